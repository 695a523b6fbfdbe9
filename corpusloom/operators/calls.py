"""Calls of a remote model that are resumed where they stopped.

Replies are kept in a store below a folder, by the digest of their prompt. A run asks only for prompts without a reply, each once however many rows have it. A task keeps a window of calls in flight and passes replies on as they
come, in files of a few each that are seen whole or not at all; so what has been answered is kept when a run is stopped, and when a task is lost and made again, which first reads what its share of this run has in the store. Failed calls are not kept
and are asked for by the next run. The limit of calls at once is one for the job: it is divided over the tasks.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.operators.components import dealt_join
from corpusloom.sources.files import contents, put
from corpusloom.sources.tables import exists, materialize

REPLIES = "digest string, reply string, attempts int"
ASKED = "digest string, reply string, error string, attempts int"
SUFFIX = ".jsonl"


def digest_of(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def kept_replies(spark: SparkSession, store: str) -> DataFrame:
    """digest, reply, attempts of all runs, one of each digest."""
    if not exists(spark, store):
        return spark.createDataFrame([], REPLIES)
    rows = spark.read.schema(REPLIES).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").json(store)
    return rows.groupBy("digest").agg(F.min("reply").alias("reply"), F.min("attempts").alias("attempts"))


def _asking(client: Callable[[str], str], folder: str, at_once: int, attempts: int, flush: int) -> Callable:
    def call(digest: str, prompt: str) -> tuple[str, str | None, str | None, int]:
        said = ""
        for n in range(1, attempts + 1):
            try:
                return digest, client(prompt), None, n
            except Exception as e:  # noqa: BLE001  a remote client may raise anything; the row carries it
                said = str(e) or type(e).__name__
        return digest, None, said, attempts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = f"{folder}/share={TaskContext.get().partitionId():06d}"
        # What an earlier attempt of this task has been told.
        known = {r["digest"]: r for f in contents(own, SUFFIX) for r in map(json.loads, f.decode().splitlines())}
        prompts = ((d, p) for f in frames for d, p in zip(f["digest"].tolist(), f["prompt"].tolist(), strict=True))
        flying: set[Future] = set()
        held: list[tuple] = []

        def keep(rows: list[tuple]) -> pd.DataFrame:
            if good := [r for r in rows if r[2] is None and r[0] not in known]:
                text = "".join(json.dumps({"digest": d, "reply": reply, "attempts": n}) + "\n" for d, reply, _, n in good)
                put(f"{own}/{uuid.uuid4().hex}{SUFFIX}", text.encode())
            return pd.DataFrame(rows, columns=["digest", "reply", "error", "attempts"]).astype({"digest": object, "reply": object, "error": object})

        with ThreadPoolExecutor(at_once) as pool:
            more = True
            while more or flying:
                while more and len(flying) < at_once:
                    if (nxt := next(prompts, None)) is None:
                        more = False
                    elif nxt[0] in known:
                        held.append((nxt[0], known[nxt[0]]["reply"], None, known[nxt[0]]["attempts"]))
                    else:
                        flying.add(pool.submit(call, *nxt))
                    if len(held) >= flush:
                        break
                if flying:
                    done, flying = wait(flying, return_when=FIRST_COMPLETED)
                    held += [f.result() for f in done]
                if len(held) >= flush:
                    yield keep(held)
                    held = []
        if held:
            yield keep(held)

    return run


def ask(spark: SparkSession, prompts: DataFrame, store: str, client: Callable[[str], str], limit: int = 8, attempts: int = 1, flush: int = 1, tasks: int | None = None) -> DataFrame:
    """digest, reply, error, attempts of the prompts(prompt) that the store has no reply to, after asking client for them; null prompts are not asked.

    At most ``limit`` calls are in flight, and at most ``flush`` replies of a task are not yet in the store when it is stopped. A reply is any string but null.
    """
    each = prompts.where("prompt is not null").select("prompt").distinct().select(digest_of(F.col("prompt")).alias("digest"), "prompt")
    missing = each.join(kept_replies(spark, store).select("digest"), "digest", "left_anti")
    tasks = max(1, min(limit, tasks or spark.sparkContext.defaultParallelism))
    folder = f"{store}/run={uuid.uuid4().hex}"
    dealt = missing.repartition(tasks, "digest").sortWithinPartitions("digest")
    return materialize(spark, dealt.mapInPandas(_asking(client, folder, limit // tasks, attempts, flush), ASKED), "asked")


def answered(rows: DataFrame, prompt: str, store: str) -> DataFrame:
    """rows with ``reply`` and ``attempts`` from the store, null where there is none. A prompt of very many rows is dealt to several tasks."""
    spark = rows.sparkSession
    keyed = materialize(spark, rows.withColumn("_digest", F.coalesce(digest_of(F.col(prompt)), F.lit(""))), "prompts")
    counts = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    kept = kept_replies(spark, store).withColumnRenamed("digest", "_digest")
    return dealt_join(keyed, counts.join(kept, "_digest", "left"), "_digest", keyed.columns[:1], "_n").drop("_digest")
