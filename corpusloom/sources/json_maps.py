"""Files that hold one JSON object of strings, read in byte ranges.

In a valid file a quote that no backslash escapes opens or closes a string, and strings are keys and values in turn: so the number of such quotes before a byte, modulo four, tells what the byte is part of. A first pass counts the quotes of
each range; their running sums, one number per range, let a second pass start anywhere. A range gives the entries whose key begins in it and reads on to the end of the last. What stands between strings is checked on the way: any file that is not an object of
strings fails the read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import NativeFile
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.files import open_input
from corpusloom.sources.tables import materialize

#: Bytes of a range, and most and least of those read at once behind its end: each read is twice as long as the one before.
RANGE, MORE, LEAST = 16 << 20, 64 << 10, 2 << 10
#: Bytes of small ranges that follow each other in one task.
STRETCH = 1 << 20
#: Bytes of ranges whose entries leave a task at once.
SENT = 1 << 20
_MARK = re.compile(rb'\\.|"', re.DOTALL)
_BLANK = b" \t\r\n"


class _Range:
    """Bytes of a file from ``start``, of which more can be read, and the places of unescaped quotes among them."""

    def __init__(self, path: str, start: int, end: int, file: NativeFile | None = None) -> None:
        self.file, self.start = file or open_input(path), start
        self.length = self.file.size()
        self.data, self.quotes, self.done, self.step = b"", [], 0, LEAST
        back = start
        while back and self._at(back - 1, back) == b"\\":
            back -= 1
        self.done = (start - back) % 2  # an escaped first byte
        self.more(end - start)

    def _at(self, lo: int, hi: int) -> bytes:
        self.file.seek(lo)
        return self.file.read(hi - lo)

    def more(self, n: int | None = None) -> bool:
        """Reads n bytes on, or a step; whether there were any."""
        if n is None:
            n, self.step = self.step, min(MORE, 2 * self.step)
        at = self.start + len(self.data)
        if at >= self.length:
            return False
        self.data += self._at(at, min(at + n, self.length))
        # A backslash at the very end waits for what it escapes.
        for m in _MARK.finditer(self.data, self.done):
            self.done = m.end()
            if m.group() == b'"':
                self.quotes.append(m.start())
        if not self.data.endswith(b"\\"):
            self.done = max(self.done, len(self.data))
        return True


class _Open:
    """The file that was asked for last."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def __call__(self, path: str) -> NativeFile:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            self.path, self.file = path, open_input(path)
        return self.file


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = _Open()
    for f in frames:
        n = [len(_Range(p, s, e, last(p)).quotes) for p, s, e in zip(f["path"], f["start"], f["end"], strict=True)]
        yield f.assign(quotes=n)


def _entries(path: str, start: int, end: int, seen: int, file: NativeFile | None = None) -> Iterator[tuple[str, str]]:
    r = _Range(path, start, end, file)
    wrong = lambda at: ValueError(f"{path} is not an object of strings, at byte {start + at}")
    own, first = len(r.quotes), -seen % 4
    if start == 0:
        while not r.quotes and r.more():
            pass
        if r.quotes:
            if r.data[: r.quotes[0]].strip(_BLANK) != b"{":
                raise wrong(0)
        elif not re.fullmatch(rb"\s*\{\s*\}\s*", r.data):
            raise wrong(0)
    for i in range(first, own, 4):
        # Up to the quote behind the entry, or the end of the file.
        while len(r.quotes) <= i + 4 and r.more():
            pass
        if len(r.quotes) < i + 4:
            raise wrong(r.quotes[i])
        a, b, c, d = r.quotes[i : i + 4]
        last = len(r.quotes) == i + 4
        behind = r.data[d + 1 :] if last else r.data[d + 1 : r.quotes[i + 4]]
        if r.data[b + 1 : c].strip(_BLANK) != b":" or behind.strip(_BLANK) != (b"}" if last else b","):
            raise wrong(b)
        yield json.loads(r.data[a : b + 1]), json.loads(r.data[c : d + 1])


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, found, size = _Open(), [], 0
    frame = lambda rows: pd.DataFrame({"id": pd.Series([k for k, _ in rows], dtype=object), "text": pd.Series([v for _, v in rows], dtype=object)})
    for f in frames:
        for p, s, e, n in zip(f["path"], f["start"], f["end"], f["seen"], strict=True):
            found += _entries(p, s, e, n, last(p))
            size += e - s
            if size >= SENT:
                yield frame(found)
                found, size = [], 0
    if found:
        yield frame(found)


def json_map(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """id, text of files that hold a JSON object of strings each, in ranges of ``size`` bytes. A key that a file repeats has a row each time; an empty file fails nothing and has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    each = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = each.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))
    # A stretch of ranges of a file goes to one task, which opens the file once.
    near = F.floor(F.col("start") / F.lit(max(size, STRETCH)))
    ranges = ranges.repartition("path", near).sortWithinPartitions("path", "start")
    counted = materialize(spark, ranges.mapInPandas(_counted, "path string, start long, end long, quotes long"), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    placed = counted.withColumn("seen", F.coalesce(F.sum("quotes").over(before), F.lit(0))).repartition("path", near).sortWithinPartitions("path", "start")
    return placed.mapInPandas(_read, "id string, text string")
