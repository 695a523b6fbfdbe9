"""WARC archives in Zstandard frames: one frame per record, after a leading skippable frame that holds the dictionary.

Writing: equal payloads are found by SHA-256 with a map-side minimum of page_id; each record goes to a file of about ``FILE_BYTES`` of records. A task
trains the dictionary of its files on ``TRAIN_BYTES`` of the records of its first file and on made-up records of the same form, so every archive has one, however few its pages.
Reading: the leading frame is loaded as the dictionary (plain or itself compressed), frames are decoded one by one, and each record's version, headers, block length and
end, HTTP length and, for responses, payload digest are checked. Any fault raises ``WarcError``.

Null html is an empty payload; null url gives a record without target. Rows that repeat a page_id have a record each, and those of the smallest page_id of a
payload are all responses. Rows without a page_id are responses and never referred to. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.llm.files import open_input, write_whole
from corpusloom.llm.runtime import balanced_join, materialize, partitions, scratch_path, ship

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
FILE_BYTES, TRAIN_BYTES, DICT_BYTES, LEVEL = 8 << 20, 1 << 20, 16 << 10, 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    pass


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http + (payload if refers_to is None else b""))


def _own_form() -> list[bytes]:
    """Records of this module's form, so that a dictionary can be trained for any number of pages."""
    page = "<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{0}</title></head><body><div class=\"{1}\"><p>{0}</p><a href=\"/{1}\">{1}</a></div></body></html>"
    out = []
    for i in range(64):
        payload = page.format(hashlib.sha256(b"%d" % i).hexdigest(), f"page-{i * i}").encode()
        out.append(page_record(i, f"http://host{i}/{i * 7919}", payload, hashlib.sha256(payload).hexdigest(), i if i % 8 == 7 else None))
    return out


def trained(records: list[bytes]) -> bytes:
    """A dictionary from ``TRAIN_BYTES`` of the records and some of this module's own form."""
    sample, held = _own_form(), 0
    for r in records:
        sample.append(r[:65536])
        held += len(sample[-1])
        if held >= TRAIN_BYTES:
            break
    return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8).as_bytes()


def archive(records: list[bytes], dictionary: bytes) -> list[bytes]:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
    return [SKIPPABLE.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed, *[made.compress(r) for r in records]]


def frames(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The content of each frame of a .warc.zst stream."""
    data = source.read(8)
    known = None
    if len(data) == 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        size = int.from_bytes(data[4:], "little")
        content = source.read(size)
        if len(content) != size:
            raise WarcError("the dictionary frame is cut off")
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
        data = b""
    decoder = zstandard.ZstdDecompressor(dict_data=known)
    try:
        while True:
            data = data or source.read(chunk)
            if not data:
                return
            frame = decoder.decompressobj()
            parts = []
            while not frame.eof:
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else source.read(chunk)
                if not frame.eof and not data:
                    raise WarcError("a frame is cut off")
            yield b"".join(parts)
    except zstandard.ZstdError as e:
        raise WarcError(f"a frame can't be decoded: {e}") from e


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"no header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no record: {data[:40]!r}")
    headers = _headers(lines)
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"{need} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length is not as declared")
    return headers, rest[:-4]


def page_of(data: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); None for other kinds of record."""
    headers, block = parse(data)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP response in the block")
    size = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
    method, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if not size.isdigit() or method != "sha256":
        raise WarcError("the payload's length or digest is missing")
    if kind == "response" and (len(payload) != int(size) or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload is not as declared")
    if kind == "revisit" and (payload or "x-refers-to-page-id" not in headers):
        raise WarcError("a revisit has a payload or no target")
    page, to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return None if page is None else int(page), int(size), digest, kind, None if to is None else int(to)


def _writer(path: str) -> Callable:
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, seq, dictionary = 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal dictionary
            if dictionary is None:
                dictionary = trained(held)
            at = f"{path}/pages-{TaskContext.get().partitionId():06d}-{seq:06d}.warc.zst"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            write_whole(at, archive([info, *held], dictionary))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(held)], pa.int64())], schema=schema)

        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = page_record(page_id, url, (html or "").encode(), digest, refers_to)
                if held and size + len(r) > FILE_BYTES:
                    yield close()
                    held, size, seq = [], 0, seq + 1
                held.append(r)
                size += len(r)
        if held:
            yield close()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for b in batches:
        for path, declared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            with open_input(path) as f:
                rows = [r for data in frames(f) if (r := page_of(data)) is not None]
            if len(rows) != declared:
                raise WarcError(f"{path} has {len(rows)} records of {declared}")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("size"))
    small = own.where(F.col("size") >= least).select("page_id", "digest")
    firsts, _ = materialize(pages.sparkSession, small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n")).where("n > 1"), "payloads")
    later = balanced_join(small.where("page_id is not null"), firsts, ["digest"], ["page_id"], "n").where("page_id > first")
    marks = later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    joined = own.join(marks, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to")


def write_archives(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Writes pages(page_id, url, html) below path and returns the manifest (path, records)."""
    ship(spark)
    return materialize(spark, with_revisits(pages).mapInArrow(_writer(path), "path string, records long"), "warc-manifest")[0]


def read_archives(manifest: DataFrame, tasks: int) -> DataFrame:
    return manifest.select("path", "records").repartition(tasks, "path").mapInArrow(_reader, RESULT)


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(spark, pages, scratch_path(spark, "warc")), partitions(spark))
