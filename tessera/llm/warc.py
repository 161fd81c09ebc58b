"""WARC archives with a two-level capture index.

``write`` deals the pages by range of (reversed-host URL key, page_id) and writes per
part, in that order: ``part-*.warc.gz`` (a gzip member per record), ``part-*.cdx.gz``
(index lines in gzip blocks of BLOCK_LINES) and ``part-*.dir`` (the sparse directory:
first key, offset and length of each block).  ``lookup`` finds the parts of a key by
their key range, binary-searches the directory and the block, and range-reads the
records; the captures of a key lie side by side in the archive.

Equal payloads of at least MIN_DUPLICATE bytes are stored once: the smallest page_id
is the response, the others revisit it.  Defined results: a null html is an empty
payload; a null or odd url is its own key; a page without id is always a response,
as are repeated rows of the response's page; an empty table gives no parts.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import finished_file, make_dir, materialize, open_fs, shared_dir, slices

MIN_DUPLICATE = 100
BLOCK_LINES = 300
LEVEL = 2
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTS = "part int, first_key string, last_key string, n long, warc string, cdx string, dir string"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Reversed host, then ")", then the rest without the fragment: com,example,www)/path?query."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, pattern, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, pattern, 2))
    return F.regexp_replace(F.when(host != "", key).otherwise(F.concat(F.lit(")"), url)), r"[\x00-\x20\x7F]", "%20")


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload size n, digest, key, refers_to (null: response) and the response record of each page.

    Records are compressed before any shuffle, and a revisit's is dropped.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    small = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= MIN_DUPLICATE).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    # The hot payload's rows can be split by the join: one row stands on the other side.
    revisits = small.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    # Written first, so that the planner knows its size: records are only shuffled for the join if this is too large to broadcast.
    revisits = materialize(revisits, "warc-revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, urls, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [(h or "").encode() for h in batch.column(2).to_pylist()]
            digests = [hashlib.sha256(p).hexdigest() for p in payloads]
            records = [_record(i, u, d, len(p), p, None) for i, u, d, p in zip(ids, urls, digests, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, payloads), pa.int64()), pa.array(digests, pa.string()), pa.array(records, pa.binary())], ["page_id", "url", "n", "digest", "record"])

    made = pages.mapInArrow(run, "page_id long, url string, n long, digest string, record binary")
    out = made.withColumn("key", url_key(F.col("url"))).join(revisits, ["page_id", "digest"], "left")
    return out.select("key", "page_id", "url", "digest", "n", "refers_to", F.when(F.col("refers_to").isNull(), F.col("record")).alias("record"))


def _record(page_id: int | None, url: str | None, digest: str, n: int, payload: bytes, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


#: Characters of a URL that are written as they are; the others, "%" too, are escaped, so that reading gives the same URL.
SAFE = "/:?#[]@!$&'()*+,;=-._~"


def parse(record: bytes) -> dict:
    """page_id, url, payload digest and size, type and reference of an expanded record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(name, ""))) else None
    revisit = fields["WARC-Type"] == "revisit"
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = said if revisit else hashlib.sha256(payload).hexdigest()
    if digest != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("WARC-Record-ID"), "url": None if url is None else unquote(url), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) below folder; returns a row per part."""
    make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        names = [f"{folder}/part-{part:06d}.{x}" for x in ("warc.gz", "cdx.gz", "dir")]
        directory, lines, at, n, last, index_at = [], [], 0, 0, "", 0
        with finished_file(names[0]) as warc, finished_file(names[1]) as cdx:

            def close_block():
                nonlocal index_at
                block = zlib.compress("\n".join(lines).encode(), LEVEL)
                cdx.write(block)
                directory.append([lines[0].split(" ", 1)[0], index_at, len(block)])
                index_at += len(block)
                lines.clear()

            for key, page_id, url, digest, size, refers_to, record in _with(first, rows):
                if record is None:
                    record = _record(page_id, url, digest, size, b"", refers_to)
                warc.write(record)
                lines.append(f"{key} {at} {len(record)}")
                at, n, last = at + len(record), n + 1, key
                if len(lines) == BLOCK_LINES:
                    close_block()
            if lines:
                close_block()
        with finished_file(names[2]) as out:
            out.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first_key": [first[0]], "last_key": [last], "n": pa.array([n], pa.int64()), "warc": [names[0]], "cdx": [names[1]], "dir": [names[2]]})

    order = ["key", F.col("page_id").asc_nulls_first()]
    sorted_pages = with_roles(pages).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_pages.mapInArrow(run, PARTS), "warc-parts")


def _with(first, rest):
    yield first
    yield from rest


class PartIndex:
    """Directory, current block and archive of one part, read as needed."""

    def __init__(self, cdx: str, directory: str, warc: str):
        self.files = []
        for name in (cdx, warc):
            where, path = open_fs(name)
            self.files.append(where.open_input_file(path))
        where, path = open_fs(directory)
        with where.open_input_file(path) as f:
            self.blocks = json.loads(f.read())
        self.first_keys = [b[0].encode() for b in self.blocks]
        self.held, self.lines, self.keys = -1, [], []

    def _block(self, i: int) -> None:
        if i != self.held:
            _, at, n = self.blocks[i]
            rows = [line.rsplit(" ", 2) for line in zlib.decompress(self.files[0].read_at(n, at)).decode().split("\n")]
            self.held, self.keys, self.lines = i, [r[0].encode() for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def captures(self, key: str) -> Iterator[dict]:
        """The captures of a key; the records of a block that hold it are one range read."""
        want = key.encode()  # Spark orders strings by their bytes
        i = max(0, bisect.bisect_left(self.first_keys, want) - 1)
        while i < len(self.blocks) and self.first_keys[i] <= want:
            self._block(i)
            a, b = bisect.bisect_left(self.keys, want), bisect.bisect_right(self.keys, want)
            if a < b:
                start = self.lines[a][0]
                data = self.files[1].read_at(sum(self.lines[b - 1]) - start, start)
                for at, n in self.lines[a:b]:
                    yield parse(zlib.decompress(data[at - start : at - start + n], 31))
            i += 1


def lookup(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """All captures of the keys (one string column; nulls and repeats are passed over), read from the archives.

    What the driver holds of the archive is a line per part (its key range and file names).
    """
    held = [tuple(r) for r in parts.orderBy("first_key", "part").collect()]
    spark = parts.sparkSession
    column = keys.columns[0]
    first, last = [p[1].encode() for p in held], [p[2].encode() for p in held]

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                want = key.encode()
                rows += [(i, key) for i in range(bisect.bisect_left(last, want), bisect.bisect_right(first, want))]
            yield pa.RecordBatch.from_pydict({"at": pa.array([r[0] for r in rows], pa.int32()), "key": pa.array([r[1] for r in rows], pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, out = -1, None, []
        for batch in batches:
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != at:
                    at, index = i, PartIndex(held[i][5], held[i][6], held[i][4])
                for capture in index.captures(key):
                    out.append(capture)
                    if len(out) == 2000:
                        yield _captures(out)
                        out = []
        yield _captures(out)

    wanted = keys.select(F.col(f"`{column}`").cast("string").alias("key")).where("key is not null").distinct()
    tasks = max(1, min(len(held), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = wanted.mapInArrow(parts_of, "at int, key string").repartition(tasks, "at").sortWithinPartitions("at", "key")
    return dealt.mapInArrow(run, CAPTURE)


def _captures(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string()}
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in names})


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages and read every capture back through the index."""
    parts = write(pages, folder or shared_dir(spark, "warc"))
    return lookup(pages.select(url_key(F.col("url")).alias("key")), parts)
