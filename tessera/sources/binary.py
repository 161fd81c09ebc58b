"""Readers and writers of binary vector files as Spark data sources.

    register(spark)
    spark.read.format("vectors").option("layout", "fbin").load(uri)

Layouts (little-endian):

    fbin      uint32 n, dim; then n x dim float32.  With ``part`` = queries the file
              beside it whose name ends in _query.fbin.
    data_new  uint32 unused, n, dim; then rows.  With ``part`` = queries the first
              ``split`` rows (default 200), with data (default) those after them, ids
              from 0.
    fvecs     each row uint32 dim and its float32 values; rows may differ in length.
    ivecs     the same with int32 values.
    strided   ``skip`` bytes, then rows of ``gap`` bytes and dim float32; dim is the
              uint32 at the file's start.  Bytes behind the last whole row are ignored.
    knng      uint32 n; then per node int32 k and k x uint32 neighbours.
    truth     int32 n, k; n x k int32 ids; then n x k float32 scores.

Rows of a fixed size are read by range, a partition for each ROWS of them; the others
by one partition a file.  Without a layout, paths with "deep1B", "yandex" or ending in
.fbin are fbin, .fvecs and .ivecs by name, and the rest data_new.  A file shorter than
its header says raises an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROWS = 100_000
SCHEMAS = {"truth": "qid long, rank int, id long, score float", "knng": "src long, nbrs array<long>", "ivecs": "id long, vec array<int>"}


def layout_of(path: str) -> str:
    if "deep1B" in path or "yandex" in path or path.endswith(".fbin"):
        return "fbin"
    for name in ("fvecs", "ivecs", "knng", "truth"):
        if path.endswith("." + name):
            return name
    return "data_new"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _layout(self) -> str:
        return self.options.get("layout") or layout_of(self.options["path"])

    def schema(self) -> str:
        return SCHEMAS.get(self._layout(), "id long, vec array<float>")

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options, self._layout())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VectorWriter(self.options, self._layout(), schema)


class VectorReader(DataSourceReader):
    def __init__(self, options: dict, layout: str):
        self.path, self.layout = options["path"], layout
        self.part, self.split = options.get("part", "data"), int(options.get("split", 200))
        self.skip, self.gap = int(options.get("skip", 0)), int(options.get("gap", 0))
        if layout == "fbin" and self.part == "queries" and not self.path.endswith("_query.fbin"):
            self.path = self.path.removesuffix(".fbin") + "_query.fbin"

    def _file(self):
        where, path = opened(self.path)
        return where.open_input_file(path)

    def _shape(self, f) -> tuple[int, int, int, int]:
        """First byte of the rows, number of rows, dim, bytes from row to row."""
        if self.layout == "strided":
            dim = int(np.frombuffer(f.read_at(4, 0), "<u4")[0])
            step = 4 * dim + self.gap
            return self.skip, max(0, f.size() - self.skip) // step if step else 0, dim, step
        if self.layout == "fbin":
            n, dim = (int(x) for x in np.frombuffer(f.read_at(8, 0), "<u4"))
            return 8, n, dim, 4 * dim
        _, n, dim = (int(x) for x in np.frombuffer(f.read_at(12, 0), "<u4"))
        first, count = (0, min(self.split, n)) if self.part == "queries" else (min(self.split, n), max(0, n - self.split))
        return 12 + 4 * dim * first, count, dim, 4 * dim

    def partitions(self) -> list[Rows]:
        if self.layout in ("fbin", "data_new", "strided"):
            with self._file() as f:
                n = self._shape(f)[1]
            return [Rows(a, min(a + ROWS, n)) for a in range(0, n, ROWS)] or [Rows(0, 0)]
        return [Rows(0, -1)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with self._file() as f:
            if self.layout in ("fbin", "data_new", "strided"):
                at, _, dim, step = self._shape(f)
                for i in range(partition.start, partition.stop, 4096):
                    m = min(4096, partition.stop - i)
                    raw = f.read_at(m * step, at + i * step)
                    if len(raw) < m * step:
                        raise ValueError(f"{self.path} ends within row {i + len(raw) // max(step, 1)}")
                    data = np.frombuffer(raw, "u1").reshape(m, step)[:, step - 4 * dim :]
                    for j, row in enumerate(np.ascontiguousarray(data).view("<f4")):
                        yield i + j, row.tolist()
            elif self.layout in ("fvecs", "ivecs"):
                i = 0
                while head := f.read(4):
                    row = np.frombuffer(f.read(4 * int(np.frombuffer(head, "<u4")[0])), "<f4" if self.layout == "fvecs" else "<i4")
                    yield i, row.tolist()
                    i += 1
            elif self.layout == "knng":
                for i in range(int(np.frombuffer(f.read(4), "<u4")[0])):
                    k = int(np.frombuffer(f.read(4), "<i4")[0])
                    yield i, np.frombuffer(f.read(4 * k), "<u4").tolist()
            elif self.layout == "truth":
                n, k = (int(x) for x in np.frombuffer(f.read(8), "<i4"))
                ids = np.frombuffer(f.read(4 * n * k), "<i4").reshape(n, k)
                scores = np.frombuffer(f.read(4 * n * k), "<f4").reshape(n, k)
                for q in range(n):
                    for r in range(k):
                        yield q, r + 1, int(ids[q, r]), float(scores[q, r])
            else:
                raise ValueError(f"unknown layout {self.layout}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    n: int
    width: int


class VectorWriter(DataSourceWriter):
    """One file in order of the rows; sort by id and coalesce(1) for a file, or write the parts below a folder for more.

    The rows go to part files first and are joined when all tasks have ended.
    """

    def __init__(self, options: dict, layout: str, schema):
        self.path, self.layout, self.names = options["path"], layout, [f.name for f in schema.fields]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        where, path = opened(self.path)
        name = f"{path}.{TaskContext.get().partitionId():06d}.{uuid.uuid4().hex}.part"
        n = width = 0
        with where.open_output_stream(name) as out:
            for row in rows:
                values = row["nbrs" if self.layout == "knng" else "vec"]
                data = np.asarray(values, "<u4" if self.layout == "knng" else "<i4" if self.layout == "ivecs" else "<f4")
                if self.layout in ("fvecs", "ivecs", "knng"):
                    out.write(np.array([len(data)], "<u4").tobytes())
                elif n and len(data) != width:
                    raise ValueError("rows of this layout have one length")
                out.write(data.tobytes())
                n, width = n + 1, len(data)
        return Written(name, n, width)

    def commit(self, messages: list) -> None:
        where, path = opened(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.name)
        n, width = sum(m.n for m in done), max([m.width for m in done if m.n], default=0)
        head = {"fbin": [n, width], "data_new": [0, n, width], "knng": [n]}.get(self.layout, [])
        with where.open_output_stream(path) as out:
            out.write(np.array(head, "<u4").tobytes())
            for m in done:
                with where.open_input_stream(m.name) as part:
                    while data := part.read(1 << 20):
                        out.write(data)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, _ = opened(self.path)
        for m in messages:
            if m:
                where.delete_file(m.name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorSource)


def write_truth(truth: DataFrame, uri: str, k: int, score: str = "ip") -> None:
    """Truth (qid from 0, rank, id, score) of a bounded query set as one file."""
    rows = truth.where(F.col("rank") <= k).orderBy("qid", "rank").select("id", score).collect()
    where, path = opened(uri)
    with where.open_output_stream(path) as out:
        out.write(np.array([len(rows) // k, k], "<i4").tobytes())
        out.write(np.array([r[0] for r in rows], "<i4").tobytes())
        out.write(np.array([r[1] for r in rows], "<f4").tobytes())


def gathered(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose ids are listed."""
    return points.join(ids.select("id"), "id", "left_semi")


def appended(points: DataFrame, more: DataFrame) -> DataFrame:
    return points.unionByName(more)
