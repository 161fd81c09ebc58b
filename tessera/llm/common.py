"""What the operators of this subpackage share: tables, the shared folder, Arrow slices."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the shingle operators: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents handled together by a Python kernel.
SLICE = 128
#: Largest size of a bitmap (8 MB).
BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, as a URI all executors can open.

    Where that setting is unset, below the session's checkpoint folder; where there is
    none either, a local master (tests) gets a folder of this machine, a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        base = spark.sparkContext.getCheckpointDir()
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more, and let Spark find the shuffles behind them."""
    spark = tables[0].sparkSession
    for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # Shuffle files are removed when the driver's collector finds their plans unused.
    spark._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """At most so many rows in an Arrow batch of this session: batches of long texts stay small on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def finished_file(uri: str):
    """A file that appears under its name only when it is whole, so a repeated task does no harm."""
    where, path = open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as out:
        yield out
    where.move(part, path)


def make_dir(uri: str) -> None:
    where, path = open_fs(uri)
    where.create_dir(path, recursive=True)


class Bitmap:
    """A filter that lets all keys through and few others: about 32 bits a key, ``most`` bits at most.

    The keys are one long column whose low bits are spread evenly (hashes).  The words of
    the bitmap are one array, read by a scalar subquery.
    """

    def __init__(self, keys: DataFrame, most: int = BITS):
        self.bits = min(most, max(1 << 12, 1 << (32 * keys.count() - 1).bit_length()))
        slot = F.col(keys.columns[0]).bitwiseAND(F.lit(self.bits - 1))
        parts = keys.select(F.shiftright(slot, 6).alias("place"), slot.bitwiseAND(F.lit(63)).cast("int").alias("s"))
        some = parts.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("word"))
        every = keys.sparkSession.range(self.bits // 64).withColumnRenamed("id", "place").join(some, "place", "left")
        words = F.array_sort(F.collect_list(F.struct("place", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
        self.words = every.agg(F.transform(words, lambda x: x["word"]).alias("words")).scalar()

    def __call__(self, key: Column) -> Column:
        slot = key.bitwiseAND(F.lit(self.bits - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        return F.coalesce(F.get(self.words, F.shiftright(slot, 6).cast("int")).bitwiseAND(bit) != 0, F.lit(False))
