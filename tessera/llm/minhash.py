"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A signature is POSITIONS b-bit minima in CHUNKS chunks of LANES positions, each chunk
one 64-bit integer.  Two signatures that differ in at most LIMIT positions have, by the
pigeonhole, a chunk with at most ERRORS = LIMIT // CHUNKS differing positions.  Every
allowed error of a chunk is enumerated: a bucket for each choice of ERRORS positions to
pass over, keyed by the other positions.  So all pairs within LIMIT share a bucket; a
pair of similarity 0.75 differs in 24 positions of 96 on average and exceeds 47 with a
probability of 1.2e-7, one that is more alike far more rarely.

Candidates within LIMIT are confirmed on their full shingle sets and closed into
classes (see ``closure``).  Documents with equal sets (by a 128-bit fingerprint) are one
node from the start; the sets of nodes that share a bucket are computed once more.

Defined results: a document without words or text has an empty set and is linked with
nothing; fewer than five words are one shingle; a repeated row is an exact copy; the
texts of a repeated doc_id are one document, whose links are those of all of them;
documents without id are classed by the smallest id they reach, or null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import closure
from tessera.llm.common import Bitmap, bound_batches, drop, materialize, slices

WORDS, PERCENT = 5, 75
BITS, LANES, CHUNKS = 16, 4, 24
POSITIONS = LANES * CHUNKS
ERRORS = 1
#: Largest distance that the chunks guarantee.
LIMIT = (ERRORS + 1) * CHUNKS - 1
#: Room for the number of a key.
SLOTS = 256
KEPT_WORDS = 250_000
#: Longs of a sketch.
SKETCH = 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


@functools.cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(WORDS + 1), odd(POSITIONS), odd(POSITIONS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    by = _constants()[0]
    n = min(len(h), WORDS)
    out = np.full(len(h) - n + 1, by[WORDS] * np.uint64(n))
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * by[k]
    return np.unique(_mix(out))


def signature(items: np.ndarray) -> np.ndarray:
    """CHUNKS integers of LANES minima of BITS bits."""
    _, a, b = _constants()
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096]
        for p in range(POSITIONS):
            least[p] = min(least[p], (part * a[p] + b[p]).min())
    # The multiplied hash's low bits depend on few bits: mixed before they are cut.
    short = (_mix(least) >> np.uint64(64 - BITS)).reshape(CHUNKS, LANES)
    out = np.zeros(CHUNKS, np.uint64)
    for k in range(LANES):
        out |= short[:, k] << np.uint64(BITS * k)
    return out.view(np.int64)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs for each set."""
    return np.array([divmod(xxhash.xxh128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)


def sketch(items: np.ndarray) -> np.ndarray:
    """SKETCH integers: each item turns one of their bits."""
    odd = np.bincount((items & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a 128-bit fingerprint of the set) and signature of every document; r1 and r2 name its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            prints = fingerprints(sets)
            signs = np.concatenate([signature(s) if len(s) else np.zeros(CHUNKS, np.int64) for s in sets]) if sets else np.empty(0, np.int64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * CHUNKS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(ends, pa.array(signs))],
                ["doc_id", "r1", "r2", "n_shingles", "f1", "f2", "signature"],
            )

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_row_name())
    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, n_shingles long, f1 long, f2 long, signature array<long>")


def _row_name() -> list[Column]:
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    return [F.xxhash64(*own).alias("r1"), F.xxhash64(F.lit(1), *own).alias("r2")]


def _differing(v: Column) -> Column:
    """Lanes of an exclusive or that are not zero: every other lane at a time, one that is not zero carries into the bit above it."""
    lanes, carry = F.lit(0x0000FFFF0000FFFF), F.lit(0x0001000000010000)
    even, odd = (F.bit_count((half.bitwiseAND(lanes) + lanes).bitwiseAND(carry)) for half in (v, F.shiftrightunsigned(v, BITS)))
    return even + odd


def chunk_distance(x: str, y: str, chunk: int) -> Column:
    return _differing(F.expr(f"({x}.signature[{chunk}] ^ {y}.signature[{chunk}])"))


def differing(x: str, y: str) -> Column:
    """Number of positions in which two signatures differ."""
    return reduce(Column.__add__, [chunk_distance(x, y, c) for c in range(CHUNKS)])


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items, n, sketch) of the nodes (node, f1, f2, doc_id: one that has the set); for sketches see ``closure.may``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            prints = fingerprints(sets)
            ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
            items = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([*map(sketch, sets), np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), items, pa.array([len(s) for s in sets], pa.int32()), bits], ["f1", "f2", "items", "n", "sketch"])

    # Null ids have a hash too, so that documents without id are found.
    name = F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    wanted = materialize(nodes.select(name.alias("name")).distinct(), "wanted")
    some = docs.select(name.alias("name"), "text").where(Bitmap(wanted)(F.col("name"))).join(wanted, "name", "left_semi")
    found = some.select("text").mapInArrow(run, "f1 long, f2 long, items array<long>, n int, sketch array<long>")
    return materialize(found.join(nodes.select("f1", "f2", "node"), ["f1", "f2"]).dropDuplicates(["node"]).select("node", "items", "n", "sketch"), "sets")


def _labelled(docs: DataFrame) -> DataFrame:
    """What ``signatures`` gives, without them, with ``label``: a number for each class of linked documents with words."""
    signed = materialize(signatures(docs), "signatures")
    # Equal sets are one node; partial sums make a hot set small.
    some = signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = materialize(some.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = []
    for c in range(CHUNKS):
        for k in range(LANES):
            mask = ~(((1 << BITS) - 1) << (BITS * k)) & 0xFFFFFFFFFFFFFFFF
            mask = mask - (1 << 64) if mask >= 1 << 63 else mask
            keys.append(F.xxhash64(F.lit(c * LANES + k), F.col("signature")[c].bitwiseAND(F.lit(mask))))
    # The number of shingles and the place of the bucket among the keys in one long.
    dealt = nodes.select("node", F.col("n_shingles").alias("n_"), F.posexplode(F.array(*keys)).alias("slot", "bucket"))
    rows = closure.shared(dealt.select("bucket", "node", (F.col("n_") * SLOTS + F.col("slot")).alias("size")))
    met = materialize(rows.select("node").distinct(), "met")
    short = materialize(nodes.join(met, "node", "left_semi").select("node", "f1", "f2", "doc_id", "signature"), "met-nodes")
    sets = sets_of(docs, short)

    def sizes(x: str, y: str) -> Column:
        a, b = (F.expr(f"{r}.size DIV {SLOTS}") for r in (x, y))
        return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)

    # The texts of one id are one document.
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "f1", "f2").join(nodes.select("f1", "f2", "node"), ["f1", "f2"])
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    more = materialize(named.join(same_id, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct(), "same-id")
    labels = closure.classes(rows, sets, PERCENT, sizes, more, short.select("node", "signature"), lambda x, y: differing(x, y) <= LIMIT)
    label = nodes.join(labels, "node", "left").select("f1", "f2", F.coalesce("label", "node").alias("label"))
    out = materialize(signed.drop("signature").join(label, ["f1", "f2"], "left"), "labelled")
    drop(signed, rows, met, short, sets)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = _labelled(docs)
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "label", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, with all columns, of each class: that of the smallest doc_id, then of any one text of it; documents without words stay."""
    rows = _labelled(docs)
    name = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "r1", "r2")
    kept = rows.groupBy("label").agg(F.min(name).alias("kept"))
    gone = rows.where("label IS NOT NULL").join(kept, "label").where(name != F.col("kept")).select("r1", "r2")
    twice = rows.where("label IS NOT NULL").groupBy("r1", "r2").count().where("count > 1").select("r1", "r2")
    named = docs.withColumns({"r1_": _row_name()[0], "r2_": _row_name()[1]})
    out = named.join(gone.distinct().select(F.col("r1").alias("r1_"), F.col("r2").alias("r2_")), ["r1_", "r2_"], "left_anti")
    if not twice.isEmpty():
        out = out.dropDuplicates(["r1_", "r2_"])
    return out.select(*docs.columns)
