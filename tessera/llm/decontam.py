"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are the lower-cased runs between ASCII white space.  An overlap is a window of an
item (WINDOW consecutive words; the whole of a shorter item) of which PERCENT of the
words stand in a document at the same places; a window may reach over the document's
ends, where no word agrees.  An item of fewer than WHOLE words must occur whole.

A seed is the hash of the words that a fixed mask selects; it ignores the words between.
The masks are lossless: however the allowed substitutions fall, one mask finds a place
in the window that avoids them all (LONG: three in 15 words or more; MIDDLE: two in ten
or more; the tests enumerate all cases).  All windows around a hit are compared, so
every overlap is found.

A document's positions are tested against a bitmap of the items' word pairs, with which
all masks begin, and then against one of their seeds; the bitmaps have about 32 bits a
seed and BITS at most, and let no hit go.  Only what passes is joined with the seeds,
with up to 31 words around it: one pass over the documents for any benchmark, and time
linear in a document's length.  At most BLOCK_SEEDS seeds are broadcast, more are
joined by a shuffle of both sides.

Defined results: null and empty texts and items hit nothing; a repeated row of either
table adds nothing, a repeated id stands for all its texts; a null doc_id is reported as
null and kept by ``without``; an empty table on either side gives no overlaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Bitmap, materialize

#: Word positions that a seed reads; all begin with the pair (0, 1).
LONG = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))
MIDDLE = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 3, 6, 7))
WINDOW, PERCENT = 16, 80
#: Items of LEAST words or more have LONG seeds, of WHOLE or more MIDDLE ones, others one seed of all words.
LEAST, WHOLE = 15, 10
BLOCK_SEEDS = 100_000
#: Largest size of a bitmap (2 MB).
BITS = 1 << 24


def hashed_words(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_for(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(tag, mask) of the seeds of an item of n words."""
    if n >= LEAST:
        return list(enumerate(LONG))
    if n >= WHOLE:
        return [(len(LONG) + k, mask) for k, mask in enumerate(MIDDLE)]
    return [(-n, tuple(range(n)))]


def _seed(tag: int, mask: tuple[int, ...], at: Column) -> Column:
    """The hash of what the mask reads from word ``at`` of ``h`` on; null where it reaches over the end."""
    return F.when(at + mask[-1] < F.size("h"), F.xxhash64(F.lit(tag), *[F.get(F.col("h"), at + o) for o in mask]))


def _pair(at: Column, single: bool = False) -> Column:
    first = F.get(F.col("h"), at)
    return first if single else first.bitwiseXOR(F.shiftrightunsigned(F.get(F.col("h"), at + 1), 7))


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(seed, pair, item_id, n, at, lead, words): a row per seed, with the item's words around it, of which ``lead`` stand before; and one length for each kind of item."""
    items = benchmark.select("item_id", hashed_words(F.col("text")).alias("h")).where(F.size("h") > 0).distinct().withColumn("n", F.size("h"))
    kind = F.when(F.col("n") >= LEAST, LEAST).when(F.col("n") >= WHOLE, WHOLE).otherwise(F.col("n"))
    kinds = sorted(r.kind for r in items.select(kind.alias("kind")).distinct().collect())
    out = []
    for k in kinds:
        for tag, mask in masks_for(k):
            last = F.lit(0) if k < WHOLE else F.col("n") - 1 - mask[-1]
            placed = items.where(kind == k).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
            start = F.greatest(F.lit(0), F.col("at") + 1 - WINDOW)
            words = F.slice("h", start + 1, F.least(F.col("n"), F.col("at") + WINDOW) - start)
            out.append(placed.select(_seed(tag, mask, F.col("at")).alias("seed"), _pair(F.col("at"), k == 1).alias("pair"), "item_id", "n", "at", (F.col("at") - start).alias("lead"), words.alias("words")))
    empty = items.select(F.lit(0).cast("long").alias("seed"), F.lit(0).cast("long").alias("pair"), "item_id", "n", F.lit(0).alias("at"), F.lit(0).alias("lead"), F.col("h").alias("words")).limit(0)
    return reduce(DataFrame.union, out, empty), kinds


def hits(docs: DataFrame, seeds: DataFrame, kinds: list[int]) -> DataFrame:
    """doc_id, at (word), seed, lead and near (the words around it) of all positions whose seed may be one of the items'."""
    pairs, known = Bitmap(seeds.select("pair"), BITS), Bitmap(seeds.select("seed"), BITS)
    at = F.col("at")
    # Without ``outer`` Spark would test the array's size before, and compute the words twice.
    placed = docs.select("doc_id", hashed_words(F.col("text")).alias("h")).select("doc_id", "h", F.explode_outer(F.sequence(F.lit(0), F.size("h") - 1)).alias("at"))
    begins = pairs(_pair(at))
    if 1 in kinds:
        begins = begins | pairs(_pair(at, True))
    own = [_seed(tag, mask, at) for k in kinds for tag, mask in masks_for(k)]
    placed = placed.where(begins).where(reduce(Column.__or__, [known(s) for s in own]))
    start = F.greatest(F.lit(0), at + 1 - WINDOW)
    near = F.slice("h", start + 1, at + WINDOW - start)
    found = placed.select("doc_id", "at", (at - start).alias("lead"), near.alias("near"), F.explode(F.array(*own)).alias("seed"))
    return found.where(F.col("seed").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (most agreeing words of a window), window (its words), first_word (where the first such window starts)."""
    seeds, kinds = item_seeds(benchmark)
    seeds = materialize(seeds, "seeds")
    docs = docs.where(F.length("text") > 0)
    if not kinds:
        return seeds.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", *[F.lit(0).cast("long").alias(c) for c in ("matched", "window", "first_word")]).limit(0)
    theirs = seeds.select("seed", "item_id", "n", F.col("at").alias("item_at"), F.col("lead").alias("item_lead"), "words")
    hit = hits(docs, seeds, kinds).join(F.broadcast(theirs) if seeds.count() <= BLOCK_SEEDS else theirs, "seed")
    shift = F.col("lead") - F.col("item_lead")
    hit = hit.withColumn("same", F.transform("words", lambda w, j: F.coalesce((F.get(F.col("near"), j + shift) == w).cast("int"), F.lit(0))))
    # Windows by their first word, counted from the first of ``words``.
    size = F.least(F.lit(WINDOW), "n")
    starts = F.sequence(F.lit(0), F.size("words") - size)
    matched = F.transform(starts, lambda s: F.struct(F.aggregate(F.slice("same", s + 1, size), F.lit(0), lambda a, x: a + x).alias("matched"), s.alias("start")))
    good = F.filter(matched, lambda m: m["matched"] * 100 >= size * PERCENT)
    best = hit.select("doc_id", "item_id", "at", "item_lead", size.alias("size"), F.explode(good).alias("m"))
    first = F.col("at") - F.col("item_lead") + F.col("m.start")
    return best.groupBy("doc_id", "item_id").agg(F.max("m.matched").cast("long").alias("matched"), F.max("size").cast("long").alias("window"), F.min(first).cast("long").alias("first_word"))


def without(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, that overlap no item."""
    return docs.join(overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
