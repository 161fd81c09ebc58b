"""Language ID by the nearest of several centroids per language.

A text is a vector of hashed letter bigrams and trigrams, log term frequency times
IDF, of length one.  Each language has CENTROIDS centres from spherical k-means over
a bounded sample (SAMPLE training documents by id hash); the IDF counts cover all
training documents.  The nearest centre by cosine names the language; a text much
further from it than the language's own sample is rejected (SHARE, LOW).

Defined results: ``und`` with score 0 and rejected for a null text, a text without a
letter, or when nothing could be learned; ties go to the smaller language name; rows
are predicted one by one, so repeated rows get equal results; a document without
doc_id is neither held out nor learned from.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Bitmap, bound_batches, materialize, slices

FEATURES = 8192
CENTROIDS = 4
#: Training documents per language that the centres are fitted on; counts cover all.
SAMPLE = 400
ROUNDS = 12
#: A text is rejected below SHARE of the LOW quantile of its language's sample (cosine with the nearest centre);
#: a text of fewer than MANY distinct n-grams below less, as the root of their number.
SHARE, LOW, MANY = 0.35, 0.02, 200
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts per text; all zero without letters."""
    data = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "replace"), "<u4") for t in texts]
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    codes = np.concatenate([*data, np.empty(0, "<u4")])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[:1] = True
    kept[1:] |= owner[1:] != owner[:-1]
    codes, owner = codes[kept], owner[kept]
    out = np.zeros(len(texts) * FEATURES, np.int64)
    mixed = codes * np.uint32(0x9E3779B1)
    for n in (2, 3):
        if len(codes) < n:
            continue
        h, some = mixed[: len(codes) - n + 1].copy(), codes[: len(codes) - n + 1] != 32
        for k in range(1, n):
            part = slice(k, len(codes) - n + 1 + k)
            h ^= h >> np.uint32(15)
            h = h * np.uint32(0x85EBCA6B) + mixed[part]
            some |= codes[part] != 32
        h ^= h >> np.uint32(16)
        h *= np.uint32(0xC2B2AE35)
        some &= owner[: len(h)] == owner[n - 1 :]
        out += np.bincount(owner[: len(h)][some] * FEATURES + (h[some] >> np.uint32(19)), minlength=len(out))
    return out.reshape(len(texts), FEATURES)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(rows, dtype=np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def centres(rows: np.ndarray) -> np.ndarray:
    """Spherical k-means from spread-out starts: each next start is the row furthest from those taken."""
    taken = [0]
    near = rows @ rows[0]
    while len(taken) < min(CENTROIDS, len(rows)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[taken[-1]])
    out = rows[taken]
    for _ in range(ROUNDS):
        own = (rows @ out.T).argmax(axis=1)
        out = np.stack([rows[own == k].sum(axis=0) if (own == k).any() else out[k] for k in range(len(out))])
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Centres and their languages, in the order of the names."""

    def __init__(self, names: list[str], rows: np.ndarray, idf: np.ndarray, bounds: np.ndarray):
        self.names, self.rows, self.idf, self.bounds = names, rows, idf, bounds

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        found = counts(texts)
        if not self.names:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        near = vectors(found, self.idf) @ self.rows.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(texts)), best].astype(float), 0, 1)
        grams = (found > 0).sum(axis=1)
        bound = SHARE * self.bounds[best] * np.sqrt(np.minimum(grams / MANY, 1))
        return [(self.names[b], s, bool(s < low)) if n else (UNKNOWN, 0.0, True) for b, s, low, n in zip(best, score.tolist(), bound, grams, strict=True)]


def fit(docs: DataFrame, learn: Column) -> Model:
    """Learn from the documents (doc_id, text, lang) where ``learn`` holds and lang and text are not null."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches):
            seen += (counts(batch.column(0).to_pylist()) > 0).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "seen": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    # A row a task, summed by feature; what the driver gets is FEATURES numbers.
    by_task = rows.select("text").mapInArrow(frequencies, "n long, seen array<long>")
    summed = by_task.select("n", F.posexplode("seen").alias("feature", "seen")).groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n")).collect()
    n, idf = 0, np.ones(FEATURES, np.float32)
    for r in summed:
        n, idf[r.feature] = r.n, np.log((1 + r.n) / (1 + r.seen)) + 1

    # The least hashes of a language, of 64 parts first: no task gathers more than SAMPLE rows from each of those.
    chosen = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    for keys in (("lang", "part"), ("lang",)):
        chosen = chosen.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("at") <= SAMPLE)
    chosen = materialize(chosen.select("doc_id", "lang").distinct(), "langid-sample")
    wanted = Bitmap(chosen.select(F.xxhash64("doc_id").alias("h")))
    texts = rows.where(wanted(F.xxhash64("doc_id"))).join(chosen, ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        found = np.concatenate([counts(part["text"].iloc[i : i + 64].tolist()) for i in range(0, len(part), 64)])
        found = found[found.any(axis=1)]
        x = vectors(found, idf)
        out = centres(x) if len(found) else np.empty((0, FEATURES))
        low = float(np.quantile((x @ out.T).max(axis=1), LOW)) if len(found) else 0.0
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [r.tolist() for r in out], "low": low}, columns=["lang", "centre", "low"])

    got = texts.groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, low double").collect()
    got = sorted(got, key=lambda r: r.lang)
    return Model([r.lang for r in got], np.array([r.centre for r in got], np.float32).reshape(len(got), FEATURES), idf, np.array([r.low for r in got]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            got = model.predict(batch.column(1).to_pylist())
            names, scores, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose text is not rejected."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            kept = [not rejected for _, _, rejected in model.predict(batch.column(names.index("text")).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    out = predict(docs, fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
