"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words (lower-cased A-Z, between ASCII white space) are tokens.  Those that occur at
least sqrt(tokens of the corpus) / RARE times (the OWN most frequent at least) have an
id of their own; the others share hashed ids, one for 15 own ids, BUCKETS at least.
Each token is masked in turn and predicted from the SIDE tokens on either side:

    h = tanh(b + sum over positions p of E[p][context token at p])
    log P(token) = log softmax(h Wc + bc)[class] + log softmax(h Ww[class] + bw[class])[member]

with two softmax levels, each of about the square root of the number of ids (CLASSES x
MEMBERS at least).  A word without its own id has the probability of its shared id times
its part of the occurrences of that id's words in the corpus, from a table of all word
counts: every word is scored apart, and the probabilities of all words sum to at most 1.
A document's score is the sum of its tokens' conditional log-probabilities; beyond its
ends the context is the pad token.

Training covers every token of every document: the word counts come from all of them,
and each task trains on its own documents from the same start (Adagrad); parameters are
averaged by tokens seen, in blocks and in two levels, so that no task gathers more than
sums.  The driver holds one model; it has about 640 bytes a word with an id, whose
number follows the square root of the corpus.  Word counts stay a table, joined to the
documents' words by 64-bit hashes: two words of one hash would count as one.

Defined results: null, empty or white-space text has 0 tokens, log_prob 0 and a null
perplexity; an empty table gives no rows; repeated rows get the same score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

CLASSES, MEMBERS = 32, 32
TOKENS = CLASSES * MEMBERS
BUCKETS = 64
RARE = 16
#: Token 0 stands beyond the ends of a document.
OWN = TOKENS - 1 - BUCKETS
SIDE, WIDTH = 2, 32
BATCH, RATE, SEED = 16_384, 0.1, 17
#: Rows worked on together, the logits that float32 can raise, and the least log-probability.
ROWS, REACH, LEAST = 1024, 60, -140.0
#: Words remembered by a task, and distinct words counted before they are passed on.
KEPT_WORDS = 300_000
BLOCK = 1024
#: Logarithms of counts are added as whole numbers of 1 / FINE, so that repeated rows get equal sums in any order.
FINE = 2**32


def shapes(classes: int, members: int) -> dict[str, tuple[int, ...]]:
    return {"E": (2 * SIDE, classes * members, WIDTH), "b": (WIDTH,), "Wc": (WIDTH, classes), "bc": (classes,), "Ww": (classes, WIDTH, members), "bw": (classes, members)}


SHAPES = shapes(CLASSES, MEMBERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; a task passes on sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update((text or "").encode().lower().split())
                if len(seen) > KEPT_WORDS:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def vocabulary(docs: DataFrame) -> list[bytes]:
    """The words with an id of their own, most frequent first, ties in byte order."""
    return frequent(word_counts(docs))


def frequent(counts: DataFrame) -> list[bytes]:
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    above = counts.where(F.col("n") * RARE >= tokens**0.5).count()
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(max(OWN, above)).collect()]


def shared_ids(words: list[bytes]) -> tuple[int, int]:
    """The first id that words share, and how many such ids there are."""
    own = max(OWN, len(words))
    return 1 + own, max(BUCKETS, own // 15)


class TokenIds(dict):
    """Token id by word."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.fixed = {w: i + 1 for i, w in enumerate(words)}
        self.first, self.buckets = shared_ids(words)
        self.update(self.fixed)

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        i = self[word] = self.first + zlib.crc32(word) % self.buckets
        return i

    def of(self, text: str | None) -> np.ndarray:
        return self.ids_of((text or "").encode().lower().split())

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def start(words: list[bytes] = ()) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    side = max(CLASSES, math.isqrt(sum(shared_ids(words)) - 1) + 1)
    return {k: (rng.normal(0, 0.1, v) if k in ("E", "Wc", "Ww") else np.zeros(v)).astype(np.float32) for k, v in shapes(side, side).items()}


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Targets, and the context ids of each by position."""
    pad = np.zeros(SIDE, np.int32)
    line = np.concatenate([pad, *(x for d in docs for x in (d, pad))])
    real = np.concatenate([np.zeros(SIDE, bool), *(x for d in docs for x in (np.ones(len(d), bool), np.zeros(SIDE, bool)))])
    at = np.flatnonzero(real)
    return line[at], np.stack([line[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _hidden(m: dict, context: np.ndarray) -> np.ndarray:
    """The hidden layer, with a last column of ones that the biases are multiplied by."""
    out = np.empty((context.shape[1], WIDTH + 1), np.float32)
    for a in range(0, len(out), ROWS):
        h = m["b"] + m["E"][0].take(context[0, a : a + ROWS], axis=0)
        for p in range(1, 2 * SIDE):
            h += m["E"][p].take(context[p, a : a + ROWS], axis=0)
        np.tanh(h, out=out[a : a + ROWS, :-1])
    out[:, -1] = 1
    return out


def _levels(m: dict, target: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """The softmax levels of sorted targets: class (-1: of the classes), rows (ROWS at most, so that they stay in the processor's cache), weights with the biases as last row, ids."""
    classes, members = m["bw"].shape
    group, member = np.divmod(target, members)
    w = np.vstack([m["Wc"], m["bc"]])
    for a in range(0, len(target), ROWS):
        yield -1, slice(a, a + ROWS), w, group[a : a + ROWS]
    ends = np.searchsorted(group, np.arange(classes + 1)).tolist()
    for c in range(classes):
        if ends[c] < ends[c + 1]:
            w = np.vstack([m["Ww"][c], m["bw"][c]])
        for a in range(ends[c], ends[c + 1], ROWS):
            rows = slice(a, min(a + ROWS, ends[c + 1]))
            yield c, rows, w, member[rows]


def _shifted(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logits that float32 can raise: less their largest, where the weights allow more than REACH."""
    logits = h @ w
    if np.abs(w).sum(axis=0).max() > REACH:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def log_probs(m: dict, target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log P of each target given its window."""
    out = np.empty(len(target))
    for a in range(0, len(target), BATCH):
        t = target[a : a + BATCH]
        order = np.argsort(t, kind="stable")
        h, p = _hidden(m, context[:, a : a + BATCH][:, order]), np.zeros(len(t))
        for _, rows, w, own in _levels(m, t[order]):
            logits = _shifted(h[rows], w)
            p[rows] += logits[np.arange(len(own)), own]
            np.exp(logits, out=logits)
            p[rows] -= np.log(logits @ np.ones(len(w.T), np.float32))
        out[a + order] = np.maximum(p, LEAST)
    return out


def train_batch(m: dict, seen: dict, target: np.ndarray, context: np.ndarray) -> None:
    """One Adagrad step on the mean loss of a batch; seen holds the sums of squares."""
    order = np.argsort(target, kind="stable")
    t, context = target[order], context[:, order]
    n = len(t)
    h = _hidden(m, context)
    grad, dh = {k: np.zeros_like(m[k]) for k in ("Wc", "bc", "Ww", "bw")}, np.zeros((n, WIDTH), np.float32)
    for c, rows, w, own in _levels(m, t):
        d = _shifted(h[rows], w)
        np.exp(d, out=d)
        d /= (d @ np.ones(len(w.T), np.float32))[:, None]
        d[np.arange(len(own)), own] -= 1
        g = h[rows].T @ d
        gw, gb = (grad["Wc"], grad["bc"]) if c < 0 else (grad["Ww"][c], grad["bw"][c])
        gw += g[:-1]
        gb += g[-1]
        dh[rows] += d @ w[:-1].T
    h = h[:, :-1]
    dh *= 1 - h * h
    grad["b"] = dh.sum(axis=0)
    # Only the rows of the batch's words have a gradient; a sum per word and column.
    weights, column = dh.astype(float).ravel(), np.arange(WIDTH)
    for p in range(2 * SIDE):
        present = np.bincount(context[p], minlength=len(m["E"][p])) > 0
        some, place = np.flatnonzero(present), (np.cumsum(present) - 1) * WIDTH
        g = np.bincount((place[context[p]][:, None] + column).ravel(), weights, len(some) * WIDTH)
        g = (g.reshape(-1, WIDTH) / n).astype(np.float32)
        squares = seen["E"][p][some] + g * g
        seen["E"][p][some] = squares
        m["E"][p][some] -= (RATE * g / (np.sqrt(squares) + 1e-8)).astype(np.float32)
    for k, g in grad.items():
        g /= n
        seen[k] += g * g
        g *= RATE
        g /= np.sqrt(seen[k]) + np.float32(1e-8)
        m[k] -= g


def _batches(batches: Iterator[pa.RecordBatch], ids: TokenIds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training batches over all documents of a task, of BATCH tokens but for the last."""
    docs, n = [], 0
    held_t, held_c = np.empty(0, np.int32), np.empty((2 * SIDE, 0), np.int32)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            docs.append(ids.of(text))
            n += len(docs[-1])
            if n >= BATCH:
                t, c = windows(docs)
                held_t, held_c, docs, n = np.concatenate([held_t, t]), np.concatenate([held_c, c], axis=1), [], 0
                whole = len(held_t) // BATCH * BATCH
                for a in range(0, whole, BATCH):
                    yield held_t[a : a + BATCH], held_c[:, a : a + BATCH]
                held_t, held_c = held_t[whole:], held_c[:, whole:]
    t, c = windows(docs)
    held_t, held_c = np.concatenate([held_t, t]), np.concatenate([held_c, c], axis=1)
    for a in range(0, len(held_t), BATCH):
        yield held_t[a : a + BATCH], held_c[:, a : a + BATCH]


def _pack(m: dict) -> np.ndarray:
    flat = np.concatenate([m[k].ravel() for k in SHAPES])
    return np.pad(flat, (0, -len(flat) % BLOCK)).reshape(-1, BLOCK)


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at, out = 0, {}
    for k in SHAPES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


PIECE = "block int, part int, n long, value array<float>"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token-weighted mean of each block that a task was dealt, a row at a time."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        values = batch.column(3).values.to_numpy(zero_copy_only=False).reshape(-1, BLOCK) if batch.num_rows else []
        for block, part, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), values, strict=True):
            held = total.setdefault((block, part), [0, np.zeros(BLOCK)])
            held[0] += n
            held[1] += n * v.astype(float)
    yield _pieces([(b, p, n, v / n) for (b, p), (n, v) in total.items()])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    values = pa.array(np.concatenate([r[3] for r in rows]).astype(np.float32)) if rows else pa.array([], pa.float32())
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BLOCK)
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.ListArray.from_arrays(ends, values)]
    return pa.RecordBatch.from_arrays(columns, ["block", "part", "n", "value"])


def train(docs: DataFrame, words: list[bytes], rounds: int = 1) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` passes over all documents."""
    model = start(words)
    for _ in range(rounds):
        begin = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, seen, n = {k: v.copy() for k, v in begin.items()}, {k: np.zeros_like(v) for k, v in begin.items()}, 0
            for target, context in _batches(batches, TokenIds(words)):
                if len(target):
                    train_batch(m, seen, target, context)
                    n += len(target)
            part = TaskContext.get().partitionId()
            yield _pieces([(i, part, n, v) for i, v in enumerate(_pack(m))] if n else [])

        trained = docs.select("text").mapInArrow(run, PIECE)
        # Means of up to 64 tasks first, then of those.
        some = trained.withColumn("part", F.floor(F.col("part") / 64).cast("int")).repartition("block", "part").mapInArrow(_sums, PIECE)
        rows = some.withColumn("part", F.lit(0)).repartition("block").mapInArrow(_sums, PIECE).orderBy("block").toArrow()
        if rows.num_rows:
            model = _unpack(rows["value"].combine_chunks().values.to_numpy(), model)
    return model


def score(docs: DataFrame, words: list[bytes], model: dict[str, np.ndarray], counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob and perplexity of every document; ``counts`` are the corpus' word counts, those of docs by default."""
    kind = dict(docs.dtypes)["doc_id"]
    first, buckets = shared_ids(words)
    known = docs.sparkSession.createDataFrame([(w,) for w in words], "word binary")
    counts = (word_counts(docs) if counts is None else counts).join(F.broadcast(known), "word", "left_anti")
    total = np.ones(buckets)
    for r in counts.groupBy((F.crc32("word") % buckets).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    log_total = np.concatenate([np.zeros(first), np.log(total)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TokenIds(words)
        for batch in slices(batches):
            split = [(t or "").encode().lower().split() for t in batch.column(1).to_pylist()]
            found = [ids.ids_of(w) for w in split]
            n = np.array([len(f) for f in found], np.int64)
            targets, context = windows(found)
            got = log_probs(model, targets, context) - log_total[targets]
            total = np.bincount(np.repeat(np.arange(len(n)), n), got, len(n)) if len(n) else np.empty(0)
            rare = [[w[i] for i in np.flatnonzero(f >= first).tolist()] for w, f in zip(split, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(rare, pa.list_(pa.binary()))], ["doc_id", "n_tokens", "log_prob", "rare"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_prob double, rare array<binary>")
    # Written once, so that both reads see the same row numbers.
    scored = materialize(scored.withColumn("rare", F.transform("rare", lambda w: F.xxhash64(w))).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    by_hash = counts.groupBy(F.xxhash64("word").alias("h")).agg(F.round(F.log(F.sum("n")) * FINE).cast("long").alias("log_n"))
    shares = scored.select("row", F.explode("rare").alias("h")).join(by_hash, "h").groupBy("row").agg(F.sum("log_n").alias("log_n"))
    out = scored.drop("rare").join(shares, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("log_n", F.lit(0)) / FINE).select("doc_id", "n_tokens", "log_prob")
    return out.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all documents and score all of them."""
    counts = materialize(word_counts(docs), "lm-counts")
    words = frequent(counts)
    return score(docs, words, train(docs, words), counts)
