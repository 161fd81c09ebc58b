"""BPE encoding and decoding with a contiguous rank array per word.

A word is held as a list of part ids (the boundaries) beside a list of the merge
ranks of adjacent parts.  The smallest rank is found by a scan, its boundary is
deleted, and the two neighbouring ranks are refreshed, until no adjacent pair
merges.  Words of a text are independent, so their ids are kept by word.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated rows; other columns are carried along untouched by
``encode``, and its output names replace columns of the same name.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Words with more parts than this use a heap, which gives the same merges without the quadratic scan.
LONG_WORD = 256
#: Words kept in each of the two generations of the cache.
KEPT_WORDS = 250_000
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable symbol of each byte value, by the byte-level rule: printable Latin-1 stands for itself, the others follow from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankBpe:
    """Encoder and decoder of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if model["type"] != "BPE" or len(split) != 1 or spec.get("decoder") or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
            raise ValueError(f"{path}: only BPE files with one inverted Split and no decoder are read")
        self.pieces = regex.compile(split[0]["pattern"]["Regex"])
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.words = _Words(self)

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        if len(parts) > LONG_WORD:
            return self._long_word(parts)
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NEVER)
        return parts

    def _long_word(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] << 32 | parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get(parts[left] << 32 | parts[right], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, x in zip(parts, alive, strict=True) if x]

    def _plain(self, text: str) -> list[int]:
        # Lower-casing goes letter by letter: no special form of a final sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [i for piece in self.pieces.findall(text) for i in self.word(piece.encode())]

    def chunk(self, data: bytes) -> list[int]:
        """Ids of what stands between two ASCII white-space characters; neither the special tokens nor a pre-token reaches over those."""
        text = data.decode()
        if not self.at_special or "<" not in text or not self.at_special.search(text):
            return self._plain(text)
        ids, at = [], 0
        for hit in self.at_special.finditer(text):
            ids += [*self._plain(text[at : hit.start()]), self.special[hit[0]]]
            at = hit.end()
        return ids + self._plain(text[at:])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, (text or "").encode().split())), dtype="<i4")

    def decode(self, ids) -> str:
        """The token strings with a space between, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Words(dict):
    """Ids by word, as bytes; when full, a generation becomes the older one and the oldest is dropped."""

    def __init__(self, bpe: RankBpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = np.array(self.bpe.chunk(chunk), dtype="<i4").tobytes()
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


@functools.cache
def load(path: str) -> RankBpe:
    return RankBpe(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ``ids`` (array<int>) of the whole ``text``.

    ``vocabulary`` is the path of the tokenizers file on every executor.
    """
    kept = [c for c in df.columns if c.lower() != ids.lower()]
    out = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = f"{out.schema.toDDL()}{', ' if kept else ''}`{ids}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in slices(batches):
            got = [bpe.encode(t) for t in batch.column(kept.index(text)).to_pylist()]
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*got, np.empty(0, "<i4")]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*kept, ids])

    return out.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of ``ids`` (null: empty) as the column ``decoded``."""
    kept = [c for c in df.columns if c.lower() != decoded.lower()]
    out = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = f"{out.schema.toDDL()}{', ' if kept else ''}`{decoded}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in slices(batches):
            got = [bpe.decode(i or ()) for i in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*kept, decoded])

    return out.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded text of every document, in one pass over the texts."""
    out = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in slices(batches):
            got = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*got, np.empty(0, "<i4")]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array([bpe.decode(i.tolist()) for i in got], pa.string())], ["doc_id", "ids", "decoded"])

    return out.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(trip: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
