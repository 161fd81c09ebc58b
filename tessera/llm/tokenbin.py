"""Token-id archives with one shared zstandard dictionary and an offset index.

File format, little-endian; a folder holds ``dictionary.zdict`` and ``part-*.tkz``:

    8 bytes   magic ``TKZDICT1``
    32 bytes  SHA-256 of the dictionary
    frames    one zstandard frame per document: its ids as unsigned 32-bit integers
    index     n x int64 doc_id, n x uint8 (1: doc_id is null), n + 1 x uint64 frame
              offsets, n x uint64 numbers of ids
    24 bytes  offset of the index, n, magic

Documents stand in ascending doc_id order, within a file and over the files.  A
reader fetches the index and then only the frames it needs, so one short document
costs three small range reads; a dictionary of another hash is refused.

Defined results: a null or empty text is one end id; documents without a doc_id
come first; equal doc_ids stay together, ordered by a hash of the text; repeated
rows are repeated documents; an empty table gives an archive without parts.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_symbols
from tessera.llm.common import finished_file, make_dir, materialize, open_fs, shared_dir, slices

MAGIC = b"TKZDICT1"
#: Dictionary bytes, and what it is trained on: so many documents of smallest id hash, and characters of each at most.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 32_768, 400, 16_384
LEVEL = 3
KEPT_WORDS = 250_000
#: Frames read together.
RUN_BYTES = 4 << 20
PUNCTUATION = b".,;:!?*#$%&()\"-|"


class LibraryEncoder:
    """The tokenizers library behind a memory of words.

    No pre-token reaches over ASCII white space, so a text's ids are those of its
    words one after the other.  A letters-only word and the run of punctuation
    behind it are two pre-tokens and are kept apart too.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.symbols = byte_symbols()
        self.words = _Words(self._word)
        self.stems = _Words(self._stem)

    def _ids(self, shown: str) -> bytes:
        """The library's model on one pre-token in its normalised, byte-level form."""
        ids = [t.id for t in self.library.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stem(self, word: bytes) -> bytes:
        if word.isascii() and word.isalpha():
            return self._ids(word.lower().decode())
        text = word.decode()
        if text.isalpha():
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if low.isalpha():
                return self._ids("".join(map(self.symbols.__getitem__, low.encode())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        plain = word.isascii()
        low = word.lower() if plain else word
        if plain and low.isalpha():
            return self.stems[low]
        stem = low.rstrip(PUNCTUATION)
        if stem != low and (stem.isalpha() if plain else stem.decode().isalpha()):
            return self.stems[stem] + self.stems[low[len(stem) :]]
        return self.stems[word if b"<" in word else low]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


class _Words(dict):
    """Values by word in two generations; the older goes when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample (SAMPLE_DOCS documents by id hash, SAMPLE_CHARS characters of each at most).

    Too little text for the trainer gives a dictionary of the sampled ids themselves (raw
    content), and no text at all one of the end id: an archive always has a dictionary.
    """
    hashed = docs.withColumn("h", F.xxhash64("doc_id"))

    def sample(rows: DataFrame) -> list[str]:
        some = rows.where(F.length("text") > 0).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "h", F.xxhash64("text").alias("g"))
        return [r.text for r in some.orderBy("h", "g").limit(SAMPLE_DOCS).collect()]

    # Only ids are ordered, unless the first of them have hardly any text.
    least = [r.h for r in hashed.select("h").orderBy("h").limit(2 * SAMPLE_DOCS).collect()]
    texts = sample(hashed.where(F.col("h") <= (least[-1] if least else 0)))
    if len(texts) < SAMPLE_DOCS // 2:
        texts = sample(hashed)
    own = encoder(vocabulary)
    end = np.uint32(end_id).tobytes()
    samples = [own.encode(t) + end for t in texts]
    if len(samples) >= 16 and sum(map(len, samples)) >= 2 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    return (b"".join(samples) or end)[:DICTIONARY_BYTES]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(data)) if data else zstandard.ZstdCompressor(level=LEVEL)


def _decompressor(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_dict(data)) if data else zstandard.ZstdDecompressor()


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the archive of (doc_id, text); returns its parts: file, first_doc, part, n_docs, n_tokens."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, vocabulary, end_id)
    digest = hashlib.sha256(dictionary).digest()
    make_dir(folder)
    with finished_file(f"{folder}/dictionary.zdict") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter_rows := (b for b in slices(batches) if b.num_rows), None)
        if first is None:
            return
        own, press, end = encoder(vocabulary), _compressor(dictionary), np.uint32(end_id).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.tkz"
        ids, offsets, counts = [], [len(MAGIC) + 32], []
        with finished_file(name) as out:
            out.write(MAGIC + digest)
            for batch in _chain(first, iter_rows):
                ids += batch.column(0).to_pylist()
                frames = []
                for text in batch.column(1).to_pylist():
                    data = own.encode(text) + end
                    frames.append(press.compress(data))
                    offsets.append(offsets[-1] + len(frames[-1]))
                    counts.append(len(data) // 4)
                out.write(b"".join(frames))
            out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
            out.write(np.array([i is None for i in ids], "u1").tobytes())
            out.write(np.array(offsets, "<u8").tobytes())
            out.write(np.array(counts, "<u8").tobytes())
            out.write(np.array([offsets[-1], len(ids)], "<u8").tobytes() + MAGIC)
        yield pa.RecordBatch.from_pydict({"file": [name], "first_doc": pa.array([ids[0]], pa.int64()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([sum(counts)], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(parts.mapInArrow(run, "file string, first_doc long, part int, n_docs long, n_tokens long"), "token-parts")


def _chain(first, rest):
    yield first
    yield from rest


class Part:
    """One file: its index, and documents by position or id."""

    def __init__(self, file: str):
        where, path = open_fs(file)
        self.file = where.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 24, 24)
        if tail[16:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{file} is no token archive")
        at, n = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
        index = self._at(at, size - 24 - at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.frombuffer(index[9 * n : 9 * n + 8 * (n + 1)], "<u8")
        self.counts = np.frombuffer(index[9 * n + 8 * (n + 1) :], "<u8")
        with where.open_input_file(f"{path.rpartition('/')[0]}/dictionary.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self._at(8, 32):
            raise ValueError(f"{file}: the dictionary is another one")
        self.expand = _decompressor(dictionary)

    def _at(self, offset: int, n: int) -> bytes:
        return bytes(self.file.read_at(n, offset))

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents with that id (short access: only their frames are read)."""
        held = np.flatnonzero((self.doc_ids == doc_id) & (self.null == 0))
        return [np.frombuffer(self._frame(self._at(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i])), i), "<u4") for i in held]

    def _frame(self, data: bytes, i: int) -> bytes:
        return self.expand.decompress(data, max_output_size=4 * int(self.counts[i]))

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """Positions and id bytes of all documents, in order."""
        i, n = 0, len(self.counts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + RUN_BYTES, "right")) - 1)
            run = self._at(int(self.offsets[i]), int(self.offsets[min(j, n)] - self.offsets[i]))
            for k in range(i, min(j, n)):
                a, b = int(self.offsets[k] - self.offsets[i]), int(self.offsets[k + 1] - self.offsets[i])
                yield k, self._frame(run[a:b], k)
            i = min(j, n)


def read(parts: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, from the files."""
    spark = parts.sparkSession
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file; the files are then dealt out evenly.
    placed = parts.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    tasks = max(1, min(parts.count(), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part, rows = Part(file), []
                for k, data in part.documents():
                    rows.append((None if part.null[k] else int(part.doc_ids[k]), start, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<u4") if with_ids else None))
                    start += len(data) // 4
                    if len(rows) == 512:
                        yield _rows(rows, with_ids)
                        rows = []
                yield _rows(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.repartition(tasks).mapInArrow(run, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    out = {c: pa.array(columns[i], pa.int64()) for i, c in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))}
    if with_ids:
        out["ids"] = pa.array([x.tolist() for x in columns[4]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(out)


def archive(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Write the archive of docs and read it back."""
    return read(write(docs, vocabulary, folder or shared_dir(spark, "token-archive"), end_id), with_ids)
