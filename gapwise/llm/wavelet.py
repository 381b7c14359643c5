"""Token ids in wavelet-matrix files: one succinct, compressed file for each shard.

A file holds the ids of consecutive documents as bit-planes, highest bit first. At each plane the ids whose bit is 0
go, in order, before those whose bit is 1, and the next plane is of that order. With the number of ones before
each chunk of a plane (rank) a single token, a token's count in any span, and its n-th place (select) are found
by one step for each plane, for which one chunk of the plane is opened. Layout, all numbers little-endian:

    b"WVM2", u32 bits, u64 tokens, u64 documents, u32 bytes of each of the three parts below
    zstd of the documents' lengths (u32 each), their ids (i64 each) and whether they have one (u8 each)
    zstd of, for each plane, u64 zeros and for each chunk u64 ones before it, u64 where it begins, the last one's end too
    the chunks: zstd of CHUNK bits each (eight to a byte, first highest), plane after plane

A file stands for itself: nothing else is needed to read it. Spark's text writer writes the bytes as they are, a file for each
shard and one byte more at its end, so that its commit protocol holds: a lost executor's files are written again or not
at all, and any store that Spark can reach will do. Spark's binary reader reads them back.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, materialize, pieces, scratch_dir
from .tokens import encoder

HEAD, MAGIC = struct.Struct("<4sIQQIII"), b"WVM2"
#: Characters of texts, about, that are encoded at once: the words that they share are looked up once.
ENCODED_CHARS = 1 << 22
#: A shard is closed once it has so many tokens; a document is never cut. Bits of a chunk. Bytes of ids in a range of documents, ranges at most.
SHARD_TOKENS, CHUNK, RANGE_BYTES, RANGES = 1 << 20, 1 << 16, 16 << 20, 20_000


def encode(ids: np.ndarray, lengths: np.ndarray, docs: list[int | None] | None = None) -> bytes:
    """The file of `ids`, which are those of documents of these lengths and doc_ids (without: 0, 1, 2 ...)."""
    docs = list(range(len(lengths))) if docs is None else docs
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1).compress
    ids, chunks, index, at = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], 0
    for level in range(bits - 1, -1, -1):
        bit = (ids >> level & 1).astype(bool)
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(bit, np.arange(0, len(bit), CHUNK), dtype=np.int64))]) if len(bit) else np.zeros(1, np.int64)
        index.append(len(ids) - int(ones[-1]))
        packed = np.packbits(bit).tobytes()
        for k in range(-(-len(bit) // CHUNK)):
            index += [int(ones[k]), at]
            chunks.append(press(packed[k * CHUNK // 8 : (k + 1) * CHUNK // 8]))
            at += len(chunks[-1])
        index.append(at)
        ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
    names = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + np.array([d is not None for d in docs], np.uint8).tobytes()
    parts = [press(lengths.astype("<u4").tobytes()), press(names), press(np.array(index, "<u8").tobytes())]
    return b"".join([HEAD.pack(MAGIC, bits, len(ids), len(lengths), *map(len, parts)), *parts, *chunks])


class WaveletMatrix:
    """Reads a file; rank, select, access and count open the chunks that they need, decode() gives all ids back."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n, docs, *sizes = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self._open, at, held = zstandard.ZstdDecompressor().decompress, HEAD.size, []
        for size in sizes:
            held.append(self._open(data[at : at + size]))
            at += size
        self.data, self.at = data, at
        self.lengths = np.frombuffer(held[0], "<u4")
        has = np.frombuffer(held[1], np.uint8, docs, 8 * docs)
        self.docs = [d if h else None for d, h in zip(np.frombuffer(held[1], "<i8", docs).tolist(), has.tolist(), strict=True)]
        index, k = np.frombuffer(held[2], "<u8").astype(np.int64), -(-self.n // CHUNK)
        index = index.reshape(self.bits, 2 * k + 2)
        self.zeros, self.before, self.begin, self.end = index[:, 0].tolist(), index[:, 1:-1:2], index[:, 2:-1:2], index[:, -1]
        self.chunks: dict[tuple[int, int], np.ndarray] = {}

    def _bytes(self, level: int, k: int) -> bytes:
        stop = self.begin[level, k + 1] if k + 1 < self.begin.shape[1] else self.end[level]
        return self._open(self.data[self.at + self.begin[level, k] : self.at + stop])

    def _chunk(self, level: int, k: int) -> np.ndarray:
        """A chunk's bits; those opened are kept."""
        if (level, k) not in self.chunks:
            self.chunks[level, k] = np.unpackbits(np.frombuffer(self._bytes(level, k), np.uint8))
        return self.chunks[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Number of ones among the first i bits of a plane."""
        k, rest = divmod(i, CHUNK)
        if not rest:
            return int(self.before[level, k]) if k < self.before.shape[1] else self.n - self.zeros[level]
        return int(self.before[level, k]) + int(np.count_nonzero(self._chunk(level, k)[:rest]))

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self._chunk(level, i // CHUNK)[i % CHUNK])
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in [lo, hi)."""
        if token >> self.bits:
            return 0
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of token."""
        if k < 0 or k >= self.count(token):
            raise IndexError("no such occurrence")
        i = self._span(token, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            want = i - self.zeros[level] if bit else i
            lo, hi = 0, self.n
            while lo < hi:  # the last place with `want` such bits before it
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > want else (mid + 1, hi)
            i = lo
        return i

    def decode(self) -> np.ndarray:
        """All ids, undoing the planes from the last to the first."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = b"".join(self._bytes(level, k) for k in range(self.begin.shape[1]))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).view(bool)
            out = np.empty_like(ids)
            out[np.flatnonzero(~bit)] = ids[: self.zeros[level]]
            out[np.flatnonzero(bit)] = ids[self.zeros[level] :] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = out
        return ids


def tokenize(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(doc_id, tie, wide, ids): ids as little-endian numbers, two bytes each where the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.lib.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
        tail = np.array([end], kind).tobytes()
        for b in batches:
            for lo, texts in pieces([t or "" for t in b.column(2).to_pylist()], ENCODED_CHARS):
                ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + tail for x in enc.encode(texts)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array([kind == "<u4"] * n), pa.array(ids, pa.binary())], names=["doc_id", "tie", "wide", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, wide boolean, ids binary")


def write(docs: DataFrame, tokenizer: str, end: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents, in ascending doc_id order (null first; equal ids by a hash of the text), into files under folder.

    A file's path has part=, shard= (its number in the part, and after a dash the part's tokens before it) and tokens=. The ids alone are moved to sort
    them, never the texts.
    """
    staged = materialize(tokenize(docs, tokenizer, end), "ids")
    size = staged.agg(F.sum(F.octet_length("ids")).alias("s")).first()["s"] or 0
    parts = max(1, min(RANGES, -(-size // RANGE_BYTES)))
    ordered = staged.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), np.array([len(x) for x in held])
            row = [[encode(ids, lengths, names)], [part], [shard], [len(ids)], [before]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["payload", "part", "shard", "tokens", "before"])

        for b in batches:
            for doc, wide, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                held.append(np.frombuffer(ids, "<u4" if wide else "<u2"))
                names.append(doc)
                size += len(held[-1])
                if size >= shard_tokens:
                    yield close()
                    shard, before, held, names, size = shard + 1, before + size, [], [], 0
        if held:
            yield close()

    files = ordered.mapInArrow(run, "payload binary, part int, shard int, tokens long, before long")
    named = files.select(F.col("payload").cast("string"), "part", F.concat_ws("-", "shard", "before").alias("shard"), "tokens")
    named.write.partitionBy("part", "shard", "tokens").text(folder)
    forget(staged)


def read(files: DataFrame, end: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its file; start counts all ids before it.

    files: part, shard, tokens, before, content. With end, the last token of each file's first document is looked up by rank as
    well, and must be that.
    """
    parts = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    above = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = materialize(parts.select("part", F.coalesce(F.sum("all").over(above), F.lit(0)).alias("above")), "wavelet-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, base in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                matrix = WaveletMatrix(content.as_py())
                ids, ends = matrix.decode(), np.cumsum(matrix.lengths, dtype=np.int64)
                last = int(ends[0]) - 1
                if end is not None and not matrix.access(last) == ids[last] == end:
                    raise ValueError("a file's ranks and its tokens disagree")
                data, starts = ids.astype("<u4").tobytes(), ends - matrix.lengths
                crc = [zlib.crc32(data[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(matrix.docs, pa.int64()), pa.array(starts + base), pa.array(matrix.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each part, RANGES at most: the contents stay where they are read.
    rows = files.join(F.broadcast(base), "part").select("content", (F.col("above") + F.col("before")).alias("base"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def files_of(spark, folder: str) -> DataFrame:
    """part, shard, tokens, before and content of the files that `write` wrote; none if there were no documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    told = lambda pattern, kind: F.regexp_extract("path", pattern, 1).cast(kind)
    shard = told("/shard=([0-9]+)-", "int").alias("shard"), told("/shard=[0-9]+-([0-9]+)/", "long").alias("before")
    return files.select(told("/part=([0-9]+)/", "int").alias("part"), *shard, told("/tokens=([0-9]+)/", "long").alias("tokens"), "content")


def token_stats(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write docs into files and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null text: as empty text, the end id alone. Null doc_ids come first, repeated rows side by side. An empty table
    gives no file and an empty result. Extra columns are not read.
    """
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write(docs, tokenizer, end, folder)
    return read(files_of(spark, folder), end)


def op8_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_stats(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
