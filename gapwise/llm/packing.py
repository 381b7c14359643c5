"""Best-fit packing by a linear grouping scheme.

Pieces have at most `capacity` tokens, so a corpus is, for packing, a histogram of at most `capacity` lengths. The
driver plans on that histogram alone: large lengths are rounded up to the largest of their group, groups having about
equally many pieces; a linear programme over configurations of the few sizes left (columns by a knapsack) says how
often to use each; actual lengths take the places of the rounded ones, the last place of a sequence being given to the longest that
the room allows; what is left over, and the small lengths, go best-fit into the room that remains. The plan is a table of runs (length, first rank, sequence, offset) whose
size depends on the capacity, not on the corpus; each piece finds its place by its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extend, gapless, materialize, pieces, running_ranks
from .tokens import CACHE, WORD_CACHE, encoder

#: Characters of texts that are encoded at once, about: the more there are, the fewer times a word is looked up, but the more memory a worker keeps.
BATCH_CHARS = 1 << 17

Block = tuple[int, tuple[int, ...]]  # so many sequences, each with pieces of these lengths


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """The linear programme: how often to use which configuration so that `demand` of each size is met with fewest bins.

    Gilmore and Gomory's column generation with a dense inverse of the basis; at most one column for each size.
    """
    k = len(sizes)
    per = capacity // sizes
    columns = np.diag(per.astype(float))
    inverse, x = np.diag(1.0 / per), demand / per
    for _ in range(40 * k):
        dual = inverse.sum(axis=0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes[0]), capacity + 1):
            n = np.searchsorted(sizes, c, side="right")
            gain = dual[:n] + best[c - sizes[:n]]
            j = int(gain.argmax())
            if gain[j] > best[c - 1] + 1e-12:
                best[c], pick[c] = gain[j], j
            else:
                best[c], pick[c] = best[c - 1], -1
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, x / move, np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * move
        x[out] = ratio[out]
        columns[:, out] = column
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
    return [(float(v), columns[:, j].astype(int)) for j, v in enumerate(x) if v > 1e-9]


def plan(histogram: np.ndarray, groups: int = 48, small: int = 256) -> list[Block]:
    """Blocks of equal sequences for histogram[length] pieces of each length up to len(histogram) - 1, the capacity."""
    left, capacity = histogram.astype(np.int64).copy(), len(histogram) - 1
    left[0] = 0
    blocks: list[Block] = []
    if left[capacity]:
        blocks.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    large = np.flatnonzero(left)
    large = large[large > small]
    if len(large):
        total = int(left[large].sum())
        of = np.minimum((np.cumsum(left[large]) - 1) * groups // total, groups - 1)
        members = [large[of == g] for g in np.unique(of)]
        sizes, demand = np.array([m[-1] for m in members]), np.array([left[m].sum() for m in members], float)
        for times, column in configurations(sizes, demand, capacity):
            m = int(times + 1e-9)
            while m > 0:
                room = [int(left[members[j]].sum()) // int(column[j]) for j in np.flatnonzero(column)]
                m = min(m, *room)
                if m <= 0:
                    break
                slots: list[int] = []
                held = left.copy()
                wanted = np.repeat(np.flatnonzero(column), column[np.flatnonzero(column)])[::-1]
                for at, j in enumerate(wanted):
                    room_left = capacity - sum(slots)
                    fit = members[j] if at + 1 < len(wanted) else large[large <= room_left]
                    length = next(int(v) for v in fit[::-1] if held[v] > 0)
                    held[length] -= 1
                    slots.append(length)
                lengths, uses = np.unique(slots, return_counts=True)
                step = min(m, *(int(left[v]) // int(u) for v, u in zip(lengths, uses, strict=True)))
                left[lengths] -= step * uses
                blocks.append((step, tuple(sorted(slots, reverse=True))))
                m -= step
    return best_fit(blocks, left)


def best_fit(blocks: list[Block], left: np.ndarray) -> list[Block]:
    """Put what is left, longest first, each where least room remains; a new sequence only if it fits nowhere."""
    capacity = len(left) - 1
    room: dict[int, list[Block]] = defaultdict(list)
    for m, slots in blocks:
        room[capacity - sum(slots)].append((m, slots))
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n > 0:
            r = next((r for r in range(length, capacity) if room.get(r)), None)
            m, slots = room[r].pop() if r is not None else (n, ())
            times = (capacity - sum(slots)) // length
            use = min(m, n // times)
            if use:
                room[capacity - sum(slots) - times * length].append((use, slots + (length,) * times))
                n -= use * times
                m -= use
            if n and m and n < times:
                room[capacity - sum(slots) - n * length].append((1, slots + (length,) * n))
                n, m = 0, m - 1
            if m and slots:
                room[capacity - sum(slots)].append((m, slots))
    return [b for r in sorted(room) for b in room[r]]


def runs(blocks: list[Block]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: rank r is in sequence first + r - first rank."""
    used, out, base = defaultdict(int), [], 0
    for m, slots in blocks:
        at = 0
        for length in slots:
            out.append((length, used[length], base, at))
            used[length] += m
            at += length
        base += m
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def cut(docs: DataFrame, tokenizer: str, capacity: int, end: int, ids: bool, caches: tuple[int, int] = (CACHE, WORD_CACHE)) -> DataFrame:
    """Pieces of all documents, with the task (pid) and the rank among the pieces of their length in it (lrank)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, lrank long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen, tail, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end], "<u4").tobytes(), encoder(tokenizer, *caches)
        for b in batches:
            for lo, texts in pieces([t or "" for t in b.column(1).to_pylist()], BATCH_CHARS):
                rows: list[tuple] = []
                for doc, ids_of in zip(b.column(0).slice(lo, len(texts)).to_pylist(), enc.encode(texts), strict=True):
                    data = ids_of + tail
                    n = len(data) // 4
                    start, k = 0, 0
                    while start < n:
                        step = (n - 1) % capacity + 1 if not start else capacity
                        own = data[4 * start : 4 * (start + step)]
                        rows.append((doc, k, start, step, zlib.crc32(own), own))
                        start, k = start + step, k + 1
                doc, k, start, length, crc, own = zip(*rows, strict=True)
                rank, seen = running_ranks(np.array(length), seen)
                columns = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rank), pid, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "lrank"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * ids, names=names + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, ids: bool = False, caches: tuple[int, int] = (CACHE, WORD_CACHE)) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Longer documents are cut into pieces of `capacity` tokens, the first of which holds what is over. Null text: as
    empty text, one piece with the end token. Null doc_id and repeated rows: packed like any row. An empty table
    gives an empty result. Extra columns are not read. caches: pieces and words of texts that a worker's encoder keeps at most;
    the ids do not depend on them.
    """
    staged = materialize(cut(docs, tokenizer, capacity, end, ids, caches), "pieces")
    counts = staged.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counts["length"]] = counts["n"]
    table = runs(plan(histogram))
    held = docs.sparkSession.sparkContext.broadcast(table)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        t = held.value
        length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        big = np.int64(1) << np.int64(50)
        at = np.searchsorted(t[:, 0] * big + t[:, 1], length * big + rank, side="right") - 1
        keep = [c for c in b.schema.names if c != "rank"]
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])], names=[*keep, "sequence_id", "offset"])

    ranked = gapless(staged, "length", "rank").select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, "rank")
    return arrow_map(ranked, place, extend(ranked.drop("rank"), sequence_id="long", offset="long"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
