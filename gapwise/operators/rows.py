"""Row-wise operators: coordinates, filters, sorts, samples. Intervals: chrom, start, stop, and more columns that are kept
unless it is said otherwise. Those that change or drop rows one by one are projections and run on streams too; unique, tail,
rename's map, sorts and samples look at the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import SMALL
from .scan import running

UNBOUNDED = (1 << 63) - 1


def _sized(df: DataFrame, genome: DataFrame) -> DataFrame:
    return df.select("chrom", "start", "stop", "ord").join(genome.select("chrom", "size"), "chrom", "left").withColumn("size", F.coalesce("size", F.lit(UNBOUNDED)))


def slop(df: DataFrame, genome: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Grown to both sides within the chromosome; one that the genome lacks has no end. chrom, start, stop, ord only."""
    return _sized(df, genome).select("chrom", F.greatest(F.col("start") - left, F.lit(0).cast("long")).alias("start"), F.least(F.col("stop") + right, "size").alias("stop"), "ord")


def flank(df: DataFrame, genome: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """The stretches beside each row, at most two, empty ones dropped. chrom, start, stop, ord only."""
    sides = F.array(F.struct(F.greatest(F.col("start") - left, F.lit(0).cast("long")).alias("start"), F.col("start").alias("stop")), F.struct(F.col("stop").alias("start"), F.least(F.col("stop") + right, "size").alias("stop")))
    return _sized(df, genome).withColumn("x", F.explode(F.filter(sides, lambda s: s["start"] < s["stop"]))).select("chrom", "x.start", "x.stop", "ord")


def flank_bp(df: DataFrame, bp: int) -> DataFrame:
    """Grown by bp on both sides, not below 0."""
    return df.withColumn("start", F.greatest(F.col("start") - bp, F.lit(0).cast("long"))).withColumn("stop", F.col("stop") + bp)


def shift(df: DataFrame, genome: DataFrame, by: int) -> DataFrame:
    """Moved, and clamped to the chromosome; what is empty then is dropped. chrom, start, stop, ord only."""
    clamp = lambda c: F.least(F.greatest(F.col(c) + by, F.lit(0).cast("long")), "size").alias(c)
    return _sized(df, genome).select("chrom", clamp("start"), clamp("stop"), "ord").where("start < stop")


def resize(df: DataFrame, size: int) -> DataFrame:
    """Of half the size to each side of the middle (an odd size gives one less), not below 0."""
    mid = F.shiftright(F.col("start") + F.col("stop"), 1)
    return df.withColumn("_m", mid).withColumn("start", F.greatest(F.col("_m") - size // 2, F.lit(0).cast("long"))).withColumn("stop", F.col("_m") + size // 2).drop("_m")


def midpoint(df: DataFrame) -> DataFrame:
    mid = F.shiftright(F.col("start") + F.col("stop"), 1)
    return df.select("chrom", mid.alias("start"), (mid + 1).alias("stop"), "ord")


def promoters(df: DataFrame, upstream: int = 2000, downstream: int = 200) -> DataFrame:
    """Minus strand: [stop, stop + both); else, also without a strand, [start - upstream, start + downstream)."""
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    out = df.withColumn("_s", F.when(minus, F.col("stop")).otherwise(F.greatest(F.col("start") - upstream, F.lit(0).cast("long")))).withColumn("_e", F.when(minus, F.col("stop") + upstream + downstream).otherwise(F.col("start") + downstream))
    return out.withColumn("start", F.col("_s")).withColumn("stop", F.col("_e")).drop("_s", "_e")


def lengths(df: DataFrame) -> DataFrame:
    return df.select("ord", F.greatest(F.col("stop") - F.col("start"), F.lit(0).cast("long")).alias("len"))


def rename(df: DataFrame, names: DataFrame) -> DataFrame:
    """chrom by a map (old, new, ord; of repeated olds the last holds), unchanged where it has none."""
    last = names.groupBy(F.col("old").alias("chrom")).agg(F.max_by("new", "ord").alias("_n"))
    return df.join(last, "chrom", "left").withColumn("chrom", F.coalesce("_n", "chrom")).select(*df.columns)


def makewindows(genome: DataFrame, size: int, step: int = 0) -> DataFrame:
    """Windows of each chromosome, one every step (or size), the last ones cut at its end."""
    if size <= 0:
        raise ValueError("size must be over 0")
    return genome.where("size > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step or size).cast("long")))).select("chrom", "start", F.least(F.col("start") + size, "size").alias("stop"))


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    """The last n rows by ord (a top-n, not a sort)."""
    return df.orderBy(F.col("ord").desc()).limit(n)


def unique(df: DataFrame) -> DataFrame:
    """Of rows with the same chrom, start and stop the first by ord."""
    first = F.row_number().over(W.partitionBy("chrom", "start", "stop").orderBy("ord"))
    return df.withColumn("_r", first).where("_r = 1").drop("_r")


def sort(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "start", "ord")


def sort_name(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("name", F.lit("")), "ord")


def sort_size(df: DataFrame, descending: bool = False) -> DataFrame:
    size = F.greatest(F.col("stop") - F.col("start"), F.lit(0))
    return df.orderBy(size.desc() if descending else size.asc(), "ord")


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, the same for the same seed, by a hash of ord: a top-n, no rows are moved."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), "ord")).orderBy("_h", "ord").limit(n).drop("_h")


#: Numbers that one task draws in one go; those that the driver draws itself at most; lanes that are drawn side by side.
DRAWN, OWN, LANES = 1 << 22, 1 << 20, 1 << 10
_ALL = (1 << 64) - 1


def _step(x: int) -> int:
    """xorshift (13, 7, 17), one number after another."""
    x ^= x << 13 & _ALL
    x ^= x >> 7
    return x ^ (x << 17 & _ALL)


class XorShift:
    """The numbers of xorshift from a seed, from any place on: a step is linear in the 64 bits, so that 2^k steps are a matrix."""

    def __init__(self, seed: int):
        self.seed = seed & _ALL
        self.powers = [[_step(1 << b) for b in range(64)]]  # what 2^k steps make of each bit

    def _power(self, k: int) -> list[int]:
        while len(self.powers) <= k:
            last = self.powers[-1]
            self.powers.append([self._apply(last, x) for x in last])
        return self.powers[k]

    @staticmethod
    def _apply(matrix: list[int], x: int) -> int:
        out = 0
        while x:
            low = x & -x
            out ^= matrix[low.bit_length() - 1]
            x ^= low
        return out

    def jump(self, x: int, steps: int) -> int:
        for k in range(steps.bit_length()):
            if steps >> k & 1:
                x = self._apply(self._power(k), x)
        return x

    def numbers(self, first: int, count: int) -> np.ndarray:
        """Numbers first, first + 1, ... (the first of all is 1): LANES stretches side by side."""
        each = -(-count // LANES)
        lane, starts = self.jump(self.seed, first - 1), []
        for _ in range(min(LANES, -(-count // max(each, 1)))):
            starts.append(lane)
            lane = self.jump(lane, each)
        x, out = np.array(starts, np.uint64), np.empty((len(starts), each), np.uint64)
        for i in range(each):
            x = x ^ x << np.uint64(13)
            x = x ^ x >> np.uint64(7)
            x = x ^ x << np.uint64(17)
            out[:, i] = x
        return out.reshape(-1)[:count]


def _first_hits(seed: int, n: int, lo: int, hi: int, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target, i): for each of the sorted targets the least i in [lo, hi), over the target, whose step swaps with it."""
    found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    draws = XorShift(seed)
    for a in range(lo, hi, OWN):
        b = min(a + OWN, hi)
        i = np.arange(b - 1, a - 1, -1, dtype=np.int64)  # the step of i is number n - i
        j = (draws.numbers(n - b + 1, b - a) % (i + 1).astype(np.uint64)).astype(np.int64)
        place = np.minimum(np.searchsorted(targets, j), len(targets) - 1)
        hit = (targets[place] == j) & (i > j)
        found.append(j[hit])
        at.append(i[hit])
    found, at = np.concatenate(found), np.concatenate(at)
    by = np.lexsort((at, found))
    new = np.concatenate([[True], found[by][1:] != found[by][:-1]]) if len(found) else np.zeros(0, bool)
    return found[by][new], at[by][new]


def permuted(spark: SparkSession, n: int, first: int, seed: int = 42) -> list[int]:
    """What stands in the first places after a Fisher-Yates shuffle of 0 to n - 1 whose numbers come from xorshift.

    Step i, from n - 1 down to 1, swaps place i with place number(n - i) mod (i + 1). Only what reaches the first places is followed: it
    comes from the place of the least step that swapped with the first one, that from the place of the least step over
    it that swapped with that, and so on. Steps are looked through in ranges that double, drawn by tasks at any place of the sequence.
    """
    first = min(first, n)
    where = np.arange(first, dtype=np.int64)  # the place that each of the first ones' content is at, before the steps seen so far
    lo = first
    while lo < n:
        hi = min(n, max(2 * lo, lo + OWN))
        moving = np.unique(where)
        while len(moving):
            if hi - lo <= OWN:
                target, i = _first_hits(seed, n, lo, hi, moving)
            else:
                held = spark.sparkContext.broadcast(moving)

                def draw(batches: Iterator[pa.RecordBatch], held=held, hi=hi, width=DRAWN) -> Iterator[pa.RecordBatch]:
                    for b in batches:
                        for a in b.column(0).to_pylist():
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _first_hits(seed, n, a, min(a + width, hi), held.value)], names=["t", "i"])

                parts = spark.range(lo, hi, DRAWN, -(-(hi - lo) // DRAWN)).mapInArrow(draw, "t long, i long").groupBy("t").agg(F.min("i").alias("i")).orderBy("t").toArrow()
                target, i = parts.column("t").to_numpy(), parts.column("i").to_numpy()
                held.destroy()
            if not len(target):
                break
            place = np.minimum(np.searchsorted(target, where), len(target) - 1)
            where = np.where(target[place] == where, i[place], where)
            moving = np.sort(i)
        lo = hi
    order = where.tolist()
    last = XorShift(seed).numbers(n - first + 1, first - 1).tolist() if first > 1 else []
    for i, x in zip(range(first - 1, 0, -1), last, strict=True):
        j = x % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def sample_exact(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of the permutation of df by ord (a unique integer; see permuted), with place. Any number of rows; n fit into the driver."""
    spark, rows = df.sparkSession, df.count()
    places = spark.createDataFrame([(r, p) for p, r in enumerate(permuted(spark, rows, n, seed))], "_r long, place int")
    ranked = running(df, [], ["ord"], "ord", _r=("sum", F.lit(1).cast("long"), "before")).withColumn("_r", F.coalesce("_r", F.lit(0).cast("long")))
    return ranked.join(F.broadcast(places) if n <= SMALL else places, "_r").drop("_r")
