"""Range joins as equi-joins on bins, and the operators on top of them. Rows need a unique ord where that is said.

A bin is about four times the usual length, so that few rows are in two. An interval that would span too many bins uses coarser
ones, so that the rows made are bounded; a pair is kept in the one bin where the later of the two begins. What is shuffled are a
row's own columns and how many bins after its first it is in: the bin itself follows from these.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import fisher_row
from .islands import merge
from .ranks import open_at, overlapping, ranked_ends
from .scan import running

#: A bin's width in usual lengths; bins that one interval has at most.
WIDTH, MAX_BINS = 4, 64
#: The columns by which a written table is bucketed: chromosome, level, bin.
KEYS = ["b_chrom", "_level", "_bin"]


def bin_levels(*sides: DataFrame) -> list[int]:
    """Bin widths, finest first: four times the 90th percentile of lengths, then 64 times wider until the longest fits.

    One job over all sides; where the lengths are known, pass levels to the operators instead.
    """
    lengths = None
    for i, s in enumerate(sides):
        own = s.select(F.lit(i).alias("side"), (F.col("stop") - F.col("start")).alias("n"))
        lengths = own if lengths is None else lengths.unionByName(own)
    found = lengths.groupBy("side").agg(F.percentile_approx("n", 0.9, 1000).alias("p"), F.max("n").alias("m")).collect()
    width = max([1, *(WIDTH * (r["p"] or 1) for r in found)])
    return _up_to([width], max([1, *(r["m"] or 1 for r in found)]))


def _up_to(levels: list[int], longest: int) -> list[int]:
    """levels with coarser ones, as many as the longest needs."""
    out = list(levels)
    while out[-1] * MAX_BINS < longest:
        out.append(out[-1] * MAX_BINS)
    return out


def _reach(of: str, pad: int) -> tuple[Column, Column]:
    """Where a row, given its columns' prefix, begins and stops, if it is padded on both sides; none begins before 0 then."""
    start, stop = F.col(f"{of}start"), F.col(f"{of}stop")
    return (F.greatest(start - pad, F.lit(0)), stop + pad) if pad else (start, stop)


def _level(levels: list[int], pad: int = 0) -> Column:
    """The finest level in which a row of chrom, start, stop has few enough bins."""
    lo, hi = _reach("", pad)
    level = F.lit(len(levels) - 1)
    for k in range(len(levels) - 2, -1, -1):
        level = F.when(F.greatest(hi - lo, F.lit(1)) <= levels[k] * MAX_BINS, k).otherwise(level)
    return level


def _wide(levels: list[int], level: Column) -> Column:
    return F.get(F.array(*[F.lit(w).cast("long") for w in levels]), level) if len(levels) > 1 else F.lit(levels[0])


def _bins(lo: Column, hi: Column, wide: Column) -> Column:
    """How many bins after its first a row is in: 0, 1, ..."""
    return F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(hi - 1, lo) / wide) - F.floor(lo / wide))


def _binned(df: DataFrame, side: str, levels: list[int], pad: int = 0) -> DataFrame:
    """df's columns as a_* or b_*, a row for each of its bins, _ja or _jb after its first; if there are several levels, for each
    level that the other side may have (_other*; its own: _own*)."""
    lo, hi = _reach("", pad)
    columns = [F.col(c).alias(f"{side}_{c}") for c in df.columns]
    if len(levels) == 1:
        return df.select(*columns, F.explode(_bins(lo, hi, _wide(levels, F.lit(0)))).alias(f"_j{side}"))
    own, other = f"_own{side}", f"_other{side}"
    rows = df.withColumn(own, _level(levels, pad)).withColumn(other, F.explode(F.array(*[F.lit(k) for k in range(len(levels))])))
    return rows.select(*columns, own, other, F.explode(_bins(lo, hi, _wide(levels, F.greatest(own, other)))).alias(f"_j{side}"))


def _keys(side: str, levels: list[int], pad: int = 0) -> list[Column]:
    """What two rows of one bin have in common; the bin comes first, as rows are sorted by it fastest."""
    several = len(levels) > 1
    wide = _wide(levels, F.greatest(f"_own{side}", f"_other{side}") if several else F.lit(0))
    of = ["_owna", "_othera"] if side == "a" else ["_otherb", "_ownb"]
    return [F.floor(_reach(f"{side}_", pad)[0] / wide) + F.col(f"_j{side}"), F.col(f"{side}_chrom"), *[F.col(c) for c in of if several]]


class BinnedTable:
    """Intervals written once in their bins, to be the other side b of many joins: a table of the catalog, bucketed by the join's keys.

    The join reads its buckets as they lie and moves only the rows that come to meet them. Bins follow from the written intervals'
    lengths, and each is written in those of its own level alone. What is too long for them on the other side (one job finds the
    longest) meets the table's rows in coarser bins, which moves these, once each.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if "gapwise.own_levels" not in props:
            raise ValueError(f"{name} was not written in bins, or by an older version")
        self.levels, self.columns = json.loads(props["gapwise.own_levels"]), json.loads(props["gapwise.columns"])

    def rows(self) -> DataFrame:
        return self.spark.read.table(self.name)

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return [(c[2:], k) for c, k in self.rows().dtypes if c.startswith("b_")]

    def select(self, *columns: str) -> BinnedTable:
        """The table with fewer of its columns; chrom, start and stop are among them."""
        out = BinnedTable(self.spark, self.name)
        out.columns = [c for c in columns if c in self.columns]
        if len(out.columns) < len(columns):
            raise ValueError("a binned table has its own columns only")
        return out

    @classmethod
    def write(cls, df: DataFrame, name: str, buckets: int = 64) -> BinnedTable:
        """Write df (chrom, start, stop and more) as the table `name`, in so many buckets; the name must be free."""
        levels = bin_levels(df)
        rows = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns], _level(levels).alias("_level"))
        lo, hi = _reach("b_", 0)
        wide = _wide(levels, F.col("_level"))
        rows = rows.withColumn("_jb", F.explode(_bins(lo, hi, wide))).withColumn("_bin", F.floor(lo / wide) + F.col("_jb"))
        rows.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
        told = {"gapwise.own_levels": json.dumps(levels), "gapwise.columns": json.dumps(df.columns)}
        df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in told.items()) + ")")
        return cls(df.sparkSession, name)

    def met(self, a: DataFrame, test: Column, pad: int = 0) -> DataFrame:
        """The pairs with a's rows that pass the test, with all columns."""
        lo, hi = _reach("", pad)
        longest = a.agg(F.max(hi - lo).alias("n")).first()["n"] or 1
        levels, stored = _up_to(self.levels, longest), len(self.levels)
        rows = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], _level(levels, pad).alias("_owna"))
        every = F.array(*[F.lit(k) for k in range(stored)])
        rows = rows.withColumn("_othera", F.explode(F.filter(every, lambda k: k >= F.col("_owna"))))
        lo, hi = _reach("a_", pad)
        wide = _wide(self.levels, F.col("_othera"))
        rows = rows.withColumn("_ja", F.explode(_bins(lo, hi, wide)))
        keys = [F.col("a_chrom") == F.col("b_chrom"), F.col("_othera") == F.col("_level"), F.floor(lo / wide) + F.col("_ja") == F.col("_bin")]
        columns = [*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in self.columns]]
        found = rows.join(self.rows(), keys).where(test & _once()).select(*columns)
        if longest <= levels[0] * MAX_BINS:
            return found
        mine = self.rows().where("_jb = 0").select(*[F.col(f"b_{c}").alias(c) for c in self.columns])
        wider = lambda df: df.where("_owna > _othera" if "_owna" in df.columns else "_otherb > _ownb")
        far = wider(_binned(a.where(_level(levels, pad) > 0), "a", levels, pad)).join(wider(_binned(mine, "b", levels)), _same(levels, pad))
        return found.unionByName(far.where(test & _once()).select(*columns))


def _once() -> Column:
    """Of all bins that a pair shares, one: that in which one of the two begins."""
    return (F.col("_ja") == 0) | (F.col("_jb") == 0)


def _same(levels: list[int], pad: int) -> list[Column]:
    return [x == y for x, y in zip(_keys("a", levels, pad), _keys("b", levels), strict=True)]


def overlap_pairs(a: DataFrame, b: DataFrame | BinnedTable, condition: Column | None = None, levels: list[int] | None = None, pad: int = 0) -> DataFrame:
    """All pairs on one chromosome that overlap, once each, with columns a_* and b_*; a's rows are padded on both sides.

    b may be a BinnedTable. condition: another test on a_start, a_stop, b_start, b_stop that no pair without a common bin can meet
    (overlap, or equal starts).
    """
    lo, hi = _reach("a_", pad)
    test = (lo < F.col("b_stop")) & (F.col("b_start") < hi) if condition is None else condition
    if isinstance(b, BinnedTable):
        return b.met(a, test, pad)
    if not levels:
        padded = a.select(*[x.alias(c) for x, c in zip(_reach("", pad), ("start", "stop"), strict=True)])
        levels = bin_levels(padded, b)
    pairs = _binned(a, "a", levels, pad).join(_binned(b, "b", levels), _same(levels, pad)).where(test & _once())
    return pairs.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns])


def _own(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col(f"a_{c}").alias(c) for c in columns]


def intersect(a: DataFrame, b: DataFrame | BinnedTable, levels: list[int] | None = None) -> DataFrame:
    """For each pair a's row, clipped to what is shared; empty parts are dropped. b may be a BinnedTable."""
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop")
    p = overlap_pairs(a, b.select("chrom", "start", "stop"), levels=levels).where(lo < hi)
    return p.select(*[lo.alias(c) if c == "start" else hi.alias(c) if c == "stop" else F.col(f"a_{c}").alias(c) for c in a.columns])


def subtract(a: DataFrame, b: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """What of each row of a (unique ord) b leaves, in parts; a's other columns are kept, empty rows vanish.

    A row's hits are in order, and the row itself comes last, as a hit at its stop: before each lies a gap, or nothing.
    """
    hits = overlap_pairs(a, merge(b), levels=levels or bin_levels(a, b))
    ends = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.col("stop").alias("b_start"), F.col("stop").alias("b_stop"), F.lit(True).alias("_last"))
    rows = hits.drop("b_chrom").withColumn("_last", F.lit(False)).unionByName(ends)
    w = W.partitionBy("a_ord").orderBy("_last", "b_start")
    begin = F.coalesce(F.lag(F.least("a_stop", "b_stop")).over(w), F.col("a_start"))
    rows = rows.withColumn("_from", begin).withColumn("_to", F.greatest("a_start", "b_start")).where("_from < _to")
    return rows.select(*[F.col({"start": "_from", "stop": "_to"}.get(c, f"a_{c}")).alias(c) for c in a.columns])


def window(a: DataFrame, b: DataFrame | BinnedTable, w: int = 1000, levels: list[int] | None = None) -> DataFrame:
    """Pairs of rows within w of each other: all columns of both, a_* and b_*."""
    return overlap_pairs(a, b, levels=levels, pad=w)


def map_values(a: DataFrame, b: DataFrame, op: str = "mean", column: str = "score", levels: list[int] | None = None) -> DataFrame:
    """a (unique ord) with value: op (mean, sum, min, max, count) of b's column over overlapping rows; null if none.

    Counts, and sums and means of integers, are differences of ranks, which are exact; others are of the pairs.
    """
    ops = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    if op not in ops:
        raise ValueError(f"no such operation: {op}")
    if op == "count" or op in ("sum", "mean") and dict(b.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        of = ["b"] if op == "count" else ["b", "v"]
        found = overlapping(a, ranked_ends(a, b, None if op == "count" else column), *of)
        value = {"count": lambda: F.col("n_b"), "sum": lambda: F.col("n_v"), "mean": lambda: F.col("n_v").cast("double") / F.col("n_b").cast("double")}[op]()
        return found.select(*a.columns, F.when(F.col("n_b") > 0, value.cast("double")).alias("value"))
    hits = overlap_pairs(a.select("chrom", "start", "stop", "ord"), b.select("chrom", "start", "stop", F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v")), levels=levels)
    found = hits.groupBy(F.col("a_ord").alias("ord")).agg(ops[op]("b_v").cast("double").alias("value"))
    return a.join(found, "ord", "left").select(*a.columns, "value")


def overlap_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts, rows with a partner, bases, shared bases (pair by pair, unmerged) and their Jaccard ratio.

    Shared bases are those between two ends times the depths of both there; partners are counted by ranks.
    """
    ids = lambda d: d.select("chrom", "start", "stop")
    ends = ranked_ends(ids(a), ids(b))
    deep = lambda x: open_at(x) + F.col(f"at_{x}") - (F.col(f"to_{x}") - F.col(f"in_{x}"))
    shared = ends.agg(F.coalesce(F.sum(deep("a") * deep("b") * (F.coalesce("next", "pos") - F.col("pos"))), F.lit(0)).alias("overlap_bases"))

    def side(d: DataFrame, k: str, other: str) -> DataFrame:
        size = F.coalesce(F.sum(F.greatest(F.col("stop") - F.col("start"), F.lit(0))), F.lit(0))
        return overlapping(ids(d), ends, other).agg(F.count("*").alias(f"{k}_count"), size.alias(f"{k}_bases"), F.count_if(F.col(f"n_{other}") > 0).alias(f"{k}_with_overlap"))

    one = side(a, "a", "b").crossJoin(side(b, "b", "a")).crossJoin(shared)  # one row each
    every = F.greatest(F.col("a_bases") + F.col("b_bases") - F.col("overlap_bases"), F.lit(0))
    return one.select("a_count", "b_count", "a_with_overlap", "b_with_overlap", "a_bases", "b_bases", "overlap_bases").withColumn("jaccard", F.when(every > 0, F.col("overlap_bases") / every).otherwise(0.0))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: bases in both merged sets, in either, their ratio, and the number of shared parts.

    One sweep over both sets' ends: how many intervals of each hold from an end to the next.
    """
    ends = lambda d, x, y: d.where("start < stop").select("chrom", F.explode(F.array(*[F.struct(F.col(c).alias("pos"), F.lit(s * x).alias("x"), F.lit(s * y).alias("y")) for c, s in (("start", 1), ("stop", -1))])).alias("e"))
    at = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.x").alias("dx"), F.sum("e.y").alias("dy"))
    on = running(at, ["chrom"], ["pos"], "pos", x=("sum", "dx", "upto"), y=("sum", "dy", "upto"), next=("min", "pos", "after"))
    width = F.coalesce(F.col("next") - F.col("pos"), F.lit(0))
    both = (F.col("x") > 0) & (F.col("y") > 0)
    begins = both & ((F.col("x") <= F.col("dx")) | (F.col("y") <= F.col("dy")))  # just before, one of them was not there
    total = lambda c: F.coalesce(F.sum(F.when(c, width)), F.lit(0))
    one = on.agg(total(both).alias("intersection"), total((F.col("x") > 0) | (F.col("y") > 0)).alias("union"), F.count(F.when(begins, 1)).alias("n_intersections"))
    return one.select("intersection", "union", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0).alias("jaccard"), "n_intersections")


def fisher(a: DataFrame, b: DataFrame, genome: DataFrame) -> DataFrame:
    """One row: n11, n12, n21, n22 and the left, right and two-tailed p-values and ratio of Fisher's exact test."""
    ids = lambda d: d.select("chrom", "start", "stop")
    # Of a pair one begins while the other is open, or both begin together; nothing is asked of how they end.
    pairs = F.col("at_a") * open_at("b") + F.col("at_b") * open_at("a") + F.col("at_a") * F.col("at_b")
    n = ranked_ends(ids(a), ids(b)).agg(F.sum(pairs).alias("n")).first()["n"] or 0
    side = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("s")).first()
    ra, rb, total = side(a), side(b), genome.agg(F.sum("size").alias("s")).first()["s"] or 0
    row = fisher_row(n, ra["n"], rb["n"], ra["s"], rb["s"], total)
    return a.sparkSession.createDataFrame([tuple(row.values())], "n11 long, n12 long, n21 long, n22 long, left double, right double, two_tail double, ratio double")
