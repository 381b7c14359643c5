"""Interval-set algebra by gaps and islands. Intervals: chrom, start, stop (half-open), and ord for row order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..tables import materialize, pinned, small_side
from .scan import running, stretch, with_far


def merge(df: DataFrame, distance: int = 0) -> DataFrame:
    """Overlapping and bookended intervals (or within distance) as one: chrom, start, stop. No order of rows is needed.

    Each stretch merges its own rows; its leading islands may belong to one that reaches in from stretches before.
    """
    by_start = df.select("chrom", "start", "stop", stretch("start").alias("_s")).groupBy("chrom", "_s", "start").agg(F.max("stop").alias("stop"))
    own = W.partitionBy("chrom", "_s").orderBy("start")
    reach = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
    begins = by_start.withColumn("_first", reach.isNull() | (F.col("start") > reach + distance))
    head = F.max(F.when(F.col("_first"), F.col("start"))).over(own.rowsBetween(W.unboundedPreceding, 0))
    parts = materialize(begins.withColumn("start", head).groupBy("chrom", "_s", "start").agg(F.max("stop").alias("stop")), "islands", "snappy")
    told = with_far(parts, ["chrom"], _reach=("max", "stop", "before"))
    kept = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + distance)
    told = with_far(told.withColumn("_head", F.when(kept, F.col("start"))), ["chrom"], _before=("max", "_head", "before"))
    return told.groupBy("chrom", F.coalesce("_head", "_before").alias("start")).agg(F.max("stop").alias("stop"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The merged intervals of both."""
    return merge(a.select("chrom", "start", "stop").unionByName(b.select("chrom", "start", "stop")))


def complement(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Gaps of each chromosome of the genome; one without intervals is a gap as a whole; others are ignored."""
    size = genome.select("chrom", "size")
    m = merge(df).join(size, "chrom").where("start < size").select("chrom", "start", F.least("stop", "size").alias("stop"), "size")
    ends = m.select("chrom", "start", "stop", F.lit(False).alias("_last")).unionByName(size.select("chrom", F.col("size").alias("start"), F.col("size").alias("stop"), F.lit(True).alias("_last")))
    before = running(ends, ["chrom"], ["start", "_last", "stop"], "start", _prev=("max", "stop", "before"))
    return before.select("chrom", F.coalesce("_prev", F.lit(0).cast("long")).alias("start"), F.col("start").alias("stop")).where("start < stop")


#: A reach below all others, as it is before a chromosome's first line.
LOWEST = -(1 << 62)


def _change(other: list[bool], start: list[int], stop: list[int], distance: int) -> tuple[int, int]:
    """How lines change the reach (the furthest stop of the current cluster): one less than `under` becomes `to`, others stay.

    Each line does that, as it either begins a cluster or may lengthen the reach, and so do any of them one after another: `to` is
    never over `under`. The first of a chromosome (other) does it to every reach.
    """
    under, to = LOWEST, LOWEST
    for o, a, b in zip(other, start, stop, strict=True):
        most = -LOWEST if o else max(a - distance, b)
        if most > under:
            under, to = most, b
        elif to < most:
            to = b
    return under, to


def _begins(other: list[bool], start: list[int], stop: list[int], distance: int, reach: int) -> list[int]:
    """1 for each line that begins a cluster, else 0, given the reach before the first."""
    out = []
    for o, a, b in zip(other, start, stop, strict=True):
        new = o or a > reach + distance
        reach = b if new else max(reach, b)
        out.append(int(new))
    return out


def _in_order(t: pa.Table) -> tuple[pa.Table, list[bool]]:
    """A stretch's lines by ord, and whether each is of another chromosome than the one before it in the stretch."""
    t = t.sort_by("ord")
    name = t.column("chrom").combine_chunks().dictionary_encode().indices.to_numpy()
    return t, np.concatenate([[False], name[1:] != name[:-1]]).tolist()


def cluster(df: DataFrame, distance: int = 0) -> DataFrame:
    """df (unique ord) with cluster: 1, 2, ... in the order of lines.

    A line begins a cluster if its chromosome is not that of the line before, or its start is over the furthest stop of the current
    cluster plus the distance, which may be negative. Of lines sorted by chromosome and start these are the merged intervals;
    others are taken as they come, so that a chromosome that is met again begins anew. A line without chromosome is of one of its own.

    Three passes over stretches of lines: how each changes the reach, one row for each; which lines begin a cluster, given the
    reach at the stretch's first; and the numbers, given how many begin in the stretches before.
    """
    cells = df.select(F.struct(*df.columns).alias("_row"), "chrom", "start", "stop", "ord", stretch("ord").alias("_s"))

    def change(t: pa.Table) -> pa.Table:
        t, other = _in_order(t)
        under, to = _change(other, t.column("start").to_pylist(), t.column("stop").to_pylist(), distance)
        row = [t.column("_s")[0].as_py(), t.column("chrom")[0].as_py(), t.column("chrom")[-1].as_py(), under, to]
        return pa.table({k: pa.array([v], kind) for k, v, kind in zip(["_s", "first", "last", "under", "to"], row, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)})

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reach = None, LOWEST
        for b in batches:
            out = []
            for _, first, end, under, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reach = reach if first == last else LOWEST
                out.append(reach)
                reach, last = (to if reach < under else reach), end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["_s", "_reach"])

    changes = cells.select("_s", "chrom", "start", "stop", "ord").groupBy("_s").applyInArrow(change, "_s long, first string, last string, under long, to long")
    # One row for each stretch of lines: few enough for one task.
    entered, small = pinned(changes.repartition(1).sortWithinPartitions("_s").mapInArrow(enter, "_s long, _reach long"), "cluster-reach")

    def number(t: pa.Table) -> pa.Table:
        t, other = _in_order(t)
        new = _begins(other, t.column("start").to_pylist(), t.column("stop").to_pylist(), distance, t.column("_reach")[0].as_py())
        return t.drop_columns(["_reach"]).append_column("_new", pa.array(new, pa.int64())).append_column("_n", pa.array(np.cumsum(new), pa.int64()))

    kind = T.StructType([*cells.schema.fields, T.StructField("_new", T.LongType()), T.StructField("_n", T.LongType())])
    written = materialize(cells.join(small_side(entered, small), "_s").select(*cells.columns, "_reach").groupBy("_s").applyInArrow(number, kind), "cluster", "snappy")
    out = with_far(written, [], _before=("sum", "_new", "before"))
    return out.select("_row.*", (F.col("_n") + F.coalesce("_before", F.lit(0))).alias("cluster"))


def spacing(df: DataFrame) -> DataFrame:
    """Gaps between a row and the one before it in ord, if that is of the same chromosome: chrom, start, stop, gap; overlaps give none."""
    rows = running(df, [], ["ord"], "ord", _p=("max", F.struct("ord", "chrom", "stop"), "before"))
    return rows.where((F.col("chrom") == F.col("_p.chrom")) & (F.col("start") >= F.col("_p.stop"))).select("chrom", F.col("_p.stop").alias("start"), F.col("start").alias("stop"), (F.col("start") - F.col("_p.stop")).alias("gap"), "ord").drop("ord")
