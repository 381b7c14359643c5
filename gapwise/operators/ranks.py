"""Counting overlaps by differences of ranks: no pair is made, so the work is linear however deep the overlaps are.

What overlaps a row has started before its stop, less what has ended by its start. One scan of both tables' ends, each position once,
gives these ranks (and sums of values) at every end; a row reads them at its own two. Rows are [start, stop) with start <= stop;
an empty one overlaps what it lies strictly inside of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def ranked_ends(a: DataFrame, b: DataFrame, value: str | None = None) -> DataFrame:
    """chrom, pos (each position where a row of either begins or ends, once), next, and for each side a and b: at_*, the rows that begin
    here; on_*, those that are not empty and began before; off_*, those that ended up to here; in_* and to_*, the empty ones before and up to here.

    With value, an integer column of b, the same sums of it as on_v, off_v, in_v and to_v.
    """
    sides = {"a": (a, F.lit(1)), "b": (b, F.lit(1))} | ({"v": (b, F.coalesce(F.col(value), F.lit(0)).cast("decimal(38,0)"))} if value else {})
    rows = None
    for x, (df, w) in sides.items():
        what = F.when(F.col("start") < F.col("stop"), 0).otherwise(1)
        end = lambda pos, k: F.struct(F.col(pos).alias("pos"), k.alias("k"))
        own = df.select("chrom", w.alias("w"), F.explode(F.array(end("start", what), end("stop", F.lit(2)))).alias("e"), (F.col("start") < F.col("stop")).alias("full"))
        own = own.select("chrom", "e.pos", F.lit(x).alias("x"), F.when((F.col("e.k") == 2) & ~F.col("full"), 3).otherwise(F.col("e.k")).alias("k"), F.col("w").cast("decimal(38,0)" if value else "long"))
        rows = own if rows is None else rows.unionByName(own)
    total = lambda x, k: F.coalesce(F.sum(F.when((F.col("x") == x) & (F.col("k") == k), F.col("w"))), F.lit(0)).alias(f"{('s', 'z', 'e')[k]}_{x}")
    ends = rows.groupBy("chrom", "pos").agg(*[total(x, k) for x in sides for k in (0, 1, 2)])
    kinds = {f"{name}_{x}": ("sum", f"{of}_{x}", where) for x in sides for name, of, where in (("on", "s", "before"), ("off", "e", "upto"), ("in", "z", "before"), ("to", "z", "upto"))}
    out = running(ends, ["chrom"], ["pos"], "pos", next=("min", "pos", "after"), **kinds)
    return out.select("chrom", "pos", "next", *[(F.col(f"s_{x}") + F.col(f"z_{x}")).alias(f"at_{x}") for x in sides], *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def open_at(x: str) -> Column:
    """How many rows of the side began before the position and end after it."""
    return F.col(f"on_{x}") - F.col(f"off_{x}")


def overlapping(rows: DataFrame, ends: DataFrame, *sides: str) -> DataFrame:
    """rows (of one of the two tables that ends come of) with n_* of each side: how many of it overlap the row, or their summed value."""
    at_start = ends.select("chrom", F.col("pos").alias("start"), *[F.col(f"{k}_{x}").alias(f"_{k}_{x}") for x in sides for k in ("off", "to")])
    at_stop = ends.select("chrom", F.col("pos").alias("stop"), *[F.col(f"{k}_{x}").alias(f"_{k}_{x}") for x in sides for k in ("on", "in")])
    found = rows.join(at_start, ["chrom", "start"]).join(at_stop, ["chrom", "stop"])
    full = lambda x: F.when(F.col("start") < F.col("stop"), F.col(f"_in_{x}") - F.col(f"_to_{x}")).otherwise(0)
    return found.select(*rows.columns, *[(F.col(f"_on_{x}") - F.col(f"_off_{x}") + full(x)).alias(f"n_{x}") for x in sides])
