"""Running aggregates in one pass, without a whole key in one task.

Rows are dealt once to stretches of the position. In that one layout each stretch is scanned in order, and the rows are
written with what the scan found within the stretch. What the stretches before (or after) add is one row for each stretch; it is
put together there, and joined to the written rows. So the input is read once, however many running values there are, and the
next operator reads a written table, not the plan of this one.

A stretch has at most WIDTH positions. Where rows may share a position without bound, they are aggregated by position first, so
that no stretch outgrows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import materialize, pinned, small_side

#: Positions of a stretch; stretches of a stretch of stretches.
WIDTH, FAN = 1 << 17, 1 << 14
_FN = {"sum": F.sum, "max": F.max, "min": F.min}
#: Which rows count: those up to the row or before it, those from the row on or after it.
_BACK = {"upto": False, "before": False, "from": True, "after": True}

Running = tuple[str, Column | str, str]


def stretch(pos: str | Column, width: int | None = None) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / (width or WIDTH))


def _value(e: Column | str) -> Column:
    return F.col(e) if isinstance(e, str) else e


def running(df: DataFrame, by: list[str], order: list[str], pos: str, width: int | None = None, **columns: Running) -> DataFrame:
    """df with each column name=(fn, expression, where): fn is "sum", "max" or "min", where "upto", "before", "from" or "after".

    Rows are in the order of `order` within `by`; `pos` is the first of `order`, an integer. Where no row counts: null.
    """
    ahead = W.partitionBy(*by, "_s").orderBy(*order)
    behind = W.partitionBy(*by, "_s").orderBy(*[F.col(c).desc() for c in order])
    frame = lambda where: (behind if _BACK[where] else ahead).rowsBetween(W.unboundedPreceding, 0 if where in ("upto", "from") else -1)
    rows = df.withColumn("_s", stretch(pos, width))
    near = [_FN[fn](_value(e)).over(frame(where)).alias(f"_near_{k}") for k, (fn, e, where) in columns.items()]
    written = materialize(rows.select("*", *near), "scan", "snappy")
    out = with_far(written, by, **{f"_far_{k}": c for k, c in columns.items()})
    both = [_both(_FN[fn], F.col(f"_near_{k}"), F.col(f"_far_{k}")).alias(k) for k, (fn, _, _) in columns.items()]
    return out.select(*df.columns, *both)


def with_far(rows: DataFrame, by: list[str], **columns: Running) -> DataFrame:
    """rows, which have _s, their stretch, with each column: what all stretches of `by` before theirs (or after it) add up to."""
    fns = {k: (_FN[fn], _BACK[where]) for k, (fn, _, where) in columns.items()}
    totals = rows.groupBy(*by, "_s").agg(*[_FN[fn](_value(e)).alias(k) for k, (fn, e, _) in columns.items()])
    far = totals.select(*by, "_s", *_others(fns, by)) if by else _upper(totals, fns)
    side, small = pinned(far, "scan-carry")
    return rows.join(small_side(side, small), [*by, "_s"])


def _others(fns: dict, by: list[str], order: str = "_s") -> list[Column]:
    ahead, behind = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col(order), F.col(order).desc()))
    return [fn(k).over(behind if back else ahead).alias(k) for k, (fn, back) in fns.items()]


def _upper(totals: DataFrame, fns: dict) -> DataFrame:
    """What all stretches before (or after) each add up to, in two levels, where there is no key to deal them by."""
    rows = totals.withColumn("_t", F.floor(F.col("_s") / FAN))
    above = rows.groupBy("_t").agg(*[fn(k).alias(k) for k, (fn, _) in fns.items()]).withColumn("_one", F.lit(0))
    above = above.select("_t", *[c.alias(f"_top_{k}") for k, c in zip(fns, _others(fns, ["_one"], "_t"), strict=True)])
    out = rows.select("_s", "_t", *_others(fns, ["_t"])).join(above, "_t")
    return out.select("_s", *[_both(fn, F.col(k), F.col(f"_top_{k}")).alias(k) for k, (fn, _) in fns.items()])


def _both(fn, a: Column, b: Column) -> Column:
    more = a + b if fn is F.sum else F.greatest(a, b) if fn is F.max else F.least(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(more)


Side = tuple[Column, Column]


def nearest_ends(asked: DataFrame, values: DataFrame, left: Side | None = None, right: Side | None = None, left_equal: bool = True) -> DataFrame:
    """(chrom, at, left, right) of each chrom and position `at` of asked: the largest `left` value at a position <= at (with
    left_equal=False: < at), and the least `right` value at one >= at; null where there is none.

    left and right: (position, value) of the rows of `values`; a value, or its first field, must grow with its position. One scan
    gives both, and it holds each position once, however many rows ask there or lie there.
    """
    rows = asked.select("chrom", F.col("at").cast("long").alias("at")).distinct().withColumn("_k", F.lit(1))
    wanted = {}
    for name, side, fn, where, k in (("left", left, F.max, "upto", 0 if left_equal else 2), ("right", right, F.min, "from", 3)):
        if side:
            ends = values.groupBy("chrom", side[0].cast("long").alias("at")).agg(fn(side[1]).alias(f"_{name}"))
            rows = rows.unionByName(ends.withColumn("_k", F.lit(k)), allowMissingColumns=True)
            wanted[name] = ("max" if fn is F.max else "min", f"_{name}", where)
    return running(rows, ["chrom"], ["at", "_k"], "at", **wanted).where("_k = 1").select("chrom", "at", *wanted)


def around(queries: DataFrame, at: Column, values: DataFrame, left: Side | None = None, right: Side | None = None, left_equal: bool = True) -> DataFrame:
    """queries with left and right (see nearest_ends) at each row's position."""
    asked = queries.withColumn("at", at.cast("long"))
    found = nearest_ends(asked, values, left, right, left_equal)
    return asked.join(found, ["chrom", "at"]).select(*queries.columns, *[c for c in ("left", "right") if c in found.columns])
