"""Nearest neighbours: overlaps by the range join, the rest as-of joins to both sides. a needs a unique ord."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import pinned, small_side
from .islands import merge
from .rangejoin import overlap_pairs
from .scan import around


def closest(a: DataFrame, b: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Each row of a with all rows of b that overlap it, else all at the least gap; no row of b: b_chrom ".", -1, -1.

    Overlaps come from the range join, and nothing else is done with them. What overlaps no row of b lies between b's islands, next
    to a row of b that ends or begins one of them; these rows are joined by position. Rows of a have start <= stop.
    """
    bb = b.select("chrom", "start", "stop", "ord").where("chrom is not null and start is not null and stop is not null")
    inside = (F.col("b_start") >= F.col("a_start")) & (F.col("b_start") < F.col("a_stop"))
    over = (F.col("b_start") < F.col("a_start")) & (F.col("b_stop") > F.col("a_start"))
    columns = [f"a_{c}" for c in a.columns] + [f"b_{c}" for c in bb.columns]
    hits = overlap_pairs(a, bb, inside | over, levels).select(*columns)
    gap_l, gap_r = F.col("start") - F.col("_l"), F.col("_r") - F.col("stop")
    best = F.least(gap_l, gap_r)  # null only if both are
    at = lambda side, pos: F.struct(F.lit(side).alias("side"), pos.cast("long").alias("pos"))
    sides = F.array(F.when(gap_l == best, at("l", F.col("_l"))), F.when(gap_r == best, at("r", F.col("_r"))), F.when(best.isNull(), at("none", F.lit(None))))
    near = _between(a, merge(bb, -1))  # those that only touch stay apart, as a row without length may lie between them
    near = near.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("_at"))
    near, small = pinned(near, "closest")
    ends = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("stop").alias("pos")), F.struct(F.lit("r").alias("side"), F.col("start").alias("pos"))))
    bs = bb.select(*[F.col(c).alias(f"b_{c}") for c in bb.columns], ends.alias("_end"))
    met = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_at.side") == F.col("_end.side")) & (F.col("_at.pos") == F.col("_end.pos"))
    found = bs.join(small_side(near, small), met & ((F.col("_at.side") == "r") | (F.col("b_start") < F.col("a_start")))).select(*columns)
    lone = {"b_chrom": F.lit("."), "b_start": F.lit(-1).cast("long"), "b_stop": F.lit(-1).cast("long"), "b_ord": F.lit(None).cast(bb.schema["ord"].dataType)}
    none = near.where("_at.side = 'none'").select(*[lone[c].alias(c) if c in lone else F.col(c) for c in columns])
    return hits.unionByName(found).unionByName(none)


def _between(a: DataFrame, islands: DataFrame) -> DataFrame:
    """The rows of a that overlap none of the islands, which don't overlap each other, with _l, the stop of the last that began
    before the row, and _r, the start of the first not before it; null where there is none.

    A few islands are sent to all tasks, and a is read as it lies; more are met in a scan of the positions.
    """
    held, small = pinned(islands, "closest-islands")
    if not small:
        every = around(a, F.col("start"), held, (F.col("start"), F.col("stop")), (F.col("start"), F.col("start")), left_equal=False)
        every = every.withColumnsRenamed({"left": "_l", "right": "_r"})
        return every.where("coalesce(_l <= start, true) and coalesce(_r >= stop, true)")
    t = held.toArrow().sort_by([("chrom", "ascending"), ("start", "ascending")])
    names = t.column("chrom").combine_chunks()
    starts, stops = (t.column(c).to_numpy() for c in ("start", "stop"))
    runs = pc.run_end_encode(names) if len(names) else None
    last = {} if runs is None else dict(zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True))
    first = dict(zip(last, [0, *last.values()], strict=False))
    told = a.sparkSession.sparkContext.broadcast((first, last, starts, stops))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, starts, stops = told.value
        for x in batches:
            chrom = x.column("chrom").dictionary_encode()
            code = chrom.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            start, stop = (x.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            left, right = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            has_l, has_r = np.zeros(len(start), bool), np.zeros(len(start), bool)
            for k, name in enumerate(chrom.dictionary.to_pylist()):
                i, lo, hi = np.flatnonzero(code == k), first.get(name, 0), last.get(name, 0)
                if hi > lo:
                    n = lo + np.searchsorted(starts[lo:hi], start[i], "left")  # the first that begins at the row's start or after
                    has_l[i], has_r[i] = n > lo, n < hi
                    left[i], right[i] = stops[np.maximum(n - 1, lo)], starts[np.minimum(n, hi - 1)]
            free = ~(has_l & (left > start)) & ~(has_r & (right < stop))
            more = [pa.array(left, pa.int64(), mask=~has_l), pa.array(right, pa.int64(), mask=~has_r)]
            yield pa.RecordBatch.from_arrays([*x.columns, *more], names=[*x.schema.names, "_l", "_r"]).filter(pa.array(free))

    kind = T.StructType([*a.schema.fields, T.StructField("_l", T.LongType()), T.StructField("_r", T.LongType())])
    return a.mapInArrow(place, kind)


def annotate(a: DataFrame, features: DataFrame) -> DataFrame:
    """a with the feature nearest to each row's midpoint (name, dist); ties to the lowest start, then ord; none: null.

    features: chrom, start, stop (inclusive, as GFF has them), name, ord.
    """
    mid = F.shiftright(F.col("start") + F.col("stop"), 1)
    m = a.select("chrom", mid.alias("start"), (mid + 1).alias("stop"), "ord")
    f = features.select("chrom", "start", (F.col("stop") + 1).alias("stop"), "name", "ord")
    within = overlap_pairs(m, f).groupBy(F.col("a_ord").alias("ord")).agg(F.min(F.struct(F.lit(0).cast("long").alias("dist"), F.col("b_start").alias("start"), F.col("b_ord").alias("o"), F.col("b_name").alias("name"))).alias("hit"))
    left = F.struct(F.col("stop").alias("k"), (-F.col("start")).alias("s"), (-F.col("ord")).alias("o"), "name")
    right = F.struct(F.col("start").alias("k"), F.col("ord").alias("o"), "name")
    both = around(m.select("chrom", F.col("start").alias("mid"), "ord"), F.col("mid"), f, (F.col("stop"), left), (F.col("start"), right))
    both = both.select("mid", "ord", F.col("left").alias("l"), F.col("right").alias("r"))
    cand_l = F.when(F.col("l").isNotNull(), F.struct((F.col("mid") - F.col("l.k") + 1).alias("dist"), (-F.col("l.s")).alias("start"), (-F.col("l.o")).alias("o"), F.col("l.name").alias("name")))
    cand_r = F.when(F.col("r").isNotNull(), F.struct((F.col("r.k") - F.col("mid")).alias("dist"), F.col("r.k").alias("start"), F.col("r.o").alias("o"), F.col("r.name").alias("name")))
    found = both.join(within, "ord", "left").select("ord", F.coalesce("hit", F.least(cand_l, cand_r)).alias("hit"))
    return a.join(found, "ord", "left").select(*a.columns, F.col("hit.name").alias("feature"), F.col("hit.dist").alias("dist"))


def reldist(a: DataFrame, b: DataFrame) -> DataFrame:
    """Histogram of the relative distance of a's midpoints to b's midpoints on both sides: reldist, count, total, fraction."""
    mid = F.expr("(start + stop) div 2")
    q = a.select("chrom", mid.alias("mid"), "ord")
    v = b.select("chrom", mid.alias("mid"))
    both = around(q, F.col("mid"), v, (F.col("mid"), F.col("mid")), (F.col("mid"), F.col("mid")), left_equal=False).withColumnsRenamed({"left": "l", "right": "r"})
    lone = v.groupBy("chrom").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    rows = both.join(lone, "chrom")
    rows = rows.where(F.col("r").isNotNull() & (F.col("l").isNotNull() | (F.col("mid") == F.col("first")) & (F.col("n") >= 2)))
    least = F.least(F.col("mid") - F.col("l"), F.col("r") - F.col("mid"))
    rel = F.when(F.col("l").isNull() | (least == 0), F.lit(0.0)).otherwise(least / (F.col("r") - F.col("l")))
    bins = rows.groupBy(F.floor(rel * 100).alias("bin")).agg(F.count("*").alias("count"))
    total = bins.agg(F.sum("count").alias("total"))
    return bins.crossJoin(total).select((F.col("bin") / 100).alias("reldist"), "count", "total", (F.col("count") / F.col("total")).alias("fraction"))  # total: one row
