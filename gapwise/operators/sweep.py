"""Endpoint sweeps: depth histograms and multi-way segmentations.

A few files have a column each, all in one scan. Over WIDE files, what holds at a position is a set of files, or a value by file, in
one running state, so that the plan is the same for any number of them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import materialize, pinned, small_side
from .scan import WIDTH, running, stretch

#: Files over which the state is one value and not a column for each.
WIDE = 16


def _ends(rows: DataFrame, **more: Column) -> DataFrame:
    """chrom, pos, sign and more columns: a row's start with sign 1, its stop with sign -1."""
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("sign")))
    return rows.select("chrom", F.explode(ends).alias("_e"), *[c.alias(k) for k, c in more.items()]).select("chrom", "_e.pos", "_e.sign", *more)


def genomecov(bed: DataFrame, genome: DataFrame) -> DataFrame:
    """scope ("chrom" or "genome"), chrom, depth, bases, size, fraction: how many bases have each depth.

    Rows are clamped to their chromosome's size; chromosomes that the genome lacks are ignored; depth 0 appears where
    bases are uncovered.
    """
    g = genome.select("chrom", "size").where("size > 0")
    rows = bed.select("chrom", "start", "stop").join(g, "chrom").select("chrom", "start", F.least("stop", "size").alias("stop")).where("start < stop")
    events = _ends(rows).groupBy("chrom", "pos").agg(F.sum("sign").alias("d"))
    steps = running(events, ["chrom"], ["pos"], "pos", depth=("sum", "d", "upto"), next=("min", "pos", "after")).where("next is not null and depth > 0")
    deep = materialize(steps.groupBy("chrom", "depth").agg(F.sum(F.col("next") - F.col("pos")).alias("bases")), "depths")
    bare = g.join(deep.groupBy("chrom").agg(F.sum("bases").alias("b")), "chrom", "left").select("chrom", F.lit(0).cast("long").alias("depth"), (F.col("size") - F.coalesce("b", F.lit(0))).alias("bases")).where("bases > 0")
    each = deep.unionByName(bare)
    total = g.agg(F.sum("size").alias("size"))
    own = each.join(g, "chrom").select(F.lit("chrom").alias("scope"), "chrom", "depth", "bases", "size")
    pooled = each.groupBy("depth").agg(F.sum("bases").alias("bases")).crossJoin(total).select(F.lit("genome").alias("scope"), F.lit("genome").alias("chrom"), "depth", "bases", "size")  # total: one row
    return own.unionByName(pooled).withColumn("fraction", F.col("bases") / F.col("size"))


def multiinter(files: list[DataFrame], names: list[str]) -> DataFrame:
    """chrom, start, stop, n, list, and a 0/1 column for each file: stretches with the same set of files covering them.

    One scan of all files' ends gives each file's depth at each position; those where some file's cover begins or ends are scanned
    again, for the next one.
    """
    if len(files) != len(names):
        raise ValueError("as many names as files")
    if len(files) > WIDE:
        on = covers(_numbered(files)).select("chrom", "start", "stop", "files")
        named = F.array(*[F.lit(x) for x in names])
        listed = F.array_join(F.transform("files", lambda i: F.get(named, i)), ",").alias("list")
        return on.select("chrom", "start", "stop", F.size("files").cast("long").alias("n"), listed, *[F.array_contains("files", i).cast("long").alias(x) for i, x in enumerate(names)])
    ends = None
    for i, f in enumerate(files):
        own = _ends(f.where("start < stop"), f=F.lit(i))
        ends = own if ends is None else ends.unionByName(own)
    at = ends.groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("f") == i, F.col("sign")).otherwise(0)).alias(f"d{i}") for i in range(len(files))])
    deep = running(at, ["chrom"], ["pos"], "pos", **{f"n{i}": ("sum", f"d{i}", "upto") for i in range(len(files))})
    here = [(F.col(f"n{i}") > 0).cast("long") for i in range(len(files))]
    turns = [(F.col(f"n{i}") > 0) != (F.col(f"n{i}") > F.col(f"d{i}")) for i in range(len(files))]  # the file covers from here, or until here
    cuts = deep.where(reduce(or_, turns)).select("chrom", "pos", *[c.alias(f"f{i}") for i, c in enumerate(here)])
    on = running(cuts, ["chrom"], ["pos"], "pos", next=("min", "pos", "after")).where("next is not null")
    n = sum((F.col(f"f{i}") for i in range(len(files))), F.lit(0))
    listed = F.concat_ws(",", *[F.when(F.col(f"f{i}") > 0, F.lit(x)) for i, x in enumerate(names)])
    return on.select("chrom", F.col("pos").alias("start"), F.col("next").alias("stop"), n.cast("long").alias("n"), listed.alias("list"), *[F.col(f"f{i}").alias(x) for i, x in enumerate(names)]).where("n > 0")


def unionbedg(files: list[DataFrame], names: list[str], filler: str = "0") -> DataFrame:
    """chrom, start, stop and each file's value (a string; filler where it has none), split at every breakpoint of any.

    Each file's intervals don't overlap among themselves. A value holds from its start until its stop, so that the last
    change at or before a breakpoint says what holds from there.
    """
    if len(files) != len(names):
        raise ValueError("as many names as files")
    if len(files) > WIDE:
        rows = _numbered(files, "value").withColumn("value", F.col("value").cast("string"))
        held = F.map_from_arrays("files", "values")
        on = values(rows).withColumn("_m", held)
        return on.select("chrom", "start", "stop", *[F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit(filler)).alias(x) for i, x in enumerate(names)])
    events = None
    for i, f in enumerate(files):
        # At one position a stop comes before a start: the later of the two, by rank, is what holds.
        e = f.where("start < stop").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("k"), F.col("value").cast("string").alias("v")), F.struct(F.col("stop").alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("v")))).alias("e"), F.lit(i).alias("f"))
        events = e if events is None else events.unionByName(e)
    at = events.groupBy("chrom", F.col("e.pos").alias("pos")).agg(*[F.max(F.when(F.col("f") == i, F.struct("e.pos", "e.k", "e.v"))).alias(f"e{i}") for i in range(len(files))])
    on = running(at, ["chrom"], ["pos"], "pos", next=("min", "pos", "after"), **{f"v{i}": ("max", f"e{i}", "upto") for i in range(len(files))})
    live = F.lit(False)
    for i in range(len(files)):
        live = live | F.coalesce(F.col(f"v{i}.k") == 1, F.lit(False))
    return on.where(F.col("next").isNotNull() & live).select("chrom", F.col("pos").alias("start"), F.col("next").alias("stop"), *[F.coalesce(F.when(F.col(f"v{i}.k") == 1, F.col(f"v{i}.v")), F.lit(filler)).alias(x) for i, x in enumerate(names)])


def _numbered(files: list[DataFrame], *more: str) -> DataFrame:
    """The rows of all files, with f, the number of their file."""
    return reduce(DataFrame.unionByName, [f.select("chrom", "start", "stop", *more, F.lit(i).alias("f")) for i, f in enumerate(files)])


def covers(rows: DataFrame) -> DataFrame:
    """chrom, start, stop, files: stretches with the same set of files (f, a number, of rows chrom, start, stop) covering them, none left out."""
    ends = _ends(rows.where("start < stop"), f=F.col("f")).groupBy("chrom", "f", "pos").agg(F.sum("sign").alias("d"))
    deep = running(ends, ["chrom", "f"], ["pos"], "pos", n=("sum", "d", "upto"))
    turns = deep.where((F.col("n") > 0) != (F.col("n") > F.col("d")))  # the file covers from here, or until here
    return _states(turns.select("chrom", "pos", "f", F.when(F.col("n") > 0, F.lit("")).alias("v"))).drop("values")


def values(rows: DataFrame) -> DataFrame:
    """chrom, start, stop, files, values: what each file (f, a number) with a value has there, split at every end of any of its rows.

    A file's rows (chrom, start, stop, value, a string, f) don't overlap among themselves.
    """
    full = rows.where("start < stop").withColumn("value", F.coalesce("value", F.lit("")))
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("k"), F.col("value").alias("v")), F.struct(F.col("stop").alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("v")))
    turns = full.select("chrom", "f", F.explode(ends).alias("e")).groupBy("chrom", "f", F.col("e.pos").alias("pos")).agg(F.max(F.struct("e.k", "e.v")).alias("e"))
    return _states(turns.select("chrom", "pos", "f", "e.v"))


def _states(turns: DataFrame, width: int | None = None) -> DataFrame:
    """chrom, start, stop, files, values from each file's turns (chrom, pos, f, v: what it has from here on, null for nothing).

    Turns are dealt to stretches. A stretch gets the state at its begin as rows of its own: a file's last turn before counts in all
    stretches up to that of its next one. Then each is walked with one state, a value by file.
    """
    cells = turns.withColumn("_s", stretch("pos", width or WIDTH // WIDE))
    firsts = cells.groupBy("chrom", "_s").agg(F.min("pos").alias("_first"))
    along = W.partitionBy("chrom").orderBy("_s")
    order = firsts.select("chrom", "_s", F.row_number().over(along).alias("_k"), F.lead("_first").over(along).alias("_next"), F.count("*").over(W.partitionBy("chrom")).alias("_n"))
    order, small = pinned(order, "stretches")
    placed = materialize(cells.join(small_side(order, small), ["chrom", "_s"]), "turns", "snappy")
    last = placed.groupBy("chrom", "f", "_k").agg(F.max(F.struct("pos", "v")).alias("e"), F.max("_n").alias("_n"))
    until = F.coalesce(F.lead("_k").over(W.partitionBy("chrom", "f").orderBy("_k")), F.col("_n"))
    held = last.withColumn("_until", until).where("e.v is not null and _until > _k")
    entered = held.select("chrom", "f", "e.v", F.explode(F.sequence(F.col("_k") + 1, "_until")).alias("_k")).join(small_side(order, small), ["chrom", "_k"])
    rows = placed.select("chrom", "_s", "_next", "pos", "f", "v").unionByName(entered.select("chrom", "_s", "_next", F.lit(None).cast("long").alias("pos"), "f", "v"))
    kind = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("files", pa.list_(pa.int32())), ("values", pa.list_(pa.string()))])

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")  # nulls, the state at the begin, come last
        pos, f, v, chrom, after = (t.column(c).to_pylist() for c in ("pos", "f", "v", "chrom", "_next"))
        n = len(pos) - t.column("pos").null_count
        state, out = dict(zip(f[n:], v[n:], strict=True)), []
        for i in range(n):
            if v[i] is None:
                state.pop(f[i], None)
            else:
                state[f[i]] = v[i]
            end = pos[i + 1] if i + 1 < n else after[0]
            if state and end is not None and end > pos[i]:
                files = sorted(state)
                out.append((chrom[0], pos[i], end, files, [state[x] for x in files]))
        return pa.table([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kind, strict=True)], schema=kind)

    return rows.groupBy("chrom", "_s").applyInArrow(walk, "chrom string, start long, stop long, files array<int>, values array<string>")
