"""Summaries and grouped aggregates of intervals and of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import materialize
from .scan import running, stretch, with_far


def _len() -> Column:
    return F.greatest(F.col("stop") - F.col("start"), F.lit(0).cast("long"))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def stats(df: DataFrame) -> DataFrame:
    """Number, bases, mean, median (of the two middle ones), least and largest length; zeros without rows."""
    n = _len()
    return df.agg(F.count("*").alias("n"), _or0(F.sum(n)).alias("total_bases"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_len"), F.coalesce(F.percentile(n, 0.5), F.lit(0.0)).alias("median_len"), _or0(F.min(n)).alias("min_len"), _or0(F.max(n)).alias("max_len"))


def coverage_hist(df: DataFrame) -> DataFrame:
    """As stats, but the median is the upper of two middle lengths, found in a histogram of lengths."""
    n = df.select(_len().alias("n"))
    by = running(n.groupBy("n").agg(F.count("*").alias("c")), [], ["n"], "n", upto=("sum", "c", "upto"))
    all_ = n.agg(F.count("*").alias("n_rows"), _or0(F.sum("n")).alias("total_bp"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.avg("n").alias("mean_len"))
    at = by.crossJoin(F.broadcast(all_.select("n_rows")))  # one row
    median = at.where("upto > n_rows div 2").agg(F.min("n").alias("median_len"))
    return all_.crossJoin(median)  # one row each


def total_bp(df: DataFrame) -> DataFrame:
    return df.agg(_or0(F.sum(_len())).alias("total_bp"))


def total_span(df: DataFrame) -> DataFrame:
    """Each chromosome's hull, and their sum in a row called total."""
    each = df.groupBy("chrom").agg((F.max("stop") - F.min("start")).alias("span"))
    return each.unionByName(each.agg(_or0(F.sum("span")).alias("span")).select(F.lit("total").alias("chrom"), "span"))


def chroms(df: DataFrame) -> DataFrame:
    return df.select("chrom").distinct()


def chroms_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom").agg(F.sum(_len()).alias("bases"))


def merge_by_name(df: DataFrame) -> DataFrame:
    """The hull of each chrom and name; rows without a name are left out."""
    return df.where("name is not null").groupBy("chrom", "name").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def numbered_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (unique ord) with run: 1, 2, ... for consecutive rows (by ord) with equal keys, nulls being equal.

    Each stretch of rows numbers its own; whether its first row goes on with the run before it is told by the last row before.
    """
    key = F.struct(*keys)
    own = W.partitionBy("_s").orderBy("ord")
    before = F.max(F.struct("ord", key.alias("k"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_s", stretch("ord")).withColumn("_p", before)
    rows = rows.withColumn("_lead", F.col("_p").isNull()).withColumn("_new", (~F.col("_lead") & ~F.col("_p.k").eqNullSafe(key)).cast("long")).drop("_p")
    rows = rows.withColumn("_n", F.sum("_new").over(upto)).withColumn("_first", F.first(key).over(upto))
    told = with_far(materialize(rows, "runs", "snappy"), [], _last=("max", F.struct("ord", key.alias("k")), "before"))
    told = told.withColumn("_begins", (F.col("_last").isNull() | ~F.col("_last.k").eqNullSafe(F.col("_first"))).cast("long"))
    told = with_far(told, [], _far=("sum", F.col("_new") + F.when(F.col("_lead"), F.col("_begins")).otherwise(0), "before"))
    return told.select(*df.columns, (F.col("_n") + F.col("_begins") + F.coalesce("_far", F.lit(0))).alias("run"))


def group_runs(df: DataFrame, keys: list[str], wanted: list[tuple[str, str]]) -> DataFrame:
    """Aggregates of consecutive rows (by ord) with equal keys: run, the keys, and a column op_column for each (column, op).

    ops: sum, mean, min, max, count (of numbers), stdev (of the population; 0 for one), collapse, distinct (in the
    order of first appearance), count_distinct, first, last. Cells that are no numbers are left out of the first six.
    """
    rows = numbered_runs(df, keys)

    def made(column: str, op: str) -> Column:
        text, number = F.col(column).cast("string"), F.expr(f"try_cast(`{column}` as double)")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("v")))), lambda x: x["v"])
        ops = {
            "sum": F.sum(number), "mean": F.avg(number), "min": F.min(number), "max": F.max(number), "count": F.count(number), "stdev": F.stddev_pop(number),
            "collapse": F.array_join(listed, ","), "distinct": F.array_join(F.array_distinct(listed), ","), "count_distinct": F.count_distinct(text), "first": F.min_by(text, "ord"), "last": F.max_by(text, "ord"),
        }
        if op not in ops:
            raise ValueError(f"no such operation: {op}")
        return ops[op].alias(f"{op}_{column}")

    return rows.groupBy("run", *keys).agg(*[made(c, op) for c, op in wanted])
