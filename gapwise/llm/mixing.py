"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Words are summed by source and leading hash bits; the bucket in which
a source's running sum passes its budget is the only one that is looked into further, by the next bits,
until one hash value is left. A document is then taken if its hash lies below its source's threshold.
No rows are sorted, and all that a level moves is one partial sum for each task, source and bucket. The thresholds are
a table with one row for each source, which is joined to the documents where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import gapless, local_ranks, materialize, small_side, word_count

HASH_BITS, LEVEL_BITS = 60, 12


def row_hash() -> Column:
    """60 bits of a document's id and text."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(key, source, source_size) -> and target: `share` of all words by weight, none above cap times its size.

    What a capped source leaves is shared by weight among the others, until none is above its cap: the level at
    which that ends is found from running sums over sources in the order in which they reach their caps.
    """
    pos = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    picks = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("w", F.get(picks, (pos - 1) % len(weights)))
    by_cap = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    s = s.withColumn("level", left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    fits = F.col("level") * F.col("w") <= F.lit(cap) * F.col("source_size")
    s = s.withColumn("level", F.min(F.when(fits, F.struct(F.row_number().over(by_cap).alias("p"), "level"))).over(all_rows)["level"])
    full = F.lit(cap) * F.col("source_size")
    target = F.least(full, F.coalesce(F.col("level") * F.col("w"), full)).cast("double")
    return s.select("key", "source_size", target.alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with _key (the source), _size (its words) and _h (its hash)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select("*", key.alias("_key"), word_count(F.col("text")).alias("_size"), row_hash().alias("_h"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, epochs, cut, need, held): documents with hash < cut, and of the `held` rows with hash = cut `need`, are taken once more than epochs."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.select("key", whole.alias("epochs"), (F.col("target") - whole * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    w = W.partitionBy("key").orderBy("bucket")
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("_h", shift)
        live = rows.join(small_side(state.select(F.col("key").alias("_key"), "prefix")), "_key").where(F.shiftright("_h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = live.groupBy(F.col("_key").alias("key"), bucket.alias("bucket")).agg(F.sum("_size").alias("n"), F.count("*").alias("held"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        run = hist.withColumn("upto", F.sum("n").over(w)).join(small_side(state.select("key", "rest", "below")), "key").withColumn("upto", F.col("upto") + F.col("below"))
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"), "upto", "held", "lo", "hi"))).alias("b")
        found = run.groupBy("key").agg(first).select("key", F.col("b.bucket").alias("prefix"), F.col("b.below").alias("below"), F.col("b.upto").alias("over"), F.col("b.held").alias("held"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
        state = materialize(state.select("key", "epochs", "rest").join(found, "key", "left"), f"mix-level{level}")
        if not state.where("lo < hi").limit(1).count():
            break
    # All rows of the last hash value are equal in id and text, so in size: as many of them are taken as come nearest.
    each = F.floor((F.col("over") - F.col("below")) / F.col("held"))
    under = F.floor((F.col("rest") - F.col("below")) / each)
    upto = F.col("below") + under * each
    need = (under + (upto + each - F.col("rest") < F.col("rest") - upto).cast("long")).cast("long")
    return state.select("key", "epochs", F.col("lo").alias("cut"), need.alias("need"), "held")


def plan(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source of rows (see measured; a written table, as it is read once for each level): its target and thresholds."""
    sources = materialize(rows.groupBy(F.col("_key").alias("key")).agg(F.min("source").alias("source"), F.sum("_size").alias("source_size")), "mix-sources")
    targets = materialize(source_targets(sources, weights, share, cap), "mix-targets")
    return materialize(targets.join(thresholds(rows, targets), "key", "left"), "mix-plan")


def take(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (see measured) with _source_size, _target and _copies, how often each is taken, by a plan of their sources.

    The plan is joined to the rows as it is, one row for each source; the rows are not moved. Only if a source's last
    hash value is that of several equal rows of which some are taken are rows written, to number those equal ones.
    """
    split = F.coalesce((F.col("need") > 0) & (F.col("need") < F.col("held")), F.lit(False))
    slot = F.when(split, F.row_number().over(W.orderBy(split.desc(), "key"))).otherwise(0)
    side = sources.select(F.col("key").alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "epochs", "cut", "need", slot.cast("int").alias("slot"))
    side = side.select("_key", "_source_size", "_target", F.struct("epochs", "cut", "need", "slot").alias("_p"))
    out = rows.join(small_side(side), "_key")
    last = F.col("_h") == F.col("_p.cut")
    rank = F.lit(0)
    if sources.where(split).limit(1).count():
        out = out.withColumn("_slot", F.when(last, F.col("_p.slot")).otherwise(0))
        out = gapless(materialize(local_ranks(out, "_slot"), "mix-equal"), "_slot", "_rank")
        rank = F.col("_rank")
    more = (F.col("_h") < F.col("_p.cut")) | (last & (rank < F.col("_p.need"))) | F.col("_p.cut").isNull()
    rest = F.col("_target") - F.col("_p.epochs") * F.col("_source_size")
    copies = F.coalesce(F.col("_p.epochs"), F.lit(0)) + F.when(F.coalesce(rest, F.lit(0.0)) > 0, more.cast("long")).otherwise(0)
    return out.withColumn("_copies", copies.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often to take each document so that sources come near their target number of words.

    Sources in code-point order (null last, a source of its own) get the weights in turn. Returns doc_id, size,
    source_size, target, taken (size times the number of copies), copies, and each row's hash h.

    Null text, or text without words: size 0, taken 0. Null doc_id and repeated rows: as any row; of rows equal in doc_id
    and text as many are taken as come nearest to the target. An empty table gives an empty result. Of extra columns,
    whatever they are called, none is read. A source's sum misses its target by at most half the size of one document.
    """
    rows = materialize(measured(docs.select("doc_id", "text", "source")).drop("text"), "mix-rows")
    out = take(rows, plan(rows, weights, share, cap))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), F.col("_h").alias("h"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rule by sorting: within a source, rows by hash, up to the running sum that is nearest to what is left.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', left(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))), 15)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS p,
        (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
        / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level FROM w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT arg_min(level, p) FROM l WHERE level * w <= 2.0::DOUBLE * source_size)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, d.size AS own
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
