"""Registered queries of the interval operators over the driver's tables, each with SQL that does it another way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import islands, nearest, randomness, rangejoin, rows, sequences, sweep
from ..sources import text

#: Interval relations: (table, select list, filter), the same text for Spark and for DuckDB.
_S = "(o_orderkey*7919+o_custkey*104729)%1000000"
_T = "(event_id*15485863+user_id*32452843)%1000000"
RELATIONS = {
    "a": ("orders", ["concat('chr',CAST(o_custkey%24+1 AS STRING)) AS chrom", f"{_S} AS start", f"{_S}+50+(o_orderkey%200) AS stop", "concat('n',CAST(o_custkey AS STRING)) AS name", "o_orderkey%1000 AS score", "CASE WHEN o_orderkey%2=0 THEN '+' ELSE '-' END AS strand", "o_orderkey AS ord"], "true"),
    "b": ("events", ["concat('chr',CAST(event_id*31%24+1 AS STRING)) AS chrom", f"{_T} AS start", f"{_T}+20+(event_id%300) AS stop", "event_type AS name", "CAST(floor(value*100) AS BIGINT) AS score", "event_id AS ord"], "true"),
    "g": ("nation", ["concat('chr',CAST(n_nationkey+1 AS STRING)) AS chrom", "CAST(1000000-n_nationkey*1000 AS BIGINT) AS size", "CAST(n_nationkey AS BIGINT) AS ord"], "n_nationkey<>23"),
    "feat": ("part", ["concat('chr',CAST(p_partkey%24+1 AS STRING)) AS chrom", "CASE WHEN p_size%2=0 THEN 'gene' ELSE 'exon' END AS ftype", "(p_partkey*611953)%990000+1 AS start", "(p_partkey*611953)%990000+501+p_size*10 AS stop", "concat('ID=f',CAST(p_partkey AS STRING),';gene_name=',p_name) AS attributes", "p_partkey AS ord"], "true"),
    "names": ("nation", ["concat('chr',CAST(n_nationkey+1 AS STRING)) AS old", "concat('c_',n_name) AS new", "CAST(n_nationkey AS BIGINT) AS ord"], "n_nationkey<20"),
}
_FASTA = "translate(upper(regexp_replace(text,'[^A-Za-z]',''{flag})),'BDEFHIJKLMOPQRSUVWXYZ','ACGTACGTACGTACGTACGTA') AS seq"
_REGIONS = ["concat('doc',CAST(doc_id+(doc_id%7)*2 AS STRING)) AS chrom", "doc_id*37%400 AS start", "doc_id*37%400+30+doc_id%150 AS stop", "source AS name", "doc_id AS ord"]


def rel(spark: SparkSession, d: str, name: str) -> DataFrame:
    table, columns, where = RELATIONS[name]
    return spark.read.parquet(f"{d}/{table}.parquet").where(where).selectExpr(*columns)


def fasta(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").selectExpr("concat('doc',CAST(doc_id AS STRING)) AS name", _FASTA.format(flag=""), "60 AS width", "doc_id AS ord")


def regions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").selectExpr(*_REGIONS)


def kinds(spark: SparkSession, d: str) -> list[DataFrame]:
    """b dealt to three files."""
    b = rel(spark, d, "b")
    return [b.where(f"ord % 3 = {i}") for i in range(3)]


def graphs(spark: SparkSession, d: str) -> list[DataFrame]:
    """As kinds, made disjoint in each file, with a value."""
    from pyspark.sql import Window as W

    out = []
    for b in kinds(spark, d):
        nxt = F.lead("start").over(W.partitionBy("chrom").orderBy("start", "ord"))
        out.append(b.withColumn("stop", F.least("stop", nxt)).select("chrom", "start", "stop", (F.col("ord") % 97).cast("string").alias("value"), "ord").where("start < stop"))
    return out


def _cte(*more: str) -> str:
    parts = [f"{k} AS (SELECT {', '.join(c)} FROM {t} WHERE {w})" for k, (t, c, w) in RELATIONS.items()]
    parts += [f"fa AS (SELECT concat('doc',CAST(doc_id AS STRING)) AS name, {_FASTA.format(flag=", 'g'")} FROM documents)", f"reg AS (SELECT {', '.join(_REGIONS)} FROM documents)"]
    return "WITH " + ", ".join([*parts, *more]) + " "


def _islands(name: str, source: str) -> str:
    return f"""{name} AS (SELECT chrom, min(start) AS start, max(stop) AS stop FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY chrom, k)"""


_MA, _MB = _islands("ma", "a"), _islands("mb", "b")
_HIT = "a JOIN b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop"
_SIZED = "a LEFT JOIN g ON a.chrom = g.chrom"
_END = "coalesce(g.size, 9223372036854775807)"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None, *more: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = _cte(*more) + sql


def _on_a(f: Callable[..., DataFrame], *others: str, **kw) -> Query:
    return lambda s, d: f(rel(s, d, "a"), *[rel(s, d, o) for o in others], **kw)


_add("slop", _on_a(rows.slop, "g", left=100, right=60), f"SELECT a.chrom, greatest(a.start-100,0) AS start, least(a.stop+60,{_END}) AS stop, a.ord FROM {_SIZED}")
_add("flank", _on_a(rows.flank, "g", left=100, right=60), f"SELECT * FROM (SELECT a.chrom, greatest(a.start-100,0) AS start, a.start AS stop, a.ord FROM a UNION ALL SELECT a.chrom, a.stop, least(a.stop+60,{_END}), a.ord FROM {_SIZED}) WHERE start<stop")
_add("flank_bp", _on_a(rows.flank_bp, bp=75), "SELECT chrom, greatest(start-75,0) AS start, stop+75 AS stop, name, score, strand, ord FROM a")
_add("shift", _on_a(rows.shift, "g", by=-500), f"SELECT * FROM (SELECT a.chrom, least(greatest(a.start-500,0),{_END}) AS start, least(greatest(a.stop-500,0),{_END}) AS stop, a.ord FROM {_SIZED}) WHERE start<stop")
_add("resize", _on_a(rows.resize, size=101), "SELECT chrom, greatest(((start+stop)>>1)-50,0) AS start, ((start+stop)>>1)+50 AS stop, name, score, strand, ord FROM a")
_add("midpoint", _on_a(rows.midpoint), "SELECT chrom, (start+stop)>>1 AS start, ((start+stop)>>1)+1 AS stop, ord FROM a")
_add("promoters", _on_a(rows.promoters), "SELECT chrom, CASE WHEN strand='-' THEN stop ELSE greatest(start-2000,0) END AS start, CASE WHEN strand='-' THEN stop+2200 ELSE start+200 END AS stop, name, score, strand, ord FROM a")
_add("len", _on_a(rows.lengths), "SELECT ord, greatest(stop-start,0) AS len FROM a")
_add("rename", _on_a(rows.rename, "names"), "SELECT coalesce(n.new,a.chrom) AS chrom, a.start, a.stop, a.name, a.score, a.strand, a.ord FROM a LEFT JOIN names n ON a.chrom=n.old")
_add("makewindows", lambda s, d: rows.makewindows(rel(s, d, "g"), 3000, 2000), "SELECT chrom, w AS start, least(w+3000,size) AS stop FROM (SELECT chrom, size, unnest(range(0,size,2000)) AS w FROM g)")
_add("tail", _on_a(rows.tail, n=25), "SELECT * FROM a ORDER BY ord DESC LIMIT 25")
_add("unique", lambda s, d: rows.unique(rel(s, d, "a").withColumn("start", F.expr("start - start % 5000")).withColumn("stop", F.col("start") + 5000)), "SELECT chrom, start, start+5000 AS stop, name, score, strand, ord FROM (SELECT chrom, start-start%5000 AS start, name, score, strand, ord, row_number() OVER (PARTITION BY chrom, start-start%5000 ORDER BY ord) AS k FROM a) WHERE k=1")
_add("sample", _on_a(rows.sample, n=100), None)
_NUMBERS = """x(t, v) AS (SELECT CAST(0 AS BIGINT), CAST(42 AS HUGEINT) UNION ALL
  SELECT t+1, xor(c, (c<<17) & 18446744073709551615) FROM (SELECT t, xor(b, b>>7) AS c FROM (SELECT t, xor(v, (v<<13) & 18446744073709551615) AS b FROM x WHERE t < (SELECT count(*) FROM a)-1))),
nums AS MATERIALIZED (SELECT i, CAST(v % (i+1) AS BIGINT) AS j FROM (SELECT (SELECT count(*) FROM a)-t AS i, v FROM x WHERE t > 0)),
c(p, place) AS (SELECT p, p FROM (SELECT unnest(range(100)) AS p) UNION ALL SELECT c.p, min(nums.i) FROM c JOIN nums ON nums.j = c.place AND nums.i > c.place AND nums.i >= 100 GROUP BY c.p),
s(i, l) AS (SELECT 99, (SELECT list(m ORDER BY p) FROM (SELECT p, max(place) AS m FROM c GROUP BY p)) UNION ALL
  SELECT s.i-1, list_transform(range(1, 101), lambda q: CASE WHEN q = s.i+1 THEN l[j+1] WHEN q = j+1 THEN l[s.i+1] ELSE l[q] END) FROM s JOIN nums ON nums.i = s.i WHERE s.i > 0),
told AS (SELECT CAST(q-1 AS INTEGER) AS place, l[q] AS r FROM s, unnest(range(1, 101)) u(q) WHERE s.i = 0)"""
_add("sample_exact", _on_a(rows.sample_exact, n=100), "SELECT chrom, start, stop, name, score, strand, ord, place FROM told JOIN (SELECT *, row_number() OVER (ORDER BY ord)-1 AS k FROM a) ON k = r", _NUMBERS)
ORACLE_SQL["sample_exact"] = ORACLE_SQL["sample_exact"].replace("WITH ", "WITH RECURSIVE ", 1)


_add("sort", lambda s, d: rows.sort(rel(s, d, "a")), "SELECT * FROM a ORDER BY chrom, start, ord")
_add("sort_name", _on_a(rows.sort_name), "SELECT * FROM a ORDER BY name, ord")
_add("sort_size", _on_a(rows.sort_size, descending=True), "SELECT * FROM a ORDER BY stop-start DESC, ord")
_add("count", _on_a(agg.count), "SELECT count(*) AS n FROM a")
_add("stats", _on_a(agg.stats), "SELECT count(*) AS n, CAST(sum(stop-start) AS BIGINT) AS total_bases, avg(stop-start) AS mean_len, median(stop-start) AS median_len, min(stop-start) AS min_len, max(stop-start) AS max_len FROM a")
_add("coverage_hist", _on_a(agg.coverage_hist), "SELECT count(*) AS n_rows, CAST(sum(stop-start) AS BIGINT) AS total_bp, min(stop-start) AS min_len, max(stop-start) AS max_len, avg(stop-start) AS mean_len, list_sort(list(stop-start))[count(*)//2+1] AS median_len FROM a")
_add("total_bp", _on_a(agg.total_bp), "SELECT CAST(sum(stop-start) AS BIGINT) AS total_bp FROM a")
_add("total_span", _on_a(agg.total_span), "SELECT chrom, max(stop)-min(start) AS span FROM a GROUP BY 1 UNION ALL SELECT 'total', CAST(sum(s) AS BIGINT) FROM (SELECT max(stop)-min(start) AS s FROM a GROUP BY chrom)")
_add("chroms", _on_a(agg.chroms), "SELECT DISTINCT chrom FROM a")
_add("chroms_sizes", _on_a(agg.chroms_sizes), "SELECT chrom, CAST(sum(stop-start) AS BIGINT) AS bases FROM a GROUP BY 1")
_add("merge_by_name", _on_a(agg.merge_by_name), "SELECT chrom, name, min(start) AS start, max(stop) AS stop FROM a GROUP BY 1, 2")

def _group(op: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        status = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
        return agg.group_runs(rel(s, d, "a").join(status, "ord"), ["status"], [("score", op)]).withColumnRenamed(f"{op}_score", op)

    return query


_GROUPED = {"sum": "CAST(sum(score) AS DOUBLE)", "mean": "avg(score)", "min": "CAST(min(score) AS DOUBLE)", "max": "CAST(max(score) AS DOUBLE)", "count": "count(score)", "stdev": "stddev_pop(score)", "collapse": "string_agg(CAST(score AS VARCHAR), ',' ORDER BY ord)", "distinct": "(SELECT string_agg(v, ',' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(list(CAST(score AS VARCHAR) ORDER BY ord)) AS v, generate_subscripts(list(score), 1) AS p) GROUP BY v))", "count_distinct": "count(DISTINCT score)", "first": "CAST(arg_min(score, ord) AS VARCHAR)", "last": "CAST(arg_max(score, ord) AS VARCHAR)"}
_RUN = "runs AS (SELECT *, CAST(sum(fresh) OVER (ORDER BY ord) AS BIGINT) AS run FROM (SELECT *, CASE WHEN status = lag(status) OVER (ORDER BY ord) THEN 0 ELSE 1 END AS fresh FROM (SELECT a.*, o.o_orderstatus AS status FROM a JOIN orders o ON o.o_orderkey = a.ord)))"
for _op, _sql in _GROUPED.items():
    if _op == "distinct":
        _add("groupby_distinct", _group("distinct"), "SELECT run, status, string_agg(CAST(score AS VARCHAR), ',' ORDER BY p) AS \"distinct\" FROM (SELECT run, status, score, min(ord) AS p FROM runs GROUP BY 1, 2, 3) GROUP BY 1, 2", _RUN)
    else:
        _add(f"groupby_{_op}", _group(_op), f'SELECT run, status, {_sql} AS "{_op}" FROM runs GROUP BY 1, 2', _RUN)



def _group_lists(s: SparkSession, d: str) -> DataFrame:
    status = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return agg.group_runs(rel(s, d, "a").join(status, "ord"), ["status", "strand"], [("score", "sum"), ("start", "max"), ("name", "collapse")])


_add("groupby_lists", _group_lists, "SELECT run, status, strand, CAST(sum(score) AS DOUBLE) AS sum_score, CAST(max(start) AS DOUBLE) AS max_start, string_agg(name, ',' ORDER BY ord) AS collapse_name FROM runs GROUP BY 1, 2, 3", _RUN.replace("status = lag(status) OVER (ORDER BY ord)", "status = lag(status) OVER (ORDER BY ord) AND strand = lag(strand) OVER (ORDER BY ord)"))
_add("intersect", _on_a(rangejoin.intersect, "b"), f"SELECT a.chrom, greatest(a.start,b.start) AS start, least(a.stop,b.stop) AS stop, a.name, a.score, a.strand, a.ord FROM {_HIT}")


def _intersect_binned(s: SparkSession, d: str) -> DataFrame:
    """b is written in bins under a name of its own, and met where it lies."""
    name = f"b_binned_{uuid.uuid4().hex}"
    return rangejoin.intersect(rel(s, d, "a"), rangejoin.BinnedTable.write(rel(s, d, "b").select("chrom", "start", "stop"), name, 8))


_add("intersect_binned", _intersect_binned, ORACLE_SQL["intersect"].removeprefix(_cte()))
_add("subtract", _on_a(rangejoin.subtract, "b"), "SELECT chrom, CAST(lo AS BIGINT) AS start, CAST(hi AS BIGINT) AS stop, name, score, strand, ord FROM (SELECT a.*, coalesce(lag(least(m.stop,a.stop)) OVER w, a.start) AS lo, CASE WHEN m.start IS NULL THEN a.stop ELSE greatest(m.start,a.start) END AS hi FROM a LEFT JOIN mb m ON a.chrom=m.chrom AND a.start<m.stop AND m.start<a.stop WINDOW w AS (PARTITION BY a.ord ORDER BY m.start) UNION ALL SELECT a.*, max(least(m.stop,a.stop)) AS lo, a.stop AS hi FROM a JOIN mb m ON a.chrom=m.chrom AND a.start<m.stop AND m.start<a.stop GROUP BY ALL) WHERE lo<hi", _MB)
_add("window", lambda s, d: rangejoin.window(rel(s, d, "a"), rel(s, d, "b"), 200), "SELECT " + ", ".join(f"a.{c} AS a_{c}" for c in ("chrom", "start", "stop", "name", "score", "strand", "ord")) + ", " + ", ".join(f"b.{c} AS b_{c}" for c in ("chrom", "start", "stop", "name", "score", "ord")) + " FROM a JOIN b ON a.chrom=b.chrom AND greatest(a.start-200,0)<b.stop AND b.start<a.stop+200")
for _op, _sql in (("mean", "avg(b.score)"), ("sum", "CAST(sum(b.score) AS DOUBLE)"), ("min", "CAST(min(b.score) AS DOUBLE)"), ("max", "CAST(max(b.score) AS DOUBLE)"), ("count", "CAST(nullif(count(b.score),0) AS DOUBLE)")):
    _add(f"map_{_op}", _on_a(rangejoin.map_values, "b", op=_op), f"SELECT a.chrom, a.start, a.stop, a.name, a.score, a.strand, a.ord, {_sql} AS value FROM a LEFT JOIN b ON a.chrom=b.chrom AND a.start<b.stop AND b.start<a.stop GROUP BY ALL")
_add("overlap", _on_a(rangejoin.overlap_stats, "b"), f"SELECT *, overlap_bases/(a_bases+b_bases-overlap_bases) AS jaccard FROM (SELECT (SELECT count(*) FROM a) AS a_count, (SELECT CAST(sum(stop-start) AS BIGINT) FROM a) AS a_bases, (SELECT count(*) FROM b) AS b_count, (SELECT CAST(sum(stop-start) AS BIGINT) FROM b) AS b_bases, count(DISTINCT a.ord) AS a_with_overlap, count(DISTINCT b.ord) AS b_with_overlap, CAST(coalesce(sum(least(a.stop,b.stop)-greatest(a.start,b.start)),0) AS BIGINT) AS overlap_bases FROM {_HIT})")
_add("jaccard", _on_a(rangejoin.jaccard, "b"), 'SELECT i AS intersection, x+y-i AS "union", i/(x+y-i) AS jaccard, n AS n_intersections FROM (SELECT CAST(coalesce(sum(least(ma.stop,mb.stop)-greatest(ma.start,mb.start)),0) AS BIGINT) AS i, count(*) AS n, (SELECT CAST(sum(stop-start) AS BIGINT) FROM ma) AS x, (SELECT CAST(sum(stop-start) AS BIGINT) FROM mb) AS y FROM ma JOIN mb ON ma.chrom=mb.chrom AND ma.start<mb.stop AND mb.start<ma.stop)', _MA, _MB)


def _fisher(s: SparkSession, d: str) -> DataFrame:
    out = rangejoin.fisher(rel(s, d, "a"), rel(s, d, "b"), rel(s, d, "g"))
    return out.select("n11", "n12", "n21", "n22", *[F.round(c, 6).alias(c) for c in ("left", "right", "two_tail")], "ratio")


_TABLE = "t AS (SELECT n11, n12, n21, greatest(n11+n12+n21, CAST(trunc((SELECT sum(size) FROM g)/(2+(SELECT sum(stop-start)/count(*) FROM a)+(SELECT sum(stop-start)/count(*) FROM b))) AS BIGINT))-n11-n12-n21 AS n22 FROM (SELECT n AS n11, greatest((SELECT count(*) FROM a)-n,0) AS n12, greatest((SELECT count(*) FROM b)-n,0) AS n21 FROM (SELECT count(*) AS n FROM a JOIN b ON a.chrom=b.chrom AND (a.start<b.stop AND b.start<a.stop OR a.start=b.start))))"
_CHOOSE = lambda n, k: f"lgamma({n}+1)-lgamma({k}+1)-lgamma({n}-({k})+1)"
_TERMS = f"p AS (SELECT *, {_CHOOSE('r1', 'k')}+{_CHOOSE('nn-r1', 'c1-k')}-({_CHOOSE('nn', 'c1')}) AS l FROM (SELECT *, unnest(range(greatest(0, r1+c1-nn), least(r1, c1)+1)) AS k FROM (SELECT *, (n11+n12)::DOUBLE::BIGINT AS r1, n11+n21 AS c1, n11+n12+n21+n22 AS nn FROM t)))"
_add("fisher", _fisher, 'SELECT n11, n12, n21, n22, round(least(1, sum(exp(l)) FILTER (k<=n11)), 6) AS "left", round(least(1, sum(exp(l)) FILTER (k>=n11)), 6) AS "right", round(least(1, sum(exp(l)) FILTER (l<=o+1e-7)), 6) AS two_tail, CASE WHEN n12=0 OR n21=0 THEN CAST(\'inf\' AS DOUBLE) ELSE CAST(n11*n22 AS DOUBLE)/CAST(n12*n21 AS DOUBLE) END AS ratio FROM (SELECT *, max(CASE WHEN k=n11 THEN l END) OVER () AS o FROM p) GROUP BY n11, n12, n21, n22', _TABLE, _TERMS)
_add("closest", _on_a(nearest.closest, "b"), "SELECT " + ", ".join(f"p.a_{c} AS a_{c}" for c in ("chrom", "start", "stop", "name", "score", "strand", "ord")) + ", coalesce(b_chrom,'.') AS b_chrom, coalesce(b_start,-1) AS b_start, coalesce(b_stop,-1) AS b_stop, b_ord FROM (SELECT *, rank() OVER (PARTITION BY a_ord ORDER BY gap) AS k FROM (SELECT " + ", ".join(f"a.{c} AS a_{c}" for c in ("chrom", "start", "stop", "name", "score", "strand", "ord")) + ", b.chrom AS b_chrom, b.start AS b_start, b.stop AS b_stop, b.ord AS b_ord, CASE WHEN b.start<a.stop AND a.start<b.stop THEN -1 WHEN b.stop<=a.start THEN a.start-b.stop ELSE b.start-a.stop END AS gap FROM a LEFT JOIN b ON a.chrom=b.chrom)) p WHERE k=1")
_add("annotate", lambda s, d: nearest.annotate(rel(s, d, "a"), text.features(rel(s, d, "feat"))), "SELECT chrom, start, stop, name, score, strand, ord, fname AS feature, dist FROM (SELECT a.*, f.fname, CASE WHEN f.fs IS NULL THEN NULL WHEN (a.start+a.stop)>>1 < f.fs THEN f.fs-((a.start+a.stop)>>1) WHEN (a.start+a.stop)>>1 > f.fe THEN ((a.start+a.stop)>>1)-f.fe ELSE 0 END AS dist, row_number() OVER (PARTITION BY a.ord ORDER BY dist, f.fs, f.fo) AS k FROM a LEFT JOIN (SELECT chrom AS fc, start AS fs, stop AS fe, split_part(attributes,'gene_name=',2) AS fname, ord AS fo FROM feat WHERE ftype='gene') f ON a.chrom=f.fc) WHERE k=1")
_add("reldist", _on_a(nearest.reldist, "b"), "SELECT bin/100 AS reldist, n AS \"count\", CAST(sum(n) OVER () AS BIGINT) AS total, n/sum(n) OVER () AS fraction FROM (SELECT CAST(floor((CASE WHEN l IS NULL OR least(m-l,r-m)=0 THEN 0.0::DOUBLE ELSE least(m-l,r-m)/(r-l) END)*100) AS BIGINT) AS bin, count(*) AS n FROM (SELECT q.ord, q.m, max(CASE WHEN v.m<q.m THEN v.m END) AS l, min(CASE WHEN v.m>=q.m THEN v.m END) AS r, count(*) AS c, min(v.m) AS f FROM (SELECT chrom, (start+stop)//2 AS m, ord FROM a) q JOIN (SELECT chrom, (start+stop)//2 AS m FROM b) v ON q.chrom=v.chrom GROUP BY 1, 2) WHERE r IS NOT NULL AND (l IS NOT NULL OR m=f AND c>=2) GROUP BY 1)")

_add("merge", _on_a(islands.merge), "SELECT chrom, start, stop FROM ma", _MA)
_add("merge_overlaps", lambda s, d: islands.merge(rel(s, d, "b")), "SELECT chrom, start, stop FROM mb", _MB)
_add("union", _on_a(islands.union, "b"), "SELECT chrom, start, stop FROM mu", "ab AS (SELECT chrom, start, stop FROM a UNION ALL SELECT chrom, start, stop FROM b)", _islands("mu", "ab"))
_add("complement", _on_a(islands.complement, "g"), "SELECT * FROM (SELECT g.chrom, coalesce(lag(m.stop) OVER (PARTITION BY g.chrom ORDER BY m.start),0) AS start, coalesce(least(m.start,g.size),g.size) AS stop FROM g LEFT JOIN ma m ON g.chrom=m.chrom UNION ALL SELECT g.chrom, max(m.stop), any_value(g.size) FROM g JOIN ma m ON g.chrom=m.chrom GROUP BY g.chrom) WHERE start<stop", _MA)

#: Lines that are nearly in order, of chromosomes that are met again, some left of 0.
_LINES = ["concat('c',CAST(ord%2000 DIV 500 AS STRING)) AS chrom", "ord%500*200+start%300-20000 AS start", "ord%500*200+start%300-20000+50+ord%200 AS stop", "name", "ord"]
_RUNS = "lines AS (SELECT " + ", ".join(_LINES).replace(" DIV ", "//") + " FROM a), r AS (SELECT *, sum(other) OVER (ORDER BY ord) AS run FROM (SELECT *, CASE WHEN chrom = lag(chrom) OVER (ORDER BY ord) THEN 0 ELSE 1 END AS other FROM lines))"
_add("cluster", lambda s, d: islands.cluster(rel(s, d, "a").selectExpr(*_LINES), 30), "SELECT chrom, start, stop, name, ord, CAST(sum(fresh) OVER (ORDER BY ord) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN start <= 30+max(stop) OVER (PARTITION BY run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r)", _RUNS)
_add("spacing", _on_a(islands.spacing), "SELECT chrom, p AS start, start AS stop, start-p AS gap FROM (SELECT chrom, start, lag(stop) OVER (ORDER BY ord) AS p, lag(chrom) OVER (ORDER BY ord) AS pc FROM a) WHERE start>=p AND chrom=pc")

_CUTS = "cov AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS stop FROM (SELECT DISTINCT chrom, unnest([0, size, least(start,size), least(stop,size)]) AS pos FROM g LEFT JOIN (SELECT chrom, start, stop FROM a) USING (chrom)) WHERE pos IS NOT NULL)"
_add("genomecov", _on_a(sweep.genomecov, "g"), "SELECT *, bases/size AS fraction FROM (SELECT 'chrom' AS scope, chrom, depth, CAST(sum(w) AS BIGINT) AS bases, size FROM dep JOIN g USING (chrom) GROUP BY chrom, depth, size UNION ALL SELECT 'genome', 'genome', depth, CAST(sum(w) AS BIGINT), (SELECT CAST(sum(size) AS BIGINT) FROM g) FROM dep GROUP BY depth)", _CUTS, "dep AS (SELECT c.chrom, c.stop-c.start AS w, count(a.ord) AS depth FROM cov c LEFT JOIN a ON a.chrom=c.chrom AND a.start<c.stop AND c.start<a.stop WHERE c.stop IS NOT NULL GROUP BY c.chrom, c.start, c.stop)")
_SEGMENTS = "seg AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS stop FROM (SELECT DISTINCT chrom, unnest([start, stop]) AS pos FROM src))"
_add("multiinter", lambda s, d: sweep.multiinter(kinds(s, d), ["x", "y", "z"]), "SELECT chrom, start, stop, x+y+z AS n, concat_ws(',', CASE WHEN x=1 THEN 'x' END, CASE WHEN y=1 THEN 'y' END, CASE WHEN z=1 THEN 'z' END) AS list, x, y, z FROM (SELECT s.chrom, s.start, s.stop, CAST(max(CASE WHEN m.f=0 THEN 1 ELSE 0 END) AS BIGINT) AS x, CAST(max(CASE WHEN m.f=1 THEN 1 ELSE 0 END) AS BIGINT) AS y, CAST(max(CASE WHEN m.f=2 THEN 1 ELSE 0 END) AS BIGINT) AS z FROM seg s JOIN src m ON m.chrom=s.chrom AND m.start<s.stop AND s.start<m.stop WHERE s.stop IS NOT NULL GROUP BY 1, 2, 3)", *[x for i in range(3) for x in (f"b{i} AS (SELECT * FROM b WHERE ord % 3 = {i})", _islands(f"m{i}", f"b{i}"))], "src AS (SELECT *, 0 AS f FROM m0 UNION ALL SELECT *, 1 FROM m1 UNION ALL SELECT *, 2 FROM m2)", _SEGMENTS)
_add("unionbedg", lambda s, d: sweep.unionbedg(graphs(s, d), ["x", "y", "z"]), "SELECT s.chrom, s.start, s.stop, " + ", ".join(f"coalesce(max(CASE WHEN m.f={i} THEN m.value END),'0') AS {c}" for i, c in enumerate("xyz")) + " FROM seg s JOIN src m ON m.chrom=s.chrom AND m.start<s.stop AND s.start<m.stop WHERE s.stop IS NOT NULL GROUP BY 1, 2, 3", "src AS (SELECT chrom, start, stop, CAST(ord%97 AS VARCHAR) AS value, f FROM (SELECT chrom, start, least(stop, lead(start) OVER (PARTITION BY ord%3, chrom ORDER BY start, ord)) AS stop, ord, ord%3 AS f FROM b) WHERE start<stop)", _SEGMENTS)

_CUT = "substr(seq, start+1, greatest(stop-start,0))"
_add("getfasta", lambda s, d: sequences.get_fasta(regions(s, d), fasta(s, d)), f"SELECT r.ord, concat(r.chrom,':',start,'-',stop) AS header, {_CUT} AS seq FROM reg r JOIN fa ON r.chrom=fa.name WHERE start<stop AND stop<=length(seq)")
_add("to_fasta", lambda s, d: sequences.to_fasta(regions(s, d), fasta(s, d)), f"SELECT r.ord, concat(r.chrom,':',start,'-',stop,'_',r.name) AS header, {_CUT} AS seq FROM reg r JOIN fa ON r.chrom=fa.name")
_add("nuc", lambda s, d: sequences.nuc(regions(s, d), fasta(s, d)), "SELECT chrom, start, stop, ord, CASE WHEN n>0 THEN (a+t)/n ELSE 0.0 END AS pct_at, CASE WHEN n>0 THEN (g+c)/n ELSE 0.0 END AS pct_gc, a AS n_a, c AS n_c, g AS n_g, t AS n_t, x AS n_n, n-a-c-g-t-x AS n_other, n AS seq_len FROM (SELECT chrom, start, stop, ord, length(s) AS n, " + ", ".join(f"length(s)-length(replace(s,'{b}','')) AS {c}" for b, c in zip("ACGTN", "acgtx", strict=True)) + f" FROM (SELECT r.chrom, start, stop, ord, upper(coalesce({_CUT},'')) AS s FROM reg r LEFT JOIN fa ON r.chrom=fa.name))")
_add("maskfasta", lambda s, d: sequences.mask_fasta(fasta(s, d).select("name", "seq"), regions(s, d)), "SELECT name, string_agg(CASE WHEN start IS NOT NULL AND p>start AND p<=stop THEN 'N' ELSE substr(seq,p,1) END, '' ORDER BY p) AS seq FROM (SELECT f.name, f.seq, p, m.start, m.stop FROM (SELECT name, seq, unnest(range(1,length(seq)+1)) AS p FROM fa) f LEFT JOIN mr m ON m.chrom=f.name AND m.start<f.p AND f.p<=m.stop) GROUP BY name UNION ALL SELECT name, seq FROM fa WHERE length(seq)=0", _islands("mr", "reg"))
_add("to_gff", _on_a(text.to_gff), "SELECT CAST(-1 AS BIGINT) AS ord, '##gff-version 3' AS line UNION ALL SELECT ord, concat_ws(chr(9), chrom,'gapwise','region',start+1,stop,score,strand,'.',concat('Name=',name)) FROM a")
_add("to_gff3", _on_a(text.to_gff3), "SELECT CAST(-1 AS BIGINT) AS ord, '##gff-version 3' AS line UNION ALL SELECT ord, concat_ws(chr(9), chrom,'BED','region',start+1,stop,score,strand,'.',concat('ID=',name)) FROM a")
_add("to_igv", _on_a(text.to_igv), "SELECT CAST(-1 AS BIGINT) AS ord, concat_ws(chr(9),'Chromosome','Start','End','Feature','Score') AS line UNION ALL SELECT ord, concat_ws(chr(9), chrom,start,stop,name,score) FROM a")
_add("to_wig", _on_a(text.to_wig), "SELECT ord, 0 AS k, concat('variableStep chrom=',chrom) AS line FROM (SELECT *, lag(chrom) OVER (ORDER BY ord) AS p FROM a) WHERE p IS NULL OR p<>chrom UNION ALL SELECT ord, 1, concat(start+1,' ',score) FROM a")
_LINE = "CASE WHEN ord%11=0 THEN concat(chrom,chr(9),start) WHEN ord%11=1 THEN concat(chrom,chr(9),'x',chr(9),stop) WHEN ord%11=2 THEN concat(chrom,chr(9),stop,chr(9),start) ELSE concat(chrom,chr(9),start,chr(9),stop) END"
_add("validate", lambda s, d: text.validate(rel(s, d, "a").select("ord", F.expr(_LINE).alias("line"))), "SELECT ord, CASE ord%11 WHEN 0 THEN 'fewer than 3 fields' WHEN 1 THEN 'bad start' ELSE 'start after end' END AS error FROM a WHERE ord%11<3")


def _shuffled(s: SparkSession, d: str) -> DataFrame:
    a, g, b = rel(s, d, "a"), rel(s, d, "g"), rel(s, d, "b")
    out = randomness.shuffle(a, g, exclude=b)
    both = out.join(a.select("ord", (F.col("stop") - F.col("start")).alias("len")), "ord").join(g.select("chrom", "size"), "chrom")
    met = rangejoin.overlap_pairs(out.select("chrom", "start", "stop"), b.select("chrom", "start", "stop")).agg(F.count("*").alias("met"))
    return both.agg(F.count("*").alias("n"), F.sum(F.when((F.col("start") >= 0) & (F.col("stop") <= F.col("size")), 1).otherwise(0)).alias("inside"), F.sum(F.when(F.col("stop") - F.col("start") == F.col("len"), 1).otherwise(0)).alias("as_long")).crossJoin(met)  # one row each


_add("random", lambda s, d: randomness.random_intervals(s, rel(s, d, "g"), 5000, 1000), "SELECT i AS ord, chrom, p-off AS start, p-off+1000 AS stop FROM places JOIN laid ON off <= p AND p < off+size", "laid AS (SELECT chrom, size, coalesce(CAST(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off FROM g)", "places AS (SELECT i, CAST(concat('0x', left(md5(concat('42:', i)), 15)) AS BIGINT) % ((SELECT CAST(sum(size) AS BIGINT) FROM g)-1000) AS p FROM (SELECT unnest(range(5000)) AS i))")
_add("shuffle", _shuffled, "SELECT count(*) AS n, count(*) AS inside, count(*) AS as_long, CAST(0 AS BIGINT) AS met FROM a")
