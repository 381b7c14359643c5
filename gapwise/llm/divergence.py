"""Source divergence audit: how far each source of a language is from the others and from the language, term by term.

Texts become counts of terms in each task before anything is shuffled. The terms that a source uses more than its language
are found by an upper-bound search: a source's terms are put in buckets by count, and a bucket's highest probability in the
source and lowest in the language bound the divergence of all its terms. Buckets are evaluated in the order of their bounds,
for all groups at once, until every unseen bound is strictly below the k-th value found. Divergences of pairs of sources
come from the postings of each term (the sources that have it): what terms add that one of two sources lacks follows from
the other's histogram of counts, so that only sources that share a term are held against each other, and the sums of their
pairs alone leave a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, small_side

#: Documents of a language that a term must be in; terms reported for a group; scale of probabilities.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms of all groups that a task counts before it sends them on; bytes of a text that are split at once.
HELD_TERMS, SPLIT_BYTES = 400_000, 1 << 20
#: Buckets of a group that the first turn of the search evaluates; each later turn takes twice as many.
FIRST_BUCKETS = 4
#: Pairs of sources that a task holds against each other at once, in the mean.
PAIRS = 1 << 21

#: ASCII letters become lower case, bytes from 0x80 on stay, any other byte separates.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists of about SPLIT_BYTES; no term is cut."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + SPLIT_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the group's documents that have it."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def send(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            columns = [[lang] * len(n), [source] * len(n), list(n), list(n.values()), [docs[t] for t in n]]
            whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for lo in range(0, len(n), 50_000):
                yield whole.slice(lo, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for found in terms_of(text.as_py()):
                    n.update(found)
                    own.update(found)
                docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from send(held)
                held = {}
        yield from send(held)

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for all longs."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * terms))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two probabilities; the square is under 2^60."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


#: Grows with the count n; the same for counts of one length in bits and one start of three bits.
BUCKET = "length(bin(n)) * 4 + cast(shiftright(n, greatest(length(bin(n)) - 3, 0)) & 3 as int)"


def top_terms(postings: DataFrame, k: int = TOP, first: int = FIRST_BUCKETS) -> DataFrame:
    """(gid, term, value, rank): each group's k terms of the highest divergence from the language among those it uses more.

    postings: gid, term, bucket, p (in the group) and q (in the language). Divergence grows with p and falls with q where
    p > q, so a bucket's highest p and lowest q bound it. Ties go to the smaller term, which is why a bucket whose bound
    equals the k-th value is still evaluated.
    """
    order = W.partitionBy("gid").orderBy(F.col("bound").desc(), "bucket")
    stats = postings.groupBy("gid", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).where("p > q")
    buckets = materialize(stats.select("gid", "bucket", apart(F.col("p"), F.col("q")).alias("bound")).withColumn("place", F.row_number().over(order)), "audit-buckets")
    best_first = F.row_number().over(W.partitionBy("gid").orderBy(F.col("value").desc(), "term"))
    found, seen, step = None, 0, first
    while True:
        todo = buckets.where((F.col("place") > seen) & (F.col("place") <= seen + step))
        if found is not None:
            kth = found.where(F.col("rank") == k).select("gid", F.col("value").alias("kth"))
            todo = todo.join(small_side(kth), "gid", "left").where("kth is null or bound >= kth")
        todo = materialize(todo.select("gid", "bucket"), "audit-turn")
        size = todo.count()
        if found is not None and not size:
            return found
        seen, step = seen + step, step * 2
        met = postings.join(small_side(todo, size), ["gid", "bucket"]).where("p > q").select("gid", "term", apart(F.col("p"), F.col("q")).alias("value"))
        met = met if found is None else met.unionByName(found.select("gid", "term", "value"))
        found = materialize(met.withColumn("rank", best_first).where(F.col("rank") <= k), "audit-found")


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, other, value): the summed divergence of each two sources of a language, both ways.

    With p0 the probability of a term that a group lacks, and f the divergence, the sum over all V terms is V f(p0, q0),
    plus f(p, q0) - f(p0, q0) for each term of the one and f(p0, q) - f(p0, q0) for each of the other, plus
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for each term of both.
    """
    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    of_lang = groups.select("lang", "gid", "p0", "terms").join(small_side(other), "lang").where("gid <> other")
    bare = of_lang.select("gid", "other", (F.col("terms") * apart(F.col("p0"), F.col("q0"))).alias("value"))
    hist = postings.groupBy("lang", "gid", "p", "p0").agg(F.count("*").alias("n")).join(small_side(other), "lang").where("gid <> other")
    alone = hist.select("gid", "other", (F.col("n") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("value"))

    shared = postings.where("sharing > 1")
    work = shared.agg(F.sum(F.col("sharing") - 1).alias("w")).first()["w"] or 0
    dealt = shared.select("lang", F.pmod(F.xxhash64("term"), F.lit(max(1, -(-work // (2 * PAIRS))))).alias("part"), "term", "gid", "p", "p0")

    def hold(t: pa.Table) -> pa.Table:
        gids, at = np.unique(t.column("gid").to_numpy(), return_inverse=True)
        term = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        by = np.lexsort((at, term))
        term, at, p, p0 = term[by], at[by].astype(np.int64), t.column("p").to_numpy()[by], t.column("p0").to_numpy()[by]
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(1, len(term)):
            i = np.flatnonzero(term[d:] == term[:-d])
            if not len(i):
                break
            j = i + d
            value = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
            codes, place = np.unique(np.concatenate([codes, at[i] * len(gids) + at[j]]), return_inverse=True)
            held, sums = np.concatenate([sums, value]), np.zeros(len(codes), np.int64)
            np.add.at(sums, place, held)
        return pa.table({"gid": gids[codes // len(gids)], "other": gids[codes % len(gids)], "value": sums})

    both = dealt.groupBy("lang", "part").applyInArrow(hold, "gid long, other long, value long").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    back = lambda df: df.unionByName(df.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
    return bare.unionByName(back(alone.groupBy("gid", "other").agg(F.sum("value").alias("value")))).unionByName(back(both)).groupBy("gid", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents with text, lang and source.

    Part `pair`: every other source of the language, by its summed divergence. Part `term`: the k terms of the highest
    divergence among those that the source uses more than its language. Ranks go by value descending, then by the
    UTF-8 bytes of item. Terms are runs of ASCII letters (in lower case) and characters beyond ASCII; a language keeps
    those in at least `least_docs` of its documents.

    Null text, lang or source is as ''. A group without kept terms has pairs (of value 0 if its language keeps none) and no
    terms; a language of one source has no pairs. Repeated rows count as often as they are there. Extra columns are not
    read. An empty table gives an empty result. Values are exact while a language has under 2^60 occurrences of terms.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    of_term = W.partitionBy("lang", "term")
    wide = term_counts(rows).select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"), F.count("*").over(of_term).alias("sharing"), (F.min("source").over(of_term) == F.col("source")).alias("lead"))
    kept = materialize(wide.where(F.col("lang_docs") >= least_docs).withColumn("term", F.col("term").cast("string")).drop("lang_docs"), "audit-kept")

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(small_side(langs), "lang", "left").na.fill(0)
    groups = groups.withColumn("p0", F.when(F.col("terms") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(1))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "audit-groups")
    size = groups.count()

    p, q = probability(F.col("n"), F.col("total"), F.col("terms")), probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    postings = materialize(kept.join(small_side(groups, size), ["lang", "source"]).select("lang", "gid", "term", F.expr(BUCKET).alias("bucket"), p.alias("p"), q.alias("q"), "p0", "sharing"), "audit-postings")

    names = groups.select("gid", "lang", "source")
    pairs = pair_sums(postings, groups).join(small_side(names, size), "gid").join(small_side(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), size), "other")
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("gid").orderBy(F.col("value").desc(), "item")))
    terms = top_terms(postings, k).withColumnRenamed("term", "item").join(small_side(names, size), "gid")
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return told(pairs, "pair").unionByName(told(terms, "term"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same from all terms of all groups, without buckets or postings.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
vl AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT d.lang, d.source, coalesce(any_value(vl.terms), 0) AS terms, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM d LEFT JOIN vl USING (lang) GROUP BY d.lang, d.source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.terms) AS BIGINT) AS p
  FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (v.n + 2)) // (vl.total + 2 * vl.terms) AS BIGINT) AS q FROM v JOIN vl USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
