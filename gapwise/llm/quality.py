"""Quality rules with suffix-array repetition.

The words of a batch of texts form one sequence of numbers. Its suffix array (prefix doubling, with the text's number
as the first key, so that suffixes of different texts never tie) and the common prefixes of neighbours in it give,
at each place, the longest passage from there that the same text holds once more: intervals of the suffix array with a
common prefix are the maximal repeated passages, and the deepest one that holds a suffix has the larger of the prefixes it shares with its two
neighbours. The passages' spans are unioned, and the covered fraction and the longest are limited.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces
from .simhash import words

#: Base rules (fixed values of the contract): fewest words; most words, in percent, within repeated windows of three.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50
#: The method's limits: repeats of fewer words don't count; covered words in percent; longest repeat in percent of the words.
#: The base rule fails over half of the words in repeats, so the second is well under that; a passage and its repeat cover
#: twice its words, so the last is under half of the second, or it would decide nothing.
MIN_PASSAGE, MAX_COVERED_PERCENT, MAX_LONGEST_PERCENT = 8, 30, 14
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def common_prefixes(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it), prefixes ending with the text.

    tokens: small numbers; doc: the number of the text of each place, ascending.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(doc, doc, side="right")  # where the text of each place ends
    key = doc.astype(np.int64) * (int(tokens.max()) + 2) + tokens + 1
    order = np.argsort(key, kind="stable")
    step, ranks = 1, []
    while True:
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # all of them are kept
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        if new.all():
            break
        after = np.zeros(n, np.int64)
        has = np.arange(n) + step < ends
        after[has] = rank[np.flatnonzero(has) + step]
        key = rank.astype(np.int64) * (n + 1) + after
        # Only places whose rank is still shared need sorting anew; they keep their part of the order.
        tied = ~new | ~np.concatenate([new[1:], [True]])
        at = np.flatnonzero(tied)
        order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
        step *= 2
    prefix = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.flatnonzero(doc[a] == doc[b])
    # Doubling's ranks say whether 2^k tokens agree: the common prefix is their binary expansion.
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a[live], b[live]
        fits = (x + (1 << k) <= ends[x]) & (y + (1 << k) <= ends[y])
        same = np.zeros(len(live), bool)
        same[fits] = ranks[k][x[fits]] == ranks[k][y[fits]]
        move = live[same]
        prefix[move + 1] += 1 << k
        a[move] += 1 << k
        b[move] += 1 << k
        inside = (a[live] < n) & (b[live] < n)
        live = live[inside]
        live = live[(doc[a[live]] == doc[order[live]]) & (doc[b[live]] == doc[order[live]])]
    return order, prefix


def repeats(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """At each place the length of the longest passage beginning there that the same text holds elsewhere too."""
    order, prefix = common_prefixes(tokens, doc)
    longest = np.zeros(len(tokens), np.int64)
    longest[order] = np.maximum(prefix, np.append(prefix[1:], 0))
    return longest


def covered(longest: np.ndarray, least: int, fixed: int | None = None) -> np.ndarray:
    """Places within a passage of at least `least` that repeats (of which `fixed` tokens count, if given)."""
    n = len(longest)
    begin = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + (fixed if fixed else longest[begin]), -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of whole texts, one entry for each."""
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    ids: dict[str, int] = {}
    tokens = np.fromiter((ids.setdefault(w, len(ids)) for own in split for w in own), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    longest = repeats(tokens, doc)
    count = lambda mask: np.bincount(doc[mask], minlength=len(texts)).astype(np.int64)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    lines = []
    for t in texts:
        own = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": n,
        "word_chars": np.array([sum(map(len, w)) for w in split], np.int64),
        "n_symbols": np.array([len(_SYMBOLS.findall(t)) for t in texts], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": count(covered(longest, WINDOW, WINDOW)),
        "n_covered": count(covered(longest, MIN_PASSAGE)),
        "longest_repeat": most,
    }


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_covered, longest_repeat).

    kept: the base rules hold, and of the words at most MAX_COVERED_PERCENT lie in repeated passages and at most
    MAX_LONGEST_PERCENT in the longest one. Null text counts as empty: no words, base_failed. Null doc_id and
    repeated rows are judged like any row. An empty table gives an empty result. Extra columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(part) for _, part in pieces([t or "" for t in b.column(1).to_pylist()])]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate([f[k] for f in found])) for k in names)], names=["doc_id", *names])

    counts = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{k} long" for k in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= MAX_COVERED_PERCENT * F.col("n_words")) & (100 * F.col("longest_repeat") <= MAX_LONGEST_PERCENT * F.col("n_words"))
    out = counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
    return out.select("doc_id", *names[:5], "base_failed", "kept", "n_covered", "longest_repeat")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("longest_repeat")


#: The same by counting windows. Words in repeated passages of 8 or more are those in repeated windows of 8. The longest
#: passage is 7 more than the longest run of successive equal windows that lie equally far apart; it is only looked for
#: where the other rules hold, as only there it can change the verdict.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s),
g AS (SELECT r, w, i, lead(i, 2) OVER o AS i3, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o) AS g3, lead(i, 7) OVER o AS i8,
        concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS g8
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, g8, i8 IS NOT NULL AND count(i8) OVER (PARTITION BY r, g8) > 1 AS two8,
        i3 IS NOT NULL AND count(i3) OVER (PARTITION BY r, g3) > 1 AS two3 FROM g),
m AS (SELECT r, w, bool_or(two3) OVER (PARTITION BY r ORDER BY i ROWS 2 PRECEDING) AS in3, bool_or(two8) OVER (PARTITION BY r ORDER BY i ROWS 7 PRECEDING) AS in8 FROM c),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (in3) AS n_repeat_words, count(*) FILTER (in8) AS n_covered FROM m GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.r, d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_covered, 0) AS BIGINT) AS n_covered,
        coalesce(n_words < 50 OR 100 * n_repeat_words > 50 * n_words, true) AS base_failed
      FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)),
h AS (SELECT c.r, c.i, c.g8 FROM c JOIN f USING (r) WHERE two8 AND NOT base_failed AND 100 * n_covered <= 30 * n_words),
p AS (SELECT a.r, a.i, b.i - a.i AS far, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS run
      FROM h a JOIN h b ON a.r = b.r AND a.g8 = b.g8 AND a.i < b.i),
x AS (SELECT r, max(n) + 7 AS longest FROM (SELECT r, count(*) AS n FROM p GROUP BY r, far, run) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_covered <= 30 * n_words AND 100 * coalesce(longest, 0) <= 14 * n_words AS kept, n_covered
FROM f LEFT JOIN x USING (r)
"""
