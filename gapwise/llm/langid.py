"""Language ID: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log-probabilities (languages x buckets), whose size is fixed by its parameters; it is
broadcast, and every batch of texts is scored in numpy by gathering the columns of the n-grams that occur. All languages
have the same prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, extend, least_hashed, pieces

#: Sizes of the model: bits of hash buckets, longest n-gram, bits of cells (languages times buckets) at most. More
#: languages than fit have fewer buckets each.
BUCKET_BITS, MAX_N, CELL_BITS = 16, 4, 24
#: Training takes so many distinct texts of a language at most, those of the least hashes.
TRAIN_DOCS = 4000
#: Floors of the mean log-likelihood an n-gram: the median of a language's training documents, each scored without its own
#: counts, less SPREADS times the distance to their QUANTILE, less SLACK over the root of the text's n-grams. Of a language
#: CALIBRATE_DOCS are scored at most; with under LEAST_DOCS it has no floor.
SPREADS, QUANTILE, SLACK, CALIBRATE_DOCS, LEAST_DOCS = 5.0, 0.01, 10.0, 1000, 20
UNKNOWN = "und"

_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    """Which code points under 65536 are letters; higher ones count as letters."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(i).isalpha() for i in range(65535)] + [True])
    return _LETTER


def bucket_bits(langs: int) -> int:
    return max(0, min(BUCKET_BITS, CELL_BITS - max(langs - 1, 0).bit_length()))


def ngrams(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of 2 ** bits) of all 1..MAX_N-grams of whole lower-cased texts, runs of other characters read as one blank; the text of each."""
    low = [f" {t} ".lower() for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = _letters()[np.minimum(cp, 65535)]
    keep = letter | np.concatenate([[True], letter[:-1]]) if len(cp) else letter
    keep[np.cumsum([0, *map(len, low)])[:-1]] = True  # each text's leading blank, wherever it lies among others
    cp, doc = np.where(letter, cp, 32).astype(np.uint32)[keep], doc[keep]
    buckets, docs, h = [], [], cp * np.uint32(0x9E3779B1)
    for n in range(1, MAX_N + 1):
        if n > 1:
            if len(cp) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        buckets.append((mixed[whole] >> np.uint32(16) >> np.uint32(16 - bits)).astype(np.int32))
        docs.append(doc[n - 1 :][whole])
    return np.concatenate(buckets or [np.zeros(0, np.int32)]), np.concatenate(docs or [np.zeros(0, np.int32)])


def counts(labelled: DataFrame, text: str = "text", label: str = "lang", docs_per_label: int = TRAIN_DOCS, alpha: float = 0.5) -> tuple[list[str], np.ndarray, DataFrame | None]:
    """(languages, n-gram counts plus alpha, the sample that was counted) of labelled rows; rows without text or label are left out.

    The sample (t, l, and _h, the text's hash) has the docs_per_label distinct texts of the least hashes of each language.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(label).alias("l")).where("t is not null and l is not null")
    langs = [r["l"] for r in rows.select("l").distinct().orderBy("l").collect()]  # one row for each language
    if not langs:
        return [], np.zeros((0, 1 << BUCKET_BITS)), None
    bits = bucket_bits(len(langs))
    picked = least_hashed(rows, "t", docs_per_label, "l")
    index = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) << bits, np.int64)
        for b in batches:
            labels = np.array([index[x] for x in b.column(1).to_pylist()], np.int64)
            for at, held in pieces(b.column(0).to_pylist()):
                bucket, doc = ngrams(held, bits)
                total += np.bincount((labels[at + doc] << bits) + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = picked.select("t", "l").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(len(langs) << bits, alpha)
    table[cells["cell"].to_numpy(np.int64)] += cells["n"].to_numpy(np.float64)
    return langs, table.reshape(len(langs), -1), picked


def logs(table: np.ndarray) -> np.ndarray:
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def train(labelled: DataFrame, text: str = "text", label: str = "lang", docs_per_label: int = TRAIN_DOCS, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) from a bounded sample of labelled rows; rows without text or label are left out."""
    langs, table, _ = counts(labelled, text, label, docs_per_label, alpha)
    return langs, logs(table)


def floors(langs: list[str], table: np.ndarray, picked: DataFrame, docs_per_label: int = CALIBRATE_DOCS) -> np.ndarray:
    """For each language the least mean log-likelihood an n-gram of a long text, from counts and their sample; -inf: none."""
    index = {name: i for i, name in enumerate(langs)}
    held, bits = picked.sparkSession.sparkContext.broadcast(table), bucket_bits(len(langs))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        table, out = held.value, []
        sums = table.sum(axis=1)
        for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            bucket, _ = ngrams([t], bits)
            at, place, own = np.unique(bucket, return_inverse=True, return_counts=True)
            left = (table[index[l]][at] - own)[place]
            out.append(float(np.log(left / (sums[index[l]] - len(bucket))).mean()) if any(map(str.isalpha, t)) else None)
        return pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.float64())], names=["l", "fit"])

    rank = F.row_number().over(W.partitionBy("l").orderBy("_h"))
    own = picked.withColumn("_r", rank).where(F.col("_r") <= docs_per_label)
    found = arrow_map(own.select("t", "l"), score, "l string, fit double").where("fit is not null").groupBy("l").agg(F.count("*").alias("n"), F.percentile("fit", [0.5, QUANTILE]).alias("q")).collect()
    out = np.full(len(langs), -np.inf)
    for r in found:
        if r["n"] >= LEAST_DOCS:
            out[index[r["l"]]] = r["q"][0] - SPREADS * (r["q"][0] - r["q"][1])
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", least: np.ndarray | None = None) -> DataFrame:
    """docs with lang_pred and score (the posterior of that language, 0 to 1; 0.0 for `und`).

    `und`: null text, text without a letter, or a model without languages; with `least` (see floors) also text that the
    likeliest language explains worse than its floor. Rows and other columns are kept as they are (columns called
    lang_pred or score are replaced); the text is the only input of the prediction. Null ids and repeated rows are like
    any row; an empty table gives an empty result.
    """
    langs, table = model
    docs, bits = docs.drop("lang_pred", "score"), bucket_bits(len(langs))
    held = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(table)))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, table = held.value
        texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at, part in pieces(texts):
            has = [any(map(str.isalpha, t)) for t in part]
            if not langs or not any(has):
                continue
            bucket, doc = ngrams(part, bits)
            sums = np.stack([np.bincount(doc, weights=table[k][bucket], minlength=len(part)) for k in range(len(langs))])
            best = sums.argmax(axis=0)
            post = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
            if least is not None:
                n = np.maximum(np.bincount(doc, minlength=len(part)), 1)
                has = has & (sums.max(axis=0) / n >= least[best] - SLACK / np.sqrt(n))
            for i in np.flatnonzero(has):
                names[at + i], scores[at + i] = langs[best[i]], post[i]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(names), pa.array(scores)], names=[*b.schema.names, "lang_pred", "score"])

    return arrow_map(docs, score, extend(docs, lang_pred="string", score="double"))


def fold(doc_id: Column) -> Column:
    """Whether a document is held out of training: crc32 of its id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score, by a model of the labelled documents that are not held out.

    Columns of these names are replaced, all others stay. A null doc_id is not held out; repeated rows are like any row.
    Null text, and text without a letter, is `und`, and so is every text if no row is labelled. An empty table gives an
    empty result.
    """
    model = train(docs.where(~fold(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", fold(F.col("doc_id"))), model)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
