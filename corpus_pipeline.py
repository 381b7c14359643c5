"""A training corpus in five stages: language ID, near-dedup, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import langid, mixing, packing, secrets, simhash
from gapwise.llm.common import materialize, ship

#: Pieces and words that a worker's encoder keeps at most: workers live through all stages, beside an executor that has run them.
PACK_CACHES = 50_000, 200_000
#: Bytes of a batch to Python, about: the shingle sets of 2000 pairs are far more than 2000 texts.
BATCH_BYTES = 4 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language of the labelled ones: those that the likeliest language explains worse than its floor.

    Null text and text without a letter go too. Without labelled documents nothing else is dropped; a language of too
    few documents for a floor drops none. Others stay as they are, null doc_ids and repeated rows among them. An empty
    table gives an empty result.
    """
    rows = docs.select(*COLUMNS)
    langs, table, picked = langid.counts(rows.where(~langid.fold(F.col("doc_id"))))
    if not langs:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    told = langid.predict(rows, (langs, langid.logs(table)), least=langid.floors(langs, table, picked))
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (null counts as 0; of rows equal in it, the first).

    Near-duplicates are SimHash partners that share 0.8 of their 5-word shingles, counted exactly; a group is what such
    links connect. Texts without words, null ones too, are one group. Other columns stay as they are. An empty table
    gives an empty result.
    """
    return simhash.drop_similar(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by a mark; documents without one stay as they are, null texts, null doc_ids and repeated rows too.

    n_chars of a changed text is its new length. An empty table gives an empty result.
    """
    rows = docs.select(*COLUMNS)
    model = secrets.train(secrets.corpus_samples(rows))
    out = secrets.redact(rows.withColumn("was", F.col("text")), model)
    changed = ~F.col("text").eqNullSafe(F.col("was"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the target weights say: never, once or twice; one without words (or null text) once.

    Null doc_id and repeated rows: as any row. A null source is a source. An empty table gives an empty result. The
    thresholds of each source are applied to the rows where they lie.
    """
    rows = mixing.measured(docs.select(*COLUMNS))
    narrow = materialize(rows.select("source", "_key", "_size", "_h"), "mix-rows")
    times = F.greatest(F.col("_copies"), (F.col("_size") == 0).cast("long")).cast("int")
    taken = mixing.take(rows, mixing.plan(narrow)).withColumn("_times", times).where("_times > 0")
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of at most 1024: one row for each piece (see packing.pack).

    Null text: as empty, one piece with the end token. Null doc_id and repeated rows: packed like any row. An empty
    table gives an empty result.
    """
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), caches=PACK_CACHES)


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(ship(spark), docs, sf_dir)

    return run


STAGES = [("language", _shipped(language)), ("near_dedup", _shipped(near_dedup)), ("secret_scan", _shipped(secret_scan)), ("mix", _shipped(mix)), ("pack", _shipped(pack))]
#: The stages' models and token ids can't be had in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
