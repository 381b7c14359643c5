"""Helpers that the training-data operators share: scratch tables, size-checked joins, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side of a join is broadcast; beyond it Spark's own shuffled join runs.
BROADCAST_ROWS = 200_000
#: Rows that a key may have before a join by that key finds it in a broadcast table.
HOT_ROWS = 64


#: Rows of an Arrow batch at most.
ARROW_ROWS = 2000
#: Bytes of row bitmaps that are broadcast at once; more go in rounds of files.
BITMAP_BYTES = 64 << 20
#: Rows of one bitmap (bitmap_construct_agg's size).
BITMAP_ROWS = 1 << 15


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, one in the warehouse, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/gapwise-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared scratch folder and read it back, which cuts its lineage.

    A lost executor costs only the tasks that were running: the table outlives it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: all that came of them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result that reads them is needed."""
    _delete(spark, scratch_dir(spark))


def on_file(docs: DataFrame) -> DataFrame:
    """docs if its rows are read from files as they are, so that each has a place (file and row index), else a written copy."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return materialize(docs, "on-file")
    return docs


def placed(docs: DataFrame) -> DataFrame:
    """docs (see on_file) with file and row, where each row lies."""
    return docs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def where_marked(docs: DataFrame, marks: DataFrame, keep: bool, limit: int = BITMAP_BYTES) -> DataFrame:
    """The rows of docs (see on_file) whose place (file, row) is in marks, or with keep=False those whose place is not.

    Nothing of docs is moved: marks become bitmaps, one bit for each row of a file with a mark, that are broadcast to the
    scan. Over `limit` bytes of them the files are dealt to rounds by hash, each with a scan of its own files alone.
    """
    bits = marks.groupBy("file", F.shiftright("row", 15).alias("part")).agg(F.expr(f"bitmap_construct_agg(row & {BITMAP_ROWS - 1})").alias("bits"))
    bits = materialize(bits, "row-bitmaps")
    rounds = -(-bits.count() * BITMAP_ROWS // 8 // limit) or 1
    names = [c for c in docs.columns]
    out = None
    for r in range(rounds):
        turn = lambda file: F.pmod(F.xxhash64(file), F.lit(rounds)) == r  # noqa: B023, E731
        own = docs.where(turn(F.col("_metadata.file_path"))) if rounds > 1 else docs
        own = own.select(*[F.col(c) for c in names], F.col("_metadata.file_path").alias("_file"), F.shiftright(F.col("_metadata.row_index"), 15).alias("_part"), F.col("_metadata.row_index").bitwiseAND(BITMAP_ROWS - 1).alias("_bit"))
        held = (bits.where(turn(F.col("file"))) if rounds > 1 else bits).select(F.col("file").alias("_file"), F.col("part").alias("_part"), F.col("bits").alias("_bits"))
        at = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(_bit & 7 as int))")
        marked = F.coalesce(at != 0, F.lit(False))
        own = own.join(F.broadcast(held), ["_file", "_part"], "left").where(marked if keep else ~marked).select(*names)
        out = own if out is None else out.unionByName(own)
    return out


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most `limit` rows, else leave the choice of join to Spark."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with side, which has each key once with n, its number of rows; no task gets all rows of a hot key.

    Of `total` rows' keys fewer than BROADCAST_ROWS can have more than total / BROADCAST_ROWS rows: these are broadcast,
    the rest is joined as Spark sees fit. Null keys match nothing.
    """
    hot = max(HOT_ROWS, total // BROADCAST_ROWS + 1)
    columns = [c for c in side.columns if c not in (key, "n")]
    found = F.struct(*columns).alias("_side") if columns else F.struct(F.lit(0)).alias("_side")
    marked = rows.join(F.broadcast(side.where(F.col("n") > hot).select(key, found)), key, "left")
    own = [c for c in rows.columns if c != key]
    out = [F.col(key), *own, *[F.col(f"_side.{c}").alias(c) for c in columns]]
    rest = marked.where("_side is null").drop("_side").join(side.where(F.col("n") <= hot).select(key, found), key)
    return marked.where("_side is not null").select(*out).unionByName(rest.select(*out))


def least_hashed(rows: DataFrame, text: str, n: int, by: str | None = None) -> DataFrame:
    """One row for each of the n distinct texts of the least 63-bit hashes, or of the n of each value of `by`, with _h, the hash.

    A bounded sample of any table: copies of a text are one, and n are taken wherever there are as many. One number for each
    distinct text is shuffled, no text. Null texts take no part.
    """
    keys = [by] if by else []
    hashed = rows.where(F.col(text).isNotNull()).withColumn("_h", F.shiftrightunsigned(F.xxhash64(text), 1))
    distinct = hashed.select(*keys, "_h").distinct()
    if not by:
        cut = distinct.orderBy("_h").limit(n).agg(F.max("_h").alias("c")).first()["c"]
        return hashed.where(F.col("_h") <= F.lit(cut).cast("long")).dropDuplicates(["_h"])
    rank = F.row_number().over(W.partitionBy(by).orderBy("_h"))
    cuts = distinct.withColumn("_r", rank).where(F.col("_r") <= n).groupBy(by).agg(F.max("_h").alias("_cut"))
    return hashed.join(small_side(materialize(cuts, "sample-cuts")), by).where(F.col("_h") <= F.col("_cut")).drop("_cut").dropDuplicates([by, "_h"])


def word_count(text: Column) -> Column:
    """Number of words in text; null: 0."""
    return F.coalesce(F.size(F.split(text, WORD, -1)) - 1, F.lit(0)).cast("long")


def local_ranks(df: DataFrame, key: str) -> DataFrame:
    """Add pid (the task) and lrank (rows of the same small integer key before this one in the task)."""
    schema = T.StructType(df.schema.fields + [T.StructField("pid", T.IntegerType()), T.StructField("lrank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank, seen = running_ranks(k, seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(k), pid, np.int32)), pa.array(rank)], names=[*b.schema.names, "pid", "lrank"])

    return df.mapInArrow(number, schema)


def running_ranks(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of keys (small integers from 0) given the counts seen so far; the new counts."""
    if len(keys) and keys.max() >= len(seen):
        seen = np.concatenate([seen, np.zeros(int(keys.max()) + 1 - len(seen), np.int64)])
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - begin
    rank += seen[keys]
    return rank, seen + np.bincount(keys, minlength=len(seen))


def gapless(staged: DataFrame, key: str, name: str) -> DataFrame:
    """Turn pid and lrank of a written table into `name`: 0, 1, 2 ... within each key, over all tasks.

    Only the counts of each task and key are dealt by key, never the rows.
    """
    w = W.partitionBy(key).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    counts = staged.groupBy(key, "pid").agg((F.max("lrank") + 1).alias("n"))
    base = materialize(counts.select(key, "pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")), "bases")
    return staged.join(small_side(base), [key, "pid"]).withColumn(name, F.col("base") + F.col("lrank")).drop("base", "pid", "lrank")


def extend(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with more columns, by name and type."""
    return T.StructType(df.schema.fields + [T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def pieces(texts: list[str], chars: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters in all, so that a batch's arrays stay small; a text is never cut."""
    at, held, n = 0, [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield at, held
            at, held, n = at + len(held), [], 0
    if held:
        yield at, held


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that Python workers can import it anywhere.

    Batches to Python are made of ARROW_ROWS rows at most, as texts may be long.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    done = getattr(spark.sparkContext, "_gapwise_shipped", False)
    if not done:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="gapwise-")) / "gapwise.zip"  # the driver's own; Spark's file server sends it on
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        spark.sparkContext._gapwise_shipped = True
    return spark
