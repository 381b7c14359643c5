"""Tables that are written once and read again: what is used more than once, or must outlive a lost executor."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table is kept in the driver and broadcast; a larger one is written and joined as Spark sees fit.
SMALL = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, one in the warehouse, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/gapwise-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared scratch folder and read it back, which cuts its lineage.

    A lost executor costs only the tasks that were running: the table outlives it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def pinned(df: DataFrame, name: str, limit: int = SMALL) -> tuple[DataFrame, bool]:
    """df computed once, and whether it is small: at most `limit` rows come to the driver, more are written."""
    free = T.StructType.fromJson(json.loads(df.schema.json().replace('"nullable":false', '"nullable":true')))
    df = df.to(free)  # Arrow takes no null struct whose fields may not be null
    head = df.limit(limit + 1).toArrow()
    if head.num_rows > limit:
        return materialize(df, name), False
    return df.sparkSession.createDataFrame(head, df.schema), True


def small_side(table: DataFrame, small: bool) -> DataFrame:
    """Mark what pinned gives for broadcast if it is small."""
    return F.broadcast(table) if small else table


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
