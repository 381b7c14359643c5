"""Random intervals and shuffles. Numbers come from hashes of (seed, row), so that reruns and retries agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .islands import merge
from .scan import around

#: Tries for a place before it is an error; rows of the genome and of merged exclusions that are sent to all tasks at most.
TRIES, MOST = 10_000, 2_000_000


def random_intervals(spark: SparkSession, genome: DataFrame, n: int, length: int = 1000, seed: int = 42) -> DataFrame:
    """n intervals at uniform places of the genome laid end to end: ord, chrom, start, stop. The end may lie beyond the chromosome's."""
    cum = genome.select("chrom", "size", F.coalesce(F.sum("size").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    total = genome.agg(F.sum("size").alias("s")).first()["s"] or 0
    if total <= length:
        raise ValueError("the genome is no longer than an interval")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")  # 60 bits
    q = spark.range(n).select(F.lit("*").alias("chrom"), F.col("id").alias("ord"), (number % (total - length)).alias("p"))
    v = cum.where("size > 0").select(F.lit("*").alias("chrom"), "at", F.col("chrom").alias("c"))
    placed = around(q, F.col("p"), v, (F.col("at"), F.struct("at", "c")))
    start = F.col("p") - F.col("left.at")
    return placed.select("ord", F.col("left.c").alias("chrom"), start.alias("start"), (start + length).alias("stop"))


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for odd, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def shuffle(df: DataFrame, genome: DataFrame, seed: int = 42, exclude: DataFrame | None = None, same_chrom: bool = False) -> DataFrame:
    """df (unique ord) with each row at a random place of its own length, within a chromosome and apart from exclusions.

    All places in all chromosomes are equally likely; same_chrom keeps each row's own. Numbers come from a hash of the seed,
    ord and the try. No place after TRIES tries is an error. The genome and merged exclusions are sent to all tasks; more
    than MOST rows are an error.
    """
    sizes = genome.select("chrom", "size").orderBy("ord").limit(MOST + 1).collect()
    held = merge(exclude).orderBy("chrom", "start").limit(MOST + 1).collect() if exclude is not None else []
    if max(len(sizes), len(held)) > MOST:
        raise ValueError("genome or exclusions are too large to send to all tasks")
    names, size = [r["chrom"] for r in sizes], np.array([r["size"] for r in sizes], np.int64)
    index = {c: i for i, c in enumerate(names)}
    line = np.concatenate([[0], np.cumsum(size + 1)])  # chromosomes laid end to end, one place more in each than bases
    # Exclusions on that line, in order and apart, so that one search finds the next one.
    blocked = np.array(sorted((line[index[r["chrom"]]] + r["start"], line[index[r["chrom"]]] + r["stop"]) for r in held if r["chrom"] in index), np.int64).reshape(-1, 2)
    shared = df.sparkSession.sparkContext.broadcast((names, size, line, blocked))
    at = [df.columns.index(c) for c in ("chrom", "start", "stop", "ord")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, size, line, blocked = shared.value
        index = {c: i for i, c in enumerate(names)}
        for b in batches:
            if not b.num_rows:
                continue
            start, stop, order = (b.column(i).to_numpy().astype(np.int64) for i in at[1:])
            n = np.maximum(stop - start, 0)
            own = np.array([index.get(c, -1) for c in b.column(at[0]).to_pylist()]) if same_chrom else None
            chrom, place = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            most = np.where(own >= 0, size[own], -1) if same_chrom else np.full(len(n), size.max() if len(size) else -1)
            if (n > most).any():
                raise ValueError(f"no chromosome has room for row {order[np.flatnonzero(n > most)[0]]}")
            left = np.arange(len(n))
            for k in range(TRIES):
                draw = _hash(order[left].astype(np.uint64) * np.uint64(TRIES) + np.uint64(k), seed)
                if same_chrom:
                    c = own[left]
                    s = (draw % (size[c] - n[left] + 1).astype(np.uint64)).astype(np.int64)
                else:
                    p = (draw % np.uint64(line[-1])).astype(np.int64)
                    c = np.searchsorted(line, p, side="right") - 1
                    s = p - line[c]
                fits = s + n[left] <= size[c]
                if len(blocked):
                    j = np.searchsorted(blocked[:, 1], line[c] + s, side="right")
                    free = (j == len(blocked)) | (blocked[np.minimum(j, len(blocked) - 1), 0] >= line[c] + s + n[left])
                    fits &= free
                chrom[left[fits]], place[left[fits]] = c[fits], s[fits]
                left = left[~fits]
                if not len(left):
                    break
            else:
                raise ValueError(f"no place found for row {order[left[0]]}")
            new = {at[0]: pa.array([names[c] for c in chrom], pa.string()), at[1]: pa.array(place), at[2]: pa.array(place + n)}
            yield pa.RecordBatch.from_arrays([new.get(i, b.column(i)) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
