"""Sharding by Karmarkar-Karp differencing, for balance of bytes with equal texts kept together.

A partial partition is a tuple of k sums. The two with the largest spread are combined, the largest sum of one with
the smallest of the other, until one is left. Groups of equal texts are summed first (a hot group is one row of
the sums, however many rows it has), dealt to cells of bounded size, and differenced in each cell; the cells' partial
partitions, k numbers each, are differenced in the same way: in cells of cells while they are many, at last on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, join_hot, local_ranks, materialize, small_side

SHARDS = 24
#: Groups in a cell, on average; partial partitions that are differenced at once.
CELL_GROUPS, CELLS = 20_000, 20_000


def difference(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each partial partition (k sums), the final place of each of its sums.

    Spread is compared, largest first, ties by the order in which the parts came or were made, so reruns agree.
    """
    if not parts:
        return []
    k = len(parts[0])
    heap, made = [], []
    for i, p in enumerate(parts):
        made.append((np.asarray(p, np.int64), None))
        heap.append((-int(p.max() - p.min()), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = made[a][0], made[b][0]
        up, down = np.argsort(x, kind="stable"), np.argsort(-y, kind="stable")
        total = np.empty(k, np.int64)
        total[:] = x[up] + y[down]
        made.append((total, (a, up, b, down)))
        heapq.heappush(heap, (-int(total.max() - total.min()), len(made) - 1))
    place: list[np.ndarray | None] = [None] * len(made)
    place[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        if made[i][1] is not None:
            a, up, b, down = made[i][1]
            place[a], place[b] = np.empty(k, np.int64), np.empty(k, np.int64)
            place[a][up], place[b][down] = place[i], place[i]
    return place[: len(parts)]


def difference_items(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of single sizes: (place of each, sums). A size starts as the partial partition (size, 0, ..., 0)."""
    tuples = np.zeros((len(sizes), k), np.int64)
    tuples[:, 0] = sizes
    place = np.array([f[0] for f in difference(list(tuples))], np.int64)
    return place, np.bincount(place, weights=sizes, minlength=k).astype(np.int64) if len(sizes) else np.zeros(k, np.int64)


def settle(sums: DataFrame, cells: int, most: int = CELLS) -> DataFrame:
    """(cell, places): for each cell's partial partition (cell from 0, sums) the final place of each of its sums."""
    spark = sums.sparkSession
    if cells <= most:
        rows = sums.select("cell", "sums").orderBy("cell").collect()
        found = difference([np.array(r["sums"], np.int64) for r in rows])
        return spark.createDataFrame([(r["cell"], f.tolist()) for r, f in zip(rows, found, strict=True)], "cell long, places array<int>")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        parts = [np.array(x, np.int64) for x in table.column("sums").to_pylist()]
        found = difference(parts)
        total = np.zeros(len(parts[0]), np.int64)
        for p, f in zip(parts, found, strict=True):
            np.add.at(total, f, p)
        n = table.num_rows
        return pa.table({"cell": table.column("cell"), "up": table.column("up"), "places": pa.array([f.tolist() for f in found], pa.list_(pa.int32())), "sums": pa.array([total.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))})

    above = -(-cells // most)
    dealt = sums.select("cell", "sums", F.pmod(F.col("cell"), F.lit(above)).alias("up"))
    held = materialize(dealt.groupBy("up").applyInArrow(run, "cell long, up long, places array<int>, sums array<long>"), "shard-cells")
    final = settle(held.where("sums is not null").select(F.col("up").alias("cell"), "sums"), above, most)
    both = held.select("cell", "up", "places").join(small_side(final.select(F.col("cell").alias("up"), F.col("places").alias("far"))), "up")
    return both.select("cell", F.transform("places", lambda p: F.get("far", p)).alias("places"))


def assign(docs: DataFrame, shards: int = SHARDS, cell_groups: int = CELL_GROUPS, most: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`; equal texts share a shard.

    Size: UTF-8 bytes of the text plus 8. Null text counts as, and goes with, empty text. Null doc_id and repeated
    rows are placed like any row. With fewer groups than shards some shards stay empty; a group larger than a shard's
    fair share fills one by itself. An empty table gives an empty result. Extra columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")), "shard-rows")
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    cells = int(max(1, -(-groups.count() // cell_groups)))
    tasks = min(cells, 20_000)
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)).cast("long")).repartition(tasks, "cell").sortWithinPartitions("cell", F.col("bytes").desc(), "grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            place, sums = difference_items(t.column("bytes").to_numpy(), shards)
            return pa.RecordBatch.from_arrays([t.column("grp").combine_chunks(), t.column("n").combine_chunks(), t.column("cell").combine_chunks(), pa.array(place.astype(np.int32)), pa.array([sums.tolist()] + [None] * (len(place) - 1), pa.list_(pa.int64()))], names=["grp", "n", "cell", "part", "sums"])

        for b in batches:
            t = pa.Table.from_batches([b])
            cell = t.column("cell").to_numpy()
            for lo, hi in zip(starts := np.flatnonzero(np.diff(cell, prepend=-1)), [*starts[1:], len(cell)], strict=True):
                if held and held[0].column("cell")[0].as_py() != cell[lo]:
                    yield close()
                    held = []
                held.append(t.slice(lo, hi - lo))
        if held:
            yield close()

    placed = materialize(dealt.select("grp", "n", "bytes", "cell").mapInArrow(run, "grp binary, n long, cell long, part int, sums array<long>"), "shard-parts")
    places = settle(placed.where("sums is not null").select("cell", "sums"), cells, most)
    shard_of = placed.select("grp", "n", "cell", "part").join(small_side(places), "cell").select("grp", "n", F.get("places", F.col("part")).alias("shard"))
    shard_of = materialize(shard_of, "shard-of")
    rows_in = join_hot(rows, shard_of, "grp", rows.count())
    staged = materialize(local_ranks(rows_in.select("doc_id", "size", "text_crc32", "shard"), "shard"), "shard-ranks")
    out = gapless(staged, "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
