"""Centroid clustering by sort-means: exact assignments with few distances, on integer vectors.

The centroids, and for each of them the others in the order of their distance from it, are sent to all tasks: k times k numbers. A
vector is first held against the centroid it had in the round before; others are scanned in that one's order, and the scan
stops at the first that is strictly further from it than twice the vector's distance, as neither that one nor any after it can be
nearer or tie. Each round writes the vectors with their centroids, and in the same files each task's sums of each
centroid, so that one pass makes a round and only sums of tasks are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: Centroids, rounds, components, scale; rows and other centroids of a scan's step.
CLUSTERS, ROUNDS, SIZE, SCALE, STEP_ROWS, STEP = 40, 5, 64, 256, 8192, 8
#: Components beyond this are set to it, so that squared distances fit into a long.
MOST = 1 << 27


def usable(vectors: DataFrame, column: str = "embedding", size: int = SIZE) -> DataFrame:
    """(vec_id, v) of the rows whose vector has exactly `size` components, none of them null or non-finite: integers floor(256 x)."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(column, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return vectors.where((F.size(column) == size) & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("v"))


class Scan:
    """The centroids of a round with, for each, all others by distance (squared) from it."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        gaps = self.far(centroids, np.arange(len(centroids)))
        np.fill_diagonal(gaps, -1)  # itself first
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def far(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of rows of x to some centroids, exact: by doubles where all sums stay under 2^53."""
        c = self.c[which]
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
        x, c = x.astype(kind), c.astype(kind)
        return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).astype(np.int64)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
        best, least, made = start.copy(), np.zeros(len(x), np.int64), 0
        for a in np.unique(start).tolist():
            rows = np.flatnonzero(start == a)
            for rows in (rows[i : i + STEP_ROWS] for i in range(0, len(rows), STEP_ROWS)):
                own = self.far(x[rows], np.array([a]))[:, 0]
                need = np.searchsorted(self.gaps[a], 4 * own, side="right")  # others at most twice as far from a
                least[rows], made = own, made + len(rows)
                for at in range(0, int(need.max(initial=0)), STEP):
                    live = rows[need > at]
                    which = self.order[a][at : at + STEP]
                    d = self.far(x[live], which)
                    made += d.size
                    near = d.min(axis=1)
                    number = np.where(d == near[:, None], which[None, :], len(self.c)).min(axis=1)
                    better = (near < least[live]) | (near == least[live]) & (number < best[live])
                    best[live[better]], least[live[better]] = number[better], near[better]
        return best, least, made


KIND = "vec_id long, v array<int>, cluster int, distance long, of int, n long, sums array<long>, inertia decimal(38,0)"


def _assign(rows: DataFrame, centroids: list[list[int]], with_vectors: bool) -> DataFrame:
    """Rows (vec_id, v, cluster) with the cluster of this round and distance; and for each task and cluster a row of of, n, sums and inertia."""
    held = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    names = ["vec_id", "v", "cluster", "distance", "of", "n", "sums", "inertia"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        scan, size = Scan(held.value), held.value.shape[1]
        k = len(scan.c)
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, size), np.int64), [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
            best, far, _ = scan.nearest(x, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            n += np.bincount(best, minlength=k)
            by = np.argsort(best, kind="stable")
            there, first = np.unique(best[by], return_index=True)
            sums[there] += np.add.reduceat(x[by], first, axis=0)
            for c, own in zip(there.tolist(), np.split(far[by], first[1:]), strict=True):
                inertia[c] += (int((own >> 31).sum()) << 31) + int((own & ((1 << 31) - 1)).sum())  # may not fit into a long
            vectors = b.column(1) if with_vectors else pa.nulls(b.num_rows, kinds[1])
            yield pa.RecordBatch.from_arrays([b.column(0), vectors, pa.array(best, pa.int32()), pa.array(far), *[pa.nulls(b.num_rows, t) for t in kinds[4:]]], names=names)
        some = np.flatnonzero(n)
        if len(some):
            told = [pa.array(some, kinds[4]), pa.array(n[some]), pa.array(sums[some].tolist(), kinds[6]), pa.array([Decimal(inertia[c]) for c in some], kinds[7])]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), t) for t in kinds[:4]], *told], names=names)

    return rows.mapInArrow(run, KIND)


def _sums(written: DataFrame, size: int) -> tuple[dict[int, int], dict[int, int], dict[int, list[int]]]:
    """Of each non-empty cluster its rows, inertia and sums of components: as many numbers as the centroids have."""
    parts = written.where("of is not null").select("of", "n", "inertia", "sums")
    whole = parts.groupBy("of").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(size)]).alias("sums")).collect()
    return {r["of"]: r["n"] for r in whole}, {r["of"]: int(r["inertia"]) for r in whole}, {r["of"]: [int(s) for s in r["sums"]] for r in whole}


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, column: str = "embedding", size: int = SIZE, seed: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector after `rounds` rounds.

    Centroids start as the k vectors with the smallest sha256 of seed and vec_id. Rows of one vec_id tie there and follow
    by their components; a null vec_id comes last. Each round assigns all vectors to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and moves each centroid that has vectors to their mean, rounded down; then
    vectors are assigned once more. All of it is exact in integers.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Repeated rows are vectors
    of their own. Fewer than k vectors: as many centroids. An empty table gives an empty result. Components of 2^19 and more
    (2^27 once scaled) count as that much. Extra columns are not read.
    """
    spark, scratch = vectors.sparkSession, []
    ranked = usable(vectors, column, size).withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    first = ranked.orderBy(F.col("_h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = [list(r["v"]) for r in first] or [[0] * size]
    rows = ranked.select("vec_id", "v", F.lit(0).alias("cluster"))
    for r in range(rounds + 1):
        written = materialize(_assign(rows, centroids, r < rounds), f"means-{r}")
        counts, inertia, sums = _sums(written, size)
        if r < rounds:
            centroids = [[s // counts[c] for s in sums[c]] if c in counts else old for c, old in enumerate(centroids)]
        if scratch:
            forget(scratch.pop())
        scratch.append(written)
        rows = written.where("of is null").select("vec_id", "v", "cluster")
    told = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(counts)]
    side = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return written.where("of is null").select("vec_id", "cluster", "distance").join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """All rounds written out, each holding every vector against every centroid."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * 256) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 40))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(CAST(list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) * 64 + c) AS best FROM v, c{i} k GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT a.best % 64 AS c, j, sum(v.x[j]) AS s, count(*) AS n FROM a{i} a JOIN v USING (r), unnest(range(1, 65)) t(j) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN m{i} m USING (c))")
    steps.append(f"e AS (SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, CAST(best // 64 AS BIGINT) AS distance FROM a{ROUNDS} JOIN v USING (r))")
    last = f"SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM e JOIN c{ROUNDS} k ON k.c = e.cluster"
    return "WITH " + ",\n".join(steps) + "\n" + last


OP13_SQL = _sql()
