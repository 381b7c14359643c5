"""Exact top-k by inner product with an M-tree, searched best-first.

Rows are dealt to the nearest of some pivots, a bounded sample of themselves, and so to pages of a bounded number of rows.
A page is an M-tree: it is built once, where its rows meet, and kept with its centre and covering radius; its own queries are
searched there, which gives each query a first k-th best score. By q.x <= q.c + |q| r for a pivot c whose pages' rows are within r of it,
a query then goes only to the pages of those pivots that could pass that score. Pivots and their radii, PIVOTS at most, are all that
is sent to every task; pairs of query and pivot are numbers, and a page goes once to each block of BLOCK queries that visit it.

In a tree, inner products become distances by one more component: with x' = (x, sqrt(M - |x|^2)) and q' = (q, 0), where M is the
largest |x|^2 of the page, |q' - x'|^2 = |q|^2 + M - 2 q.x, so that the nearest x' has the highest q.x. The tree is
metric: a routing object and a covering radius for each node, and for each entry its distance to the node's routing
object. Nodes are visited in the order of their lower bounds, until the k-th best score so far cannot be passed; entries whose
stored distance to the routing object rules them out are never compared. Scores are exact integers; bounds are slackened
against rounding, so that they never cost a result. Where vectors are near no others (many dimensions, no clusters), bounds
rule out little, and the work is that of comparing all queries with all rows, in blocks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, materialize, small_side

K, SCALE, EVERY = 5, 256, 50
#: Rows of a page (one tree) in the mean, pivots at most (beyond, pages of a pivot are several), entries of a node, queries of a block.
PAGE_ROWS, PIVOTS, NODE, BLOCK = 8192, 20_000, 256, 4096
#: Pairs of a query and a page whose bounds are held at once.
VISIT_CELLS = 1 << 18
SLACK = 1e-6


class MTree:
    """A two-level M-tree, built in bulk: leaves of at most NODE entries around routing objects, under one root page."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, node: int = NODE):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x = ids[order], rows[order], vectors[order]
        norm = np.einsum("ij,ij->i", self.x, self.x)
        self.top = float(norm.max()) if len(norm) else 0.0
        full = np.column_stack([self.x, np.sqrt(np.maximum(self.top - norm, 0))])
        self.leaves: list[np.ndarray] = []
        self._split(full, np.arange(len(ids)), node)
        self.route = np.array([full[own[0]] for own in self.leaves])
        self.to_parent = [np.sqrt(np.maximum(((full[own] - r) ** 2).sum(axis=1), 0)) for own, r in zip(self.leaves, self.route, strict=True)]
        self.radius = np.array([d.max() for d in self.to_parent])
        for i, d in enumerate(self.to_parent):  # entries by their distance to the routing object
            by = np.argsort(d, kind="stable")
            self.leaves[i], self.to_parent[i] = self.leaves[i][by], d[by]

    def _split(self, full: np.ndarray, own: np.ndarray, node: int) -> None:
        """Halve by distance to two far objects until a node's entries fit."""
        todo = [own] if len(own) else []
        while todo:
            own = todo.pop()
            if len(own) <= node:
                self.leaves.append(own)
                continue
            far = own[np.argmax(((full[own] - full[own[0]]) ** 2).sum(axis=1))]
            a = ((full[own] - full[far]) ** 2).sum(axis=1)
            b = ((full[own] - full[own[np.argmax(a)]]) ** 2).sum(axis=1)
            by = np.argsort(a - b, kind="stable")
            todo += [own[by[: len(own) // 2]], own[by[len(own) // 2 :]]]

    def dump(self) -> bytes:
        out = io.BytesIO()
        sizes = np.array([len(own) for own in self.leaves], np.int64)
        np.savez(out, ids=self.ids, rows=self.rows, x=self.x, top=self.top, route=self.route, radius=self.radius, sizes=sizes, entries=np.concatenate(self.leaves), far=np.concatenate(self.to_parent))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        held, tree = np.load(io.BytesIO(data)), cls.__new__(cls)
        tree.ids, tree.rows, tree.x, tree.top, tree.route, tree.radius = held["ids"], held["rows"], held["x"], float(held["top"]), held["route"], held["radius"]
        cuts = np.cumsum(held["sizes"])[:-1]
        tree.leaves, tree.to_parent = np.split(held["entries"], cuts), np.split(held["far"], cuts)
        return tree

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector id, score) of each query's k best here, its own row left out; with least only scores of at least that."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        norm = np.einsum("ij,ij->i", queries, queries)
        flat = np.column_stack([queries, np.zeros(len(queries))])
        gap = (flat**2).sum(axis=1)[:, None] + (self.route**2).sum(axis=1)[None, :] - 2 * flat @ self.route.T
        gap = np.sqrt(np.maximum(gap, 0))
        bound = np.maximum(gap - self.radius[None, :], 0)
        reach_of = lambda i, score: np.sqrt(max(norm[i] + self.top - 2 * score, 0)) * (1 + SLACK) + SLACK * (1 + np.sqrt(norm[i] + self.top))
        for i, (row, q) in enumerate(zip(query_rows, queries, strict=True)):
            best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
            reach = reach_of(i, least[i]) if least is not None else np.inf  # distance that the k-th best has; nothing further can pass it
            for leaf in np.argsort(bound[i], kind="stable"):
                if bound[i, leaf] > reach:
                    break
                d = self.to_parent[leaf]
                lo, hi = (0, len(d)) if reach == np.inf else (np.searchsorted(d, gap[i, leaf] - reach), np.searchsorted(d, gap[i, leaf] + reach, side="right"))
                own = self.leaves[leaf][lo:hi]
                own = own[self.rows[own] != row]
                if not len(own):
                    continue
                score = self.x[own] @ q
                if least is not None:
                    own, score = own[score >= least[i]], score[score >= least[i]]
                best_score = np.concatenate([best_score, score])
                best_id = np.concatenate([best_id, self.ids[own]])
                keep = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[keep], best_id[keep]
                if len(keep) == k:
                    reach = min(reach, reach_of(i, best_score[-1]))
            out.append((np.full(len(best_id), row), best_id, best_score.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): components times SCALE, rounded down; rows with a null or non-finite component are left out."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull()
    return vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def in_pages(rows: DataFrame, page_rows: int) -> tuple[DataFrame, Broadcast]:
    """rows (row, vec_id, v) with pivot, the nearest among those of their length, and page, one of the pivot's; and what is known of
    the pivots of each length (vectors, number of the first, pages of each), PIVOTS at most.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # one row for each length
    pivots, first, parts = {}, {}, {}
    base = 0
    for r in sizes:
        want = max(1, -(-r["n"] // page_rows))
        few = min(want, PIVOTS)
        picked = rows.where(F.size("v") == r["d"]).orderBy(F.xxhash64("row"), "row").limit(few).select("v").toArrow()
        pivots[r["d"]] = _matrix(picked.column("v"), picked.num_rows) if r["d"] else np.zeros((few, 0))
        first[r["d"]], parts[r["d"]] = base, -(-want // few)
        base += few * parts[r["d"]]
    held = spark.sparkContext.broadcast((pivots, first, parts))

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        pivots, first, parts = held.value
        length = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
        row, pivot, page = b.column(0).to_numpy(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for d in np.unique(length):
            at = np.flatnonzero(length == d)
            p = pivots[int(d)]
            x = _matrix(b.column(2).take(pa.array(at)), len(at)) if d else np.zeros((len(at), 0))
            near = ((p**2).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
            pivot[at] = first[int(d)] + near * parts[int(d)]
            page[at] = pivot[at] + row[at] % parts[int(d)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(page)], names=["row", "vec_id", "v", "pivot", "page"])

    return arrow_map(rows.select("row", "vec_id", "v"), deal, "row long, vec_id long, v array<double>, pivot long, page long"), held


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, column: str = "embedding", page_rows: int = PAGE_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k others with the highest
    inner product, ties to the smaller vec_id; all others, if there are fewer.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. A query is a row: of
    rows with one vec_id each is a query, and a candidate for all but itself. Only vectors of one length are compared with
    each other. An empty table gives an empty result. Extra columns are not read.
    """
    numbered = usable(vectors, column).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(numbered.select("row", "vec_id", "v"), "vectors")
    dealt, held = in_pages(rows, page_rows)
    # A page that far outgrows the mean (copies of one vector, say) is cut into several.
    sizes = materialize(dealt.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > 2 * page_rows), "page-sizes")
    cut = F.coalesce(F.ceil(F.col("n") / page_rows), F.lit(1))
    dealt = dealt.join(small_side(sizes), "page", "left").withColumn("cut", F.pmod(F.xxhash64("row"), cut).cast("int")).drop("n")

    def build(table: pa.Table) -> pa.Table:
        row, ids, x = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("v"), table.num_rows)
        tree = MTree(ids, row, x)
        pivots, first, parts = held.value
        pivot, d = table.column("pivot")[0].as_py(), x.shape[1]
        radius = float(np.sqrt(((x - pivots[d][(pivot - first[d]) // parts[d]]) ** 2).sum(axis=1)).max())
        asks = ids % every == 0
        order = np.flatnonzero(asks)
        q, v, score = tree.search(row[order], x[order], k) if len(order) else (np.zeros(0, np.int64),) * 3
        kth = {int(r): int(s[-1]) if len(s) == k else None for r in row[order] for s in [score[q == r]]}
        page, part = table.column("page")[0].as_py(), table.column("cut")[0].as_py()
        name = lambda n: ([page] * n, [part] * n)
        none = lambda n, kind: pa.nulls(n, kind)
        vector = pa.list_(pa.float64())
        made = [
            {"what": ["page"], "query": none(1, pa.int64()), "vec_id": none(1, pa.int64()), "score": none(1, pa.int64()), "v": none(1, vector), "radius": [radius], "tree": pa.array([tree.dump()], pa.binary())},
            {"what": ["found"] * len(q), "query": q, "vec_id": v, "score": score, "v": none(len(q), vector), "radius": none(len(q), pa.float64()), "tree": none(len(q), pa.binary())},
            {"what": ["query"] * len(order), "query": row[order], "vec_id": ids[order], "score": pa.array([kth[int(r)] for r in row[order]], pa.int64()), "v": pa.array(list(x[order]), vector), "radius": none(len(order), pa.float64()), "tree": none(len(order), pa.binary())},
        ]
        return pa.concat_tables([pa.table({"page": pa.array(name(len(m["what"]))[0], pa.int64()), "cut": pa.array(name(len(m["what"]))[1], pa.int32()), "pivot": pa.array([pivot] * len(m["what"]), pa.int64()), **m}).cast(shape) for m in made])

    kind = "page long, cut int, pivot long, what string, query long, vec_id long, score long, v array<double>, radius double, tree binary"
    shape = pa.schema([("page", pa.int64()), ("cut", pa.int32()), ("pivot", pa.int64()), ("what", pa.string()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("v", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary())])
    built = materialize(dealt.groupBy("page", "cut").applyInArrow(build, kind), "pages")
    pages = built.where("what = 'page'")
    reach = pages.groupBy("pivot").agg(F.max("radius").alias("radius")).orderBy("pivot").toArrow()  # one row for each pivot, however many pages it has
    pivots, first, parts = held.value
    spread = {}
    for d, vectors in pivots.items():
        ids = first[d] + np.arange(len(vectors)) * parts[d]
        at = np.searchsorted(reach.column("pivot").to_numpy(), ids)
        at = np.minimum(at, len(reach) - 1)
        met = reach.column("pivot").to_numpy()[at] == ids
        spread[d] = ids[met], reach.column("radius").to_numpy()[at][met], vectors[met]
    known = rows.sparkSession.sparkContext.broadcast(spread)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, least = b.column(2).value_lengths().to_numpy(zero_copy_only=False), b.column(1).cast(pa.float64()).fill_null(-np.inf).to_numpy()
            for d in np.unique(length).tolist():
                pivot, radius, centres = known.value[d]
                asked = np.flatnonzero(length == d)
                step = max(1, VISIT_CELLS // len(pivot))
                for at in (asked[i : i + step] for i in range(0, len(asked), step)):
                    x = _matrix(b.column(2).take(pa.array(at)), len(at))
                    high = x @ centres.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius[None, :]
                    q, to = np.nonzero(high * (1 + np.sign(high) * SLACK) + SLACK >= least[at][:, None])
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(pivot[to]), b.column(0).take(pa.array(at[q]))], names=["pivot", "query"])

    queries = built.where("what = 'query'")
    # Numbers alone say who goes where; a query's own page has been searched.
    goes = materialize(queries.select("query", "score", "v").mapInArrow(visits, "pivot long, query long"), "page-visits")
    places = pages.select("pivot", F.col("page").alias("page"), F.col("cut").alias("cut"))  # columns of their own beside those of pages
    asking = queries.select("query", F.col("page").alias("_page"), F.col("cut").alias("_cut"), F.col("score").alias("least"), "v")
    pairs = goes.join(small_side(places), "pivot").join(asking, "query").where("page <> _page or cut <> _cut").select("page", "cut", "query", "least", "v")
    visited = goes.join(small_side(places), "pivot")
    blocks = materialize(visited.groupBy("page", "cut").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "page-blocks")
    asked = pairs.join(small_side(blocks), ["page", "cut"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
    sent = pages.select("page", "cut", "tree").join(small_side(blocks), ["page", "cut"]).select("page", "cut", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(asked: pa.Table, sent: pa.Table) -> pa.Table:
        q, v, score = (np.zeros(0, np.int64),) * 3
        if asked.num_rows and sent.num_rows:
            least = asked.column("least").to_pylist()
            bounds = np.array([-np.inf if x is None else x for x in least], float)
            q, v, score = MTree.load(sent.column("tree")[0].as_py()).search(asked.column("query").to_numpy(), _matrix(asked.column("v"), asked.num_rows), k, bounds)
        return pa.table({"query": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(score, pa.int64())})

    far = asked.groupBy("page", "cut", "block").cogroup(sent.groupBy("page", "cut", "block")).applyInArrow(search, "query long, vec_id long, score long")
    found = built.where("what = 'found'").select("query", "vec_id", "score").unionByName(far)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = queries.select("query", F.col("vec_id").alias("query_id"))
    return best.join(small_side(names), "query").select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by comparing every query with every row.
OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
