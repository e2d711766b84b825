"""Operator 5 - exact top-k inner-product search with a KD-tree per shard.

Components become integers, floor(64 * x).  The top of the tree is split at the medians of a bounded sample (``SAMPLE_PER_LEAF``
rows a leaf, ``TOP_LEAVES`` leaves at most), and every vector walks down to its leaf; a leaf is dealt into shards of bounded size
by a hash of the id, so neither many rows nor many equal ones make a shard large.  Each shard builds a KD-tree of its own by median
splits with tight bounding boxes.  A query walks a tree best first: the bound of a box is the largest inner product that
any point inside could have, and the walk ends when the best bound left is below the query's k-th score.

The k-th score is propagated: a first pass searches one shard of the query's own leaf, and its k-th score starts the second pass.
There the tight boxes of the leaves, worked out over all rows, tell which leaves a query still has to visit, before any vector
moves; only shards that some query needs are sent.  Every shard and box not excluded by its bound is scanned, so results are
exact.  Queries are a stated set and meet a shard in blocks of bounded size: (shard, block) is one task's work.

Edge cases: null vectors and vectors with a null, NaN or infinite component take no part; vectors of another length are
never compared; an empty vector scores nothing; products beyond
2**53 are worked out with whole numbers, components and scores beyond the range of a long count as its ends; ties go to the smaller id; rows that repeat an id are candidates each, none
for the query of the same id, and a repeated query row is asked once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, TOP_LEAVES, SAMPLE_PER_LEAF = 8192, 2048, 256, 1024, 32
LONG = 2**63 - 1
HITS = "query_id long, vec_id long, score long"


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS):
    """(order, nodes): nodes are (start, stop, left, right), boxes lo and hi are tight."""
    order, nodes, lo, hi, todo = np.arange(len(points)), [], [], [], [(0, len(points), -1, False)]
    while todo:
        start, stop, parent, right = todo.pop()
        part = points[order[start:stop]]
        me = len(nodes)
        nodes.append([start, stop, -1, -1])
        lo.append(part.min(axis=0))
        hi.append(part.max(axis=0))
        if parent >= 0:
            nodes[parent][3 if right else 2] = me
        spread = hi[me] - lo[me]
        if stop - start > leaf_rows and spread.max() > 0:
            axis, mid = int(spread.argmax()), (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(part[:, axis], mid)]
            todo += [(start, start + mid, me, False), (start + mid, stop, me, True)]
    return order, nodes, np.array(lo), np.array(hi)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
    """Best-first search of every query; ``floor`` is a score known to be reached by k other rows (or -inf)."""
    order, nodes, lo, hi = build_tree(points)
    points, ids = points[order], ids[order]
    bounds = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T  # query x node: no point of the box scores more
    out = []
    for j in range(len(queries)):
        q, me, kth, row = queries[j], query_ids[j], floor[j], bounds[j]
        best_score, best_id = np.empty(0), np.empty(0, dtype=np.int64)
        heap = [(-row[0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            start, stop, left, right = nodes[node]
            if left >= 0:
                for child in (left, right):
                    if row[child] >= kth:
                        heapq.heappush(heap, (-row[child], child))
                continue
            score, who = points[start:stop] @ q, ids[start:stop]
            keep = (score >= kth) & (who != me)
            if not keep.any():
                continue
            best_score, best_id = np.concatenate([best_score, score[keep]]), np.concatenate([best_id, who[keep]])
            top = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[top], best_id[top]
            if len(top) == k:
                kth = max(kth, best_score[-1])
        if len(best_id):
            out.append(pd.DataFrame({"query_id": me, "vec_id": best_id, "score": best_score.astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def exhaustive(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
    """The same with whole numbers of any size, for components whose products leave the range of exact doubles."""
    out = []
    for q, me, least in zip(queries, query_ids, floor, strict=True):
        scores = [(-max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(q.tolist(), p.tolist(), strict=True)))), int(i)) for p, i in zip(points, ids, strict=True) if i != me]
        best = heapq.nsmallest(k, [x for x in scores if -x[0] >= least])
        out.append(pd.DataFrame({"query_id": me, "vec_id": [i for _, i in best], "score": [-x for x, _ in best]}, dtype="int64"))
    return pd.concat(out)


def _searcher(k: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        whole, asked = np.array(points.v.tolist(), dtype=np.int64), np.array(queries.v.tolist(), dtype=np.int64)
        exact = np.abs(whole.astype(float)).max(initial=0) * np.abs(asked.astype(float)).max(initial=0) * whole.shape[1] < 2**53
        look, kind = (search, np.float64) if exact else (exhaustive, np.int64)
        return look(whole.astype(kind), points.id.to_numpy(np.int64), asked.astype(kind), queries.id.to_numpy(np.int64), queries.kth.fillna(-np.inf).to_numpy(np.float64), k)

    return run


class Top:
    """The top of the KD-tree: median splits of a sample in heap layout, and the boxes of its leaves."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, inner = depth, 2**depth - 1
        self.axis, self.cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.iinfo(np.int64).max)
        parts = [sample]
        for node in range(inner):
            part = parts[node]
            if len(part):
                self.axis[node] = axis = int((part.max(axis=0).astype(float) - part.min(axis=0).astype(float)).argmax())
                self.cut[node] = np.sort(part[:, axis])[(len(part) - 1) // 2]
            right = part[:, self.axis[node]] > self.cut[node]
            parts += [part[~right], part[right]]
        self.lo = self.hi = None

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)

    def within(self, q: np.ndarray, least: float) -> list[int]:
        """Leaves in which some point may score ``least`` or more with ``q``."""
        bound = np.maximum(q, 0) @ self.hi + np.minimum(q, 0) @ self.lo
        # Rounding errors go with the sizes of the summands, not with that of the sum.
        slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(self.hi), np.abs(self.lo)))
        return np.flatnonzero(np.minimum(bound, float(LONG)) + slack >= least).tolist()


def _boxes(placed: DataFrame, top: Top, dim: int) -> None:
    """Tight boxes over all rows of every leaf; a leaf's box is all that comes to the driver."""

    def run(batches):
        lo, hi = {}, {}
        for batch in batches:
            points = np.array(batch.v.tolist(), dtype=np.int64)
            for leaf in batch.leaf.unique():
                part = points[(batch.leaf == leaf).to_numpy()]
                lo[leaf] = np.minimum(lo.get(leaf, part[0]), part.min(axis=0))
                hi[leaf] = np.maximum(hi.get(leaf, part[0]), part.max(axis=0))
        if lo:
            yield pd.DataFrame({"leaf": list(lo), "lo": [x.tolist() for x in lo.values()], "hi": [x.tolist() for x in hi.values()]})

    parts = placed.where(F.col("dim") == dim).select("leaf", "v").mapInPandas(run, "leaf int, lo array<long>, hi array<long>")
    ends = parts.select("leaf", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "b")).groupBy("leaf", "at").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi")).collect()
    # An empty leaf's bounds are below any score.
    top.lo, top.hi = np.full((dim, 2**top.depth), 0.0), np.full((dim, 2**top.depth), 0.0)
    for r in ends:
        top.lo[r["at"], r.leaf], top.hi[r["at"], r.leaf] = float(r.lo), float(r.hi)


def floor_of(score):
    """A score as a double that is not above it; the least long stands for anything below, so it excludes nothing."""
    near = score.cast("double")
    return F.when(F.abs(near) < 2.0**53, near).when(near > -(2.0**63), near - F.abs(near) * 2.0**-51)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for the queries with vec_id divisible by ``every``."""
    floored = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").alias("id"), floored.alias("v"), F.size("embedding").alias("dim"))
    rows = stored(rows.repartition("id"), "vectors")
    total = rows.count()
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dim = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    depth = min(TOP_LEAVES.bit_length() - 1, max(0, (-(-total // shard_rows) - 1).bit_length()))
    sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_LEAF << depth).select("v").collect()
    top = Top(np.array([r.v for r in sample], dtype=np.int64).reshape(-1, dim), depth)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(top.leaf(np.array(v.tolist(), dtype=np.int64)) if len(v) else [], dtype="int32")

    # Vectors of another length than the commonest are leaves of their own.
    placed = stored(rows.where(F.col("dim") == dim).withColumn("leaf", leaf_of("v")).unionByName(rows.where(F.col("dim") != dim).withColumn("leaf", F.lit(0))), "placed")
    _boxes(placed, top, dim)
    salts = stored(placed.groupBy("dim", "leaf").count().select("dim", "leaf", F.ceil(F.col("count") / shard_rows).alias("salts")), "salts")
    placed = placed.join(salts, ["dim", "leaf"])
    points = placed.withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).select("dim", "leaf", "salt", "id", "v")
    asked = placed.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    asked = stored(asked.select("dim", "leaf", F.pmod(F.xxhash64("id", F.lit(11)), "salts").alias("salt"), "id", "v"), "queries")
    shard = ["dim", "leaf", "salt"]
    first = points.groupBy(*shard).cogroup(asked.withColumn("kth", F.lit(None).cast("double")).groupBy(*shard)).applyInPandas(_searcher(k), HITS)
    first = stored(_ranked(first, k), "hits")
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), floor_of(F.col("score")).alias("kth"))
    asked = asked.select(F.col("leaf").alias("home"), F.col("salt").alias("done"), "dim", "id", "v").join(known, "id", "left")

    @F.pandas_udf("array<int>")
    def leaves(v: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([top.within(np.array(q, dtype=np.float64), x) for q, x in zip(v, least.fillna(-np.inf), strict=True)])

    visits = asked.where(F.col("dim") == dim).withColumn("leaf", F.explode(leaves("v", "kth"))).unionByName(asked.where(F.col("dim") != dim).withColumn("leaf", F.lit(0)))
    visits = visits.join(salts, ["dim", "leaf"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    visits = visits.where((F.col("leaf") != F.col("home")) | (F.col("salt") != F.col("done"))).select(*shard, "id", "v", "kth")
    blocks = stored(visits.groupBy(*shard).count().select(*shard, F.ceil(F.col("count") / block_rows).alias("blocks")), "blocks")
    visits = visits.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), "blocks")).drop("blocks")
    sent = points.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    key = [*shard, "block"]
    rest = sent.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(_searcher(k), HITS)
    return _ranked(first.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
