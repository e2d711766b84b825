"""Operator 11 - embedding whitening by a tiled covariance.

Components become whole numbers, floor(256 * c).  The covariance is worked out over each distinct vector once: rows are dealt to
row-blocks of bounded size, and a row-block is stored as column blocks, centred.  Pairs of dimensions are parted into tiles, a
tile being a pair of column blocks; the column blocks of a row-block meet in a join on it, are multiplied tile by tile, products
are added up within a task and then by tile.  The tiles are put together on the driver, a matrix as large as the square of the
dimension whatever the rows, and decomposed there; whitening is a map over all rows.

Sums are exact: they are added up as whole numbers of any size.  ``deviation`` is exact too, and null where it leaves the range of a
long.  Eigenvectors have their largest entry positive, so that reruns agree in sign.

Edge cases: rows whose vector is null or holds a null, NaN or infinite entry take no part; an empty vector has no components and
no rows in the result; vectors of different lengths are populations of their own; entries beyond 2**63 / 256 count as the
end of that range, as Spark's floor has it; a component without variance (a single vector, fewer distinct vectors than
dimensions) has ``whitened`` 0 and no part in ``identity_error``; without any variance ``explained`` is 0; null and repeated ids are
rows each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, COMPONENTS, TILE, ROW_BLOCK = 256, 4, 32, 4096
#: Least share of the largest eigenvalue that counts as variance: below it is rounding.
LEAST_SHARE = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array<long>) and its length of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.size("embedding").alias("dim"))


def matrix(arrays: pd.Series) -> np.ndarray:
    return np.stack(arrays.to_numpy()).astype(np.int64)


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """By length: number of rows, exact sum of each dimension, largest absolute entry."""

    def run(batches):
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        most: dict[int, int] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = matrix(part.x)
                low, high = int(x.min()), int(x.max())
                big = max(-low, high) * len(x) >= 2**62
                n[dim] = n.get(dim, 0) + len(x)
                total[dim] = total.get(dim, 0) + (x.astype(object) if big else x).sum(axis=0).astype(object)
                most[dim] = max(most.get(dim, 0), -low, high)
        for dim in n:
            yield pd.DataFrame({"dim": dim, "at": range(dim), "n": n[dim], "s": [str(v) for v in total[dim]], "most": str(most[dim])})

    parts = rows.mapInPandas(run, "dim int, at int, n long, s string, most string")
    whole_numbers = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max(F.col("most").cast("decimal(38,0)")).alias("most"))
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in sorted(whole_numbers.collect(), key=lambda r: (r.dim, r["at"])):  # one row a dimension
        n, s, most = out.get(r.dim, (r.n, [], 0))
        out[r.dim] = (n, [*s, int(r.s)], max(most, int(r.most)))
    return out


def column_blocks(fit: DataFrame, means: dict[int, np.ndarray], tile: int, row_block: int) -> DataFrame:
    """Row-blocks of at most ``row_block`` rows of one length, each as its centred column blocks of ``tile`` dimensions."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[np.ndarray]] = {}

        def close(dim):
            nonlocal made
            rows = np.concatenate(held.pop(dim)) - means[dim]
            for start in range(0, len(rows), row_block):
                piece = rows[start : start + row_block]
                yield pd.DataFrame([((part << 32) + made, dim, k, len(piece), np.ascontiguousarray(piece[:, k * tile : (k + 1) * tile]).tobytes()) for k in range(-(-dim // tile))], columns=["row_block", "dim", "k", "n", "data"])
                made += 1

        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                held.setdefault(dim, []).append(matrix(rows.x))
                if sum(map(len, held[dim])) >= row_block:
                    yield from close(dim)
        for dim in list(held):
            yield from close(dim)

    return fit.mapInPandas(run, "row_block long, dim int, k int, n int, data binary")


def covariances(blocks: DataFrame, counts: dict[int, int], tile: int) -> dict[int, np.ndarray]:
    """By length: the covariance, put together from its tiles."""
    left = blocks.select("row_block", "dim", "n", F.col("k").alias("i"), F.col("data").alias("a"))
    right = blocks.select("row_block", F.col("k").alias("j"), F.col("data").alias("b"))
    pairs = left.join(right, "row_block").where(F.col("i") <= F.col("j"))

    def multiply(batches):
        tiles: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in batch.itertuples():
                product = np.frombuffer(r.a).reshape(r.n, -1).T @ np.frombuffer(r.b).reshape(r.n, -1)
                key = (r.dim, r.i, r.j)
                tiles[key] = tiles[key] + product if key in tiles else product
        yield pd.DataFrame([(*key, product.tobytes()) for key, product in tiles.items()], columns=["dim", "i", "j", "data"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        # In one order whatever arrives first, so that reruns agree to the last bit.
        return rows.head(1).assign(data=[sum(np.frombuffer(x) for x in sorted(rows.data)).tobytes()])

    schema = "dim int, i int, j int, data binary"
    out = {dim: np.zeros((dim, dim)) for dim in counts}
    for r in pairs.mapInPandas(multiply, schema).groupBy("dim", "i", "j").applyInPandas(add, schema).collect():
        rows, columns = slice(r.i * tile, min((r.i + 1) * tile, r.dim)), slice(r.j * tile, min((r.j + 1) * tile, r.dim))
        product = np.frombuffer(r.data).reshape(rows.stop - rows.start, -1) / counts[r.dim]
        out[r.dim][rows, columns] = product
        out[r.dim][columns, rows] = product.T
    return out


def components_of(v: np.ndarray, components: int):
    """(axes, explained): unit eigenvectors over the root of their eigenvalue, by falling eigenvalue, and their shares of the trace."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    fine = values > LEAST_SHARE * max(values.max(initial=0), 0)
    axes = np.where(fine, vectors / np.sqrt(np.where(fine, values, 1)), 0.0)
    return axes, values / np.trace(v) if np.trace(v) > 0 else np.zeros(len(values))


def identity_errors(fit: DataFrame, means: dict, axes: dict) -> dict[int, float]:
    """By length: how far the covariance of what has been whitened is from the identity, measured over the fit list."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                y = (matrix(rows.x) - means[dim]) @ axes[dim]
                y = np.column_stack([y, np.ones(len(y))])
                total[dim] = total.get(dim, 0) + y.T @ y
        yield pd.DataFrame([(dim, t.tobytes()) for dim, t in total.items()], columns=["dim", "data"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.head(1).assign(data=[sum(np.frombuffer(x) for x in sorted(rows.data)).tobytes()])

    out = {}
    for r in fit.mapInPandas(run, "dim int, data binary").groupBy("dim").applyInPandas(add, "dim int, data binary").collect():
        products = np.frombuffer(r.data).reshape(axes[r.dim].shape[1] + 1, -1)
        n, fine = products[-1, -1], np.flatnonzero(np.abs(axes[r.dim]).sum(axis=0) > 0)
        mean = products[-1, :-1] / n
        error = (products[:-1, :-1] / n - np.outer(mean, mean))[np.ix_(fine, fine)] - np.eye(len(fine))
        out[r.dim] = float(np.abs(error).max(initial=0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, row_block: int = ROW_BLOCK) -> DataFrame:
    """(vec_id, embedding) -> RESULT: a row for each vector and each of the first ``components`` components."""
    spark = vectors.sparkSession
    rows = stored(whole(vectors), "whole_vectors")
    fit = stored(rows.select("dim", "x").dropDuplicates(["dim", "x"]), "fit_list")
    totals = sums(fit)
    if not totals:
        return spark.createDataFrame([], RESULT)
    means = {dim: np.array([float(v // n) + float(v % n) / n for v in s]) for dim, (n, s, _) in totals.items()}
    blocks = stored(column_blocks(fit, means, tile, row_block), "column_blocks")
    found = {dim: components_of(v, components) for dim, v in covariances(blocks, {dim: n for dim, (n, _, _) in totals.items()}, tile).items()}
    axes = {dim: a for dim, (a, _) in found.items()}
    errors = identity_errors(fit, means, axes)

    def deviations(dim: int, x: np.ndarray) -> list:
        n, s, most = totals[dim]
        if (n * (most + abs(max(s, key=abs)) // n + 1)) ** 2 * dim < 2**62:
            return np.square(n * x - np.array(s, dtype=np.int64)).sum(axis=1).tolist()
        exact = np.square(n * x.astype(object) - np.array(s, dtype=object)).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = matrix(part.x)
                y, k = (x - means[dim]) @ axes[dim], axes[dim].shape[1]
                each = lambda values: np.repeat(np.array(values, dtype=object), k)  # noqa: E731, B023
                yield pd.DataFrame({
                    "vec_id": part.vec_id.astype("Int64").repeat(k).array,
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": totals[dim][0],
                    "deviation": pd.array(each(deviations(dim, x)), dtype="Int64"),
                    "whitened": y.ravel(),
                    "explained": np.tile(found[dim][1], len(x)),
                    "identity_error": errors[dim],
                })

    return rows.mapInPandas(run, RESULT)
