"""Exact pair work without the block pairs that can't matter: pivot cells and the triangle inequality.

Rows go to the nearest of at most ``MAX_PIVOTS`` pivots. A cell is ordered by the distance to its pivot and cut
into blocks of ``block_rows`` rows, so that a block is a ring around a pivot: a crowded cell, or one vector that
a third of the rows share, is many blocks. From the pivots' distance and the two rings follow bounds for every
distance between two blocks; a block pair is computed only where its lower bound doesn't exceed the threshold,
or what the k-th neighbours of its rows are known to reach. The bounds need a metric with the triangle
inequality (``METRICS``). They have a margin far above rounding, and unclear ones (NaN) keep the pair.

The block table has about n / block_rows rows and is compared with itself by the blocked primitive: nothing but
the pivots and the sizes of their cells comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clusterloom.operators.blocks import (DEFAULT_BLOCK_ROWS, MAX_RANGES, _stack, as_right, n_blocks_for, pair_matrix,
                                          range_cap, reduce_pairs, self_block_cogroup)
from clusterloom.operators.jobs import global_rank
from clusterloom.session import cut_lineage

METRICS = ("euclidean", "l2", "manhattan", "l1", "cityblock")
MAX_PIVOTS = 1024
MAX_PIVOT_VALUES = 2_000_000  # numbers in the pivots that go to every task, 16 MB
MARGIN = 1e-6


class Cells(NamedTuple):
    """``points``: the given columns and ``_blk``; ``blocks``: ``_id, _cell, _lo, _hi, _n``; pivots as a broadcast."""

    points: DataFrame
    blocks: DataFrame
    pivots: Any
    metric: str


def _choose_pivots(pts: DataFrame, count: int, metric: str) -> np.ndarray:
    """k-means++ picks among the ``4 * count`` rows with the smallest hashes, all different and finite."""
    rows = pts.select("_vec", "_id").orderBy(F.xxhash64("_id"), "_id").limit(4 * count).collect()
    x = np.unique(np.array([r[0] for r in rows], np.float64), axis=0)
    x = x[np.isfinite(x).all(axis=1)]
    if len(x) <= count:
        return x if len(x) else np.zeros((1, len(rows[0][0])))
    rng = np.random.default_rng(0)
    chosen = [int(rng.integers(len(x)))]
    near = pair_matrix(x, x[chosen], metric)[:, 0] ** 2
    while len(chosen) < count and near.sum() > 0:
        chosen.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, pair_matrix(x, x[chosen[-1:]], metric)[:, 0] ** 2)
    return x[chosen]


def make_cells(pts: DataFrame, metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS,
               n_blocks: int | None = None) -> Cells:
    """Cells of ``pts`` (``_id``, ``_vec`` and any other columns; ids are unique and no vector is null)."""
    if metric not in METRICS:
        raise ValueError(f"no triangle inequality for {metric!r}")
    width = max(1, pts.select(F.max(F.size("_vec"))).first()[0] or 1)
    count = min(n_blocks or n_blocks_for(pts, block_rows), MAX_PIVOTS, max(1, MAX_PIVOT_VALUES // width))
    pivots = pts.sparkSession.sparkContext.broadcast(_choose_pivots(pts, count, metric))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, dist = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for at in range(0, len(pdf), DEFAULT_BLOCK_ROWS):
                d = pair_matrix(_stack(pdf["_vec"].iloc[at:at + DEFAULT_BLOCK_ROWS]), pivots.value, metric)
                best = d.argmin(axis=1)
                cell[at:at + len(d)], dist[at:at + len(d)] = best, d[np.arange(len(d)), best]
            yield pdf.assign(_cell=cell, _dist=dist)

    placed = pts.mapInPandas(nearest, StructType(list(pts.schema.fields)).add("_cell", "integer").add("_dist", "double"))
    ranked = global_rank(placed, [F.asc("_cell"), F.asc("_dist"), F.asc("_id")], "_g")
    first, base, blocks = {}, {}, 0
    for cell, start, n in sorted(ranked.groupBy("_cell").agg(F.min("_g"), F.count("*")).collect()):
        first[cell], base[cell] = start, blocks
        blocks += -(-n // block_rows)

    def by_cell(values: dict[int, int]):
        return F.element_at(F.lit([values.get(c, 0) for c in range(len(pivots.value))]).cast("array<long>"),
                            F.col("_cell") + 1)

    points = ranked.withColumn("_blk", by_cell(base) + F.floor((F.col("_g") - by_cell(first)) / F.lit(block_rows)))
    table = points.groupBy(F.col("_blk").alias("_id")).agg(
        F.first("_cell").alias("_cell"), F.min("_dist").alias("_lo"), F.max("_dist").alias("_hi"),
        F.count("*").alias("_n"))
    return Cells(points.drop("_g", "_cell", "_dist"), cut_lineage(table), pivots, metric)


def _bounds(l: pd.DataFrame, r: pd.DataFrame, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the distances between the rows of each left and each right block."""
    d = pair_matrix(pivots[l["_cell"].to_numpy()], pivots[r["r__cell"].to_numpy()], metric)
    lo_l, hi_l = l["_lo"].to_numpy(np.float64)[:, None], l["_hi"].to_numpy(np.float64)[:, None]
    lo_r, hi_r = r["r__lo"].to_numpy(np.float64)[None, :], r["r__hi"].to_numpy(np.float64)[None, :]
    upper = d + hi_l + hi_r
    margin = MARGIN * upper
    lower = np.maximum(np.maximum(d - hi_l - hi_r, 0.0), np.maximum(lo_l - hi_r, lo_r - hi_l) - d)
    return lower - margin, upper + margin


def pairs_in_reach(cells: Cells, reach: DataFrame) -> DataFrame:
    """Block pairs ``_gl <= _gh`` whose lower bound is at most the larger ``_reach`` of the two.

    ``reach``: the block table with that column.
    """
    pivots, metric = cells.pivots, cells.metric

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0:
            return pd.DataFrame({"_gl": pd.Series([], dtype="int64"), "_gh": pd.Series([], dtype="int64")})
        lower, _ = _bounds(l, r, pivots.value, metric)
        far = lower > np.maximum(l["_reach"].to_numpy(np.float64)[:, None], r["r__reach"].to_numpy(np.float64)[None, :])
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        if diag:
            far |= li[:, None] > ri[None, :]
        a, b = np.nonzero(~far)
        return pd.DataFrame({"_gl": np.minimum(li[a], ri[b]), "_gh": np.maximum(li[a], ri[b])})

    return cut_lineage(self_block_cogroup(reach, red, "_gl long, _gh long", n_blocks_for(reach)))


def pairs_within_reach(cells: Cells, threshold: float) -> DataFrame:
    """The block pairs that may hold a distance of at most ``threshold``."""
    return pairs_in_reach(cells, cells.blocks.withColumn("_reach", F.lit(float(threshold))))


def _reach_inside(cells: Cells, k: int) -> DataFrame:
    """Per block the largest distance of a row to its k-th nearest other row of the same block."""
    metric = cells.metric

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        far = float("inf")
        if len(pdf) > k:
            x, ids = _stack(pdf["_vec"]), pdf["_id"].to_numpy(np.int64)
            d = np.where(ids[:, None] == ids[None, :], np.inf, pair_matrix(x, x, metric))
            far = float(np.partition(d, k - 1, axis=1)[:, k - 1].max()) * (1.0 + MARGIN)
        return pd.DataFrame({"_id": [key[0]], "_inside": [far]})

    return cells.points.select("_blk", "_id", "_vec").groupBy("_blk").applyInPandas(run, "_id long, _inside double")


def _reach_around(cells: Cells, k: int) -> DataFrame:
    """Per block an upper bound within which the blocks around it (and its own) have k other rows for each of its rows."""
    pivots, metric = cells.pivots, cells.metric

    def nearest(ids: np.ndarray, upper: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(upper, axis=1, kind="stable")
        sizes = np.take_along_axis(n, order, axis=1)
        a, b = np.nonzero((sizes.cumsum(axis=1) - sizes < k) & (sizes > 0))  # the shortest prefix with k rows
        return ids[a], upper[a, order[a, b]], sizes[a, b]

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        cols = {"_id": "int64", "_upper": "float64", "_n": "int64"}
        if len(l) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in cols.items()})
        _, upper = _bounds(l, r, pivots.value, metric)
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        own = (li[:, None] == ri[None, :]).astype(np.int64)  # a row isn't its own neighbour
        found = [nearest(li, upper, r["r__n"].to_numpy(np.int64)[None, :] - own)]
        if not diag:
            found.append(nearest(ri, upper.T, np.repeat(l["_n"].to_numpy(np.int64)[None, :], len(ri), axis=0)))
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(cols)})

    near = self_block_cogroup(cells.blocks, red, "_id long, _upper double, _n long", n_blocks_for(cells.blocks))
    w = Window.partitionBy("_id").orderBy("_upper").rowsBetween(Window.unboundedPreceding, 0)
    return (near.withColumn("_have", F.sum("_n").over(w)).where(F.col("_have") >= k)
            .groupBy("_id").agg(F.min("_upper").alias("_around")))


def pairs_for_neighbours(cells: Cells, k: int) -> DataFrame:
    """The block pairs that may hold one of the k nearest other rows of any row."""
    reach = cells.blocks.join(_reach_inside(cells, k), "_id")
    if cells.blocks.where(F.col("_n") <= k).isEmpty():
        reach = reach.withColumn("_reach", F.col("_inside"))
    else:
        reach = reach.join(_reach_around(cells, k), "_id", "left").withColumn("_reach", F.least("_inside", "_around"))
    return pairs_in_reach(cells, cut_lineage(reach.drop("_inside", "_around")))


def pairs_cogroup(points: DataFrame, pairs: DataFrame, reducer: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
                  schema: str, block_rows: int = DEFAULT_BLOCK_ROWS, span: int | None = None) -> DataFrame:
    """``reducer(left, right, is_diagonal)`` on the given pairs ``_gl <= _gh`` of the blocks ``_blk`` of ``points``,
    as ``self_block_cogroup`` runs it on all: in groups of ranges of blocks (``span`` blocks each), to which a row goes once.

    A left row brings the right blocks that its block meets in the range.
    """
    if span is None:
        blocks = (pairs.agg(F.max("_gh")).first()[0] or 0) + 1
        span = 1 if blocks <= MAX_RANGES else min(-(-blocks // MAX_RANGES), range_cap(points, block_rows))
    to = pairs.select(F.floor(F.col("_gl") / F.lit(span)).alias("_rl"), F.floor(F.col("_gh") / F.lit(span)).alias("_rh"), "_gl", "_gh")
    to_right = to.groupBy(F.col("_gl").alias("_blk"), "_rl", "_rh").agg(
        F.collect_list((F.col("_gh") - F.col("_rh") * F.lit(span)).cast("int")).alias("_with"))
    to_left = to.select(F.col("_gh").alias("_blk"), "_rl", "_rh").distinct()
    keys = ["_rl", "_rh"]
    left, right = points.join(to_right, "_blk"), points.join(to_left, "_blk")
    right = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])

    def run(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        rights = {int(b): rows for b, rows in rpdf.groupby("r__blk")}

        def met() -> Iterator[tuple]:
            for a, l in lpdf.groupby("_blk"):
                for b in sorted(int(l["_rh"].iloc[0]) * span + int(b) for b in l["_with"].iloc[0]):
                    if b == a or b in rights:
                        yield int(a), l, b, as_right(l, keys) if b == a else rights[b]

        return reduce_pairs(reducer, met(), lpdf.iloc[0:0])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
