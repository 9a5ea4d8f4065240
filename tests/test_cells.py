"""Pivot cells: the same results as all block pairs, from fewer of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import neighbors as N
from clusterloom.operators.blocks import pair_matrix
from clusterloom.operators.cells import make_cells, pairs_for_neighbours, pairs_within_reach
from clusterloom.operators.graph import core_distances
from helpers import planted, to_df

ROWS = 16


def points(df):
    return df.select(F.col("pos").alias("_id"), F.col("embedding").alias("_vec"))


def crowded():
    """Six clusters, outliers, and a third of the rows equal."""
    x, _ = planted(n_per=30, k=6, dim=8, noise=0.05, outliers=12, seed=3)
    return np.vstack([x, np.repeat(x[:1], 90, axis=0)])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_pairs_and_neighbours_equal_brute_force(spark, metric):
    x = crowded()
    df = to_df(spark, x)
    d = pair_matrix(x, x, metric)
    got = {(r["id_a"], r["id_b"]) for r in N.pairs_within(df, 0.2, metric=metric, block_rows=ROWS).collect()}
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 0.2}
    np.fill_diagonal(d, np.inf)
    rows = N.knn_graph(df, 5, metric=metric, block_rows=ROWS).collect()
    assert len(rows) == 5 * len(x)
    want = np.sort(d, axis=1)
    assert all(abs(want[r["id"], r["rank"] - 1] - r["dist"]) < 1e-9 for r in rows)


def test_under_half_of_the_block_pairs_on_clustered_data(spark):
    x, _ = planted(n_per=80, k=8, dim=8, noise=0.02)
    cells = make_cells(points(to_df(spark, x)), block_rows=ROWS)
    n = cells.blocks.count()
    assert cells.blocks.agg(F.max("_n"), F.sum("_n")).first() == (ROWS, len(x))
    for pairs in (pairs_within_reach(cells, 0.05), pairs_for_neighbours(cells, 5)):
        assert pairs.distinct().count() == pairs.count() < n * (n + 1) / 4


def test_more_neighbours_than_a_block_and_than_rows(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(40, 4)), rng.normal(size=(3, 4)) + 50])
    df = to_df(spark, x)
    d = np.sort(np.where(np.eye(len(x), dtype=bool), np.inf, pair_matrix(x, x)), axis=1)
    for k in (20, 60):
        cores = {r["pos"]: r["core_distance"] for r in core_distances(df, k, block_rows=ROWS).collect()}
        assert all(abs(cores[i] - d[i, min(k, len(x) - 1) - 1]) < 1e-9 for i in range(len(x)))


def test_equal_rows_are_many_blocks_and_no_row_is_lost(spark):
    df = to_df(spark, np.ones((70, 3)))
    cells = make_cells(points(df), block_rows=ROWS)
    assert sorted(r["_n"] for r in cells.blocks.collect()) == [6, 16, 16, 16, 16]
    assert N.pairs_within(df, 0.0, block_rows=ROWS).count() == 70 * 69 // 2
    assert N.pairs_within(df.limit(0), 1.0, block_rows=ROWS).count() == 0


def test_a_metric_without_triangle_inequality_is_refused(spark):
    with pytest.raises(ValueError, match="triangle"):
        make_cells(points(to_df(spark, np.ones((4, 2)))), "cosine")
