"""K-Means invariants (exact k, every row labelled, planted recovery, errors)."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import kmeans as KM
from helpers import planted, to_df


def test_kmeans_planted(spark):
    x, y = planted(n_per=20, k=4, dim=8)
    df = to_df(spark, x, y)
    asg, info = KM.kmeans(df, k=4, n_init=3)
    rows = asg.select("pos", "label").collect()
    assert len(rows) == 80 and info["k"] == 4
    assert {r["label"] for r in rows} == {0, 1, 2, 3}
    pairs = {(y[r["pos"]], r["label"]) for r in rows}
    assert len(pairs) == 4  # one label per planted cluster


def test_kmeans_clamps_k_and_tops_up(spark):
    x, y = planted(n_per=3, k=2, dim=4, noise=0.01)  # 6 distinct rows
    asg, info = KM.kmeans(to_df(spark, x, y), k=10, n_init=1)
    assert info["k"] == 6
    assert asg.select("label").distinct().count() == 6


def test_kmeans_duplicates_use_distinct_points_only(spark):
    x, y = planted(n_per=2, k=2, dim=4, noise=0.0)  # 4 rows, 2 distinct points
    asg, info = KM.kmeans(to_df(spark, x, y), k=4, n_init=1)
    assert info["k"] == 4 and asg.count() == 4
    assert asg.select("label").distinct().count() == 2


def test_kmeans_empty_raises(spark):
    x, y = planted(n_per=2, k=1, dim=4)
    with pytest.raises(ValueError):
        KM.kmeans(to_df(spark, x, y).where(F.lit(False)), k=2)


def test_minibatch_kmeans_passes_read_every_row(spark):
    x, y = planted(n_per=40, k=3, dim=6)
    df, about_mean = to_df(spark, x, y), ((x - x.mean(axis=0)) ** 2).sum()
    for batch_size in (1, 16, 10_000):
        # one centre is the mean of all rows read, however they are dealt to tasks and batches
        _, info = KM.minibatch_kmeans(df.repartition(5), k=1, batch_size=batch_size, max_iter=1)
        assert info["iterations"] == 1 and info["inertia"] == pytest.approx(about_mean)
    assert KM.minibatch_kmeans(df, k=3, batch_size=16, max_iter=5, tol=100.0)[1]["iterations"] == 1


def jobs_of(spark, work):
    """How many Spark jobs ``work`` starts."""
    tracker, name = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(tracker.getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_minibatch_jobs_do_not_grow_with_rows(spark):
    x, y = planted(n_per=300, k=3, dim=6)
    few, many = (to_df(spark, x[::step], y[::step]) for step in (15, 1))
    run = [jobs_of(spark, lambda df=df: KM.minibatch_kmeans(df, k=3, batch_size=8, max_iter=4, tol=0.0))
           for df in (few, many)]
    assert abs(run[0] - run[1]) <= 4  # 900 rows are 113 batches, 60 rows are 8


def test_minibatch_close_to_lloyd(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 5)) + rng.normal(size=(12, 5))[rng.integers(12, size=600)] * 4
    df = to_df(spark, x)
    best = KM.kmeans(df, k=12, n_init=10)[1]["inertia"]
    assert KM.minibatch_kmeans(df, k=12, batch_size=64, max_iter=30, n_init=10)[1]["inertia"] <= 1.02 * best


def test_minibatch_by_group(spark):
    x, y = planted(n_per=30, k=4, dim=6)
    df = to_df(spark, x, y).selectExpr("*", "cast(truth_label div 2 as int) as half")
    asg, info = KM.minibatch_kmeans(df, k=2, batch_size=16, max_iter=10, group="half")
    assert info["k"] == 4
    assert len({(r.truth_label, r.label) for r in asg.collect()}) == 4


def test_first_centers_cover_far_groups(spark):
    """k-means|| finds a group of 3 rows among 3,000, which few hashed candidates would hold."""
    x = np.vstack([np.random.default_rng(1).normal(0, 0.01, (3000, 4)), np.full((3, 4), 50.0)])
    pts = to_df(spark, x).selectExpr("item_id as _id", "embedding as _vec")
    for c in KM.first_centers(pts, 2, 3, 5):
        assert c.max(axis=1).max() > 40 and c.max(axis=1).min() < 1


def test_minibatch_kmeans(spark):
    x, y = planted(n_per=40, k=3, dim=6)
    asg, info = KM.minibatch_kmeans(to_df(spark, x, y), k=3, batch_size=32, max_iter=20)
    assert asg.count() == 120 and info["k"] == 3


def test_rows_of_one_file_go_to_all_tasks_as_matrices(spark, monkeypatch):
    monkeypatch.setattr(KM, "LEAST_TASK_VALUES", 100)
    x = np.random.default_rng(3).normal(size=(300, 5))
    pts = to_df(spark, x).coalesce(1).selectExpr("cast(pos % 3 as int) as _g", "item_id as _id", "embedding as _vec")
    blocks, tasks = KM._packed(pts, 7)
    assert tasks == blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = [(g, v) for r in blocks.collect() for g, v in zip(np.frombuffer(r.g, np.int32).tolist(),
                                                              np.frombuffer(r.x).reshape(-1, 5).tolist())]
    assert sorted(rows) == sorted((i % 3, v) for i, v in enumerate(x.tolist()))


def test_pass_equals_brute_force(spark, monkeypatch):
    """Sets with different numbers of centres, one of them done, rows in small pieces, added up here and in Spark."""
    monkeypatch.setattr(KM, "LEAST_TASK_VALUES", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    pts = to_df(spark, x).selectExpr("cast(pos % 2 as int) as _g", "item_id as _id", "embedding as _vec")
    blocks, tasks = KM._packed(pts, 7)
    sets = {g: [rng.normal(size=(3, 4)), None, rng.normal(size=(3, 4)), rng.normal(size=(2, 4))] for g in (0, 1)}
    for limit in (KM.MAX_RETURNED_VALUES, 0):
        monkeypatch.setattr(KM, "MAX_RETURNED_VALUES", limit)
        found = KM._pass(blocks, tasks, sets, KM._sums)
        assert sorted(found) == [(g, r) for g in (0, 1) for r in (0, 2, 3)]
        for (g, r), rows in found.items():
            d = np.linalg.norm(x[g::2][:, None] - sets[g][r][None], axis=2)
            for row in rows:
                own = d.argmin(axis=1) == row.j
                assert row.n == own.sum() and np.allclose(row.s, x[g::2][own].sum(axis=0))
                assert row.cost == pytest.approx((d[own, row.j] ** 2).sum()) and row.far_d == pytest.approx(d[own, row.j].max())
                assert np.allclose(row.far, x[g::2][own][d[own, row.j].argmax()])


def test_estimate_k_jobs_do_not_grow_with_the_grid(spark):
    """All k and restarts go through the same jobs, and each k costs what K-Means with that k does."""
    x, y = planted(n_per=30, k=4, dim=6)
    df = to_df(spark, x, y)
    few, many = (jobs_of(spark, lambda top=top: KM.estimate_k(df, 2, top)) for top in (3, 10))
    assert many < 2 * few
    k, costs = KM.estimate_k(df, 2, 6)
    assert k == 4 and [kk for kk, _ in costs] == [2, 3, 4, 5, 6]
    assert costs[1][1] == pytest.approx(KM.kmeans(df, 3, n_init=3, max_iter=100)[1]["inertia"])
