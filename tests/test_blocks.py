"""Blocked pair primitive against numpy brute force, with several blocks forced."""

import numpy as np
import pandas as pd
import pytest

from clusterloom.operators import metrics as M
from clusterloom.operators import neighbors as N
from clusterloom.operators.agglomerative import _ward_links
from clusterloom.operators.blocks import NearestReducer, Screen, as_right, knn_reducer, outside_reducer, pair_matrix
from helpers import planted, to_df


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 8))
    y = rng.integers(0, 4, size=120)
    return x, y, to_df(spark, x, y)


def brute_force_knn(x, k):
    d = pair_matrix(x, x)
    np.fill_diagonal(d, np.inf)
    return {i: [(int(j), float(d[i, j])) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]] for i in range(len(x))}


def test_knn_graph_multi_block(data):
    x, _, df = data
    got = N.knn_graph(df, 4, block_rows=16).collect()
    ref = brute_force_knn(x, 4)
    assert len(got) == 4 * len(x)
    for r in got:
        nbrs = ref[r["id"]]
        assert nbrs[r["rank"] - 1][0] == r["nbr_id"]
        assert abs(nbrs[r["rank"] - 1][1] - r["dist"]) < 1e-9


def test_pairs_within_multi_block(data):
    x, _, df = data
    d = pair_matrix(x, x)
    t = float(np.quantile(d[np.triu_indices(len(x), 1)], 0.05))
    got = {(r["id_a"], r["id_b"]) for r in N.pairs_within(df, t, block_rows=16).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= t}
    assert got == want


def test_silhouette_matches_brute_force(data):
    x, y, df = data
    per, _ = M.silhouette(df.withColumnRenamed("truth_label", "label"), block_rows=16)
    got = {r["pos"]: r["silhouette"] for r in per.collect()}
    d = pair_matrix(x, x)
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean()
        b = min(d[i, y == c].mean() for c in set(y) if c != y[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_knn_search_and_padding(spark, data):
    x, _, df = data
    q = spark.createDataFrame([(0, [0.0] * 8), (1, [1.0] * 8)], "query_id long, query_vector array<double>")
    hits = N.pad_results(N.knn_search(df, q, 5, block_rows=16), q, 5).collect()
    assert len(hits) == 10
    d0 = ((x - 0.0) ** 2).sum(1)
    want0 = list(np.lexsort((np.arange(len(x)), d0))[:5])
    got0 = [r["id"] for r in sorted(hits, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 0]
    assert got0 == want0
    small = df.limit(3)
    padded = N.pad_results(N.knn_search(small, q, 5), q, 5).collect()
    assert sum(1 for r in padded if r["id"] == -1) == 4 and all(
        r["dist"] == float("inf") for r in padded if r["id"] == -1)


def test_wrong_query_dimension_raises(spark, data):
    _, _, df = data
    q = spark.createDataFrame([(0, [0.0] * 5)], "query_id long, query_vector array<double>")
    with pytest.raises(ValueError, match="dimension"):
        N.knn_search(df, q, 3)


def test_pairwise_similarity_closed_form(spark):
    x, y = planted(n_per=10, k=2, dim=6, noise=0.3)
    df = to_df(spark, x, y).withColumnRenamed("truth_label", "label")
    got = {r["label"]: r["pairwise_similarity"] for r in M.pairwise_intra_similarity(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for c in (0, 1):
        s = u[y == c] @ u[y == c].T
        n = (y == c).sum()
        assert abs(got[c] - (s.sum() - n) / (n * (n - 1))) < 1e-9


def test_exact_duplicates_are_at_distance_zero(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 48)) * 100
    x[30:] = x[:30]
    got = N.pairs_within(to_df(spark, x), 0.0, block_rows=16).collect()
    assert sorted((r["id_a"], r["id_b"], r["dist"]) for r in got) == [(i, i + 30, 0.0) for i in range(30)]


def test_search_ships_small_queries_and_blocks_large_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(90, 6)), rng.normal(size=(7, 6))
    base = to_df(spark, x).repartition(4)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id long, query_vector array<double>")
    d = pair_matrix(q, x, "sqeuclidean")
    want = {(i, r + 1): int(j) for i in range(7) for r, j in enumerate(np.argsort(d[i])[:5])}
    for limit in (N.MAX_SHIPPED_VALUES, 0):
        monkeypatch.setattr(N, "MAX_SHIPPED_VALUES", limit)
        got = {(r["query_id"], r["rank"]): r["id"] for r in N.knn_search(base, queries, 5, block_rows=32).collect()}
        assert got == want


@pytest.mark.parametrize("window", [2.5, 0.0])
def test_pairs_within_days_of_a_hot_day(spark, window):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(130, 4))
    day = [4.0] * 45 + [None if i % 9 == 0 else float(i % 40) / 2 for i in range(85)]
    rows = [(i, [float(v) for v in x[i]], day[i]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "pos long, embedding array<double>, date_days double")
    d = pair_matrix(x, x)
    got = {(r["id_a"], r["id_b"]): (r["gap_days"], r["dist"])
           for r in N.pairs_within_days(df, window, threshold=2.5, block_rows=16).collect()}
    want = {(i, j): abs(day[i] - day[j]) for i in range(len(x)) for j in range(i + 1, len(x))
            if day[i] is not None and day[j] is not None and abs(day[i] - day[j]) <= window and d[i, j] <= 2.5}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(v[1] - d[k]) < 1e-9 for k, v in got.items())
    assert N.pairs_within_days(df.limit(0), window, block_rows=16).count() == 0


def test_pairs_within_days_hold_one_block_pair_at_a_time(spark, monkeypatch):
    """Twenty blocks of one day, more than there are ranges: a task group returns the pairs of two blocks, not of ranges."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(160, 3))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 1.0) for i in range(len(x))],
                               "pos long, embedding array<double>, date_days double")
    one = N.pairs_cogroup

    def watched(points, pairs, reducer, schema, *rest, **more):
        def red(l, r, diag):
            out = reducer(l, r, diag)
            for name, rows, c in (("rl", l, "_rl"), ("rh", l, "_rh"), ("bl", l, "_blk"), ("bh", r, "r__blk")):
                out[name] = int(rows[c].iloc[0]) if len(out) else 0
            return out

        return one(points, pairs, red, schema + ", rl long, rh long, bl long, bh long", *rest, **more)

    monkeypatch.setattr(N, "pairs_cogroup", watched)
    got = N.pairs_within_days(df, 0.5, block_rows=8).toPandas()
    assert len(got) == 160 * 159 // 2
    assert got.groupby(["rl", "rh"])[["bl", "bh"]].nunique().max().max() == 1
    assert got.groupby(["rl", "rh"]).size().max() <= 64


def test_screened_products_find_the_nearest():
    """Average cosine links screened in single precision: the nearest of the whole matrix, whoever looks."""
    from clusterloom.operators import blocks as B

    rng = np.random.default_rng(12)
    x = rng.normal(size=(360, 16)) * rng.uniform(0.2, 1.0, size=(360, 1)) / 4
    need = rng.random(360) < 0.5
    rows = [pd.DataFrame({"_id": np.arange(a, a + 120), "_vec": list(x[a:a + 120]), "_need": need[a:a + 120]})
            for a in (0, 120, 240)]

    def links(l, r):
        return 1.0 - np.stack(l["_vec"]) @ np.stack(r["r__vec"]).T

    def run(**more):
        reducer = B.NearestReducer(1, links, **more)
        pairs = [(a, rows[a], b, B.as_right(rows[b])) for a in range(3) for b in range(a, 3)]
        return reducer.over(iter(pairs)).sort_values("id").reset_index(drop=True)

    for flag in (None, "_need"):
        plain, screened = run(need=flag), run(need=flag, screen=B.ProductScreen())
        assert len(plain) == (360 if flag is None else need.sum())
        assert (plain[["id", "nbr_id"]] == screened[["id", "nbr_id"]]).all().all()
        assert np.allclose(plain["dist"], screened["dist"], atol=1e-12)


def test_a_row_goes_to_ranges_of_blocks_not_to_every_block(spark, data, monkeypatch):
    """Thirty blocks in at most three ranges: the same pairs and neighbours, and rows copied three times instead of 31."""
    from pyspark.sql import functions as F

    from clusterloom.operators import blocks, cells

    x, _, df = data
    for module in (blocks, cells):
        monkeypatch.setattr(module, "MAX_RANGES", 3)

    def rows(l, r, diag):
        return pd.DataFrame({"n": [len(l) * len(r)], "same": [diag]})

    pts = df.select(F.col("pos").alias("_id"), F.col("embedding").alias("_vec"))
    met = blocks.self_block_cogroup(pts, rows, "n long, same boolean", 30, block_rows=4)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_rng" in plan  # the copies of a row are counted by ranges
    got = {(r["same"]): r["n"] for r in met.groupBy("same").agg(F.sum("n").alias("n")).collect()}
    assert got[True] + 2 * got[False] == len(x) ** 2
    ref = brute_force_knn(x, 4)
    for metric in ("euclidean", "sqeuclidean"):  # by cells and by a hash
        for r in N.knn_graph(df, 4, block_rows=4, metric=metric).collect():
            assert ref[r["id"]][r["rank"] - 1][0] == r["nbr_id"]
    d = pair_matrix(x, x)
    pairs = {(r["id_a"], r["id_b"]) for r in N.pairs_within(df, 2.0, block_rows=4).collect()}
    assert pairs == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 2.0}


def test_largest_distance_of_every_two_values(spark, data):
    x, y, df = data
    d = pair_matrix(x, x)
    np.fill_diagonal(d, -1.0)
    for block_rows in (16, 2048):  # values in pieces, and whole
        got = {(r["x"], r["y"]): r["dist"] for r in N.pair_distances(df, block_rows=block_rows, by="truth_label").collect()}
        assert set(got) == {(a, b) for a in range(4) for b in range(a, 4)}
        assert all(abs(v - d[np.ix_(y == a, y == b)].max()) < 1e-9 for (a, b), v in got.items())


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e3])
def test_screened_neighbours_are_those_of_the_matrix(scale):
    """Single precision only leaves links out; a block's rows may come in another order as the right side."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 24)) * scale
    x[:40] = x[100:140] + 1e-4 * scale * rng.normal(size=(40, 24))
    d = pair_matrix(x, x)
    rows = pd.DataFrame({"_id": np.arange(900), "_vec": list(x), "_comp": rng.integers(0, 300, 900),
                         "_core": np.sort(d, axis=1)[:, 3], "_need": rng.uniform(size=900) < 0.4,
                         "_size": rng.integers(1, 30, 900).astype(float)})
    lefts = [p.sample(frac=1, random_state=1) for _, p in rows.groupby(rows["_id"] % 3)]
    rights = [as_right(p.sample(frac=1, random_state=2)) for p in lefts]
    ids = np.arange(900)
    core, size, comp = (rows[c].to_numpy() for c in ("_core", "_size", "_comp"))
    mutual = np.maximum(np.maximum(d / 0.9, core[:, None]), core[None, :])
    ward = np.sqrt(2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :])) * d
    for red, want, apart, need in (
            (knn_reducer(3), d, ids, np.ones(900, bool)), (outside_reducer(8, 0.9), mutual, comp, rows["_need"].to_numpy()),
            (NearestReducer(1, _ward_links, need="_need", screen=Screen(size="_size")), ward, ids, rows["_need"].to_numpy())):
        matrices = []
        red.links = lambda l, r, links=red.links: matrices.append(1) or links(l, r)
        got = red.over((a, lefts[a], b, rights[b]) for a in range(3) for b in range(a, 3))
        assert not matrices
        want = np.where(apart[:, None] == apart[None, :], np.inf, want)
        for i, mine in got.groupby("id"):
            assert need[i] and np.allclose(mine["dist"], np.sort(want[i])[:red.k], rtol=1e-9)
            assert np.allclose(want[i, mine["nbr_id"]], mine["dist"], rtol=1e-9)
        assert got["id"].nunique() == need.sum()
