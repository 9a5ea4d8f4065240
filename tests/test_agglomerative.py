"""Agglomerative linkages against a naive sequential numpy implementation."""

import numpy as np
import pytest

from clusterloom.operators import agglomerative as A
from clusterloom.operators.blocks import pair_matrix
from helpers import planted, to_df


def naive(x, linkage, k, metric="euclidean"):
    clusters = {i: [i] for i in range(len(x))}
    d = pair_matrix(x, x, metric)
    heights = []

    def link(p, q):
        a, b = clusters[p], clusters[q]
        if linkage == "average":
            return d[np.ix_(a, b)].mean()
        if linkage == "complete":
            return d[np.ix_(a, b)].max()
        ca, cb = x[a].mean(0), x[b].mean(0)
        return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(ca - cb)

    while len(clusters) > 1:
        keys = sorted(clusters)
        best = min((link(p, q), p, q) for i, p in enumerate(keys) for q in keys[i + 1:])
        h, p, q = best
        heights.append(h)
        clusters[p] = clusters[p] + clusters.pop(q)
        if len(clusters) == k:
            snapshot = [sorted(v) for v in clusters.values()]
    return sorted(heights), sorted(snapshot)


@pytest.mark.parametrize("linkage,block_rows", [("ward", 8), ("average", 8), ("complete", 2048)])
def test_linkage_matches_naive(spark, linkage, block_rows):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 4))
    df = to_df(spark, x)
    labels, merges = A.agglomerative(df, n_clusters=4, linkage=linkage, block_rows=block_rows)
    want_h, want_parts = naive(x, linkage, 4)
    got_h = sorted(r["height"] for r in merges.collect())
    assert np.allclose(got_h, want_h)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["label"], []).append(r["pos"])
    assert sorted(sorted(v) for v in parts.values()) == want_parts


@pytest.mark.parametrize("linkage,metric,block_rows", [
    ("average", "euclidean", 5), ("average", "cosine", 5), ("complete", "cosine", 2048)])
def test_rounds_by_bounds_give_the_naive_dendrogram(spark, monkeypatch, linkage, metric, block_rows):
    """Rounds down to three clusters in blocks and chunks of a few rows; equal rows and a zero vector among them."""
    monkeypatch.setattr(A, "TAIL", 3)
    rng = np.random.default_rng(23)
    x = np.vstack([rng.normal(size=(12, 3)) + rng.normal(size=(4, 3))[rng.integers(4, size=12)] * 2, np.zeros((1, 3))])
    x = np.vstack([x, x[:2]])
    labels, merges = A.agglomerative(to_df(spark, x), n_clusters=5, linkage=linkage, metric=metric, block_rows=block_rows)
    want_h, want_parts = naive(x, linkage, 5, metric)
    assert np.allclose(sorted(r["height"] for r in merges.collect()), want_h, atol=1e-7)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["label"], []).append(r["pos"])
    assert sorted(sorted(v) for v in parts.values()) == want_parts


@pytest.mark.parametrize("linkage,metric", [("average", "euclidean"), ("average", "cosine"), ("average", "sqeuclidean"),
                                            ("complete", "manhattan"), ("complete", "cosine")])
def test_last_clusters_are_merged_like_the_rest(spark, linkage, metric):
    rng = np.random.default_rng(29)
    x = np.vstack([rng.normal(size=(40, 3)) + rng.normal(size=(5, 3))[rng.integers(5, size=40)] * 2, np.zeros((1, 3))])
    x = np.vstack([x, x[:3]])
    labels, merges = A.agglomerative(to_df(spark, x), n_clusters=5, linkage=linkage, metric=metric, block_rows=9)
    want_h, want_parts = naive(x, linkage, 5, metric)
    assert np.allclose(sorted(r["height"] for r in merges.collect()), want_h, atol=1e-7)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["label"], []).append(r["pos"])
    assert sorted(sorted(v) for v in parts.values()) == want_parts


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_link_bounds_hold(linkage, metric):
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.normal(rng.normal(size=4) * 2, rng.uniform(0, 1.5), (int(rng.integers(1, 9)), 4)) for _ in "ab")
        if metric == "cosine":
            a, b = (p / np.linalg.norm(p, axis=1, keepdims=True) for p in (a, b))
        sides = []
        for p in (a, b):
            off = p - p.mean(axis=0)
            far = np.abs(off).sum(axis=1) if metric == "manhattan" else np.linalg.norm(off, axis=1)
            sides.append((p.mean(axis=0)[None], np.array([far.mean() if metric == "manhattan" else (far ** 2).mean()]),
                          np.array([far.max()])))
        lo, hi = A._link(linkage, metric, *sides)
        d = pair_matrix(a, b, metric)
        true = d.mean() if linkage == "average" else d.max()
        assert lo[0, 0] - 1e-9 <= true <= hi[0, 0] + 1e-9
        if linkage == "average" and metric in ("cosine", "sqeuclidean"):
            assert lo[0, 0] == pytest.approx(true)


def test_threshold_wins_and_errors(spark):
    x, y = planted(n_per=10, k=3, dim=6, noise=0.02)
    df = to_df(spark, x, y)
    labels, _ = A.agglomerative(df, n_clusters=9, distance_threshold=1.0, linkage="average")
    assert labels.select("label").distinct().count() == 3
    with pytest.raises(ValueError):
        A.agglomerative(df, linkage="average")
    with pytest.raises(ValueError):
        A.agglomerative(df, n_clusters=2, linkage="ward", metric="cosine")


def test_groups_are_clustered_on_their_own(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 3))
    df = to_df(spark, x).selectExpr("*", "cast(pos % 2 as int) as half")
    for linkage in ("ward", "average"):
        labels, merges = A.agglomerative(df, n_clusters=3, linkage=linkage, group="half")
        assert merges.count() == 22
        parts = {}
        for r in labels.collect():
            parts.setdefault(r["label"], []).append(r["pos"])
        want = [[int(i) * 2 + h for i in p] for h in (0, 1) for p in naive(x[h::2], linkage, 3)[1]]
        assert sorted(map(sorted, parts.values())) == sorted(want)


def test_equal_rows_merge_at_once_and_open_links_in_blocks(spark, monkeypatch):
    """Ninety equal rows take no round each, and links that the bounds leave open come from all points in blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(24, 5))
    x = np.vstack([x, np.repeat(x[:3], 30, axis=0)])
    df = to_df(spark, x)
    monkeypatch.setattr(A, "TAIL", 12)
    monkeypatch.setattr(A, "OPEN_ROWS", 0)
    rounds, one = [], A._nearest_by
    monkeypatch.setattr(A, "_nearest_by", lambda *a: rounds.append(1) or one(*a))
    for linkage, metric, rows in (("complete", "manhattan", 16), ("ward", "euclidean", 512)):
        rounds.clear()
        heights = sorted(r["height"] for r in A.dendrogram(df, linkage, metric, block_rows=rows).collect())
        assert len(heights) == len(x) - 1 and heights[:90] == [0.0] * 90
        assert len(rounds) < 20
        d = pair_matrix(x, x, metric)
        groups = [[i] for i in range(len(x))]

        def link(a, b):
            if linkage == "ward":
                return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
            m = d[np.ix_(a, b)]
            return m.max() if linkage == "complete" else m.mean()
        for i in range(3):  # the copies first
            groups[i] += list(range(24 + 30 * i, 54 + 30 * i))
        groups = groups[:24]
        want = [0.0] * 90
        while len(groups) > 1:
            h, i, j = min((link(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
            want.append(h)
            groups[j] += groups.pop(i)
        assert np.allclose(heights, sorted(want), atol=1e-9)


def test_ward_rounds_look_only_where_something_changed(spark, monkeypatch):
    """Rounds down to four clusters, several blocks: the naive dendrogram, though most clusters keep their nearest."""
    rng = np.random.default_rng(31)
    x = np.vstack([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(1, 4)), 3, axis=0)])
    monkeypatch.setattr(A, "TAIL", 2)
    monkeypatch.setattr(A, "WARD_TAILS", 2)
    looks, one = [], A._nearest_by

    def watched(cl, links, k, *rest):
        looks.append((cl.where("_need").count(), k))
        return one(cl, links, k, *rest)

    monkeypatch.setattr(A, "_nearest_by", watched)
    labels, merges = A.agglomerative(to_df(spark, x), n_clusters=6, block_rows=16)
    want_h, want_parts = naive(x, "ward", 6)
    assert np.allclose(sorted(r["height"] for r in merges.collect()), want_h)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["label"], []).append(r["pos"])
    assert sorted(sorted(v) for v in parts.values()) == want_parts
    assert looks[0] == (61, 61) and len(looks) > 3
    assert sum(n for n, _ in looks[1:]) < 0.8 * sum(k for _, k in looks[1:])


@pytest.mark.parametrize("linkage,metric,open_rows", [
    ("average", "cosine", 32), ("average", "euclidean", 1000), ("complete", "manhattan", 0)])
def test_bounded_rounds_look_only_where_something_changed(spark, monkeypatch, linkage, metric, open_rows):
    """Rounds down to eight clusters, several blocks, links by the points or by bounds: the naive dendrogram."""
    rng = np.random.default_rng(37)
    x = np.vstack([rng.normal(size=(27, 4)), np.repeat(rng.normal(size=(1, 4)), 5, axis=0)])
    monkeypatch.setattr(A, "TAIL", 4)
    monkeypatch.setattr(A, "WARD_TAILS", 2)
    monkeypatch.setattr(A, "OPEN_ROWS", open_rows)
    looks, mark = [], A._marked

    def watched(cl, kept):
        out = mark(cl, kept)
        looks.append((out.where("_need").count(), out.count()))
        return out

    monkeypatch.setattr(A, "_marked", watched)
    labels, merges = A.agglomerative(to_df(spark, x), n_clusters=6, linkage=linkage, metric=metric, block_rows=16)
    want_h, want_parts = naive(x, linkage, 6, metric)
    assert np.allclose(sorted(r["height"] for r in merges.collect()), want_h, atol=1e-7)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["label"], []).append(r["pos"])
    assert sorted(sorted(v) for v in parts.values()) == want_parts
    assert looks[0] == (28, 28) and len(looks) > 2
    assert sum(n for n, _ in looks[1:]) < sum(k for _, k in looks[1:])


@pytest.mark.parametrize("linkage,metric", [("average", "cosine"), ("average", "euclidean"), ("complete", "manhattan")])
def test_more_clusters_are_finished_in_one_task(spark, monkeypatch, linkage, metric):
    """Sixty clusters are above ``TAIL`` and below the size of the last matrix: no round, the same dendrogram."""
    rng = np.random.default_rng(41)
    x = rng.normal(size=(60, 4))
    monkeypatch.setattr(A, "TAIL", 8)
    rounds, one = [], A._nearest_by
    monkeypatch.setattr(A, "_nearest_by", lambda *a: rounds.append(1) or one(*a))
    heights = sorted(r["height"] for r in A.dendrogram(to_df(spark, x), linkage, metric, block_rows=16).collect())
    assert np.allclose(heights, naive(x, linkage, 6, metric)[0], atol=1e-7)
    assert not rounds


def test_rows_that_repeat_an_id_are_one_cluster(spark):
    rng = np.random.default_rng(43)
    x = rng.normal(size=(12, 3))
    df = to_df(spark, x)
    heights = sorted(r["height"] for r in A.dendrogram(df.union(df.limit(3)), "complete", "manhattan", block_rows=8).collect())
    assert np.allclose(heights, naive(x, "complete", 3, "manhattan")[0])
