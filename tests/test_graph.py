"""Connected components, Boruvka MST and single linkage against brute force."""

import numpy as np

from clusterloom.operators import graph as G
from clusterloom.operators.blocks import pair_matrix
from helpers import planted, to_df


def prim_weight(d):
    n = len(d)
    seen = np.zeros(n, bool)
    best = np.full(n, np.inf)
    best[0] = 0
    total = 0.0
    for _ in range(n):
        i = int(np.argmin(np.where(seen, np.inf, best)))
        total += best[i]
        seen[i] = True
        best = np.minimum(best, d[i])
    return total


def test_connected_components_chain_and_isolated(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (7, 6)], "src long, dst long")
    v = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, 6, 7, 10, 11, 12]], "id long")
    got = dict(map(tuple, G.connected_components(v, e).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 10: 10, 11: 10, 12: 12}


def test_mst_weight_matches_prim(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    df = to_df(spark, x)
    mst = G.minimum_spanning_forest(df, block_rows=16).collect()
    assert len(mst) == 59
    assert abs(sum(r["w"] for r in mst) - prim_weight(pair_matrix(x, x))) < 1e-9


def test_mutual_reachability_mst(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    df = to_df(spark, x)
    cores = G.core_distances(df, 3, block_rows=16)
    mst = G.minimum_spanning_forest(df, cores=cores, block_rows=16).collect()
    d = pair_matrix(x, x)
    core = np.sort(d, axis=1)[:, 3]
    mr = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    np.fill_diagonal(mr, 0)
    assert len(mst) == 39
    assert abs(sum(r["w"] for r in mst) - prim_weight(mr)) < 1e-9


def test_single_linkage_recovers_planted(spark):
    x, y = planted(n_per=15, k=3, dim=8, noise=0.02)
    df = to_df(spark, x, y)
    lab = {r["pos"]: r["label"] for r in G.single_linkage(df, n_clusters=3, block_rows=16).collect()}
    groups = {}
    for pos, lbl in lab.items():
        groups.setdefault(lbl, set()).add(y[pos])
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def test_prefix_count_multi_chunk(spark):
    from clusterloom.operators.profiles import prefix_count

    rows = [(i, i % 3 == 0) for i in range(1, 51)]
    df = spark.createDataFrame(rows, "g long, f boolean")
    got = {r["g"]: r["c"] for r in prefix_count(df, "g", "f", "c", chunk=7).collect()}
    run = 0
    for i, f in rows:
        run += int(f)
        assert got[i] == run


def test_component_reducer_returns_a_forest():
    """Chains, a clique and lone rows: fewer edges than rows, and the same components as all links give."""
    import pandas as pd

    from clusterloom.operators.blocks import component_reducer, within_reducer

    rng = np.random.default_rng(2)
    x = np.concatenate([np.arange(40) * 0.9, 200 + rng.uniform(0, 0.5, 60), 500 + np.arange(10) * 7.0])[:, None]
    ids = rng.permutation(len(x)) + 1000
    l = pd.DataFrame({"_id": ids, "_vec": list(x)})
    r = l.rename(columns={"_id": "r__id", "_vec": "r__vec"})
    edges, links = component_reducer(1.0)(l, r, True), within_reducer(1.0)(l, r, True)
    assert len(edges) == 39 + 59 and len(links) > 1500

    def groups(pairs):
        up = {i: i for i in ids.tolist()}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in zip(pairs["id_a"].tolist(), pairs["id_b"].tolist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return [root(i) for i in ids.tolist()]
    assert groups(edges) == groups(links)
    assert len(component_reducer(1.0)(l.iloc[:0], r.iloc[:0], False)) == 0


def test_few_passes_and_equal_rows(spark, monkeypatch):
    """Lists of cheapest edges take several rounds from one pass; forty copies of a row need no pass of their own."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 6))
    x[100:140] = x[0]
    passes, one = [], G._cheapest_outside
    monkeypatch.setattr(G, "_cheapest_outside", lambda *a: passes.append(1) or one(*a))
    mst = G.minimum_spanning_forest(to_df(spark, x), block_rows=16).collect()
    assert len(mst) == 149 and len({(r["lo"], r["hi"]) for r in mst}) == 149
    assert abs(sum(r["w"] for r in mst) - prim_weight(pair_matrix(x, x))) < 1e-9
    assert {(r["lo"], r["hi"]) for r in mst if r["w"] == 0} == {(0, i) for i in range(100, 140)}
    assert len(passes) <= 4


def test_listed_rounds_are_the_same_in_one_task_and_in_many(spark, monkeypatch):
    """Ties (a lattice), equal rows and several blocks; one component left needs no further pass."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.integers(0, 4, size=(60, 3)).astype(float), rng.normal(size=(40, 3)) + 9.0])
    df = to_df(spark, x)
    passes, one = [], G._cheapest_outside
    monkeypatch.setattr(G, "_cheapest_outside", lambda *a: passes.append(1) or one(*a))
    found = []
    for rows in (0, 1 << 19):
        monkeypatch.setattr(G, "LIST_ROWS", rows)
        passes.clear()
        found.append(sorted((r["lo"], r["hi"], round(r["w"], 9)) for r in G.minimum_spanning_forest(df, block_rows=16).collect()))
    assert found[0] == found[1] and len(found[0]) == 99
    assert abs(sum(w for _, _, w in found[0]) - prim_weight(pair_matrix(x, x))) < 1e-6
    passes.clear()
    G.minimum_spanning_forest(to_df(spark, rng.normal(size=(5, 2))), block_rows=16)
    assert len(passes) == 1
