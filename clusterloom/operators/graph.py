"""Graph operators: connected components (C5), core distances and mutual
reachability (C6a, C6b), Boruvka minimum spanning forest (C6c) and the
single-linkage cuts that follow from it (C4 single, C5 threshold groups).

Connected components use the alternating large-star / small-star rounds of
Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014):
each round is one ``groupBy`` (a partial ``min``) and one equi-join, the number
of rounds is O(log^2 n), and lineage is cut with a reliable checkpoint every
round. A hub vertex of huge degree only ever appears as a join key whose other
side is a single row, which AQE's skew handling splits.

Boruvka: a pass of the blocked pair primitive keeps for every row its ``NEAR``
cheapest edges to other components (the O(n^2) candidate edges are never
materialised). Rounds on these lists merge components for as long as the lists
show some component's cheapest edge: it is no worse than the last edge of every
full list of its rows, behind which cheaper ones could lie. The graph of the lists
shrinks with the components. Then the next pass lists edges anew, but not for the
rows of the largest component (of each group), which the others choose. A pass shows
the cheapest edge of every component it lists, so there are O(log n) passes at worst,
and few where rows have neighbours beyond their own component. Ties break by (weight,
min id, max id), which makes the spanning tree unique and the selected edges cycle-free.
Rows with the very same vector and no distance between them are one row in all passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.operators.blocks import (DEFAULT_BLOCK_ROWS, component_reducer, equal_rows, n_blocks_for,
                                          outside_reducer, self_block_cogroup)
from clusterloom.session import cut_lineage

#: Edges that a pass over all pairs lists for a row of the spanning forest.
NEAR = 8
#: Rounds on so many listed edges or fewer, a constant number, are done in one task.
LIST_ROWS = 1 << 19


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    m = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (sym.where(F.col("v") > F.col("u")).join(m, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    m = o.groupBy("u").agg(F.min("v").alias("m"))
    j = o.join(m, "u")
    out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    out = out.union(j.select("u", F.col("m").alias("v")))
    return out.distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Converged when every vertex points at one root and no root points anywhere.

    Then e (oriented u > v) maps every non-root vertex to its component minimum
    and a further large-star / small-star round changes nothing. One job.
    """
    multi = e.groupBy("u").agg(F.count_distinct("v").alias("n")).where(F.col("n") > 1).select("u")
    chained = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
    return multi.union(chained).isEmpty()


def connected_components(vertices: DataFrame, edges: DataFrame, vid: str = "id", src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """``vid, component`` where component = smallest vertex id of the component.

    Isolated vertices are their own component. O(log^2 n) rounds.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where(
        F.col("u") != F.col("v")).distinct()
    e = cut_lineage(e)
    while True:
        e = cut_lineage(_small_star(_large_star(e)))
        if _is_star_forest(e):
            break
    comp = (e.union(e.select(F.col("v").alias("u"), F.col("v")))
            .groupBy("u").agg(F.min("v").alias("component")))
    return (vertices.select(F.col(vid).cast("long").alias(vid)).distinct()
            .join(comp.withColumnRenamed("u", vid), vid, "left")
            .select(vid, F.coalesce(F.col("component"), F.col(vid)).alias("component")))


def threshold_components(df: DataFrame, threshold: float, id_col: str = "pos", vec: str = "embedding",
                         metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C5 on the graph of pairs within ``threshold`` (single-linkage cut / duplicate groups).

    A block pair returns a forest of what hangs together in it, so at most rows x blocks edges are written,
    however dense the graph is.
    """
    from clusterloom.operators.neighbors import reduce_within

    pts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_vec"))
    edges = reduce_within(pts, threshold, component_reducer(threshold, metric), "id_a long, id_b long", metric, block_rows)
    return connected_components(df.select(F.col(id_col).alias("id")), edges, "id", "id_a", "id_b")


def core_distances(df: DataFrame, min_samples: int = 3, id_col: str = "pos", vec: str = "embedding",
                   metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS,
                   group: str | None = None) -> DataFrame:
    """Distance to the ``min_samples``-th nearest other point (of its group), or to the last
    where there are fewer; a lone point has none."""
    from clusterloom.operators.neighbors import knn_graph

    g = knn_graph(df, int(min_samples), id_col, vec, metric, block_rows, group)
    return g.groupBy(F.col("id").alias(id_col)).agg(F.max("dist").alias("core_distance"))


def mutual_reachability(pairs: DataFrame, cores: DataFrame, alpha: float = 1.0, id_col: str = "pos") -> DataFrame:
    """max(core_a, core_b, d / alpha) on a pair table ``id_a, id_b, dist``."""
    ca = cores.select(F.col(id_col).alias("id_a"), F.col("core_distance").alias("core_a"))
    cb = cores.select(F.col(id_col).alias("id_b"), F.col("core_distance").alias("core_b"))
    return (pairs.join(ca, "id_a").join(cb, "id_b")
            .withColumn("mreach", F.greatest("core_a", "core_b", F.col("dist") / F.lit(float(alpha)))))


def _hook_and_jump(parent: DataFrame) -> DataFrame:
    """Roots of the functional graph c -> p chosen by Boruvka (``c, root`` rows).

    A component points at the component across its cheapest edge, or chose none and is
    a root; the only cycles are mutual pairs (both chose the same edge), whose smaller id
    becomes the root. Pointer jumping p <- p(p) then halves every path per round.
    """
    pp = parent.join(parent.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p", "left")
    p = pp.select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c"))
                  .otherwise(F.col("p")).alias("p"))
    p = cut_lineage(p)
    while True:
        step = p.join(p.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p", "left").select(
            "c", "p", F.coalesce(F.col("pp"), F.col("p")).alias("pp"))
        step = cut_lineage(step)
        if step.where(F.col("pp") != F.col("p")).isEmpty():
            return step.select("c", F.col("p").alias("root"))
        p = step.select("c", F.col("pp").alias("p"))


def _cheapest_outside(pts: DataFrame, reducer, n_blocks: int, grouped: bool, block_rows: int) -> DataFrame:
    """``c, o, w, lo, hi``: between components the cheapest listed edges, and for ``o`` null the end of a list
    that may not hold all edges."""
    found = self_block_cogroup(pts, reducer, "id long, nbr_id long, dist double", n_blocks,
                               group="_grp" if grouped else None, block_rows=block_rows)
    w = Window.partitionBy("id").orderBy("dist", "nbr_id")
    ranked = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= NEAR)
    comps = pts.select("_id", "_comp")
    edges = (ranked.join(comps.select(F.col("_id").alias("id"), F.col("_comp").alias("c")), "id")
             .join(comps.select(F.col("_id").alias("nbr_id"), F.col("_comp").alias("o")), "nbr_id")
             .select("c", "o", F.col("dist").alias("w"), F.least("id", "nbr_id").alias("lo"),
                     F.greatest("id", "nbr_id").alias("hi"), "_r"))
    ends = edges.where(F.col("_r") == NEAR).withColumn("o", F.lit(None).cast("long"))
    return _cheapest(edges.unionByName(ends))


def _cheapest(links: DataFrame) -> DataFrame:
    return cut_lineage(links.groupBy("c", "o").agg(F.min(F.struct("w", "lo", "hi")).alias("e"))
                       .select("c", "o", "e.w", "e.lo", "e.hi"))


def _rounds_locally(links: pd.DataFrame) -> pd.DataFrame:
    """All the rounds of ``_list_rounds`` on a bounded number of edges: rows ``c, root`` and rows ``lo, hi, w``."""
    c, beyond = links["c"].to_numpy(np.int64), links["o"].isna().to_numpy()
    o = np.where(beyond, c, links["o"].fillna(0).to_numpy(np.int64))
    w, lo, hi = links["w"].to_numpy(np.float64), links["lo"].to_numpy(np.int64), links["hi"].to_numpy(np.int64)
    ids, at = np.unique(np.concatenate([c, o]), return_inverse=True)
    c, o = at[:len(c)], np.where(beyond, -1, at[len(c):])
    own = np.arange(len(ids))
    root, edges = own, [(lo[:0], hi[:0], w[:0])]
    while True:
        # the cheapest edge of two components, the ends of lists after edges that equal them
        order = np.lexsort((o < 0, hi, lo, w, c))
        first = order[np.r_[True, np.diff(c[order]) != 0][:len(order)]]
        first = first[o[first] >= 0]
        if not len(first):
            break
        edges.append((lo[first], hi[first], w[first]))
        to = own.copy()
        to[c[first]] = o[first]
        mutual = (to[to] == own) & (own < to)
        to[mutual] = own[mutual]
        while (to[to] != to).any():
            to = to[to]
        root, c, o = to[root], to[c], np.where(o < 0, -1, to[o])
        c, o, w, lo, hi = (v[c != o] for v in (c, o, w, lo, hi))
        order = np.lexsort((hi, lo, w, o, c))
        order = order[np.r_[True, (np.diff(c[order]) != 0) | (np.diff(o[order]) != 0)][:len(order)]]
        c, o, w, lo, hi = (v[order] for v in (c, o, w, lo, hi))
    gone = np.flatnonzero(root != own)
    lo, hi, w = (np.concatenate(v) for v in zip(*edges))
    chosen = pd.DataFrame({"lo": lo, "hi": hi, "w": w}).drop_duplicates(["lo", "hi"]).astype({"lo": "Int64", "hi": "Int64"})
    return pd.concat([pd.DataFrame({"c": ids[gone], "root": ids[root[gone]]}, dtype="Int64"), chosen], ignore_index=True)


def _list_rounds(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boruvka rounds on listed edges: the edges chosen, ``lo, hi, w``, and where components went, ``c, root``."""
    forest, moved = None, None
    while True:
        last = links.count() <= LIST_ROWS
        if last:
            done = cut_lineage(links.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
                lambda pdf: _rounds_locally(pdf), "c long, root long, lo long, hi long, w double"))
            chosen, roots = done.where(F.col("lo").isNotNull()).select("lo", "hi", "w"), done.where(F.col("c").isNotNull())
            if chosen.isEmpty():
                return forest, moved
            roots = roots.select("c", "root")
        else:
            # a component's cheapest edge, unless a list ends before it
            best = cut_lineage(links.groupBy("c").agg(F.min(F.struct(
                "w", "lo", "hi", F.col("o").isNull().alias("beyond"), "o")).alias("e")).where(~F.col("e.beyond"))
                .select("c", "e.w", "e.lo", "e.hi", "e.o"))
            if best.isEmpty():
                return forest, moved
            chosen = best.groupBy("lo", "hi").agg(F.min("w").alias("w"))
            roots = cut_lineage(_hook_and_jump(best.select("c", F.col("o").alias("p"))))
        forest = cut_lineage(chosen if forest is None else forest.union(chosen))
        if moved is None:
            moved = roots
        else:  # components that went before go on from where they are
            moved = moved.withColumnRenamed("c", "_from").withColumnRenamed("root", "c").join(roots, "c", "left").select(
                F.col("_from").alias("c"), F.coalesce("root", "c").alias("root")).union(
                roots.join(moved.select("c"), "c", "left_anti"))
            moved = cut_lineage(moved)
        if last:
            return forest, moved
        for side in ("c", "o"):
            links = links.join(roots.select(F.col("c").alias(side), "root"), side, "left").withColumn(
                side, F.coalesce("root", side)).drop("root")
        links = _cheapest(links.where(F.col("o").isNull() | (F.col("c") != F.col("o"))))


def minimum_spanning_forest(df: DataFrame, id_col: str = "pos", vec: str = "embedding",
                            cores: DataFrame | None = None, alpha: float = 1.0, metric: str = "euclidean",
                            block_rows: int = DEFAULT_BLOCK_ROWS, group: str | None = None) -> DataFrame:
    """Boruvka MST of the complete graph (mutual reachability when ``cores`` given).

    Returns ``lo, hi, w`` edges: n - 1, or n minus the number of groups where ``group`` is
    given and only rows of a group are joined.
    """
    pts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_vec"),
                    *([F.col(group).alias("_grp")] if group else []))
    use_core = cores is not None
    if use_core:
        pts = pts.join(cores.select(F.col(id_col).cast("long").alias("_id"),
                                    F.col("core_distance").alias("_core")), "_id")
    pts = cut_lineage(pts.withColumn("_comp", F.col("_id")).withColumn("_need", F.lit(True)))
    # equal rows at distance 0 all hang on the smallest id, as the order of edges has it
    alike = pts.where(F.col("_core") == 0) if use_core else pts
    equal = cut_lineage(equal_rows(alike, ["_grp"] if group else []))
    forest = None
    if not equal.isEmpty():
        forest = equal.select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(0.0).alias("w"))
        pts = cut_lineage(pts.join(equal.select(F.col("b").alias("_id")), "_id", "left_anti"))
    B = 0 if group else n_blocks_for(pts, block_rows)
    while True:  # a pass at least halves the components that chose
        lists = _cheapest_outside(pts, outside_reducer(NEAR, alpha, metric, use_core), B, bool(group), block_rows)
        if lists.isEmpty():
            break
        chosen, moved = _list_rounds(lists)
        forest = chosen if forest is None else cut_lineage(forest.union(chosen))
        pts = pts.join(moved.withColumnRenamed("c", "_comp"), "_comp", "left").withColumn(
            "_comp", F.coalesce("root", "_comp")).drop("root", "_need")
        grp = ["_grp"] if group else []
        sizes = cut_lineage(pts.groupBy("_comp", *grp).count().withColumn("_at", F.col("_grp") if group else F.lit(0)))
        largest = sizes.groupBy("_at").agg(F.max_by("_comp", F.struct("count", "_comp")).alias("_largest"))
        need = sizes.join(largest, "_at").groupBy("_comp").agg(F.max(F.col("_comp") != F.col("_largest")).alias("_need"))
        need = cut_lineage(need)
        if need.where("_need").isEmpty():  # one component (of each group)
            break
        pts = cut_lineage(pts.join(need, "_comp"))
    if forest is None:
        return df.sparkSession.createDataFrame([], "lo long, hi long, w double")
    return forest


def single_linkage(df: DataFrame, n_clusters: int | None = None, distance_threshold: float | None = None,
                   id_col: str = "pos", vec: str = "embedding", metric: str = "euclidean",
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C4 with single linkage: cut the Euclidean MST.

    threshold wins when both are given: drop edges heavier than it; otherwise
    drop the n_clusters - 1 heaviest edges (a top-k on the edge list). The
    remaining forest's components are the clusters. Labels are canonical
    (size desc, min id). Output ``<id_col>, label``.
    """
    from clusterloom.operators.kmeans import canonical_labels

    if n_clusters is None and distance_threshold is None:
        raise ValueError("agglomerative clustering needs n_clusters or distance_threshold")
    mst = minimum_spanning_forest(df, id_col, vec, metric=metric, block_rows=block_rows)
    if distance_threshold is not None:
        keep = mst.where(F.col("w") <= F.lit(float(distance_threshold)))
    else:
        n = df.count()
        cut = max(0, min(int(n_clusters), n) - 1)
        heaviest = mst.orderBy(F.desc("w"), F.desc("lo"), F.desc("hi")).limit(cut)
        keep = mst.join(heaviest, ["lo", "hi"], "left_anti")
    comps = connected_components(df.select(F.col(id_col).alias("id")), keep, "id", "lo", "hi")
    lab = comps.select(F.col("id").alias(id_col), F.col("component").alias("label"))
    return canonical_labels(lab.withColumn("item_key", F.col(id_col)), "item_key").drop("item_key")
