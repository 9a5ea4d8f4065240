"""Agglomerative clustering (C4) with ward, average, complete and single linkage, and A9.

Ward, average and complete linkage are reducible, so merging *every* pair of
reciprocal nearest neighbours in a round gives the same dendrogram as merging
one pair at a time (Murtagh 1983), provided ties break the same way (here by
(distance, cluster id)). Each round is a handful of DataFrame operations:

* ward: no pair table at all. Clusters are (id, centroid, size) rows; each
  round finds every cluster's nearest cluster under the ward distance
  sqrt(2 n_a n_b / (n_a + n_b)) * |c_a - c_b| with the blocked pair primitive,
  merges reciprocal pairs (weighted centroid, summed size) and repeats. No merge brings a cluster nearer to
  another than its nearest was, so only new clusters and those whose nearest was merged look again.
  The same holds for average and complete links.
* average / complete: no pair table either. Clusters are (id, mean, size, spread, radius) rows, and the
  link of two clusters follows from them or is bounded by them (``_link``): the average cosine or squared
  Euclidean distance is exact algebra on means, sizes and variances; the average Euclidean distance lies
  between the distance of the means and the root of the average square (Jensen), the average L1 distance
  within the mean deviations, and a complete link between the average and the distance plus both radii.
  A round finds for every cluster the pairs that the bounds leave open, in blocks, and only those are
  computed from their points (chunks of bounded size meet chunks); mostly there are few. A merged row
  follows from its two parts by join, without the points.
* single: the minimum spanning tree (operators/graph.py).

The last ``WARD_TAILS`` times ``TAIL`` clusters, a constant number whatever the rows behind them, have their links
computed in blocks (in the task, where the rows decide them: ward, average cosine) and are merged one pair at a time in
a matrix (Lance-Williams), which saves the many late rounds with few merges.

Merged clusters take the smaller id, so a merge (a, b, height) is also an edge
between two real items. Cutting the dendrogram at k clusters drops the k - 1
highest merges (heights are monotone for these linkages); a threshold keeps the
merges at or below it; connected components of the kept edges are the clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.blocks import (DEFAULT_BLOCK_ROWS, NearestReducer, ProductScreen, Screen, _stack, _topk_rows, as_right,
                                          equal_rows, pair_matrix, place_whole, self_block_cogroup, value_links)
from clusterloom.session import cut_lineage

LINKAGES = ("ward", "average", "complete", "single")
#: So many clusters (of a group) or fewer are finished in one task, from their links: a matrix of this size squared.
TAIL = 256
#: The last clusters are so many times ``TAIL`` (128 MB for 4,096 squared), but for groups with links from the points.
#: Ward's rows go to the task, not links, as others do that decide the links.
WARD_TAILS = 16
#: Open pairs of clusters are computed one by one up to this many rows for each row; beyond it, all pairs in blocks.
OPEN_ROWS = 32


def _nearest_by(cl: DataFrame, links, k: int, block_rows: int, group: str | None, need: str | None = None,
                screen: Screen | None = None) -> DataFrame:
    """``c, nn, d``: each cluster's nearest by the link matrix ``links`` of two blocks of cluster rows, ties by id
    (with ``need`` only of clusters with that flag)."""
    found = self_block_cogroup(cl, NearestReducer(1, links, need=need, screen=screen), "id long, nbr_id long, dist double",
                               max(1, -(-k // block_rows)), group="_grp" if group else None, block_rows=block_rows)
    return _nearest(found.toDF("c", "nn", "d"))


def _nearest(nn_rows: DataFrame) -> DataFrame:
    return (nn_rows.groupBy("c").agg(F.min(F.struct("d", "nn")).alias("b"))
            .select("c", F.col("b.nn").alias("nn"), F.col("b.d").alias("d")))


def _marked(cl: DataFrame, kept: DataFrame | None) -> DataFrame:
    """``cl`` with ``_need``: whether a cluster looks for its nearest, as ``kept`` (``c, nn, d``) doesn't have it."""
    if kept is None:
        return cl.withColumn("_need", F.lit(True))
    known = kept.select(F.col("c").alias("_id"), F.lit(True).alias("_kept"))
    return cl.join(known, "_id", "left").withColumn("_need", F.col("_kept").isNull()).drop("_kept")


def _kept(nearest: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``nearest`` that merging ``pairs`` leaves as they are: neither the cluster nor its nearest is merged."""
    gone = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("c")))
    return nearest.join(gone, "c", "left_anti").join(gone.withColumnRenamed("c", "nn"), "nn", "left_anti").select(
        "c", "nn", "d")


def _reciprocal(nn: DataFrame) -> DataFrame:
    """Pairs a < b that are each other's nearest: ``a, b, height``."""
    other = nn.select(F.col("c").alias("nn"), F.col("nn").alias("back"))
    return (nn.join(other, "nn").where((F.col("back") == F.col("c")) & (F.col("c") < F.col("nn")))
            .select(F.col("c").alias("a"), F.col("nn").alias("b"), F.col("d").alias("height")))


# ----------------------------------------------------------------- the last clusters

def _most(cl: DataFrame, k: int, group: str | None) -> int:
    """Clusters of the group that has most."""
    return (cl.groupBy("_grp").count().agg(F.max("count")).first()[0] or 0) if group else k


def _link_schema(cl: DataFrame, group: str | None) -> str:
    kind = cl.schema["_grp"].dataType.simpleString() if group else "int"
    return f"_grp {kind}, a long, b long, d double"


def _ward_links(l: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
    nl, nr = l["_size"].to_numpy(np.float64), r["r__size"].to_numpy(np.float64)
    return np.sqrt(2.0 * nl[:, None] * nr[None, :] / (nl[:, None] + nr[None, :])) * pair_matrix(
        _stack(l["_vec"]), _stack(r["r__vec"]))


def _finish(links: DataFrame, linkage: str) -> DataFrame:
    """The merges ``a, b, height`` of the last clusters of each group from ``_last_links``, one pair after the other."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("_id").sort_values("_id")
        ids, size = pdf["_id"].to_numpy(np.int64), pdf["_size"].to_numpy(np.float64)
        d = np.full((len(ids), len(ids)), np.inf)
        for i, (b, link) in enumerate(zip(pdf["b"], pdf["d"])):
            if b is not None:
                j = np.searchsorted(ids, b)
                d[i, j] = d[j, i] = link / (size[i] * size[j]) if linkage == "average" else link
        return _merge_matrix(ids, d, size, linkage)

    return cut_lineage(links.groupBy("_grp").applyInPandas(run, "a long, b long, height double"))


def _finish_rows(cl: DataFrame, links, linkage: str, group: str | None) -> DataFrame:
    """The merges ``a, b, height`` of the last clusters of each group from their rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("_id").sort_values("_id")
        d = links(pdf, as_right(pdf))
        d = np.minimum(d, d.T)
        np.fill_diagonal(d, np.inf)
        return _merge_matrix(pdf["_id"].to_numpy(np.int64), d, pdf["_size"].to_numpy(np.float64), linkage)

    rows = cl.select(F.col("_grp") if group else F.lit(0).alias("_grp"), *(c for c in cl.columns if c != "_grp"))
    return cut_lineage(rows.groupBy("_grp").applyInPandas(run, "a long, b long, height double"))


def _merge_matrix(ids: np.ndarray, d: np.ndarray, size: np.ndarray, linkage: str) -> pd.DataFrame:
    """Merges one pair after the other; every row keeps its least link, so that a merge looks through few rows."""
    out, near = [], d.argmin(axis=1)
    least = d[np.arange(len(ids)), near]
    for _ in range(len(ids) - 1):
        a = int(least.argmin())  # the first of equals: the smallest ids
        a, b = sorted((a, int(near[a])))
        height, na, nb = d[a, b], size[a], size[b]
        if linkage == "average":
            row = (na * d[a] + nb * d[b]) / (na + nb)
        elif linkage == "complete":
            row = np.maximum(d[a], d[b])
        else:
            with np.errstate(invalid="ignore"):
                row = np.sqrt(np.maximum(((na + size) * d[a] ** 2 + (nb + size) * d[b] ** 2 - size * height ** 2)
                                         / (na + nb + size), 0.0))
        row[[a, b]] = np.inf
        row[~np.isfinite(d[a]) | ~np.isfinite(d[b])] = np.inf
        d[a], d[:, a], d[b], d[:, b], size[a] = row, row, np.inf, np.inf, na + nb
        again = np.flatnonzero((near == a) | (near == b))
        closer = (row < least) | ((row == least) & (a < near))
        near[closer], least[closer] = a, row[closer]
        again = np.union1d(again, [a, b])
        near[again] = d[again].argmin(axis=1)
        least[again] = d[again, near[again]]
        out.append((ids[a], ids[b], height))
    return pd.DataFrame(out, columns=["a", "b", "height"])


def _ward_merges(df: DataFrame, id_col: str, vec: str, block_rows: int, group: str | None) -> DataFrame | None:
    extra = [F.col(group).alias("_grp")] if group else []
    cl = cut_lineage(df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_vec"),
                               F.lit(1.0).alias("_size"), *extra))
    k, merges, tail = cl.count(), [], WARD_TAILS * TAIL
    if _most(cl, k, group) > tail:
        equal = _equal_merges(cl, group)
        if not equal.isEmpty():
            merges, cl = [equal], _ward_rows(cl, equal, group)
            k = cl.count()
    kept = None
    while True:
        if _most(cl, k, group) <= tail:
            return _union([*merges, _finish_rows(cl, _ward_links, "ward", group)])
        found = _nearest_by(_marked(cl, kept), _ward_links, k, block_rows, group, "_need", Screen(size="_size"))
        nearest = cut_lineage(found if kept is None else found.unionByName(kept))
        pairs = cut_lineage(_reciprocal(nearest))
        merged = pairs.count()
        if not merged:
            return _union(merges)
        merges.append(pairs)
        k -= merged
        cl = _ward_rows(cl, pairs, group)
        kept = _kept(nearest, pairs)


def _ward_rows(cl: DataFrame, pairs: DataFrame, group: str | None) -> DataFrame:
    remap = pairs.select(F.col("b").alias("_id"), F.col("a").alias("_new"))
    moved = cl.join(remap, "_id", "left").withColumn("_new", F.coalesce("_new", "_id"))
    return cut_lineage(moved.groupBy(F.col("_new").alias("_id"), *(["_grp"] if group else [])).agg(
        vector_to_array(_weighted_mean("_vec", "_size")).alias("_vec"), F.sum("_size").alias("_size")))


def _equal_merges(cl: DataFrame, group: str | None) -> DataFrame:
    """The merges of equal rows, ``a, b, height``: at height 0 they come first, all onto the smallest id.

    As reciprocal neighbours only one pair of a set of equal rows would merge in a round.
    """
    return cut_lineage(equal_rows(cl, ["_grp"] if group else []).withColumn("height", F.lit(0.0)))


def _union(frames: list[DataFrame]) -> DataFrame | None:
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _weighted_mean(vec: str, w: str):
    from pyspark.ml.stat import Summarizer

    return Summarizer.mean(array_to_vector(F.col(vec)), F.col(w))


# ----------------------------------------------------------------- average and complete linkage by bounds

OPEN_SCHEMA = "c long, nn long, lo double, hi double, exact boolean"


def _link(linkage: str, metric: str, l: tuple, r: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the links between cluster rows; equal where the rows decide the link.

    A side is (means, spreads, radii): spread is the mean squared deviation from the mean (L1: the mean
    deviation or more), radius the largest deviation or more; cosine clusters hold unit vectors.
    """
    (x, vx, rx), (y, vy, ry) = l, r
    spread, reach = vx[:, None] + vy[None, :], rx[:, None] + ry[None, :]
    if metric == "cosine":
        mean = 1.0 - x @ y.T
        if linkage == "average":
            return mean, mean
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        return mean, mean + rx[:, None] * ny[None, :] + nx[:, None] * ry[None, :] + rx[:, None] * ry[None, :]
    if metric in ("manhattan", "l1", "cityblock"):
        d = pair_matrix(x, y, "manhattan")
        return d, d + (spread if linkage == "average" else reach)
    d = pair_matrix(x, y)
    mean_square = d * d + spread
    if metric == "sqeuclidean":
        return mean_square, (mean_square if linkage == "average" else (d + reach) ** 2)
    return (d, np.sqrt(mean_square)) if linkage == "average" else (np.sqrt(mean_square), d + reach)


def _link_sides(l: pd.DataFrame, r: pd.DataFrame, linkage: str, metric: str) -> tuple[np.ndarray, np.ndarray]:
    return _link(linkage, metric, *((_stack(p[f"{k}_vec"]), p[f"{k}_spread"].to_numpy(np.float64),
                                     p[f"{k}_rad"].to_numpy(np.float64)) for p, k in ((l, ""), (r, "r_"))))


def _upper_links(linkage: str, metric: str):
    return lambda l, r: _link_sides(l, r, linkage, metric)[1]


def _known(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return hi - lo <= 1e-12 + 1e-9 * np.abs(hi)


def _open_reducer(linkage: str, metric: str, weigh: bool = False):
    """For each cluster of a block pair the links that may be its least, ``_best`` being the least upper bound it has.

    ``weigh``: only the rows behind the links that aren't known, as one number.
    """
    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({"n": []} if weigh else {"c": [], "nn": [], "lo": [], "hi": [], "exact": []})
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        lo, hi = _link_sides(l, r, linkage, metric)
        known = _known(lo, hi)
        lo = np.where(known, hi, lo)
        lo[li[:, None] == ri[None, :]] = np.inf
        of_l, of_r = (lo <= p[c].to_numpy(np.float64)[s] * (1 + 1e-9) + 1e-12
                      for p, c, s in ((l, "_best", np.s_[:, None]), (r, "r__best", np.s_[None, :])))
        if weigh:
            a, b = np.nonzero((of_l if diag else of_l | of_r) & ~known)
            return pd.DataFrame({"n": [float(l["_size"].to_numpy()[a].sum() + r["r__size"].to_numpy()[b].sum())]})
        (a, b), (x, y) = np.nonzero(of_l), np.nonzero(of_r if not diag else np.zeros((0, 0)))
        at = np.concatenate([a, x]), np.concatenate([b, y])
        return pd.DataFrame({"c": np.concatenate([li[a], ri[y]]), "nn": np.concatenate([ri[b], li[x]]),
                             "lo": lo[at], "hi": hi[at], "exact": known[at]})

    if weigh:
        red.merge = lambda found: found.sum().to_frame().T
    return red


def _nearest_from_points(points: DataFrame, linkage: str, metric: str, block_rows: int) -> DataFrame:
    """``c, nn, d``: the nearest of each cluster with the flag ``_need`` from all points (``_pid, _vec, _cl, _need``) in blocks.

    Points of a cluster share a block, and a block pair gives the nearest of each of its clusters; only the links
    of clusters that are larger than a part of a block leave the tasks in parts (``n`` is their number of distances).
    Clusters without the flag may have rows too, of some of their links.
    """
    placed, n_blocks = place_whole(points.withColumnRenamed("_pid", "_id"), "_cl", block_rows)
    mean = linkage == "average"

    def part(l: pd.DataFrame, r: pd.DataFrame, diag: bool, looks: bool) -> list[tuple]:
        """Links of the left rows, all of which look or don't, to the right rows."""
        cl, wl, cr, wr, d = value_links(l, r, "_cl", metric, mean)
        n = (np.bincount(np.searchsorted(cl, l["_cl"])).astype(float)[:, None]
             * np.bincount(np.searchsorted(cr, r["r__cl"])).astype(float)[None, :])
        look = np.isin(cr, r["r__cl"].to_numpy(np.int64)[r["r__need"].to_numpy(bool)])
        whole = wl[:, None] & wr[None, :]
        other = cl[:, None] != cr[None, :]
        a, b = np.nonzero(other & ~whole & (((cl[:, None] < cr[None, :]) | ~look[None, :]) if diag else True))
        parts = [(np.minimum(cl[a], cr[b]), np.maximum(cl[a], cr[b]), d[a, b], n[a, b])]
        link = np.where(other & whole, d / n if mean else d, np.inf)
        for m, own, far in ([(link, cl, cr)] if looks else []) + ([] if diag else [(link[:, look].T, cr[look], cl)]):
            a, b = _topk_rows(m, far, 1)
            parts.append((own[a], far[b], m[a, b], np.zeros(len(a))))
        return parts

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(l) and len(r):
            nl, nr = l["_need"].to_numpy(bool), r["r__need"].to_numpy(bool)
            if nl.any():
                parts += part(l[nl], r, diag, True)
            if not diag and nr.any() and not nl.all():
                parts += part(l[~nl], r[nr], False, False)
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("c", "nn", "d", "n"))})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        split = found["n"] > 0
        least = found[~split].sort_values(["c", "d", "nn"]).drop_duplicates("c")
        return pd.concat([least, found[split].groupby(["c", "nn"], as_index=False).agg(
            {"d": "sum" if mean else "max", "n": "sum"})], ignore_index=True)

    red.merge = merge
    found = cut_lineage(self_block_cogroup(placed, red, "c long, nn long, d double, n double", n_blocks, block_rows=block_rows))
    split = found.where(F.col("n") > 0).groupBy("c", "nn").agg(
        (F.sum("d") / F.sum("n") if mean else F.max("d")).alias("d"))
    return _nearest(found.where(F.col("n") == 0).select("c", "nn", "d").unionByName(split).unionByName(
        split.select(F.col("nn").alias("c"), F.col("c").alias("nn"), "d")))


def _exact_links(points: DataFrame, pairs: DataFrame, sizes: DataFrame, linkage: str, metric: str, block_rows: int
                 ) -> DataFrame | None:
    """``a, b, d``: the links of cluster pairs from their points (``_pid, _vec, _cl``); None if there are no pairs.

    Clusters are cut into chunks of about ``block_rows`` rows; a chunk of one meets a chunk of the other, and
    pairs of chunks share tasks of bounded size.
    """
    chunks = sizes.select(F.col("_id").alias("_cl"), F.ceil(F.col("_size") / block_rows).cast("int").alias("_nc"),
                          F.col("_size").alias("_n"))
    named = pairs
    for side in "ab":
        named = named.join(chunks.select(F.col("_cl").alias(side), F.col("_nc").alias(f"nc_{side}"),
                                         F.col("_n").alias(f"n_{side}")), side)
    rows = named.agg(F.sum(F.col("n_a") * F.col("nc_b") + F.col("n_b") * F.col("nc_a"))).first()[0]
    if rows is None:
        return None
    tasks = max(1, int(rows // (4 * block_rows)))
    work = (named.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nc_a") - 1)))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nc_b") - 1))))
    work = work.withColumn("_task", F.pmod(F.xxhash64("a", "b", "i", "j"), F.lit(tasks)).cast("int"))
    dealt = points.join(chunks, "_cl").withColumn("_chunk", F.pmod(F.xxhash64("_pid"), F.col("_nc")).cast("int"))
    keys = ["_task", "a", "b", "i", "j"]
    left = dealt.join(work.select(*keys, F.col("a").alias("_cl"), F.col("i").alias("_chunk")), ["_cl", "_chunk"]
                      ).select(*keys, "_vec")
    right = dealt.join(work.select(*keys, F.col("b").alias("_cl"), F.col("j").alias("_chunk")), ["_cl", "_chunk"]
                       ).select(*(F.col(c).alias(f"r_{c}") for c in [*keys, "_vec"]))

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out, other = [], {k: g for k, g in r.groupby(["r_a", "r_b", "r_i", "r_j"])}
        for k, g in l.groupby(["a", "b", "i", "j"]):
            if k in other:
                d = pair_matrix(_stack(g["_vec"]), _stack(other[k]["r__vec"]), metric)
                out.append((k[0], k[1], d.sum(), d.max(), d.size))
        return pd.DataFrame(out, columns=["a", "b", "s", "mx", "n"]).astype(
            {"a": "int64", "b": "int64", "s": "float64", "mx": "float64", "n": "int64"})

    found = left.groupBy("_task").cogroup(right.groupBy("r__task")).applyInPandas(
        run, "a long, b long, s double, mx double, n long")
    d = F.sum("s") / F.sum("n") if linkage == "average" else F.max("mx")
    return found.groupBy("a", "b").agg(d.alias("d"))


def _merged_rows(cl: DataFrame, pairs: DataFrame, metric: str, extra: list[str]) -> DataFrame:
    """The cluster rows after a round: the mean lies on the line between two means, and spread and radius follow."""
    def side(name: str) -> DataFrame:
        return cl.select(F.col("_id").alias(name), *(F.col(c).alias(f"{name}{c}") for c in ("_vec", "_size", "_spread", "_rad")),
                         *(F.col(c) for c in (extra if name == "a" else [])))

    j = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    na, nb = F.col("a_size"), F.col("b_size")
    n = na + nb
    l1 = metric in ("manhattan", "l1", "cityblock")
    gaps = F.zip_with("a_vec", "b_vec", lambda x, y: F.abs(x - y) if l1 else (x - y) * (x - y))
    gap = F.aggregate(gaps, F.lit(0.0), lambda t, v: t + v)
    j = j.withColumn("_gap", gap if l1 else F.sqrt(gap))
    da, db = F.col("_gap") * nb / n, F.col("_gap") * na / n
    spread = ((na * (F.col("a_spread") + da) + nb * (F.col("b_spread") + db)) if l1 else
              (na * (F.col("a_spread") + da * da) + nb * (F.col("b_spread") + db * db))) / n
    merged = j.select(F.col("a").alias("_id"), *extra,
                      F.zip_with("a_vec", "b_vec", lambda x, y: (x * na + y * nb) / n).alias("_vec"), n.alias("_size"),
                      spread.alias("_spread"), F.greatest(F.col("a_rad") + da, F.col("b_rad") + db).alias("_rad"))
    gone = pairs.select(F.explode(F.array("a", "b")).alias("_id"))
    return cl.join(gone, "_id", "left_anti").select(*merged.columns).unionByName(merged)


def _last_links(cl: DataFrame, points: DataFrame, linkage: str, metric: str, block_rows: int, group: str | None) -> DataFrame:
    """``_grp, _id, _size, b, d``: of each of the last clusters the links to some others, every pair at one of its ends.

    They come from the points in blocks, where points of a cluster are side by side; average links are still sums.
    """
    mean = linkage == "average"
    rows = points.withColumnRenamed("_pid", "_id")
    if group:  # each group is in blocks of its own
        rows, n_blocks = rows.join(cl.select(F.col("_id").alias("_cl"), "_grp"), "_cl").withColumn("_whole", F.lit(False)), 0
    else:
        rows, n_blocks = place_whole(rows, "_cl", block_rows)

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({"_grp": [], "a": [], "b": [], "d": []})
        x, _, y, _, d = value_links(l, r, "_cl", metric, mean)
        # a pair of clusters meets in both orders of a diagonal block
        a, b = np.nonzero(x[:, None] < y[None, :] if diag else x[:, None] != y[None, :])
        return pd.DataFrame({"_grp": l["_grp"].iloc[0] if group else 0, "a": np.minimum(x[a], y[b]),
                             "b": np.maximum(x[a], y[b]), "d": d[a, b]})

    red.merge = lambda found: found.groupby(["_grp", "a", "b"], as_index=False).agg({"d": "sum" if mean else "max"})
    found = self_block_cogroup(rows, red, _link_schema(cl, group), n_blocks, group="_grp" if group else None, block_rows=block_rows)
    found = found.groupBy("_grp", "a", "b").agg((F.sum if mean else F.max)("d").alias("d"))
    packed = found.groupBy("a").agg(F.collect_list(F.struct("b", "d")).alias("l")).select(
        F.col("a").alias("_id"), F.col("l.b").alias("b"), F.col("l.d").alias("d"))
    return cl.select(F.col("_grp") if group else F.lit(0).alias("_grp"), "_id", "_size").join(packed, "_id", "left")


def _nearest_by_points(cl: DataFrame, best: DataFrame, points: DataFrame, linkage: str, metric: str, k: int, n: int,
                       block_rows: int, group: str | None) -> tuple[DataFrame, bool]:
    """``c, nn, d`` exactly: the links that the bounds leave open from their points, or from all points in blocks if
    that is less (the second value). ``best``: the least upper bound of each cluster that looks."""
    grp, blocks = "_grp" if group else None, max(1, -(-k // block_rows))
    rows = cut_lineage(cl.join(best.select(F.col("c").alias("_id"), F.col("d").alias("_best")), "_id", "left").withColumn(
        "_best", F.coalesce("_best", F.lit(float("-inf")))))
    if not group:
        weight = self_block_cogroup(rows, _open_reducer(linkage, metric, weigh=True), "n double", blocks, block_rows=block_rows)
        if (weight.agg(F.sum("n")).first()[0] or 0) > OPEN_ROWS * n:
            return _nearest_from_points(points, linkage, metric, block_rows), True
    near = cut_lineage(self_block_cogroup(rows, _open_reducer(linkage, metric), OPEN_SCHEMA, blocks, group=grp,
                                          block_rows=block_rows))
    left_open = cut_lineage(near.where(~F.col("exact")).select(
        F.least("c", "nn").alias("a"), F.greatest("c", "nn").alias("b")).distinct())
    found = _exact_links(points, left_open, cl.select("_id", "_size"), linkage, metric, block_rows)
    if found is not None:
        near = near.withColumn("a", F.least("c", "nn")).withColumn("b", F.greatest("c", "nn")).join(
            found, ["a", "b"], "left").withColumn("hi", F.when(F.col("exact"), F.col("hi")).otherwise(F.col("d")))
    return _nearest(near.select("c", "nn", F.col("hi").alias("d"))), False


def _bounded_merges(df: DataFrame, linkage: str, id_col: str, vec: str, metric: str, block_rows: int,
                    group: str | None) -> DataFrame | None:
    extra = ["_grp"] if group else []
    value = F.col(vec).cast("array<double>")
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda t, v: t + v * v))
        value = F.when(norm > 0, F.transform(value, lambda v: v / norm)).otherwise(value)
    cl = cut_lineage(df.select(F.col(id_col).cast("long").alias("_id"), *([F.col(group).alias("_grp")] if group else []),
                               value.alias("_vec"), F.lit(1.0).alias("_size"), F.lit(0.0).alias("_spread"),
                               F.lit(0.0).alias("_rad")))
    vectors = cl.select(F.col("_id").alias("_pid"), "_vec")
    members = cl.select(F.col("_id").alias("_pid"), F.col("_id").alias("_cl"))
    by_points = not (linkage == "average" and metric in ("cosine", "sqeuclidean"))
    merges, n = [], cl.count()
    k = n
    tail = TAIL * (1 if by_points and group else WARD_TAILS)
    if _most(cl, k, group) > TAIL:
        # a zero vector is at cosine distance 1 from its like
        equal = _equal_merges(cl.where(F.exists("_vec", lambda v: v != 0)) if metric == "cosine" else cl, group)
        if not equal.isEmpty():
            merges = [equal]
            more = equal.join(cl.select(F.col("_id").alias("b")), "b").groupBy(F.col("a").alias("_id")).agg(
                F.count("*").alias("_more"))
            cl = cut_lineage(cl.join(equal.select(F.col("b").alias("_id")), "_id", "left_anti").join(more, "_id", "left")
                             .withColumn("_size", F.col("_size") + F.coalesce("_more", F.lit(0))).drop("_more"))
            to = equal.select(F.col("b").alias("_cl"), F.col("a").alias("_new"))
            members = cut_lineage(members.join(to, "_cl", "left").select("_pid", F.coalesce("_new", "_cl").alias("_cl")))
            k = cl.count()
    links, screen = _upper_links(linkage, metric), ProductScreen() if linkage == "average" and metric == "cosine" else None
    single, kept, weighed, from_points = True, None, 0, False
    while True:
        if _most(cl, k, group) <= tail:
            if not by_points:
                return _union([*merges, _finish_rows(cl, links, linkage, group)])
            return _union([*merges, _finish(_last_links(cl, vectors.join(members, "_pid"), linkage, metric, block_rows, group),
                                            linkage)])
        marked = _marked(cl, kept)
        points = vectors.join(members, "_pid").join(marked.select(F.col("_id").alias("_cl"), "_need"), "_cl")
        if from_points and 2 * k > weighed:  # bounds that left too much open lately do so again
            found = _nearest_from_points(points, linkage, metric, block_rows)
        else:
            found = _nearest_by(marked, links, k, block_rows, group, "_need", screen)
            if by_points and not single:  # single points (and equal ones) have known links
                found, from_points = _nearest_by_points(cl, cut_lineage(found), points, linkage, metric, k, n, block_rows, group)
                weighed = k
        nearest = cut_lineage(found if kept is None else _nearest(found.unionByName(kept)))
        pairs = cut_lineage(_reciprocal(nearest))
        merged = pairs.count()
        if not merged:
            if kept is None:
                return _union(merges)
            kept = None  # links that differ by rounding only: all look again, each pair at one number
            continue
        merges.append(pairs)
        k, single, kept = k - merged, False, _kept(nearest, pairs)
        cl = cut_lineage(_merged_rows(cl, pairs, metric, extra))
        if by_points:
            to = pairs.select(F.col("b").alias("_cl"), F.col("a").alias("_new"))
            members = cut_lineage(members.join(to, "_cl", "left").select("_pid", F.coalesce("_new", "_cl").alias("_cl")))


def dendrogram(df: DataFrame, linkage: str = "ward", metric: str = "euclidean", id_col: str = "pos",
               vec: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS, group: str | None = None) -> DataFrame:
    """Full merge list ``a, b, height`` for the given linkage: n - 1 rows, or one less for each group."""
    linkage = linkage.lower()
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}")
    if linkage == "ward" and metric not in ("euclidean", "l2"):
        raise ValueError("ward linkage needs the euclidean metric")
    if linkage == "single":
        from clusterloom.operators.graph import minimum_spanning_forest

        mst = minimum_spanning_forest(df, id_col, vec, metric=metric, block_rows=block_rows, group=group)
        return mst.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("w").alias("height"))
    if linkage == "ward":
        m = _ward_merges(df, id_col, vec, block_rows, group)
    else:
        m = _bounded_merges(df, linkage, id_col, vec, metric, block_rows, group)
    if m is None:
        return df.sparkSession.createDataFrame([], "a long, b long, height double")
    return m


def agglomerative(df: DataFrame, n_clusters: int | None = None, distance_threshold: float | None = None,
                  linkage: str = "ward", metric: str = "euclidean", id_col: str = "pos",
                  vec: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS, group: str | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """C4: labels (``<id_col>, label``, canonical numbering) and the merge list.

    Both parameters given -> the threshold wins; neither -> error; k is clamped
    to the row count. With ``group`` every group is clustered on its own, in the
    same rounds; labels are unique over all groups.
    """
    from clusterloom.operators.graph import connected_components
    from clusterloom.operators.kmeans import canonical_labels
    from clusterloom.operators.topn import top_n_per_group

    if n_clusters is None and distance_threshold is None:
        raise ValueError("agglomerative clustering needs n_clusters or distance_threshold")
    if df.isEmpty():
        raise ValueError("cannot cluster an empty vector set")
    merges = dendrogram(df, linkage, metric, id_col, vec, block_rows, group)
    if distance_threshold is not None:
        keep = merges.where(F.col("height") <= F.lit(float(distance_threshold)))
    elif group is None:
        top = merges.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(max(0, int(n_clusters) - 1))
        keep = merges.join(top, ["a", "b"], "left_anti")
    else:
        of = merges.join(df.select(F.col(id_col).cast("long").alias("a"), F.col(group).alias("_grp")), "a")
        top = top_n_per_group(of, ["_grp"], [F.desc("height"), F.desc("a"), F.desc("b")], max(0, int(n_clusters) - 1),
                              ["a", "b"])
        keep = merges.join(top.select("a", "b"), ["a", "b"], "left_anti")
    comps = connected_components(df.select(F.col(id_col).alias("id")), keep, "id", "a", "b")
    lab = comps.select(F.col("id").alias(id_col), F.col("component").alias("label"))
    return canonical_labels(lab.withColumn("_k", F.col(id_col)), "_k").drop("_k"), merges


def tree_metrics(merges: DataFrame, n_items: int) -> dict:
    """Leaves and connected components of the hierarchy."""
    n_merges = merges.count()
    return {"n_leaves": n_items, "n_connected_components": n_items - n_merges}
