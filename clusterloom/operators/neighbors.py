"""Similarity search and pair joins (Q1-Q6, J4-J6) on the blocked primitive.

Integral ids are required here (the vector position ``pos``); callers join
back to string item ids when they need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.operators.blocks import (DEFAULT_BLOCK_ROWS, _stack, _topk_rows, cross_block_cogroup, knn_reducer,
                                          n_blocks_for, pair_matrix, place_whole, self_block_cogroup, value_links, within_reducer)
from clusterloom.operators.cells import METRICS, make_cells, pairs_cogroup, pairs_for_neighbours, pairs_within_reach
from clusterloom.operators.filters import search_predicate
from clusterloom.operators.jobs import global_rank
from clusterloom.operators.profiles import prefix_count
from clusterloom.session import cut_lineage

KNN_SCHEMA = "id long, nbr_id long, dist double"
#: Rows of a block of the interval join: all pairs of two blocks, a million, fit the memory of a task.
PAIR_BLOCK_ROWS = 1024
MAX_SHIPPED_VALUES = 8_000_000  # numbers in the query vectors that go to every task, 64 MB


def _points(df: DataFrame, id_col: str, vec: str, **extra: str) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_vec")]
    cols += [F.col(src).alias(f"_{dst}") for src, dst in extra.items()]
    return df.select(*cols)


def knn_graph(df: DataFrame, k: int, id_col: str = "pos", vec: str = "embedding",
              metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS,
              group: str | None = None) -> DataFrame:
    """Q6: the k nearest other items of every item (of its group): ``id, nbr_id, dist, rank``.

    Each block pair returns at most k candidates per row; the final top-k per
    id ranks at most (B + 1) k candidates, a bounded group per id. Beyond one block, and
    under a metric with the triangle inequality, blocks are rings of pivot cells and
    only pairs that can hold a neighbour are computed (groups: all pairs of a group's blocks).
    """
    pts = _points(df, id_col, vec, **({group: "grp"} if group else {}))
    B = 0 if group else n_blocks_for(pts, block_rows)
    if B > 1 and metric in METRICS:
        cells = make_cells(pts, metric, block_rows, B)
        cand = pairs_cogroup(cells.points, pairs_for_neighbours(cells, k), knn_reducer(k, metric), KNN_SCHEMA,
                             block_rows)
    else:
        cand = self_block_cogroup(pts, knn_reducer(k, metric), KNN_SCHEMA, B, group="_grp" if group else None,
                                  block_rows=block_rows)
    w = Window.partitionBy("id").orderBy("dist", "nbr_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_search(base: DataFrame, queries: DataFrame, k: int, id_col: str = "pos",
               vec: str = "embedding", query_id: str = "query_id", query_vec: str = "query_vector",
               metric: str = "sqeuclidean", block_rows: int = DEFAULT_BLOCK_ROWS,
               check_dimension: bool = True) -> DataFrame:
    """Q1: exact k nearest base items for every query, by squared L2 like a flat index.

    Output ``query_id, rank, id, dist``; fewer rows than k when the base is
    smaller than k (pad with Q3). A query of the wrong dimension raises.
    """
    if check_dimension:
        bad = (queries.select(F.size(query_vec).alias("qd")).distinct()
               .join(base.select(F.size(vec).alias("qd")).distinct(), "qd", "left_anti").limit(1).collect())
        if bad:
            raise ValueError(f"query dimension {bad[0][0]} does not match the vector set")
    left = queries.select(F.col(query_id).cast("long").alias("_id"), F.col(query_vec).alias("_vec"))
    right = base.select(F.col(id_col).cast("long").alias("r__id"), F.col(vec).alias("r__vec"))
    n_queries = left.count()
    width = left.select(F.max(F.size("_vec"))).first()[0] or 0
    if n_queries * width <= MAX_SHIPPED_VALUES:
        cand = _scan_base(left, right, k, metric)
    else:
        red = knn_reducer(k, metric, exclude_self=False)

        def one_sided(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
            return red(l, r, True)  # 'diagonal' = only the query direction

        cand = cross_block_cogroup(left, right, one_sided, KNN_SCHEMA, max(1, -(-n_queries // block_rows)),
                                   n_blocks_for(right, block_rows))
    w = Window.partitionBy("id").orderBy("dist", "nbr_id")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("id").alias(query_id), "rank", F.col("nbr_id").alias("id"), "dist"))


def _scan_base(queries: DataFrame, base: DataFrame, k: int, metric: str) -> DataFrame:
    """Each partition's k nearest rows of every query: the queries, of a checked size, go to the base."""
    rows = queries.orderBy("_id").collect()
    ids = np.array([r[0] for r in rows], np.int64)
    bc = base.sparkSession.sparkContext.broadcast(
        (ids, np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = bc.value
        own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, id, distance
        for pdf in batches:
            if len(pdf) == 0 or len(qid) == 0:
                continue
            found = [own]
            x, nbr = _stack(pdf["r__vec"]), pdf["r__id"].to_numpy(np.int64)
            for at in range(0, len(x), DEFAULT_BLOCK_ROWS):
                d = pair_matrix(q, x[at:at + DEFAULT_BLOCK_ROWS], metric)
                a, b = _topk_rows(d, nbr[at:at + DEFAULT_BLOCK_ROWS], k)
                found.append((a, nbr[at + b], d[a, b]))
            a, n, d = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((n, d, a))
            a, n, d = a[order], n[order], d[order]
            starts = np.searchsorted(a, a)  # first of the same query
            keep = np.arange(len(a)) - starts < k
            own = a[keep], n[keep], d[keep]
        yield pd.DataFrame({"id": qid[own[0]] if len(qid) else own[0], "nbr_id": own[1], "dist": own[2]})

    return base.mapInPandas(run, KNN_SCHEMA)


def pad_results(hits: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """Q3: exactly k slots per query; empty slots have id -1 and distance +inf."""
    slots = queries.select(query_id).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return (slots.join(hits, [query_id, "rank"], "left")
            .withColumn("id", F.coalesce(F.col("id"), F.lit(-1).cast("long")))
            .withColumn("dist", F.coalesce(F.col("dist"), F.lit(float("inf")))))


def knn_search_postfilter(base: DataFrame, queries: DataFrame, k: int, filters: dict,
                          id_col: str = "pos", vec: str = "embedding", over_fetch: int = 10,
                          **kw) -> DataFrame:
    """Q2: the nearest ``over_fetch * k`` candidates, the search filter (F7) on them, the first k of the rest.

    A query may get fewer than k hits (pad with Q3); Q4 filters first.
    """
    cand = knn_search(base, queries, over_fetch * k, id_col, vec, **kw)
    meta = base.drop(vec, "id").withColumnRenamed(id_col, "id")
    kept = cand.join(meta, "id", "inner").where(search_predicate(meta, filters))
    w = Window.partitionBy(kw.get("query_id", "query_id")).orderBy("rank")
    return (kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(kw.get("query_id", "query_id"), "rank", "id", "dist"))


def knn_search_prefilter(base: DataFrame, queries: DataFrame, k: int, filters: dict,
                         id_col: str = "pos", vec: str = "embedding", **kw) -> DataFrame:
    """Q4: exact filtered top-k: filter first (pushed down), then search."""
    return knn_search(base.where(search_predicate(base, filters)), queries, k, id_col, vec, **kw)


def pairs_within(df: DataFrame, threshold: float, id_col: str = "pos", vec: str = "embedding",
                 metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """J5 (and J4 with threshold=inf): unordered pairs id_a < id_b with distance <= threshold."""
    return reduce_within(_points(df, id_col, vec), threshold, within_reducer(threshold, metric),
                         "id_a long, id_b long, dist double", metric, block_rows)


def reduce_within(pts: DataFrame, threshold: float, reducer, schema: str, metric: str, block_rows: int) -> DataFrame:
    """``reducer`` on every block pair that may hold a distance of at most ``threshold``."""
    B = n_blocks_for(pts, block_rows)
    if B > 1 and metric in METRICS and np.isfinite(threshold):
        cells = make_cells(pts, metric, block_rows, B)
        return pairs_cogroup(cells.points, pairs_within_reach(cells, threshold), reducer, schema, block_rows)
    return self_block_cogroup(pts, reducer, schema, B)


def pair_distances(df: DataFrame, id_col: str = "pos", vec: str = "embedding",
                   metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS, by: str | None = None) -> DataFrame:
    """Every unordered pair with its distance (O(n^2) rows: a library building block).

    With ``by`` (a column of whole numbers) the pairs are reduced where they are computed: ``x <= y, dist``, the
    largest distance of two items with these values. Items of one value share a block, so that only values
    of many items leave the tasks in parts.
    """
    if by is None:
        return pairs_within(df, float("inf"), id_col, vec, metric, block_rows)
    placed, n_blocks = place_whole(_points(df, id_col, vec, **{by: "by"}), "_by", block_rows)

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({"x": [], "y": [], "dist": [], "whole": []})
        vl, wl, vr, wr, most = value_links(l, r, "_by", metric, False)
        a, b = np.nonzero(np.isfinite(most) & ((vl[:, None] <= vr[None, :]) if diag else True))
        return pd.DataFrame({"x": np.minimum(vl[a], vr[b]), "y": np.maximum(vl[a], vr[b]), "dist": most[a, b],
                             "whole": wl[a] & wr[b]})

    found = self_block_cogroup(placed, red, "x long, y long, dist double, whole boolean", n_blocks, block_rows=block_rows)
    found = cut_lineage(found)
    return found.where("whole").drop("whole").unionByName(
        found.where(~F.col("whole")).groupBy("x", "y").agg(F.max("dist").alias("dist")))


def pairs_within_days(df: DataFrame, window_days: float, threshold: float | None = None,
                      id_col: str = "pos", vec: str = "embedding", days: str = "date_days",
                      decay_days: float | None = None, block_rows: int = PAIR_BLOCK_ROWS) -> DataFrame:
    """Interval join, pairs whose dates differ by at most ``window_days`` (and optionally
    whose distance is at most ``threshold``): ``id_a < id_b, gap_days, dist[, temporal_similarity]``.

    One distributed sort by date cuts the rows into blocks of ``block_rows``; a block meets
    the blocks up to the last one that begins within the window after its own end, a run of
    neighbours. A hot day (a third of all rows) is many blocks. Each block pair is one cogroup
    group: a numpy distance block masked by the date gap, of which a group's memory holds one,
    though every pair may be within both bounds. Undated rows take no part. With
    ``decay_days`` the pair also gets the decayed cosine similarity (V8).
    """
    w = float(window_days)
    base = df.where(F.col(days).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_vec"), F.col(days).cast("double").alias("_day"))
    points = global_rank(base, [F.asc("_day"), F.asc("_id")], "_g").withColumn(
        "_blk", F.floor((F.col("_g") - 1) / F.lit(block_rows))).drop("_g")
    pairs = _overlapping_blocks(points, w)
    thr = float("inf") if threshold is None else float(threshold)
    decay = None if decay_days is None else float(decay_days)
    cols = ["id_a", "id_b", "gap_days", "dist"] + (["temporal_similarity"] if decay else [])
    schema = "id_a long, id_b long, gap_days double, dist double" + (
        ", temporal_similarity double" if decay else "")

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({c: pd.Series([], dtype="int64" if c.startswith("id") else "float64")
                                 for c in cols})
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        xl, xr = _stack(l["_vec"]), _stack(r["r__vec"])
        d = pair_matrix(xl, xr)
        gap = np.abs(l["_day"].to_numpy(np.float64)[:, None] - r["r__day"].to_numpy(np.float64)[None, :])
        mask = (gap <= w) & (d <= thr) & (li[:, None] != ri[None, :])
        if diag:
            mask &= li[:, None] < ri[None, :]
        a, b = np.nonzero(mask)
        out = {"id_a": np.minimum(li[a], ri[b]), "id_b": np.maximum(li[a], ri[b]), "gap_days": gap[a, b],
               "dist": d[a, b]}
        if decay:
            cos = 1.0 - pair_matrix(xl, xr, "cosine")
            out["temporal_similarity"] = cos[a, b] * np.exp(-gap[a, b] / decay)
        return pd.DataFrame(out)

    return pairs_cogroup(points, pairs, red, schema, block_rows, span=1)


def _overlapping_blocks(points: DataFrame, window: float) -> DataFrame:
    """Pairs ``_gl <= _gh`` of date-ordered blocks (numbered from 0) with rows at most ``window`` days apart.

    How many blocks begin by the end of a block's window is a running count over the block table's sorted bounds.
    """
    table = cut_lineage(points.groupBy("_blk").agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi")))
    reach = F.col("_hi") + F.lit(window + 1e-6 * (1.0 + abs(window)))  # rounding must not lose a pair
    bounds = table.select(F.col("_lo").alias("_v"), F.lit(1).alias("_begins"), "_blk").unionByName(
        table.select(reach.alias("_v"), F.lit(0).alias("_begins"), "_blk"))
    ranked = global_rank(bounds, [F.asc("_v"), F.desc("_begins"), F.asc("_blk")], "_place")
    last = prefix_count(ranked, "_place", "_begins", "_n").where(F.col("_begins") == 0)
    return cut_lineage(last.select(F.col("_blk").alias("_gl"), F.explode(F.sequence(
        F.col("_blk"), F.greatest(F.col("_n") - 1, F.col("_blk")))).alias("_gh")))


def search_clusters(profiles: DataFrame, query_vector: Column | None = None, filters: dict | None = None,
                    min_size: int = 3, top_k: int = 10, centroid: str = "centroid",
                    id_col: str = "cluster_id") -> DataFrame:
    """Q5: clusters ranked by cosine similarity to a query vector and/or metadata match.

    Ranking (trap D21): similarity desc, then size desc, then id. ``orderBy.limit``
    is a per-partition top-k followed by one small merge.
    """
    from clusterloom.functions.vector import cosine_similarity

    keep = F.col("size") >= F.lit(min_size)
    for key, want in (filters or {}).items():
        if f"{key}s" in profiles.columns and key not in profiles.columns:  # a profile's sets: domains, event_types, ...
            wanted = list(want) if isinstance(want, (list, tuple, set)) else [want]
            keep = keep & F.coalesce(F.arrays_overlap(f"{key}s", F.array(*map(F.lit, wanted))), F.lit(False))
        else:
            keep = keep & search_predicate(profiles, {key: want})
    p = profiles.where(keep)
    sim = cosine_similarity(centroid, query_vector) if query_vector is not None else F.lit(None).cast("double")
    return (p.withColumn("similarity", sim)
            .orderBy(F.desc_nulls_last("similarity"), F.desc("size"), F.asc(id_col)).limit(top_k))
