"""Clustering entry point and composites.

Algorithms are registered by name (case-insensitive) as functions ``(DataFrame, params,
group) -> (DataFrame, metrics)`` whose frame has ``pos, label`` and optionally
``probability``; ``group`` names a column whose values are clustered each on their own.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.vector import apply_temporal_weighting, distance_confidence, l2_distance
from clusterloom.operators import filters as FL
from clusterloom.operators import metrics as M
from clusterloom.operators.jobs import global_rank
from clusterloom.session import cut_lineage

Algorithm = Callable[..., tuple[DataFrame, dict]]
_REGISTRY: dict[str, Algorithm] = {}


def register_algorithm(name: str, fn: Algorithm) -> None:
    """Add a clustering algorithm under a (case-insensitive) name."""
    _REGISTRY[name.lower()] = fn


def algorithms() -> list[str]:
    return sorted(_REGISTRY)


def _kmeans(df: DataFrame, p: dict, group: str | None = None) -> tuple[DataFrame, dict]:
    from clusterloom.operators.kmeans import kmeans, minibatch_kmeans

    k, seed = int(p.get("n_clusters", 50)), int(p.get("random_state", 42))
    if p.get("use_minibatch"):
        out, info = minibatch_kmeans(df, k, batch_size=int(p.get("batch_size", 1024)), seed=seed,
                                     max_iter=int(p.get("max_iter", 100)), tol=float(p.get("tol", 0.0)),
                                     reassignment_ratio=float(p.get("reassignment_ratio", 0.01)), group=group)
    else:
        out, info = kmeans(df, k, n_init=int(p.get("n_init", 10)), max_iter=int(p.get("max_iter", 300)),
                           tol=float(p.get("tol", 1e-4)), seed=seed, group=group)
    return out.select("pos", "label"), {"inertia": info["inertia"], "n_iterations": float(info["iterations"])}


def _agglomerative(df: DataFrame, p: dict, group: str | None = None) -> tuple[DataFrame, dict]:
    from clusterloom.operators.agglomerative import agglomerative, tree_metrics

    k, t = p.get("n_clusters"), p.get("distance_threshold")
    labels, merges = agglomerative(df, n_clusters=int(k) if k is not None else None,
                                   distance_threshold=float(t) if t is not None else None,
                                   linkage=p.get("linkage", "ward"), metric=p.get("metric", "euclidean"), group=group)
    return labels, {k: float(v) for k, v in tree_metrics(merges, df.count()).items()}


def _hdbscan(df: DataFrame, p: dict, group: str | None = None) -> tuple[DataFrame, dict]:
    from clusterloom.operators.hdbscan import hdbscan

    out = cut_lineage(hdbscan(
        df, int(p.get("min_cluster_size", 5)), int(p.get("min_samples", 3)),
        float(p.get("cluster_selection_epsilon", 0.0)), p.get("cluster_selection_method", "eom"),
        str(p.get("allow_single_cluster", "false")).lower() == "true", float(p.get("alpha", 1.0)),
        p.get("metric", "euclidean"), group=group))
    density = M.density_metrics(out).first().asDict()
    return out, {f"{k.replace('avg_probability', 'avg_membership_probability')}": v for k, v in density.items()}


register_algorithm("kmeans", _kmeans)
register_algorithm("agglomerative", _agglomerative)
register_algorithm("hdbscan", _hdbscan)


def _algorithm(name: str) -> Algorithm:
    if name.lower() not in _REGISTRY:
        raise ValueError(f"unknown algorithm {name!r}; available: {algorithms()}")
    return _REGISTRY[name.lower()]


def cluster(df: DataFrame, algorithm: str, params: dict | None = None, filters: dict | None = None,
            temporal_decay_days: float | None = None, metrics: bool = True) -> tuple[DataFrame, dict]:
    """Validate, filter (F6), weight (V7), cluster, map back (F8), score (A1, A3, A4, A5).

    Returns every input row with ``label`` (-1 for filtered rows and noise) and
    ``probability`` (0 there; from the density, or V10 of the distance to the
    centroid), and a dict of metric-sized values: counts, the algorithm's own
    metrics, the quality metrics, and under ``centroids`` a frame ``label, centroid,
    size``. Centroids, distances and metrics are taken in the space that was
    clustered, so with temporal weighting from the weighted vectors. Rows are
    identified by ``pos``.
    """
    run = _algorithm(algorithm)
    if df.isEmpty():
        raise ValueError("cannot cluster an empty vector set")
    kept = FL.apply_metadata_filters(df, filters)
    if temporal_decay_days:
        kept = apply_temporal_weighting(kept, decay_days=temporal_decay_days)
    if kept.isEmpty():
        out = df.withColumn("label", F.lit(-1)).withColumn("probability", F.lit(0.0))
        return out, {"n_clusters": 0, "outlier_count": out.count(), "total": out.count()}
    kept = cut_lineage(kept)
    labelled, own = run(kept, params or {})
    if not {"pos", "label"} <= set(labelled.columns):
        raise ValueError("algorithm output must have pos and label")
    labelled = cut_lineage(labelled)
    scored = kept.select("pos", "embedding").join(labelled.where(F.col("label") >= 0).select("pos", "label"), "pos")
    cents = cut_lineage(M.centroids(scored))
    if "probability" not in labelled.columns:
        distances = M.with_centroid(scored, cents).select("pos", l2_distance("embedding", "_centroid").alias("distance"))
        labelled = labelled.join(distance_confidence(distances, out="probability").select("pos", "probability"),
                                 "pos", "left")
    full = FL.map_back_labels(df, labelled, id_col="pos")
    info = {**M.result_counts(full).first().asDict(), **own, "centroids": cents}
    if metrics:
        if info["n_clusters"] > 1:
            per, _ = M.silhouette(scored)
            info["silhouette_score"] = per.agg(F.avg("silhouette")).first()[0]
            info["davies_bouldin_index"] = M.davies_bouldin(scored).first()[0]
        _, overall = M.intra_similarity(scored, cents)
        info["avg_intra_cluster_similarity"] = overall.first()[0]
    return full, info


def cluster_by_group(df: DataFrame, keys: list[str], algorithm: str, params: dict | None = None
                     ) -> DataFrame:
    """Every group clustered on its own, labels unique over all groups.

    One run of the algorithm with the group as a key of its blocks and sums, so
    the number of Spark jobs doesn't follow the number of groups. Rows whose keys
    are all null belong to no group and keep label -1.
    """
    run = _algorithm(algorithm)
    any_key = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys])
    groups = global_rank(df.where(any_key).select(*keys).distinct(), [F.asc(k) for k in keys], "_group")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    grouped = cut_lineage(df.alias("l").join(groups.alias("r"), same, "left").select(
        "l.*", F.col("r._group").cast("int").alias("_group")))
    inside = grouped.where(F.col("_group").isNotNull())
    if inside.isEmpty():
        return df.withColumn("label", F.lit(-1))
    # an item may be in several groups (windows): number the rows that are clustered
    numbered = cut_lineage(inside.withColumn("_item", F.col("pos")).withColumn("pos", F.monotonically_increasing_id()))
    labelled, _ = run(numbered, params or {}, "_group")
    out = (numbered.join(labelled.select("pos", "label"), "pos", "left").drop("pos", "_group")
           .withColumnRenamed("_item", "pos").withColumn("label", F.coalesce("label", F.lit(-1))))
    rest = grouped.where(F.col("_group").isNull()).drop("_group").withColumn("label", F.lit(-1))
    return out.unionByName(rest).select(*df.columns, "label")


def cluster_levels(vectors: DataFrame, level_config: dict[str, tuple[str, dict]] | None = None) -> DataFrame:
    """Per embedding type its own algorithm and parameters (four types); outputs unioned by name.

    The types are clustered at the same time: their many short jobs fill each other's gaps.
    """
    level_config = level_config or DEFAULT_LEVELS
    vectors = cut_lineage(vectors)

    def level(item: tuple[str, tuple[str, dict]]) -> DataFrame | None:
        etype, (alg, params) = item
        own = vectors.where(F.col("embedding_type") == etype)
        if own.isEmpty():
            return None
        out, _ = cluster(own, alg, params, metrics=False)
        return out.withColumn("algorithm", F.lit(alg))

    with ThreadPoolExecutor(max_workers=min(8, max(1, len(level_config)))) as pool:
        outs = [out for out in pool.map(level, level_config.items()) if out is not None]
    if not outs:
        raise ValueError("no vectors of the configured types")
    return reduce(lambda a, b: a.unionByName(b), outs)


# The default per-level configuration.
DEFAULT_LEVELS = {
    "document": ("hdbscan", {"min_cluster_size": 5}),
    "event": ("hdbscan", {"min_cluster_size": 5}),
    "entity": ("agglomerative", {"distance_threshold": 0.3}),
    "storyline": ("kmeans", {"n_clusters": 20}),
}


def compare_algorithms(df: DataFrame, runs: dict[str, tuple[str, dict]]) -> DataFrame:
    """C14: the same data through several algorithms, comparable metrics side by side."""
    rows = []
    with ThreadPoolExecutor(max_workers=min(8, max(1, len(runs)))) as pool:
        infos = list(pool.map(lambda item: cluster(df, item[1][0], item[1][1])[1], runs.items()))
    for (run, (alg, params)), info in zip(runs.items(), infos):
        rows.append((run, alg, int(info["n_clusters"]), int(info["outlier_count"]),
                     info.get("silhouette_score"), info.get("davies_bouldin_index"),
                     info.get("avg_intra_cluster_similarity")))
    return df.sparkSession.createDataFrame(
        rows, "run string, algorithm string, n_clusters long, outlier_count long, silhouette_score double, "
              "davies_bouldin_index double, avg_intra_cluster_similarity double")


def resolve_entities(mentions: DataFrame, threshold: float = 0.3, metric: str = "cosine",
                     group: str = "entity_type", text: str = "item_id") -> DataFrame:
    """Mentions -> canonical entity by average linkage at a threshold, within each type.

    ``canonical_form``: the most frequent ``text`` of the cluster, ties by text.
    """
    out = cut_lineage(cluster_by_group(mentions, [group], "agglomerative",
                                       {"distance_threshold": threshold, "linkage": "average", "metric": metric}))
    names = out.where(F.col("label") >= 0).groupBy("label", F.col(text).alias("_text")).agg(F.count("*").alias("_n"))
    form = names.groupBy("label").agg(F.min_by("_text", F.struct(-F.col("_n"), F.col("_text"))).alias("canonical_form"))
    return out.join(form, "label", "left")


def search_then_cluster(df: DataFrame, queries: DataFrame, k: int, algorithm: str, params: dict | None = None,
                        **options) -> tuple[DataFrame, dict]:
    """Cluster (C7) only the items that are among the k nearest of some query (Q1)."""
    from clusterloom.operators.neighbors import knn_search

    hits = knn_search(df, queries, k).select(F.col("id").alias("pos")).distinct()
    return cluster(df.join(hits, "pos", "left_semi"), algorithm, params, **options)


def two_stage_cluster(df: DataFrame, pre_k: int, refine_algorithm: str, refine_params: dict,
                      seed: int = 42) -> DataFrame:
    """K-Means pre-clusters, then a finer algorithm inside each pre-cluster (C9 keyed by it)."""
    from clusterloom.operators.kmeans import kmeans

    pre, _ = kmeans(df, pre_k, n_init=3, seed=seed)
    keyed = df.join(pre.select("pos", F.col("label").alias("pre_cluster")), "pos")
    return cluster_by_group(keyed, ["pre_cluster"], refine_algorithm, refine_params)


def cluster_temporal_windows(df: DataFrame, size_days: float, step_days: float, algorithm: str,
                             params: dict, days: str = "date_days") -> DataFrame:
    """C11: cluster only within sliding time windows; an item appears in every window covering it.

    Window starts are multiples of ``step_days``; each item is exploded to the
    ceil(size / step) windows that contain its date, then C9 keyed by window. An
    item without date is in no window and keeps label -1.
    """
    n_win = int(-(-size_days // step_days))
    starts = F.transform(F.sequence(F.lit(0), F.lit(n_win - 1)),
                         lambda j: (F.floor(F.col(days) / F.lit(step_days)) - j) * F.lit(step_days))
    inside = F.filter(starts, lambda s: F.col(days) < s + F.lit(size_days))
    win = df.withColumn("window_start_days", F.explode_outer(inside))
    return cluster_by_group(win, ["window_start_days"], algorithm, params)
