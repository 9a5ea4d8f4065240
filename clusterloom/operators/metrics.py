"""Clustering quality metrics.

Every metric is a DataFrame aggregation: partial aggregates per partition,
one shuffle on the cluster label. A label holding a third of the rows costs
nothing extra because sums, counts and vector means combine map-side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.vector import cosine_similarity, l2_distance, l2_normalize, squared_l2
from clusterloom.operators.blocks import (DEFAULT_BLOCK_ROWS, _stack, cluster_sum_reducer, n_blocks_for,
                                          pair_matrix, self_block_cogroup)


def result_counts(assign: DataFrame, label: str = "label") -> DataFrame:
    """A1: clusters (excluding -1), outliers (label -1) and total rows."""
    return assign.agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters"),
        F.count_if(F.col(label) == -1).alias("outlier_count"),
        F.count("*").alias("total"))


def centroids(assign: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """A2: mean vector and size per non-negative label (Summarizer: one partial buffer per label)."""
    return (assign.where(F.col(label) >= 0).groupBy(label)
            .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("centroid"),
                 F.count("*").alias("size")))


def with_centroid(assign: DataFrame, cents: DataFrame, label: str = "label") -> DataFrame:
    """Attach each row's own centroid (equi-join on label; AQE broadcasts the k-row side)."""
    return assign.join(cents.select(label, F.col("centroid").alias("_centroid")), label, "inner")


def intra_similarity(assign: DataFrame, cents: DataFrame | None = None, vec: str = "embedding",
                     label: str = "label") -> tuple[DataFrame, DataFrame]:
    """A5: per-cluster mean cosine to the centroid; overall = unweighted mean of clusters."""
    cents = centroids(assign, vec, label) if cents is None else cents
    per = (with_centroid(assign.where(F.col(label) >= 0), cents, label)
           .groupBy(label).agg(F.avg(cosine_similarity(vec, "_centroid")).alias("intra_similarity")))
    overall = per.agg(F.avg("intra_similarity").alias("avg_intra_cluster_similarity"))
    return per, overall


def pairwise_intra_similarity(assign: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Mean pairwise cosine inside each cluster without a pair join.

    With unit vectors u_i: sum_{i != j} u_i.u_j = |sum u|^2 - n, so the mean over
    the n(n-1) ordered pairs needs only the per-cluster vector sum.
    """
    s = (assign.where(F.col(label) >= 0)
         .withColumn("_u", l2_normalize(vec))
         .groupBy(label).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("_u")))).alias("_s"),
                             F.count("*").alias("size"),
                             F.sum(F.when(F.aggregate(F.col("_u"), F.lit(0.0), lambda a, x: a + x * x) > 0,
                                          1).otherwise(0)).alias("_nz")))
    sq = F.aggregate(F.col("_s"), F.lit(0.0), lambda a, x: a + x * x)
    return s.select(label, "size", F.when(F.col("size") > 1, (sq - F.col("_nz")) /
                                           (F.col("size") * (F.col("size") - 1)))
                    .alias("pairwise_similarity"))


def inertia(assign: DataFrame, cents: DataFrame | None = None, vec: str = "embedding",
            label: str = "label") -> DataFrame:
    """Sum of squared distances to the own centroid."""
    cents = centroids(assign, vec, label) if cents is None else cents
    return (with_centroid(assign.where(F.col(label) >= 0), cents, label)
            .agg(F.sum(squared_l2(vec, "_centroid")).alias("inertia")))


def density_metrics(assign: DataFrame, prob: str = "probability", score: str = "outlier_score") -> DataFrame:
    """Mean positive membership probability (null if none, trap D18) and mean outlier score."""
    return assign.agg(F.avg(F.when(F.col(prob) > 0, F.col(prob))).alias("avg_probability"),
                      F.avg(score).alias("avg_outlier_score"))


def silhouette(assign: DataFrame, id_col: str = "pos", vec: str = "embedding", label: str = "label",
               metric: str = "euclidean", block_rows: int = DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """A3: exact silhouette (outliers excluded) via blocked per-(point, cluster) distance sums.

    s(i) = (b - a) / max(a, b) with a = mean distance to the own cluster (self
    excluded), b = smallest mean distance to another cluster; a point alone in
    its cluster scores 0. Returns (per-point, per-cluster) frames; the overall
    score is the mean of the per-point column. Undefined (fewer than 2 points or
    labels) gives no rows.
    """
    pts = assign.where(F.col(label) != -1).select(
        F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_vec"),
        F.col(label).cast("long").alias("_label"))
    B = n_blocks_for(pts, block_rows)
    sums = self_block_cogroup(pts, cluster_sum_reducer(metric), "id long, label int, dsum double, cnt long", B)
    means = sums.groupBy("id", "label").agg((F.sum("dsum") / F.sum("cnt")).alias("m"))
    own = pts.select(F.col("_id").alias("id"), F.col("_label").cast("int").alias("own"))
    j = own.join(means, "id", "left")
    per = j.groupBy("id", "own").agg(
        F.max(F.when(F.col("label") == F.col("own"), F.col("m"))).alias("a"),
        F.min(F.when(F.col("label") != F.col("own"), F.col("m"))).alias("b"))
    s = (F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0))
         .otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))))
    per = per.select(F.col("id").alias(id_col), F.col("own").alias(label), F.coalesce(s, F.lit(0.0))
                     .alias("silhouette"), F.col("b").isNull().alias("_single_label"))
    # undefined when every point sees only its own label (one cluster) -> drop
    per = per.where(~F.col("_single_label")).drop("_single_label")
    per_cluster = per.groupBy(label).agg(F.avg("silhouette").alias("silhouette"))
    return per, per_cluster


def davies_bouldin(assign: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """A4: mean over clusters of max_j (s_i + s_j) / d(c_i, c_j), outliers excluded.

    s_i is the mean distance of members to their centroid. The centroid pair
    step runs through the blocked primitive over the k centroid rows.
    """
    cents = centroids(assign, vec, label)
    scat = (with_centroid(assign.where(F.col(label) >= 0), cents, label)
            .groupBy(label).agg(F.avg(l2_distance(vec, "_centroid")).alias("_s")))
    pts = cents.join(scat, label).select(F.col(label).cast("long").alias("_id"),
                                         F.col("centroid").alias("_vec"), F.col("_s").alias("_scat"))

    def red(l: pd.DataFrame, r: pd.DataFrame, diag: bool) -> pd.DataFrame:
        if len(l) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "ratio": pd.Series([], dtype="float64")})
        d = pair_matrix(_stack(l["_vec"]), _stack(r["r__vec"]))
        li, ri = l["_id"].to_numpy(np.int64), r["r__id"].to_numpy(np.int64)
        num = l["_scat"].to_numpy()[:, None] + r["r__scat"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 0, num / d, 0.0)  # coinciding centroids count as 0
        ratio = np.where(li[:, None] == ri[None, :], -np.inf, ratio)
        out = [pd.DataFrame({"id": li, "ratio": ratio.max(axis=1)})]
        if not diag:
            out.append(pd.DataFrame({"id": ri, "ratio": ratio.max(axis=0)}))
        return pd.concat(out, ignore_index=True)

    B = n_blocks_for(pts, DEFAULT_BLOCK_ROWS)
    ratios = self_block_cogroup(pts, red, "id long, ratio double", B)
    per = ratios.where(F.col("ratio") > float("-inf")).groupBy("id").agg(F.max("ratio").alias("r"))
    return per.agg(F.avg("r").alias("davies_bouldin_index"))


def metadata_coverage(items: DataFrame) -> DataFrame:
    """How many items carry a domain, an event type and a date."""
    return items.agg(F.count("*").alias("total_items"),
                     F.count_if(F.col("domain").isNotNull()).alias("with_domain"),
                     F.count_if(F.col("event_type").isNotNull()).alias("with_event_type"),
                     F.count_if(F.col("date_days").isNotNull()).alias("with_date"))


def label_quality(assign: DataFrame, truth: str = "truth_label", label: str = "label") -> DataFrame:
    """Pairwise precision / recall, purity and coverage against known labels.

    Contingency counts n(label, truth) come from one groupBy; pair counts use
    n (n - 1) / 2, so no pair is ever materialised. Outliers (-1) count as
    unclustered: they lower coverage and recall, and are not a cluster.
    """
    cont = assign.groupBy(label, truth).agg(F.count("*").alias("n"))
    clustered = cont.where(F.col(label) != -1)
    pairs = lambda c: c * (c - 1) / 2
    by_label = clustered.groupBy(label).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    by_truth = cont.groupBy(truth).agg(F.sum("n").alias("n"))
    tp = clustered.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    pred_pairs = by_label.agg(F.sum(pairs(F.col("n"))).alias("pp"), F.sum("top").alias("top"),
                              F.sum("n").alias("clustered"))
    true_pairs = by_truth.agg(F.sum(pairs(F.col("n"))).alias("tpairs"), F.sum("n").alias("total"))
    # three one-row aggregates combined by scalar subqueries (no join)
    return tp.select(
        F.try_divide(F.col("tp"), pred_pairs.select("pp").scalar()).alias("precision"),
        F.try_divide(F.col("tp"), true_pairs.select("tpairs").scalar()).alias("recall"),
        F.try_divide(pred_pairs.select("top").scalar(), pred_pairs.select("clustered").scalar())
        .alias("purity"),
        F.try_divide(pred_pairs.select("clustered").scalar(), true_pairs.select("total").scalar())
        .alias("coverage"))
