"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the driver tables (or data Spark derives from them) in full.
Doubles are rounded to 6 decimals and vectors are exploded to
``(label, pos, value)`` in compared outputs, identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions import vector as V
from clusterloom.operators import filters as FL
from clusterloom.operators import metrics as M
from clusterloom.operators import neighbors as N
from clusterloom.sources import testdata as TD
from clusterloom.sources.vectors import vector_set_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


ITEMS = "WITH " + TD.ITEMS_SQL
# truth-label centroids (mean per coordinate), shared by several oracles
CENT = """,
cent AS (
  SELECT truth_label AS label, list(v ORDER BY i) AS centroid, CAST(max(n) AS BIGINT) AS size FROM (
    SELECT truth_label, i, avg(x) AS v, count(*) AS n FROM (
      SELECT truth_label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM items)
    GROUP BY ALL)
  GROUP BY ALL)"""


def truth_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Items with the given labels as a ready-made clustering (``label``)."""
    return TD.items(spark, sf).withColumn("label", F.col("truth_label"))


def truth_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return M.centroids(truth_assign(spark, sf))


# --------------------------------------------------------------------------- S / F

@register("vector_set_stats", """
SELECT 'event' AS embedding_type, count(*) AS total_vectors,
       CAST(max(len(e.embedding)) AS INTEGER) AS dimension, count(*) AS metadata_count,
       count(*) > 0 AS ready
FROM embeddings e JOIN events v ON e.vec_id = v.event_id
""")
def q_vector_set_stats(spark, sf):
    """S6 over the stand-in vector set."""
    return vector_set_stats(TD.vector_set(spark, sf))


@register("clustering_metadata", ITEMS + """
SELECT item_id, domain, event_type, entity_type, round(date_days, 6) AS date_days FROM items
""")
def q_clustering_metadata(spark, sf):
    """S4 + F1: resolved ids, projected metadata, ISO dates parsed to days."""
    return TD.items(spark, sf).select("item_id", "domain", "event_type", "entity_type",
                                      r6("date_days").alias("date_days"))


@register("metadata_filters", ITEMS + """
SELECT item_id, round(date_days, 6) AS date_days FROM items
WHERE domain = 'en'
  AND date_days BETWEEN CAST(epoch_us(TIMESTAMP '2024-01-01 12:00:00') AS DOUBLE) / 86400000000.0
                    AND CAST(epoch_us(TIMESTAMP '2024-01-02 02:30:00') AS DOUBLE) / 86400000000.0
""")
def q_metadata_filters(spark, sf):
    """F2 + F5 via F6: domain equality and an inclusive temporal window."""
    f = {"domain": "en", "temporal_window": {"start": "2024-01-01T12:00:00Z", "end": "2024-01-02T02:30:00"}}
    return FL.apply_metadata_filters(TD.items(spark, sf), f).select("item_id", r6("date_days").alias("date_days"))


@register("type_filters", ITEMS + """
SELECT item_id, event_type, entity_type FROM items WHERE event_type = 'click' AND entity_type = 'src7'
""")
def q_type_filters(spark, sf):
    """F3 + F4: event type and entity type equality."""
    df = FL.filter_entity_type(FL.filter_event_type(TD.items(spark, sf), "click"), "src7")
    return df.select("item_id", "event_type", "entity_type")


@register("search_filter", ITEMS + """
SELECT item_id, event_type, domain FROM items WHERE event_type IN ('click', 'view') AND domain = 'de'
""")
def q_search_filter(spark, sf):
    """list -> IN, scalar -> equality, null never matches."""
    return FL.matches_filters(TD.items(spark, sf), {"event_type": ["click", "view"], "domain": "de"}).select(
        "item_id", "event_type", "domain")


@register("result_counts", ITEMS + """
SELECT CAST(count(DISTINCT CASE WHEN label <> -1 THEN label END) AS BIGINT) AS n_clusters,
       count(*) FILTER (WHERE label = -1) AS outlier_count, count(*) AS total
FROM (SELECT CASE WHEN domain = 'en' THEN truth_label ELSE -1 END AS label FROM items)
""")
def q_result_counts(spark, sf):
    """F8 + A1: rows removed by a filter are mapped back as -1, then counted."""
    it = TD.items(spark, sf)
    kept = FL.apply_metadata_filters(it, {"domain": "en"}).select("pos", F.col("truth_label").alias("label"))
    return M.result_counts(FL.map_back_labels(it, kept, id_col="pos", prob_col=None))


# --------------------------------------------------------------------------- V

@register("temporal_weighting", ITEMS + """,
f AS (SELECT * FROM items WHERE event_type = 'purchase')
SELECT item_id,
       round(coalesce(exp(-abs(date_days - (SELECT max(date_days) FROM f)) / 7.0), 1.0), 6) AS weight,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))) *
             coalesce(exp(-abs(date_days - (SELECT max(date_days) FROM f)) / 7.0), 1.0), 6) AS weighted_norm
FROM f
""")
def q_temporal_weighting(spark, sf):
    """V7: recency weight against the latest date of the filtered set, 7-day decay."""
    f = FL.filter_event_type(TD.items(spark, sf), "purchase")
    w = V.apply_temporal_weighting(f, decay_days=7.0, out="weighted")
    return w.select("item_id", r6("temporal_weight").alias("weight"), r6(V.l2_norm("weighted")).alias("weighted_norm"))


@register("vector_functions", ITEMS + CENT + """
SELECT i.item_id,
       round(list_dot_product(i.embedding, c.centroid), 6) AS dot,
       round(sqrt(list_sum(list_transform(i.embedding, lambda x: x * x))), 6) AS norm,
       round(list_distance(i.embedding, c.centroid), 6) AS l2,
       round(list_distance(i.embedding, c.centroid) * list_distance(i.embedding, c.centroid), 6) AS sq_l2,
       round(list_cosine_similarity(i.embedding, c.centroid), 6) AS cosine,
       round(1 - list_cosine_similarity(i.embedding, c.centroid), 6) AS cosine_distance,
       round(list_sum(list_transform(list_zip(i.embedding, c.centroid), lambda p: abs(p[1] - p[2]))), 6) AS manhattan,
       round(1.0 / (1.0 + list_distance(i.embedding, c.centroid)), 6) AS similarity,
       round(sqrt(list_sum(list_transform(c.centroid, lambda x: x * x))), 6) AS centroid_norm
FROM items i JOIN cent c ON c.label = i.truth_label
""")
def q_vector_functions(spark, sf):
    """V1-V6, V9: every distance / similarity between an item and its label centroid."""
    a = M.with_centroid(truth_assign(spark, sf), truth_centroids(spark, sf))
    return a.select(
        "item_id",
        r6(V.dot("embedding", "_centroid")).alias("dot"),
        r6(V.l2_norm("embedding")).alias("norm"),
        r6(V.l2_distance("embedding", "_centroid")).alias("l2"),
        r6(V.squared_l2("embedding", "_centroid")).alias("sq_l2"),
        r6(V.cosine_similarity("embedding", "_centroid")).alias("cosine"),
        r6(V.cosine_distance("embedding", "_centroid")).alias("cosine_distance"),
        r6(V.manhattan("embedding", "_centroid")).alias("manhattan"),
        r6(V.distance_to_similarity(V.l2_distance("embedding", "_centroid"))).alias("similarity"),
        r6(V.l2_norm(V.l2_normalize("_centroid")) * V.l2_norm("_centroid")).alias("centroid_norm"))


@register("distance_confidence", ITEMS + CENT + """,
d AS (SELECT i.item_id, i.domain, list_distance(i.embedding, c.centroid) AS distance
      FROM items i JOIN cent c ON c.label = i.truth_label)
SELECT item_id,
       round(CASE WHEN domain = 'en' THEN
               CASE WHEN (SELECT max(distance) FROM d WHERE domain = 'en') > 0
                    THEN exp(-distance / (SELECT max(distance) FROM d WHERE domain = 'en')) END
             ELSE 0.0 END, 6) AS confidence
FROM d
""")
def q_distance_confidence(spark, sf):
    """exp(-d / max d) over the kept rows; rows outside the filter get 0."""
    a = M.with_centroid(truth_assign(spark, sf), truth_centroids(spark, sf))
    a = a.withColumn("distance", V.l2_distance("embedding", "_centroid"))
    out = V.distance_confidence(a, "distance", keep=F.coalesce(F.col("domain") == "en", F.lit(False)))
    return out.select("item_id", r6("confidence").alias("confidence"))


@register("sql_vector_functions", ITEMS + CENT + """
SELECT i.pos AS pos,
       round(list_distance(i.embedding, c.centroid), 6) AS l2,
       round(list_cosine_similarity(i.embedding, c.centroid), 6) AS cosine,
       round(coalesce(exp(-abs(i.date_days - 19723.0) / 30.0), 1.0), 6) AS weight
FROM items i JOIN cent c ON c.label = i.truth_label
""")
def q_sql_vector_functions(spark, sf):
    """The vector functions called from Spark SQL (temporary SQL functions)."""
    V.register_sql_functions(spark)
    TD.items(spark, sf).createOrReplaceTempView("cl_items")
    return spark.sql("""
        WITH coords AS (
          SELECT truth_label, p, avg(CAST(x AS DOUBLE)) AS v
          FROM cl_items LATERAL VIEW posexplode(embedding) t AS p, x GROUP BY truth_label, p),
        cent AS (
          SELECT truth_label, transform(array_sort(collect_list(struct(p, v))), s -> s.v) AS centroid
          FROM coords GROUP BY truth_label)
        SELECT i.pos AS pos,
               round(vec_l2(transform(i.embedding, x -> CAST(x AS DOUBLE)), c.centroid), 6) AS l2,
               round(vec_cosine(transform(i.embedding, x -> CAST(x AS DOUBLE)), c.centroid), 6) AS cosine,
               round(temporal_weight(i.date_days, 19723D, 30D), 6) AS weight
        FROM cl_items i JOIN cent c ON c.truth_label = i.truth_label""")


# --------------------------------------------------------------------------- A (over the given labels)

@register("centroids", ITEMS + CENT + """
SELECT label, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS pos,
       round(unnest(centroid), 6) AS value, size
FROM cent
""")
def q_centroids(spark, sf):
    """A2: mean vector per label, exploded to (label, pos, value)."""
    c = truth_centroids(spark, sf)
    return c.select("label", "size", F.posexplode("centroid").alias("pos", "v")).select(
        "label", "pos", r6("v").alias("value"), "size")


@register("intra_similarity", ITEMS + CENT + """
SELECT i.truth_label AS label, round(avg(list_cosine_similarity(i.embedding, c.centroid)), 6) AS intra_similarity
FROM items i JOIN cent c ON c.label = i.truth_label GROUP BY i.truth_label
""")
def q_intra_similarity(spark, sf):
    """A5 per cluster: mean cosine of members to their centroid."""
    per, _ = M.intra_similarity(truth_assign(spark, sf))
    return per.select("label", r6("intra_similarity").alias("intra_similarity"))


@register("intra_similarity_overall", ITEMS + CENT + """
SELECT round(avg(s), 6) AS avg_intra_cluster_similarity FROM (
  SELECT avg(list_cosine_similarity(i.embedding, c.centroid)) AS s
  FROM items i JOIN cent c ON c.label = i.truth_label GROUP BY i.truth_label)
""")
def q_intra_similarity_overall(spark, sf):
    """A5 overall: unweighted mean over clusters."""
    _, overall = M.intra_similarity(truth_assign(spark, sf))
    return overall.select(r6("avg_intra_cluster_similarity").alias("avg_intra_cluster_similarity"))


@register("pairwise_intra_similarity", ITEMS + """
SELECT a.truth_label AS label, CAST(count(DISTINCT a.pos) AS BIGINT) AS size,
       round(avg(list_cosine_similarity(a.embedding, b.embedding)), 6) AS pairwise_similarity
FROM items a JOIN items b ON a.truth_label = b.truth_label AND a.pos <> b.pos
GROUP BY a.truth_label
""")
def q_pairwise_intra_similarity(spark, sf):
    """Mean pairwise cosine per cluster from the norm of the summed unit vectors."""
    return M.pairwise_intra_similarity(truth_assign(spark, sf)).select(
        "label", "size", r6("pairwise_similarity").alias("pairwise_similarity"))


@register("inertia", ITEMS + CENT + """
SELECT round(sum(list_distance(i.embedding, c.centroid) * list_distance(i.embedding, c.centroid)), 6) AS inertia
FROM items i JOIN cent c ON c.label = i.truth_label
""")
def q_inertia(spark, sf):
    """Sum of squared distances to the own centroid."""
    return M.inertia(truth_assign(spark, sf)).select(r6("inertia").alias("inertia"))


SIL_SQL = ITEMS + """,
m AS (SELECT a.pos, a.truth_label AS own, b.truth_label AS label, avg(list_distance(a.embedding, b.embedding)) AS m
      FROM items a JOIN items b ON a.pos <> b.pos GROUP BY ALL),
s AS (SELECT pos, own, max(m) FILTER (WHERE label = own) AS a, min(m) FILTER (WHERE label <> own) AS b
      FROM m GROUP BY ALL),
p AS (SELECT pos, own AS label, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette
      FROM s WHERE b IS NOT NULL)
"""


@register("silhouette", SIL_SQL + """
SELECT label, round(avg(silhouette), 6) AS silhouette FROM p GROUP BY label
""")
def q_silhouette(spark, sf):
    """A3 per cluster: exact silhouette through blocked per-(point, cluster) distance sums."""
    _, per_cluster = M.silhouette(truth_assign(spark, sf))
    return per_cluster.select("label", r6("silhouette").alias("silhouette"))


@register("silhouette_overall", SIL_SQL + """
SELECT round(avg(silhouette), 6) AS silhouette_score FROM p
""")
def q_silhouette_overall(spark, sf):
    """A3 overall: mean of the per-point scores."""
    per, _ = M.silhouette(truth_assign(spark, sf))
    return per.agg(r6(F.avg("silhouette")).alias("silhouette_score"))


@register("davies_bouldin", ITEMS + CENT + """,
sc AS (SELECT c.label, c.centroid, avg(list_distance(i.embedding, c.centroid)) AS s
       FROM items i JOIN cent c ON c.label = i.truth_label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin_index FROM (
  SELECT a.label, max((a.s + b.s) / list_distance(a.centroid, b.centroid)) AS r
  FROM sc a JOIN sc b ON a.label <> b.label GROUP BY a.label)
""")
def q_davies_bouldin(spark, sf):
    """A4: Davies-Bouldin index over the given labels."""
    return M.davies_bouldin(truth_assign(spark, sf)).select(
        r6("davies_bouldin_index").alias("davies_bouldin_index"))


@register("metadata_coverage", ITEMS + """
SELECT count(*) AS total_items, count(domain) AS with_domain, count(event_type) AS with_event_type,
       count(date_days) AS with_date FROM items
""")
def q_metadata_coverage(spark, sf):
    """Items carrying each clustering attribute."""
    return M.metadata_coverage(TD.items(spark, sf))


# --------------------------------------------------------------------------- Q / J

@register("knn_graph", ITEMS + """
SELECT id, nbr_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM (
  SELECT a.pos AS id, b.pos AS nbr_id, list_distance(a.embedding, b.embedding) AS dist,
         row_number() OVER (PARTITION BY a.pos ORDER BY list_distance(a.embedding, b.embedding), b.pos) AS rank
  FROM items a JOIN items b ON a.pos <> b.pos)
WHERE rank <= 5
""")
def q_knn_graph(spark, sf):
    """Q6: 5 nearest neighbours of every item (blocked cogroup, exact)."""
    g = N.knn_graph(TD.items(spark, sf), 5)
    return g.select("id", "nbr_id", "rank", r6("dist").alias("dist"))


KNN_SQL = ITEMS + CENT + """,
base AS (SELECT * FROM items {where})
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM (
  SELECT CAST(c.label AS BIGINT) AS query_id, b.pos AS id,
         list_distance(b.embedding, c.centroid) * list_distance(b.embedding, c.centroid) AS dist,
         row_number() OVER (PARTITION BY c.label ORDER BY list_distance(b.embedding, c.centroid), b.pos) AS rank
  FROM cent c, base b)
WHERE rank <= {k}
"""


def _label_queries(spark, sf):
    return truth_centroids(spark, sf).select(F.col("label").cast("long").alias("query_id"),
                                             F.col("centroid").alias("query_vector"))


@register("knn_search", KNN_SQL.format(where="", k=10))
def q_knn_search(spark, sf):
    """Q1 + Q3: top-10 items by squared L2 for each label centroid, padded to k."""
    it = TD.items(spark, sf)
    qs = _label_queries(spark, sf)
    hits = N.pad_results(N.knn_search(it, qs, 10), qs, 10)
    return hits.select("query_id", "rank", "id", r6("dist").alias("dist"))


@register("knn_search_prefilter", KNN_SQL.format(where="WHERE event_type = 'click'", k=5))
def q_knn_search_prefilter(spark, sf):
    """Q4: exact filtered top-5 (filter first)."""
    h = N.knn_search_prefilter(TD.items(spark, sf), _label_queries(spark, sf), 5, {"event_type": "click"})
    return h.select("query_id", "rank", "id", r6("dist").alias("dist"))


@register("knn_search_postfilter", ITEMS + CENT + """,
cand AS (SELECT * FROM (
  SELECT CAST(c.label AS BIGINT) AS query_id, b.pos AS id, b.event_type,
         list_distance(b.embedding, c.centroid) * list_distance(b.embedding, c.centroid) AS dist,
         row_number() OVER (PARTITION BY c.label ORDER BY list_distance(b.embedding, c.centroid), b.pos) AS r
  FROM cent c, items b) WHERE r <= 30),
kept AS (SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM cand
         WHERE event_type = 'click'),
slots AS (SELECT CAST(label AS BIGINT) AS query_id, unnest(range(1, 4)) AS rank FROM cent)
SELECT s.query_id, CAST(s.rank AS INTEGER) AS rank, coalesce(k.id, -1) AS id,
       coalesce(round(k.dist, 6), CAST('inf' AS DOUBLE)) AS dist
FROM slots s LEFT JOIN kept k ON k.query_id = s.query_id AND k.rank = s.rank
""")
def q_knn_search_postfilter(spark, sf):
    """Q2 + Q3: the nearest 10 x 3 candidates, those of a type, the first 3, empty slots padded."""
    qs = _label_queries(spark, sf)
    h = N.knn_search_postfilter(TD.items(spark, sf), qs, 3, {"event_type": "click"})
    return N.pad_results(h, qs, 3).select("query_id", "rank", "id", r6("dist").alias("dist"))


@register("pairs_within", ITEMS + """
SELECT a.pos AS id_a, b.pos AS id_b, round(list_distance(a.embedding, b.embedding), 6) AS dist
FROM items a JOIN items b ON a.pos < b.pos WHERE list_distance(a.embedding, b.embedding) <= 1.15
""")
def q_pairs_within(spark, sf):
    """Range join, all pairs within distance 1.15 (blocked, exact)."""
    p = N.pairs_within(TD.items(spark, sf), 1.15)
    return p.select("id_a", "id_b", r6("dist").alias("dist"))


@register("pairs_within_days", ITEMS + """
SELECT a.pos AS id_a, b.pos AS id_b, round(abs(a.date_days - b.date_days), 6) AS gap_days,
       round(list_distance(a.embedding, b.embedding), 6) AS dist
FROM items a JOIN items b ON a.pos < b.pos
WHERE abs(a.date_days - b.date_days) <= 0.5 AND list_distance(a.embedding, b.embedding) <= 1.3
""")
def q_pairs_within_days(spark, sf):
    """Interval join (date gap <= 0.5 day) with a distance threshold."""
    p = N.pairs_within_days(TD.items(spark, sf), 0.5, threshold=1.3)
    return p.select("id_a", "id_b", r6("gap_days").alias("gap_days"), r6("dist").alias("dist"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def _load_all() -> None:
    """Import the modules that register further queries."""
    import clusterloom.plans.cluster_queries  # noqa: F401
    import clusterloom.plans.job_queries  # noqa: F401
    import clusterloom.plans.result_queries  # noqa: F401
