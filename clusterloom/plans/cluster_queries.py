"""Registered clustering queries (C*, and metrics over their results)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.functions import vector as V
from clusterloom.operators import filters as FL
from clusterloom.operators import kmeans as KM
from clusterloom.operators import metrics as M
from clusterloom.operators.profiles import cluster_profile
from clusterloom.plans.catalog import CENT, ITEMS, r6, register, truth_assign, truth_centroids
from clusterloom.sources import testdata as TD


def flagship(spark, sf, event_type: str = "purchase", k: int = 10, decay_days: float = 7.0,
             n_init: int = 10):
    """Slice query: filter one event type, weight by recency, K-Means, map back, profile.

    items -> C7 with F3, V7 (7-day decay against the latest purchase), C1 (k=10, best of
    n_init) and F8 onto all items (other event types become -1) -> A10 per cluster.
    """
    from clusterloom.plans.clustering import cluster

    full, _ = cluster(TD.items(spark, sf), "kmeans", {"n_clusters": k, "n_init": n_init},
                      filters={"event_type": event_type}, temporal_decay_days=decay_days, metrics=False)
    prof = cluster_profile(full)
    return prof.select(
        "label", "size", "exemplar_id", r6("mean_distance").alias("mean_distance"),
        r6("cohesion").alias("avg_similarity"), r6("separation").alias("separation"),
        r6("min_date_days").alias("min_date_days"), r6("max_date_days").alias("max_date_days"),
        r6("temporal_span_days").alias("temporal_span_days"), "dominant_event_type", "dominant_domain",
        "domains", "entity_types", "top_members")


@register("kmeans_event_clusters")
def q_kmeans_event_clusters(spark, sf):
    """C1 end to end (rows-only check: labels depend on MLlib's initialisation)."""
    return flagship(spark, sf)


LLOYD_SQL = ITEMS + CENT + """,
asg AS (SELECT pos, truth_label, label, embedding FROM (
  SELECT i.pos, i.truth_label, i.embedding, c.label,
         row_number() OVER (PARTITION BY i.pos ORDER BY list_distance(i.embedding, c.centroid), c.label) AS r
  FROM items i, cent c) WHERE r = 1)
"""


@register("kmeans_lloyd_step", LLOYD_SQL + """
SELECT label, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS pos, round(unnest(centroid), 6) AS value,
       size
FROM (SELECT label, list(v ORDER BY i) AS centroid, CAST(max(n) AS BIGINT) AS size FROM (
        SELECT label, i, avg(x) AS v, count(*) AS n FROM (
          SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM asg) GROUP BY ALL)
      GROUP BY ALL)
""")
def q_kmeans_lloyd_step(spark, sf):
    """C1 core step: assign to the nearest of the label centroids (J3), recompute means (A2)."""
    _, new = KM.lloyd_step(truth_assign(spark, sf), truth_centroids(spark, sf))
    return new.select("label", "size", F.posexplode("centroid").alias("pos", "v")).select(
        "label", "pos", r6("v").alias("value"), "size")


@register("label_quality", LLOYD_SQL + """,
cont AS (SELECT label, truth_label, count(*) AS n FROM asg GROUP BY ALL),
bl AS (SELECT label, sum(n) AS n, max(n) AS top FROM cont GROUP BY label),
bt AS (SELECT truth_label, sum(n) AS n FROM cont GROUP BY truth_label)
SELECT round((SELECT sum(n * (n - 1) / 2) FROM cont) / (SELECT sum(n * (n - 1) / 2) FROM bl), 6) AS precision,
       round((SELECT sum(n * (n - 1) / 2) FROM cont) / (SELECT sum(n * (n - 1) / 2) FROM bt), 6) AS recall,
       round((SELECT sum(top) FROM bl) / (SELECT sum(n) FROM bl), 6) AS purity,
       round((SELECT sum(n) FROM bl) / (SELECT sum(n) FROM bt), 6) AS coverage
""")
def q_label_quality(spark, sf):
    """Pairwise precision / recall, purity, coverage of the Lloyd-step labels vs the given labels."""
    asg, _ = KM.lloyd_step(truth_assign(spark, sf), truth_centroids(spark, sf))
    truth = TD.items(spark, sf).select("item_id", "truth_label")
    q = M.label_quality(asg.join(truth, "item_id"))
    return q.select(*[r6(c).alias(c) for c in ("precision", "recall", "purity", "coverage")])


# --------------------------------------------------------------------------- graph: C4 single, C5, C6a-c

from clusterloom.operators import graph as G  # noqa: E402

CC_SQL = ITEMS + """,
edges AS (
  SELECT a.pos AS a, b.pos AS b FROM items a JOIN items b ON a.pos <> b.pos
  WHERE list_distance(a.embedding, b.embedding) <= {t}),
cc AS (SELECT id, min(comp) AS component FROM (
  WITH RECURSIVE walk(id, comp) AS (
    SELECT pos, pos FROM items
    UNION
    SELECT e.b, w.comp FROM walk w JOIN edges e ON w.id = e.a)
  SELECT * FROM walk) GROUP BY id)
"""


@register("threshold_components", CC_SQL.format(t=1.15) + """
SELECT id, component FROM cc
""")
def q_threshold_components(spark, sf):
    """Connected components of the graph of pairs within 1.15 (star rounds)."""
    return G.threshold_components(TD.items(spark, sf), 1.15)


@register("single_linkage_threshold", CC_SQL.format(t=1.15) + """,
sizes AS (SELECT component, count(*) AS n, min(id) AS min_id FROM cc GROUP BY component),
ranked AS (SELECT component, CAST(row_number() OVER (ORDER BY n DESC, min_id) - 1 AS INTEGER) AS label FROM sizes)
SELECT cc.id AS pos, ranked.label FROM cc JOIN ranked USING (component)
""")
def q_single_linkage_threshold(spark, sf):
    """C4 single linkage, distance_threshold 1.15: Boruvka MST cut at the threshold."""
    return G.single_linkage(TD.items(spark, sf), distance_threshold=1.15).select("pos", "label")


@register("single_linkage_k")
def q_single_linkage_k(spark, sf):
    """C4 single linkage with n_clusters = 10: the 9 heaviest MST edges removed."""
    return G.single_linkage(TD.items(spark, sf), n_clusters=10).select("pos", "label")


@register("core_distances", ITEMS + """
SELECT pos, round(dist, 6) AS core_distance FROM (
  SELECT a.pos, list_distance(a.embedding, b.embedding) AS dist,
         row_number() OVER (PARTITION BY a.pos ORDER BY list_distance(a.embedding, b.embedding), b.pos) AS r
  FROM items a JOIN items b ON a.pos <> b.pos) WHERE r = 3
""")
def q_core_distances(spark, sf):
    """Distance to the 3rd nearest other point (min_samples = 3)."""
    return G.core_distances(TD.items(spark, sf), 3).select("pos", r6("core_distance").alias("core_distance"))


@register("mutual_reachability", ITEMS + """,
core AS (SELECT pos, dist AS core FROM (
  SELECT a.pos, list_distance(a.embedding, b.embedding) AS dist,
         row_number() OVER (PARTITION BY a.pos ORDER BY list_distance(a.embedding, b.embedding), b.pos) AS r
  FROM items a JOIN items b ON a.pos <> b.pos) WHERE r = 3)
SELECT a.pos AS id_a, b.pos AS id_b,
       round(greatest(ca.core, cb.core, list_distance(a.embedding, b.embedding)), 6) AS mreach
FROM items a JOIN items b ON a.pos < b.pos
JOIN core ca ON ca.pos = a.pos JOIN core cb ON cb.pos = b.pos
WHERE list_distance(a.embedding, b.embedding) <= 1.15
""")
def q_mutual_reachability(spark, sf):
    """Mutual reachability max(core_a, core_b, d / alpha) on the pairs within 1.15."""
    it = TD.items(spark, sf)
    from clusterloom.operators.neighbors import pairs_within

    mr = G.mutual_reachability(pairs_within(it, 1.15), G.core_distances(it, 3))
    return mr.select("id_a", "id_b", r6("mreach").alias("mreach"))


@register("minimum_spanning_tree")
def q_minimum_spanning_tree(spark, sf):
    """Boruvka MST of the mutual-reachability graph (min_samples = 3)."""
    it = TD.items(spark, sf)
    mst = G.minimum_spanning_forest(it, cores=G.core_distances(it, 3))
    return mst.select("lo", "hi", r6("w").alias("w"))


# --------------------------------------------------------------------------- W3, W4

from clusterloom.operators import profiles as P  # noqa: E402

ORDER_SQL = ITEMS + """,
o AS (SELECT truth_label AS label, item_id, date_days,
             row_number() OVER (PARTITION BY truth_label ORDER BY date_days, item_id) AS position FROM items),
g AS (SELECT label, item_id, position, date_days - lag(date_days) OVER (PARTITION BY label ORDER BY position)
             AS gap_days FROM o)
"""


@register("temporal_order", ORDER_SQL + """
SELECT label, item_id, position, round(gap_days, 6) AS gap_days FROM g
""")
def q_temporal_order(spark, sf):
    """W3 + W4: members in date order per cluster and the gap to the previous member."""
    gaps, _ = P.temporal_gaps(P.temporal_order(truth_assign(spark, sf)))
    return gaps.select("label", "item_id", "position", r6("gap_days").alias("gap_days"))


@register("temporal_patterns", ORDER_SQL + """
SELECT label, count(*) AS n_dated, round(max(gap_days), 6) AS max_gap_days,
       round(avg(gap_days), 6) AS mean_gap_days,
       CASE WHEN avg(gap_days) IS NULL THEN NULL WHEN avg(gap_days) < 1 THEN 'burst'
            WHEN avg(gap_days) < 2 THEN 'daily' WHEN avg(gap_days) BETWEEN 5 AND 9 THEN 'weekly'
            ELSE 'sporadic' END AS temporal_pattern
FROM g GROUP BY label
""")
def q_temporal_patterns(spark, sf):
    """Per-cluster max / mean gap and pattern class."""
    _, st = P.temporal_gaps(P.temporal_order(truth_assign(spark, sf)))
    return st.select("label", "n_dated", r6("max_gap_days").alias("max_gap_days"),
                     r6("mean_gap_days").alias("mean_gap_days"), "temporal_pattern")


# --------------------------------------------------------------------------- C4 ward / average / complete

from clusterloom.operators import agglomerative as AG  # noqa: E402


@register("agglomerative_ward")
def q_agglomerative_ward(spark, sf):
    """C4: ward linkage, n_clusters = 10 (reciprocal-nearest-neighbour rounds on centroids)."""
    labels, _ = AG.agglomerative(TD.items(spark, sf), n_clusters=10, linkage="ward")
    return labels.select("pos", "label")


@register("agglomerative_average")
def q_agglomerative_average(spark, sf):
    """C4: average linkage, cosine metric, n_clusters = 10 (pair-table rounds)."""
    labels, _ = AG.agglomerative(TD.items(spark, sf), n_clusters=10, linkage="average", metric="cosine")
    return labels.select("pos", "label")


@register("agglomerative_complete")
def q_agglomerative_complete(spark, sf):
    """C4: complete linkage, manhattan metric, distance_threshold = 9.0."""
    labels, _ = AG.agglomerative(TD.items(spark, sf), distance_threshold=9.0, linkage="complete",
                                 metric="manhattan")
    return labels.select("pos", "label")


# --------------------------------------------------------------------------- A10, S7-S9, J2

from clusterloom.sources import sinks as SK  # noqa: E402

PROFILE_SQL = ITEMS + CENT + """,
m AS (SELECT i.*, c.centroid, list_distance(i.embedding, c.centroid) AS d,
             list_cosine_similarity(i.embedding, c.centroid) AS cos
      FROM items i JOIN cent c ON c.label = i.truth_label),
sep AS (SELECT a.label, min(list_distance(a.centroid, b.centroid)) AS separation
        FROM cent a JOIN cent b ON a.label <> b.label GROUP BY a.label),
et AS (SELECT truth_label, event_type, count(*) AS n FROM items WHERE event_type IS NOT NULL GROUP BY ALL),
dom_et AS (SELECT truth_label, arg_min(event_type, (-n, event_type)) AS dominant_event_type FROM et GROUP BY ALL),
topm AS (SELECT truth_label, string_agg(item_id, ',' ORDER BY r) AS top_members FROM (
           SELECT truth_label, item_id, row_number() OVER (PARTITION BY truth_label ORDER BY d, item_id) AS r FROM m)
         WHERE r <= 5 GROUP BY ALL)
"""


@register("cluster_profile", PROFILE_SQL + """
SELECT m.truth_label AS label, count(*) AS size, arg_min(item_id, (d, item_id)) AS exemplar_id,
       round(avg(d), 6) AS mean_distance, round(avg(cos), 6) AS cohesion, round(max(sep.separation), 6) AS separation,
       round(min(date_days), 6) AS min_date_days, round(max(date_days) - min(date_days), 6) AS temporal_span_days,
       array_to_string(list_sort(list_distinct(list(domain) FILTER (WHERE domain IS NOT NULL))), ',') AS domains,
       array_to_string(list_sort(list_distinct(list(entity_type) FILTER (WHERE entity_type IS NOT NULL))), ',')
         AS entity_types,
       max(dom_et.dominant_event_type) AS dominant_event_type, max(topm.top_members) AS top_members
FROM m JOIN sep ON sep.label = m.truth_label JOIN dom_et USING (truth_label) JOIN topm USING (truth_label)
GROUP BY m.truth_label
""")
def q_cluster_profile(spark, sf):
    """A10: profile per cluster of the given labelling."""
    p = P.cluster_profile(truth_assign(spark, sf))
    return p.select(
        "label", "size", "exemplar_id", r6("mean_distance").alias("mean_distance"), r6("cohesion").alias("cohesion"),
        r6("separation").alias("separation"), r6("min_date_days").alias("min_date_days"),
        r6("temporal_span_days").alias("temporal_span_days"), F.array_join("domains", ",").alias("domains"),
        F.array_join("entity_types", ",").alias("entity_types"), "dominant_event_type",
        F.array_join("top_members", ",").alias("top_members"))


MEMB_SQL = ITEMS + CENT + """,
lab AS (SELECT *, CASE WHEN domain = 'en' THEN truth_label ELSE -1 END AS label FROM items),
cen AS (SELECT label, list(v ORDER BY i) AS centroid FROM (
          SELECT label, i, avg(x) AS v FROM (
            SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM lab WHERE label >= 0)
          GROUP BY ALL) GROUP BY ALL),
memb AS (SELECT CASE WHEN l.label = -1 THEN 'outlier' ELSE 'event_cluster_' || CAST(l.label AS VARCHAR) END
                  AS cluster_id, l.item_id AS member_id,
                CASE WHEN l.label >= 0 THEN list_distance(l.embedding, c.centroid) END AS distance_to_centroid
         FROM lab l LEFT JOIN cen c ON c.label = l.label)
"""


def _memberships(spark, sf):
    from clusterloom.operators import filters as FL2

    it = TD.items(spark, sf)
    kept = FL2.apply_metadata_filters(it, {"domain": "en"}).select("pos", F.col("truth_label").alias("label"))
    return SK.memberships(FL2.map_back_labels(it, kept, id_col="pos", prob_col=None), "truth", "event", "given")


@register("memberships", MEMB_SQL + """
SELECT cluster_id, member_id, round(distance_to_centroid, 6) AS distance_to_centroid,
       'truth' AS job_id, 'given' AS algorithm FROM memb
""")
def q_memberships(spark, sf):
    """Membership rows (filtered-out items are outliers without a distance)."""
    m = _memberships(spark, sf)
    return m.select("cluster_id", "member_id", r6("distance_to_centroid").alias("distance_to_centroid"),
                    "job_id", "algorithm")


@register("jobs_clusters_members", MEMB_SQL + """
SELECT 'truth' AS job_id, 'truth_' || replace(cluster_id, 'outlier', 'event_outlier') AS cluster_id,
       cluster_id = 'outlier' AS is_outlier, count(*) AS n_members,
       round(avg(1.0 / (1.0 + distance_to_centroid)), 6) AS avg_similarity
FROM memb GROUP BY cluster_id
UNION ALL
SELECT 'all', 'all_event_cluster_' || CAST(i.truth_label AS VARCHAR), false, count(*),
       round(avg(1.0 / (1.0 + list_distance(i.embedding, c.centroid))), 6)
FROM items i JOIN cent c ON c.label = i.truth_label GROUP BY i.truth_label
""")
def q_jobs_clusters_members(spark, sf):
    """S9 + J2: the tables of two jobs saved, read back, and joined job -> clusters -> members."""
    from clusterloom.operators import filters as FL2
    from clusterloom.session import table_path

    it = TD.items(spark, sf)
    root = table_path(spark)
    kept = FL2.apply_metadata_filters(it, {"domain": "en"}).select("pos", F.col("truth_label").alias("label"))
    runs = {"truth": FL2.map_back_labels(it, kept, id_col="pos", prob_col=None), "all": truth_assign(spark, sf)}
    for job, assign in runs.items():
        outliers = assign.where(F.col("label") == -1).count()
        SK.save_tables(root, assign.select(F.lit(job).alias("job_id"), F.lit("completed").alias("status")).limit(1),
                       SK.clusters_table(P.cluster_profile(assign), job, "event", outliers=outliers),
                       SK.members_table(SK.memberships(assign, job, "event", "given")))
    j = SK.jobs_clusters_members(*SK.read_tables(spark, root))
    return j.groupBy("job_id", "cluster_id", "is_outlier").agg(F.count("member_id").alias("n_members"),
                                                               r6(F.avg("similarity_score")).alias("avg_similarity"))


@register("clusters_jsonl", PROFILE_SQL + """
SELECT 'truth_event_cluster_' || CAST(m.truth_label AS VARCHAR) AS cluster_id, 'truth' AS job_id,
       m.truth_label AS cluster_label, count(*) AS size, false AS is_outlier, 'event' AS embedding_type,
       len(any_value(m.centroid)) AS dimension, round(avg(cos), 6) AS cohesion, round(max(sep.separation), 6) AS separation,
       round(max(date_days) - min(date_days), 6) AS temporal_span_days,
       array_to_string(list_sort(list_distinct(list(domain) FILTER (WHERE domain IS NOT NULL))), ',') AS domains,
       array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE event_type IS NOT NULL))), ',') AS event_types
FROM m JOIN sep ON sep.label = m.truth_label GROUP BY m.truth_label
""")
def q_clusters_jsonl(spark, sf):
    """S8 + S9: write the cluster table as partitioned JSON lines, read it back by type."""
    import uuid

    from clusterloom.session import ensure_checkpoint_dir

    prof = P.cluster_profile(truth_assign(spark, sf))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusters-jsonl/{uuid.uuid4().hex}"
    SK.write_clusters_jsonl(SK.clusters_table(prof, "truth", "event"), root)
    back = SK.read_clusters_jsonl(spark, root, "event")
    return back.select("cluster_id", "job_id", "cluster_label", "size", "is_outlier", "embedding_type",
                       F.size("centroid").cast("long").alias("dimension"), r6("cohesion").alias("cohesion"),
                       r6("separation").alias("separation"), r6("temporal_span_days").alias("temporal_span_days"),
                       F.array_join("domains", ",").alias("domains"), F.array_join("event_types", ",").alias("event_types"))


# --------------------------------------------------------------------------- C13, A11-A14

INC_SQL = ITEMS + """,
old AS (SELECT truth_label AS label, list(v ORDER BY i) AS centroid, CAST(max(n) AS BIGINT) AS size FROM (
          SELECT truth_label, i, avg(x) AS v, count(*) AS n FROM (
            SELECT truth_label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM items
            WHERE domain = 'en') GROUP BY ALL) GROUP BY ALL),
nw AS (SELECT * FROM items WHERE domain IS DISTINCT FROM 'en'),
asg AS (SELECT pos, embedding, CASE WHEN d <= 0.97 THEN label ELSE -1 END AS label FROM (
          SELECT n.pos, n.embedding, o.label, list_distance(n.embedding, o.centroid) AS d,
                 row_number() OVER (PARTITION BY n.pos ORDER BY list_distance(n.embedding, o.centroid), o.label) AS r
          FROM nw n, old o) WHERE r = 1)
"""


@register("incremental_assign", INC_SQL + """
SELECT pos, label FROM asg
""")
def q_incremental_assign(spark, sf):
    """Items outside the 'en' domain join the clusters built from 'en' items (cut-off 0.97)."""
    it = TD.items(spark, sf)
    base = it.where(F.col("domain") == "en").withColumn("label", F.col("truth_label"))
    cents = M.centroids(base)
    asg, _ = KM.incremental_assign(it.where(~F.coalesce(F.col("domain") == "en", F.lit(False))), cents, 0.97)
    return asg.select("pos", "label")


@register("incremental_centroids", INC_SQL + """,
upd AS (SELECT o.label, o.size + coalesce(a.m, 0) AS size, o.centroid, a.s, coalesce(a.m, 0) AS m FROM old o LEFT JOIN (
          SELECT label, max(c) AS m, list(v ORDER BY i) AS s FROM (
            SELECT label, i, sum(x) AS v, count(*) AS c FROM (
              SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM asg WHERE label >= 0)
            GROUP BY ALL) GROUP BY label) a USING (label))
SELECT label, CAST(size AS BIGINT) AS size, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS pos,
       round(unnest(CASE WHEN m > 0 THEN list_transform(list_zip(centroid, s),
               lambda p: (p[1] * (size - m) + p[2]) / size) ELSE centroid END), 6) AS value
FROM upd
""")
def q_incremental_centroids(spark, sf):
    """Updated sizes and centroids after the incremental assignment."""
    it = TD.items(spark, sf)
    base = it.where(F.col("domain") == "en").withColumn("label", F.col("truth_label"))
    _, upd = KM.incremental_assign(it.where(~F.coalesce(F.col("domain") == "en", F.lit(False))),
                                   M.centroids(base), 0.97)
    return upd.select("label", "size", F.posexplode("centroid").alias("pos", "v")).select(
        "label", "size", "pos", r6("v").alias("value"))


@register("cluster_top_entities", ITEMS + """
SELECT label, CAST(rank AS INTEGER) AS rank, value, n FROM (
  SELECT label, value, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, value) AS rank FROM (
    SELECT truth_label AS label, entity_type AS value, count(*) AS n
    FROM items WHERE entity_type IS NOT NULL GROUP BY truth_label, entity_type)) WHERE rank <= 3
""")
def q_cluster_top_entities(spark, sf):
    """A11-A14 'primary entities': top 3 entity types per cluster."""
    return P.top_values(truth_assign(spark, sf), "entity_type", 3).select("label", "rank", "value", "n")


@register("event_profile", ORDER_SQL + """,
cnt AS (SELECT truth_label AS label, count(*) AS size FROM items GROUP BY ALL),
et AS (SELECT truth_label AS label, arg_min(event_type, (-n, event_type)) AS dominant_event_type FROM (
         SELECT truth_label, event_type, count(*) AS n FROM items WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY ALL),
dm AS (SELECT truth_label AS label, arg_min(domain, (-n, domain)) AS dominant_domain FROM (
         SELECT truth_label, domain, count(*) AS n FROM items WHERE domain IS NOT NULL GROUP BY ALL) GROUP BY ALL),
en AS (SELECT label, string_agg(entity_type, ',' ORDER BY r) AS primary_entities FROM (
         SELECT label, entity_type, row_number() OVER (PARTITION BY label ORDER BY n DESC, entity_type) AS r FROM (
           SELECT truth_label AS label, entity_type, count(*) AS n FROM items WHERE entity_type IS NOT NULL GROUP BY ALL))
       WHERE r <= 3 GROUP BY label),
fe AS (SELECT label, string_agg(item_id, ',' ORDER BY position) AS first_events FROM o WHERE position <= 3 GROUP BY label),
pt AS (SELECT label, CASE WHEN avg(gap_days) IS NULL THEN NULL WHEN avg(gap_days) < 1 THEN 'burst'
            WHEN avg(gap_days) < 2 THEN 'daily' WHEN avg(gap_days) BETWEEN 5 AND 9 THEN 'weekly'
            ELSE 'sporadic' END AS temporal_pattern FROM g GROUP BY label)
SELECT label, size, dominant_event_type, dominant_domain, primary_entities, first_events, temporal_pattern
FROM cnt JOIN et USING (label) LEFT JOIN dm USING (label) LEFT JOIN en USING (label) JOIN fe USING (label) JOIN pt USING (label)
""")
def q_event_profile(spark, sf):
    """Dominant types, primary entities, first events and temporal pattern per cluster."""
    e = P.event_profile(truth_assign(spark, sf))
    return e.select("label", "size", "dominant_event_type", "dominant_domain",
                    F.array_join("primary_entities", ",").alias("primary_entities"),
                    F.array_join("first_events", ",").alias("first_events"), "temporal_pattern")


@register("split_on_gap", ORDER_SQL + """
SELECT label, item_id, position,
       CAST(sum(CASE WHEN gap_days > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY position
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
FROM g
""")
def q_split_on_gap(spark, sf):
    """Clusters split where consecutive members are more than 0.05 days apart."""
    return P.split_on_gap(truth_assign(spark, sf), 0.05).select("label", "item_id", "position", "segment")


# --------------------------------------------------------------------------- C7-C9, C14, C15

from clusterloom.plans import clustering as CL  # noqa: E402


@register("cluster_by_domain", ITEMS + """
SELECT domain, count(*) AS n_items, CASE WHEN domain IS NULL THEN 0 ELSE 3 END AS n_labels,
       CASE WHEN domain IS NULL THEN count(*) ELSE 0 END AS unlabelled, true AS labels_are_its_own
FROM items GROUP BY domain
""")
def q_cluster_by_domain(spark, sf):
    """K-Means (k = 3) separately inside each domain, labels made globally unique."""
    out = CL.cluster_by_group(TD.items(spark, sf), ["domain"], "kmeans", {"n_clusters": 3, "n_init": 3})
    labels = out.where(F.col("label") >= 0).groupBy("label").agg(F.count_distinct("domain").alias("n_domains"))
    j = out.join(labels, "label", "left")
    return j.groupBy("domain").agg(
        F.count("*").alias("n_items"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).cast("int").alias(
            "n_labels"), F.count_if(F.col("label") == -1).alias("unlabelled"),
        F.max(F.coalesce("n_domains", F.lit(1))).alias("_m")).select(
        "domain", "n_items", "n_labels", "unlabelled", (F.col("_m") == 1).alias("labels_are_its_own"))


@register("compare_algorithms")
def q_compare_algorithms(spark, sf):
    """C14 (through C7): all items by K-Means, single linkage and HDBSCAN, metrics side by side."""
    runs = {"kmeans": ("kmeans", {"n_clusters": 5, "n_init": 3}),
            "single": ("agglomerative", {"n_clusters": 5, "linkage": "single"}),
            "hdbscan": ("hdbscan", {"min_cluster_size": 5})}
    return CL.compare_algorithms(TD.items(spark, sf), runs)


@register("resolve_entities")
def q_resolve_entities(spark, sf):
    """All items resolved to canonical entities by average cosine linkage at 0.9, within each source."""
    return CL.resolve_entities(TD.items(spark, sf), threshold=0.9).select(
        "item_id", "entity_type", "label", "canonical_form")


@register("minibatch_kmeans")
def q_minibatch_kmeans(spark, sf):
    """Mini-batch K-Means (k = 10, batches of 128 in every task, one job a pass)."""
    out, _ = KM.minibatch_kmeans(TD.items(spark, sf), k=10, batch_size=128, max_iter=20)
    return out.select("pos", "label")


@register("minibatch_invariants", ITEMS + """
SELECT count(*) AS n_items, 10 AS n_labels, true AS every_item_at_its_nearest_centre, true AS within_two_percent_of_lloyd
FROM items
""")
def q_minibatch_invariants(spark, sf):
    """Ten labels, every item labelled, inertia at most 2 % above that of C1 with as many restarts."""
    it = TD.items(spark, sf)
    out, info = KM.minibatch_kmeans(it, k=10, batch_size=128, max_iter=30, n_init=10)
    _, full = KM.kmeans(it, k=10, n_init=10)
    total = out.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    return out.agg(F.count("*").alias("n_items"), F.count_distinct("label").cast("int").alias("n_labels"),
                   F.lit(abs(total - info["inertia"]) <= 1e-6 * total).alias("every_item_at_its_nearest_centre"),
                   F.lit(info["inertia"] <= 1.02 * full["inertia"]).alias("within_two_percent_of_lloyd"))


@register("estimate_k")
def q_estimate_k(spark, sf):
    """Elbow choice of k over k = 2..10 over all items."""
    k, costs = KM.estimate_k(TD.items(spark, sf), 2, 10)
    return spark.createDataFrame([(int(kk), float(c), int(kk) == int(k)) for kk, c in costs],
                                 "k int, inertia double, chosen boolean")


@register("two_stage_cluster")
def q_two_stage_cluster(spark, sf):
    """K-Means pre-clusters (k = 3), average-linkage refinement inside each at cosine 0.95."""
    out = CL.two_stage_cluster(TD.items(spark, sf), 3, "agglomerative",
                               {"distance_threshold": 0.95, "linkage": "average", "metric": "cosine"})
    return out.select("item_id", "pre_cluster", "label")


@register("cluster_temporal_windows")
def q_cluster_temporal_windows(spark, sf):
    """C11: K-Means (k = 3) inside 14-day windows sliding by 7 days."""
    out = CL.cluster_temporal_windows(TD.items(spark, sf), 14.0, 7.0, "kmeans", {"n_clusters": 3, "n_init": 3})
    return out.select("item_id", "window_start_days", "label")
