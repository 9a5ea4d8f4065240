"""Cluster profiles (A10-A14) and job / service statistics.

A profile is one ``groupBy(label)`` with partial aggregates only: counts,
sums, min/max, ``min_by`` and sets over bounded vocabularies (domains, event
types, entity types). Member lists, which grow with the cluster, are never
collected into a profile row; they live in the members table (S9) and are
paged by W2. A profile carries a bounded top-N of exemplars instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.vector import cosine_similarity, l2_distance
from clusterloom.operators.metrics import centroids as centroids_of
from clusterloom.operators.metrics import with_centroid
from clusterloom.operators.topn import top_n_per_group

TOP_EXEMPLARS = 5


def cluster_profile(assign: DataFrame, vec: str = "embedding", label: str = "label",
                    id_col: str = "item_id", cents: DataFrame | None = None,
                    top_n: int = TOP_EXEMPLARS) -> DataFrame:
    """A10: one row per cluster with size, centroid, exemplar, cohesion, dates and vocabularies.

    * exemplar: the member closest to the centroid (``min_by``), ties by id;
    * mean_distance / cohesion: mean L2 distance / mean cosine to the centroid;
    * separation: distance to the nearest other centroid (k-row pair step);
    * density: members per unit of mean distance (size / (mean distance + 1));
    * min/max date, span in days; sorted distinct domains, event and entity types;
    * the source documents are the rows of ``cluster_documents``;
    * top_members: the ``top_n`` members nearest the centroid (a bounded report).
    """
    cents = centroids_of(assign, vec, label) if cents is None else cents
    m = with_centroid(assign.where(F.col(label) >= 0), cents, label)
    m = m.withColumn("_d", l2_distance(vec, "_centroid")).withColumn("_cos", cosine_similarity(vec, "_centroid"))
    prof = m.groupBy(label).agg(
        F.count("*").alias("size"),
        F.min_by(F.col(id_col), F.struct(F.col("_d"), F.col(id_col))).alias("exemplar_id"),
        F.avg("_d").alias("mean_distance"),
        F.avg("_cos").alias("cohesion"),
        F.min("date_days").alias("min_date_days"),
        F.max("date_days").alias("max_date_days"),
        F.array_sort(F.collect_set("domain")).alias("domains"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
        F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
        F.mode("event_type", deterministic=True).alias("dominant_event_type"),
        F.mode("domain", deterministic=True).alias("dominant_domain"),
    ).withColumn("density", F.col("size") / (F.col("mean_distance") + 1.0)).withColumn("temporal_span_days", F.col("max_date_days") - F.col("min_date_days"))
    # nearest-member report: rank inside each cluster, keep top_n (a top-k feature)
    top = (top_n_per_group(m.select(label, id_col, "_d"), [label], [F.col("_d"), F.col(id_col)], top_n,
                           [id_col], rank_col="_r")
           .groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_r", id_col))).alias("_t"))
           .select(label, F.transform("_t", lambda s: s[id_col]).alias("top_members")))
    sep = separation(cents, label)
    return (prof.join(cents.select(label, "centroid"), label).join(sep, label, "left")
            .join(top, label, "left"))


def separation(cents: DataFrame, label: str = "label") -> DataFrame:
    """Distance from every centroid to its nearest other centroid (blocked over k rows)."""
    from clusterloom.operators.neighbors import knn_graph

    g = knn_graph(cents, 1, id_col=label, vec="centroid")
    return g.select(F.col("id").cast("int").alias(label), F.col("dist").alias("separation"))


def temporal_order(assign: DataFrame, label: str = "label", id_col: str = "item_id",
                   days: str = "date_days") -> DataFrame:
    """Members ordered by (date, id) inside each cluster: ``position`` from 1.

    One distributed sort over (label, date, id) numbers all rows globally; a
    member's position in its cluster is its global position minus the
    cluster's first global position (a partial ``min``). No window is
    partitioned by cluster, so a hot cluster is sorted across many tasks.
    """
    from clusterloom.operators.jobs import global_rank

    rows = assign.where((F.col(label) >= 0) & F.col(days).isNotNull()).select(label, id_col, days)
    ranked = global_rank(rows, [F.asc(label), F.asc(days), F.asc(id_col)], "_g")
    first = ranked.groupBy(label).agg(F.min("_g").alias("_g0"))
    return (ranked.join(first, label).withColumn("position", F.col("_g") - F.col("_g0") + 1)
            .drop("_g0"))


def temporal_gaps(ordered: DataFrame, label: str = "label", id_col: str = "item_id",
                  days: str = "date_days") -> tuple[DataFrame, DataFrame]:
    """Gap to the previous member and per-cluster gap statistics with a pattern class.

    The previous member is found by an equi-join on (label, position - 1).
    Pattern (on the mean gap in days): burst < 1, daily < 2, weekly 5-9,
    otherwise sporadic; a cluster with one dated member has no pattern.
    """
    prev = ordered.select(label, (F.col("position") + 1).alias("position"), F.col(days).alias("_prev"))
    gaps = (ordered.join(prev, [label, "position"], "left")
            .withColumn("gap_days", F.col(days) - F.col("_prev")).drop("_prev"))
    mean_gap = F.avg("gap_days")
    stats = gaps.groupBy(label).agg(
        F.count("*").alias("n_dated"), F.max("gap_days").alias("max_gap_days"), mean_gap.alias("mean_gap_days"))
    pattern = (F.when(F.col("mean_gap_days").isNull(), F.lit(None))
               .when(F.col("mean_gap_days") < 1, F.lit("burst"))
               .when(F.col("mean_gap_days") < 2, F.lit("daily"))
               .when(F.col("mean_gap_days").between(5, 9), F.lit("weekly"))
               .otherwise(F.lit("sporadic")))
    return gaps.drop("_g"), stats.withColumn("temporal_pattern", pattern.cast("string"))  # noqa: E501


def quality_gate(profile: DataFrame, min_size: int = 3, min_similarity: float = 0.7) -> DataFrame:
    """F13, cluster half: ``passes`` where size >= 3 and average similarity >= 0.7."""
    return profile.withColumn("passes", (F.col("size") >= min_size) & (F.col("cohesion") >= min_similarity))


def outlier_gate(assign: DataFrame, max_outlier_share: float = 0.1, keys: tuple[str, ...] = (),
                 label: str = "label") -> DataFrame:
    """F13, job half: share of outliers (of each of ``keys``, as a job) and whether it is above the limit."""
    share = F.count_if(F.col(label) == -1) / F.count("*")
    return assign.groupBy(*keys).agg(F.count("*").alias("total"), share.alias("outlier_share")).withColumn(
        "flagged", F.col("outlier_share") > max_outlier_share)


def cluster_documents(assign: DataFrame, document: str = "item_id", label: str = "label") -> DataFrame:
    """A10 / A12 document ids: one row per cluster and source document with its number of members.

    Rows, not an array in the profile: a cluster may hold any share of all documents.
    """
    return (assign.where((F.col(label) >= 0) & F.col(document).isNotNull())
            .groupBy(label, F.col(document).alias("document_id")).agg(F.count("*").alias("n_members")))


def top_values(assign: DataFrame, col: str, n: int = 3, label: str = "label") -> DataFrame:
    """A11-A14 'primary / dominant X': the n most frequent values of ``col`` per cluster.

    Counts per (cluster, value) are partial aggregates; the ranking keeps n per
    cluster with the salted two-stage top-n (ties by value).
    """
    counts = assign.where((F.col(label) >= 0) & F.col(col).isNotNull()).groupBy(label, col).agg(
        F.count("*").alias("n"))
    ranked = top_n_per_group(counts, [label], [F.desc("n"), F.asc(col)], n, [col], rank_col="rank")
    return ranked.select(label, "rank", F.col(col).alias("value"), "n")


def event_profile(assign: DataFrame, label: str = "label", id_col: str = "item_id", n: int = 3) -> DataFrame:
    """Dominant event type and domain, primary entity types, the first ``n`` events in time
    order (a top-n report), and the temporal pattern of each cluster.

    All events in time order are the rows of ``temporal_order``, all documents those
    of ``cluster_documents``.
    """
    dom = cluster_profile_min(assign, label)
    ents = (top_values(assign, "entity_type", n, label).groupBy(label)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
                 .alias("primary_entities")))
    first = (top_n_per_group(assign.where(F.col(label) >= 0).select(label, id_col, "date_days"), [label],
                             [F.asc_nulls_last("date_days"), F.asc(id_col)], n, [id_col], rank_col="_r")
             .groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", id_col))),
                                             lambda s: s[id_col]).alias("first_events")))
    _, pattern = temporal_gaps(temporal_order(assign, label, id_col), label, id_col)
    return (dom.join(ents, label, "left").join(first, label, "left")
            .join(pattern.select(label, "temporal_pattern"), label, "left"))


def entity_profile(assign: DataFrame, text: str = "item_id", entity: str = "entity_type",
                   document: str = "document_id", label: str = "label", n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(profile, co-occurring entity clusters).

    profile: size, entity type (the most frequent), canonical form (the most frequent
    text, ties by text), number of distinct forms and the ``n`` most frequent ones as
    aliases. Co-occurrence: the ``n`` other clusters that share most documents, by a
    join on the document of (cluster, document) rows.
    """
    own = assign.where(F.col(label) >= 0)
    kinds = own.groupBy(label).agg(F.count("*").alias("size"), F.mode(entity, deterministic=True).alias("entity_type"))
    forms = own.where(F.col(text).isNotNull()).groupBy(label, F.col(text).alias("form")).agg(F.count("*").alias("n"))
    best = forms.groupBy(label).agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("canonical_form"),
                                    F.count("*").alias("n_forms"))
    top = top_n_per_group(forms, [label], [F.desc("n"), F.asc("form")], n, ["form"], rank_col="rank")
    aliases = top.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "form"))),
                                                 lambda s: s["form"]).alias("aliases"))
    profile = kinds.join(best, label, "left").join(aliases, label, "left")
    return profile, related_clusters(own, document, label, n)


def related_clusters(assign: DataFrame, shared: str, label: str = "label", n: int = 10) -> DataFrame:
    """For each cluster the ``n`` others that share most values of ``shared``, with the overlap.

    ``label, rank, related, n_shared, jaccard``. A value's clusters meet through an
    equi-join on the value, pre-aggregated to one row per cluster and value.
    """
    sets = assign.where((F.col(label) >= 0) & F.col(shared).isNotNull()).select(label, F.col(shared).alias("v")).distinct()
    sizes = sets.groupBy(label).agg(F.count("*").alias("m"))
    other = sets.select(F.col(label).alias("related"), "v")
    pairs = (sets.join(other, "v").where(F.col(label) != F.col("related")).groupBy(label, "related")
             .agg(F.count("*").alias("n_shared")))
    scored = (pairs.join(sizes, label).join(sizes.select(F.col(label).alias("related"), F.col("m").alias("m2")), "related")
              .withColumn("jaccard", F.col("n_shared") / (F.col("m") + F.col("m2") - F.col("n_shared"))).drop("m", "m2"))
    ranked = top_n_per_group(scored, [label], [F.desc("n_shared"), F.desc("jaccard"), F.asc("related")], n, ["related"])
    return ranked.select(label, "rank", "related", "n_shared", "jaccard")


def document_profile(assign: DataFrame, topics: str = "domain", words: str = "n_words", label: str = "label",
                     days: str = "date_days", n: int = 3) -> DataFrame:
    """Size, primary topics (the ``n`` most frequent), date range, and average word count of each cluster."""
    own = assign.where(F.col(label) >= 0)
    base = own.groupBy(label).agg(F.count("*").alias("size"), F.avg(words).alias("avg_words"),
                                  F.min(days).alias("min_date_days"), F.max(days).alias("max_date_days"))
    top = top_values(own, topics, n, label).groupBy(label).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("primary_topics"))
    return base.join(top, label, "left")


def storyline_profile(assign: DataFrame, event: str = "event_type", entity: str = "entity_type", label: str = "label",
                      days: str = "date_days", n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(profile, related storylines).

    profile: size, key events and primary entities (the ``n`` most frequent), span in
    days; related: clusters that share entities (``related_clusters``).
    """
    own = assign.where(F.col(label) >= 0)
    out = own.groupBy(label).agg(F.count("*").alias("size"), (F.max(days) - F.min(days)).alias("span_days"))
    for col, name in ((event, "key_events"), (entity, "primary_entities")):
        top = top_values(own, col, n, label).groupBy(label).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias(name))
        out = out.join(top, label, "left")
    return out, related_clusters(own, entity, label, n)


def cluster_profile_min(assign: DataFrame, label: str = "label") -> DataFrame:
    return assign.where(F.col(label) >= 0).groupBy(label).agg(
        F.count("*").alias("size"),
        F.mode("event_type", deterministic=True).alias("dominant_event_type"),
        F.mode("domain", deterministic=True).alias("dominant_domain"))


PREFIX_CHUNK = 1 << 20


def prefix_count(df: DataFrame, pos: str, flag: str, out: str, chunk: int = PREFIX_CHUNK) -> DataFrame:
    """Running count of ``flag`` over the global order ``pos`` (1..n), distributed.

    Chunk totals (n / chunk rows) are accumulated by a window over the chunk
    table only; inside a chunk a window partitioned by chunk adds the local
    running count. No partition ever holds more than ``chunk`` rows.
    """
    from pyspark.sql import Window

    c = df.withColumn("_chunk", F.floor((F.col(pos) - 1) / F.lit(chunk)))
    totals = c.groupBy("_chunk").agg(F.sum(F.col(flag).cast("long")).alias("_t"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(
        Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    local = F.sum(F.col(flag).cast("long")).over(
        Window.partitionBy("_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return (c.withColumn("_local", local).join(offsets, "_chunk")
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_chunk", "_off", "_local"))


def split_on_gap(assign: DataFrame, max_gap_days: float = 30.0, label: str = "label",
                 id_col: str = "item_id", days: str = "date_days") -> DataFrame:
    """Break a cluster wherever consecutive member dates differ by more than the gap.

    Output: ``label, item_id, position, segment`` (segment numbered from 0 inside
    each cluster). Undated members keep no segment.
    """
    ordered = temporal_order(assign, label, id_col, days)
    gaps, _ = temporal_gaps(ordered, label, id_col, days)
    flagged = gaps.withColumn("_brk", F.coalesce(F.col("gap_days") > F.lit(float(max_gap_days)), F.lit(False)))
    pre = prefix_count(flagged.join(ordered.select(label, "position", "_g"), [label, "position"]), "_g", "_brk",
                       "_pre")
    first = pre.groupBy(label).agg(F.min_by("_pre", "_g").alias("_pre0"))
    return (pre.join(first, label).withColumn("segment", F.col("_pre") - F.col("_pre0"))
            .select(label, id_col, "position", "segment"))
