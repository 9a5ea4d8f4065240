"""Job and cluster tables: listing, queues, progress, expiry, statistics.

Listings that are top-k reports (W1, W2, W6, W7, W9) keep their limit: the
limit is the feature. Global positions (queue order) use a distributed sort
with offsets from the partitions' counts (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.topn import top_n_per_group
from clusterloom.session import number_rows

# The six job states (the reference spells the last one "canceled").
JOB_STATUSES = ("queued", "running", "paused", "completed", "failed", "canceled")


def normalise_status(col: Column) -> Column:
    """Accept 'cancelled' on read (trap D13)."""
    return F.when(F.lower(col) == "cancelled", F.lit("canceled")).otherwise(F.lower(col))


def global_rank(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position in a total order, without a single-partition window."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return number_rows(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), name)


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Optional status filter, newest first, ties by id; sort before limit (trap D12)."""
    j = jobs if status is None else jobs.where(normalise_status(F.col("status")) == F.lit(status))
    return j.orderBy(F.desc("created_at"), F.asc("job_id")).limit(limit)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Queued jobs by priority (manual 9 before automatic 5), then age, then id."""
    q = jobs.where(F.col("status") == "queued")
    return global_rank(q, [F.desc("priority"), F.asc("created_at"), F.asc("job_id")], "queue_position")


def job_progress(events: DataFrame, as_of: Column, totals: DataFrame | None = None) -> DataFrame:
    """Percent (2 decimals), items per second and remaining seconds per job at ``as_of``.

    processed = cumulative count of the latest event at or before ``as_of``;
    total = the job's total (``totals``) or the largest cumulative count seen;
    rate = processed / seconds since the first event. All partial aggregates.
    """
    tot = totals if totals is not None else events.groupBy("job_id").agg(
        F.max("processed_items").alias("total_items"))
    seen = events.where(F.col("ts") <= as_of).groupBy("job_id").agg(
        F.max_by("processed_items", F.struct("ts", "processed_items")).alias("processed_items"),
        F.min("ts").alias("first_ts"))
    secs = F.timestamp_diff("MICROSECOND", F.col("first_ts"), as_of) / 1e6  # no time-zone shift
    rate = F.try_divide(F.col("processed_items").cast("double"), secs)
    return (seen.join(tot, "job_id").select(
        "job_id", "processed_items", "total_items",
        F.round(F.try_divide(F.col("processed_items") * 100.0, F.col("total_items")), 2).alias("percent"),
        rate.alias("items_per_second"),
        F.try_divide((F.col("total_items") - F.col("processed_items")).cast("double"), rate)
        .alias("remaining_seconds")))


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """Seeded sample without replacement: the n smallest seeded hashes (deterministic)."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")),
                      F.col(id_col)).limit(n)


def latest_events(df: DataFrame, n: int = 10_000, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Bounded view of an event log (newest n)."""
    return df.orderBy(F.desc(ts), F.desc(id_col)).limit(n)


def expire_jobs(jobs: DataFrame, cutoff: Column, dependents: dict[str, DataFrame] | None = None
                ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Drop jobs created before ``cutoff`` and, by anti-join, their dependent rows."""
    expired = jobs.where(F.col("created_at") < cutoff).select("job_id")
    kept = jobs.join(expired, "job_id", "left_anti")
    deps = {k: d.join(expired, "job_id", "left_anti") for k, d in (dependents or {}).items()}
    return kept, deps


def unprocessed_items(items: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Items of a job not yet in its processed set (anti join)."""
    return items.join(processed.select(*keys), keys, "left_anti")


def add_processed(processed: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add to the processed set without duplicates."""
    return processed.select(*keys).union(new.select(*keys)).dropDuplicates(keys)


def cluster_statistics(clusters: DataFrame) -> DataFrame:
    """A16, cluster half: clusters, items and average size by embedding type, and the outliers.

    Input: the clusters table (S9) with its outlier rows; the row of type null is
    the total over all types.
    """
    own = ~F.col("is_outlier")
    return clusters.rollup("embedding_type").agg(
        F.count_if(own).alias("total_clusters"),
        F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).alias("clustered_items"),
        F.avg(F.when(own, F.col("size"))).alias("avg_cluster_size"),
        F.coalesce(F.sum(F.when(~own, F.col("size"))), F.lit(0)).alias("total_outliers"))


def service_statistics(jobs: DataFrame) -> DataFrame:
    """A16, job half: jobs by status with all six states present (zeros kept)."""
    spark = jobs.sparkSession
    dim = spark.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    counts = jobs.groupBy(normalise_status(F.col("status")).alias("status")).agg(F.count("*").alias("n_jobs"))
    return dim.join(counts, "status", "left").select("status", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


def success_rate(jobs: DataFrame) -> DataFrame:
    """Completed / (completed + failed) x 100; 0 when there are neither."""
    s = normalise_status(F.col("status"))
    return jobs.agg(F.coalesce(F.try_divide(F.count_if(s == "completed") * 100.0,
                                            F.count_if(s.isin("completed", "failed"))), F.lit(0.0))
                    .alias("success_rate"))


def job_result(assign: DataFrame, label: str = "label", quality: dict[str, float | None] | None = None,
               processing_time_ms: int | None = None) -> DataFrame:
    """Clusters created, outliers, total, clustered items per cluster (trap D6), quality metrics and time."""
    metrics = F.create_map(*[x for k, v in (quality or {}).items() for x in (F.lit(k), F.lit(v).cast("double"))]) \
        if quality else F.create_map().cast("map<string,double>")
    return assign.agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters_created"),
        F.count_if(F.col(label) == -1).alias("outliers"),
        F.count("*").alias("total_items"),
    ).withColumn("avg_cluster_size",
                 F.try_divide((F.col("total_items") - F.col("outliers")).cast("double"), F.col("clusters_created"))
                 ).withColumn("quality_metrics", metrics
                              ).withColumn("processing_time_ms", F.lit(processing_time_ms).cast("long"))


def list_clusters(clusters: DataFrame, embedding_type: str | None = None, job_id: str | None = None,
                  limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Filtered page of clusters (size desc, id) and the total count of the filter."""
    c = clusters
    if embedding_type is not None:
        c = c.where(F.col("embedding_type") == embedding_type)
    if job_id is not None:
        c = c.where(F.col("job_id") == job_id)
    page = c.orderBy(F.desc("size"), F.asc("cluster_id")).offset(offset).limit(limit)
    return page, c.agg(F.count("*").alias("total"))


def get_cluster(clusters: DataFrame, members: DataFrame, cluster_id: str, include_members: bool = True,
                member_limit: int | None = None, member_offset: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """One cluster and its members, all of them or the page that is asked for."""
    c = clusters.where(F.col("cluster_id") == cluster_id)
    if not include_members:
        return c, None
    m = (members.where(F.col("cluster_id") == cluster_id)
         .orderBy(F.asc("distance_to_centroid"), F.asc("member_id")).offset(member_offset))
    return c, m if member_limit is None else m.limit(member_limit)


def sample_clusters(clusters: DataFrame, n: int = 5) -> DataFrame:
    """The n largest clusters of every job (salted two-stage top-n)."""
    return top_n_per_group(clusters, ["job_id"], [F.desc("size"), F.asc("cluster_id")], n, ["cluster_id"],
                           rank_col="sample_rank")
