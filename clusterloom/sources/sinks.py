"""Sinks and result tables (S7-S9, S11) and the jobs -> clusters -> members join.

Everything is written partitioned by (embedding_type, job_id) with dynamic
partition overwrite, so re-running a job replaces only its own partitions and
readers prune to one job or type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.vector import l2_distance
from clusterloom.operators.metrics import centroids as centroids_of
from clusterloom.operators.rules import cluster_id, member_cluster_key

CLUSTER_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.StringType()), T.StructField("job_id", T.StringType()),
    T.StructField("cluster_label", T.IntegerType()), T.StructField("size", T.LongType()),
    T.StructField("is_outlier", T.BooleanType()), T.StructField("embedding_type", T.StringType()),
    T.StructField("centroid", T.ArrayType(T.DoubleType())), T.StructField("cohesion", T.DoubleType()),
    T.StructField("separation", T.DoubleType()), T.StructField("silhouette", T.DoubleType()),
    T.StructField("min_date_days", T.DoubleType()), T.StructField("max_date_days", T.DoubleType()),
    T.StructField("temporal_span_days", T.DoubleType()), T.StructField("domains", T.ArrayType(T.StringType())),
    T.StructField("event_types", T.ArrayType(T.StringType())),
    T.StructField("entity_types", T.ArrayType(T.StringType())),
])


def memberships(assign: DataFrame, job_id: str, embedding_type: str, algorithm: str, vec: str = "embedding",
                label: str = "label", id_col: str = "item_id", raw_vec: str | None = None) -> DataFrame:
    """S7 rows: one per item with cluster key, vector, distance to the (raw) centroid for members.

    The distance uses centroids recomputed from the raw vectors (trap D5) when
    ``raw_vec`` is given; outliers get no distance.
    """
    space = raw_vec or vec
    cents = centroids_of(assign.select(label, F.col(space).alias("_v")), "_v", label)
    j = assign.join(cents.select(label, F.col("centroid").alias("_c")), label, "left")
    return j.select(
        member_cluster_key(F.lit(embedding_type), F.col(label)).alias("cluster_id"),
        F.col(id_col).alias("member_id"), F.col(vec).alias("vector"),
        F.when(F.col(label) >= 0, l2_distance(space, "_c")).alias("distance_to_centroid"),
        F.lit(job_id).alias("job_id"), F.lit(embedding_type).alias("embedding_type"),
        F.lit(algorithm).alias("algorithm"))


def write_memberships_jsonl(df: DataFrame, root: str) -> None:
    """JSON lines partitioned by type and job."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("embedding_type", "job_id").json(root))


def table_cluster_id(job_id: Column, embedding_type: Column, label: Column) -> Column:
    """The key that cluster and member rows share: F17's cluster id, or the job's outlier cluster."""
    return F.when(label >= 0, cluster_id(job_id, embedding_type, label)).otherwise(
        F.format_string("%s_%s_outlier", job_id, embedding_type))


def clusters_table(profile: DataFrame, job_id: str, embedding_type: str, silhouette: DataFrame | None = None,
                   outliers: int = 0, label: str = "label") -> DataFrame:
    """S9 cluster rows from an A10 profile, and one for the ``outliers`` where there are any."""
    p = profile if silhouette is None else profile.join(silhouette, label, "left")
    sil = F.col("silhouette") if silhouette is not None else F.lit(None).cast("double")
    rows = p.select(
        table_cluster_id(F.lit(job_id), F.lit(embedding_type), F.col(label)).alias("cluster_id"),
        F.lit(job_id).alias("job_id"), F.col(label).cast("int").alias("cluster_label"),
        F.col("size").cast("long").alias("size"), F.lit(False).alias("is_outlier"),
        F.lit(embedding_type).alias("embedding_type"), F.col("centroid"), F.col("cohesion"),
        F.col("separation"), sil.alias("silhouette"), "min_date_days", "max_date_days", "temporal_span_days",
        "domains", "event_types", "entity_types")
    if outliers:
        none = [(f"{job_id}_{embedding_type}_outlier", job_id, -1, int(outliers), True, embedding_type)]
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in CLUSTER_SCHEMA.fields[6:]]
        only = profile.sparkSession.createDataFrame(none, T.StructType(CLUSTER_SCHEMA.fields[:6]))
        rows = rows.unionByName(only.select("*", *empty))
    return rows


def members_table(memb: DataFrame) -> DataFrame:
    """S9 member rows from S7 rows, keyed as the cluster rows are (``table_cluster_id``)."""
    key = F.format_string("%s_%s", F.col("job_id"), F.when(
        F.col("cluster_id") == "outlier", F.format_string("%s_outlier", F.col("embedding_type")))
        .otherwise(F.col("cluster_id")))
    return memb.select(key.alias("cluster_id"), "member_id", "distance_to_centroid", "job_id", "embedding_type",
                       F.when(F.col("distance_to_centroid").isNotNull(),
                              F.lit(1.0) / (F.lit(1.0) + F.col("distance_to_centroid"))).alias("similarity_score"))


def save_tables(root: str, jobs: DataFrame | None = None, clusters: DataFrame | None = None,
                members: DataFrame | None = None) -> None:
    """Three related Parquet tables, each replaced per job partition."""
    for name, df in (("jobs", jobs), ("clusters", clusters), ("members", members)):
        if df is not None:
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("job_id").parquet(f"{root}/{name}"))


def write_clusters_jsonl(clusters: DataFrame, root: str) -> None:
    """One nested cluster object per line, grouped by (type, job) folders."""
    (clusters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("embedding_type", "job_id").json(root))


def read_clusters_jsonl(spark: SparkSession, root: str, embedding_type: str | None = None) -> DataFrame:
    """S8 read-back with an explicit schema; the type filter prunes partitions."""
    schema = T.StructType([f for f in CLUSTER_SCHEMA.fields if f.name not in ("embedding_type", "job_id")]
                          + [T.StructField("embedding_type", T.StringType()), T.StructField("job_id", T.StringType())])
    df = spark.read.schema(schema).json(root)
    return df if embedding_type is None else df.where(F.col("embedding_type") == embedding_type)


def jobs_clusters_members(jobs: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Jobs -> clusters -> members as flat rows: equi-joins on the job and on (job, cluster)."""
    return (jobs.drop("embedding_type").join(clusters, "job_id")
            .join(members.drop("embedding_type"), ["job_id", "cluster_id"], "left"))


def read_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S9 read back: jobs, clusters, members."""
    return tuple(spark.read.parquet(f"{root}/{name}") for name in ("jobs", "clusters", "members"))


def write_event_stream(events: DataFrame, path: str, checkpoint: str):
    """Publish lifecycle events (JSON payload rows) to a file sink with a checkpoint."""
    return (events.writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").start())
