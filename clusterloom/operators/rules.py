"""Event validation, trigger rules, request validation and parameters.

Each rule set is one ``CASE WHEN`` chain, so the same expression runs in a
batch query and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.vector import iso_micros

UPSTREAM_EVENT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("embedding_type", T.StringType()),
    T.StructField("total_embeddings", T.IntegerType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# Default consumer rules.
DEFAULT_RULES = {
    "trigger_events": ["embedding.job.completed"],
    "auto_trigger": True,
    "embedding_types": ["document", "event", "entity", "storyline"],
    "min_embeddings": 10,
    "quality_threshold": 0.0,
    "default_algorithm": "hdbscan",
}
# Per-algorithm default parameters and the manual / automatic priorities.
ALGORITHM_DEFAULTS = {
    "hdbscan": {"min_cluster_size": "5", "min_samples": "3", "cluster_selection_epsilon": "0.0",
                "metric": "euclidean", "cluster_selection_method": "eom", "allow_single_cluster": "false"},
    "kmeans": {"n_clusters": "50", "n_init": "10", "max_iter": "300", "random_state": "42"},
    "agglomerative": {"distance_threshold": "0.5", "linkage": "ward", "metric": "euclidean"},
}
MANUAL_PRIORITY, AUTO_PRIORITY = 9, 5
REQUIRED_FIELDS = ("event_type", "job_id", "embedding_type", "total_embeddings", "timestamp")


def validate_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """parse the JSON payload with an explicit schema and flag missing / bad fields.

    Adds ``event`` (the parsed struct), ``event_ts`` and ``invalid_reason``
    (null when valid).
    """
    ev = F.from_json(F.col(payload), UPSTREAM_EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    df = raw.withColumn("event", ev)
    reason = F.when(F.col("event").isNull(), F.lit("unparseable"))
    for f in REQUIRED_FIELDS:
        reason = reason.when(F.col(f"event.{f}").isNull(), F.lit(f"missing_{f}"))
    ts = F.timestamp_micros(iso_micros(F.col("event.timestamp")))
    reason = reason.when(ts.isNull(), F.lit("bad_timestamp"))
    return df.withColumn("event_ts", ts).withColumn("invalid_reason", reason)


def trigger_decision(ev: DataFrame, rules: dict | None = None) -> DataFrame:
    """ordered rules -> 'triggered' or the name of the first failing rule."""
    r = {**DEFAULT_RULES, **(rules or {})}
    e = lambda f: F.col(f"event.{f}")
    decision = (F.when(F.col("invalid_reason").isNotNull(), F.lit("invalid"))
                .when(~e("event_type").isin(r["trigger_events"]), F.lit("event_type_not_triggering"))
                .when(F.lit(not r["auto_trigger"]), F.lit("auto_trigger_disabled"))
                .when(~e("embedding_type").isin(r["embedding_types"]), F.lit("embedding_type_not_allowed"))
                .when(e("total_embeddings") < F.lit(r["min_embeddings"]), F.lit("insufficient_embeddings"))
                .when(e("quality_score").isNotNull() & (e("quality_score") < F.lit(r["quality_threshold"])),
                      F.lit("embedding_quality_too_low"))
                .otherwise(F.lit("triggered")))
    return ev.withColumn("decision", decision)


def receiver_decision(ev: DataFrame, rules: dict | None = None) -> DataFrame:
    """the webhook variant, with a status code for each reason.

    Order: malformed (422), wrong token (401, only where a token is set), automation
    or receiver disabled (503), type, minimum (0 by default) and quality (400). The
    event type isn't tested here.
    """
    r = {**DEFAULT_RULES, "min_embeddings": 0, "receiver_enabled": True, "auth_token": None, **(rules or {})}
    e = lambda f: F.col(f"event.{f}")
    token = F.col("auth_token") if "auth_token" in ev.columns else F.lit(None).cast("string")
    wrong = F.lit(False) if not r["auth_token"] else ~F.coalesce(token == F.lit(r["auth_token"]), F.lit(False))
    checks = [(F.col("invalid_reason").isNotNull(), "invalid", 422),
              (wrong, "unauthorized", 401),
              (F.lit(not r["auto_trigger"]), "auto_trigger_disabled", 503),
              (F.lit(not r["receiver_enabled"]), "receiver_disabled", 503),
              (~e("embedding_type").isin(r["embedding_types"]), "embedding_type_not_allowed", 400),
              (e("total_embeddings") < F.lit(r["min_embeddings"]), "insufficient_embeddings", 400),
              (F.coalesce(e("quality_score") < F.lit(r["quality_threshold"]), F.lit(False)),
               "embedding_quality_too_low", 400)]
    decision, code = F, F
    for failed, name, status in checks:
        decision, code = decision.when(failed, F.lit(name)), code.when(failed, F.lit(status))
    decision, code = decision.otherwise(F.lit("triggered")), code.otherwise(F.lit(202))
    return (ev.withColumn("decision", decision).withColumn("status_code", code)
            .withColumn("accepted", F.col("decision") == "triggered"))


def job_requests(decided: DataFrame, rules: dict | None = None, triggered_by: str = "stage3_event") -> DataFrame:
    """T1 output: one complete clustering-job request per triggered event (trap D8).

    ``triggered_by``: ``stage3_event`` from the stream, ``stage3_webhook`` from the receiver.
    """
    r = {**DEFAULT_RULES, **(rules or {})}
    t = decided.where(F.col("decision") == "triggered")
    return t.select(
        F.format_string("auto_%s_%s", F.col("event.job_id"), F.col("event.embedding_type")).alias("request_id"),
        F.col("event.job_id").alias("upstream_job_id"),
        F.col("event.embedding_type").alias("embedding_type"),
        F.lit(r["default_algorithm"]).alias("algorithm"),
        F.lit(AUTO_PRIORITY).alias("priority"),
        F.lit(True).alias("auto_triggered"),
        F.lit(triggered_by).alias("triggered_by"),
        F.col("event_ts").alias("requested_at"),
    )


def validate_job_requests(req: DataFrame) -> DataFrame:
    """``errors`` map per request (empty when valid, trap D11).

    A missing algorithm is the default one (F15). A parameter that isn't a number
    is an error of that parameter.
    """
    alg = F.coalesce(F.lower(F.col("algorithm")), F.lit(DEFAULT_RULES["default_algorithm"]))

    def at_least(key: str, low: int, *algorithms: str) -> list[Column]:
        raw, number = F.col("params")[key], F.col("params")[key].try_cast("int")
        return [F.lit(key), F.when(alg.isin(*algorithms) & raw.isNotNull() & number.isNull(), F.lit("must be a number"))
                .when(alg.isin(*algorithms) & (number < low), F.lit(f"must be >= {low}"))]

    threshold = F.col("params")["distance_threshold"]
    checks = F.create_map(
        F.lit("algorithm"), F.when(~alg.isin(*ALGORITHM_DEFAULTS), F.lit("unknown algorithm")),
        *at_least("min_cluster_size", 2, "hdbscan"), *at_least("min_samples", 1, "hdbscan"),
        *at_least("n_clusters", 2, "kmeans", "agglomerative"),
        F.lit("distance_threshold"), F.when((alg == "agglomerative") & F.col("params")["n_clusters"].isNull()
                                            & threshold.isNull(), F.lit("n_clusters or distance_threshold required"))
        .when((alg == "agglomerative") & threshold.isNotNull() & threshold.try_cast("double").isNull(),
              F.lit("must be a number")),
    )
    return req.withColumn("errors", F.map_filter(checks, lambda k, v: v.isNotNull()))


def merge_params(requests: DataFrame) -> DataFrame:
    """request params override the algorithm defaults; algorithm defaults to hdbscan."""
    spark = requests.sparkSession
    alg = F.coalesce(F.lower(F.col("algorithm")), F.lit(DEFAULT_RULES["default_algorithm"]))
    defaults = spark.createDataFrame([(a, p) for a, p in ALGORITHM_DEFAULTS.items()],
                                     "algorithm string, defaults map<string,string>")
    none = F.create_map().cast("map<string,string>")
    r = requests.withColumn("algorithm", alg).withColumn("params", F.coalesce("params", none))
    return (r.join(F.broadcast(defaults), "algorithm", "left")  # one row per algorithm
            .withColumn("params", F.map_concat(
                F.map_filter(F.coalesce("defaults", none), lambda k, v: ~F.map_contains_key("params", k)), "params"))
            .drop("defaults"))


def recommend_algorithm(stats: DataFrame, n: str = "total_vectors", etype: str = "embedding_type") -> Column:
    """F16: n < 100 agglomerative; n < 10000 hdbscan for event/entity else kmeans; else kmeans."""
    return (F.when(F.col(n) < 100, F.lit("agglomerative"))
            .when((F.col(n) < 10000) & F.col(etype).isin("event", "entity"), F.lit("hdbscan"))
            .otherwise(F.lit("kmeans")))


def cluster_id(job_id: Column, embedding_type: Column, label: Column) -> Column:
    """``{job}_{type}_cluster_{i}``."""
    return F.format_string("%s_%s_cluster_%d", job_id, embedding_type, label)


def member_cluster_key(embedding_type: Column, label: Column) -> Column:
    """``{type}_cluster_{label}`` or ``outlier``."""
    return F.when(label == -1, F.lit("outlier")).otherwise(F.format_string("%s_cluster_%d", embedding_type, label))


def checkpoint_key(job_id: Column, index: Column, ts: Column) -> Column:
    """``{job}_checkpoint_{i}_{ts}``."""
    return F.format_string("%s_checkpoint_%d_%s", job_id, index, ts)
