"""Readers for the driver's parquet tables and the vector-set stand-in built from them.

``vector_set`` only reshapes rows of ``embeddings``, ``events`` and ``documents``
into the vector-set schema the operators expect (the same shape
``read_vectors`` + ``attach_metadata`` produce); it does none of the operators'
work. Dates are carried as ISO-8601 text inside the nested metadata, exactly as
an upstream metadata file carries them, so F1 really parses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector set of type ``event``: one row per embedding with nested metadata.

    embeddings.vec_id = events.event_id (inner, complete at every scale) and
    documents.doc_id = vec_id (left: partial at the smallest scale, so null
    metadata is exercised). Both joins are equi-joins on the id; at scale they
    are sort-merge joins on a well-distributed key, AQE turns them into
    broadcasts when one side is measured small.
    """
    emb = table(spark, sf_dir, "embeddings")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = (emb.join(ev, emb.vec_id == ev.event_id, "inner")
         .join(docs, emb.vec_id == docs.doc_id, "left"))
    meta = F.struct(
        F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
        .alias("source_id"),
        F.col("lang").alias("domain"),
        F.col("event_type").alias("event_type"),
        F.col("source").alias("entity_type"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("temporal_reference"),
        F.lit(None).cast("string").alias("publication_date"),
        F.lit(None).cast("string").alias("date"),
        F.col("value").alias("confidence"),
        F.col("user_id").alias("user_id"),
    )
    return j.select(
        F.col("vec_id").alias("pos"),
        F.lit(None).cast("string").alias("id"),
        F.lit("event").alias("embedding_type"),
        F.col("embedding"),
        F.col("label").alias("truth_label"),
        meta.alias("metadata"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector set with item ids resolved (S4) and clustering metadata projected (F1)."""
    from clusterloom.operators.filters import extract_clustering_metadata
    from clusterloom.sources.vectors import resolve_item_id

    return extract_clustering_metadata(resolve_item_id(vector_set(spark, sf_dir)))


# DuckDB twin of ``items`` for the oracle SQL (dates straight from the timestamp).
ITEMS_SQL = """
items AS (
  SELECT coalesce('doc_' || CAST(d.doc_id AS VARCHAR), 'item_' || CAST(e.vec_id AS VARCHAR)) AS item_id,
         e.vec_id AS pos,
         CAST(e.embedding AS DOUBLE[]) AS embedding,
         e.label AS truth_label,
         d.lang AS domain,
         v.event_type AS event_type,
         d.source AS entity_type,
         CAST(epoch_us(v.ts) AS DOUBLE) / 86400000000.0 AS date_days
  FROM embeddings e
  JOIN events v ON e.vec_id = v.event_id
  LEFT JOIN documents d ON d.doc_id = e.vec_id
)"""


# --------------------------------------------------------------------------- job and stream stand-ins
# Fixed values used to shape stand-in rows (not rules of any operator).
_STATUS_BY_ORDER = """CASE
  WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'failed'
  WHEN o_orderstatus = 'F' THEN 'completed'
  WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'canceled'
  WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'paused'
  WHEN o_orderstatus = 'O' THEN 'queued'
  ELSE 'running' END"""
_TYPES = "element_at(array('document', 'event', 'entity', 'storyline'), CAST(pmod(o_custkey, 4) AS INT) + 1)"
_ALGOS = "element_at(array('hdbscan', 'kmeans', 'agglomerative'), CAST(pmod(o_custkey, 3) AS INT) + 1)"


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job records: one per order (status, type, algorithm, priority, created_at)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id"),
        F.expr(_STATUS_BY_ORDER).alias("status"),
        F.expr(_TYPES).alias("embedding_type"),
        F.expr(_ALGOS).alias("algorithm"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(9)).otherwise(F.lit(5)).alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events: one per line item (cumulative processed = line number)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").cast("long").alias("processed_items"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_returnflag").alias("return_flag"),
        F.concat(F.lit("item_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("item_id"),
    )


def upstream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream (embedding stage) events in their wire shape, one per driver event.

    All fields are strings / JSON text as they arrive on the stream; F10
    parses and validates them.
    """
    ev = table(spark, sf_dir, "events")
    etype = F.expr("""CASE event_type WHEN 'purchase' THEN 'embedding.job.completed'
        WHEN 'click' THEN 'embedding.job.completed' WHEN 'signup' THEN 'embedding.job.started'
        WHEN 'view' THEN 'embedding.job.progress' ELSE 'embedding.job.failed' END""")
    k = F.get_json_object("props", "$.k")
    emb_type = F.element_at(F.array(*[F.lit(x) for x in ("document", "event", "entity", "storyline", "image")]),
                            (F.pmod(k.cast("int"), F.lit(5)) + 1).cast("int"))
    payload = F.to_json(F.struct(
        etype.alias("event_type"),
        F.concat(F.lit("up_"), F.col("user_id").cast("string")).alias("job_id"),
        emb_type.alias("embedding_type"),
        k.cast("int").alias("total_embeddings"),
        F.when(F.col("value") < 400, (F.col("value") / 100.0 - 0.5)).alias("quality_score"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("event_type") == "error", F.create_map(F.lit("error_type"), F.concat(
            F.lit("E"), F.pmod(k.cast("int"), F.lit(3)).cast("string")))).alias("metadata"),
    ))
    # an event whose payload lost a required field (the 'view' events drop total_embeddings)
    payload = F.when(F.col("event_type") == "view", F.regexp_replace(payload, r'"total_embeddings":\d+,', "")) \
        .otherwise(payload)
    return ev.select(F.col("event_id").cast("string").alias("event_id"), ntz_as_utc("ts").alias("ts"),
                     payload.alias("payload"))


def ntz_as_utc(col: str):
    """Wall-clock (timestamp_ntz) value read as a UTC instant, whatever the session time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              F.col(col).cast("timestamp_ntz"))
    return F.timestamp_micros(micros)
