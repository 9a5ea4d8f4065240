"""Vector-set sources.

A vector set is one DataFrame, one row per item:
``pos long, id string, embedding_type string, embedding array<float>, metadata struct<...>``.
On disk it is Parquet partitioned by ``embedding_type`` so that reading one
type prunes the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.session import number_rows

# Accepted spellings of the four embedding types (singular is canonical).
TYPE_ALIASES = {
    "document": "document", "documents": "document",
    "event": "event", "events": "event", "eventss": "event",
    "entity": "entity", "entities": "entity", "entitys": "entity",
    "storyline": "storyline", "storylines": "storyline",
}
EMBEDDING_TYPES = ("document", "event", "entity", "storyline")

METADATA_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("embedding_type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("publication_date", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("entity_count", T.IntegerType()),
    T.StructField("event_count", T.IntegerType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("event_type", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("temporal_reference", T.StringType()),
    T.StructField("argument_count", T.IntegerType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_text", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("storyline_id", T.StringType()),
    T.StructField("primary_entities", T.ArrayType(T.StringType())),
    T.StructField("temporal_span", T.ArrayType(T.StringType())),
    T.StructField("temporal_span_days", T.IntegerType()),
    T.StructField("date", T.StringType()),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("embedding_type", T.StringType()),
    T.StructField("metadata", METADATA_SCHEMA),
])

STORE_SCHEMA = T.StructType([
    T.StructField("metadata_store", T.MapType(T.StringType(), RECORD_SCHEMA)),
    T.StructField("id_map", T.MapType(T.StringType(), T.LongType())),
    T.StructField("reverse_id_map", T.MapType(T.StringType(), T.StringType())),
])


def canonical_type(name: str) -> str:
    try:
        return TYPE_ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown embedding type: {name!r}") from None


def canonical_type_col(col) -> F.Column:
    """Column form of ``canonical_type`` (unknown spellings -> null)."""
    m = F.create_map(*[x for k, v in TYPE_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.lower(F.trim(col)))


def write_vectors(df: DataFrame, root: str, mode: str = "append") -> None:
    """Persist a vector set partitioned by type (dynamic partition overwrite on 'overwrite')."""
    (df.withColumn("embedding_type", canonical_type_col(F.col("embedding_type")))
       .write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy("embedding_type").parquet(root))


def read_vectors(spark: SparkSession, root: str, embedding_type: str) -> DataFrame:
    """One vector set by type; partition pruning reads only that folder.

    A missing root raises (AnalysisException), and so does a type without vectors
    (FileNotFoundError), matching 'missing file = error'.
    """
    t = canonical_type(embedding_type)
    found = spark.read.parquet(root).where(F.col("embedding_type") == F.lit(t))
    if found.isEmpty():
        raise FileNotFoundError(f"no vectors of type {t!r} under {root}")
    return found


def read_metadata_json(spark: SparkSession, path: str, shape: str = "lines") -> DataFrame:
    """Metadata files -> one row per key: ``meta_key, meta_pos, record`` struct columns.

    shapes: ``store`` ({metadata_store, id_map, reverse_id_map}), ``list`` (JSON array of
    records), ``object`` (a single record), ``lines`` (one record per line; the only
    splittable shape, the one to use at scale). Always read with an explicit schema.
    """
    if shape == "store":
        raw = spark.read.schema(STORE_SCHEMA).option("multiLine", True).json(path)
        entries = raw.select(F.explode("metadata_store").alias("meta_key", "rec"), "id_map")
        return entries.select(
            "meta_key",
            F.element_at("id_map", F.col("meta_key")).alias("meta_pos"),
            F.col("rec.id").alias("id"), F.col("rec.source_id").alias("source_id"),
            F.col("rec.embedding_type").alias("meta_type"), F.col("rec.metadata").alias("metadata"))
    if shape in ("list", "object", "lines"):
        reader = spark.read.schema(RECORD_SCHEMA)
        if shape != "lines":
            reader = reader.option("multiLine", True)
        raw = reader.json(path)
        # position of a record = its order in the input, from 0
        raw = number_rows(raw, "meta_pos").withColumn("meta_pos", F.col("meta_pos") - 1)
        return raw.select(
            F.coalesce("id", "source_id", F.col("meta_pos").cast("string")).alias("meta_key"),
            "meta_pos", "id", "source_id", F.col("embedding_type").alias("meta_type"), "metadata")
    raise ValueError(f"unknown metadata shape {shape!r}")


def attach_metadata(vectors: DataFrame, meta: DataFrame, reverse_map: DataFrame | None = None,
                    fallback: str = "null") -> DataFrame:
    """Vector position -> key -> metadata record (left equi-joins).

    ``fallback='cycle'`` reproduces the reference's modulo fallback: a position
    without a key takes the record whose ``meta_pos`` equals ``pos mod n_keys``;
    ``n_keys`` is a scalar subquery, so this is still an equi-join.
    """
    v = vectors.drop("metadata")
    if reverse_map is not None:
        v = v.join(reverse_map, "pos", "left")
    else:
        v = v.withColumn("meta_key", F.col("pos").cast("string"))
    m = meta.select("meta_key", "meta_pos", F.col("id").alias("meta_id"),
                    F.col("source_id").alias("meta_source_id"), "metadata")
    out = v.join(m, "meta_key", "left")
    if fallback == "cycle":
        n_keys = meta.select(F.count("*")).scalar()
        missing = out.where(F.col("metadata").isNull()).drop("meta_pos", "meta_id", "meta_source_id",
                                                             "metadata")
        found = out.where(F.col("metadata").isNotNull())
        cyc = (missing.withColumn("meta_pos", F.pmod(F.col("pos"), n_keys))
               .join(m.drop("meta_key"), "meta_pos", "left"))
        out = found.unionByName(cyc)
    elif fallback != "null":
        raise ValueError("fallback must be 'null' or 'cycle'")
    if "id" not in out.columns:
        out = out.withColumn("id", F.col("meta_id"))
    return out.withColumn("id", F.coalesce(F.col("id"), F.col("meta_id"))).drop("meta_pos")


def resolve_item_id(df: DataFrame) -> DataFrame:
    """Item id = first of id, metadata.source_id, ``item_{pos}``."""
    src = F.col("metadata.source_id") if "metadata" in df.columns else F.lit(None).cast("string")
    ident = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("item_id", F.coalesce(ident, src, F.concat(F.lit("item_"),
                                                                    F.col("pos").cast("string"))))


def vectors_by_ids(vectors: DataFrame, request: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Fetch vectors for requested ids in request order.

    ``request`` has ``req_pos long, item_id string``. Unknown ids are dropped; if
    an id occurs at several vector positions the last position wins (``max_by``
    per id, a partial aggregate, so a hot id never lands whole in one task).
    """
    latest = vectors.groupBy(id_col).agg(
        F.max_by(F.struct("pos", "embedding"), F.col("pos")).alias("v"))
    return (request.join(latest, id_col, "inner")
            .select("req_pos", id_col, F.col("v.pos").alias("pos"), F.col("v.embedding").alias("embedding"))
            .orderBy("req_pos"))


def vector_set_stats(vectors: DataFrame) -> DataFrame:
    """Per type: total vectors, dimension, metadata count, readiness."""
    return vectors.groupBy("embedding_type").agg(
        F.count("*").alias("total_vectors"),
        F.max(F.size("embedding")).cast("int").alias("dimension"),
        F.count("metadata").alias("metadata_count"),
    ).withColumn("ready", F.col("total_vectors") > 0)
