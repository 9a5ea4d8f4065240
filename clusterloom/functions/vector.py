"""Vector, distance, weighting and confidence expressions.

All functions return Catalyst expressions built from higher-order functions
(``transform``, ``zip_with``, ``aggregate``), so they run JVM-side inside
whole-stage codegen; no Python UDF is involved. Arithmetic is in double even
when the stored vectors are ``array<float>``. Vectors of different length give
null (``zip_with`` pads with null), which is how a dimension mismatch surfaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def as_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """V1: inner product."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a) -> Column:
    """V1: Euclidean length."""
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a, b) -> Column:
    """V3: squared Euclidean distance (what a flat L2 index returns)."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                           * (x.cast("double") - y.cast("double"))))


def l2_distance(a, b) -> Column:
    """V2: Euclidean distance."""
    return F.sqrt(squared_l2(a, b))


def manhattan(a, b) -> Column:
    """V5: L1 / Manhattan distance."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """V4: cosine similarity; zero-length vectors give null, not an error."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def cosine_distance(a, b) -> Column:
    """V5: 1 - cosine similarity."""
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_normalize(a) -> Column:
    """V6: unit-length vector; the zero vector stays zero."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(as_double(a))


def scale(a, w) -> Column:
    """Multiply every element by a (per-row) weight."""
    w = _c(w)
    return F.transform(_c(a), lambda x: x.cast("double") * w)


def epoch_days(ts) -> Column:
    """Days since 1970-01-01 as double, for timestamp or timestamp_ntz columns."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              _c(ts).cast("timestamp_ntz"))
    return micros.cast("double") / F.lit(MICROS_PER_DAY)


def iso_micros(s) -> Column:
    """ISO-8601 text to microseconds since the epoch; bad text -> null.

    Text with ``Z`` or an offset is an instant; naive text is UTC, whatever the
    session's time zone.
    """
    text = F.nullif(F.trim(_c(s)), F.lit(""))
    naive = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                             text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(r"([Zz]|[+-]\d{1,2}(:?\d{2})?)$") & text.contains(":"),
                  F.unix_micros(text.try_cast("timestamp"))).otherwise(naive)


def parse_iso_days(s) -> Column:
    """ISO-8601 text to days since the epoch (see ``iso_micros``)."""
    return iso_micros(s).cast("double") / F.lit(MICROS_PER_DAY)


def temporal_weight(days, ref_days, decay_days) -> Column:
    """V7: exp(-|d - ref| / decay); a missing date keeps weight 1.0."""
    decay = decay_days if isinstance(decay_days, Column) else F.lit(float(decay_days))
    return F.coalesce(F.exp(-F.abs(_c(days) - _c(ref_days)) / decay), F.lit(1.0))


def temporal_similarity(sim, days_a, days_b, decay_days) -> Column:
    """V8: pair similarity scaled by exp(-|d1 - d2| / decay)."""
    return _c(sim) * F.exp(-F.abs(_c(days_a) - _c(days_b)) / F.lit(float(decay_days)))


def distance_to_similarity(d) -> Column:
    """V9: 1 / (1 + d)."""
    return F.lit(1.0) / (F.lit(1.0) + _c(d))


def apply_temporal_weighting(df: DataFrame, vec: str = "embedding", days: str = "date_days",
                             decay_days: float = 7.0, out: str | None = None) -> DataFrame:
    """V7 over a set: reference = latest non-null date of *this* (filtered) set.

    The reference date is a scalar subquery (one partial max per partition, one
    value broadcast back), not a window over the whole set and not a join.
    When every date is null the vectors are unchanged.
    """
    ref = df.select(F.max(days)).scalar()
    w = temporal_weight(F.col(days), ref, decay_days)
    return df.withColumn("temporal_weight", w).withColumn(out or vec, scale(vec, F.col("temporal_weight")))


def distance_confidence(df: DataFrame, dist: str = "distance", keep: Column | None = None,
                        out: str = "confidence") -> DataFrame:
    """exp(-d / max d) over the job; rows outside ``keep`` get 0; max <= 0 -> null."""
    kept = df if keep is None else df.where(keep)
    mx = kept.select(F.max(dist)).scalar()
    conf = F.when(mx > 0, F.exp(-F.col(dist) / mx))
    if keep is not None:
        conf = F.when(keep, conf).otherwise(F.lit(0.0))
    return df.withColumn(out, conf)


# The same functions callable from SQL. SQL UDFs are inlined by Catalyst, so
# they stay inside codegen like the DataFrame forms above.
_SQL_FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (acc, v) -> acc + v)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE",
                 "sqrt(aggregate(transform(a, x -> x * x), 0D, (acc, v) -> acc + v))"),
    "vec_sq_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                  "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (acc, v) -> acc + v)"),
    "vec_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
               "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (acc, v) -> acc + v))"),
    "vec_l1": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
               "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (acc, v) -> acc + v)"),
    "vec_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                   "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (acc, v) -> acc + v), "
                   "sqrt(aggregate(transform(a, x -> x * x), 0D, (acc, v) -> acc + v)) * "
                   "sqrt(aggregate(transform(b, x -> x * x), 0D, (acc, v) -> acc + v)))"),
    "vec_normalize": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>",
                      "CASE WHEN aggregate(transform(a, x -> x * x), 0D, (acc, v) -> acc + v) > 0 "
                      "THEN transform(a, x -> x / sqrt(aggregate(transform(a, y -> y * y), 0D, "
                      "(acc, v) -> acc + v))) ELSE a END"),
    "temporal_weight": ("d DOUBLE, ref DOUBLE, decay DOUBLE", "DOUBLE",
                        "coalesce(exp(-abs(d - ref) / decay), 1D)"),
    "distance_to_similarity": ("d DOUBLE", "DOUBLE", "1D / (1D + d)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register the vector functions as temporary SQL functions."""
    for name, (args, ret, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return sorted(_SQL_FUNCTIONS)
