"""Projections and predicates over vector sets.

Two filter semantics coexist on purpose (trap D16):
* clustering filters (F2-F6): equality on a single value, a temporal window
  that only applies when both bounds are given, unknown keys ignored;
* search filters (F7): a list means IN, a scalar means equality, a missing
  column or a null value never matches.
Both compile to one Catalyst predicate, so Parquet pushdown applies whenever
the columns come straight from a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.vector import l2_norm, parse_iso_days


def _meta_field(df: DataFrame, meta: str, name: str) -> Column:
    """The field of the nested metadata, or the record's own where it isn't nested."""
    if meta in df.columns and name in getattr(df.schema[meta].dataType, "names", []):
        return F.col(f"{meta}.{name}")
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def extract_clustering_metadata(df: DataFrame, meta: str = "metadata") -> DataFrame:
    """project domain / event_type / entity_type and the item date in days.

    The date is the first non-empty of temporal_reference, publication_date and
    date, parsed as ISO-8601 ('Z' or an offset allowed, naive text = UTC); text
    that does not parse gives null.
    """
    def text(name):
        return F.nullif(F.trim(_meta_field(df, meta, name).cast("string")), F.lit(""))

    first_date = F.coalesce(text("temporal_reference"), text("publication_date"), text("date"))
    return df.withColumns({"domain": _meta_field(df, meta, "domain"), "event_type": _meta_field(df, meta, "event_type"),
                           "entity_type": _meta_field(df, meta, "entity_type"),
                           "date_days": parse_iso_days(first_date)})


def _days_literal(v) -> Column:
    if isinstance(v, (int, float)):
        return F.lit(float(v))
    return parse_iso_days(F.lit(str(v)))


def filter_predicate(filters: dict | None) -> Column:
    """F2-F6 as one predicate: AND of the known keys; no filters -> TRUE."""
    preds: list[Column] = []
    for key in ("domain", "event_type", "entity_type"):
        if filters and filters.get(key) is not None:
            preds.append(F.col(key) == F.lit(filters[key]))
    window = (filters or {}).get("temporal_window") or {}
    start, end = window.get("start"), window.get("end")
    if start is not None and end is not None:
        # inclusive at both ends; a null date is excluded (trap D3)
        preds.append(F.coalesce(F.col("date_days").between(_days_literal(start), _days_literal(end)),
                                F.lit(False)))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def apply_metadata_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """rows passing every known filter."""
    return df.where(filter_predicate(filters))


def filter_domain(df: DataFrame, domain: str) -> DataFrame:
    """F2."""
    return apply_metadata_filters(df, {"domain": domain})


def filter_event_type(df: DataFrame, event_type: str) -> DataFrame:
    """F3."""
    return apply_metadata_filters(df, {"event_type": event_type})


def filter_entity_type(df: DataFrame, entity_type: str) -> DataFrame:
    """F4."""
    return apply_metadata_filters(df, {"entity_type": entity_type})


def filter_temporal_window(df: DataFrame, start, end) -> DataFrame:
    """F5."""
    return apply_metadata_filters(df, {"temporal_window": {"start": start, "end": end}})


def search_predicate(df: DataFrame, filters: dict | None) -> Column:
    """list -> IN, scalar -> equality; a missing column or null value -> false."""
    preds: list[Column] = []
    for key, want in (filters or {}).items():
        if key not in df.columns:
            preds.append(F.lit(False))
            continue
        if isinstance(want, (list, tuple, set)):
            p = F.col(key).isin(list(want))
        else:
            p = F.col(key) == F.lit(want)
        preds.append(F.coalesce(p, F.lit(False)))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def matches_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    return df.where(search_predicate(df, filters))


def map_back_labels(all_items: DataFrame, labelled: DataFrame, id_col: str = "item_id",
                    label_col: str = "label", prob_col: str | None = "probability") -> DataFrame:
    """F8: every input row keeps a label; rows removed by the filters get -1 (probability 0).

    ``id_col`` must identify a row: several vectors may share an ``item_id``, a
    position (``pos``) is one vector's.
    """
    cols = [id_col, label_col] + ([prob_col] if prob_col and prob_col in labelled.columns else [])
    out = all_items.join(labelled.select(*cols), id_col, "left")
    out = out.withColumn(label_col, F.coalesce(F.col(label_col), F.lit(-1)).cast("int"))
    if prob_col and prob_col in labelled.columns:
        out = out.withColumn(prob_col, F.coalesce(F.col(prob_col), F.lit(0.0)))
    return out


def check_vectors(df: DataFrame, dim: int, vec: str = "embedding", tol: float = 1e-3,
                  require_normalised: bool = True) -> tuple[DataFrame, DataFrame]:
    """split into (valid, quarantine) with a reason; raise on an empty set.

    The emptiness check is ``isEmpty`` (one LIMIT 1 job), never a count.
    """
    if df.isEmpty():
        raise ValueError("empty vector set")
    norm = l2_norm(vec)
    reason = (F.when(F.col(vec).isNull(), F.lit("null_vector"))
              .when(F.size(vec) != F.lit(dim), F.lit("wrong_dimension"))
              .when(F.lit(require_normalised) & (F.abs(norm - F.lit(1.0)) > F.lit(tol)),
                    F.lit("not_normalised")))
    flagged = df.withColumn("reject_reason", reason)
    return (flagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            flagged.where(F.col("reject_reason").isNotNull()))
