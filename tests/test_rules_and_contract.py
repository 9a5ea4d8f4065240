"""Rules, request validation, parameters, and the driver contract."""

import json

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from clusterloom.operators import rules as R
from helpers import SF_SMALL


def _events(spark, payloads):
    rows = [(str(i), None, json.dumps(p) if isinstance(p, dict) else p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "event_id string, ts timestamp, payload string")


BASE = {"event_type": "embedding.job.completed", "job_id": "u1", "embedding_type": "document",
        "total_embeddings": 50, "quality_score": 0.9, "timestamp": "2024-01-01T00:00:00Z"}


def test_trigger_rules(spark):
    cases = [BASE, {**BASE, "event_type": "embedding.job.started"}, {**BASE, "total_embeddings": 5},
             {**BASE, "quality_score": -0.1}, {k: v for k, v in BASE.items() if k != "job_id"},
             {**BASE, "embedding_type": "image"}, {**BASE, "quality_score": None}, "not json"]
    got = [r["decision"] for r in R.trigger_decision(R.validate_events(_events(spark, cases)))
           .orderBy(F.col("event_id").cast("int")).collect()]
    assert got == ["triggered", "event_type_not_triggering", "insufficient_embeddings",
                   "embedding_quality_too_low", "invalid", "embedding_type_not_allowed", "triggered", "invalid"]
    off = R.trigger_decision(R.validate_events(_events(spark, [BASE])), {"auto_trigger": False}).first()
    assert off["decision"] == "auto_trigger_disabled"


def test_request_validation_and_params(spark):
    req = spark.createDataFrame(
        [("r1", "hdbscan", {"min_cluster_size": "1"}), ("r2", "KMeans", {"n_clusters": "8"}),
         ("r3", "agglomerative", {}), ("r4", "spectral", {}), ("r5", None, None)],
        "request_id string, algorithm string, params map<string,string>")
    errs = {r["request_id"]: r["errors"] for r in R.validate_job_requests(req).collect()}
    assert set(errs["r1"]) == {"min_cluster_size"} and errs["r2"] == {}
    assert set(errs["r3"]) == {"distance_threshold"} and set(errs["r4"]) == {"algorithm"}
    merged = {r["request_id"]: r["params"] for r in R.merge_params(req).collect()}
    assert merged["r2"]["n_clusters"] == "8" and merged["r2"]["max_iter"] == "300"
    assert merged["r5"]["min_cluster_size"] == "5"


def test_contract_keys_and_entry(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    out = E.entry(spark)
    assert out.count() >= 0 and "size" in out.columns


def test_oracles_on_small_scale(spark):
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    from clusterloom.sources.testdata import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ["vector_set_stats", "metadata_filters", "temporal_weighting", "knn_graph", "silhouette",
                 "trigger_decisions", "queue_order", "threshold_components"]:
        s = qs[name](spark, SF_SMALL).toPandas()
        d = con.execute(sql[name]).df()
        cols = sorted(s.columns)
        assert cols == sorted(d.columns), name
        key = lambda df: sorted(map(repr, df[cols].round(6).itertuples(index=False)))
        assert key(s) == key(d), name
