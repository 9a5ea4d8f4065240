"""Vector-set sources: attach metadata with fallbacks (S3), fetch by ids (S5), type aliases."""

import pytest

from clusterloom.sources import vectors as SV


def test_attach_metadata_null_and_cycle(spark):
    vec = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0]), (3, [4.0])], "pos long, embedding array<double>")
    meta = spark.createDataFrame([("0", 0, "a", None, None), ("1", 1, "b", None, None)],
                                 "meta_key string, meta_pos long, id string, source_id string, metadata string")
    plain = {r["pos"]: r["id"] for r in SV.attach_metadata(vec, meta).collect()}
    assert plain == {0: "a", 1: "b", 2: None, 3: None}
    cyc = {r["pos"]: r["id"] for r in SV.attach_metadata(vec, meta, fallback="cycle").collect()}
    assert cyc == {0: "a", 1: "b", 2: "a", 3: "b"}


def test_vectors_by_ids_request_order_and_last_wins(spark):
    vec = spark.createDataFrame([(0, "x", [0.0]), (1, "y", [1.0]), (2, "x", [2.0])],
                                "pos long, item_id string, embedding array<double>")
    req = spark.createDataFrame([(0, "y"), (1, "nope"), (2, "x")], "req_pos long, item_id string")
    got = [(r["item_id"], r["pos"]) for r in SV.vectors_by_ids(vec, req).collect()]
    assert got == [("y", 1), ("x", 2)]


def test_type_aliases():
    assert SV.canonical_type("Entities") == "entity" and SV.canonical_type("eventss") == "event"
    with pytest.raises(ValueError):
        SV.canonical_type("image")


def test_flat_records_and_repeated_ids(spark):
    from clusterloom.operators import filters as FL

    flat = spark.createDataFrame([("a", "en", "click", "2024-01-02T00:00:00"), ("b", None, "view", "bad")],
                                 "item_id string, domain string, event_type string, publication_date string")
    rows = {r["item_id"]: r for r in FL.extract_clustering_metadata(flat).collect()}
    assert rows["a"]["domain"] == "en" and rows["a"]["date_days"] == 19724.0
    assert rows["b"]["date_days"] is None and rows["b"]["entity_type"] is None
    items = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "pos long, item_id string")
    kept = spark.createDataFrame([(0, 4), (2, 5)], "pos long, label int")
    out = FL.map_back_labels(items, kept, id_col="pos", prob_col=None).collect()
    assert sorted((r["pos"], r["label"]) for r in out) == [(0, 4), (1, -1), (2, 5)]


def test_naive_dates_are_utc_in_any_zone(spark):
    from clusterloom.functions.vector import parse_iso_days
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T00:00:00Z",), ("2024-01-01T05:00:00+05:00",),
                                ("2024-01-01",), ("x",), ("",)], "t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(parse_iso_days(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [19723.0, 19723.0, 19723.0, 19723.0, None, None]


def test_metadata_files_and_missing_types(spark, tmp_path):
    import json

    records = [{"id": f"m{i}", "source_id": f"s{i}", "embedding_type": "event", "metadata": {"domain": "en"}} for i in range(7)]
    (tmp_path / "list.json").write_text(json.dumps(records))
    (tmp_path / "one.json").write_text(json.dumps(records[3], indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    for name, shape, want in (("list", "list", records), ("one", "object", records[3:4]), ("lines", "lines", records)):
        got = SV.read_metadata_json(spark, str(tmp_path / f"{name}.json"), shape).orderBy("meta_pos").collect()
        assert [(r["meta_pos"], r["meta_key"]) for r in got] == [(i, r["id"]) for i, r in enumerate(want)]
    vec = spark.createDataFrame([(0, "event", [1.0])], "pos long, embedding_type string, embedding array<double>")
    SV.write_vectors(vec, str(tmp_path / "v"))
    assert SV.read_vectors(spark, str(tmp_path / "v"), "events").count() == 1
    with pytest.raises(FileNotFoundError):
        SV.read_vectors(spark, str(tmp_path / "v"), "entity")
