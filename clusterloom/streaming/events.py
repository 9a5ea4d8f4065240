"""Structured Streaming side (S10, S11, T1-T8, T11) and the batch twins of its aggregations.

The same builder functions run on a batch DataFrame (the twin used by the
oracle checks) and on a streaming one. Watermarks bound the state of every
stateful operator; stateful per-key logic (job lifecycle, progress throttle)
uses ``applyInPandasWithState`` so state lives in the checkpointed state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from clusterloom.operators.rules import job_requests, trigger_decision, validate_events

RAW_EVENT_SCHEMA = "event_id string, ts timestamp, payload string"


def read_event_stream(spark: SparkSession, path: str, fmt: str = "json", max_files_per_trigger: int = 10
                      ) -> DataFrame:
    """Ordered upstream event source (files), read in bounded micro-batches."""
    return (spark.readStream.schema(RAW_EVENT_SCHEMA).format(fmt)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def stream_triggers(raw: DataFrame, rules: dict | None = None) -> DataFrame:
    """Validate (F10), decide (F11) and emit job requests; stateless, batch or stream."""
    return job_requests(trigger_decision(validate_events(raw), rules), rules)


def dedupe_requests_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same upstream job arriving twice (stream + webhook) triggers once.

    The watermark bounds the dedup state to ``delay`` of event time.
    """
    return (requests.withWatermark("requested_at", delay)
            .dropDuplicatesWithinWatermark(["upstream_job_id", "embedding_type"]))


def dedupe_requests_batch(requests: DataFrame, delay_seconds: float = 3600.0) -> DataFrame:
    """T2 batch twin: per (upstream job, type) a request counts unless one was kept less than the
    delay before; ``duplicates`` is how many requests each kept one stands for, itself included."""
    kept = throttle_batch(requests.withColumnRenamed("requested_at", "ts"),
                          ["upstream_job_id", "embedding_type", "request_id"], [], delay_seconds)
    return kept.withColumnRenamed("ts", "requested_at").withColumnRenamed("n_events", "duplicates")


def consumer_stats(decided: DataFrame) -> DataFrame:
    """Events processed, jobs triggered, errors and last event time (complete mode on a stream)."""
    return decided.agg(F.count("*").alias("events_processed"),
                       F.count_if(F.col("decision") == "triggered").alias("jobs_triggered"),
                       F.count_if(F.col("decision") == "invalid").alias("errors"),
                       F.max("event_ts").alias("last_event_ts"))


def error_alerts(errors: DataFrame, window: str = "300 seconds", slide: str = "60 seconds",
                 threshold: int = 10, watermark: str | None = None) -> DataFrame:
    """Errors by type in a sliding window; rows at or above ``threshold`` are alerts."""
    e = errors.withWatermark("ts", watermark) if watermark else errors
    w = e.groupBy(F.window("ts", window, slide), "error_type").agg(F.count("*").alias("n_errors"))
    return w.where(F.col("n_errors") >= threshold).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "error_type", "n_errors")


def activity_sessions(events: DataFrame, gap: str = "300 seconds", key: str | None = None,
                      watermark: str | None = None) -> DataFrame:
    """Busy periods: a session ends after ``gap`` without activity (session windows)."""
    e = events.withWatermark("ts", watermark) if watermark else events
    keys = [F.session_window("ts", gap)] + ([key] if key else [])
    s = e.groupBy(*keys).agg(F.count("*").alias("n_events"))
    return s.select(*([key] if key else []), F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "n_events")


def event_payload(df: DataFrame, event_type: str, fields: list[str], key: str = "job_id") -> DataFrame:
    """Lifecycle event rows with a JSON payload (null fields dropped, non-strings encoded)."""
    return df.select(F.lit(event_type).alias("event_type"), F.col(key).alias("key"),
                     F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("payload"))


# The eight lifecycle events and the fields each carries besides event_type and timestamp.
LIFECYCLE_EVENTS = {
    "job.created": ("job_id", "embedding_type", "algorithm"),
    "job.started": ("job_id", "total_items"),
    "job.progress": ("job_id", "processed_items", "total_items", "clusters_created", "progress_percent"),
    "job.completed": ("job_id", "clusters_created", "outliers", "quality_metrics", "processing_time_ms"),
    "job.failed": ("job_id", "error_message"),
    "job.paused": ("job_id", "processed_items"),
    "job.resumed": ("job_id",),
    "job.canceled": ("job_id",),
}


def lifecycle_payload(df: DataFrame, event_type: str, at: str = "timestamp", more: tuple[str, ...] = ()) -> DataFrame:
    """Events of one of the eight types; fields that ``df`` lacks are null and left out of the payload.

    ``progress_percent`` is derived (0 without items); ``more`` adds columns, as the
    statistics, sample clusters and output paths of a completion.
    """
    fields = LIFECYCLE_EVENTS[event_type]
    if "progress_percent" in fields:
        df = df.withColumn("progress_percent", F.when(F.col("total_items") > 0, F.round(
            F.col("processed_items") * 100.0 / F.col("total_items"), 2)).otherwise(F.lit(0.0)))
    have = [f for f in (*fields, *more) if f in df.columns]
    stamped = df.withColumn("event_type", F.lit(event_type)).withColumn("timestamp", F.col(at))
    return event_payload(stamped, event_type, ["event_type", *have, "timestamp"])


# ----------------------------------------------------------------------------- stateful: T4, T5

# Legal lifecycle moves (command -> allowed from-states, next state).
TRANSITIONS = {
    "start": (("queued",), "running"),
    "pause": (("running",), "paused"),
    "resume": (("paused",), "queued"),
    "complete": (("running",), "completed"),
    "fail": (("queued", "running", "paused"), "failed"),
    "cancel": (("queued", "running", "paused"), "canceled"),
}
LIFECYCLE_OUT = "job_id string, seq long, command string, from_status string, to_status string, legal boolean"
LIFECYCLE_STATE = "status string"
STATES = ("queued", "running", "paused", "completed", "failed", "canceled")
LOG_CHUNK = 100_000


def _fold_lifecycle(job_id: str, rows: pd.DataFrame, status: str) -> tuple[pd.DataFrame, str]:
    out = []
    for r in rows.sort_values(["ts", "seq"]).itertuples(index=False):
        allowed, nxt = TRANSITIONS.get(r.command, ((), None))
        legal = status in allowed
        new = nxt if legal else status
        out.append((job_id, int(r.seq), r.command, status, new, legal))
        status = new
    return pd.DataFrame(out, columns=["job_id", "seq", "command", "from_status", "to_status", "legal"]), status


def job_lifecycle_batch(commands: DataFrame, chunk: int = LOG_CHUNK) -> DataFrame:
    """T4 batch twin: commands of each job applied in (ts, seq) order from ``queued``.

    All logs are ordered by one distributed sort and cut into chunks of rows, whatever jobs
    they belong to: a group is a chunk, not a job. Only the last job of a chunk can go on in
    the next one; its part is summarised as the map from each state to the state after it,
    the maps are composed per job (a row for each chunk), and every chunk is folded with the
    state in which its first job comes.
    """
    from clusterloom.operators.jobs import global_rank

    cols = ["job_id", "ts", "seq", "command"]
    ranked = global_rank(commands.select(*cols), [F.asc("job_id"), F.asc("ts"), F.asc("seq")], "_g").withColumn(
        "_chunk", F.floor((F.col("_g") - 1) / F.lit(chunk)).cast("long")).drop("_g").where(F.col("job_id").isNotNull())

    def summary(key, pdf: pd.DataFrame) -> pd.DataFrame:
        after = [_fold_lifecycle(key[1], pdf, s)[1] for s in STATES]
        return pd.DataFrame({"job_id": [key[1]], "_chunk": [key[0]], "_after": [after]})

    def first_states(key, pdf: pd.DataFrame) -> pd.DataFrame:
        status, first = "queued", []
        for row in pdf.sort_values("_chunk").itertuples(index=False):
            status = row[2][STATES.index(status)]
            first.append((row[1] + 1, key[0], status))
        return pd.DataFrame(first, columns=["_chunk", "_job", "_first"])

    ends = ranked.groupBy("_chunk").agg(F.min("job_id").alias("_opens"), F.max("job_id").alias("job_id"))
    on = ends.select((F.col("_chunk") - 1).alias("_chunk"), F.col("_opens").alias("job_id"))  # goes on in the next
    last = ends.select("_chunk", "job_id").join(on, ["_chunk", "job_id"], "left_semi")
    maps = ranked.join(last, ["_chunk", "job_id"]).groupBy("_chunk", "job_id").applyInPandas(
        summary, "job_id string, _chunk long, _after array<string>")
    starts = maps.groupBy("job_id").applyInPandas(first_states, "_chunk long, _job string, _first string")

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["job_id", "ts", "seq"])
        begins = dict(zip(pdf["_job"].iloc[:1], pdf["_first"].iloc[:1]))
        out, job, status = [], None, None
        for name, seq, command in zip(pdf["job_id"], pdf["seq"], pdf["command"]):
            if name != job:
                job, status = name, begins.get(name, "queued")
            allowed, nxt = TRANSITIONS.get(command, ((), None))
            legal = status in allowed
            new = nxt if legal else status
            out.append((job, int(seq), command, status, new, legal))
            status = new
        return pd.DataFrame(out, columns=["job_id", "seq", "command", "from_status", "to_status", "legal"])

    return ranked.join(starts, "_chunk", "left").groupBy("_chunk").applyInPandas(fold, LIFECYCLE_OUT)


def job_lifecycle_stream(commands: DataFrame, timeout_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """T4: lifecycle state per job in the state store; idle jobs expire after ``timeout_ms``
    (7 days by default, the reference's job expiry).

    Within a micro-batch commands are applied in (ts, seq) order; illegal
    moves are reported with ``legal = false`` and leave the state unchanged.
    """
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        status = state.get[0] if state.exists else "queued"
        frames = list(pdfs)
        rows = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame()
        if len(rows):
            out, status = _fold_lifecycle(key[0], rows, status)
            yield out
        state.update((status,))
        state.setTimeoutDuration(int(timeout_ms))

    return commands.groupBy("job_id").applyInPandasWithState(
        fn, LIFECYCLE_OUT, LIFECYCLE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


THROTTLE_OUT = "job_id string, ts timestamp, processed_items long"


def _throttle(rows: pd.DataFrame, last_us: int | None, every_us: int) -> tuple[list, int | None]:
    keep = []
    for r in rows.sort_values(["ts", "processed_items"]).itertuples(index=False):
        t = pd.Timestamp(r.ts).value // 1000
        if last_us is None or t - last_us >= every_us:
            keep.append((r.job_id, r.ts, int(r.processed_items)))
            last_us = t
    return keep, last_us


def _starts(after: list[int]) -> list[bool]:
    """Rows of a chunk that are kept whatever was kept before them: ``after`` is each row's successor, from 0."""
    start = [False] * len(after)
    for p, t in enumerate(after[:-1]):
        start[p + 1] = t == p + 1
    return start


def throttle_batch(rows: DataFrame, keys: list[str], carry: list[str], every_seconds: float,
                   chunk: int = LOG_CHUNK) -> DataFrame:
    """Of each key's rows, in time order, those at least ``every_seconds`` after the last one kept.

    Output: keys, ts, carry, and ``n_events`` (rows a kept one stands for). Rows without a time come before all
    others, at one moment.

    A row's successor (its key's first row at least the interval later, or the next key's first row) is a running
    count over rows and row ends in one sorted order. The kept rows are those that the successors lead to from
    each key's first. Sorted rows are cut into chunks: a chunk gives where its rows leave it, the rows that are
    entered from other chunks are marked by pointer doubling (logarithmically many rounds in the chunks of a dense
    stretch), and each chunk follows its own marked rows. So a key's whole log, however dense, is never one group.
    """
    from clusterloom.operators.jobs import global_rank
    from clusterloom.operators.profiles import prefix_count
    from clusterloom.session import cut_lineage

    every = int(every_seconds * 1e6)
    order = [*keys, "ts", *carry]
    ranked = global_rank(rows.select(*order), [F.asc(c) for c in order], "_g").withColumn(
        "_us", F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))))
    ends = ranked.select(*keys, (F.col("_us") + F.lit(every)).alias("_us"), "_g", F.lit(0).alias("_row"))
    both = global_rank(ranked.select(*keys, "_us", "_g", F.lit(1).alias("_row")).unionByName(ends),
                       [*[F.asc(c) for c in keys], F.asc("_us"), F.asc("_row"), F.asc("_g")], "_place")
    after = prefix_count(both, "_place", "_row", "_before").where(F.col("_row") == 0).select(
        "_g", F.greatest(F.col("_before") + 1, F.col("_g") + 1).alias("_next"))
    linked = cut_lineage(ranked.drop("_us").join(after, "_g").withColumn(
        "_chunk", F.floor((F.col("_g") - 1) / F.lit(chunk))))

    def leave(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = key[0] * chunk + 1
        after = (pdf.sort_values("_g")["_next"] - first).tolist()
        start, out = _starts(after), [-1] * len(after)
        for p in range(len(after) - 1, -1, -1):  # a chain that meets a start ends there: that row is kept anyway
            t = after[p]
            out[p] = t if t >= len(after) else -1 if start[t] else out[t]
        start[0] |= first == 1
        found = [p for p, t in enumerate(out) if t >= 0]
        return pd.DataFrame({"_g": [first + p for p in found], "_to": [first + out[p] for p in found],
                             "_start": [start[p] for p in found]})

    hops = cut_lineage(linked.select("_g", "_next", "_chunk").groupBy("_chunk").applyInPandas(
        leave, "_g long, _to long, _start boolean"))
    over = linked.where((F.col("_g") % chunk == 0) & (F.col("_next") == F.col("_g") + 1)).select("_next")
    marked = cut_lineage(hops.where("_start").select(F.col("_to").alias("_g")).union(over).distinct())
    jump = cut_lineage(hops.select("_g", "_to").join(hops.select(F.col("_to").alias("_g")).distinct(), "_g", "left_semi"))
    while not jump.isEmpty():
        marked = cut_lineage(marked.union(jump.join(marked, "_g", "left_semi").select("_to")).distinct())
        jump = cut_lineage(jump.join(jump.select(F.col("_g").alias("_to"), F.col("_to").alias("_on")), "_to")
                           .select("_g", F.col("_on").alias("_to")))

    def follow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = key[0] * chunk + 1
        pdf = pdf.sort_values("_g")
        after = (pdf["_next"] - first).tolist()
        keep = [a or b for a, b in zip(_starts(after), pdf["_marked"].tolist())]
        keep[0] |= first == 1
        for p, t in enumerate(after):
            if keep[p] and t < len(after):
                keep[t] = True
        kept = pdf[keep]
        return kept[order].assign(n_events=kept["_next"] - kept["_g"])

    schema = StructType(list(ranked.select(*order).schema.fields)).add("n_events", "long")
    return (linked.join(marked.withColumn("_hit", F.lit(True)), "_g", "left")
            .withColumn("_marked", F.coalesce("_hit", F.lit(False))).drop("_hit")
            .groupBy("_chunk").applyInPandas(follow, schema))


def throttle_progress_batch(progress: DataFrame, every_seconds: float = 5.0) -> DataFrame:
    """T5 batch twin: at most one progress event per job per ``every_seconds``."""
    return throttle_batch(progress.select("job_id", "ts", "processed_items"), ["job_id"], ["processed_items"],
                          every_seconds).select("job_id", "ts", "processed_items")


def throttle_progress_stream(progress: DataFrame, every_seconds: float = 5.0,
                             idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """T5: the throttle with the last emitted time kept in the state store.

    The state of a job without events for ``idle_ms`` (a day by default) is removed;
    its next event counts as a first one.
    """
    every = int(every_seconds * 1e6)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frames = list(pdfs)
        if frames:
            keep, last = _throttle(pd.concat(frames, ignore_index=True), last, every)
            if keep:
                yield pd.DataFrame(keep, columns=["job_id", "ts", "processed_items"])
        if last is not None:
            state.update((int(last),))
            state.setTimeoutDuration(int(idle_ms))

    return progress.select("job_id", "ts", "processed_items").groupBy("job_id").applyInPandasWithState(
        fn, THROTTLE_OUT, "last_us long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def retry_or_dead_letter(failures: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Attempts per event id; at the limit the event goes to the dead letters."""
    a = failures.groupBy("event_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_failure"))
    return a.withColumn("route", F.when(F.col("attempts") >= max_attempts, F.lit("dead_letter"))
                        .otherwise(F.lit("retry")))


def incremental_assign_stream(new_vectors: DataFrame, centroid_path: str, checkpoint: str,
                              max_distance: float | None = None, label: str = "label",
                              assignment_path: str | None = None):
    """C13 for arriving vectors.

    Every micro-batch reads the latest centroid version before its own, assigns,
    writes the assignments of the batch (``batch=<id>`` under ``assignment_path``,
    replaced if the batch runs again) and a new version (the batch id after the
    version the table began with). A batch whose version is there already, after a
    restart, isn't counted twice.
    """
    from clusterloom.operators.kmeans import incremental_assign

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cents = spark.read.parquet(centroid_path)
        base = cents.select(F.min("version")).first()[0]
        version = int(base) + 1 + int(batch_id)
        known = {r[0] for r in cents.where(F.col("version") >= version - 1).select("version").distinct().collect()}
        latest = cents.where(F.col("version") < version).select(F.max("version")).first()[0]
        current = cents.where(F.col("version") == latest).drop("version")
        assigned, upd = incremental_assign(batch, current, max_distance, label=label)
        if assignment_path:
            assigned.write.mode("overwrite").parquet(f"{assignment_path}/batch={int(batch_id)}")
        if version in known:
            return
        # keep the table's own column types (a version written as int next to long files cannot be read)
        upd.withColumn("version", F.lit(version)).select(
            *[F.col(f.name).cast(f.dataType) for f in cents.schema.fields]).write.mode("append").parquet(centroid_path)

    return (new_vectors.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
