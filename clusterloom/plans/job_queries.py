"""Registered job-table, rule and stream batch-twin queries (W, A15-A17, F10-F17, T1-T3, T6, T8, T9, J7, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterloom.operators import jobs as J
from clusterloom.operators import rules as R
from clusterloom.plans.catalog import ITEMS, r6, register
from clusterloom.sources import testdata as TD
from clusterloom.streaming import events as SE


def micros_ntz(c):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz"))


JOBS_SQL = """WITH jobs AS (
  SELECT 'job_' || CAST(o_orderkey AS VARCHAR) AS job_id,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'failed'
              WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'canceled'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'paused'
              WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'running' END AS status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 9 ELSE 5 END AS priority,
         o_orderdate AS created_at
  FROM orders),
progress AS (
  SELECT 'job_' || CAST(l_orderkey AS VARCHAR) AS job_id, l_shipdate AS ts,
         CAST(l_linenumber AS BIGINT) AS processed_items, l_linestatus AS line_status,
         l_returnflag AS return_flag,
         'item_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS item_id
  FROM lineitem)
"""


@register("service_statistics", JOBS_SQL + """,
dim AS (SELECT unnest(['queued', 'running', 'paused', 'completed', 'failed', 'canceled']) AS status)
SELECT dim.status, coalesce(n, 0) AS n_jobs FROM dim LEFT JOIN (
  SELECT status, count(*) AS n FROM jobs GROUP BY status) c USING (status)
""")
def q_service_statistics(spark, sf):
    """Jobs by status, all six states kept."""
    return J.service_statistics(TD.jobs_table(spark, sf))


@register("success_rate", JOBS_SQL + """
SELECT round(coalesce(count(*) FILTER (WHERE status = 'completed') * 100.0 /
       nullif(count(*) FILTER (WHERE status IN ('completed', 'failed')), 0), 0.0), 6) AS success_rate FROM jobs
""")
def q_success_rate(spark, sf):
    """Completed / (completed + failed) x 100."""
    return J.success_rate(TD.jobs_table(spark, sf)).select(r6("success_rate").alias("success_rate"))


@register("list_jobs", JOBS_SQL + """
SELECT job_id, CAST(epoch_us(created_at) AS BIGINT) AS created_us FROM jobs WHERE status = 'completed'
ORDER BY created_at DESC, job_id LIMIT 100
""")
def q_list_jobs(spark, sf):
    """Completed jobs, newest first, top 100 (a listing: the limit is the feature)."""
    return J.list_jobs(TD.jobs_table(spark, sf), "completed", 100).select(
        "job_id", micros_ntz("created_at").alias("created_us"))


@register("queue_order", JOBS_SQL + """
SELECT job_id, row_number() OVER (ORDER BY priority DESC, created_at, job_id) AS queue_position
FROM jobs WHERE status = 'queued'
""")
def q_queue_order(spark, sf):
    """Queue position of every queued job (distributed sort + zipWithIndex)."""
    return J.queue_order(TD.jobs_table(spark, sf)).select("job_id", "queue_position")


@register("job_progress", JOBS_SQL + """,
tot AS (SELECT job_id, max(processed_items) AS total_items FROM progress GROUP BY job_id),
seen AS (SELECT job_id, arg_max(processed_items, (ts, processed_items)) AS processed_items, min(ts) AS first_ts
         FROM progress WHERE ts <= TIMESTAMP '1996-06-01 00:00:00' GROUP BY job_id)
SELECT job_id, processed_items, total_items,
       round(round(processed_items * 100.0 / total_items, 2), 6) AS percent,
       round(processed_items / nullif((epoch_us(TIMESTAMP '1996-06-01 00:00:00') - epoch_us(first_ts)) / 1e6, 0), 6)
         AS items_per_second,
       round((total_items - processed_items) /
             nullif(processed_items / nullif((epoch_us(TIMESTAMP '1996-06-01 00:00:00') - epoch_us(first_ts)) / 1e6, 0),
                    0), 6) AS remaining_seconds
FROM seen JOIN tot USING (job_id)
""")
def q_job_progress(spark, sf):
    """Progress percent, rate and time left per job as of 1996-06-01."""
    p = J.job_progress(TD.progress_events(spark, sf), F.lit("1996-06-01 00:00:00").cast("timestamp_ntz"))
    return p.select("job_id", "processed_items", "total_items", r6("percent").alias("percent"),
                    r6("items_per_second").alias("items_per_second"), r6("remaining_seconds").alias("remaining_seconds"))


@register("expire_jobs", JOBS_SQL + """,
expired AS (SELECT job_id FROM jobs WHERE created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 7 DAY)
SELECT p.job_id, count(*) AS n_progress FROM progress p
WHERE p.job_id NOT IN (SELECT job_id FROM expired) GROUP BY p.job_id
""")
def q_expire_jobs(spark, sf):
    """Jobs older than 7 days before the newest are removed with their progress rows."""
    jobs = TD.jobs_table(spark, sf)
    cutoff = jobs.select(F.max("created_at")).scalar() - F.expr("INTERVAL 7 DAYS")
    _, deps = J.expire_jobs(jobs, cutoff, {"progress": TD.progress_events(spark, sf)})
    return deps["progress"].groupBy("job_id").agg(F.count("*").alias("n_progress"))


@register("unprocessed_items", JOBS_SQL + """
SELECT job_id, count(*) AS pending FROM progress p
WHERE NOT EXISTS (SELECT 1 FROM progress q WHERE q.line_status = 'F' AND q.job_id = p.job_id AND q.item_id = p.item_id)
GROUP BY job_id
""")
def q_unprocessed_items(spark, sf):
    """Items of each job not in its processed set (anti join)."""
    p = TD.progress_events(spark, sf)
    done = p.where(F.col("line_status") == "F")
    return J.unprocessed_items(p, done, ["job_id", "item_id"]).groupBy("job_id").agg(F.count("*").alias("pending"))


@register("processed_set", JOBS_SQL + """
SELECT job_id, count(*) AS processed FROM (
  SELECT DISTINCT job_id, item_id FROM progress WHERE line_status = 'F' OR return_flag = 'R')
GROUP BY job_id
""")
def q_processed_set(spark, sf):
    """Distinct additions to the processed set from two sources."""
    p = TD.progress_events(spark, sf)
    s = J.add_processed(p.where(F.col("line_status") == "F"), p.where(F.col("return_flag") == "R"),
                        ["job_id", "item_id"])
    return s.groupBy("job_id").agg(F.count("*").alias("processed"))


@register("sample_rows", ITEMS + """
SELECT item_id FROM items ORDER BY md5(item_id || ':42'), item_id LIMIT 100
""")
def q_sample_rows(spark, sf):
    """Seeded deterministic sample of 100 items."""
    return J.sample_rows(TD.items(spark, sf), 100, 42).select("item_id")


@register("latest_events", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM events
ORDER BY ts DESC, event_id DESC LIMIT 1000
""")
def q_latest_events(spark, sf):
    """Bounded view of the event log (newest 1000)."""
    ev = TD.upstream_events(spark, sf)
    return J.latest_events(ev, 1000).select("event_id", F.unix_micros("ts").alias("ts_us"))


UP_SQL = """WITH up AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts, user_id, value, event_type AS raw_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'embedding.job.completed'
              WHEN event_type = 'signup' THEN 'embedding.job.started'
              WHEN event_type = 'view' THEN 'embedding.job.progress' ELSE 'embedding.job.failed' END AS etype,
         ['document', 'event', 'entity', 'storyline', 'image'][CAST(k % 5 AS INTEGER) + 1] AS embedding_type,
         CASE WHEN value < 400 THEN value / 100.0 - 0.5 END AS quality
  FROM events),
dec AS (
  SELECT *, CASE WHEN raw_type = 'view' THEN 'invalid'
                 WHEN etype <> 'embedding.job.completed' THEN 'event_type_not_triggering'
                 WHEN embedding_type NOT IN ('document', 'event', 'entity', 'storyline') THEN 'embedding_type_not_allowed'
                 WHEN k < {min_k} THEN 'insufficient_embeddings'
                 WHEN quality IS NOT NULL AND quality < 0.0 THEN 'embedding_quality_too_low'
                 ELSE 'triggered' END AS decision
  FROM up)
"""


@register("trigger_decisions", UP_SQL.format(min_k=10) + "SELECT event_id, decision FROM dec")
def q_trigger_decisions(spark, sf):
    """F10 + F11: validate each upstream event and apply the ordered trigger rules."""
    d = R.trigger_decision(R.validate_events(TD.upstream_events(spark, sf)))
    return d.select("event_id", "decision")


@register("receiver_decisions", UP_SQL.format(min_k=0) + """,
tok AS (SELECT event_id, raw_type = 'view' AS invalid, user_id % 4 = 0 AS wrong, embedding_type, quality FROM up),
rec AS (
  SELECT event_id, CASE WHEN invalid THEN 'invalid' WHEN wrong THEN 'unauthorized'
           WHEN embedding_type NOT IN ('document', 'event', 'entity', 'storyline') THEN 'embedding_type_not_allowed'
           WHEN quality < 0.0 THEN 'embedding_quality_too_low' ELSE 'triggered' END AS decision FROM tok)
SELECT event_id, decision, CASE decision WHEN 'triggered' THEN 202 WHEN 'invalid' THEN 422 WHEN 'unauthorized' THEN 401
  ELSE 400 END AS status_code, 'receiver_disabled' AS when_disabled, 503 AS disabled_code
FROM rec WHERE decision NOT IN ('invalid', 'unauthorized')
UNION ALL
SELECT event_id, decision, CASE decision WHEN 'invalid' THEN 422 ELSE 401 END, decision,
       CASE decision WHEN 'invalid' THEN 422 ELSE 401 END FROM rec WHERE decision IN ('invalid', 'unauthorized')
""")
def q_receiver_decisions(spark, sf):
    """webhook receiver rules (minimum 0, a token) with status codes, with the receiver on and off."""
    ev = R.validate_events(TD.upstream_events(spark, sf)).withColumn(
        "auth_token", F.when(F.regexp_extract("payload", r'"job_id":"up_(\d+)"', 1).cast("long") % 4 != 0, F.lit("s")))
    on = R.receiver_decision(ev, {"auth_token": "s"}).select("event_id", "decision", "status_code")
    off = R.receiver_decision(ev, {"auth_token": "s", "receiver_enabled": False}).select(
        "event_id", F.col("decision").alias("when_disabled"), F.col("status_code").alias("disabled_code"))
    return on.join(off, "event_id")


@register("stream_job_requests", UP_SQL.format(min_k=10) + """
SELECT 'auto_up_' || CAST(user_id AS VARCHAR) || '_' || embedding_type AS request_id,
       'up_' || CAST(user_id AS VARCHAR) AS upstream_job_id, embedding_type, 'hdbscan' AS algorithm,
       5 AS priority, 'stage3_event' AS triggered_by, true AS auto_triggered,
       CAST(epoch_us(ts) AS BIGINT) AS requested_us
FROM dec WHERE decision = 'triggered'
""")
def q_stream_job_requests(spark, sf):
    """T1 (batch twin): job requests with provenance for every triggered event."""
    req = R.job_requests(R.trigger_decision(R.validate_events(TD.upstream_events(spark, sf))))
    return req.select("request_id", "upstream_job_id", "embedding_type", "algorithm", "priority",
                      "triggered_by", "auto_triggered", F.unix_micros("requested_at").alias("requested_us"))


@register("dedupe_triggers", UP_SQL.format(min_k=10).replace("WITH up", "WITH RECURSIVE up") + """,
req AS (SELECT 'auto_up_' || CAST(user_id AS VARCHAR) || '_' || embedding_type AS request_id, epoch_us(ts) AS t
        FROM dec WHERE decision = 'triggered'),
kept AS (
  SELECT request_id, min(t) AS t FROM req GROUP BY request_id
  UNION
  SELECT k.request_id, (SELECT min(r.t) FROM req r WHERE r.request_id = k.request_id AND r.t >= k.t + 259200000000) AS t
  FROM kept k WHERE k.t IS NOT NULL),
spans AS (SELECT request_id, t, lead(t) OVER (PARTITION BY request_id ORDER BY t) AS nxt FROM kept WHERE t IS NOT NULL)
SELECT s.request_id, CAST(s.t AS BIGINT) AS requested_us, count(*) AS duplicates
FROM spans s JOIN req r ON r.request_id = s.request_id AND r.t >= s.t AND (s.nxt IS NULL OR r.t < s.nxt) GROUP BY ALL
""")
def q_dedupe_triggers(spark, sf):
    """T2 (batch twin): a request counts unless one of its (upstream job, type) was kept within 3 days before."""
    req = R.job_requests(R.trigger_decision(R.validate_events(TD.upstream_events(spark, sf))))
    return SE.dedupe_requests_batch(req, 3 * 86400.0).select("request_id", F.unix_micros("requested_at").alias("requested_us"),
                                                "duplicates")


@register("consumer_stats", UP_SQL.format(min_k=10) + """
SELECT count(*) AS events_processed, count(*) FILTER (WHERE decision = 'triggered') AS jobs_triggered,
       count(*) FILTER (WHERE decision = 'invalid') AS errors, CAST(max(epoch_us(ts)) AS BIGINT) AS last_event_us
FROM dec
""")
def q_consumer_stats(spark, sf):
    """T3 (batch twin): processed, triggered, errors, last event time."""
    d = R.trigger_decision(R.validate_events(TD.upstream_events(spark, sf)))
    return SE.consumer_stats(d).select("events_processed", "jobs_triggered", "errors",
                                       F.unix_micros("last_event_ts").alias("last_event_us"))


@register("error_alerts", UP_SQL.format(min_k=10) + """,
err AS (SELECT epoch_us(ts) AS t, 'E' || CAST(k % 3 AS VARCHAR) AS error_type FROM up WHERE raw_type = 'error'),
win AS (SELECT error_type, (t // 3600000000 - j) * 3600000000 AS window_start_us FROM err, range(6) r(j))
SELECT CAST(window_start_us AS BIGINT) AS window_start_us, error_type, count(*) AS n_errors FROM win
GROUP BY ALL HAVING count(*) >= 10
""")
def q_error_alerts(spark, sf):
    """T6 (batch twin): errors by type in 6-hour windows sliding by 1 hour, alert at >= 10."""
    d = R.validate_events(TD.upstream_events(spark, sf))
    errs = d.where(F.col("event.event_type") == "embedding.job.failed").select(
        F.col("event_ts").alias("ts"), F.col("event.metadata")["error_type"].alias("error_type"))
    a = SE.error_alerts(errs, "6 hours", "1 hour", 10)
    return a.select(F.unix_micros("window_start").alias("window_start_us"), "error_type", "n_errors")


@register("activity_sessions", """
WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
             OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000 THEN 1 ELSE 0 END AS brk
           FROM events),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, CAST(min(epoch_us(ts)) AS BIGINT) AS session_start_us,
       CAST(max(epoch_us(ts)) + 21600000000 AS BIGINT) AS session_end_us, count(*) AS n_events
FROM g GROUP BY user_id, sid
""")
def q_activity_sessions(spark, sf):
    """Activity sessions per user, idle after a 6-hour gap (session windows)."""
    ev = TD.table(spark, sf, "events").select("user_id", TD.ntz_as_utc("ts").alias("ts"))
    s = SE.activity_sessions(ev, "6 hours", key="user_id")
    return s.select("user_id", F.unix_micros("session_start").alias("session_start_us"),
                    F.unix_micros("session_end").alias("session_end_us"), "n_events")


@register("recommend_algorithm", """
SELECT 'event' AS embedding_type, CASE WHEN n < 100 THEN 'agglomerative' WHEN n < 10000 THEN 'hdbscan'
  ELSE 'kmeans' END AS algorithm FROM (SELECT count(*) AS n FROM embeddings e JOIN events v ON e.vec_id = v.event_id)
""")
def q_recommend_algorithm(spark, sf):
    """F16: algorithm recommended from the vector-set statistics."""
    from clusterloom.sources.vectors import vector_set_stats

    st = vector_set_stats(TD.vector_set(spark, sf))
    return st.select("embedding_type", R.recommend_algorithm(st).alias("algorithm"))


@register("cluster_keys", ITEMS + """
SELECT item_id, CASE WHEN domain = 'en' THEN 'event_cluster_' || CAST(truth_label AS VARCHAR) ELSE 'outlier' END
         AS member_cluster, CASE WHEN domain = 'en' THEN 'truth_event_cluster_' || CAST(truth_label AS VARCHAR) END
         AS cluster_id
FROM items
""")
def q_cluster_keys(spark, sf):
    """F17 over an F8-mapped labelling: member keys and cluster ids."""
    from clusterloom.operators import filters as FL

    it = TD.items(spark, sf)
    kept = FL.apply_metadata_filters(it, {"domain": "en"}).select("pos", F.col("truth_label").alias("label"))
    m = FL.map_back_labels(it, kept, id_col="pos", prob_col=None)
    return m.select("item_id", R.member_cluster_key(F.col("embedding_type"), F.col("label")).alias("member_cluster"),
                    F.when(F.col("label") >= 0, R.cluster_id(F.lit("truth"), F.col("embedding_type"), F.col("label")))
                    .alias("cluster_id"))


# --------------------------------------------------------------------------- F13, T10, T11, W2, W6

from clusterloom.operators import metrics as M  # noqa: E402
from clusterloom.operators import profiles as P  # noqa: E402
from clusterloom.plans.catalog import CENT, truth_assign  # noqa: E402


@register("quality_gate", ITEMS + CENT + """
SELECT i.truth_label AS label, count(*) AS size,
       count(*) >= 47 AND avg(list_cosine_similarity(i.embedding, c.centroid)) >= 0.14 AS passes
FROM items i JOIN cent c ON c.label = i.truth_label GROUP BY i.truth_label
""")
def q_quality_gate(spark, sf):
    """clusters with size >= 47 and average similarity >= 0.14 pass (limits that part these clusters)."""
    a = truth_assign(spark, sf)
    per, _ = M.intra_similarity(a)
    prof = M.centroids(a).select("label", "size").join(per.withColumnRenamed("intra_similarity", "cohesion"),
                                                       "label")
    return P.quality_gate(prof, 47, 0.14).select("label", "size", "passes")


@register("event_payload", JOBS_SQL + """
SELECT 'clustering.job.completed' AS event_type, job_id AS key,
       json_object('job_id', job_id, 'status', status, 'priority', priority) AS payload
FROM jobs WHERE status = 'completed'
""")
def q_event_payload(spark, sf):
    """Completion events of finished jobs with a JSON payload."""
    jobs = TD.jobs_table(spark, sf).where(F.col("status") == "completed")
    return SE.event_payload(jobs, "clustering.job.completed", ["job_id", "status", "priority"])


@register("retry_or_dead_letter", UP_SQL.format(min_k=10) + """
SELECT 'up_' || CAST(user_id AS VARCHAR) AS event_id, count(*) AS attempts,
       CASE WHEN count(*) >= 3 THEN 'dead_letter' ELSE 'retry' END AS route
FROM dec WHERE decision = 'invalid' GROUP BY user_id
""")
def q_retry_or_dead_letter(spark, sf):
    """Failed (invalid) deliveries per upstream job: retry until 3 attempts, then dead letter."""
    d = R.trigger_decision(R.validate_events(TD.upstream_events(spark, sf)))
    fails = d.where(F.col("decision") == "invalid").select(
        F.concat(F.lit("up_"), F.regexp_extract("payload", r'"job_id":"up_(\d+)"', 1)).alias("event_id"), "ts")
    return SE.retry_or_dead_letter(fails, 3).select("event_id", "attempts", "route")


CLUSTERS_SQL = ITEMS + """,
cl AS (SELECT 'truth_event_cluster_' || CAST(truth_label AS VARCHAR) AS cluster_id, count(*) AS size,
              'truth' AS job_id FROM items GROUP BY truth_label)
"""


def _clusters(spark, sf):
    from clusterloom.operators.rules import cluster_id

    c = M.centroids(truth_assign(spark, sf))
    return c.select(cluster_id(F.lit("truth"), F.lit("event"), F.col("label")).alias("cluster_id"),
                    "size", F.lit("truth").alias("job_id"), F.lit("event").alias("embedding_type"))


@register("list_clusters", CLUSTERS_SQL + """
SELECT cluster_id, size FROM cl ORDER BY size DESC, cluster_id LIMIT 3 OFFSET 3
""")
def q_list_clusters(spark, sf):
    """Second page (3 per page) of a job's clusters, largest first."""
    page, _ = J.list_clusters(_clusters(spark, sf), "event", "truth", limit=3, offset=3)
    return page.select("cluster_id", "size")


@register("sample_clusters", CLUSTERS_SQL + """
SELECT job_id, cluster_id, size, CAST(row_number() OVER (PARTITION BY job_id ORDER BY size DESC, cluster_id)
       AS INTEGER) AS sample_rank FROM cl QUALIFY sample_rank <= 5
""")
def q_sample_clusters(spark, sf):
    """Five largest clusters per job for the completion payload."""
    return J.sample_clusters(_clusters(spark, sf), 5).select("job_id", "cluster_id", "size", "sample_rank")
