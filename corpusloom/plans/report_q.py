"""Queries of reports and folds over the audit log (the events), trials and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import reports as rx
from corpusloom.plans.tables import AUDIT_SQL, audit, table
from corpusloom.streaming import jobs as sj


def a1(spark, d):
    return rx.feedback_report(audit(spark, d)).select("target", "down", "up")


A1 = f"WITH {AUDIT_SQL} SELECT target, count(*) FILTER (WHERE action = 'feedback_down') AS down, count(*) FILTER (WHERE action = 'feedback_up') AS up FROM audit WHERE action IN ('feedback_up', 'feedback_down') AND target <> '-' GROUP BY 1"


def a2(spark, d):
    return rx.gaps_report(audit(spark, d), 20)


A2 = f"WITH {AUDIT_SQL} SELECT count(*) AS n, trim(target) AS question FROM audit WHERE action = 'query' AND detail = 'no-evidence' GROUP BY 2 ORDER BY 1 DESC, 2 LIMIT 20"


def a3(spark, d):
    return rx.usage_stats(audit(spark, d))


A3 = f"""WITH {AUDIT_SQL} SELECT count(*) FILTER (WHERE action = 'query') AS queries, count(*) FILTER (WHERE action = 'query' AND detail = 'no-evidence') AS no_evidence,
count(DISTINCT CASE WHEN action = 'query' THEN user_id END) AS users, count(*) FILTER (WHERE action = 'feedback_up') AS up, count(*) FILTER (WHERE action = 'feedback_down') AS down FROM audit"""


def a4(spark, d):
    return rx.audit_entries(audit(spark, d).where("action = 'query'"), limit=1000).select("id", "user_id", "target")


A4 = f"WITH {AUDIT_SQL} SELECT id, user_id, target FROM audit WHERE action = 'query' ORDER BY id DESC LIMIT 1000"


def a5(spark, d):
    kept, marker = rx.audit_retention(audit(spark, d), 30, F.to_timestamp(F.lit("2024-02-10 12:00:00")))
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(marker.select("detail"))


A5 = "SELECT count(*) FILTER (WHERE NOT ts < TIMESTAMP '2024-01-11 12:00:00') AS kept, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-11 12:00:00') AS VARCHAR) AS detail FROM events"


def a6(spark, d):
    """Orders as ingest results, their lines as sources."""
    o = table(spark, d, "orders")
    results = o.select(F.col("o_orderkey").alias("raw_path"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("duplicate").alias("status"))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("raw_path"), F.col("l_suppkey").alias("article_path"))
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"))
    failures = rx.ingest_failures(results).agg(F.count(F.lit(1)).alias("failures"))
    out = rx.ingest_summary(results, edges, emb).crossJoin(failures)
    return out.select("done", "failed", "duplicate", "failures", "articles", "embedded", "without_article")


A6 = """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS failed, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) AS duplicate,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS failures, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS articles, (SELECT count(DISTINCT vec_id) FROM embeddings) AS embedded,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_article"""


def a7(spark, d):
    jobs = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("attempts"))
    return rx.job_status(jobs, 3)


A7 = "SELECT l_linestatus AS status, l_linenumber >= 3 AS exhausted, count(*) AS n FROM lineitem GROUP BY 1, 2"


def a9(spark, d):
    return rx.latency_stats(audit(spark, d).select("action", F.col("value").alias("latency_ms")), ["action"]).select("action", "p50", "p95", F.round("mean", 6).alias("mean"))


A9 = f"WITH {AUDIT_SQL} SELECT action, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM audit GROUP BY 1"


def a14(spark, d):
    """Lines as trials: shipping flags and status as parameters, quantity as score."""
    li = table(spark, d, "lineitem")
    trials = li.select(F.col("l_extendedprice").alias("score"), (F.col("l_linenumber") == 7).alias("rejected"), F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus", F.lit("one"), F.lit("x")).alias("cfg"))
    return rx.sensitivity(trials)


A14 = """WITH t AS (SELECT l_extendedprice AS score, l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_linenumber <> 7)
SELECT 'flag' AS param, f AS value, max(score) AS best, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'status', s, max(score), count(*) FROM t GROUP BY 2"""


def a15(spark, d):
    return rx.dataset_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("split")))


A15 = "SELECT o_orderpriority AS type, o_orderstatus AS split, count(*) AS n FROM orders GROUP BY CUBE (1, 2)"


def a16(spark, d):
    c = table(spark, d, "conversations")
    out = rx.thread_rollup(c.select(F.col("conv_id").alias("thread_key"), F.col("turn").alias("date"), F.col("role").alias("sender")))
    return out.select("thread_key", "n", "first", "last", F.array_join("participants", ",").alias("participants"))


A16 = "SELECT conv_id AS thread_key, count(*) AS n, min(turn) AS first, max(turn) AS last, string_agg(DISTINCT role, ',' ORDER BY role) AS participants FROM conversations GROUP BY 1"


def w5(spark, d):
    trials = table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "P").alias("rejected"))
    return rx.best_records(trials, 25).select("trial", "score")


W5 = "SELECT o_orderkey AS trial, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'P' ORDER BY 2 DESC, 1 LIMIT 25"


def t4(spark, d):
    """Events as scans of users' files: whether the last two look alike."""
    e = table(spark, d, "events")
    obs = e.select(F.col("user_id").alias("path"), F.col("ts").alias("scan_ts"), (F.col("event_id") % 3).alias("size"), F.lit(0).cast("long").alias("mtime_ns"), (F.col("event_type") == "error").alias("locked"))
    return sj.stable_files(obs, 1.0, 2)


T4 = """WITH o AS (SELECT user_id, ts, event_id % 3 AS size, event_type = 'error' AS locked, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events),
l AS (SELECT a.user_id, a.locked, a.size = b.size AS same, a.locked AND b.locked AND a.size = b.size AS twice FROM o a LEFT JOIN o b ON b.user_id = a.user_id AND b.r = 2 WHERE a.r = 1)
SELECT user_id AS path, CASE WHEN locked AND coalesce(twice, false) THEN 'given-up' WHEN locked THEN 'locked' WHEN coalesce(same, false) THEN 'ready' ELSE 'waiting' END AS status FROM l"""


def t5(spark, d):
    """Events as attempts of a file: signup puts it in, purchase succeeds, error and view fail, click finds it locked."""
    outcome = F.create_map(*(F.lit(x) for x in ("signup", "enqueued", "purchase", "ok", "error", "error", "view", "error", "click", "locked")))
    log = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), outcome[F.col("event_type")].alias("outcome"))
    return sj.retry_ledger(log)


T5 = """WITH e AS (SELECT user_id AS path, event_id AS seq, CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'locked' ELSE 'error' END AS o FROM events),
b AS (SELECT *, (SELECT x.o FROM e x WHERE x.path = e.path AND x.seq < e.seq AND x.o IN ('ok', 'error') ORDER BY x.seq DESC LIMIT 1) AS before FROM e WHERE o = 'enqueued'),
l AS (SELECT path, max(seq) AS since FROM b WHERE before = 'ok' GROUP BY 1),
n AS (SELECT e.path, e.seq, e.o FROM e LEFT JOIN l ON l.path = e.path WHERE l.since IS NULL OR e.seq >= l.since),
g AS (SELECT path, count(*) FILTER (WHERE o = 'error') AS attempts, arg_max(o, seq) FILTER (WHERE o <> 'locked') AS last FROM n GROUP BY 1)
SELECT path, CASE WHEN last = 'ok' THEN 'done' WHEN attempts >= 3 THEN 'exhausted' WHEN last = 'error' THEN 'failed' ELSE 'new' END AS status, attempts FROM g"""


def t7(spark, d):
    return sj.sessionize(table(spark, d, "events").select("user_id", "ts"), 6 * 3600, None).select("user_id", F.col("session").cast("long").alias("session"), "n")


T7 = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 21600 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n FROM r GROUP BY 1, 2"""


def t7_cap(spark, d):
    """Sessions that also end ten hours after their start."""
    return sj.sessionize(table(spark, d, "events").select("user_id", "ts"), 6 * 3600, 10 * 3600).select("user_id", "session", "n")


T7_CAP = """WITH RECURSIVE o AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
s(user_id, k, t, start, session) AS (SELECT user_id, k, t, t, 1 FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, o.t, CASE WHEN o.t - s.t > 21600 OR o.t - s.start > 36000 THEN o.t ELSE s.start END, CASE WHEN o.t - s.t > 21600 OR o.t - s.start > 36000 THEN session + 1 ELSE session END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, CAST(session AS INT) AS session, count(*) AS n FROM s GROUP BY 1, 2"""

QUERIES = {
    "a1_feedback_report": (a1, A1), "a2_gaps_report": (a2, A2), "a3_usage_stats": (a3, A3), "a4_audit_entries": (a4, A4), "a5_audit_retention": (a5, A5), "a6_ingest_summary": (a6, A6), "a7_job_status": (a7, A7),
    "a9_latency_stats": (a9, A9), "a14_sensitivity": (a14, A14), "a15_dataset_counts": (a15, A15), "a16_thread_rollup": (a16, A16), "w5_best_records": (w5, W5), "t4_stable_files": (t4, T4), "t5_retry_ledger": (t5, T5),
    "t7_sessionize": (t7, T7), "t7_sessionize_capped": (t7_cap, T7_CAP),
}
