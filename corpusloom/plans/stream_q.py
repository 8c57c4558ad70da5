"""Streams over the given tables, cut into files that arrive one after another, with late rows and a restart between."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.tables import AUDIT_SQL, audit, scratch, table
from corpusloom.sources.extract import extracted
from corpusloom.streaming import admission
from corpusloom.streaming import jobs as sj
from corpusloom.streaming import ledger as ledgers
from corpusloom.streaming import stateful as st

DAY = 86_400_000_000


def arrivals(rows, path, slices, late):
    """Writes ``rows(ts, …)`` as ``slices`` files by time, rows of ``late`` one file too late; yields after each."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = rows.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    step = ((ends.hi or 0) - (ends.lo or 0)) // slices + 1
    at = F.least(F.floor((t - F.lit(ends.lo or 0)) / step) + F.when(late, 1).otherwise(0), F.lit(slices - 1))
    for i in range(slices):
        rows.where(at == i).coalesce(1).write.mode("append").parquet(path)
        yield i


def append_run(df, out, state):
    """Runs an appending stream over the files that are there now."""
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def in_slices(spark, rows, beat, make, name, slices=6, late=None, restarts=(2, 5)):
    """What ``make(stream)`` appends over all files, started anew after the slices of ``restarts``; ``beat`` comes last and
    moves the clock past all rows."""
    path, out, state = scratch(spark, f"{name}-in"), scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    df = None
    for i in arrivals(rows, path, slices, F.lit(False) if late is None else late):
        if i == slices - 1:
            beat.coalesce(1).write.mode("append").parquet(path)
        if i in restarts:
            df = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
            append_run(df, out, state)
    return spark.read.schema(df.schema).parquet(out)


def _long_targets(spark, d):
    """Audit rows whose targets differ in their first 200 characters by one digit at most."""
    long = F.concat(F.repeat(F.lit("x"), F.lit(199)), F.col("target"))
    return audit(spark, d).select("id", "ts", "user_id", "action", long.alias("target"), F.concat(F.lit("from "), F.repeat(F.col("target"), F.lit(300))).alias("detail"))


WINDOW, FORGET = 3.0 * 86_400, 5.0 * 86_400


def t6(spark, d):
    """Refused logins and reads, one in three days of each user and target; what is kept says how many it stands for."""
    out = sj.coalesced_audit(_long_targets(spark, d), window=WINDOW, forget=FORGET)
    return out.select("id", "user_id", "action", "target", "detail", "repeats")


T6 = f"""WITH RECURSIVE {AUDIT_SQL}, a AS (SELECT id, ts, user_id, action, left(repeat('x', 199) || target, 200) AS target, left('from ' || repeat(target, 300), 500) AS detail FROM audit),
o AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, action, target ORDER BY ts, id) AS k FROM a WHERE action IN ('login_failed', 'read_denied')),
s AS (SELECT *, t AS since, 0 AS hidden, 0 AS kept FROM o WHERE k = 1
UNION ALL SELECT o.*, CASE WHEN o.t - since < {3 * DAY} THEN since ELSE o.t END, CASE WHEN o.t - since < {3 * DAY} THEN hidden + 1 ELSE 0 END, CASE WHEN o.t - since < {3 * DAY} THEN NULL WHEN o.t - since > {5 * DAY} THEN 0 ELSE hidden END
FROM s JOIN o ON o.user_id = s.user_id AND o.action = s.action AND o.target = s.target AND o.k = s.k + 1)
SELECT id, user_id, action, target, CASE WHEN kept > 0 THEN detail || ' repeats_suppressed=' || kept ELSE detail END AS detail, CAST(kept AS BIGINT) AS repeats FROM s WHERE kept IS NOT NULL
UNION ALL SELECT id, user_id, action, target, detail, 0 FROM a WHERE action NOT IN ('login_failed', 'read_denied')"""


def t6_stream(spark, d):
    """The same over a stream of six files with late rows, started three times: state, timers and expiry."""
    rows = _long_targets(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 20 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("login_failed").alias("action"), F.lit("").alias("target"), F.lit("").alias("detail"))
    make = lambda s: st.coalesced_audit_stream(s, sj.COALESCED, WINDOW, FORGET, "6 days")
    out = in_slices(spark, rows, beat, make, "repeats", late=F.col("id") % 5 == 0)
    return out.where("id >= 0").select("id", "user_id", "action", "target", "detail", "repeats")


def _scans(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("size"), F.lit(0).cast("long").alias("mtime_ns"), (F.col("event_type") == "error").alias("locked"), "event_id")


def t4_stream(spark, d):
    """Events as scans of users' files, as a stream of six files with late rows: the status of every scan."""
    rows = _scans(spark, d)
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 20 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("path"), "ts", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(False).alias("locked"), F.lit(-1).cast("long").alias("event_id"))
    make = lambda s: st.stable_files_stream(s.withColumnRenamed("ts", "scan_ts"), 1.0, 2, 86_400.0, "6 days")
    out = in_slices(spark, rows, beat, make, "scans", late=F.col("event_id") % 5 == 0, restarts=(3, 5))
    return out.where("path >= 0").select("path", F.unix_micros("scan_ts").alias("at"), "status")


T4_STREAM = f"""WITH o AS (SELECT user_id, epoch_us(ts) AS t, event_id % 3 AS size, event_type = 'error' AS locked FROM events),
l AS (SELECT *, coalesce(size = lag(size) OVER w AND t - lag(t) OVER w <= {DAY}, false) AS same, coalesce(lag(locked) OVER w, false) AS was FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(CASE WHEN same AND was AND locked THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM l)
SELECT user_id AS path, t AS at, CASE WHEN locked AND count(*) FILTER (WHERE locked) OVER (PARTITION BY user_id, run ORDER BY t) >= 2 THEN 'given-up' WHEN locked THEN 'locked' WHEN same THEN 'ready' ELSE 'waiting' END AS status FROM r"""

TODAY = "2026-09-30"


def _replay(spark, state, batch):
    """Takes back that a batch was finished, as if the driver had been lost before it said so."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/{batch}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


def t1(spark, d):
    """Documents as files of their sources, packed, arriving in three batches of which the last runs twice: records with
    numbers, each file once for ever."""
    k = F.col("doc_id")
    content = F.concat(F.lit("# Note "), F.coalesce("lang", F.lit("xx")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary")
    rows = table(spark, d, "documents").select(F.concat("source", F.lit("/doc-"), k, F.lit(".md")).alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"), (k % 3).alias("slice"))
    path, state, ledger, names, out = (scratch(spark, f"ingest-{x}") for x in ("in", "state", "ledger", "names", "out"))
    stream = lambda: spark.readStream.schema("path string, length long, content binary").option("maxFilesPerTrigger", 1).parquet(path)
    run = lambda: sj.ingest_stream(stream(), "", ledger, names, out, state, TODAY, mask=False).awaitTermination()
    for i in range(3):
        rows.where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
        run()
    _replay(spark, state, 2)
    run()
    return spark.read.schema(f"{sj.OUTCOME}, batch long").option("basePath", out).parquet(out).select("path", "space", "title", "status", "raw_path", F.col("batch"))


T1 = f"""WITH d AS (SELECT doc_id % 3 AS batch, source, coalesce(lang, 'xx') AS lang, source || '/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id || '.md' AS name, '# Note ' || coalesce(lang, 'xx') || chr(10) || coalesce(text, '') AS c FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY source, sha256(c) ORDER BY batch, path) AS nth,
sha256('# Note ' || lang || chr(10) || chr(10) || '> Source: ' || name || chr(10) || '> Collected: {TODAY}' || chr(10) || '> Published: Unknown' || chr(10) || chr(10) || regexp_replace(c, '[\\s\\x0B\\x1C-\\x1F]+$', '') || chr(10)) AS record FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY batch, record) AS n FROM f WHERE nth = 1)
SELECT path, source AS space, 'Note ' || lang AS title, 'done' AS status, 'raw/' || source || '/{TODAY}-note-' || lang || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS raw_path, batch FROM n
UNION ALL SELECT path, source, NULL, 'duplicate', NULL, batch FROM f WHERE nth > 1"""


def t2(spark, d):
    """Documents that arrive at once, a fifth let in each turn, their sources taking turns."""
    docs = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("source").alias("space"), "text")
    path, state, root, out = (scratch(spark, f"admit-{x}") for x in ("in", "state", "backlog", "out"))
    docs.write.parquet(path)
    n = -(-docs.count() // 5) or 1
    take = lambda rows, turn: rows.select("path", "space", F.length("text").alias("size"), F.lit(turn).alias("turn")).write.mode("overwrite").parquet(f"{out}/t={turn}")
    admission.admitted_stream(spark.readStream.schema(docs.schema).parquet(path), root, n, take, state).awaitTermination()
    admission.drain(spark, root, n, take)
    return spark.read.parquet(out).select("path", "space", "size", "turn")


T2 = """WITH q AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, source AS space, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS number, (count(*) OVER () + 4) // 5 AS n FROM documents)
SELECT path, space, CAST(size AS INT) AS size, CAST((row_number() OVER (ORDER BY number, path, space) - 1) // n AS INT) AS turn FROM q"""


def t3_ever(spark, d):
    """Contents of events, once for ever: a ledger of three batches, of which the second runs twice."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("space"), F.sha2("props", 256).alias("sha256"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("raw_path"), (F.col("event_id") % 3).alias("batch"))
    ledger, out = scratch(spark, "ever-ledger"), scratch(spark, "ever-out")
    for i in (0, 1, 1, 2):
        batch = rows.where(F.col("batch") == i).drop("batch").withColumn("prefix", ledgers.prefix("sha256"))
        seen = ledgers.remembered(spark, ledger, "space string, sha256 string, raw_path string", batch, i)
        marked = ledgers.first_seen(batch, seen, ["space", "sha256"], "raw_path")
        marked.write.mode("overwrite").parquet(f"{out}/batch={i}")
        ledgers.remember(spark.read.parquet(f"{out}/batch={i}").where("not duplicate").select("space", "sha256", "raw_path", "prefix"), ledger, i)
    return spark.read.option("basePath", out).parquet(out).select("raw_path", "space", "duplicate")


T3_EVER = "SELECT lpad(event_id::VARCHAR, 12, '0') AS raw_path, event_type AS space, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id % 3, event_id) > 1 AS duplicate FROM events"


def s4(spark, d):
    """Turns of conversations as mails with an attachment (every fifth has one that nobody reads, every seventh is lost)."""
    c = F.col
    b64 = lambda x: F.base64(F.coalesce(x, F.lit("")).cast("binary"))
    part = lambda head, body: F.concat(F.lit("--B\r\nContent-Transfer-Encoding: base64\r\n" + head + "\r\n\r\n"), body, F.lit("\r\n"))
    attached = part('Content-Type: text/plain; charset=utf-8\r\nContent-Disposition: attachment; filename="note.txt"', b64(F.concat(F.lit("# Role "), "role", F.lit("\n"), F.coalesce("text", F.lit("")))))
    other = F.when((c("conv_id") + c("turn")) % 5 == 0, part('Content-Type: application/x-msdownload\r\nContent-Disposition: attachment; filename="note.exe"', F.lit("AAAA"))).otherwise("")
    mail = F.concat(F.lit("From: "), "role", F.lit("@example.org\r\nSubject: Conv "), "conv_id", F.lit("\r\nDate: Thu, 01 Jan 2026 10:00:00 +0000\r\nMessage-ID: <"), "turn", F.lit("@c>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"), part("Content-Type: text/plain; charset=utf-8", b64(c("text"))), attached, other, F.lit("--B--\r\n"))
    files = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", F.concat("turn", F.lit(".eml"))).alias("path"), F.when((c("conv_id") + c("turn")) % 7 != 0, mail.cast("binary")).alias("content"))
    out = extracted(files)
    return out.select("path", "part", "parent", F.when(c("part") > 0, c("name")).alias("name"), "title", F.sha2("text", 256).alias("text_sha"), "published", c("headers")["message-id"].alias("message_id"), "error")


S4 = r"""WITH c AS (SELECT conv_id || '/' || turn || '.eml' AS path, conv_id AS conv, turn, role, coalesce(text, '') AS t, (conv_id + turn) % 7 = 0 AS lost, (conv_id + turn) % 5 = 0 AS odd FROM conversations)
SELECT path, 0 AS part, CAST(NULL AS INT) AS parent, NULL AS name, 'Conv ' || conv AS title, sha256(regexp_replace(t, '^[\s-]+|[\s-]+$', '', 'g')) AS text_sha, '2026-01-01' AS published, '<' || turn || '@c>' AS message_id, CASE WHEN trim(t) = '' THEN 'empty' END AS error FROM c WHERE NOT lost
UNION ALL SELECT path, 1, 0, 'note.txt', 'Role ' || role, sha256(regexp_replace('# Role ' || role || chr(10) || t, '[\s-]+$', '')), NULL, NULL, NULL FROM c WHERE NOT lost
UNION ALL SELECT path, 2, 0, 'note.exe', NULL, NULL, NULL, NULL, 'unsupported' FROM c WHERE NOT lost AND odd
UNION ALL SELECT path, 0, NULL, NULL, NULL, NULL, NULL, NULL, 'no-content' FROM c WHERE lost"""

def t9_running(spark, d):
    """Votes, gaps and usage of the audit log as running totals over six files, started three times."""
    rows = audit(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path, root, state = (scratch(spark, f"reports-{x}") for x in ("in", "out", "state"))
    for i in arrivals(rows, path, 6, F.lit(False)):
        if i in (1, 3, 5):
            sj.running_reports(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), root, state).awaitTermination()
    _replay(spark, state, 5)
    sj.running_reports(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), root, state).awaitTermination()
    t = sj.running_totals(spark, root)
    none = F.lit(None).cast("string")
    a = sj.running_feedback(t).select(F.lit("A1").alias("report"), F.col("target").alias("key"), "down", "up", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("users"))
    b = sj.running_gaps(t, 20).select(F.lit("A2").alias("report"), F.col("question").alias("key"), F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("up"), "n", F.lit(0).cast("long").alias("users"))
    c = sj.running_usage(t).select(F.lit("A3").alias("report"), none.alias("key"), "down", "up", (F.col("queries") * 1_000_000 + F.col("no_evidence")).alias("n"), "users")
    return a.unionByName(b).unionByName(c)


T9_RUNNING = f"""WITH {AUDIT_SQL}, a2 AS (SELECT count(*) AS n, trim(target) AS question FROM audit WHERE action = 'query' AND detail = 'no-evidence' GROUP BY 2 ORDER BY 1 DESC, 2 LIMIT 20)
SELECT 'A1' AS report, target AS key, count(*) FILTER (WHERE action = 'feedback_down') AS down, count(*) FILTER (WHERE action = 'feedback_up') AS up, 0 AS n, 0 AS users FROM audit WHERE action IN ('feedback_up', 'feedback_down') AND target <> '-' GROUP BY 2
UNION ALL SELECT 'A2', question, 0, 0, n, 0 FROM a2
UNION ALL SELECT 'A3', NULL, count(*) FILTER (WHERE action = 'feedback_down'), count(*) FILTER (WHERE action = 'feedback_up'), count(*) FILTER (WHERE action = 'query') * 1000000 + count(*) FILTER (WHERE action = 'query' AND detail = 'no-evidence'), count(DISTINCT CASE WHEN action = 'query' THEN user_id END) FROM audit"""

QUERIES = {"t9_running_reports": (t9_running, T9_RUNNING), "t1_stream_ingest": (t1, T1), "t2_admission": (t2, T2), "t3_once_for_ever": (t3_ever, T3_EVER), "s4_mail_parts": (s4, S4), "t6_coalesce_repeats": (t6, T6), "t6_coalesce_stream": (t6_stream, T6), "t4_stable_stream": (t4_stream, T4_STREAM)}
