"""Streaming ingest, stateful folds (batch and stream forms) and running reports."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.functions import pii
from corpusloom.functions import text as tx
from corpusloom.sources import files as src
from corpusloom.sources.extract import EXTRACTORS, extracted
from corpusloom.storage import saved
from corpusloom.streaming import ledger as ledgers
from corpusloom.streaming import stateful

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, max_files: int = 500, clean: str | None = None, archive: str | None = None) -> DataFrame:
    """New files below a folder; at most ``max_files`` a batch (the rest wait), archived or deleted after it if asked."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
    if clean:
        reader = reader.option("cleanSource", clean)
        reader = reader.option("sourceArchiveDir", archive) if archive else reader
    return reader.load(root)


def prepare_batch(batch: DataFrame, root: str = "", mask: bool = True, extractors: Mapping[str, Callable] = EXTRACTORS) -> DataFrame:
    """path, part, parent, space, source_name, title, text, published, sha256, error of a batch of files ``(path, length,
    content)``: a row for each part of a file (a mail's body, then its attachments), with the file's hash; what is bad is a
    row with an error, never a failure."""
    rows = batch.select(src._relative(root, F.col("path")).alias("path") if root else F.col("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    parts = F.split("path", "/")
    space = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    name = F.element_at(parts, -1)
    error = F.when(~F.coalesce(tx.valid_space(space), F.lit(False)), "location").when(~tx.valid_filename(name), "bad-name").when(F.col("size") > src.MAX_BYTES, "too-large")
    rows = rows.withColumn("space", space).withColumn("bad", error)
    rows = extracted(rows.withColumn("content", F.when(F.col("bad").isNull(), F.col("content"))), extractors)
    error = F.coalesce("bad", "error", F.when(F.contains("text", F.lit("\x00")), "corrupt"))
    rows = rows.select("path", "part", "parent", "space", F.element_at(F.split("name", "/"), -1).alias("source_name"), "title", "text", F.to_date("published").alias("published"), "sha256", error.alias("error"))
    if mask:
        rows = rows.withColumn("text", pii.pii_mask("text")["text"]).withColumn("title", pii.mask_one_line("title")["text"]).withColumn("source_name", pii.mask_one_line("source_name")["text"])
    return rows


OUTCOME = "path string, part int, space string, title string, text string, published date, sha256 string, raw_path string, parent_raw string, status string, error string"


def ingest_batch(batch: DataFrame, number: int, root: str, ledger: str, names: str, out: str, today: str, mask: bool = True, extractors: Mapping[str, Callable] = EXTRACTORS) -> None:
    """Files to numbered records, each (space, file hash) once for ever.

    ``out/batch=…`` gets a row for each part with its outcome (done, duplicate, failed); ``ledger`` remembers files,
    ``names`` the names of records.  Both are read by the prefixes of the batch alone, and everything that the batch
    writes is replaced if it is repeated.
    """
    spark = batch.sparkSession
    files = batch.select(src._relative(root, F.col("path")).alias("path") if root else F.col("path"), F.col("length").alias("size"), "content")
    keys = saved(files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("space"), F.sha2("content", 256).alias("sha256"), ledgers.prefix(F.sha2("content", 256)).alias("prefix")), "batch-files")
    seen = ledgers.remembered(spark, ledger, "space string, sha256 string, raw_path string", keys, number)
    marked = ledgers.first_seen(keys, seen, ["space", "sha256"], "path").select("path", "duplicate")
    fresh = files.join(marked.where("not duplicate").select("path"), "path", "left_semi").withColumnRenamed("size", "length")
    parts = saved(prepare_batch(fresh, "", mask, extractors), "batch-parts")
    good = parts.where("error is null").withColumn("base", src.raw_base(today))
    held = good.select(ledgers.prefix(F.sha2(src.raw_root("base"), 256)).alias("prefix"))
    taken = ledgers.remembered(spark, names, "raw_path string, space string, sha256 string", held, number)
    records = saved(src.save_raw(good.select("title", "text", "source_name", "published", "space"), taken, today).drop("content"), "batch-records")
    # a record's name is made of what its content holds, so space and content tell records apart
    kept = records.select("raw_path", "space", F.col("sha256").alias("record"))
    placed = good.withColumn("record", F.sha2(src.raw_content(today), 256)).join(kept, ["space", "record"])
    mother = placed.where("part = 0").select("path", F.col("raw_path").alias("parent_raw"))
    placed = placed.join(mother, "path", "left").withColumn("parent_raw", F.when(F.col("part") > 0, F.col("parent_raw")))
    cols = [F.col(c.split()[0]) for c in OUTCOME.split(", ")]
    none = F.lit(None).cast("string")
    done = placed.withColumn("status", F.lit("done")).select(*cols)
    failed = parts.where("error is not null").withColumn("raw_path", none).withColumn("parent_raw", none).withColumn("status", F.lit("failed")).select(*cols)
    again = keys.join(marked.where("duplicate").select("path"), "path", "left_semi").select("path", F.lit(0).alias("part"), "space", none.alias("title"), none.alias("text"), F.lit(None).cast("date").alias("published"), "sha256", none.alias("raw_path"), none.alias("parent_raw"), F.lit("duplicate").alias("status"), none.alias("error"))
    done.unionByName(failed).unionByName(again).write.mode("overwrite").parquet(f"{out}/batch={number}")
    # what is remembered is read from what was written
    written = spark.read.schema(OUTCOME).parquet(f"{out}/batch={number}").where("status = 'done'")
    ledgers.remember(records.where("is_new").select("raw_path", "space", "sha256", ledgers.prefix(F.sha2(src.raw_root("raw_path"), 256)).alias("prefix")), names, number)
    ledgers.remember(written.where("part = 0").select("space", "sha256", "raw_path", ledgers.prefix("sha256").alias("prefix")), ledger, number)


def ingest_stream(stream: DataFrame, root: str, ledger: str, names: str, out: str, checkpoint: str, today: str, mask: bool = True, extractors: Mapping[str, Callable] = EXTRACTORS) -> StreamingQuery:
    """``ingest_batch`` over a stream of files ``(path, length, content)``: of a folder, or packed in tables."""
    take = lambda batch, number: ingest_batch(batch, number, root, ledger, names, out, today, mask, extractors)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(spark: SparkSession, root: str, ledger_path: str, out_path: str, checkpoint: str, mask: bool = True, max_files: int = 500, today: str | None = None) -> StreamingQuery:
    """Files below a folder to documents, as ``ingest_stream``; names are remembered beside the ledger."""
    today = today or datetime.date.today().isoformat()
    return ingest_stream(file_stream(spark, root, max_files), root, ledger_path, f"{ledger_path}-names", out_path, checkpoint, today, mask)


def dedup_stream(stream: DataFrame, horizon: str = "7 days", ts: str = "ts") -> DataFrame:
    """(space, sha256) once within a bounded horizon; for ever is the ledger of ``stream_ingest``."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["space", "sha256"])


def archive_outcome(results: DataFrame, path: str, batch: int = 0) -> None:
    """Outcome rows by status; masked originals leave a hash behind, not their content.  A batch has a folder of its own,
    which is replaced when the batch is repeated."""
    results.drop("content").write.mode("overwrite").partitionBy("status").parquet(f"{path}/batch={batch}")


# --- folds --------------------------------------------------------------------------------------------------------


def stable_files(obs: DataFrame, min_age: float = 0.0, locked_max: int = 60, forget: float | None = None) -> DataFrame:
    """path, status (ready, waiting, locked, given-up) at the last scan of ``obs(path, scan_ts, size, mtime_ns, locked)``.

    Ready: size and mtime as at the scan before and old enough (both only if ``min_age`` is positive).  A file that is
    locked with one signature for ``locked_max`` scans in a row is given up; another signature starts the count anew, and
    so does a scan that comes over ``forget`` seconds after the one before.
    """
    order = Window.partitionBy("path").orderBy("scan_ts")
    same = (F.lag("size").over(order) == F.col("size")) & (F.lag("mtime_ns").over(order) == F.col("mtime_ns"))
    if forget is not None:
        t = F.unix_micros(F.col("scan_ts").cast("timestamp"))
        same = same & (t - F.lag(t).over(order) <= round(forget * 1e6))
    run = F.sum((~F.coalesce(same & F.lag("locked").over(order) & F.col("locked"), F.lit(False))).cast("int")).over(order)
    rows = obs.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("run", run)
    rows = rows.withColumn("locks", F.count_if("locked").over(Window.partitionBy("path", "run").orderBy("scan_ts").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("scan_ts")))).where("last = 1")
    age = F.unix_micros(F.col("scan_ts").cast("timestamp")) / 1e6 - F.col("mtime_ns") / 1e9
    ready = F.lit(True) if min_age <= 0 else F.col("same") & (age >= min_age)
    status = F.when(F.col("locked") & (F.col("locks") >= locked_max), "given-up").when(F.col("locked"), "locked").when(ready, "ready").otherwise("waiting")
    return rows.select("path", status.alias("status"))


def retry_ledger(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """path, status, attempts from the log ``attempts(path, seq, outcome)``; outcome: enqueued, ok, error, locked, duplicate.

    Locked and duplicate outcomes are no attempts; a file that is enqueued after it was done (or exhausted) is new.
    """
    order = Window.partitionBy("path").orderBy("seq")
    before = F.last(F.when(F.col("outcome").isin("ok", "duplicate"), F.lit(True)).when(F.col("outcome") == "error", F.lit(False)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = (F.col("outcome") == "enqueued") & F.coalesce(before, F.lit(False))
    rows = attempts.withColumn("life", F.sum(again.cast("int")).over(order))
    last = rows.groupBy("path").agg(F.max("life").alias("life"))
    now = rows.join(last, ["path", "life"]).groupBy("path").agg(F.count_if(F.col("outcome") == "error").alias("attempts"), F.max_by("outcome", F.when(F.col("outcome") != "locked", F.col("seq"))).alias("o"))
    status = F.when(F.col("o").isin("ok", "duplicate"), "done").when(F.col("attempts") >= max_attempts, "exhausted").when(F.col("o") == "error", "failed").otherwise("new")
    return now.select("path", status.alias("status"), "attempts")


def _fold_sorted(rows: DataFrame, key: list[str], order: list, step: Callable, name: str) -> DataFrame:
    """``rows`` with the column ``name``: what ``step(t, state) -> (state, value)`` gives for each row of a key in order.

    State is None at a key's first row and carried from batch to batch, so a key of any size takes the memory of one batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for batch in batches:
            out = []
            for k, t in zip(batch.column("fold_key").to_pylist(), batch.column("t").to_pylist()):
                if k != last:
                    last, state = k, None
                state, value = step(t, state)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    keyed = rows.withColumn("fold_key", F.to_json(F.struct(*key))).repartition("fold_key").sortWithinPartitions("fold_key", *order)
    return keyed.mapInArrow(run, StructType([*keyed.schema.fields, StructField(name, LongType())])).drop("fold_key")


COALESCED = ("login_failed", "read_denied")


def coalesce_repeats(audit: DataFrame, actions: tuple[str, ...] = COALESCED, window: float = 60.0, forget: float | None = None) -> DataFrame:
    """id, repeats of the events that are kept of ``audit(id, ts, user_id, action, target)``.

    A repeat of one (user, action, target) within ``window`` seconds of the kept event is suppressed; the next kept one
    reports how many were, if it comes within ``forget`` seconds of the kept one before.  Other actions are all kept.
    """
    def step(t: int | None, state: tuple | None) -> tuple[tuple, int | None]:
        since, hidden = state or (None, 0)
        if since is not None and t is not None and t - since < window * 1e6:
            return (since, hidden + 1), None
        known = since is not None and t is not None and (forget is None or t - since <= forget * 1e6)
        return (t, 0), hidden if known or forget is None else 0

    some = audit.where(F.col("action").isin(*actions)).select("user_id", "action", "target", F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    some = _fold_sorted(some, ["user_id", "action", "target"], [F.col("t").asc_nulls_last(), "id"], step, "repeats").where("repeats is not null").select("id", "repeats")
    return audit.where(~F.col("action").isin(*actions)).select("id", F.lit(0).cast("long").alias("repeats")).unionByName(some)


def coalesced_audit(audit: DataFrame, actions: tuple[str, ...] = COALESCED, window: float = 60.0, forget: float | None = None) -> DataFrame:
    """id, ts, user_id, action, target, detail, repeats of the rows that are kept: strings cut (and compared as cut), the
    number of suppressed repeats at the end of the detail."""
    rows = stateful.audit_rows(audit)
    kept = coalesce_repeats(rows, actions, window, forget)
    return rows.join(kept, "id").withColumn("detail", stateful.noted()).select(*rows.columns, "repeats")


def coalesce_repeats_stream(audit: DataFrame, window: float = 60.0, forget: float = stateful.FORGET, delay: str = "10 minutes") -> DataFrame:
    """id, repeats as a stream of the coalesced actions: see ``stateful.coalesced_audit_stream``."""
    audit = audit if "detail" in audit.columns else audit.withColumn("detail", F.lit(""))
    return stateful.coalesced_audit_stream(audit.where(F.col("action").isin(*COALESCED)), COALESCED, window, forget, delay).select("id", "repeats")


def sessionize(events: DataFrame, idle: int = 1800, absolute: int | None = 28800) -> DataFrame:
    """user, session, start, end, n of ``events(user_id, ts)``: a session ends after ``idle`` seconds without an event,
    or when an event comes more than ``absolute`` seconds after its start."""
    events = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    order = Window.partitionBy("user_id").orderBy("ts")
    t = F.unix_micros("ts") / 1e6
    gap = F.coalesce((t - F.lag(t).over(order) > idle).cast("int"), F.lit(1))
    rows = events.select("user_id", "ts", t.alias("t"), gap.alias("gap")).withColumn("run", F.sum("gap").over(order))
    if absolute is None:
        parts = rows.withColumn("part", F.lit(0))
    else:
        long_runs = rows.groupBy("user_id", "run").agg((F.max("t") - F.min("t") > absolute).alias("long"))
        rows = rows.join(long_runs, ["user_id", "run"])

        def step(t: float, state: tuple | None) -> tuple[tuple, int]:
            start, part = state or (t, 0)
            if t - start > absolute:
                start, part = t, part + 1
            return (start, part), part

        cut = _fold_sorted(rows.where("long").select("user_id", "ts", "t", "run"), ["user_id", "run"], ["t"], step, "part")
        parts = rows.where("not long").select("user_id", "ts", "t", "run", F.lit(0).cast("long").alias("part")).unionByName(cut)
    per = parts.groupBy("user_id", "run", "part").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("start"))
    return per.select("user_id", number.alias("session"), "start", "end", "n")


def sessionize_stream(events: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Idle sessions of a stream."""
    w = F.session_window("ts", idle)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def audit_stream(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by action and outcome in event-time windows; run in update mode it is the running report."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "action").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("detail") == "no-evidence").alias("no_evidence"))


COUNTERS = ("queries", "no_evidence", "up", "down")


def report_rows(audit: DataFrame) -> DataFrame:
    """report, key, counters: what an audit row adds to the usage, its user, its target's votes and its question's gaps."""
    action, hit = F.col("action"), lambda c: c.cast("long")
    query, none = action == "query", (action == "query") & (F.col("detail") == "no-evidence")
    up, down = action == "feedback_up", action == "feedback_down"
    entry = lambda when, report, key: F.when(when, F.struct(F.lit(report).alias("report"), key.cast("string").alias("key")))
    entries = F.array(entry(query | up | down, "usage", F.lit("")), entry(query, "user", F.col("user_id")), entry((up | down) & (F.col("target") != "-"), "vote", F.col("target")), entry(none, "gap", F.trim("target")))
    rows = audit.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"), hit(query).alias("queries"), hit(none).alias("no_evidence"), hit(up).alias("up"), hit(down).alias("down"))
    return rows.select("e.*", *COUNTERS)


def running_reports(audit: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Totals of ``report_rows`` as a stream in update mode: a batch writes the keys that it changed with their new totals, in
    a folder of its own that is replaced if the batch is repeated; of a key the row of the latest batch holds."""

    def upsert(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={number}")

    totals = report_rows(audit).groupBy("report", "key").agg(*(F.sum(c).alias(c) for c in COUNTERS))
    return totals.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(spark: SparkSession, root: str) -> DataFrame:
    """report, key, counters as of the last batch."""
    schema = "report string, key string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", batch long"
    rows = spark.read.schema(schema).option("basePath", root).parquet(root)
    return rows.groupBy("report", "key").agg(F.max_by(F.struct(*COUNTERS), "batch").alias("t")).select("report", "key", "t.*")


def running_feedback(totals: DataFrame) -> DataFrame:
    """A1's rows of running totals."""
    return totals.where("report = 'vote'").select(F.col("key").alias("target"), "down", "up").orderBy(F.desc("down"), "up", "target")


def running_gaps(totals: DataFrame, limit: int = 50) -> DataFrame:
    """A2's rows."""
    return totals.where("report = 'gap'").select(F.col("no_evidence").alias("n"), F.col("key").alias("question")).orderBy(F.desc("n"), "question").limit(limit)


def running_usage(totals: DataFrame) -> DataFrame:
    """A3's row."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("report") == "usage", F.col(c))), F.lit(0)).alias(c)
    return totals.agg(of("queries"), of("no_evidence"), F.count_if((F.col("report") == "user") & F.col("key").isNotNull()).alias("users"), of("up"), of("down"))


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
