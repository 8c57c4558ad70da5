"""Aggregates over audit events, jobs, findings and trials; window-type operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordering import positions

ANSWERABLE = ("lookup", "numeric", "latest", "multi_doc", "paraphrase", "conflict")
REFUSAL = ("unanswerable", "cross_space")


def feedback_report(audit: DataFrame) -> DataFrame:
    """target, down, up; most votes against first."""
    rows = audit.where(F.col("action").isin("feedback_up", "feedback_down") & (F.col("target") != "-"))
    votes = rows.groupBy("target").agg(F.count_if(F.col("action") == "feedback_down").alias("down"), F.count_if(F.col("action") == "feedback_up").alias("up"))
    return votes.orderBy(F.desc("down"), "up", "target")


def gaps_report(audit: DataFrame, limit: int = 50) -> DataFrame:
    """n, question of queries without evidence, most frequent first."""
    rows = audit.where((F.col("action") == "query") & (F.col("detail") == "no-evidence")).select(F.trim("target").alias("question"))
    return rows.groupBy("question").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question").limit(limit).select("n", "question")


def usage_stats(audit: DataFrame) -> DataFrame:
    is_query = F.col("action") == "query"
    return audit.agg(
        F.count_if(is_query).alias("queries"), F.count_if(is_query & (F.col("detail") == "no-evidence")).alias("no_evidence"),
        F.count_distinct(F.when(is_query, F.col("user_id"))).alias("users"), F.count_if(F.col("action") == "feedback_up").alias("up"), F.count_if(F.col("action") == "feedback_down").alias("down"),
    )


def audit_entries(audit: DataFrame, user=None, limit: int = 1000) -> DataFrame:
    """The last rows by id, newest first."""
    return (audit.where(F.col("user_id") == user) if user is not None else audit).orderBy(F.desc("id")).limit(limit)


def audit_retention(audit: DataFrame, days: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one marker row with the number deleted); under 30 days is refused."""
    if days < 30:
        raise ValueError("retention is 30 days at least")
    old = F.col("ts") < now - F.make_interval(days=F.lit(days))
    marker = audit.where(old).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("audit_purge").alias("action"), F.col("deleted").cast("string").alias("detail"), now.alias("ts"))
    return audit.where(~F.coalesce(old, F.lit(False))), marker


def ingest_summary(results: DataFrame, sources: DataFrame, emb: DataFrame) -> DataFrame:
    """One row: counts by status, articles, embedded, documents without an article; ``ingest_failures`` has the failed ones."""
    counts = results.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "duplicate")))
    lost = results.where("status = 'done'").join(sources.select("raw_path"), "raw_path", "left_anti").agg(F.count(F.lit(1)).alias("without_article"))
    return counts.crossJoin(sources.agg(F.count_distinct("article_path").alias("articles"))).crossJoin(emb.agg(F.count_distinct("path").alias("embedded"))).crossJoin(lost)


def ingest_failures(results: DataFrame) -> DataFrame:
    """raw_path of what failed, a row each."""
    return results.where("status = 'failed'").select("raw_path")


def job_status(jobs: DataFrame, max_attempts: int = 3) -> DataFrame:
    return jobs.groupBy("status", (F.col("attempts") >= max_attempts).alias("exhausted")).agg(F.count(F.lit(1)).alias("n"))


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.distinct().groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def latency_stats(rows: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """by, p50, p95, mean; percentiles are nearest ranks, 0 without rows."""
    p = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {value})"), F.lit(0.0))
    return rows.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def retrieval_score() -> Column:
    return 0.5 * F.col("recall") + 0.3 * F.col("mrr") + 0.2 * F.col("ndcg")


def summarize(rows: DataFrame, mode: str = "retrieval") -> DataFrame:
    """A row per question type and one for all (type null)."""
    ans, ref = F.col("type").isin(*ANSWERABLE), F.col("type").isin(*REFUSAL)
    avg = lambda c, when, name: F.avg(F.when(when, c)).alias(name)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    out = [F.count(F.lit(1)).alias("n"), *(avg(F.col(c).cast("double"), ans, c) for c in ("recall", "hit", "hit1", "mrr", "ndcg")), avg(retrieval_score(), ans, "retrieval_score"), avg(flag("empty"), ref, "empty_rate")]
    if "stale_top1" in rows.columns:
        out.append(avg(F.col("stale_top1").cast("double"), ans, "stale_top1"))
    if mode == "answer":
        out += [avg(flag("correct"), ans, "correct"), avg(F.col("fact_recall"), ans, "fact_recall"), avg(flag("citation_ok"), ans, "citation_accuracy"), avg(flag("correct"), ref, "refusal_accuracy")]
    out += [F.expr("percentile_disc(0.5) within group (order by latency_ms)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95"), F.count_if(F.size("leak") > 0).alias("leaks")]
    base = rows.withColumn("_type", F.col("type"))
    return base.groupingSets([["_type"], []], "_type").agg(*out).withColumnRenamed("_type", "type")


def type_scores(rows: DataFrame, mode: str = "retrieval") -> DataFrame:
    """type, score: one headline number a type."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    score = flag("correct") if mode == "answer" else F.when(F.col("type").isin(*ANSWERABLE), retrieval_score()).otherwise(flag("empty"))
    return rows.groupBy("type").agg(F.avg(score).alias("score"))


def objective(rows: DataFrame, mode: str = "retrieval", by: list[str] | None = None) -> DataFrame:
    """0.7 of the answerable mean and 0.3 of the refusal mean; a missing group hands its weight over."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    a = F.avg(F.when(F.col("type").isin(*ANSWERABLE), flag("correct") if mode == "answer" else retrieval_score()))
    r = F.avg(F.when(F.col("type").isin(*REFUSAL), flag("correct") if mode == "answer" else flag("empty")))
    return rows.groupBy(*(by or [])).agg(F.coalesce(0.7 * a + 0.3 * r, a, r, F.lit(0.0)).alias("objective"))


def leak_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.size("leak") > 0).alias("leaks"))


def sensitivity(trials: DataFrame) -> DataFrame:
    """param, value, best, n over trials not rejected; parameters with one value are left out."""
    rows = trials.where(~F.coalesce("rejected", F.lit(False))).select("score", F.explode("cfg").alias("param", "value"))
    per = rows.groupBy("param", "value").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("param"))).where("k > 1").drop("k")


def dataset_counts(qa: DataFrame) -> DataFrame:
    """type, split, n by both, each, and overall (null: all)."""
    return qa.cube("type", "split").agg(F.count(F.lit(1)).alias("n"))


def thread_rollup(mails: DataFrame) -> DataFrame:
    """thread_key, n, first, last, participants of ``mails(thread_key, date, sender)``."""
    return mails.groupBy("thread_key").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.array_sort(F.collect_set("sender")).alias("participants"))


# --- window-type operators ----------------------------------------------------------------------------------------


def round_robin(jobs: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Jobs ``(id, space)`` with ``turn`` and ``position``, interleaved: the first of every space, then the second, …; spaces
    by first appearance.  A space of any size is numbered in many tasks; ``max_jobs`` keeps the first positions."""
    first = jobs.groupBy("space").agg(F.min("id").alias("first_id"))
    if max_jobs:  # no more than so many of a space can be among them
        turn = F.row_number().over(Window.partitionBy("space").orderBy("id")).cast("long")
        rows = jobs.withColumn("turn", turn).where(F.col("turn") <= max_jobs)
    else:
        rows = positions(jobs, ["space"], ["id"], "turn")
    rows = rows.join(first.withColumnRenamed("space", "_space"), F.col("space").eqNullSafe(F.col("_space"))).drop("_space")
    if max_jobs:
        rows = rows.orderBy("turn", "first_id").limit(max_jobs)
    return positions(rows, [], ["turn", "first_id"]).withColumn("turn", F.col("turn").cast("int")).orderBy("position")


def unique_paths(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new(id, base, space)`` with ``path``: the base, or with the space, or with the space and a number from 2 on.

    Rows of one base and space are numbered from what is taken already, so no two rows and no old path meet.
    """
    taken = existing.select("path").distinct()
    whole = new.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    whole = whole.join(taken.select(F.col("path").alias("base"), F.lit(True).alias("used")), "base", "left")
    plain = (F.col("nth") == 1) & F.col("used").isNull()
    out = whole.where(plain).select("id", F.col("base").alias("path"))
    rest = whole.where(~plain).withColumn("stem", F.concat_ws("-", "base", "space"))
    number = F.regexp_extract("path", r"^(.*)-(\d+)$", 2)
    used = taken.select(F.explode(F.array(F.struct(F.col("path").alias("stem"), F.lit(1).alias("k")), F.struct(F.regexp_extract("path", r"^(.*)-(\d{1,9})$", 1).alias("stem"), number.try_cast("int").alias("k")))).alias("x")).select("x.stem", "x.k").where("k is not null").groupBy("stem").agg(F.max("k").alias("top"))
    rest = rest.join(used, "stem", "left").withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("id")) + F.coalesce("top", F.lit(0)))
    return out.unionByName(rest.select("id", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", "k")).alias("path")))


def attachment_names(attachments: DataFrame) -> DataFrame:
    """``attachments(mail, pos, name)`` with ``unique_name``: repeated names (case does not count) get ``-2``, ``-3``, …

    A number that another attachment has literally is passed over: numbered names come after the largest such number.
    """
    low = F.lower("name")
    stem, ext = F.regexp_replace(low, r"\.[^.]*$", ""), F.regexp_extract(low, r"(\.[^.]*)$", 1)
    rows = attachments.withColumn("_low", low).withColumn("_nth", F.row_number().over(Window.partitionBy("mail", "_low").orderBy("pos")))
    literal = rows.select("mail", F.concat(F.regexp_extract(stem, r"^(.*)-(\d{1,6})$", 1), ext).alias("_low"), F.regexp_extract(stem, r"^(.*)-(\d{1,6})$", 2).try_cast("int").alias("k")).where("k is not null").groupBy("mail", "_low").agg(F.max("k").alias("_top"))
    rows = rows.join(literal, ["mail", "_low"], "left")
    k = F.col("_nth") + F.greatest(F.coalesce("_top", F.lit(1)) - 1, F.lit(0))
    numbered = F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("-"), k, F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return rows.withColumn("unique_name", F.when(F.col("_nth") == 1, F.col("name")).otherwise(numbered)).select(*attachments.columns, "unique_name")


def failure_streak(results: DataFrame, n: int = 5, by: list[str] | None = None) -> DataFrame:
    """``results(seq, failed)`` with ``streak`` (failures in a row so far) and ``stop`` (n are reached)."""
    key = by or []
    order = Window.partitionBy(*key).orderBy("seq")
    island = F.sum((~F.col("failed")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = results.withColumn("island", island)
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy(*key, "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", streak).withColumn("stop", F.col("streak") >= n)


def best_records(trials: DataFrame, n: int = 1) -> DataFrame:
    return trials.where(~F.coalesce("rejected", F.lit(False))).orderBy(F.desc("score"), "trial").limit(n)


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (removed, added)."""
    gone = old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti").withColumn("side", F.lit("removed"))
    return gone.unionByName(new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").withColumn("side", F.lit("added")))
