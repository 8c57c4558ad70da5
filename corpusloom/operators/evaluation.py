"""Evaluation of retrieval and answers over many configurations, and tuning."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import facts as fx
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import reports
from corpusloom.operators import search as sx
from corpusloom.operators.access import attachments_of
from corpusloom.operators.matching import occurring
from corpusloom.operators.postings import Index, bm25_lists, build_index
from corpusloom.storage import exists, saved


def gold_map(files: DataFrame, ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """doc, space, raw_paths, articles of ``files(doc, space, sha256)``: what was ingested from a document, its
    attachments, and the articles made of them."""
    own = files.join(ledger.select("space", "sha256", "raw_path"), ["space", "sha256"]).select("doc", "space", "raw_path")
    child = own.join(attachments_of(ledger), "raw_path").select("doc", "space", F.col("child_raw").alias("raw_path"))
    raws = own.unionByName(child).distinct()
    made = raws.join(sources.select("raw_path", "article_path"), "raw_path", "left")
    out = made.groupBy("doc", "space").agg(F.array_sort(F.collect_set("raw_path")).alias("raw_paths"), F.array_sort(F.collect_set("article_path")).alias("articles"))
    empty = F.array().cast("array<string>")
    return files.select("doc", "space").distinct().join(out, ["doc", "space"], "left").withColumn("raw_paths", F.coalesce("raw_paths", empty)).withColumn("articles", F.coalesce("articles", empty))


def hit_docs(hits: DataFrame, sources: DataFrame, gold: DataFrame) -> DataFrame:
    """hits with ``docs``: the gold documents that a hit's sources come from."""
    of_raw = gold.select("doc", F.explode("raw_paths").alias("raw_path"))
    of_article = sources.select(F.col("article_path").alias("path"), "raw_path").join(of_raw, "raw_path").groupBy("path").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    return hits.join(of_article, "path", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))


def relevant_articles(qa: DataFrame, gold: DataFrame) -> DataFrame:
    """id, n_relevant: articles of a question's gold documents, or the number of those documents if there is none."""
    per = qa.select("id", F.explode("gold_docs").alias("doc")).join(gold.select("doc", "articles"), "doc", "left").groupBy("id").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("articles", F.array().cast("array<string>")))))).alias("n"))
    return qa.join(per, "id", "left").select("id", F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n")).otherwise(F.size("gold_docs")).alias("n_relevant"))


def retrieval_metrics(hd: DataFrame, qa: DataFrame, n_relevant: DataFrame, k: int, by: list[str] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """A row per question (and ``by``): recall, hit, hit1, mrr, ndcg, stale_top1, empty of ``hd(qid, path, rank, docs)``.

    ``settings`` has the configurations in the columns of ``by``; one that found nothing gets its rows of zeros.  Without
    it they are those that occur in ``hd``.
    """
    key = by or []
    ask = qa.select(F.col("id").alias("qid"), "gold_docs", "stale_docs").join(n_relevant.withColumnRenamed("id", "qid"), "qid")
    if key:  # the result has a row for each question and configuration
        ask = ask.crossJoin((hd if settings is None else settings).select(*key).distinct())
    rows = ask.join(hd, ["qid", *key], "left")
    found = F.array_intersect("docs", "gold_docs")
    rel, near = F.coalesce(F.size(found) > 0, F.lit(False)), F.col("rank") <= k
    rows = rows.withColumn("rel", rel).withColumn("found", found)
    stale = F.bool_or((F.col("rank") == 1) & ~F.col("rel") & (F.size(F.array_intersect("docs", "stale_docs")) > 0))
    parts = rows.groupBy("qid", *key).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(near & F.col("rel"), F.col("found")))))).alias("covered"), F.max(near & F.col("rel")).alias("hit"), F.max((F.col("rank") <= 1) & F.col("rel")).alias("hit1"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.array_sort(F.collect_list(F.when(near & F.col("rel"), F.col("rank")))).alias("ranks"), stale.alias("stale"),
        F.first(F.size("gold_docs")).alias("n_gold"), F.first(F.size("stale_docs")).alias("n_stale"), F.first("n_relevant").alias("n_relevant"), F.count("path").alias("n_hits"),
    )
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1 / (F.log2(r.cast("double") + 1)))
    n = F.least(F.lit(k), "n_relevant")
    ideal = F.when(n > 0, gain(F.sequence(F.lit(1), n))).otherwise(0.0)
    return parts.select(
        "qid", *key, F.when(F.col("n_gold") > 0, F.col("covered") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        F.coalesce("hit", F.lit(False)).cast("double").alias("hit"), F.coalesce("hit1", F.lit(False)).cast("double").alias("hit1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(ideal > 0, gain("ranks") / ideal).otherwise(0.0).alias("ndcg"), F.when(F.col("n_stale") > 0, F.coalesce("stale", F.lit(False))).alias("stale_top1"), (F.col("n_hits") == 0).alias("empty"),
    )


def recall_at_k(hd: DataFrame, qa: DataFrame, k: int) -> DataFrame:
    return _metric(hd, qa, k, "recall")


def hit_at_k(hd: DataFrame, qa: DataFrame, k: int) -> DataFrame:
    return _metric(hd, qa, k, "hit")


def mrr(hd: DataFrame, qa: DataFrame) -> DataFrame:
    return _metric(hd, qa, 1 << 30, "mrr")


def ndcg_at_k(hd: DataFrame, qa: DataFrame, k: int, n_relevant: DataFrame) -> DataFrame:
    return retrieval_metrics(hd, qa, n_relevant, k).select("qid", "ndcg")


def stale_top1(hd: DataFrame, qa: DataFrame) -> DataFrame:
    return _metric(hd, qa, 1, "stale_top1")


def _metric(hd: DataFrame, qa: DataFrame, k: int, name: str) -> DataFrame:
    n = qa.select("id", F.size("gold_docs").alias("n_relevant"))
    return retrieval_metrics(hd, qa, n, k).select("qid", name)


def answer_metrics(answers: DataFrame, qa: DataFrame, marker: str = "근거 없음") -> DataFrame:
    """qid, fact_recall, refused, correct of ``answers(qid, answer)``; without facts the recall is 1."""
    rows = qa.select(F.col("id").alias("qid"), "type", "gold_facts").join(answers.select("qid", "answer"), "qid").withColumn("norm", fx.fact_normalize("answer"))
    facts = rows.select("qid", "norm", F.explode("gold_facts").alias("fact")).withColumn("fact", fx.fact_normalize("fact"))
    per = facts.groupBy("qid").agg(F.avg(fx.contains_fact(F.col("fact"), F.col("norm")).cast("double")).alias("r"))
    rows = rows.join(per, "qid", "left").withColumn("fact_recall", F.coalesce("r", F.lit(1.0))).withColumn("refused", tx.is_refusal("answer", marker))
    correct = F.when(F.col("type").isin(*reports.REFUSAL), F.col("refused")).otherwise(~F.col("refused") & (F.col("fact_recall") == 1))
    return rows.select("qid", "fact_recall", "refused", correct.alias("correct"))


def fact_recall(answers: DataFrame, qa: DataFrame) -> DataFrame:
    return answer_metrics(answers, qa).select("qid", "fact_recall")


def answer_correct(answers: DataFrame, qa: DataFrame) -> DataFrame:
    return answer_metrics(answers, qa).select("qid", "correct")


def citation_accurate(citations: DataFrame, qa: DataFrame) -> DataFrame:
    """qid, citation_ok of ``citations(qid, docs)``: whether a cited article comes from a gold document."""
    per = citations.join(qa.select(F.col("id").alias("qid"), "gold_docs"), "qid").groupBy("qid").agg(F.bool_or(F.arrays_overlap("docs", "gold_docs")).alias("citation_ok"))
    return qa.select(F.col("id").alias("qid")).join(per, "qid", "left").select("qid", F.coalesce("citation_ok", F.lit(False)).alias("citation_ok"))


def foreign_facts(qa: DataFrame, readable_text: DataFrame) -> DataFrame:
    """space, fact, ambiguous of ``readable_text(space, text)``: facts of other spaces (declared ones from one character
    on, others' from three) that the space's own texts lack; those they hold are ambiguous if declared.

    All facts are one automaton, and each text is read once; a space's texts are never put together.
    """
    own = qa.select("space", F.explode("leak_facts").alias("fact"), F.lit(True).alias("declared"))
    homes = qa.select("space", F.explode(F.concat("gold_facts", "leak_facts")).alias("fact")).groupBy("fact").agg(F.collect_set("space").alias("homes"))
    spaces = qa.agg(F.collect_set("space").alias("spaces"))  # one row of all spaces
    others = F.when(F.size("homes") > 1, F.col("spaces")).otherwise(F.array_except("spaces", "homes"))
    far = homes.crossJoin(F.broadcast(spaces)).select(F.explode(others).alias("space"), "fact", F.lit(False).alias("declared"))
    facts = own.unionByName(far).groupBy("space", "fact").agg(F.max("declared").alias("declared")).withColumn("norm", fx.fact_normalize("fact"))
    facts = facts.where(F.length("norm") >= F.when(F.col("declared"), 1).otherwise(3))
    found = occurring(readable_text, facts.select(F.col("norm").alias("pattern")), ["space"], fx.fact_normalize("text"), whole_numbers=True)
    found = found.select("space", F.col("pattern").alias("norm"), F.lit(True).alias("in"))
    return facts.join(found, ["space", "norm"], "left").select("space", "fact", "declared", F.coalesce("in", F.lit(False)).alias("in")).where("not `in` or declared").select("space", "fact", F.col("in").alias("ambiguous"))


def detect_leaks(answers: DataFrame, hits: DataFrame, spaces: DataFrame, foreign: DataFrame) -> DataFrame:
    """qid, leak ARRAY of reasons: a hit outside the asker's space or without labels, a foreign fact in the answer or in
    a hit's text.  ``answers(qid, space, answer)``, ``hits(qid, path, body)``, ``spaces(path, spaces)``."""
    ask = answers.select("qid", "space", fx.fact_normalize("answer").alias("norm"))
    seen = hits.join(ask.select("qid", "space"), "qid").join(spaces, "path", "left")
    outside = seen.where(~F.coalesce((F.size("spaces") > 0) & F.forall("spaces", lambda s: s == F.col("space")), F.lit(False))).select("qid", F.concat(F.lit("outside: "), "path").alias("reason"))
    facts = foreign.where("not ambiguous").select("space", "fact").withColumn("pattern", fx.fact_normalize("fact"))
    read = ask.select("qid", "space", F.lit("answer: ").alias("where"), "norm").unionByName(seen.select("qid", "space", F.lit("text: ").alias("where"), fx.fact_normalize("body").alias("norm")))
    said = occurring(read, facts.select("pattern"), ["qid", "space", "where"], "norm", whole_numbers=True).join(facts, ["space", "pattern"]).select("qid", F.concat("where", "fact").alias("reason"))
    reasons = outside.unionByName(said).groupBy("qid").agg(F.array_sort(F.collect_set("reason")).alias("leak"))
    return answers.select("qid").join(reasons, "qid", "left").select("qid", F.coalesce("leak", F.array().cast("array<string>")).alias("leak"))


# --- sweeps -------------------------------------------------------------------------------------------------------

def sweep_scores(questions: DataFrame, docs: DataFrame, readable: DataFrame, configs: DataFrame, digits: int | None = None, index: Index | None = None) -> DataFrame:
    """hash, qid, path, score, rank: BM25 for every row of ``configs(hash, bm25_k1, bm25_b, top_k)`` in one job, over a
    saved index (of ``docs``, if none is given; of a larger one ``docs`` alone count)."""
    seen = readable if index is None else readable.join(docs.select("path"), "path", "left_semi")
    return bm25_lists(questions, index or build_index(docs), seen, configs, digits)


def _first_of(rows: DataFrame, most: int) -> DataFrame:
    """The first ``top_k`` rows of each (hash, qid) by score, then path, with ``rank`` from 1.

    The largest ``top_k`` is compared as a number first, so that each task cuts its rows before they are shuffled.
    """
    order = Window.partitionBy("hash", "qid").orderBy(F.desc("score"), "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).where("rank <= top_k")


def sweep_retrieval(questions: DataFrame, docs: DataFrame, readable: DataFrame, configs: DataFrame, qvecs: DataFrame, emb: DataFrame, digits: int | None = None, index: Index | None = None) -> DataFrame:
    """hash, qid, path, score, rank for every row of ``configs(hash, retrieval_mode, top_k, pool, rrf_k, w_bm25, w_dense,
    bm25_k1, bm25_b, min_cosine)``, each as ``search.retrieve`` gives it, in one job.

    One BM25 list is made for each different (bm25_k1, bm25_b) and one dense list for all: a least cosine and a pool cut a
    list at its end, so each configuration takes the first rows of a longer one.
    """
    ends = configs.agg(F.max("pool").alias("pool"), F.min(F.when(F.col("retrieval_mode") != "bm25", F.col("min_cosine"))).alias("low"), F.max("top_k").alias("most")).first()
    if ends.pool is None:
        return questions.limit(0).select(F.lit("").alias("hash"), "qid", F.lit("").alias("path"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    knobs = F.concat_ws("/", "bm25_k1", "bm25_b")
    lists = configs.where("retrieval_mode <> 'dense'").select(knobs.alias("hash"), "bm25_k1", "bm25_b").distinct().withColumn("top_k", F.lit(ends.pool))
    bm = sweep_scores(questions, docs, readable, lists, digits, index).withColumnRenamed("hash", "list")
    dn = sx.dense_topk(qvecs, emb, readable, 1.0 if ends.low is None else ends.low, ends.pool, digits)
    single = F.col("retrieval_mode") != "hybrid"
    part = lambda weight: F.when(single, F.col("score")).otherwise(F.col(weight).cast("double") / (F.col("rrf_k") + F.col("rank")))
    keep = ["hash", "qid", "path", "top_k"]
    near = configs.where("retrieval_mode <> 'dense'").withColumn("list", knobs).join(bm, "list").where("rank <= pool").select(*keep, part("w_bm25").alias("s"))
    far = configs.where("retrieval_mode <> 'bm25'").join(dn.withColumnRenamed("cos", "score"), F.col("score") > F.col("min_cosine")).where("rank <= pool").select(*keep, part("w_dense").alias("s"))
    total = F.sum("s")  # two terms at most
    both = near.unionByName(far).groupBy(*keep).agg((F.round(total, digits) if digits else total).alias("score"))
    return _first_of(both, int(ends.most)).drop("top_k")


def evaluate(hits: DataFrame, sources: DataFrame, gold: DataFrame, qa: DataFrame, k: int, by: list[str] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """A row per question and configuration (of ``settings``, also those without hits): the retrieval metrics with type,
    space and split."""
    metrics = retrieval_metrics(hit_docs(hits, sources, gold), qa, relevant_articles(qa, gold), k, by, settings)
    return metrics.join(qa.select(F.col("id").alias("qid"), "type", "space", "split"), "qid")


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """All combinations of the values, as configurations with hashes; equal ones once."""
    rows = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    return vx.canonical_config(spark.createDataFrame(rows))


def sample_grid(spark: SparkSession, space: dict[str, list], n: int, seed: int = 0) -> DataFrame:
    """n combinations drawn by index, so that the grid is never written out."""
    sizes = [len(v) for v in space.values()]
    total = 1
    for s in sizes:
        total *= s
    rows = []
    for i in random.Random(seed).sample(range(total), min(n, total)):
        row = {}
        for (name, values), s in zip(space.items(), sizes):
            i, at = divmod(i, s)
            row[name] = values[at]
        rows.append(row)
    return vx.canonical_config(spark.createDataFrame(rows))


def sweep(rows: DataFrame, by: str = "hash") -> DataFrame:
    """hash, score, rejected of evaluated rows (with ``leak``): a leak makes the score -1 and rejects."""
    scored = reports.objective(rows, by=[by]).join(rows.groupBy(by).agg(F.max(F.size("leak") > 0).alias("rejected")), by)
    return scored.select(by, F.when(F.col("rejected"), F.lit(-1.0)).otherwise(F.col("objective")).alias("score"), "rejected")


def neighbours(best: dict, space: dict[str, list | tuple], bounds: dict[str, tuple] | None = None) -> list[dict]:
    """Configurations one step from the best.

    Of a list of numbers: the adjacent values, midpoints to them, and past the list's edge a step as long as the last one,
    no further than ``bounds`` names for it (none without bounds).  Of a range (low, high): an eighth and a sixteenth of it
    to both sides, inside it.  Of other lists: all other values.
    """
    out = []
    for name, values in space.items():
        here = best[name]
        if isinstance(values, tuple):
            low, high = values
            reach = (high - low) / 8
            out += [best | {name: min(high, max(low, here + s * reach))} for s in (-1, -0.5, 0.5, 1)]
            continue
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            out += [best | {name: v} for v in values if v != here]
            continue
        whole = all(isinstance(v, int) for v in values)
        below, above = [v for v in values if v < here], [v for v in values if v > here]
        for near, far in ((below, above), (above, below)):
            if near:
                v = max(near) if near is below else min(near)
                mid = (v + here) / 2
                out += [best | {name: v}, best | {name: int(mid) if whole else mid}]
            elif far and bounds and name in bounds:  # past the edge
                low, high = bounds[name]
                v = min(high, max(low, 2 * here - (min(far) if near is below else max(far))))
                out.append(best | {name: int(v) if whole else v})
    return [c for i, c in enumerate(out) if c != best and c not in out[:i]]


def refine(best: dict, score: float, space: dict[str, list | tuple], evaluate_many, rounds: int = 2, bounds: dict[str, tuple] | None = None) -> tuple[dict, float]:
    """Hill climbing by tables of neighbours; ``evaluate_many(list of configs) -> list of scores`` is one sweep."""
    for _ in range(rounds):
        near = neighbours(best, space, bounds)
        scores = evaluate_many(near) if near else []
        if not scores or max(scores) <= score:
            break
        score = max(scores)
        best = near[scores.index(score)]
    return best, score


def refine_job(spark: SparkSession, log: str, start: dict, space: dict[str, list | tuple], score: Callable[[DataFrame], DataFrame], rounds: int = 10, bounds: dict[str, tuple] | None = None) -> DataFrame:
    """hash, score, cfg, trial of all trials: hill climbing whose rounds are rows of a trial log, best first.

    A round scores the configurations one step from the best of the log that the log does not hold yet: ``score`` makes
    ``(hash, score)`` of a table of configurations, one sweep.  A round without a better one is the last.  Everything is
    read from the log, so a driver that starts anew goes on where the one before ended, and repeats no trial.
    """
    schema = "hash string, score double, cfg map<string,string>, trial long"
    read = lambda: spark.read.schema(schema).json(log) if exists(spark, log) else spark.createDataFrame([], schema)
    order = (F.desc("score"), "trial", "hash")

    def run(configs: list[dict], number: int) -> int:
        asked = vx.canonical_config(spark.createDataFrame([{k: c[k] for k in space} for c in configs]))
        fresh = saved(resume_trials(asked, read()), "round")
        if not fresh.limit(1).count():
            return 0
        cfg = F.create_map(*(x for k in space for x in (F.lit(k), F.to_json(F.struct(F.col(k).alias("v"))))))
        fresh.join(score(fresh), "hash").select("hash", "score", cfg.alias("cfg"), F.lit(number).cast("long").alias("trial")).write.mode("append").json(log)
        return 1

    done = read().agg(F.max("trial").alias("n")).first().n
    if done is None:
        run([start], 0)
        done = 0
    for number in range(done + 1, done + 1 + rounds):
        best = read().orderBy(*order).first()
        here = {k: json.loads(v)["v"] for k, v in best.cfg.items()}
        if not run(neighbours(here, space, bounds), number) or read().orderBy(*order).first().hash == best.hash:
            break
    return read().orderBy(*order)


def resume_trials(configs: DataFrame, log: DataFrame) -> DataFrame:
    return configs.join(log.select("hash"), "hash", "left_anti")


def heldout_guard(config: str, used: DataFrame, force: bool = False) -> None:
    """Refuses a configuration that the held-out questions have already seen."""
    if not force and used.where(F.col("hash") == config).limit(1).count():
        raise ValueError(f"configuration {config} was evaluated on held-out questions before")


def used_heldout(configs: DataFrame, used: DataFrame) -> DataFrame:
    """The configurations that the held-out questions have already seen: those that ``heldout_guard`` refuses."""
    return configs.join(used.select("hash").distinct(), "hash", "left_semi")


def gap_table(rows: DataFrame, mode: str = "retrieval") -> DataFrame:
    """type, tune, heldout, gap."""
    score = reports.retrieval_score() if mode == "retrieval" else F.col("correct").cast("double")
    score = F.when(F.col("type").isin(*reports.REFUSAL) & (F.lit(mode) == "retrieval"), F.col("empty").cast("double")).otherwise(score)
    wide = rows.groupBy("type").pivot("split", ["tune", "heldout"]).agg(F.avg(score))
    return wide.withColumn("gap", F.col("tune") - F.col("heldout"))


def cached_calls(requests: DataFrame, cache: DataFrame, fn) -> tuple[DataFrame, DataFrame]:
    """(replies, new cache rows) of ``requests(id, key, prompt)``: each missing key is asked once by ``fn``
    (mapInPandas: key, prompt -> key, reply, latency_ms, error); errors are not cached."""
    hits = requests.join(cache.select("key", "reply", "latency_ms"), "key").select("id", "reply", F.col("latency_ms").alias("saved_ms"))
    misses = requests.join(cache.select("key"), "key", "left_anti")
    asked = misses.select("key", "prompt").dropDuplicates(["key"]).mapInPandas(fn, "key string, reply string, latency_ms double, error string")
    replies = hits.unionByName(misses.join(asked, "key").select("id", "reply", F.lit(0.0).alias("saved_ms")))
    return replies, asked.where("error is null").select("key", "reply", "latency_ms")


def compact_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.round(F.avg(c), 4).alias(c) for c in ("recall", "hit1", "mrr", "ndcg")), F.count(F.lit(1)).alias("n"))


def chosen_vs_default(chosen: DataFrame, default: DataFrame) -> DataFrame:
    """param, chosen, default where they differ, of two tables of one row."""
    long = lambda df, name: df.select(F.explode(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("param", name))
    return long(chosen, "chosen").join(long(default, "default"), "param", "full_outer").where(~F.col("chosen").eqNullSafe(F.col("default")))
