"""Queries of evaluation: questions are the benchmark's, hits their best documents, gold the documents that hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators.postings import bm25_topk
from corpusloom.operators import evaluation as ex
from corpusloom.operators import reports as rx
from corpusloom.operators import search as sx
from corpusloom.plans.search_q import STATS, _bm25
from corpusloom.plans.tables import docs, index, questions, readable, table

K = 5


def _hits(spark, d):
    """The five best documents of a question, as (qid, path, rank, docs): an article's document is itself."""
    found = bm25_topk(questions(spark, d), index(spark, d), readable(spark, d), K, digits=6)
    return found.select("qid", F.col("path").cast("string").alias("path"), "rank", F.array(F.col("path").cast("string")).alias("docs"))


def _qa(spark, d):
    """Gold: two documents by number, one of them stale for every third question; types and splits by number."""
    i = F.col("item_id")
    gold = F.when(i % 8 == 7, F.array().cast("array<string>")).otherwise(F.array((i * 7 % 200).cast("string"), (i * 11 % 200).cast("string")))
    types = F.array(*map(F.lit, ("lookup", "numeric", "latest", "multi_doc", "paraphrase", "conflict", "cross_space", "unanswerable")))
    return table(spark, d, "benchmark").select(
        i.alias("id"), F.lit("en").alias("space"), F.get(types, (i % 8).cast("int")).alias("type"), F.array_distinct(gold).alias("gold_docs"),
        F.when(i % 3 == 0, F.array((i * 5 % 200).cast("string"))).otherwise(F.array().cast("array<string>")).alias("stale_docs"), F.when(i % 10 < 7, "tune").otherwise("heldout").alias("split"),
        F.array(F.substring("text", 1, 12), F.lit("zzz")).alias("gold_facts"), F.array().cast("array<string>").alias("leak_facts"), F.col("text").alias("question"),
    )


_TYPES_SQL = "['lookup','numeric','latest','multi_doc','paraphrase','conflict','cross_space','unanswerable']"

#: x: the graded questions of two BM25 settings, before their metrics.
GRADED_SQL = f"""{STATS}, c AS (SELECT unnest([0.9, 1.5])::DOUBLE AS k1), w AS (SELECT k1, qid, path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * dl / avgdl)) AS w FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (path), n, c),
bm AS (SELECT k1, qid, path, round(sum(w), 6) AS score FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k1, qid ORDER BY score DESC, CAST(path AS BIGINT)) AS rank FROM bm WHERE score > 0),
qa AS (SELECT item_id AS qid, CASE WHEN item_id % 8 = 7 THEN [] ELSE list_distinct([item_id * 7 % 20, item_id * 11 % 20]) END AS gold, {_TYPES_SQL}[item_id % 8 + 1] AS type, CASE WHEN item_id % 10 < 7 THEN 'tune' ELSE 'heldout' END AS split FROM benchmark),
a AS (SELECT doc_id // 50 AS doc, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1), g AS (SELECT qid, unnest(gold) AS doc FROM qa), nr AS (SELECT qid, sum(n) AS n FROM g JOIN a USING (doc) GROUP BY 1),
h AS (SELECT k1, qid, rank, path // 50 AS doc, list_contains(gold, path // 50) AS rel FROM r JOIN qa USING (qid) WHERE rank <= {K}),
m AS (SELECT k1, qid, count(DISTINCT doc) FILTER (WHERE rel) AS covered, min(rank) FILTER (WHERE rel) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel), 0) AS dcg FROM h GROUP BY 1, 2),
x AS (SELECT c.k1, qa.*, covered, first, dcg, m.qid IS NULL AS empty, least({K}, coalesce(nr.n, len(gold))) AS best FROM qa CROSS JOIN c LEFT JOIN m ON m.qid = qa.qid AND m.k1 = c.k1 LEFT JOIN nr ON nr.qid = qa.qid)"""


def _graded(spark, d):
    """Sources, gold documents and questions: every fifty documents are the articles of one gold document, two by two from
    one raw file."""
    k = F.col("doc_id")
    raw = F.floor(k / 2).cast("string")
    made = table(spark, d, "documents").select(F.floor(k / 50).cast("string").alias("doc"), k.cast("string").alias("article_path"), raw.alias("raw_path"))
    gold = made.groupBy("doc").agg(F.array_sort(F.collect_set("raw_path")).alias("raw_paths"), F.array_sort(F.collect_set("article_path")).alias("articles"))
    i = F.col("id")
    qa = _qa(spark, d).withColumn("gold_docs", F.when(F.size("gold_docs") > 0, F.array_distinct(F.array((i * 7 % 20).cast("string"), (i * 11 % 20).cast("string")))).otherwise(F.col("gold_docs")))
    return made.select("article_path", "raw_path"), gold, qa


def _swept(spark, d, cfg):
    return ex.sweep_scores(questions(spark, d), docs(spark, d), readable(spark, d), cfg, 6, index(spark, d)).withColumn("path", F.col("path").cast("string"))


def _evaluated(spark, d, cfg):
    return ex.evaluate(_swept(spark, d, cfg), *_graded(spark, d), K, ["hash"], cfg)


def _rows(spark, d):
    """Evaluated questions of two BM25 settings: right is a first hit that is gold (nothing found, where nothing is to be
    found); a first hit in another language than the asker's leaks."""
    cfg = ex.grid(spark, {"retrieval_mode": ["bm25"], "bm25_k1": [0.9, 1.5], "bm25_b": [0.75], "top_k": [K]})
    hits = _swept(spark, d, cfg)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.length("text").cast("double").alias("latency_ms"))
    first = hits.where("rank = 1").join(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang"), "path").select("hash", "qid", "lang")
    rows = ex.evaluate(hits, *_graded(spark, d), K, ["hash"], cfg).join(first, ["hash", "qid"], "left").join(asked, "qid")
    outside = F.coalesce(F.col("lang") != F.when(F.col("qid") % 2 == 0, "en").otherwise("fr"), F.lit(False))
    correct = F.when(F.col("type").isin(*rx.REFUSAL), F.col("empty")).otherwise(F.col("hit1") == 1)
    rows = rows.withColumn("leak", F.when(outside, F.array(F.lit("outside"))).otherwise(F.array().cast("array<string>"))).withColumn("correct", correct)
    return rows.join(cfg.select("hash", F.col("bm25_k1").cast("string").alias("k1")), "hash").drop("hash", "lang").withColumnRenamed("k1", "hash")


_ROWS_SQL = f"""{GRADED_SQL}, top AS (SELECT k1, qid, lang FROM r JOIN documents ON doc_id = path WHERE rank = 1),
rows AS (SELECT x.qid AS k, type, split, CASE WHEN len(gold) > 0 THEN coalesce(covered, 0) / len(gold) ELSE 0 END AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr,
CASE WHEN best > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(best AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, empty, CASE WHEN type IN ('cross_space', 'unanswerable') THEN empty ELSE coalesce(first = 1, false) END AS correct,
coalesce(lang <> CASE WHEN x.qid % 2 = 0 THEN 'en' ELSE 'fr' END, false) AS leak, CAST(x.k1 AS VARCHAR) AS hash FROM x LEFT JOIN top ON top.k1 = x.k1 AND top.qid = x.qid), s AS (SELECT *, type NOT IN ('cross_space', 'unanswerable') AS ans, 0.5 * recall + 0.3 * mrr + 0.2 * ndcg AS rs, CASE WHEN empty THEN 1.0 ELSE 0.0 END AS em FROM rows)"""


def _r(df, *cols):
    return df.select(*[c for c in df.columns if c not in cols], *(F.round(c, 6).alias(c) for c in cols))


def e3(spark, d):
    """Recall, hits, reciprocal ranks, gain and stale first hits of each question."""
    qa = _qa(spark, d)
    out = ex.retrieval_metrics(_hits(spark, d), qa, qa.select("id", F.greatest(F.size("gold_docs"), F.lit(0)).alias("n_relevant")), K)
    return _r(out.select("qid", "recall", "hit", "hit1", "mrr", "ndcg", F.coalesce(F.col("stale_top1").cast("int"), F.lit(-1)).alias("stale"), "empty"), "recall", "mrr", "ndcg")


_QA_SQL = """qa AS (SELECT item_id AS qid, CASE WHEN item_id % 8 = 7 THEN [] ELSE list_distinct([item_id * 7 % 200, item_id * 11 % 200]) END AS gold, CASE WHEN item_id % 3 = 0 THEN item_id * 5 % 200 END AS st FROM benchmark)"""
E3 = f"""WITH {STATS}, {_bm25()}, {_QA_SQL}, h AS (SELECT qid, path, rank, list_contains(gold, path) AS rel, path = st AS stale FROM r JOIN qa USING (qid) WHERE rank <= {K}),
m AS (SELECT qid, count(*) FILTER (WHERE rel) AS covered, min(rank) FILTER (WHERE rel) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel), 0) AS dcg, bool_or(rank = 1 AND NOT rel AND stale) AS s FROM h GROUP BY 1)
SELECT qa.qid, round(CASE WHEN len(gold) > 0 THEN coalesce(covered, 0) / len(gold) ELSE 0 END, 6) AS recall, CASE WHEN covered > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit1, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr,
round(CASE WHEN len(gold) = 0 THEN 0 ELSE coalesce(dcg, 0) / (CASE WHEN len(gold) = 1 THEN 1 ELSE 1 + 1 / log2(3) END) END, 6) AS ndcg, CASE WHEN st IS NULL THEN -1 WHEN s THEN 1 ELSE 0 END AS stale, m.qid IS NULL AS empty FROM qa LEFT JOIN m USING (qid)"""


def e7(spark, d):
    """Answers that quote their question: facts found and missing, refusals."""
    i = F.col("id")
    answers = _qa(spark, d).select(i.alias("qid"), F.when(i % 4 == 0, "근거 없음").when(i % 4 == 1, F.concat("question", F.lit(" zzz"))).otherwise(F.col("question")).alias("answer"))
    return ex.answer_metrics(answers, _qa(spark, d))


E7 = """SELECT item_id AS qid, CASE WHEN item_id % 4 = 0 THEN 0.0 WHEN item_id % 4 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS fact_recall, item_id % 4 = 0 AS refused,
CASE WHEN item_id % 8 IN (6, 7) THEN item_id % 4 = 0 ELSE item_id % 4 = 1 END AS correct FROM benchmark"""


def e8(spark, d):
    cited = _hits(spark, d).where("rank <= 2").select("qid", "docs")
    return ex.citation_accurate(cited, _qa(spark, d))


E8 = f"WITH {STATS}, {_bm25()}, {_QA_SQL} SELECT qa.qid, coalesce(bool_or(list_contains(gold, path)), false) AS citation_ok FROM qa LEFT JOIN r ON r.qid = qa.qid AND rank <= 2 GROUP BY 1"


def e9(spark, d):
    """Ten documents each, of several languages: the first is an asker's answer in its language, all are its hits."""
    t = table(spark, d, "documents").select("doc_id", "lang", "text", F.floor(F.col("doc_id") / 10).alias("g"))
    first = t.groupBy("g").agg(F.min("doc_id").alias("qid"))
    answers = first.join(t.drop("g"), F.col("qid") == F.col("doc_id")).select("qid", F.col("lang").alias("space"), F.col("text").alias("answer"))
    hits = t.join(first, "g").select("qid", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    spaces = t.select(F.col("doc_id").cast("string").alias("path"), F.array("lang").alias("spaces"))
    foreign = spark.createDataFrame([("en", "of the", False), ("fr", "de la", False), ("de", "und", True)], "space string, fact string, ambiguous boolean")
    out = ex.detect_leaks(answers, hits, spaces, foreign)
    return out.select("qid", F.array_join("leak", "|").alias("leak"))


E9 = """WITH t AS (SELECT doc_id, lang, regexp_replace(lower(text), '\\s+', '', 'g') AS x, min(doc_id) OVER (PARTITION BY doc_id // 10) AS q FROM documents), a AS (SELECT * FROM t WHERE doc_id = q),
f AS (SELECT 'en' AS lang, 'of the' AS fact, 'ofthe' AS x UNION ALL SELECT 'fr', 'de la', 'dela'),
l AS (SELECT a.q, 'outside: ' || t.doc_id AS r FROM a JOIN t ON t.q = a.q WHERE t.lang <> a.lang UNION SELECT a.q, 'answer: ' || fact FROM a JOIN f ON f.lang = a.lang AND contains(a.x, f.x) UNION SELECT a.q, 'text: ' || fact FROM a JOIN t ON t.q = a.q JOIN f ON f.lang = a.lang AND contains(t.x, f.x))
SELECT a.q AS qid, coalesce(string_agg(r, '|' ORDER BY r), '') AS leak FROM a LEFT JOIN l ON l.q = a.q GROUP BY 1"""


def e10(spark, d):
    """Facts of each language's questions that another language's documents hold or lack."""
    b = table(spark, d, "benchmark")
    i = F.col("item_id")
    space = F.when(i % 2 == 0, "en").otherwise("fr")
    words = F.regexp_extract("text", r"([A-Za-z]{3,})", 1)
    qa = b.select(i.alias("id"), space.alias("space"), F.array(words).alias("gold_facts"), F.when(i % 5 == 0, F.array(F.lit("the"))).otherwise(F.array().cast("array<string>")).alias("leak_facts"))
    return ex.foreign_facts(qa.where(words != ""), docs(spark, d).select("space", "text"))


E10 = """WITH b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS space, regexp_extract(text, '([A-Za-z]{3,})', 1) AS w FROM benchmark WHERE regexp_extract(text, '([A-Za-z]{3,})', 1) <> ''),
o AS (SELECT space, w AS fact FROM b UNION SELECT space, 'the' FROM b WHERE item_id % 5 = 0), sp AS (SELECT DISTINCT space FROM b),
f AS (SELECT space, fact, max(decl) AS decl FROM (SELECT space, 'the' AS fact, true AS decl FROM b WHERE item_id % 5 = 0 UNION ALL SELECT sp.space, fact, false FROM o JOIN sp ON sp.space <> o.space) GROUP BY 1, 2),
x AS (SELECT f.*, EXISTS (SELECT 1 FROM documents WHERE lang = f.space AND contains(regexp_replace(lower(text), '\\s+', '', 'g'), lower(fact))) AS found FROM f) SELECT space, fact, found AS ambiguous FROM x WHERE NOT found OR decl"""


def e12(spark, d):
    """Four BM25 settings over all questions in one job: the best document of each."""
    cfg = ex.grid(spark, {"retrieval_mode": ["bm25"], "bm25_k1": [0.9, 1.5], "bm25_b": [0.4, 0.75], "top_k": [1], "rrf_k": [30, 60]})
    out = ex.sweep_scores(questions(spark, d), docs(spark, d), readable(spark, d), cfg, 6, index(spark, d))
    named = out.join(cfg.select("hash", "bm25_k1", "bm25_b"), "hash")
    return named.select("bm25_k1", "bm25_b", "qid", "path", "score")


E12 = f"""WITH {STATS}, c AS (SELECT unnest([0.9, 1.5])::DOUBLE AS k1), c2 AS (SELECT k1, unnest([0.4, 0.75])::DOUBLE AS b FROM c),
w AS (SELECT k1, b, qid, path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) AS w FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (path), n, c2),
s AS (SELECT k1, b, qid, path, round(sum(w), 6) AS score FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY score DESC, path) AS rank FROM s) SELECT k1 AS bm25_k1, b AS bm25_b, qid, path, score FROM r WHERE rank = 1"""


def e12_objective(spark, d):
    return _r(ex.sweep(_rows(spark, d)), "score")


E12_OBJECTIVE = f"WITH {_ROWS_SQL} SELECT hash, bool_or(leak) AS rejected, round(CASE WHEN bool_or(leak) THEN -1.0 ELSE 0.7 * avg(rs) FILTER (WHERE ans) + 0.3 * avg(em) FILTER (WHERE NOT ans) END, 6)::DOUBLE AS score FROM s GROUP BY 1"


def e14(spark, d):
    configs = table(spark, d, "orders").select(vx.config_hash(["o_orderkey", "o_custkey"]).alias("hash"), "o_orderkey")
    log = table(spark, d, "orders").where("o_orderstatus = 'F'").select(vx.config_hash(["o_orderkey", "o_custkey"]).alias("hash"))
    return ex.resume_trials(configs, log).select("o_orderkey")


E14 = "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"


def e16(spark, d):
    return _r(ex.gap_table(_rows(spark, d)), "tune", "heldout", "gap")


E16 = f"""WITH {_ROWS_SQL}, gg AS (SELECT type, avg(CASE WHEN ans THEN rs ELSE em END) FILTER (WHERE split = 'tune') AS t, avg(CASE WHEN ans THEN rs ELSE em END) FILTER (WHERE split = 'heldout') AS h FROM s GROUP BY 1)
SELECT type, round(t, 6)::DOUBLE AS tune, round(h, 6)::DOUBLE AS heldout, round(t - h, 6)::DOUBLE AS gap FROM gg"""


def e17(spark, d):
    """Documents as requests by content: half the contents are cached, the others are asked once each."""
    import pandas as pd

    def ask(parts):
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "reply": p["prompt"].str.len().astype(str), "latency_ms": 1.0, "error": None})

    reqs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("key"), F.col("text").alias("prompt"))
    cache = reqs.where(F.substring("key", 1, 1) < "8").select("key", F.lit("cached").alias("reply"), F.lit(5.0).alias("latency_ms")).distinct()
    return ex.cached_calls(reqs, cache, ask)[0].select("id", "reply", "saved_ms")


E17 = "SELECT doc_id AS id, CASE WHEN left(sha256(text), 1) < '8' THEN 'cached' ELSE CAST(length(text) AS VARCHAR) END AS reply, CASE WHEN left(sha256(text), 1) < '8' THEN 5.0 ELSE 0.0 END::DOUBLE AS saved_ms FROM documents"


def a10(spark, d):
    out = rx.summarize(_rows(spark, d)).select(F.coalesce("type", F.lit("all")).alias("type"), "n", "recall", "mrr", "retrieval_score", "empty_rate", "leaks")
    return _r(out, "recall", "mrr", "retrieval_score", "empty_rate")


A10 = f"""WITH {_ROWS_SQL} SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg(recall) FILTER (WHERE ans), 6)::DOUBLE AS recall, round(avg(mrr) FILTER (WHERE ans), 6)::DOUBLE AS mrr, round(avg(rs) FILTER (WHERE ans), 6)::DOUBLE AS retrieval_score,
round(avg(em) FILTER (WHERE NOT ans), 6)::DOUBLE AS empty_rate, count(*) FILTER (WHERE leak) AS leaks FROM s GROUP BY GROUPING SETS ((type), ())"""


def a11(spark, d):
    return _r(rx.type_scores(_rows(spark, d), "answer"), "score")


A11 = f"WITH {_ROWS_SQL} SELECT type, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS score FROM s GROUP BY 1"


def a12(spark, d):
    return _r(rx.objective(_rows(spark, d), "answer", ["split"]), "objective")


A12 = f"WITH {_ROWS_SQL}, cc AS (SELECT split, ans, CASE WHEN correct THEN 1.0 ELSE 0.0 END AS c FROM s) SELECT split, round(0.7 * avg(c) FILTER (WHERE ans) + 0.3 * avg(c) FILTER (WHERE NOT ans), 6)::DOUBLE AS objective FROM cc GROUP BY 1"


def e18(spark, d):
    return ex.compact_metrics(_rows(spark, d), ["hash"]).select("hash", "n", F.round("recall", 3).alias("recall"), F.round("mrr", 3).alias("mrr"))


E18 = f"WITH {_ROWS_SQL} SELECT hash, count(*) AS n, round(round(avg(recall), 4), 3)::DOUBLE AS recall, round(round(avg(mrr), 4), 3)::DOUBLE AS mrr FROM s GROUP BY 1"

QUERIES = {
    "e3_retrieval_metrics": (e3, E3), "e7_answer_metrics": (e7, E7), "e8_citation_accurate": (e8, E8), "e9_detect_leaks": (e9, E9), "e10_foreign_facts": (e10, E10), "e12_sweep_scores": (e12, E12), "e12_sweep_objective": (e12_objective, E12_OBJECTIVE),
    "e14_resume_trials": (e14, E14), "e16_gap_table": (e16, E16), "e17_cached_calls": (e17, E17), "e18_compact_metrics": (e18, E18), "a10_summarize": (a10, A10), "a11_type_scores": (a11, A11), "a12_objective": (a12, A12),
}
