"""Queries from end to end: evaluation and sweeps, decisions, files written and read back, streams over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import decisions as dx
from corpusloom.operators import evaluation as ex
from corpusloom.plans.eval_q import GRADED_SQL, K, _evaluated, _r
from corpusloom.plans.search_q import _DENSE, STATS, _qvecs, _seen, _vectors
from corpusloom.plans.tables import docs, index, questions, readable, scratch, table
from corpusloom.sources import files as src
from corpusloom.streaming import jobs as sj

_TYPES_SQL = "['lookup','numeric','latest','multi_doc','paraphrase','conflict','cross_space','unanswerable']"


def e11(spark, d):
    """Two BM25 settings, retrieved and graded."""
    cfg = ex.grid(spark, {"retrieval_mode": ["bm25"], "bm25_k1": [0.9, 1.5], "bm25_b": [0.75], "top_k": [K]})
    out = _evaluated(spark, d, cfg).join(cfg.select("hash", "bm25_k1"), "hash")
    return _r(out.select("bm25_k1", "qid", "type", "split", "recall", "hit1", "mrr", "ndcg", "empty"), "recall", "mrr", "ndcg")


E11 = f"""WITH {GRADED_SQL}
SELECT k1 AS bm25_k1, qid, type, split, round(CASE WHEN len(gold) > 0 THEN coalesce(covered, 0) / len(gold) ELSE 0 END, 6) AS recall, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit1, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr,
round(CASE WHEN best > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(best AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6)::DOUBLE AS ndcg, empty FROM x"""


def e13(spark, d):
    """Hill climbing over nine BM25 settings whose first driver ends after one round: the best score of the trial log."""
    space = {"retrieval_mode": ["bm25"], "bm25_k1": ["0.5", "0.9", "1.5"], "bm25_b": ["0.2", "0.5", "0.75"], "top_k": [K]}
    log = scratch(spark, "trials")

    def score(cfg):
        rows = _evaluated(spark, d, cfg.select("hash", F.col("bm25_k1").cast("double"), F.col("bm25_b").cast("double"), "top_k"))
        return rows.groupBy("hash").agg(F.round(F.avg(F.col("mrr") + F.col("ndcg")), 6).alias("score"))

    start = {"retrieval_mode": "bm25", "bm25_k1": "1.5", "bm25_b": "0.75", "top_k": K}
    ex.refine_job(spark, log, start, space, score, rounds=1)
    return ex.refine_job(spark, log, start, space, score).limit(1).select("score")


E13 = f"""WITH {STATS}, c AS (SELECT k1, unnest([0.2, 0.5, 0.75])::DOUBLE AS b FROM (SELECT unnest([0.5, 0.9, 1.5])::DOUBLE AS k1)), w AS (SELECT k1, b, qid, path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) AS w FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (path), n, c),
s AS (SELECT k1, b, qid, path, round(sum(w), 6) AS score FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY score DESC, CAST(path AS BIGINT)) AS rank FROM s WHERE score > 0),
qa AS (SELECT item_id AS qid, CASE WHEN item_id % 8 = 7 THEN [] ELSE list_distinct([item_id * 7 % 20, item_id * 11 % 20]) END AS gold, {_TYPES_SQL}[item_id % 8 + 1] AS type, CASE WHEN item_id % 10 < 7 THEN 'tune' ELSE 'heldout' END AS split FROM benchmark),
a AS (SELECT doc_id // 50 AS doc, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1), g AS (SELECT qid, unnest(gold) AS doc FROM qa), nr AS (SELECT qid, sum(n) AS n FROM g JOIN a USING (doc) GROUP BY 1),
h AS (SELECT k1, b, qid, rank, path // 50 AS doc, list_contains(gold, path // 50) AS rel FROM r JOIN qa USING (qid) WHERE rank <= {K}),
m AS (SELECT k1, b, qid, count(DISTINCT doc) FILTER (WHERE rel) AS covered, min(rank) FILTER (WHERE rel) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel), 0) AS dcg FROM h GROUP BY 1, 2, 3),
x AS (SELECT c.k1, c.b, qa.*, covered, first, dcg, m.qid IS NULL AS empty, least({K}, coalesce(nr.n, len(gold))) AS best FROM qa CROSS JOIN c LEFT JOIN m ON m.qid = qa.qid AND m.k1 = c.k1 AND m.b = c.b LEFT JOIN nr ON nr.qid = qa.qid)
SELECT max(score) AS score FROM (SELECT k1, b, round(avg(coalesce(1.0 / first, 0) + CASE WHEN best > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(best AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6)::DOUBLE AS score FROM x GROUP BY 1, 2)"""


def e12_knobs(spark, d):
    """All knobs of retrieval in one job: three modes with their BM25, fusion and cosine settings."""
    space = {"retrieval_mode": ["bm25", "dense", "hybrid"], "top_k": [4], "pool": [12], "rrf_k": [30, 60], "w_bm25": [1.0], "w_dense": [0.5], "bm25_k1": [0.9, 1.5], "bm25_b": [0.75], "min_cosine": [0.05, 0.2]}
    cfg = ex.grid(spark, space)
    both = readable(spark, d).unionByName(_seen(spark, d)).distinct()
    seen = _vectors(spark, d).join(_seen(spark, d).select("path"), "path", "left_semi")
    texts = docs(spark, d).where("space in ('en', 'fr')")
    # the vectors' access decides for vectors, the documents' for texts
    out = ex.sweep_retrieval(questions(spark, d), texts.join(readable(spark, d).select("path"), "path", "left_semi"), both, cfg, _qvecs(spark, d), seen, 5, index(spark, d))
    return out.join(cfg.select("hash", "retrieval_mode", "bm25_k1", "rrf_k", "min_cosine"), "hash").drop("hash")


E12_KNOBS = f"""WITH {STATS}, {_DENSE}, cfg AS (SELECT DISTINCT mode, CASE WHEN mode = 'dense' THEN 1.5 ELSE k1 END AS k1, CASE WHEN mode = 'hybrid' THEN rrf ELSE 60 END AS rrf, CASE WHEN mode = 'bm25' THEN 0.0 ELSE mc END AS mc
FROM (SELECT unnest(['bm25', 'dense', 'hybrid']) AS mode), (SELECT unnest([0.9, 1.5])::DOUBLE AS k1), (SELECT unnest([30, 60]) AS rrf), (SELECT unnest([0.05, 0.2])::DOUBLE AS mc)), c AS (SELECT DISTINCT k1 FROM cfg),
w AS (SELECT k1, qid, path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * dl / avgdl)) AS w FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (path), n, c),
s AS (SELECT k1, qid, path, round(sum(w), 5) AS score FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k1, qid ORDER BY score DESC, path) AS rank FROM s WHERE score > 0),
u AS (SELECT mode, k1, rrf, mc, qid, path, CASE WHEN mode = 'hybrid' THEN 1.0::DOUBLE / (rrf + rank) ELSE score END AS s FROM cfg JOIN r USING (k1) WHERE mode <> 'dense' AND rank <= 12
UNION ALL SELECT mode, k1, rrf, mc, qid, path, CASE WHEN mode = 'hybrid' THEN 0.5::DOUBLE / (rrf + rank) ELSE cos END FROM cfg JOIN dr ON cos > mc WHERE mode <> 'bm25' AND rank <= 12),
f AS (SELECT mode, k1, rrf, mc, qid, path, round(sum(s), 5) AS score FROM u GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY mode, k1, rrf, mc, qid ORDER BY score DESC, path) AS rank FROM f)
SELECT mode AS retrieval_mode, k1 AS bm25_k1, CAST(rrf AS BIGINT) AS rrf_k, mc AS min_cosine, qid, path, score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 4"""


def e15(spark, d):
    """Orders as configurations: those that the held-out questions have seen."""
    name = vx.config_hash(["o_orderkey", "o_custkey"]).alias("hash")
    orders = table(spark, d, "orders")
    return ex.used_heldout(orders.select(name, "o_orderkey"), orders.where("o_orderpriority = '1-URGENT'").select(name)).select("o_orderkey")


E15 = "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"


def c2(spark, d):
    """Every document decides on the article of its ten: a third update it, a third dispute it, the rest are new (with one
    title for each eight, so that paths collide); some fall back to an article of their own, some have no title at all."""
    k = F.col("doc_id")
    t = table(spark, d, "documents").select(k, "text", "source", F.lpad(k.cast("string"), 12, "0").alias("raw_path"))
    decision = F.when(k % 3 == 0, "New").when(k % 3 == 1, "Update").otherwise("Disputed")
    at = lambda n: F.concat(F.lit("a/"), n, F.lit(".md"))
    path = at(F.floor(k / 10))
    related = F.array(at(F.floor(k / 10) + 1), at(F.floor(k / 10)), F.lit("a/none.md"))
    decisions = t.select("raw_path", decision.alias("decision"), path.alias("target"), F.lit("Topic A").alias("topic"), F.concat(F.lit("Title "), F.floor(k / 8)).alias("title"), F.col("text").alias("body"), related.alias("related"), F.when(k % 7 == 0, "shrink").when(k % 11 == 0, "refused-title").alias("reason"))
    articles = t.select(path.alias("path")).distinct().select("path", F.lit("t").alias("title"), F.lit("old").alias("body"), F.array(F.lit("raw")).alias("sources"), F.array(F.lit("b/x.md")).alias("related"))
    articles = articles.unionByName(spark.createDataFrame([("topic-a/title-0.md", "t", "old", ["raw"], [])], articles.schema))
    raw = t.select("raw_path", F.concat(F.lit("# Head "), k, F.lit("\n\n> Source: x\n\nrest "), k).alias("text"), F.col("source").alias("space"))
    candidates = t.select("raw_path", F.explode(F.array(path, at(F.floor(k / 10) + 1))).alias("path"))
    out = dx.apply_decisions(decisions, articles, raw, candidates)
    return out.select("path", "title", F.sha2("body", 256).alias("body_sha"), F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"))


C2 = """WITH t AS (SELECT doc_id AS k, text, source, lpad(doc_id::VARCHAR, 12, '0') AS raw, 'a/' || (doc_id // 10) || '.md' AS path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 <> 0), m AS (SELECT * FROM t WHERE k % 7 <> 0 AND k % 3 <> 0),
u AS (SELECT path, max(raw) FILTER (WHERE k % 3 = 1) AS last FROM m GROUP BY 1),
b AS (SELECT path, coalesce(max(coalesce(text, '')) FILTER (WHERE raw = last), 'old') || coalesce(string_agg(chr(10) || chr(10) || '## Disputed' || chr(10) || coalesce(text, '') || chr(10) || '(Source: ' || raw || ')', '' ORDER BY raw) FILTER (WHERE k % 3 = 2 AND (last IS NULL OR raw > last)), '') AS body, 'raw,' || string_agg(raw, ',' ORDER BY raw) AS sources, 'b/x.md,a/' || (max(k) // 10 + 1) || '.md' AS related FROM m JOIN u USING (path) GROUP BY 1),
n AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'general/head-' || k ELSE 'topic-a/title-' || (k // 8) END AS base, 'a/' || (k // 10 + 1) || '.md,a/' || (k // 10) || '.md' AS rel FROM t WHERE k % 7 = 0 OR k % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY raw) AS nth, base = 'topic-a/title-0' AS used FROM n), s AS (SELECT *, row_number() OVER (PARTITION BY base, source ORDER BY raw) AS j FROM o WHERE used OR nth > 1)
SELECT path, 't' AS title, sha256(body) AS body_sha, sources, related FROM b
UNION ALL SELECT coalesce(s.base || '-' || s.source || CASE WHEN j > 1 THEN '-' || j ELSE '' END, o.base) || '.md', CASE WHEN o.k % 7 = 0 THEN 'Head ' || o.k ELSE 'Title ' || (o.k // 8) END, sha256(CASE WHEN o.k % 7 = 0 THEN 'rest ' || o.k ELSE coalesce(o.text, '') END), o.raw, CASE WHEN o.k % 7 = 0 THEN '' ELSE o.rel END FROM o LEFT JOIN s ON s.raw = o.raw"""


def f15(spark, d):
    """Documents as raw files with a head: titles and bodies."""
    k = F.col("doc_id")
    raw = F.when(k % 2 == 0, F.concat(F.lit("## Doc "), k, F.lit("\n> Source: x\n\n"))).otherwise("> Source: y\n")
    out = table(spark, d, "documents").select(k, tx.raw_fallback(F.concat(raw, F.lit("id "), k, F.lit(":"), F.regexp_replace("text", r"\s+", "_"), F.lit(".")), F.concat(F.lit("raw/en/file-"), k, F.lit(".md"))).alias("f"))
    return out.select("doc_id", "f.title", F.sha2("f.body", 256).alias("body_sha"))


F15 = """WITH t AS (SELECT doc_id, 'id ' || doc_id || ':' || regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '_', 'g') || '.' AS b FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE 'file-' || doc_id END AS title, sha256(CASE WHEN length(b) > 60000 THEN left(b, 60000) || chr(10) || chr(10) || '[... truncated ...]' ELSE b END) AS body_sha FROM t"""


def f29(spark, d):
    """Documents as uploads of seven types, every third with the right leading bytes."""
    k = F.col("doc_id")
    kinds = {"pdf": "255044462D", "docx": "504B0304", "xlsx": "504B0506", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FFE0", "txt": ""}
    ext = F.get(F.array(*map(F.lit, kinds)), (k % 7).cast("int"))
    head = F.when(k % 3 == 0, F.get(F.array(*map(F.lit, kinds.values())), (k % 7).cast("int"))).otherwise("")
    content = F.concat(F.unhex(head), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return table(spark, d, "documents").select("doc_id", tx.magic_ok(ext, content).alias("ok"))


F29 = "SELECT doc_id, doc_id % 7 = 6 OR doc_id % 3 = 0 OR (doc_id % 7 = 0 AND contains(left(encode(coalesce(text, ''))::VARCHAR, 1024), '%PDF-')) OR (doc_id % 7 IN (1, 2) AND coalesce(starts_with(text, 'PK'), false)) AS ok FROM documents"


def s12(spark, d):
    """Orders as articles with their lines' suppliers as sources and a related order: rendered and parsed again."""
    k = F.col("o_orderkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("raw/s/"), F.col("l_suppkey")))).alias("sources"))
    path = lambda n: F.concat(F.lit("o/"), n, F.lit(".md"))
    articles = table(spark, d, "orders").join(lines, "o_orderkey", "left").select(
        path(k).alias("path"), F.concat(F.lit('Order "'), k, F.lit('" of '), F.col("o_orderpriority")).alias("title"), F.concat(F.lit("Total: "), F.col("o_custkey"), F.lit("\n\nStatus "), F.col("o_orderstatus")).alias("body"),
        F.to_date("o_orderdate").alias("updated"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.array(path(k + 1)).alias("related"))
    out = src.parse_articles(src.render_articles(articles, articles.select("path", "title")).withColumnRenamed("markdown", "text"))
    return out.select("path", "title", "body", F.col("updated").cast("string").alias("updated"), F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"))


S12 = """WITH l AS (SELECT l_orderkey AS k, string_agg(DISTINCT 'raw/s/' || l_suppkey, ',' ORDER BY 'raw/s/' || l_suppkey) AS sources FROM lineitem GROUP BY 1)
SELECT 'o/' || o_orderkey || '.md' AS path, 'Order "' || o_orderkey || '" of ' || o_orderpriority AS title, 'Total: ' || o_custkey || chr(10) || chr(10) || 'Status ' || o_orderstatus AS body,
CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS updated, coalesce(sources, '') AS sources, 'o/' || (o_orderkey + 1) || '.md' AS related FROM orders LEFT JOIN l ON k = o_orderkey"""


def s7(spark, d):
    """Suppliers as notes of a vault with front matter, some of them templates."""
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 5 == 0, "_templates/").otherwise("20 Wiki/"), k, F.lit(".md"))
    text = F.concat(F.lit("---\nvisibility: "), F.when(k % 2 == 0, "team").otherwise("private"), F.lit("\ntags: [a, "), k % 3, F.lit("]\nbased_on:\n- one\n- "), k, F.lit("\n---\nbody "), k)
    out = src.parse_vault(table(spark, d, "supplier").select(path.alias("path"), text.alias("text")))
    front = lambda n: F.array_join(F.element_at("front", n), ",").alias(n)
    return out.select("folder", "name", front("visibility"), front("tags"), front("based_on"), "body")


S7 = """SELECT '20 Wiki' AS folder, s_suppkey::VARCHAR AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'team' ELSE 'private' END AS visibility, 'a,' || (s_suppkey % 3) AS tags, 'one,' || s_suppkey AS based_on, 'body ' || s_suppkey AS body FROM supplier WHERE s_suppkey % 5 <> 0"""


def s8(spark, d):
    """The benchmark written as a question set and read back: the questions to tune on."""
    path = scratch(spark, "questions")
    i = F.col("item_id")
    qa = table(spark, d, "benchmark").select(
        i.cast("string").alias("id"), F.lit("en").alias("space"), F.col("text").alias("question"), F.get(F.array(*map(F.lit, src.TYPES)), (i % 8).cast("int")).alias("type"),
        F.array(F.concat(F.lit("x\\corpus\\en\\"), i, F.lit(".md"))).alias("gold_docs"), F.when(i % 2 == 0, "tune").otherwise("heldout").alias("split"))
    qa.write.json(path)
    return src.read_qa(spark, path, "tune").select("id", "type", "question", F.array_join("gold_docs", ",").alias("gold_docs"), F.size("leak_facts").alias("n_leak"))


S8 = f"""SELECT item_id::VARCHAR AS id, ['lookup','numeric','latest','multi_doc','paraphrase','conflict','unanswerable','cross_space'][item_id % 8 + 1] AS type, text AS question, 'en/' || item_id || '.md' AS gold_docs, 0 AS n_leak FROM benchmark WHERE item_id % 2 = 0"""


def s9(spark, d):
    """Orders logged as trials in two parts, with torn lines between them, and read back."""
    path = scratch(spark, "trials")
    o = table(spark, d, "orders")
    name = F.concat(F.lit("h"), F.col("o_orderkey"))
    trials = lambda rows: rows.select(F.lit("retrieval").alias("stage"), F.col("o_custkey").alias("seed"), name.alias("hash"), F.create_map(F.lit("k"), F.col("o_orderstatus")).alias("cfg"), (F.col("o_orderkey") / 4).alias("score"), (F.col("o_orderkey") % 9 == 0).alias("rejected"))
    src.append_trials(trials(o.where("o_orderkey % 2 = 0")), path)
    src.append_trials(trials(o.where("o_orderkey % 2 = 1")), path)
    o.select(F.concat(F.lit('{"stage": "retrieval", "hash": "torn'), F.col("o_orderkey")).alias("value")).write.mode("append").text(path)
    return src.read_trials(spark, path).select("hash", "seed", F.col("cfg")["k"].alias("k"), "score", "rejected")


S9 = "SELECT 'h' || o_orderkey AS hash, CAST(o_custkey AS BIGINT) AS seed, o_orderstatus AS k, o_orderkey / 4 AS score, o_orderkey % 9 = 0 AS rejected FROM orders"


def _event_stream(spark, d):
    """The events as a stream of files; ``[t]`` makes the table's name a pattern, as streams read folders or patterns."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _run(df, name):
    """What an appending stream writes over the files that are there now."""
    spark = df.sparkSession
    out = scratch(spark, name)
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def t3(spark, d):
    """Contents of events, once each within ninety days, as a stream."""
    rows = _event_stream(spark, d).select("ts", F.col("event_type").alias("space"), F.sha2("props", 256).alias("sha256"))
    return _run(sj.dedup_stream(rows, "90 days"), "dedup").select("space", "sha256")


T3 = "SELECT DISTINCT event_type AS space, sha256(props) AS sha256 FROM events"


def t9(spark, d):
    """Events by hour as a stream: the windows that the watermark has closed."""
    kind = F.col("event_type")
    rows = _event_stream(spark, d).select("ts", kind.alias("action"), F.when(kind == "purchase", "no-evidence").otherwise("").alias("detail"))
    return _run(sj.audit_stream(rows), "audit").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "action", "n", "no_evidence")


T9 = "SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type AS action, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS no_evidence FROM events GROUP BY 1, 2) WHERE start + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events)"

QUERIES = {
    "e11_evaluate": (e11, E11), "e13_refine_job": (e13, E13), "e12_sweep_knobs": (e12_knobs, E12_KNOBS), "e15_used_heldout": (e15, E15), "c2_apply_decisions": (c2, C2), "f15_raw_fallback": (f15, F15), "f29_magic_ok": (f29, F29),
    "s12_render_articles": (s12, S12), "s7_parse_vault": (s7, S7), "s8_read_qa": (s8, S8), "s9_read_trials": (s9, S9), "t3_dedup_stream": (t3, T3), "t9_audit_stream": (t9, T9),
}
