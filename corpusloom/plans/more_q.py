"""Further queries: configurations, findings, outputs and indexes, question checks, decisions, grids, names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vx
from corpusloom.operators import decisions as dx
from corpusloom.operators import evaluation as ex
from corpusloom.operators import grids
from corpusloom.operators import quality as qx
from corpusloom.operators import reports as rx
from corpusloom.plans.eval_q import _ROWS_SQL, _rows
from corpusloom.plans.tables import table


def f36(spark, d):
    """Orders as configurations of three modes: how many are different once idle knobs are reset."""
    k = F.col("o_orderkey")
    mode = F.when(k % 3 == 0, "bm25").when(k % 3 == 1, "dense").otherwise("hybrid")
    cfg = table(spark, d, "orders").select(mode.alias("retrieval_mode"), (k % 7).cast("int").alias("top_k"), (k % 5 * 10).cast("int").alias("rrf_k"), (k % 4 / 4).alias("bm25_b"), (k % 6 / 10).alias("min_cosine"))
    return vx.canonical_config(cfg).groupBy("retrieval_mode").agg(F.count(F.lit(1)).alias("n"))


F36 = """WITH c AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS m, o_orderkey % 7 AS k, o_orderkey % 5 AS r, o_orderkey % 4 AS b, o_orderkey % 6 AS c FROM orders),
u AS (SELECT DISTINCT m, k, CASE WHEN m = 'hybrid' THEN r END AS r, CASE WHEN m <> 'dense' THEN b END AS b, CASE WHEN m <> 'bm25' THEN c END AS c FROM c) SELECT m AS retrieval_mode, count(*) AS n FROM u GROUP BY 1"""


def a8(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("level"), F.col("l_suppkey").alias("kind"), F.col("l_linestatus").alias("file"))
    return rx.findings_summary(f)


A8 = "SELECT l_returnflag AS level, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linestatus FROM lineitem) GROUP BY 1"


def a13(spark, d):
    return rx.leak_count(_rows(spark, d))


A13 = f"WITH {_ROWS_SQL} SELECT count(*) FILTER (WHERE leak) AS leaks FROM rows"


def w3(spark, d):
    """Turns as attachments of their conversation, named by role: unique names."""
    att = table(spark, d, "conversations").select(F.col("conv_id").alias("mail"), F.col("turn").alias("pos"), F.concat(F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")), F.lit(".txt")).alias("name"))
    return rx.attachment_names(att).select("mail", "pos", F.lower("unique_name").alias("name"))


W3 = """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) SELECT conv_id AS mail, turn AS pos, role || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.txt' AS name FROM n"""


def _outputs(spark, d):
    """Suppliers as wiki pages (some private), orders as outputs based on the suppliers of their lines."""
    wiki = table(spark, d, "supplier").select(
        F.lit(qx.WIKI).alias("folder"), F.concat(F.lit("w/"), "s_suppkey").alias("path"), F.concat(F.lit("s"), "s_suppkey").alias("name"),
        F.create_map(F.lit("visibility"), F.array(F.when(F.col("s_suppkey") % 3 == 0, "Private").otherwise("team"))).alias("front"), F.lit("no numbers").alias("body"))
    base = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("[[s"), "l_suppkey", F.lit("]]")))).alias("b"))
    out = base.select(
        F.lit(qx.OUT).alias("folder"), F.concat(F.lit("o/"), "l_orderkey").alias("path"), F.concat(F.lit("o"), "l_orderkey").alias("name"),
        F.create_map(F.lit("based_on"), F.col("b"), F.lit("audience"), F.array(F.when(F.col("l_orderkey") % 2 == 0, "private").otherwise("internal"))).alias("front"), F.concat(F.lit("order 1"), F.col("l_orderkey") % 10).alias("body"))
    return wiki.unionByName(out)


def q10(spark, d):
    return qx.private_in_output(_outputs(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


Q10 = """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT 'private-in-output' AS kind, count(*) AS n, count(DISTINCT o) AS files FROM e WHERE o % 2 = 1 AND s % 3 = 0
UNION ALL SELECT 'ungrounded-number', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) FROM lineitem"""


def q11(spark, d):
    """Suppliers as pages and an index of every other one, with dates that differ for some, and some that are gone."""
    k = F.col("s_suppkey")
    date = lambda n: F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    s = table(spark, d, "supplier")
    pages = s.select(F.lit(qx.WIKI).alias("folder"), F.concat(F.lit("w/"), k).alias("path"), F.concat(F.lit("s"), k).alias("name"), F.create_map(F.lit("updated"), F.array(date(k % 50))).alias("front"), F.lit("").alias("body"))
    line = F.concat(F.lit("[[s"), F.when(k % 10 == 0, k + 1_000_000_000).otherwise(k), F.lit("]] (updated: "), date(F.when(k % 7 == 0, k % 50 + 1).otherwise(k % 50)), F.lit(")"))
    index = s.where(k % 2 == 0).select(F.lit(qx.WIKI).alias("folder"), F.lit("w/_index").alias("path"), F.lit("_index").alias("name"), F.create_map(F.lit("x"), F.array(F.lit("y"))).alias("front"), line.alias("body"))
    return qx.index_check(pages.unionByName(index)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


Q11 = """SELECT 'index-missing' AS kind, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 10 = 0 UNION ALL SELECT 'index-dangling', count(*) FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'index-date', count(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 7 = 0"""


def q16(spark, d):
    """Questions about documents: missing gold, gold of another language, facts that the gold text lacks."""
    b = F.col("item_id")
    qa = table(spark, d, "benchmark").select(
        F.when(b % 10 == 9, b - 1).otherwise(b).cast("string").alias("id"), F.lit("en").alias("space"), F.when(b % 8 == 1, "").otherwise(F.col("text")).alias("question"), F.when(b % 5 == 0, "multi_doc").otherwise("lookup").alias("type"),
        F.array(F.when(b % 6 == 2, F.lit("none")).otherwise((b * 3).cast("string"))).alias("gold_docs"), F.array(F.lit("the")).alias("gold_facts"), F.array().cast("array<string>").alias("leak_facts"),
        F.when(b % 7 == 3, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>")).alias("stale_docs"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("lang").alias("space"), "text")
    return qx.verify_qa(qa, docs).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


Q16 = """WITH q AS (SELECT item_id AS b, CASE WHEN item_id % 10 = 9 THEN item_id - 1 ELSE item_id END AS id, CASE WHEN item_id % 6 = 2 THEN -1 ELSE item_id * 3 END AS g FROM benchmark), j AS (SELECT q.*, d.doc_id, d.lang, d.text FROM q LEFT JOIN documents d ON d.doc_id = g),
f AS (SELECT id, bool_or(coalesce(contains(text, 'the'), false)) AS ok FROM j GROUP BY 1),
k AS (SELECT 'repeated-id' AS problem, (SELECT count(*) FROM (SELECT id FROM q GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'empty-field', (SELECT count(*) FROM q WHERE b % 8 = 1) UNION ALL SELECT 'gold-missing', (SELECT count(*) FROM j WHERE doc_id IS NULL)
UNION ALL SELECT 'gold-other-space', (SELECT count(*) FROM j WHERE lang <> 'en') UNION ALL SELECT 'fact-missing', (SELECT count(*) FROM f WHERE NOT ok) UNION ALL SELECT 'stale-missing', (SELECT count(*) FROM q WHERE b % 7 = 3) UNION ALL SELECT 'one-document', (SELECT count(*) FROM q WHERE b % 5 = 0))
SELECT * FROM k WHERE n > 0"""


def c1(spark, d):
    """Replies for every document, some broken: why they cannot be followed."""
    k = F.col("doc_id")
    decision = F.when(k % 4 == 0, "New").when(k % 4 == 1, "Update").when(k % 4 == 2, "Disputed").otherwise("No material")
    target = F.when(k % 3 == 0, F.lit("other.md")).otherwise(F.lit("c.md"))
    body = F.when(k % 5 == 0, "").when(k % 5 == 1, "short").otherwise("long enough body text")
    reply = F.concat(F.lit("<think>{}</think> so: "), F.when(k % 11 == 0, "no json").otherwise(F.to_json(F.struct(decision.alias("decision"), target.alias("target"), F.lit("t").alias("topic"), F.when(k % 13 == 0, " ").otherwise("Title").alias("title"), body.alias("body")))))
    docs = table(spark, d, "documents")
    replies = docs.select(k.alias("raw_path"), reply.alias("reply"))
    cands = docs.select(k.alias("raw_path"), F.lit("c.md").alias("path"), F.lit("twenty characters ok").alias("body"))
    out = dx.validate_decisions(replies, cands, docs.select(k.alias("raw_path"), "text"))
    return out.select("raw_path", "decision", "target", "title", F.length("body").alias("n_body"), "reason")


C1 = """WITH r AS (SELECT doc_id AS k, text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ['New', 'Update', 'Disputed', 'No material'][doc_id % 4 + 1] END AS d, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 21 END AS b FROM documents)
SELECT k AS raw_path, d AS decision, CASE WHEN d IS NOT NULL THEN CASE WHEN k % 3 = 0 THEN 'other.md' ELSE 'c.md' END END AS target, CASE WHEN d IS NOT NULL THEN CASE WHEN k % 13 = 0 THEN '' ELSE 'Title' END END AS title, CASE WHEN d IS NOT NULL THEN b END AS n_body,
CASE WHEN d IS NULL THEN 'invalid-reply' WHEN d IN ('Update', 'Disputed') AND k % 3 = 0 THEN 'bad-target' WHEN d = 'No material' AND len(regexp_extract_all(text, '[0-9]+')) >= 3 THEN 'no-material-with-data' WHEN d = 'Update' AND b = 0 THEN 'empty-body'
WHEN d = 'Update' AND k % 13 = 0 THEN 'empty-title' WHEN d = 'Update' AND b = 5 THEN 'shrink' WHEN d IN ('New', 'Disputed') AND b = 0 THEN 'refused-body' WHEN d = 'New' AND k % 13 = 0 THEN 'refused-title' END AS reason FROM r"""


def j19(spark, d):
    """Order lines as a sheet per order whose first column is merged downwards: every line carries the order's first part."""
    li = table(spark, d, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1)
    sheet = F.col("l_orderkey").alias("sheet")
    cells = li.select(sheet, F.col("r").alias("row"), F.lit(0).alias("col"), F.when(F.col("r") == 0, F.col("l_partkey").cast("string")).alias("value")).unionByName(li.select(sheet, F.col("r").alias("row"), F.lit(1).alias("col"), F.col("l_suppkey").cast("string").alias("value")))
    merges = li.where("r = 0").select(sheet, F.lit(0).alias("r0"), F.lit(0).alias("c0"), F.lit(100).alias("rowspan"), F.lit(1).alias("colspan"))
    return grids.flatten_table(grids.expand_merges(cells, merges), 0, 1).select("sheet", "row", "label", "value")


J19 = """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r FROM lineitem)
SELECT a.l_orderkey AS sheet, CAST(a.r AS INT) AS row, CAST(b.l_partkey AS VARCHAR) AS label, CAST(a.l_suppkey AS VARCHAR) AS value FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.r = 0"""


def e2(spark, d):
    """Orders as hits: the parts (gold documents) that their suppliers' lines come from."""
    li = table(spark, d, "lineitem")
    hits = li.select(F.col("l_orderkey").alias("qid"), F.col("l_orderkey").cast("string").alias("path"), F.lit(1).alias("rank")).distinct()
    sources = li.select(F.col("l_orderkey").cast("string").alias("article_path"), F.col("l_suppkey").alias("raw_path")).distinct()
    gold = table(spark, d, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey") % 20).alias("doc"), F.array("s_suppkey").alias("raw_paths"))
    return ex.hit_docs(hits, sources, gold).select("qid", F.array_join("docs", ",").alias("docs"))


E2 = "SELECT l_orderkey AS qid, coalesce(string_agg(DISTINCT 'd' || (s_suppkey % 20), ',' ORDER BY 'd' || (s_suppkey % 20)), '') AS docs FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"

QUERIES = {
    "f36_canonical_config": (f36, F36), "a8_findings_summary": (a8, A8), "a13_leak_count": (a13, A13), "w3_attachment_names": (w3, W3), "q10_private_in_output": (q10, Q10), "q11_index_check": (q11, Q11), "q16_verify_qa": (q16, Q16),
    "c1_validate_decisions": (c1, C1), "j19_expand_merges": (j19, J19), "e2_hit_docs": (e2, E2),
}
