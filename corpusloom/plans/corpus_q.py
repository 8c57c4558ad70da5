"""Queries of grounding and page checks.  Wiki pages are web pages, raw pages documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import grounding as gx
from corpusloom.operators import quality as qx
from corpusloom.plans.tables import table


def pages(spark, d):
    """Web pages as wiki pages that link to each other by number and cite a document each; documents as raw pages."""
    k = F.col("page_id")
    link = lambda n: F.concat(F.lit("[[p"), n, F.lit("]] "))
    front = F.create_map(
        F.lit("topic"), F.array("url"), F.lit("updated"), F.array(F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 200).cast("int")), "yyyy-MM-dd")),
        F.lit("sources"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), k * 2))), F.lit("status"), F.array(F.when(k % 4 == 0, "draft").otherwise("final")),
        F.lit("type"), F.array(F.when(k % 25 == 0, "hub").otherwise("page")),
    )
    status = F.when(k % 10 == 0, "\n> **Status: Outdated** (2026-01-01)\n> see\n").when(k % 10 == 1, "\n> **Status: Disputed**\n> x\n").when(k % 10 == 2, "\n> **Status: Outdated** soon\n> x\n").otherwise("")
    body = F.concat(F.lit("x "), link(k * 2), link(k * 3), F.when(k % 8 == 0, "`[[code]]`").otherwise(""), status)
    name = F.concat(F.lit("p"), F.when(k % 50 == 49, k - 1).otherwise(k))
    wiki = table(spark, d, "pages").select(F.lit(qx.WIKI).alias("folder"), F.concat(F.lit("w/"), k, F.lit(".md")).alias("path"), name.alias("name"), front.alias("front"), body.alias("body"))
    raw_front = F.create_map(F.lit("date"), F.array(F.lit("2026-01-01")), F.lit("source"), F.array("source"))
    raw = table(spark, d, "documents").select(F.lit(qx.RAW).alias("folder"), F.concat(F.lit("r/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("d"), "doc_id").alias("name"), raw_front.alias("front"), F.col("text").alias("body"))
    return wiki.unionByName(raw)


WIKI_SQL = """w AS (SELECT page_id AS k, 'w/' || page_id || '.md' AS file, 'p' || CASE WHEN page_id % 50 = 49 THEN page_id - 1 ELSE page_id END AS name, page_id % 25 = 0 AS hub FROM pages),
names AS (SELECT name FROM w UNION SELECT 'd' || doc_id FROM documents), links AS (SELECT k, file, name, 'p' || (k * 2) AS target FROM w UNION ALL SELECT k, file, name, 'p' || (k * 3) FROM w)"""


def _short(df):
    return df.select("level", "kind", "file", "detail")


def q4(spark, d):
    """Names of several pages: each of these pages with its place, and the finding at the first."""
    p = pages(spark, d)
    found = _short(qx.ambiguous_names(p)).select(F.col("file").alias("path"), "level", "kind", "detail")
    return qx.ambiguous_pages(p).join(found, "path", "left").select("name", "position", "path", "n", "level", "kind", "detail")


Q4 = f"""WITH {WIKI_SQL}, r AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY file) AS position, file AS path, count(*) OVER (PARTITION BY name) AS n FROM w)
SELECT name, position, path, n, CASE WHEN position = 1 THEN 'E' END AS level, CASE WHEN position = 1 THEN 'ambiguous-name' END AS kind, CASE WHEN position = 1 THEN name || ': ' || n || ' pages' END AS detail FROM r WHERE n > 1"""


def q5(spark, d):
    return _short(qx.broken_links(pages(spark, d)))


Q5 = f"WITH {WIKI_SQL} SELECT 'E' AS level, 'broken-link' AS kind, file, target AS detail FROM links WHERE target NOT IN (SELECT name FROM names)"


def q6(spark, d):
    return _short(qx.missing_frontmatter(pages(spark, d)))


Q6 = f"WITH {WIKI_SQL} SELECT 'E' AS level, 'missing-frontmatter' AS kind, file, 'sources' AS detail FROM w WHERE k % 6 = 0 AND NOT hub"


def q7(spark, d):
    return _short(qx.bad_sources(pages(spark, d)))


Q7 = f"WITH {WIKI_SQL} SELECT 'E' AS level, 'bad-source' AS kind, file, 'd' || (k * 2) AS detail FROM w WHERE k % 6 <> 0 AND NOT hub AND k * 2 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'E', 'ungrounded-date', file, '2026-01-01' FROM w JOIN documents ON doc_id = k * 2 WHERE k % 6 <> 0 AND NOT hub AND k % 10 = 0 AND NOT contains(text, '2026-01-01')"


def q8(spark, d):
    return _short(qx.bad_status(pages(spark, d)))


Q8 = f"WITH {WIKI_SQL} SELECT 'E' AS level, 'bad-status' AS kind, file, CASE WHEN k % 10 = 1 THEN 'Status: Disputed' ELSE 'Status: Outdated' END AS detail FROM w WHERE k % 10 IN (1, 2) AND NOT hub"


def q9(spark, d):
    return _short(qx.stale_drafts(pages(spark, d), "2026-06-01"))


Q9 = f"WITH {WIKI_SQL}, u AS (SELECT *, DATE '2026-01-01' + CAST(k % 200 AS INT) AS updated FROM w) SELECT 'W' AS level, 'stale-draft' AS kind, file, 'draft since ' || strftime(updated, '%Y-%m-%d') AS detail FROM u WHERE k % 4 = 0 AND NOT hub AND updated < DATE '2026-05-02'"


def q12(spark, d):
    return _short(qx.orphans(pages(spark, d)))


Q12 = f"WITH {WIKI_SQL} SELECT 'W' AS level, 'orphan' AS kind, file, 'no other wiki page links here' AS detail FROM w WHERE NOT hub AND NOT EXISTS (SELECT 1 FROM links WHERE links.target = w.name AND links.name <> w.name)"


def q13(spark, d):
    return _short(qx.unprocessed_raw(pages(spark, d))).groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n"))


Q13 = "SELECT 'W' AS level, 'raw-unprocessed' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT page_id * 2 FROM pages WHERE page_id % 6 <> 0)"


def q14(spark, d):
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "lang")
    old = now.where("lang <> 'es'").select(F.when(F.col("lang") == "fr", -F.col("path") - 1).otherwise(F.col("path")).alias("path"), F.when(F.col("lang") == "de", "x").otherwise(F.col("sha256")).alias("sha256"))
    return qx.manifest_diff(old, now.select("path", "sha256"))


Q14 = "SELECT doc_id AS path, CASE WHEN lang IN ('es', 'fr') THEN 'raw-new' ELSE 'raw-changed' END AS kind FROM documents WHERE lang <> 'en' UNION ALL SELECT -doc_id - 1, 'raw-deleted' FROM documents WHERE lang = 'fr'"


def q1(spark, d):
    """Prices and dates of all lines, said to be from the delivered lines of their orders: which these do not hold.  Prices
    are asked of what is said of prices, dates of what is said of dates: a price of 1996.00 is not grounded by a year."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("day"), "l_linestatus")
    said = lambda rows, text, name: rows.select("id", text.alias(name))
    done = li.where("l_linestatus = 'F'")
    prices = gx.ungrounded_claims(said(li, F.concat(F.lit("it cost "), F.format_string("%.2f", "price"), F.lit("!")), "body"), said(done, F.concat(F.lit("line of "), F.format_number("price", 2)), "text"))
    days = gx.ungrounded_claims(said(li, F.concat(F.lit("came in "), F.date_format("day", "yyyy/M/d"), F.lit("!")), "body"), said(done, F.concat(F.lit("line on "), F.date_format("day", "yyyy-MM-dd")), "text"))
    return prices.unionByName(days)


Q1 = """WITH b AS (SELECT l_orderkey AS id, printf('%.2f', l_extendedprice) AS v, strftime(l_shipdate, '%Y/%-m/%-d') AS dv, l_extendedprice AS p, l_shipdate AS s FROM lineitem),
r AS (SELECT l_orderkey AS id, l_extendedprice AS p, l_shipdate AS s FROM lineitem WHERE l_linestatus = 'F')
SELECT id, 'number' AS kind, v AS value FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = b.id AND r.p = b.p)
UNION ALL SELECT id, 'date', dv FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = b.id AND r.s = b.s)"""


def q2(spark, d):
    """Orders as articles over their lines: missing and wrong sources, and numbers that no line has."""
    li = table(spark, d, "lineitem")
    articles = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.concat(F.lit("total "), F.format_string("%.2f", "o_totalprice"), F.lit(" due")).alias("body"))
    edges = li.select(F.col("l_orderkey").alias("article_path"), F.concat(F.when(F.col("l_partkey") % 10 == 0, "tmp/").otherwise("raw/"), "l_suppkey").alias("raw_path"))
    raw = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.concat(F.lit("raw/"), "s_suppkey").alias("raw_path"), F.concat(F.lit("total 5 of "), "s_name").alias("text"))
    return gx.lint_articles(articles, edges, raw).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


Q2 = """WITH e AS (SELECT DISTINCT l_orderkey AS a, CASE WHEN l_partkey % 10 = 0 THEN 'tmp/' ELSE 'raw/' END || l_suppkey AS r, l_suppkey AS s FROM lineitem), o AS (SELECT o_orderkey AS a FROM orders),
m AS (SELECT e.* FROM e JOIN o USING (a)), k AS (SELECT 'no-source' AS kind, count(*) AS n FROM o WHERE a NOT IN (SELECT a FROM e) UNION ALL SELECT 'missing-article', count(DISTINCT a) FROM e WHERE a NOT IN (SELECT a FROM o)
UNION ALL SELECT 'invalid-source', count(*) FROM m WHERE r LIKE 'tmp/%' UNION ALL SELECT 'missing-source', count(*) FROM m WHERE r LIKE 'raw/%' AND s % 9 = 0 UNION ALL SELECT 'number', count(DISTINCT a) FROM m) SELECT * FROM k WHERE n > 0"""


def q3(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.concat("text", F.when(F.col("doc_id") % 10 == 0, "\n## Disputed\nx").otherwise("")).alias("body"))
    return gx.lint_disputed(a)


Q3 = "SELECT doc_id AS path FROM documents WHERE doc_id % 10 = 0"


def q15(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.when(F.col("lang") == "en", "# T\n").otherwise(""), "text").alias("text"))
    return qx.verify_corpus(docs)


Q15 = """WITH t AS (SELECT doc_id AS doc, CASE WHEN lang = 'en' THEN '# T' || chr(10) ELSE '' END || text AS text, lang FROM documents), n AS (SELECT doc, lang, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) AS n FROM t)
SELECT doc, 'no-heading' AS problem FROM n WHERE lang <> 'en' UNION ALL SELECT doc, 'length' FROM n WHERE n NOT BETWEEN 150 AND 600"""


def q17(spark, d):
    terms = spark.createDataFrame([("insult", ["idiot"]), ("both", ["trash", "clown"])], "term string, words array<string>")
    return qx.absent_terms(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), terms)


Q17 = """WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no FROM documents)
SELECT doc, line_no, 'insult' AS term FROM l WHERE contains(line, 'idiot') UNION ALL SELECT doc, line_no, 'both' FROM l WHERE contains(line, 'trash') AND contains(line, 'clown')"""

QUERIES = {
    "q1_ungrounded_claims": (q1, Q1), "q2_lint_articles": (q2, Q2), "q3_lint_disputed": (q3, Q3), "q4_ambiguous_names": (q4, Q4), "q5_broken_links": (q5, Q5), "q6_missing_frontmatter": (q6, Q6), "q7_bad_sources": (q7, Q7),
    "q8_bad_status": (q8, Q8), "q9_stale_drafts": (q9, Q9), "q12_orphans": (q12, Q12), "q13_unprocessed_raw": (q13, Q13), "q14_manifest_diff": (q14, Q14), "q15_verify_corpus": (q15, Q15), "q17_absent_terms": (q17, Q17),
}
