"""Queries of access control, ledgers and set operations.  Articles are orders, sources their suppliers, labels regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import access as ax
from corpusloom.operators import decisions as dx
from corpusloom.operators import evaluation as ex
from corpusloom.operators import reports as rx
from corpusloom.plans.tables import LABELS_SQL, docs, raw_files, sources, table, users
from corpusloom.sources import files as src


def j1(spark, d):
    """Readable orders per access key, counted."""
    found = ax.readable_articles(sources(spark, d), raw_files(spark, d), users(spark, d))
    spaces = ax.acl_keys(users(spark, d)).select("acl_key", F.array_join("spaces", ",").alias("spaces")).distinct()
    return found.join(spaces, "acl_key").select("spaces", "path")


J1 = f"""WITH {LABELS_SQL}, reg AS (SELECT r_regionkey, r_name FROM region),
usr AS (SELECT DISTINCT a.r_name AS x, b.r_name AS y FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN reg a ON a.r_regionkey = n_regionkey JOIN reg b ON b.r_regionkey = (a.r_regionkey + 1) % 5),
k AS (SELECT DISTINCT CASE WHEN x < y THEN x || ',' || y ELSE y || ',' || x END AS spaces, x, y FROM usr)
SELECT DISTINCT spaces, article_path AS path FROM k JOIN src ON true JOIN lab USING (raw_path)
GROUP BY spaces, x, y, article_path HAVING bool_and(space = x OR space = y)"""


def j2(spark, d):
    return ax.article_spaces(sources(spark, d), raw_files(spark, d)).select("path", F.array_join("spaces", ",").alias("spaces"))


J2 = f"WITH {LABELS_SQL} SELECT article_path AS path, string_agg(DISTINCT space, ',' ORDER BY space) AS spaces FROM src JOIN lab USING (raw_path) GROUP BY 1"


def j3(spark, d):
    return ax.filter_readable(ax.article_spaces(sources(spark, d), raw_files(spark, d)), ["ASIA", "EUROPE", "AMERICA"]).select("path")


J3 = f"WITH {LABELS_SQL} SELECT article_path AS path FROM src JOIN lab USING (raw_path) GROUP BY 1 HAVING bool_and(space IN ('ASIA', 'EUROPE', 'AMERICA'))"


def j4(spark, d):
    return ax.articles_with_spaces(ax.article_spaces(sources(spark, d), raw_files(spark, d)), ["ASIA", "EUROPE"])


J4 = f"WITH {LABELS_SQL} SELECT article_path AS path FROM src JOIN lab USING (raw_path) GROUP BY 1 HAVING string_agg(DISTINCT space, ',' ORDER BY space) = 'ASIA,EUROPE'"


def j5(spark, d):
    """Orders of one customer, in key order, as related edges; kept within one label set."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    edges = o.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("c")).join(o.select(F.col("o_orderkey").alias("other"), F.col("o_custkey").alias("c")), "c").select("path", F.col("other").alias("pos"), "other")
    out = ax.related_same_space(edges, ax.article_spaces(sources(spark, d), raw_files(spark, d)))
    return out.select("path", F.array_join(F.col("related").cast("array<string>"), ",").alias("related"))


J5 = f"""WITH {LABELS_SQL}, s AS (SELECT article_path AS path, string_agg(DISTINCT space, ',' ORDER BY space) AS spaces FROM src JOIN lab USING (raw_path) GROUP BY 1)
SELECT a.o_orderkey AS path, string_agg(CAST(b.o_orderkey AS VARCHAR), ',' ORDER BY b.o_orderkey) AS related
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
JOIN s sa ON sa.path = a.o_orderkey JOIN s sb ON sb.path = b.o_orderkey AND sa.spaces = sb.spaces GROUP BY 1"""


def _policy(spark, d):
    return table(spark, d, "region").select(F.lower("r_name").alias("space"), (F.col("r_regionkey") % 2 == 0).alias("flag")).where("space <> 'asia'").unionByName(table(spark, d, "nation").where("n_nationkey % 5 = 1").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lower("r_name"), F.lit("/n"), "n_nationkey").alias("space"), F.lit(False).alias("flag")))


def _folders(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower("r_name"), F.lit("/n"), "n_nationkey", F.lit("/c"), F.col("c_custkey") % 50).alias("space"))


_POLICY_SQL = """pol AS (SELECT lower(r_name) AS at, r_regionkey % 2 = 0 AS flag FROM region WHERE r_name <> 'ASIA'
UNION ALL SELECT lower(r_name) || '/n' || n_nationkey, false FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 1),
f AS (SELECT DISTINCT lower(r_name) AS r, lower(r_name) || '/n' || n_nationkey AS n, lower(r_name) || '/n' || n_nationkey || '/c' || (c_custkey % 50) AS space FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def j6(spark, d):
    return ax.policy_for_space(_folders(spark, d), _policy(spark, d), True)


J6 = f"WITH {_POLICY_SQL} SELECT space, coalesce(p2.flag, p1.flag, true) AS flag FROM f LEFT JOIN pol p1 ON p1.at = r LEFT JOIN pol p2 ON p2.at = n"


def j7(spark, d):
    aliases = _policy(spark, d).select(F.upper("space").alias("alias"), F.concat(F.lit("to-"), "space").alias("space"))
    return ax.resolve_alias(_folders(spark, d).withColumnRenamed("space", "folder"), aliases)


J7 = f"WITH {_POLICY_SQL} SELECT space AS folder, 'to-' || coalesce(p2.at, p1.at) AS space FROM f LEFT JOIN pol p1 ON p1.at = r LEFT JOIN pol p2 ON p2.at = n"


def _new_raw(spark, d):
    """Every supplier once more: some moved, some changed, some without a label, and customers as new files."""
    k = F.col("raw_path")
    old = raw_files(spark, d).withColumn("space", F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, F.lit("MARS")).otherwise(F.col("space")))
    new = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("raw_path"), F.lit("ASIA").alias("space"), F.sha2("c_name", 256).alias("sha256"))
    return old.unionByName(new)


def j9(spark, d):
    return ax.register_raw(raw_files(spark, d), _new_raw(spark, d))


J9 = "SELECT s_suppkey AS raw_path, CASE WHEN s_suppkey % 7 = 0 THEN 'refused' WHEN s_suppkey % 5 = 0 THEN 'conflict' ELSE 'same' END AS status FROM supplier UNION ALL SELECT c_custkey + 1000000000, 'new' FROM customer"


def j10(spark, d):
    """Suppliers of one nation in five moved to MARS; the label sets that result."""
    moved = ax.relabel_raw(raw_files(spark, d), table(spark, d, "supplier").where("s_nationkey % 5 = 2").select(F.col("s_suppkey").alias("raw_path"), F.lit("MARS").alias("space")))
    return ax.article_spaces(sources(spark, d), moved).groupBy(F.array_join("spaces", ",").alias("spaces")).agg(F.count(F.lit(1)).alias("n"))


J10 = """WITH l AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 2 THEN 'MARS' ELSE r_name END AS space FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT l_orderkey, string_agg(DISTINCT space, ',' ORDER BY space) AS spaces FROM lineitem JOIN l ON l_suppkey = s_suppkey GROUP BY 1) SELECT spaces, count(*) AS n FROM a GROUP BY 1"""


def j11(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_path"), F.concat(F.when(F.col("l_linenumber") == 1, "wiki/").otherwise("raw/"), F.col("l_suppkey") + F.when(F.col("l_partkey") % 11 == 0, 1_000_000_000).otherwise(0)).alias("raw_path"), F.lit("ASIA").alias("space"))
    known = raw_files(spark, d).withColumn("raw_path", F.concat(F.lit("raw/"), "raw_path"))
    return ax.check_sources(edges, known).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


J11 = """SELECT CASE WHEN l_linenumber = 1 THEN 'not-raw' WHEN l_partkey % 11 = 0 THEN 'unregistered' ELSE 'other-space' END AS reason, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_linenumber = 1 OR l_partkey % 11 = 0 OR r_name <> 'ASIA' GROUP BY 1"""


def j12(spark, d):
    """Documents of two languages written again, and some new ones: revision numbers by language."""
    old = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("title"), F.lit(1).cast("long").alias("rev"))
    new = table(spark, d, "documents").where("lang in ('fr', 'de')").select(F.when(F.col("lang") == "de", F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("path"), F.concat("lang", F.lit("-new")).alias("title"), F.lit(0).cast("long").alias("rev"))
    return ax.upsert_articles(old, new).groupBy("title", "rev").agg(F.count(F.lit(1)).alias("n"))


J12 = "SELECT lang AS title, CAST(1 AS BIGINT) AS rev, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY 1 UNION ALL SELECT 'fr-new', 2, count(*) FROM documents WHERE lang = 'fr' UNION ALL SELECT 'de-new', 1, count(*) FROM documents WHERE lang = 'de'"


def j13(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    left = ax.delete_articles({"edges": (sources(spark, d), "article_path")}, gone)
    return left["edges"].groupBy("article_path").agg(F.count(F.lit(1)).alias("n"))


J13 = "SELECT l_orderkey AS article_path, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"


def _by_hash(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("space"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("raw_path"))


def j14(spark, d):
    """Documents against a ledger of the even ones: which are in it, or repeat an earlier one of their source."""
    rows = _by_hash(spark, d)
    ledger = table(spark, d, "documents").where("lang = 'en'").select(F.col("source").alias("space"), F.sha2("text", 256).alias("sha256"))
    return ax.already_ingested(rows, ledger, ledger.where("space = 'src1'")).select("raw_path", "duplicate")


J14 = """WITH h AS (SELECT doc_id, source, lang, sha256(text) AS s FROM documents), led AS (SELECT DISTINCT source, s FROM h WHERE lang = 'en')
SELECT doc_id AS raw_path, (led.s IS NOT NULL) OR row_number() OVER (PARTITION BY h.source, h.s ORDER BY doc_id) > 1 AS duplicate FROM h LEFT JOIN led ON h.source = led.source AND h.s = led.s"""


def j15(spark, d):
    failed = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("raw_path"))
    return ax.undo_orphans(raw_files(spark, d), sources(spark, d), failed).select("raw_path", "space")


J15 = f"WITH {LABELS_SQL} SELECT raw_path, space FROM lab WHERE raw_path NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 AND s_suppkey NOT IN (SELECT raw_path FROM src))"


def j16(spark, d):
    """Turns as files: a conversation's first turn is the mail, the others are attached to it."""
    t = table(spark, d, "conversations")
    ledger = t.select(F.concat_ws("/", "conv_id", "turn").alias("raw_path"), F.when(F.col("turn") > 0, F.concat("conv_id", F.lit("/0"))).otherwise("").alias("parent_raw"))
    return ax.attachments_of(ledger)


J16 = "SELECT CAST(a.conv_id AS VARCHAR) || '/0' AS raw_path, CAST(a.conv_id AS VARCHAR) || '/' || a.turn AS child_raw FROM conversations a WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = 0)"


def j17(spark, d):
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.sha2("text", 256).alias("sha256"), "lang", "source")
    index = now.where("lang <> 'es'").select("path", "size", F.when(F.col("lang") == "fr", F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("source") == "src3", "x").otherwise(F.col("sha256")).alias("sha256"))
    return ax.detect_changes(now.drop("lang", "source"), index, max_size=10_000)


J17 = """SELECT doc_id AS path, CASE WHEN n_chars > 10000 THEN 'too-big' WHEN n_chars = 0 THEN 'empty' WHEN lang = 'es' THEN 'new' WHEN lang <> 'fr' THEN 'unchanged'
WHEN source = 'src3' THEN 'changed' ELSE 'touched' END AS status FROM documents"""


def j18(spark, d):
    readable = ax.readable_articles(sources(spark, d), raw_files(spark, d), users(spark, d))
    asia = ax.acl_keys(users(spark, d)).where(F.array_join("spaces", ",") == "ASIA,EUROPE").select("acl_key").distinct()
    requests = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("path")).crossJoin(asia)
    return ax.can_open(requests, readable).select("path", "allowed")


J18 = f"""WITH {LABELS_SQL}, ok AS (SELECT article_path FROM src JOIN lab USING (raw_path) GROUP BY 1 HAVING bool_and(space IN ('ASIA', 'EUROPE')))
SELECT o_orderkey * 2 AS path, ok.article_path IS NOT NULL AS allowed FROM orders LEFT JOIN ok ON ok.article_path = o_orderkey * 2"""


def w1(spark, d):
    rows = rx.round_robin(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("space")))
    return rows.select("id", "space", "turn", "position")


W1 = """WITH t AS (SELECT doc_id AS id, source AS space, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
SELECT id, space, turn, row_number() OVER (ORDER BY turn, first) AS position FROM t"""


def w2(spark, d):
    """A path per document from its first word: the base, then base and source, then a number."""
    new = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("base"), F.col("source").alias("space"))
    return rx.unique_paths(new, spark.createDataFrame([], "path string"))


W2 = """WITH a AS (SELECT doc_id AS id, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS base, source AS space FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS nth FROM a),
r AS (SELECT id, base || '-' || space AS stem, row_number() OVER (PARTITION BY base || '-' || space ORDER BY id) AS k FROM n WHERE nth > 1)
SELECT id, base AS path FROM n WHERE nth = 1 UNION ALL SELECT id, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END FROM r"""


def w8(spark, d):
    """Suppliers that sold in 1995 and before against those after it, by order line."""
    li = table(spark, d, "lineitem")
    pick = lambda c: li.where(c).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return rx.set_diff(pick("l_shipdate < timestamp'1996-01-01'"), pick("l_shipdate >= timestamp'1996-01-01'"), ["s", "p"])


W8 = """WITH o AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), n AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')
SELECT s, p, 'removed' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT s, p, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)"""


def w4(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") != "purchase").alias("failed"))
    return rx.failure_streak(rows, 5, ["user_id"]).select("seq", "streak", "stop")


W4 = """WITH e AS (SELECT user_id, event_id AS seq, event_type <> 'purchase' AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM e),
s AS (SELECT seq, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY seq) AS BIGINT) AS streak FROM i) SELECT seq, streak, streak >= 5 AS stop FROM s"""


def w7(spark, d):
    """The distinct first words of each document's lines, in order."""
    return docs(spark, d).select("path", F.array_join(tx.distinct_keep_order(F.transform(F.split("text", "\n"), lambda x: F.regexp_extract(x, "^([A-Za-z]*)", 1))), ",").alias("firsts"))


W7 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, regexp_extract(line, '^([A-Za-z]*)', 1) AS w, min(pos) AS pos FROM l GROUP BY 1, 2) SELECT doc_id AS path, string_agg(w, ',' ORDER BY pos) AS firsts FROM f GROUP BY 1"""


def s10(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.lit("m").alias("model"), F.size("embedding").alias("dim"), "label")
    new = old.where("label < 3").withColumn("label", F.col("label") + 100)
    return src.upsert_embeddings(old, new).groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))


S10 = "SELECT CASE WHEN label < 3 THEN label + 100 ELSE label END AS label, CAST(len(embedding) AS INT) AS dim, count(*) AS n FROM embeddings GROUP BY 1, 2"


def s13(spark, d):
    from corpusloom.plans.tables import audit

    return src.export_audit(audit(spark, d), "2024-01-15 00:00:00")


S13 = "SELECT 'audit_export' AS action, '2024-01-15 00:00:00' AS target, CAST(count(*) AS VARCHAR) AS detail FROM events WHERE ts >= TIMESTAMP '2024-01-15'"


def s14(spark, d):
    o = table(spark, d, "supplier").select(F.concat("s_suppkey", F.lit(".md")).alias("path"), F.col("s_name").alias("title"))
    spaces = raw_files(spark, d).select(F.concat("raw_path", F.lit(".md")).alias("path"), F.array("space").alias("spaces"))
    return src.space_index(o, spaces)


S14 = f"WITH {LABELS_SQL}, r AS (SELECT space, '- [[' || s_suppkey || '|' || s_name || ']]' AS line FROM supplier JOIN lab ON s_suppkey = raw_path) SELECT space, row_number() OVER (PARTITION BY space ORDER BY line) AS position, line FROM r"


def s15(spark, d):
    return src.raw_manifest(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))


S15 = "SELECT doc_id AS path, sha256(text) AS sha256 FROM documents"


def s16(spark, d):
    """The digest of all documents, from a tree of three levels."""
    return src.dataset_digest(s15(spark, d).withColumn("path", F.col("path").cast("string")), 3)


S16 = """WITH f AS (SELECT sha256(doc_id::VARCHAR) AS spot, doc_id || chr(10) || sha256(text) AS line FROM documents), l3 AS (SELECT left(spot, 3) AS p, sha256(string_agg(line, chr(10) ORDER BY line)) AS d, count(*) AS n FROM f GROUP BY 1),
l2 AS (SELECT left(p, 2) AS p, sha256(string_agg(p || ' ' || d, chr(10) ORDER BY p)) AS d, sum(n) AS n FROM l3 GROUP BY left(p, 2)), l1 AS (SELECT left(p, 1) AS p, sha256(string_agg(p || ' ' || d, chr(10) ORDER BY p)) AS d, sum(n) AS n FROM l2 GROUP BY left(p, 1))
SELECT sha256(string_agg(p || ' ' || d, chr(10) ORDER BY p)) AS digest, sum(n)::BIGINT AS n FROM l1"""


def s11(spark, d):
    """Documents as parsed files of one title per language: the records of new and old contents, beside registered files
    that hold the plain name and the third one, and a title that is such a number's name."""
    t = table(spark, d, "documents")
    k = F.col("doc_id")
    title = F.concat(F.lit("Note - "), "lang", F.when(k % 10 == 7, " 3").otherwise(""))
    parsed = t.select(title.alias("title"), "text", F.lit("f.txt").alias("source_name"), F.lit(None).cast("date").alias("published"), F.col("source").alias("space"))
    some = t.groupBy("source", "lang").agg(F.min("text").alias("text"))
    head = F.concat(F.lit("# Note - "), "lang", F.lit("\n\n> Source: f.txt\n> Collected: 2026-09-30\n> Published: Unknown\n\n"), "text", F.lit("\n"))
    base = F.concat(F.lit("raw/"), "source", F.lit("/2026-09-30-note-"), "lang")
    old = some.select(F.explode(F.array(F.struct(F.concat(base, F.lit(".md")).alias("raw_path"), F.sha2(head, 256).alias("sha256")), F.struct(F.concat(base, F.lit("-4.md")).alias("raw_path"), F.lit("other").alias("sha256")))).alias("x"), F.col("source").alias("space")).select("x.raw_path", "space", "x.sha256")
    return src.save_raw(parsed, old, "2026-09-30").select("raw_path", "space", "sha256", "is_new")


S11 = """WITH u AS (SELECT DISTINCT source, lang, doc_id % 10 = 7 AS third, text FROM documents WHERE lang IS NOT NULL), b AS (SELECT *, 'raw/' || source || '/2026-09-30-note-' || lang || CASE WHEN third THEN '-3' ELSE '' END AS base,
sha256('# Note - ' || lang || CASE WHEN third THEN ' 3' ELSE '' END || chr(10) || chr(10) || '> Source: f.txt' || chr(10) || '> Collected: 2026-09-30' || chr(10) || '> Published: Unknown' || chr(10) || chr(10) || coalesce(text, '') || chr(10)) AS sha256 FROM u),
o AS (SELECT source, lang, min(text) AS t FROM documents GROUP BY 1, 2), h AS (SELECT source, lang, sha256('# Note - ' || lang || chr(10) || chr(10) || '> Source: f.txt' || chr(10) || '> Collected: 2026-09-30' || chr(10) || '> Published: Unknown' || chr(10) || chr(10) || t || chr(10)) AS first FROM o),
x AS (SELECT b.*, NOT third AND sha256 = first AS old, max(third) OVER (PARTITION BY b.source, b.lang) AS kept FROM b JOIN h ON h.source = b.source AND h.lang = b.lang),
j AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY sha256) AS j FROM x WHERE NOT old),
n AS (SELECT base, source, sha256, CASE WHEN third THEN j WHEN kept THEN j + CASE WHEN j >= 2 THEN 3 ELSE 1 END ELSE j + CASE WHEN j >= 3 THEN 2 ELSE 1 END END AS n FROM j)
SELECT base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS raw_path, source AS space, sha256, true AS is_new FROM n UNION ALL SELECT base || '.md', source, sha256, false FROM x WHERE old"""


def c3(spark, d):
    """Edges from each order to the next one of its customer, drawn back too."""
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    edges = o.select(F.col("o_orderkey").alias("path"), F.lit(0).alias("pos"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("other")).where("other is not null")
    spaces = o.select(F.col("o_orderkey").alias("path"), F.array("o_orderstatus").alias("spaces"))
    out = dx.backlinks(edges, edges.select("path"), spaces)
    return out.select("path", F.array_join(F.array_sort(F.col("related")).cast("array<string>"), ",").alias("related"))


C3 = """WITH e AS (SELECT o_orderkey AS p, o_orderstatus AS s, lead(o_orderkey) OVER w AS o, lead(o_orderstatus) OVER w AS os FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
b AS (SELECT p, o FROM e WHERE s = os UNION SELECT o, p FROM e WHERE s = os) SELECT p AS path, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS related FROM b GROUP BY 1"""


def c4(spark, d):
    raw = table(spark, d, "documents").select(F.concat(F.lit("raw/"), "source", F.lit("/"), "doc_id").alias("raw_path"), F.when(F.col("lang") == "es", "other").otherwise(F.col("source")).alias("space"), F.when(F.col("lang") == "de", "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    files = table(spark, d, "documents").where("source <> 'src2'").select(F.concat(F.lit("raw/"), "source", F.lit("/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return dx.raw_integrity(raw, files)


C4 = """SELECT 'raw/' || source || '/' || doc_id AS raw_path, CASE WHEN lang = 'es' THEN 'outside-space' WHEN source = 'src2' THEN 'missing' ELSE 'changed' END AS problem
FROM documents WHERE lang IN ('es', 'de') OR source = 'src2'"""


def e1(spark, d):
    """Parts as documents, order lines as their ingested files, orders as articles."""
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.lit("s").alias("space"), F.col("p_partkey").cast("string").alias("sha256"))
    li = table(spark, d, "lineitem")
    ledger = li.select(F.lit("s").alias("space"), F.col("l_partkey").cast("string").alias("sha256"), F.concat(F.lit("raw/"), "l_orderkey").alias("raw_path"), F.lit("").alias("parent_raw"))
    edges = li.select(F.col("l_orderkey").cast("string").alias("article_path"), F.concat(F.lit("raw/"), "l_orderkey").alias("raw_path"))
    out = ex.gold_map(files, ledger, edges)
    return out.select("doc", F.size("raw_paths").alias("raws"), F.array_join("articles", ",").alias("articles"))


E1 = """SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(count(DISTINCT l_orderkey) AS INT) AS raws, coalesce(string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)), '') AS articles
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1"""

QUERIES = {
    "j1_readable_articles": (j1, J1), "j2_article_spaces": (j2, J2), "j3_filter_readable": (j3, J3), "j4_articles_with_spaces": (j4, J4), "j5_related_same_space": (j5, J5),
    "j6_policy_for_space": (j6, J6), "j7_resolve_alias": (j7, J7), "j9_register_raw": (j9, J9), "j10_relabel_raw": (j10, J10), "j11_check_sources": (j11, J11), "j12_upsert_articles": (j12, J12),
    "j13_delete_articles": (j13, J13), "j14_already_ingested": (j14, J14), "j15_undo_orphans": (j15, J15), "j16_attachments_of": (j16, J16), "j17_detect_changes": (j17, J17), "j18_can_open": (j18, J18),
    "w1_round_robin": (w1, W1), "w2_unique_paths": (w2, W2), "w4_failure_streak": (w4, W4), "w7_distinct_keep_order": (w7, W7), "w8_set_diff": (w8, W8),
    "s10_upsert_embeddings": (s10, S10), "s11_save_raw": (s11, S11), "s13_export_audit": (s13, S13), "s14_space_index": (s14, S14), "s15_raw_manifest": (s15, S15), "s16_dataset_digest": (s16, S16),
    "c3_backlinks": (c3, C3), "c4_raw_integrity": (c4, C4), "e1_gold_map": (e1, E1),
}
