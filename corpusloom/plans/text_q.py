"""Queries of text, personal-data, claim and vector functions, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import facts as fx
from corpusloom.functions import pii
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import search as sx
from corpusloom.operators.matching import occurring
from corpusloom.plans.tables import TOKENS_SQL, docs, table, turns

T, N = "text", "path"


def f1(spark, d):
    """Tokens of a document: how many, how many different, and the last."""
    t = docs(spark, d).select(N, tx.tokenize(T).alias("t"))
    return t.select(N, F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("kinds"), F.try_element_at("t", F.lit(-1)).alias("last"))


F1 = f"WITH t AS (SELECT doc_id AS path, {TOKENS_SQL} AS t FROM documents) SELECT path, CAST(len(t) AS INT) AS n, CAST(len(list_distinct(t)) AS INT) AS kinds, t[-1] AS last FROM t"


def f2(spark, d):
    """Frequencies of terms over the corpus: documents and occurrences."""
    per = tx.term_counts(docs(spark, d), N)
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


F2 = f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1"


def f4(spark, d):
    """Masked texts by their hash, and how often each kind was masked."""
    m = docs(spark, d).select(N, pii.pii_mask(T).alias("m"))
    kinds = [F.coalesce(F.try_element_at("m.counts", F.lit(k)), F.lit(0)).alias(k) for k in pii.KINDS]
    return m.select(N, *kinds, F.sha2("m.text", 256).alias("sha"))


def _mask_sql() -> str:
    """The masks in DuckDB, which has neither look-around nor back references: neighbours are captured and put back (twice,
    as two matches can share one), and a repeated separator is written out for each of its values."""
    space, area = r"\t-\r ", r"(?:1[016-9]|2|[3-6][0-9]|70)"
    seps, gap = ["", "-", *(rf"\x{c:02x}" for c in (9, 10, 11, 12, 13, 32))], rf"[-{space}.]?"
    numbers = [
        ("RRN", rf"[0-9]{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[-{space}]{{0,2}}[1-8][0-9]{{6}}"),
        ("CARD", "|".join(s.join(["[0-9]{4}"] * 4) for s in seps)),
        ("CARD", "|".join(s.join(["[0-9]{4}", "[0-9]{6}", "[0-9]{5}"]) for s in seps)),
        ("BRN", "[0-9]{3}-[0-9]{2}-[0-9]{5}"),
        ("PHONE", rf"(?:\+[{space}]?82|82){gap}(?:\(0\){gap})?0?{area}{gap}[0-9]{{3,4}}{gap}[0-9]{{4}}"),
        ("PHONE", rf"\(0{area}\){gap}[0-9]{{3,4}}{gap}[0-9]{{4}}"),
        ("PHONE", rf"0{area}{gap}[0-9]{{3,4}}{gap}[0-9]{{4}}"),
    ]
    t = r"regexp_replace(text, '[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,}', '[EMAIL]', 'g')"
    for token, core in numbers:
        for _ in range(2):
            t = rf"regexp_replace({t}, '(^|[^0-9])(?:{core})($|[^0-9])', '\1[{token}]\2', 'g')"
    count = lambda k: f"CAST((length(m) - length(replace(m, '[{k}]', '')) - length(text) + length(replace(text, '[{k}]', ''))) // {len(k) + 2} AS INT) AS {k.lower()}"
    return f"WITH m AS (SELECT doc_id, text, {t} AS m FROM documents) SELECT doc_id AS path, {', '.join(count(k.upper()) for k in pii.KINDS)}, sha256(m) AS sha FROM m"


F4 = _mask_sql()


def f6(spark, d):
    """Masked documents: whose text, read again, holds no address."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"), (F.col("lang") != "es").alias("mask"))
    out = pii.mask_document(rows)
    return out.select("doc_id", F.coalesce(F.try_element_at("pii_counts", F.lit("email")), F.lit(0)).alias("emails"), F.contains("text", F.lit("[EMAIL]")).alias("marked"))


F6 = """WITH e AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]{1,64}@[A-Za-z0-9.\\-]{1,255}\\.[A-Za-z]{2,}')) ELSE 0 END AS n FROM documents)
SELECT doc_id, CAST(n AS INT) AS emails, n > 0 AS marked FROM e"""


def f7(spark, d):
    """Personal data of all kinds."""
    return pii.pii_scan(table(spark, d, "documents"))


F7 = """WITH e AS (SELECT doc_id AS doc, 'rrn' AS kind, unnest(regexp_extract_all(text, '\\b[0-9]{6}-?[1-4][0-9]{6}\\b')) AS value FROM documents
UNION ALL SELECT doc_id, 'card', unnest(regexp_extract_all(text, '\\b(?:[0-9]{4}[- ]){3}[0-9]{4}\\b')) FROM documents
UNION ALL SELECT doc_id, 'mobile', unnest(regexp_extract_all(text, '\\b01[016789]-?[0-9]{3,4}-?[0-9]{4}\\b')) FROM documents
UNION ALL SELECT doc_id, 'landline', unnest(regexp_extract_all(text, '\\b0(?:2|[3-6][0-9])-[0-9]{3,4}-[0-9]{4}\\b')) FROM documents
UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[\\pL\\pM\\pN_.+-]+@[\\pL\\pM\\pN_-]+(?:\\.[\\pL\\pM\\pN_-]+)+')) FROM documents)
SELECT * FROM e WHERE NOT (kind = 'email' AND ends_with(value, '.example') OR kind = 'mobile' AND starts_with(value, '010-0000-') OR kind = 'landline' AND contains(value, '-0000-'))"""


def f8(spark, d):
    """Slugs of addresses, which are plain ASCII, and of notes whose titles hold runs of hyphens and numbers."""
    title = F.concat(F.lit(" Report - "), "page_id", F.lit(" --_ "), F.substring("url", 1, 45), F.lit(" & x "))
    return table(spark, d, "pages").select("page_id", tx.slugify("url").alias("slug"), tx.raw_slug("url").alias("short"), tx.raw_slug(title).alias("raw"))


F8 = """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^\\w-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS s, url AS u, ' Report - ' || page_id || ' --_ ' || left(url, 45) || ' & x ' AS t FROM pages),
r AS (SELECT page_id, s, regexp_replace(left(regexp_replace(lower(regexp_replace(u, '[^\\w]+', '-', 'g')), '^[-_]+|[-_]+$', '', 'g'), 60), '[-_]+$', '') AS short, regexp_replace(left(regexp_replace(lower(regexp_replace(t, '[^\\w]+', '-', 'g')), '^[-_]+|[-_]+$', '', 'g'), 60), '[-_]+$', '') AS raw FROM s)
SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE left(s, 80) END AS slug, CASE WHEN short = '' THEN 'untitled' ELSE short END AS short, raw FROM r"""


def f10(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean_title(F.concat(F.lit("  a\n"), "url")).alias("title"), tx.label(F.concat(F.lit("[x]|"), "url")).alias("label"), tx.link_target(F.concat("url", F.lit(".md"))).alias("target"))


F10 = "SELECT page_id, left('a ' || url, 200) AS title, left(' x  ' || url, 200) AS label, url AS target FROM pages"


def f12(spark, d):
    return docs(spark, d).select(N, tx.text_sha(T).alias("sha"), tx.has_data(T).alias("has_data"))


F12 = "SELECT doc_id AS path, sha256(left(text, 4000)) AS sha, len(regexp_extract_all(text, '[0-9]+')) >= 3 AS has_data FROM documents"


def f13(spark, d):
    c = tx.head_tail_truncate(T, 1000)
    return docs(spark, d).select(N, F.sha2(c["text"], 256).alias("sha"), c["cut"].alias("cut"))


F13 = """SELECT doc_id AS path, sha256(CASE WHEN length(text) > 1000 THEN left(text, 666) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(text, 334) ELSE text END) AS sha, length(text) > 1000 AS cut FROM documents"""


def f20(spark, d):
    """Orders' dates written in three formats in a sentence, read back."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("x"))
    said = F.concat(F.lit("on "), F.date_format("x", "yyyy-MM-dd"), F.lit(", "), F.date_format("x", "yyyy.M.d"), F.lit(" and "), F.date_format("x", "yyyy/MM/d"), F.lit(" again"))
    found = o.select("o_orderkey", fx.extract_dates(said).alias("f"))
    return found.select("o_orderkey", F.size("f").alias("n"), F.size(F.array_distinct(F.transform("f", lambda s: F.struct(s["y"], s["m"], s["d"])))).alias("kinds"), F.get("f", F.lit(0))["y"].alias("y"), F.get("f", F.lit(0))["d"].alias("d"))


F20 = "SELECT o_orderkey, 3 AS n, 1 AS kinds, CAST(year(o_orderdate) AS INT) AS y, CAST(day(o_orderdate) AS INT) AS d FROM orders"


def f21(spark, d):
    """Prices written with commas and zeros: the canonical form."""
    o = table(spark, d, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("said"))
    return o.select("o_orderkey", F.get(fx.extract_numbers(F.concat(F.lit("about "), "said", F.lit(" in all"))), F.lit(0))["canon"].alias("canon"))


F21 = "SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.2f', o_totalprice), '0+$', ''), '\\.$', '') AS canon FROM orders"


def f22(spark, d):
    """Quotes in whole texts, some of which are put between marks."""
    q = F.concat(F.when(F.col(N) % 3 == 0, F.lit("a “")).otherwise(F.lit('a "')), T, F.when(F.col(N) % 3 == 0, F.lit("” b")).otherwise(F.lit('" b')))
    return docs(spark, d).select(N, F.array_join(fx.extract_quotes(q), "|").alias("quotes"))


F22 = """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a “' || text || '” b' ELSE 'a "' || text || '" b' END AS t FROM documents)
SELECT doc_id AS path, array_to_string(list_transform(regexp_extract_all(t, '"[^"\\n]{10,}"|“[^”\\n]{10,}”|「[^」\\n]{10,}」|‘[^’\\n]{10,}’|『[^』\\n]{10,}』'), lambda x: substring(x, 2, length(x) - 2)), '|') AS quotes FROM q"""


def f23(spark, d):
    body = F.concat(T, F.when(F.col(N) % 7 == 0, "\n## Disputed  \nx").when(F.col(N) % 7 == 1, "\n### Disputed").otherwise(""))
    return docs(spark, d).select(N, tx.is_disputed(body).alias("disputed"), tx.is_refusal(F.when(F.col(N) % 3 == 0, F.lit(' "근거  없음". ')).otherwise(F.lit("근거 없음이지만"))).alias("refusal"))


F23 = "SELECT doc_id AS path, doc_id % 7 = 0 AS disputed, doc_id % 3 = 0 AS refusal FROM documents"


def f24(spark, d):
    """Page links as wiki links, some in code."""
    href = F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]+)"'), F.lit(1))
    text = F.array_join(F.transform(href, lambda h: F.concat(F.lit("[["), h, F.lit(".md|x]] `[[code]]` "))), " ")
    return table(spark, d, "pages").select("page_id", F.array_join(tx.wiki_links(text), ",").alias("links"))


F24 = "SELECT page_id, array_to_string(regexp_extract_all(html, '<a href=\"/([A-Za-z]+)\"', 1), ',') AS links FROM pages"


def f25(spark, d):
    k = F.col(N)
    a = F.concat(F.lit("x ["), k % 9, F.lit("] y ["), k % 4, F.lit("] z ["), k % 9, F.lit("]"))
    return docs(spark, d).select(N, F.array_join(tx.cite_markers(a).cast("array<string>"), ",").alias("marks"), tx.drop_bad_markers(a, F.lit(5)).alias("text"))


F25 = """SELECT doc_id AS path, CASE WHEN doc_id % 9 = doc_id % 4 THEN CAST(doc_id % 9 AS VARCHAR) ELSE (doc_id % 9) || ',' || (doc_id % 4) END AS marks,
'x ' || CASE WHEN doc_id % 9 BETWEEN 1 AND 5 THEN '[' || (doc_id % 9) || ']' ELSE '' END || ' y ' || CASE WHEN doc_id % 4 BETWEEN 1 AND 5 THEN '[' || (doc_id % 4) || ']' ELSE '' END || ' z ' || CASE WHEN doc_id % 9 BETWEEN 1 AND 5 THEN '[' || (doc_id % 9) || ']' ELSE '' END AS text FROM documents"""


def f26(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.thread_key(F.when(F.col("turn") > 1, F.concat(F.lit("<C"), "conv_id", F.lit("@x> <b@x>"))).otherwise(""), F.when(F.col("turn") == 1, F.concat(F.lit(" <C"), "conv_id", F.lit("@x>"))).otherwise(""), F.concat(F.lit("<c"), "conv_id", F.lit("@X>"))).alias("key"))


F26 = "SELECT conv_id, turn, 'c' || conv_id || '@x' AS key FROM conversations"


def f27(spark, d):
    s = F.concat(F.lower("source"), F.when(F.col("doc_id") % 4 == 0, "/Part").when(F.col("doc_id") % 4 == 1, "/con").when(F.col("doc_id") % 4 == 2, "/a/b/c/d").otherwise("/part-1"))
    return table(spark, d, "documents").select("doc_id", tx.valid_space(s).alias("ok"), tx.valid_filename(F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise("..txt"))).alias("file"), tx.is_temp_name(F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".TMP").otherwise(".md"))).alias("temp"))


F27 = "SELECT doc_id, doc_id % 4 = 3 AS ok, doc_id % 2 = 0 AS file, doc_id % 2 = 0 AS temp FROM documents"


def f30(spark, d):
    k = F.col("event_id") % 5
    msg = F.when(k == 0, "ValueError: Unsupported format").when(k == 1, "too large: 7").when(k == 2, "malformed zip").when(k == 3, "PermissionError").otherwise("boom")
    return table(spark, d, "events").select("event_id", tx.categorize_error(msg).alias("category"))


F30 = "SELECT event_id, ['unsupported', 'too-large', 'corrupt', 'no-access', 'failed'][event_id % 5 + 1] AS category FROM events"


def f31(spark, d):
    p = table(spark, d, "pages")
    c = tx.clean_note(F.concat(F.lit("a:"), "url"), F.lit("x\r\ny"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("ftp://x"))
    return p.select("page_id", c["text"].alias("text"), c["url"].alias("url"), (F.length(c["title"]) <= 60).alias("short"))


F31 = "SELECT page_id, 'x' || chr(10) || 'y' AS text, CASE WHEN page_id % 2 = 0 THEN url END AS url, true AS short FROM pages"


def f32(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    other = e.select(F.col("vec_id").alias("v2"), F.col("embedding").alias("e2"))
    return e.join(other, F.col("vec_id") + 1 == F.col("v2")).select("vec_id", F.round(vx.cosine("embedding", "e2"), 5).alias("cos"))


F32 = "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def f33(spark, d):
    return docs(spark, d).select(N, F.round(vx.norm(vx.hashed_bigram_embed(T)), 4).alias("norm"), F.lit(256).alias("dim"))


F33 = "SELECT doc_id AS path, 1.0::DOUBLE AS norm, 256 AS dim FROM documents"


def f34(spark, d):
    """Keys of model calls: as many as there are different texts."""
    return docs(spark, d).select(vx.cache_key(F.lit("m"), F.lit("system"), T, F.lit(0.3)).alias("k")).agg(F.count_distinct("k").alias("keys"), F.count(F.lit(1)).alias("rows"))


F34 = "SELECT count(DISTINCT text) AS keys, count(*) AS rows FROM documents"


def f35(spark, d):
    return docs(spark, d).select(N, tx.context_budget(F.length(T)).alias("budget"))


F35 = "SELECT doc_id AS path, CAST(greatest(1500, trunc((length(text) - 1500) * 9 / 10.0)) AS INT) AS budget FROM documents"


def f18(spark, d):
    """Which benchmark items occur in which documents, as facts."""
    b = table(spark, d, "benchmark").select("item_id", fx.fact_normalize("text").alias("pattern"))
    found = occurring(docs(spark, d), b, [N], fx.fact_normalize(T), whole_numbers=True)
    return found.join(b, "pattern").select("item_id", N)


F18 = """WITH b AS (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS fact FROM benchmark), t AS (SELECT doc_id AS path, regexp_replace(lower(text), '\\s+', '', 'g') AS norm FROM documents)
SELECT item_id, path FROM b JOIN t ON fact <> '' AND contains(norm, fact)"""


def s5(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_text("html").alias("text"))


def r12(spark, d):
    return sx.history_text(turns(spark, d)).select("conv", "turn", "search_text")


R12 = "SELECT conv_id AS conv, turn, concat_ws(' ', lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text) AS search_text FROM conversations WHERE role = 'user'"


QUERIES = {
    "f1_tokenize": (f1, F1), "f2_term_counts": (f2, F2), "f4_pii_mask": (f4, F4), "f6_mask_document": (f6, F6), "f7_pii_scan": (f7, F7), "f8_slugify": (f8, F8), "f10_titles": (f10, F10), "f12_text_sha": (f12, F12),
    "f13_head_tail_truncate": (f13, F13), "f18_fact_in": (f18, F18), "f20_extract_dates": (f20, F20), "f21_extract_numbers": (f21, F21), "f22_extract_quotes": (f22, F22), "f23_disputed_refusal": (f23, F23), "f24_wiki_links": (f24, F24),
    "f25_cite_markers": (f25, F25), "f26_thread_key": (f26, F26), "f27_valid_names": (f27, F27), "f30_categorize_error": (f30, F30), "f31_clean_note": (f31, F31), "f32_cosine": (f32, F32), "f33_hashed_bigram_embed": (f33, F33),
    "f34_cache_key": (f34, F34), "f35_context_budget": (f35, F35), "s5_html_to_text": (s5, None), "r12_history_text": (r12, R12),
}
