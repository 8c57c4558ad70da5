"""Queries of retrieval: documents are read by language, questions are the benchmark's."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import search as sx
from corpusloom.operators.postings import bm25_topk
from corpusloom.plans.tables import TOKENS_SQL, docs, index, questions, readable, table

STATS = f"""d AS (SELECT doc_id AS path, lang AS space, {TOKENS_SQL} AS t FROM documents WHERE lang IN ('en', 'fr')),
p AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(t) AS term FROM d) GROUP BY 1, 2), l AS (SELECT path, len(t) AS dl FROM d), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS_SQL}) AS term FROM benchmark)"""


def _bm25(k1=1.5, b=0.75):
    return f"""w AS (SELECT qid, path, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) AS w FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (path), n),
s AS (SELECT qid, path, round(sum(w), 6) AS score FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM s WHERE score > 0)"""


def r1(spark, d):
    postings, lengths = sx.postings_of(docs(spark, d))
    size, terms = sx.corpus_stats(postings, lengths, readable(spark, d))
    return terms.join(size, "acl_key").select("acl_key", "term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


R1 = f"WITH {STATS} SELECT 'en+fr' AS acl_key, term, df, n, round(avgdl, 6) AS avgdl FROM df, n"


def r2(spark, d):
    """The eight best readable documents of each question."""
    return bm25_topk(questions(spark, d), index(spark, d), readable(spark, d), 8, digits=6)


R2 = f"WITH {STATS}, {_bm25()} SELECT qid, path, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), "embedding", F.lit("m").alias("model"), "label")


def _seen(spark, d):
    return _vectors(spark, d).where("label < 5").select(F.lit("en+fr").alias("acl_key"), "path")


def _qvecs(spark, d):
    """The benchmark's items ask with the vectors of their numbers."""
    return questions(spark, d).join(_vectors(spark, d).select(F.col("path").alias("qid"), F.col("embedding").alias("qv")), "qid").select("qid", "acl_key", "qv")


def r4(spark, d):
    return sx.valid_vectors(_vectors(spark, d), "m", 64).select("path")


R4 = "SELECT vec_id AS path FROM embeddings WHERE abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 0.01"


def r5(spark, d):
    return sx.dense_topk(_qvecs(spark, d), _vectors(spark, d), _seen(spark, d), 0.05, 20, 5)


_DENSE = """dn AS (SELECT b.item_id AS qid, c.vec_id AS path, round(list_inner_product(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) AS cos FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id JOIN embeddings c ON c.label < 5),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, path) AS rank FROM dn WHERE cos > 0.05)"""
R5 = f"WITH {_DENSE} SELECT qid, path, cos, CAST(rank AS INT) AS rank FROM dr WHERE rank <= 20"


def r7(spark, d):
    """Hybrid: BM25 over readable documents and cosines over readable vectors, fused."""
    both = readable(spark, d).unionByName(_seen(spark, d)).distinct()
    out = sx.retrieve(questions(spark, d), docs(spark, d).where("space in ('en', 'fr')"), readable(spark, d), "bm25", top_k=20, digits=6, index=index(spark, d))
    dense = sx.dense_topk(_qvecs(spark, d), _vectors(spark, d), both.join(_seen(spark, d), ["acl_key", "path"], "left_semi"), 0.05, 20, 5)
    return sx.rrf_fuse(out, dense, 30, 1.0, 0.5, 8, 9)


R7 = f"""WITH {STATS}, {_bm25()}, {_DENSE}, f AS (SELECT qid, path, round(sum(s), 9) AS score FROM (SELECT qid, path, 1.0 / (30 + rank) AS s FROM r WHERE rank <= 20 UNION ALL SELECT qid, path, 0.5 / (30 + rank) FROM dr WHERE rank <= 20) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM f) SELECT qid, path, score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 8"""


def r8(spark, d):
    """The five documents of its language that are nearest to each benchmark item (read as a raw document)."""
    raw = table(spark, d, "benchmark").select(F.col("item_id").alias("raw_path"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("space"), "text")
    return sx.related_candidates(raw, docs(spark, d).where("space in ('en', 'fr')"), 5, 6)


R8 = f"""WITH d AS (SELECT doc_id AS path, lang AS space, {TOKENS_SQL} AS t FROM documents WHERE lang IN ('en', 'fr')), p AS (SELECT path, space, term, count(*) AS tf FROM (SELECT path, space, unnest(t) AS term FROM d) GROUP BY 1, 2, 3),
l AS (SELECT path, space, len(t) AS dl FROM d), n AS (SELECT space, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY 1), df AS (SELECT space, term, count(*) AS df FROM p GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS space, unnest({TOKENS_SQL}) AS term FROM benchmark),
w AS (SELECT qid, p.path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM q JOIN p USING (space, term) JOIN df USING (space, term) JOIN n USING (space) JOIN l ON l.path = p.path),
s AS (SELECT qid, path, round(sum(w), 6) AS score FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM s)
SELECT qid, path, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


def _packed(spark, d):
    t = table(spark, d, "conversations")
    hits = t.select(F.col("conv_id").alias("qid"), F.concat_ws("/", "conv_id", "turn").alias("path"), (F.col("turn") + 1).alias("rank"))
    bodies = t.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("body"))
    return hits, bodies


def r9(spark, d):
    """Turns as ranked articles, packed into 2,000 characters: what is in, how long, and whether something was cut."""
    out = sx.pack_context(*_packed(spark, d), budget=2000, cap=900)
    return out.select("qid", F.size("included").alias("n"), F.length("context").alias("size"), "truncated")


R9 = """WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(conv_id || '/' || turn) AS lp, least(length(text), 900) AS lb, length(text) > 900 AS c FROM conversations),
h AS (SELECT *, length('[' || n || '] ') + lp + 1 AS lh, CASE WHEN n > 1 THEN 2 ELSE 0 END AS sep FROM t),
f AS (SELECT conv_id, n, 0 AS used, false AS tr, 0 AS cnt, false AS stop, lh, lb, c, sep FROM h WHERE n = 1
UNION ALL SELECT conv_id, 0, 0, false, 0, false, 0, 0, false, 0 FROM h WHERE false),
g(conv_id, n, used, cnt, tr, stop) AS (SELECT conv_id, CAST(1 AS BIGINT), CAST(CASE WHEN lh + lb > 2000 THEN lh + greatest(2000 - lh - 20, 0) + 20 ELSE lh + lb END AS BIGINT), CAST(1 AS BIGINT), c OR lh + lb > 2000, lh + lb > 2000 FROM f
UNION ALL SELECT g.conv_id, h.n, CAST(CASE WHEN g.used + sep + lh + lb <= 2000 THEN g.used + sep + lh + lb WHEN 2000 - g.used - sep - lh < 300 THEN g.used ELSE 2000 END AS BIGINT),
CAST(CASE WHEN g.used + sep + lh + lb <= 2000 OR 2000 - g.used - sep - lh >= 300 THEN g.cnt + 1 ELSE g.cnt END AS BIGINT), g.tr OR h.c OR g.used + sep + lh + lb > 2000, g.used + sep + lh + lb > 2000
FROM g JOIN h ON h.conv_id = g.conv_id AND h.n = g.n + 1 WHERE NOT g.stop)
SELECT conv_id AS qid, CAST(max(cnt) AS INT) AS n, CAST(max(used) AS INT) AS size, bool_or(tr) AS truncated FROM g GROUP BY 1"""


def r11(spark, d):
    """Assistant turns as answers over their conversation's user turns: cited markers or all hits."""
    t = table(spark, d, "conversations")
    hits = t.where("role = 'user'").select(F.col("conv_id").alias("qid"), F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("body"), "turn")
    from pyspark.sql import Window

    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("turn"))).drop("turn")
    answers = t.groupBy("conv_id").agg(F.max("turn").alias("m")).select(F.col("conv_id").alias("qid"), F.concat(F.lit("a ["), F.col("m") % 3, F.lit("] b [9]")).alias("answer"), F.when(F.col("m") % 5 == 0, "refused").otherwise("answered").alias("status"))
    return sx.bind_citations(answers, hits).select("qid", "answer", F.array_join("citations", ",").alias("citations"))


R11 = """WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1), u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, count(*) AS k FROM u GROUP BY 1), a AS (SELECT m.conv_id, m, m % 3 AS x, coalesce(k, 0) AS k FROM m LEFT JOIN k USING (conv_id)),
b AS (SELECT *, x BETWEEN 1 AND k AS vx, 9 <= k AS v9 FROM a)
SELECT b.conv_id AS qid, 'a ' || CASE WHEN vx THEN '[' || x || ']' ELSE '' END || ' b ' || CASE WHEN v9 THEN '[9]' ELSE '' END AS answer,
coalesce(string_agg(u.conv_id || '/' || turn, ',' ORDER BY n) FILTER (WHERE m % 5 <> 0 AND CASE WHEN vx OR v9 THEN (vx AND n = x) OR (v9 AND n = 9) ELSE true END), '') AS citations FROM b LEFT JOIN u ON u.conv_id = b.conv_id GROUP BY b.conv_id, x, vx, v9"""


def r13(spark, d):
    """Embeddings brought up to date: one source's texts changed, one language is missing."""
    from corpusloom.functions import text as tx
    from corpusloom.functions import vectors as vx

    a = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("title"), F.col("text").alias("body"), "lang", "source")
    emb = a.where("lang <> 'es'").select("path", F.lit("m").alias("model"), F.when(F.col("source") == "src1", "old").otherwise(tx.text_sha(tx.embed_text("title", "body"))).alias("text_sha256"), F.lit(1).alias("dim"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return sx.refresh_embeddings(a, emb, vx.hashed_bigram_embed, "m")[1].withColumnRenamed("count", "n")


R13 = "SELECT CASE WHEN lang = 'es' OR source = 'src1' THEN 'embedded' ELSE 'fresh' END AS status, count(*) AS n FROM documents GROUP BY 1"


def r14(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("updated"))
    return sx.recent_articles(a, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path")), 50)


R14 = "SELECT o_orderkey AS path, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE o_orderstatus = 'F' ORDER BY 3 DESC, 1 LIMIT 50"

QUERIES = {
    "r1_corpus_stats": (r1, R1), "r2_bm25_topk": (r2, R2), "r4_valid_vectors": (r4, R4), "r5_dense_topk": (r5, R5), "r7_retrieve_hybrid": (r7, R7), "r8_related_candidates": (r8, R8),
    "r9_pack_context": (r9, R9), "r11_bind_citations": (r11, R11), "r13_refresh_embeddings": (r13, R13), "r14_recent_articles": (r14, R14),
}
