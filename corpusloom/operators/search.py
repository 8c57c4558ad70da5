"""Retrieval for tables of questions: statistics over readable documents only, BM25, dense, fusion, packing, citing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators.dense import nearest
from corpusloom.operators.postings import Index, bm25_topk, build_index


def postings_of(docs: DataFrame, doc: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(path, term, tf) and (path, dl); documents without tokens have length 0."""
    tokens = docs.select(F.col(doc).alias("path"), tx.tokenize(text).alias("tokens"))
    lengths = tokens.select("path", F.coalesce(F.size("tokens"), F.lit(0)).alias("dl"))
    return tokens.select("path", F.explode("tokens").alias("term")).groupBy("path", "term").agg(F.count(F.lit(1)).alias("tf")), lengths


def corpus_stats(postings: DataFrame, lengths: DataFrame, readable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acl_key, n, avgdl) and (acl_key, term, df), over the documents that a key may read and no others."""
    docs = readable.select("acl_key", "path").join(lengths, "path")
    size = docs.groupBy("acl_key").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = readable.select("acl_key", "path").join(postings, "path").groupBy("acl_key", "term").agg(F.count(F.lit(1)).alias("df"))
    return size, terms


def bm25_scores(queries: DataFrame, postings: DataFrame, lengths: DataFrame, readable: DataFrame, k1: float = 1.5, b: float = 0.75, digits: int | None = None) -> DataFrame:
    """qid, path, score > 0 of ``queries(qid, acl_key, text)``.

    Terms that no question asks are dropped before anything is shuffled by term; a score is summed in the order of its
    terms, so it does not depend on the shuffle.
    """
    asked = queries.select("qid", "acl_key", F.explode(F.array_distinct(tx.tokenize("text"))).alias("term"))
    few = postings.join(asked.select("term").distinct(), "term", "left_semi")
    keys = readable.select("acl_key", "path").join(queries.select("acl_key").distinct(), "acl_key", "left_semi")
    size, terms = corpus_stats(few, lengths, keys)
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.join(size, "acl_key").select("acl_key", "term", idf.alias("idf"), "avgdl")
    seen = few.join(lengths, "path").join(keys, "path")
    hits = asked.join(terms, ["acl_key", "term"]).join(seen, ["acl_key", "term"])
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = hits.select("qid", "path", "term", weight.alias("w")).groupBy("qid", "path").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["w"])
    scored = parts.select("qid", "path", (F.round(score, digits) if digits else score).alias("score"))
    return scored.where("score > 0")


def candidate_pool(scores: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The first n of each question by score, then path, with ``rank`` from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc(by), "path")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def valid_vectors(emb: DataFrame, model: str | None = None, dim: int | None = None) -> DataFrame:
    """Rows of the model whose vectors have the dimension, finite components and unit length (within 0.01)."""
    out = emb.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & (F.abs(vx.norm("embedding") - 1) < 0.01))
    out = out.where(F.col("model") == model) if model else out
    return out.where(F.size("embedding") == dim) if dim else out


def dense_topk(qvecs: DataFrame, emb: DataFrame, readable: DataFrame, min_cosine: float = 0.0, n: int = 50, digits: int | None = None) -> DataFrame:
    """qid, path, cos, rank of ``qvecs(qid, acl_key, qv)`` over the vectors that the asker's key may read.

    Products are made block by block; n rows of each question and block are shuffled.
    """
    keys = readable.select("acl_key", "path").join(qvecs.select("acl_key").distinct(), "acl_key", "left_semi")
    seen = emb.select("path", "embedding").join(keys, "path")
    return candidate_pool(nearest(qvecs, seen, min_cosine, n, digits), n, "cos")


def rrf_fuse(bm: DataFrame, dn: DataFrame, rrf_k: int = 60, w_bm25: float = 1.0, w_dense: float = 1.0, top_k: int = 8, digits: int | None = None) -> DataFrame:
    """qid, path, score, rank: reciprocal ranks of both lists, weighted and summed."""
    part = lambda df, w, o: df.select("qid", "path", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("s"), F.lit(o).alias("o"))
    both = part(bm, w_bm25, 0).unionByName(part(dn, w_dense, 1))
    # two terms at most, so the sum's order cannot matter
    total = F.sum("s")
    fused = both.groupBy("qid", "path").agg((F.round(total, digits) if digits else total).alias("score"))
    return candidate_pool(fused, top_k)


def retrieve(questions: DataFrame, docs: DataFrame, readable: DataFrame, mode: str = "hybrid", qvecs: DataFrame | None = None, emb: DataFrame | None = None, top_k: int = 8, pool: int = 20, rrf_k: int = 60, w_bm25: float = 1.0, w_dense: float = 1.0, min_cosine: float = 0.0, k1: float = 1.5, b: float = 0.75, digits: int | None = None, index: Index | None = None) -> DataFrame:
    """qid, path, score, rank for ``questions(qid, acl_key, text)``; access is applied before any statistic.

    Hybrid without vectors is BM25 alone; dense without vectors is empty.  BM25 reads ``index`` (of ``docs`` or more), or one
    made of ``docs``.
    """
    has = qvecs is not None and emb is not None
    if mode == "dense" and not has:
        return questions.limit(0).select("qid", F.lit("").alias("path"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if mode == "dense":
        return dense_topk(qvecs, emb, readable, min_cosine, min(pool, top_k), digits).withColumnRenamed("cos", "score")
    seen = readable if index is None else readable.join(docs.select("path"), "path", "left_semi")
    bm = bm25_topk(questions, index or build_index(docs), seen, pool if mode == "hybrid" and has else min(pool, top_k), k1, b, digits)
    if mode == "bm25" or not has:
        return bm
    return rrf_fuse(bm, dense_topk(qvecs, emb, readable, min_cosine, pool, digits), rrf_k, w_bm25, w_dense, top_k, digits)


def related_candidates(raw_docs: DataFrame, articles: DataFrame, n: int = 5, digits: int | None = None) -> DataFrame:
    """qid (raw_path), path, score, rank: the n best articles ``(path, space, text)`` of a raw document's space."""
    queries = raw_docs.select(F.col("raw_path").alias("qid"), F.col("space").alias("acl_key"), "text")
    readable = articles.select(F.col("space").alias("acl_key"), "path")
    return candidate_pool(bm25_scores(queries, *postings_of(articles), readable, digits=digits), n)


CUT = "[... truncated ...]"
MIN_TAIL = 300


def retry_budget(budget: Column | int, n_ctx: Column | None = None) -> Column:
    """Characters for a second try: half, and no more than 0.8 of what the size (in tokens) that the model reported leaves;
    300 at least."""
    half = F.floor((budget if isinstance(budget, Column) else F.lit(budget)) / 2)
    if n_ctx is not None:
        half = F.least(half, F.when(n_ctx > 0, F.floor(F.lit(0.8) * tx.context_budget(n_ctx))))  # null: half alone
    return F.greatest(F.lit(MIN_TAIL), half).cast("int")


def pack_context(hits: DataFrame, bodies: DataFrame, budget: int | None = None, cap: int | None = None) -> DataFrame:
    """qid, included, context, truncated: bodies in rank order into ``budget`` characters (without it: those that the
    column ``budget`` of ``hits`` gives each question).

    One running sum decides: the first row that overflows is cut to what is left (dropped, if something is included and
    under 300 characters are left), and everything after it is dropped.
    """
    body = F.col("body")
    budget = F.col("budget") if budget is None else F.lit(budget)
    rows = hits.select("qid", "path", "rank", budget.alias("budget")).join(bodies.select("path", "body"), "path")
    rows = rows.withColumn("capped", F.length(body) > cap if cap else F.lit(False)).withColumn("body", F.substring(body, 1, cap) if cap else body)
    order = Window.partitionBy("qid").orderBy("rank")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("head", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("path"), F.lit("\n")))
    size = F.length("head") + F.length("body") + F.when(F.col("n") > 1, 2).otherwise(0)
    rows = rows.withColumn("size", size).withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("over", F.col("before") + F.col("size") > F.col("budget"))
    rows = rows.withColumn("first_over", F.min(F.when(F.col("over"), F.col("n"))).over(Window.partitionBy("qid")))
    left = F.col("budget") - F.col("before") - F.when(F.col("n") > 1, 2).otherwise(0) - F.length("head")
    keep = F.col("first_over").isNull() | (F.col("n") < F.col("first_over")) | ((F.col("n") == F.col("first_over")) & ((F.col("n") == 1) | (left >= MIN_TAIL)))
    cut = F.col("n") == F.col("first_over")
    short = F.concat(F.substring(body, F.lit(1), F.greatest(left - len(CUT) - 1, F.lit(0)).cast("int")), F.lit("\n" + CUT))
    rows = rows.withColumn("entry", F.concat("head", F.when(cut, short).otherwise(body))).withColumn("keep", keep)
    kept = F.filter(F.array_sort(F.collect_list(F.struct("n", "path", "entry", "keep"))), lambda x: x["keep"])
    # a cap counts only for rows that were looked at, that is up to the first that overflowed
    seen = F.col("first_over").isNull() | (F.col("n") <= F.col("first_over"))
    out = rows.groupBy("qid").agg(kept.alias("k"), (F.bool_or(F.col("capped") & seen) | F.max("first_over").isNotNull()).alias("truncated"))
    return out.select("qid", F.transform("k", lambda x: x["path"]).alias("included"), F.array_join(F.transform("k", lambda x: x["entry"]), "\n\n").alias("context"), "truncated")


def answer(questions: DataFrame, packed: DataFrame, fn: Callable, repack: Callable[[DataFrame], DataFrame] | None = None, marker: str = "근거 없음", budget: int | None = None) -> DataFrame:
    """qid, answer, status (answered, refused, no-evidence, too-long) by a caller's vectorised function.

    ``fn`` is a ``mapInPandas`` function from (qid, text, context) to (qid, answer, too_long); rows that were too long
    are tried once more with the contexts that ``repack`` makes for them.  With ``budget``, that of the first contexts,
    ``fn`` gives n_ctx as well (the size in tokens that the model reported, or null), and ``repack`` gets (qid, budget) by
    ``retry_budget``, ready to be joined with hits for ``pack_context``; without it, qid alone.
    """
    asked = questions.select("qid", "text")
    ready = asked.join(packed.where("context <> ''").select("qid", "context"), "qid")
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, answer string, too_long boolean" + (", n_ctx int" if budget is not None else "")
    first = ready.mapInPandas(fn, schema)
    if repack is not None:
        again = first.where("too_long").select("qid", *([retry_budget(budget, F.col("n_ctx")).alias("budget")] if budget is not None else []))
        second = asked.join(repack(again).select("qid", "context"), "qid").mapInPandas(fn, schema)
        first = first.where("not too_long").unionByName(second).unionByName(first.where("too_long").join(second.select("qid"), "qid", "left_anti"))
    status = F.when(F.col("too_long"), "too-long").when(tx.is_refusal("answer", marker), "refused").otherwise("answered")
    none = asked.join(ready.select("qid"), "qid", "left_anti").select("qid", F.lit(marker).alias("answer"), F.lit("no-evidence").alias("status"))
    return first.select("qid", "answer", status.alias("status")).unionByName(none)


def bind_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, answer, citations, disputed of ``answers(qid, answer, status)`` and ``hits(qid, n, path, body)``.

    Cited are the distinct valid markers in ascending order, or all hits if there is none; refusals cite nothing.
    """
    per = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "path", tx.is_disputed("body").alias("disputed")))).alias("hits"))
    rows = answers.join(per, "qid", "left").withColumn("hits", F.coalesce("hits", F.array().cast(per.schema["hits"].dataType)))
    marks = F.filter(tx.cite_markers("answer"), lambda k: (k >= 1) & (k <= F.size("hits")))
    rows = rows.withColumn("marks", marks).withColumn("cited", F.when(F.col("status") != "answered", F.filter("hits", lambda h: F.lit(False))).when(F.size("marks") > 0, F.filter("hits", lambda h: F.array_contains("marks", h["n"].cast("int")))).otherwise(F.col("hits")))
    return rows.select("qid", tx.drop_bad_markers("answer", F.size("hits")).alias("answer"), F.transform("cited", lambda h: h["path"]).alias("citations"), F.exists("cited", lambda h: h["disputed"]).alias("disputed"))


def history_text(turns: DataFrame) -> DataFrame:
    """``turns(conv, turn, text)`` with ``search_text``: the question before it and the question."""
    before = F.lag("text").over(Window.partitionBy("conv").orderBy("turn"))
    return turns.withColumn("search_text", F.concat_ws(" ", before, "text"))


def refresh_embeddings(articles: DataFrame, emb: DataFrame, fn, model: str) -> tuple[DataFrame, DataFrame]:
    """(embeddings, status counts): only rows of another model or text are embedded again by ``fn`` (a pandas UDF);
    where it gives null the stale vector goes."""
    want = articles.select("path", F.lit(model).alias("model"), tx.text_sha(tx.embed_text("title", "body")).alias("text_sha256"), tx.embed_text("title", "body").alias("text"))
    key = ["path", "model", "text_sha256"]
    fresh = emb.join(want.select(*key), key, "left_semi")
    todo = want.join(fresh.select(*key), key, "left_anti").withColumn("embedding", fn("text"))
    done = todo.where("embedding is not null").select(*key, F.size("embedding").alias("dim"), "embedding")
    out = fresh.select("path", "model", "text_sha256", "dim", "embedding").unionByName(done)
    counts = todo.select(F.when(F.col("embedding").isNull(), "failed").otherwise("embedded").alias("status")).unionByName(fresh.select(F.lit("fresh").alias("status"))).groupBy("status").count()
    return out, counts


def recent_articles(articles: DataFrame, readable: DataFrame, limit: int = 20) -> DataFrame:
    """The newest readable articles: updated descending, then path."""
    return articles.join(readable.select("path").distinct(), "path", "left_semi").select("path", "title", "updated").orderBy(F.desc("updated"), "path").limit(max(1, min(50, limit)))
