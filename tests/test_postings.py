"""Lists from the saved index against full scoring, for any settings, and what a block may hide."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ex
from corpusloom.operators import postings as px
from corpusloom.operators import search as sx


def corpus(spark, seed, n=160):
    """Texts of very common, common and rare words; some empty or null, some repeated."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [60 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 10, 40, 200]))) for _ in range(n)]
    rows = [(i, None if i % 37 == 5 else texts[i % 50] if i % 11 == 0 else texts[i]) for i in range(n)]
    docs = spark.createDataFrame(rows, "path long, text string")
    readable = spark.createDataFrame([(k, i) for k, i in [("a", i) for i in range(n) if i % 3] + [("b", i) for i in range(0, n, 2)]], "acl_key string, path long")
    asked = [(f"q{i}", rng.choice("ab"), " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 15])))) for i in range(14)]
    asked += [("none", "a", "absent words"), ("empty", "b", ""), ("null", "a", None), ("all", "a", " ".join(vocabulary)), ("other", "c", "w1")]
    return docs, readable, spark.createDataFrame(asked, "qid string, acl_key string, text string")


def test_lists_equal_full_scoring(spark):
    for seed, digits in ((1, 6), (2, None), (3, 1)):  # one digit: many equal scores, decided by path
        docs, readable, asked = corpus(spark, seed)
        configs = spark.createDataFrame([("h1", 0.9, 0.4, 3), ("h2", 1.5, 0.75, 3), ("h3", 2.0, 1.0, 12), ("h4", 1.2, 0.0, 1)], "hash string, bm25_k1 double, bm25_b double, top_k int")
        index = px.build_index(docs, block=8)
        got = sorted((r.hash, r.qid, r["rank"], r.path, round(r.score, 9)) for r in px.bm25_lists(asked, index, readable, configs, digits).collect())
        want = []
        for c in configs.collect():
            full = sx.candidate_pool(sx.bm25_scores(asked, *sx.postings_of(docs), readable, c.bm25_k1, c.bm25_b, digits), c.top_k)
            want += [(c.hash, r.qid, r["rank"], r.path, round(r.score, 9)) for r in full.collect()]
        assert want and got == sorted(want)
        assert sorted(map(str, ex.sweep_scores(asked, docs, readable, configs, digits).collect())) == sorted(map(str, px.bm25_lists(asked, index, readable, configs, digits).collect()))


def test_unreadable_documents_change_nothing(spark):
    docs, readable, asked = corpus(spark, 4)
    more = docs.unionByName(spark.createDataFrame([(1000 + i, " ".join(f"w{j}" for j in range(60))) for i in range(40)], docs.schema))
    one = px.bm25_topk(asked, px.build_index(docs, block=8), readable, 5, digits=6)
    two = px.bm25_topk(asked, px.build_index(more, block=8), readable, 5, digits=6)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    # an index of more documents than are searched
    some = docs.where("path % 5 <> 1")
    index = px.build_index(more, block=8)
    left = sx.retrieve(asked, some, readable, "bm25", top_k=5, digits=6, index=index)
    right = sx.retrieve(asked, some, readable.join(some.select("path"), "path", "left_semi"), "bm25", top_k=5, digits=6)
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_index_is_found_again_for_the_same_files(spark, tmp_path):
    docs, _, _ = corpus(spark, 5)
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = px.index_of(read(), "t")
    assert sorted(px.index_of(read(), "t").postings.inputFiles()) == sorted(first.postings.inputFiles())
    docs.limit(3).write.mode("append").parquet(path)
    again = px.index_of(read(), "t")
    assert sorted(again.postings.inputFiles()) != sorted(first.postings.inputFiles()) and again.lengths.count() == docs.count() + 3
    term = first.postings.where("term = 'w0'").select(F.explode("paths").alias("path"))
    assert term.count() == term.distinct().count() == docs.where("text rlike '\\\\bw0\\\\b'").count()
    assert px.build_index(docs.limit(0)).lengths.count() == 0
