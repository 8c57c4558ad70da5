"""Operators on small tables, with values worked out by hand, and metamorphic and randomised rules."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import access as ax
from corpusloom.operators import decisions as dx
from corpusloom.operators import evaluation as ex
from corpusloom.operators import grids
from corpusloom.operators import grounding as gx
from corpusloom.operators import quality as qx
from corpusloom.operators import reports as rx
from corpusloom.operators import search as sx


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_readable_articles_rule(spark):
    rng = random.Random(1)
    spaces = ["a", "b", "c", "d"]
    raw = [(f"raw/{i}", rng.choice([*spaces, "", None])) for i in range(12)]
    edges = [(f"p{i}", f"raw/{rng.randrange(14)}") for i in range(60) for _ in range(rng.randrange(4))]
    users = [(f"u{k}", list(s)) for k, s in enumerate(itertools.chain.from_iterable(itertools.combinations(spaces, n) for n in range(5)))]
    got = ax.readable_articles(spark.createDataFrame(edges, "article_path string, raw_path string"), spark.createDataFrame([(a, b, "h") for a, b in raw], "raw_path string, space string, sha256 string"), spark.createDataFrame(users, "user_id string, spaces array<string>"))
    keys = {r.acl_key: set(r.spaces) for r in ax.acl_keys(spark.createDataFrame(users, "user_id string, spaces array<string>")).collect()}
    labels = dict(raw)
    want = set()
    for key, held in keys.items():
        for p in {e[0] for e in edges}:
            have = [labels.get(r) for q, r in edges if q == p]
            if all(h and h in held for h in have):
                want.add((key, p))
    assert {tuple(r) for r in got.select("acl_key", "path").collect()} == want


def test_unreadable_document_changes_nothing(spark):
    docs = [(f"d{i}", f"alpha beta {'gamma ' * (i % 3)} word{i}", [1.0, i / 10.0]) for i in range(8)]
    q = spark.createDataFrame([(1, "k", "alpha gamma word3")], "qid long, acl_key string, text string")
    qv = spark.createDataFrame([(1, "k", [1.0, 0.5])], "qid long, acl_key string, qv array<double>")
    read = spark.createDataFrame([("k", f"d{i}") for i in range(8)], "acl_key string, path string")
    make = lambda d: spark.createDataFrame(d, "path string, text string, embedding array<double>")
    for mode in ("bm25", "dense", "hybrid"):
        run = lambda d: rows(sx.retrieve(q, d.select("path", "text"), read, mode, qv, d.select("path", "embedding"), top_k=5))
        assert run(make(docs)) == run(make([*docs, ("secret", "alpha gamma word3 alpha gamma word3", [1.0, 0.5])]))


def test_modes_without_vectors(spark):
    q = spark.createDataFrame([(1, "k", "alpha")], "qid long, acl_key string, text string")
    d = spark.createDataFrame([("a", "alpha x"), ("b", "y")], "path string, text string")
    read = spark.createDataFrame([("k", "a"), ("k", "b")], "acl_key string, path string")
    assert rows(sx.retrieve(q, d, read, "hybrid"), "path") == [("a",)]
    assert sx.retrieve(q, d, read, "dense").count() == 0


def test_policy_alias_and_spaces(spark):
    s = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("x",)], "space string")
    p = spark.createDataFrame([("a", False), ("a/b", True)], "space string, flag boolean")
    assert rows(ax.policy_for_space(s, p, True)) == [("a", False), ("a/b", True), ("a/b/c", True), ("x", True)]
    f = spark.createDataFrame([("Sales/EU",), ("other",)], "folder string")
    al = spark.createDataFrame([("sales", "dept-a"), ("SALES/eu", "dept-b")], "alias string, space string")
    assert {tuple(r) for r in ax.resolve_alias(f, al).collect()} == {("Sales/EU", "dept-b"), ("other", None)}


def test_pack_context_is_the_sequential_rule(spark):
    rng = random.Random(2)
    data, want = [], {}
    for q in range(60):
        bodies = ["x" * rng.choice([10, 200, 350, 700, 1500]) for _ in range(rng.randint(1, 6))]
        used, kept, cut = 0, 0, False
        for i, body in enumerate(bodies):
            data.append((q, f"p{q}-{i}", i + 1, body))
        for i, body in enumerate(bodies):
            if len(body) > 900:
                body, cut = body[:900], True
            head, sep = f"[{kept + 1}] p{q}-{i}\n", 2 if kept else 0
            left = 1200 - used - sep - len(head)
            if len(head) + len(body) > 1200 - used - sep:
                cut = True
                if kept and left < 300:
                    break
                body = body[: max(left - len(sx.CUT) - 1, 0)] + "\n" + sx.CUT
            used += len(head) + len(body) + sep
            kept += 1
        want[q] = (kept, used, cut)
    df = spark.createDataFrame(data, "qid long, path string, rank int, body string")
    got = {r.qid: (len(r.included), len(r.context), r.truncated) for r in sx.pack_context(df, df.select("path", "body"), 1200, 900).collect()}
    assert got == want


def test_answer_and_citations(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid long, text string")
    packed = spark.createDataFrame([(1, "ctx"), (2, "long" * 50)], "qid long, context string")

    def fn(parts):
        for p in parts:
            yield pd.DataFrame({"qid": p["qid"], "answer": ["근거 없음" if len(c) == 100 else "yes [1] [7]" for c in p["context"]], "too_long": [len(c) > 150 for c in p["context"]]})

    halve = lambda ids: packed.join(ids, "qid").withColumn("context", F.substring("context", 1, 100))
    out = sx.answer(q, packed, fn, halve)
    assert rows(out, "qid", "status") == [(1, "answered"), (2, "refused"), (3, "no-evidence")]
    hits = spark.createDataFrame([(1, 1, "p", "x"), (1, 2, "q", "## Disputed\n")], "qid long, n int, path string, body string")
    bound = {r.qid: r for r in sx.bind_citations(out, hits).collect()}
    assert (bound[1].answer, bound[1].citations, bound[1].disputed) == ("yes [1] ", ["p"], False)
    assert bound[2].citations == [] and bound[3].citations == []


def test_metrics_by_hand(spark):
    qa = spark.createDataFrame([(1, ["a", "c"], ["x"]), (2, [], []), (3, ["c"], [])], "id long, gold_docs array<string>, stale_docs array<string>")
    hd = spark.createDataFrame([(1, "h1", 1, ["a"]), (1, "h2", 2, ["x"]), (1, "h3", 3, ["c"]), (3, "h1", 1, ["a"]), (3, "h2", 2, ["x"]), (3, "h3", 3, ["c"])], "qid long, path string, rank int, docs array<string>")
    assert rows(ex.recall_at_k(hd, qa, 2)) == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert rows(ex.recall_at_k(hd, qa, 3)) == [(1, 1.0), (2, 0.0), (3, 1.0)]
    assert rows(ex.hit_at_k(hd, qa, 2))[2] == (3, 0.0)
    assert rows(ex.mrr(hd, qa))[2] == (3, pytest.approx(1 / 3))
    n = qa.select("id", F.size("gold_docs").alias("n_relevant"))
    assert rows(ex.ndcg_at_k(hd, qa, 3, n))[0][1] == pytest.approx(1.5 / (1 + 1 / 1.5849625007211562))
    assert rows(ex.stale_top1(hd, qa))[0] == (1, False)


def test_latency(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 101)] + [("b", x) for x in (10.0, 20.0, 30.0)], "g string, latency_ms double")
    assert rows(rx.latency_stats(df, ["g"])) == [("a", 50.0, 95.0, 50.5), ("b", 20.0, 30.0, 20.0)]


def test_reports(spark):
    d = "no-evidence"
    data = [(1, "u", "query", "why", d), (2, "u", "query", " why ", d), (3, "u", "query", "why", d), (4, "u", "query", "other", d), (5, "u", "query", "ok", ""), (6, "u", "feedback_down", "p", ""), (7, "u", "feedback_down", "-", "")]
    audit = spark.createDataFrame(data, "id long, user_id string, action string, target string, detail string")
    assert [tuple(r) for r in rx.gaps_report(audit, 5).collect()] == [(3, "why"), (1, "other")]
    assert rows(rx.usage_stats(audit)) == [(5, 4, 1, 0, 2)]
    assert rows(rx.feedback_report(audit)) == [("p", 1, 0)]
    with pytest.raises(ValueError):
        rx.audit_retention(audit, 7, F.current_timestamp())
    f = spark.createDataFrame([("E", "a"), ("E", "a"), ("W", "b")], "level string, kind string")
    assert rows(rx.findings_summary(f)) == [("E", 1), ("W", 1)]
    leaks = spark.createDataFrame([(["x"],), ([],)], "leak array<string>")
    assert rx.leak_count(leaks).first()[0] == 1


def test_round_robin_and_names(spark):
    jobs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A"), (5, "B"), (6, "C")], "id long, space string")
    assert [r.id for r in rx.round_robin(jobs).collect()] == [1, 5, 6, 2, 3, 4]
    att = spark.createDataFrame([("m", 1, "a.txt"), ("m", 2, "A.txt"), ("m", 3, "a-2.txt"), ("m", 4, "a.TXT")], "mail string, pos int, name string")
    names = [r.unique_name.lower() for r in rx.attachment_names(att).collect()]
    assert len(set(names)) == 4
    new = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "x", "s"), (4, "y", "s")], "id long, base string, space string")
    old = spark.createDataFrame([("x-s",), ("y",)], "path string")
    assert rows(rx.unique_paths(new, old)) == [(1, "x"), (2, "x-s-2"), (3, "x-s-3"), (4, "y-s")]


def test_grounding(spark):
    raw = spark.createDataFrame([(1, "날짜 2026-09-30 합계 1,120"), (2, "합계 11,200"), (3, "값 13.5"), (4, "값 1,200"), (5, "2026-09-30"), (6, "그는 '아무 말' 했다")], "id long, text string")
    body = spark.createDataFrame([(1, "매출 20"), (2, "합계 1,200"), (3, "값 3.5"), (4, "값 1,200."), (5, "2026년 9월 30일 2026.09.30 2026/9/30 2026.10.30 2026-09-31"), (6, "‘열 글자가 넘는 긴 인용문’ ‘짧은’")], "id long, body string")
    assert rows(gx.ungrounded_claims(body, raw)) == [(1, "number", "20"), (2, "number", "1,200"), (3, "number", "3.5"), (5, "date", "2026-09-31"), (5, "date", "2026.10.30"), (6, "quote", "열 글자가 넘는 긴 인용문")]


def _vault(spark, change=None):
    f = lambda **k: {a: b if isinstance(b, list) else [b] for a, b in k.items()}
    pages = {
        "20_ai_wiki/_index.md": ({}, "[[A]] (updated: 2026-05-01)\n[[B]]\n"), "20_ai_wiki/_log.md": ({}, "[[r2]] no material\n"),
        "20_ai_wiki/A.md": (f(topic="t", updated="2026-05-01", sources=["[[r1]]"], status="final"), "see [[B]] 42 items"),
        "20_ai_wiki/B.md": (f(topic="t", updated="2026-05-02", sources=["[[r1]]"], status="final"), "see [[A]]"),
        "30_outputs/O.md": (f(date="2026-05-03", based_on=["[[A]]"]), "42 items in [[A]]"),
        "10_raw_data/r1.md": (f(date="d", source="s"), "42 items"), "10_raw_data/r2.md": (f(date="d", source="s"), "nothing"),
    }
    if change:
        change(pages, f)
    data = [(p.split("/")[0], p, p.split("/")[-1][:-3], front, body) for p, (front, body) in pages.items()]
    return spark.createDataFrame(data, "folder string, path string, name string, front map<string,array<string>>, body string")


def _set(path, front=None, body=None):
    def change(pages, f):
        old = pages.get(path, ({}, ""))
        pages[path] = ({**old[0], **(f(**front) if front else {})}, old[1] if body is None else body)
    return change


@pytest.mark.parametrize("change, kind", [
    (None, None), (_set("20_ai_wiki/A.md", body="see [[B]] [[zz]] 42 items"), "broken-link"), (_set("20_ai_wiki/A.md", {"status": ""}), "missing-frontmatter"), (_set("20_ai_wiki/B.md", {"sources": ["[[none]]"]}), "bad-source"),
    (_set("20_ai_wiki/A.md", body="see [[B]] 43 items"), "ungrounded-number"), (_set("20_ai_wiki/A.md", body="see [[B]] 42 items\n\n> **Status: Disputed**\n"), "bad-status"), (_set("20_ai_wiki/B.md", {"status": "draft", "updated": "2026-01-01"}), "stale-draft"),
    (_set("20_ai_wiki/A.md", {"visibility": "private"}), "private-in-output"), (_set("20_ai_wiki/_index.md", body="[[B]]"), "index-missing"), (_set("20_ai_wiki/_index.md", body="[[A]] [[B]] [[O]]"), "index-dangling"),
    (_set("20_ai_wiki/_index.md", body="[[A]] (updated: 2026-05-09) [[B]]"), "index-date"), (_set("20_ai_wiki/A.md", body="42 items"), "orphan"), (_set("10_raw_data/r3.md", {"date": "d", "source": "s"}, "x"), "raw-unprocessed"),
    (_set("30_outputs/A.md", {"date": "d", "based_on": ["[[A]]"]}, "x"), "ambiguous-name"),
])
def test_vault_findings(spark, change, kind):
    found = {r.kind for r in qx.check_vault(_vault(spark, change), "2026-06-01").collect()}
    assert found == ({kind} if kind else set())


def test_verify_qa(spark):
    schema = "id string, space string, question string, type string, gold_docs array<string>, gold_facts array<string>, leak_facts array<string>, stale_docs array<string>"
    qa = spark.createDataFrame([("1", "s", "q", "lookup", ["d1"], ["fact"], [], []), ("1", "s", "", "multi_doc", ["d1"], ["no"], [], ["zz"]), ("2", "s", "q", "lookup", ["d9"], [], [], []), ("3", "s", "q", "lookup", ["d2"], [], [], [])], schema)
    docs = spark.createDataFrame([("d1", "s", "a fact"), ("d2", "t", "x")], "doc string, space string, text string")
    assert {r.problem for r in qx.verify_qa(qa, docs).collect()} == {"repeated-id", "empty-field", "gold-missing", "gold-other-space", "fact-missing", "stale-missing", "one-document"}


def test_decisions(spark):
    reply = lambda **k: __import__("json").dumps({"decision": "New", "target": None, "topic": "t", "title": "T", "body": "b", "related": []} | k)
    replies = [("r1", reply()), ("r2", "nonsense"), ("r3", reply(decision="Update", target="zz")), ("r4", reply(decision="No material")), ("r5", reply(decision="Update", target="c", body="x" * 7)), ("r6", reply(decision="Update", target="c", body="x")), ("r7", "<think>x</think>" + reply(decision="Disputed", target="c", body="but")), ("r8", reply(decision="Update", target="c", title="", body="x" * 9)), ("r9", reply(decision="Update", target="c", body=" "))]
    cands = spark.createDataFrame([(f"r{i}", "c", "0123456789") for i in range(1, 10)], "raw_path string, path string, body string")
    raw = spark.createDataFrame([(f"r{i}", "# Head\n\n1 2 3" if i == 4 else "# Head\n\ntext") for i in range(1, 10)], "raw_path string, text string")
    v = dx.validate_decisions(spark.createDataFrame(replies, "raw_path string, reply string"), cands, raw)
    want = {"r1": None, "r2": "invalid-reply", "r3": "bad-target", "r4": "no-material-with-data", "r5": None, "r6": "shrink", "r7": None, "r8": "empty-title", "r9": "empty-body"}
    assert {r.raw_path: r.reason for r in v.collect()} == want
    articles = spark.createDataFrame([("c", "C", "0123456789", ["r0"])], "path string, title string, body string, sources array<string>")
    done = {r.path: r for r in dx.apply_decisions(v, articles, raw).collect()}
    assert done["c"].body == "xxxxxxx\n\n## Disputed\nbut\n(Source: r7)" and done["c"].sources == ["r0", "r5", "r7"]
    assert done["t/t.md"].body == "b" and done["general/head.md"].title == "Head"


def test_evaluation_helpers(spark):
    space = {"x": [0, 2, 4, 8], "y": [0.0, 0.5, 1.0], "mode": ["a", "b"]}
    score = lambda c: -((c["x"] - 3) ** 2) - (c["y"] - 0.5) ** 2 + 0.5 * (c["mode"] == "b")
    best, s = ex.refine({"x": 2, "y": 0.0, "mode": "a"}, score({"x": 2, "y": 0.0, "mode": "a"}), space, lambda cs: [score(c) for c in cs], rounds=6)
    assert best == {"x": 3, "y": 0.5, "mode": "b"} and s == 0.5
    used = spark.createDataFrame([("h",)], "hash string")
    with pytest.raises(ValueError):
        ex.heldout_guard("h", used)
    ex.heldout_guard("other", used)
    assert ex.sample_grid(spark, {"retrieval_mode": ["hybrid"], "top_k": [1, 2, 3], "rrf_k": [30, 60]}, 4).count() == 4
    diff = ex.chosen_vs_default(spark.createDataFrame([(1, "a")], "k int, m string"), spark.createDataFrame([(1, "b")], "k int, m string"))
    assert rows(diff) == [("m", "a", "b")]
    hits = spark.createDataFrame([("q", "art", 1)], "qid string, path string, rank int")
    sources = spark.createDataFrame([("art", "raw/1")], "article_path string, raw_path string")
    gold = spark.createDataFrame([("d", "s", ["raw/1"], ["art", "b"])], "doc string, space string, raw_paths array<string>, articles array<string>")
    qa = spark.createDataFrame([("q", "lookup", "s", "tune", ["d"], [])], "id string, type string, space string, split string, gold_docs array<string>, stale_docs array<string>")
    row = ex.evaluate(hits, sources, gold, qa, 3).first()
    assert (row.recall, row.mrr, row.type) == (1.0, 1.0, "lookup") and row.ndcg < 1


def test_grids(spark):
    cells = spark.createDataFrame([("s", 0, 1, "A"), ("s", 0, 2, None), ("s", 1, 1, "B"), ("s", 1, 2, "C"), ("s", 2, 0, "row"), ("s", 2, 1, "1"), ("s", 2, 2, "2"), ("s", 3, 0, None), ("s", 3, 1, "3")], "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([("s", 0, 1, 1, 9), ("s", 2, 0, 2, 1)], "sheet string, r0 int, c0 int, rowspan int, colspan int")
    full = grids.expand_merges(cells, merges)
    assert {(r.row, r.col): r.value for r in full.collect()}[0, 2] == "A" and {(r.row, r.col): r.value for r in full.collect()}[3, 0] == "row"
    assert rows(grids.flatten_table(full, 2, 1), "label", "header", "value") == [("row", "A > B", "1"), ("row", "A > B", "3"), ("row", "A > C", "2")]


def test_sweep_scores_every_configuration(spark):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red hen")], "path string, text string")
    asked = spark.createDataFrame([("q", "k", "red fox")], "qid string, acl_key string, text string")
    readable = spark.createDataFrame([("k", "a"), ("k", "b")], "acl_key string, path string")
    n = F.col("id")
    for count in (3, 10_200):
        configs = spark.range(count).select(n.cast("string").alias("hash"), (0.5 + n / count).alias("bm25_k1"), F.lit(0.5).alias("bm25_b"), F.lit(2).alias("top_k"))
        out = ex.sweep_scores(asked, docs, readable, configs)
        assert out.groupBy("hash").agg(F.count("path").alias("n")).where("n = 2").count() == count


def test_sweep_retrieval_is_retrieve_for_each_configuration(spark):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red hen"), ("c", "blue fox fox"), ("d", "grey")], "path string, text string")
    asked = spark.createDataFrame([("q", "k", "red fox"), ("r", "k", "grey hen")], "qid string, acl_key string, text string")
    readable = spark.createDataFrame([("k", p) for p in "abc"], "acl_key string, path string")
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("d", [0.8, 0.6])], "path string, embedding array<float>")
    qvecs = spark.createDataFrame([("q", "k", [0.6, 0.8]), ("r", "k", [1.0, 0.0])], "qid string, acl_key string, qv array<float>")
    space = {"retrieval_mode": ["bm25", "dense", "hybrid"], "top_k": [2], "pool": [2, 3], "rrf_k": [5], "w_bm25": [1.0], "w_dense": [0.5], "bm25_k1": [1.2], "bm25_b": [0.5], "min_cosine": [0.1, 0.7]}
    configs = ex.grid(spark, space)
    got = ex.sweep_retrieval(asked, docs, readable, configs, qvecs, emb, 6).collect()
    for c in configs.collect():
        one = sx.retrieve(asked, docs, readable, c.retrieval_mode, qvecs, emb, c.top_k, c.pool, c.rrf_k, c.w_bm25, c.w_dense, c.min_cosine, c.bm25_k1, c.bm25_b, 6)
        want = sorted((r.qid, r.path, round(r.score, 6), r["rank"]) for r in one.collect())
        assert want and sorted((r.qid, r.path, round(r.score, 6), r["rank"]) for r in got if r.hash == c.hash) == want
    assert ex.sweep_retrieval(asked, docs, readable, configs.limit(0), qvecs, emb).count() == 0
    assert rows(ex.used_heldout(configs.select("hash"), configs.select("hash").limit(0))) == []


def test_decisions_on_one_target_keep_their_order(spark):
    schema = "raw_path string, decision string, target string, topic string, title string, body string, reason string"
    steps = [("r1", "Disputed", "one"), ("r2", "Update", "two"), ("r3", "Disputed", None), ("r4", "Disputed", "four")]
    decisions = spark.createDataFrame([(r, d, "c", None, None, b, None) for r, d, b in steps] + [("r5", "Disputed", "e", None, None, "x", None), ("r6", "Update", "gone", None, None, "x", None)], schema)
    articles = spark.createDataFrame([("c", "C", "old", ["r2"]), ("e", "E", None, None)], "path string, title string, body string, sources array<string>")
    raw = spark.createDataFrame([(f"r{i}", "text") for i in range(1, 7)], "raw_path string, text string")
    done = {r.path: r for r in dx.apply_decisions(decisions, articles, raw).collect()}
    assert set(done) == {"c", "e"}
    assert done["c"].body == "two\n\n## Disputed\n\n(Source: r3)\n\n## Disputed\nfour\n(Source: r4)" and done["c"].sources == ["r2", "r1", "r3", "r4"]
    assert done["e"].body == "\n\n## Disputed\nx\n(Source: r5)" and done["e"].sources == ["r5"]


def test_failures_and_index_lines_are_rows(spark):
    results = spark.createDataFrame([("a", "done"), ("b", "failed"), ("c", "failed"), ("d", "duplicate")], "raw_path string, status string")
    out = rx.ingest_summary(results, spark.createDataFrame([("a", "x")], "raw_path string, article_path string"), spark.createDataFrame([("x",)], "path string"))
    assert out.first().asDict() == {"done": 1, "failed": 2, "duplicate": 1, "articles": 1, "embedded": 1, "without_article": 0}
    assert rows(rx.ingest_failures(results)) == [("b",), ("c",)]
    wiki = lambda name, body: (qx.WIKI, f"w/{name}", name, {"updated": ["2026-01-01"]}, body)
    lines = ["[[a]] (updated: 2026-01-01)", "[[b]] (updated: 2026-01-02)", "[[gone]]", "see [[gone]]"]
    pages = [wiki("a", ""), wiki("b", ""), wiki("c", "")]
    schema = "folder string, path string, name string, front map<string,array<string>>, body string"
    found = [rows(qx.index_check(spark.createDataFrame([*pages, *(wiki("_index", x) for x in index)], schema))) for index in (["\n".join(lines)], lines)]
    assert found[0] == found[1] and len(found[0]) == 3


def test_refine_keeps_to_bounds_and_ranges():
    near = ex.neighbours({"x": 8, "y": 0.5, "mode": "a"}, {"x": [0, 2, 4, 8], "y": (0.0, 1.0), "mode": ["a", "b"]}, {"x": (0, 10)})
    assert sorted(c["x"] for c in near if c["x"] != 8) == [4, 6, 10]
    assert sorted(c["y"] for c in near if c["y"] != 0.5) == [0.375, 0.4375, 0.5625, 0.625]
    assert [c for c in near if c["mode"] == "b"] == [{"x": 8, "y": 0.5, "mode": "b"}]
    assert {c["x"] for c in ex.neighbours({"x": 8}, {"x": [4, 8]})} == {4, 6}
    score = lambda c: -abs(c["x"] - 15)
    best, s = ex.refine({"x": 8}, score({"x": 8}), {"x": [4, 8]}, lambda cs: [score(c) for c in cs], rounds=9, bounds={"x": (0, 14)})
    assert (best, s) == ({"x": 14}, -1)
