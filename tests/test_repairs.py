"""Names, paths and configurations that were once given wrongly."""

import datetime

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import decisions as dx
from corpusloom.operators import evaluation as ex
from corpusloom.operators.ordering import positions, running_sum
from corpusloom.sources import files as src
from corpusloom.streaming import jobs as sj


def test_raw_slug_squeezes_and_trims(spark):
    titles = {"Report - 2026": "report-2026", "a" * 59 + " - b": "a" * 59, "--_x_--": "x", "주간  회의!": "주간-회의", "***": "untitled", "": "untitled", "x_y": "x_y"}
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", tx.raw_slug("t").alias("s"))
    assert {r.t: r.s for r in df.collect()} == titles


PARSED = "title string, text string, source_name string, published date, space string"
DAY = datetime.date(2026, 9, 30)


def save(spark, notes, old=()):
    """{(title, text): path} of notes in one space, and the rows."""
    known = spark.createDataFrame([(p, "s", h) for p, h in old], "raw_path string, space string, sha256 string")
    rows = src.save_raw(spark.createDataFrame([(t, x, "f", DAY, "s") for t, x in notes], PARSED), known, "2026-10-01").collect()
    return {(r.content.split("\n")[0][2:], r.content.rstrip("\n").rsplit("\n", 1)[1]): (r.raw_path.removeprefix("raw/s/2026-09-30-"), r.is_new) for r in rows}, [(r.raw_path, r.sha256) for r in rows]


def test_save_raw_takes_the_next_free_name(spark):
    at = "raw/s/2026-09-30-"
    # note-2 is free though two records are there; note-3 is never given twice
    got, _ = save(spark, [("Note", "a"), ("Note", "b")], [(f"{at}note.md", "x"), (f"{at}note-3.md", "y")])
    assert sorted(got.values()) == [("note-2.md", True), ("note-4.md", True)]
    # a title that ends in a number is a name of its own, and its content is found again
    _, rows = save(spark, [("report 2", "a"), ("report", "a")])
    assert sorted(p for p, _ in rows) == [f"{at}report-2.md", f"{at}report.md"]
    got, again = save(spark, [("report 2", "a"), ("report", "a"), ("report", "b"), ("report 2", "c")], rows)
    assert got["report 2", "a"] == ("report-2.md", False) and got["report", "a"] == ("report.md", False)
    assert got["report", "b"] == ("report-3.md", True) and got["report 2", "c"] == ("report-2-2.md", True)
    assert len({p for p, _ in again}) == 4
    # files of one batch do not meet under one name
    got, rows = save(spark, [("n", "1"), ("n", "2"), ("n", "3"), ("n 2", "4"), ("n 2 2", "5"), ("n 2", "6"), ("n", "1")])
    assert len({p for p, _ in rows}) == 6 and got["n 2 2", "5"][0] == "n-2-2.md" and "n-2.md" in {got["n 2", "4"][0], got["n 2", "6"][0]}
    assert sorted(got["n", str(i)][0] for i in (1, 2, 3)) == ["n-3.md", "n-4.md", "n.md"]
    # identical content behind a free name is not looked for: the free name is taken
    _, one = save(spark, [("m", "t")])
    got, _ = save(spark, [("m", "t")], [(f"{at}m-2.md", one[0][1])])
    assert got["m", "t"] == ("m.md", True)
    got, _ = save(spark, [("m", "t")], [(f"{at}m.md", "other"), (f"{at}m-2.md", one[0][1])])
    assert got["m", "t"] == ("m-2.md", False)


def test_positions_of_a_hot_key(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(100)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    got = {(r.k, r.i): (r.position, r.total) for r in running_sum(positions(df, ["k"], [F.desc("i")]), ["k"], ["i"], F.col("i"), "total").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted(i for key, i in rows if key == k)
        for n, i in enumerate(mine):
            assert got[k, i] == (len(mine) - n, sum(mine[: n + 1]))


def test_a_configuration_without_hits_has_rows(spark):
    qa = spark.createDataFrame([("q1", "s", "lookup", "tune", ["d"], []), ("q2", "s", "lookup", "tune", ["e"], [])], "id string, space string, type string, split string, gold_docs array<string>, stale_docs array<string>")
    gold = spark.createDataFrame([("d", ["r"], ["a"]), ("e", ["t"], ["b"])], "doc string, raw_paths array<string>, articles array<string>")
    sources = spark.createDataFrame([("a", "r"), ("b", "t")], "article_path string, raw_path string")
    hits = spark.createDataFrame([("one", "q1", "a", 1)], "hash string, qid string, path string, rank int")
    settings = spark.createDataFrame([("one",), ("none",)], "hash string")
    got = {(r.hash, r.qid): (r.recall, r.hit, r.empty) for r in ex.evaluate(hits, sources, gold, qa, 3, ["hash"], settings).collect()}
    assert got == {("one", "q1"): (1.0, 1.0, False), ("one", "q2"): (0.0, 0.0, True), ("none", "q1"): (0.0, 0.0, True), ("none", "q2"): (0.0, 0.0, True)}


def test_new_articles_have_paths_of_their_own(spark):
    schema = "raw_path string, decision string, target string, topic string, title string, body string, related array<string>, reason string"
    new = lambda i, **k: tuple(({"raw_path": i, "decision": "New", "target": None, "topic": "T", "title": "Same", "body": "b", "related": None, "reason": None} | k).values())
    rows = [new("r1", related=["t/c.md", "t/other.md", "t/d.md"]), new("r2"), new("r3", title="Old"), new("r4", title=None, topic=None), new("r5", reason="refused-body", body=""), new("r6", decision="Update", target="t/c.md", body="now", related=["t/d.md", "t/c.md"])]
    articles = spark.createDataFrame([("t/old.md", "O", "x", ["r0"], []), ("t/c.md", "C", "x", ["r0"], ["t/old.md"]), ("t/d.md", "D", "x", [], None)], "path string, title string, body string, sources array<string>, related array<string>")
    raw = spark.createDataFrame([(f"r{i}", "text", "dept/a") for i in range(1, 7)], "raw_path string, text string, space string")
    cands = spark.createDataFrame([("r1", "t/c.md"), ("r1", "t/d.md"), ("r6", "t/c.md"), ("r6", "t/d.md")], "raw_path string, path string")
    done = {r.path: r for r in dx.apply_decisions(spark.createDataFrame(rows, schema), articles, raw, cands).collect()}
    assert set(done) == {"t/same.md", "t/same-dept-a.md", "t/old-dept-a.md", "general/untitled.md", "t/c.md"}
    assert done["t/same.md"].related == ["t/c.md", "t/d.md"] and done["t/c.md"].related == ["t/old.md", "t/d.md"] and done["t/c.md"].body == "now"
    assert done["t/same-dept-a.md"].sources == ["r2"] and done["general/untitled.md"].sources == ["r4"]


def test_a_repeated_batch_is_archived_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "done", b"x"), ("b", "failed", b"y")], "path string, status string, content binary")
    for batch in (0, 1, 1, 0):
        sj.archive_outcome(rows, str(tmp_path / "arch"), batch)
    assert spark.read.parquet(str(tmp_path / "arch")).groupBy("status").count().orderBy("status").collect() == [("done", 2), ("failed", 2)]


def test_second_tries_get_their_budget(spark):
    from corpusloom.operators import search as sx

    sizes = spark.createDataFrame([(1, None), (2, 8192), (3, 1600), (4, 0)], "qid int, n_ctx int")
    got = {r.qid: r.b for r in sizes.select("qid", sx.retry_budget(6000, F.col("n_ctx")).alias("b")).collect()}
    assert got == {1: 3000, 2: 3000, 3: 1200, 4: 3000}
    assert sizes.select(sx.retry_budget(400).alias("b")).first().b == 300

    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid int, text string")
    hits = spark.createDataFrame([(q, "p", 1) for q in (1, 2, 3)], "qid int, path string, rank int")
    bodies = spark.createDataFrame([("p", "x" * 9000)], "path string, body string")

    def model(parts):  # a question's model takes 700 characters and says so in its own way
        for pdf in parts:
            pdf["too_long"] = (pdf["context"].str.len() > 3000) | ((pdf["qid"] == 3) & (pdf["context"].str.len() > 100))
            pdf["answer"] = pdf["context"].str.len().astype(str)
            pdf["n_ctx"] = pdf["qid"].map({1: None, 2: 1700, 3: 1700}).astype("Int32")
            yield pdf[["qid", "answer", "too_long", "n_ctx"]]

    again = lambda few: sx.pack_context(hits.join(few, "qid"), bodies)
    out = {r.qid: (r.answer, r.status) for r in sx.answer(questions, sx.pack_context(hits, bodies, 6000), model, again, budget=6000).collect()}
    assert out == {1: ("3000", "answered"), 2: ("1200", "answered"), 3: ("1200", "too-long")}
