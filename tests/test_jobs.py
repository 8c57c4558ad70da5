"""Trees of digests, ordered rows, running reports and trial logs: what changes, what survives a restart."""

import datetime
import random

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ex
from corpusloom.operators import quality as qx
from corpusloom.operators import reports as rx
from corpusloom.plans.stream_q import _replay
from corpusloom.sources import files as src
from corpusloom.streaming import jobs as sj


def test_changes_are_found_by_descent(spark):
    rows = [(f"d/{i}", f"h{i}") for i in range(300)]
    made = lambda r: spark.createDataFrame(r, "path string, sha256 string")
    old, new = made(rows), made([r for r in rows if r[0] not in ("d/7", "d/50")] + [("d/7", "other"), ("d/new", "x")])
    branches, files = src.changed_files(old, new, 3)
    assert {(r.path, r.change) for r in files.collect()} == {("d/7", "changed"), ("d/50", "removed"), ("d/new", "added")}
    assert [b for b in branches if b[0] == 0] == [(0, "")] and len([b for b in branches if b[0] == 3]) == 3
    assert all(any(low.startswith(p) for level, low in branches if level == 3) for _, p in branches)
    same, none = src.changed_files(old, made(rows[::-1]), 3)
    assert same == [] and none.count() == 0
    tree = src.digest_tree(old, 2)
    assert tree.where("level = 0").first().n == 300 and tree.groupBy("level").agg(F.sum("n").alias("n")).select("n").distinct().count() == 1
    assert src.dataset_digest(old.limit(0)).count() == 0 and src.dataset_digest(old).first().n == 300


def test_index_lines_are_written_in_order(spark, tmp_path):
    articles = spark.createDataFrame([(f"a/{i:03}.md", f"T{i}") for i in range(60)], "path string, title string")
    spaces = articles.select("path", F.when(F.col("path") < "a/050.md", F.array(F.lit("hot"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("spaces"))
    index = src.space_index(articles, spaces)
    src.write_space_index(index, str(tmp_path / "index"))
    for space, n in (("hot", 50), ("b", 60)):
        lines = [r.line for r in index.where(F.col("space") == space).orderBy("position").collect()]
        files = sorted((tmp_path / "index" / f"space={space}").glob("part-*"))
        assert lines == [f"- [[a/{i:03}|T{i}]]" for i in range(n)] == "".join(f.read_text() for f in files).splitlines()


def test_names_and_turns_of_any_size(spark):
    pages = spark.createDataFrame([("w", f"w/{i:02}/x.md", "x") for i in range(12)] + [("w", "w/y.md", "y")], "folder string, path string, name string")
    assert [(r.position, r.path) for r in qx.ambiguous_pages(pages).orderBy("position").collect()] == [(i + 1, f"w/{i:02}/x.md") for i in range(12)]
    assert [(r.file, r.detail) for r in qx.ambiguous_names(pages).collect()] == [("w/00/x.md", "x: 12 pages")]
    jobs = spark.createDataFrame([(i, s) for i, s in enumerate("AAAABCA")] + [(7, None)], "id long, space string")
    order = lambda df: [(r.id, r.position, r.turn) for r in df.collect()]
    want = [(0, 1, 1), (4, 2, 1), (5, 3, 1), (7, 4, 1), (1, 5, 2), (2, 6, 3), (3, 7, 4), (6, 8, 5)]
    assert order(rx.round_robin(jobs)) == want and order(rx.round_robin(jobs, 5)) == want[:5]


def test_running_reports_equal_batch_reports(spark, tmp_path):
    rng = random.Random(1)
    schema = "id long, ts timestamp, user_id long, action string, target string, detail string"
    day = datetime.datetime(2026, 1, 1)
    rows = [(i, day, rng.choice([1, 2, None]), rng.choice(["query", "feedback_up", "feedback_down", "login"]), rng.choice(["q1", " q1 ", "-", "q2"]), rng.choice(["no-evidence", ""])) for i in range(90)]
    path, root, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(path)
        sj.running_reports(spark.readStream.schema(schema).parquet(path), root, state).awaitTermination()
        if k == 1:
            _replay(spark, state, 1)
        totals, seen = sj.running_totals(spark, root), spark.createDataFrame(rows[: k * 30 + 30], schema)
        assert sj.running_feedback(totals).collect() == rx.feedback_report(seen).collect()
        assert sj.running_gaps(totals).collect() == rx.gaps_report(seen).collect()
        assert sj.running_usage(totals).collect() == rx.usage_stats(seen).collect()


def test_refine_goes_on_where_a_driver_ended(spark, tmp_path):
    space = {"x": [0, 2, 4, 8], "y": [0.0, 0.5, 1.0], "mode": ["a", "b"]}
    asked = []

    def score(configs):
        rows = configs.collect()
        asked.extend((r.x, r.y, r.mode) for r in rows)
        return spark.createDataFrame([(r.hash, float(-((r.x - 3) ** 2) - (r.y - 0.5) ** 2 + 0.5 * (r.mode == "b"))) for r in rows], "hash string, score double")

    log, start = str(tmp_path / "log"), {"x": 2, "y": 0.0, "mode": "a"}
    ex.refine_job(spark, log, start, space, score, rounds=1)
    before = len(asked)
    best = ex.refine_job(spark, log, start, space, score).first()
    assert (best.score, best.cfg["x"], best.cfg["y"], best.cfg["mode"]) == (0.5, '{"v":3}', '{"v":0.5}', '{"v":"b"}')
    assert len(asked) > before > 1 and len(asked) == len(set(asked))  # no trial twice
    n = len(asked)
    assert ex.refine_job(spark, log, start, space, score).first().score == 0.5 and len(asked) == n


def test_registered_queries_import_without_a_session():
    """The driver's functions are read before a session is there, and every query with SQL is registered."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) >= 140
