"""What grows with the tables is not sent to one place, and large tables give what small ones do."""

import datetime

import duckdb

from corpusloom.functions import facts as fx
from corpusloom.llm import mixing
from corpusloom.plans import corpus_q
from corpusloom.plans.stream_q import append_run
from corpusloom.streaming import jobs as sj
from corpusloom.streaming import stateful


def test_blocks_and_slots_are_not_broadcast(spark):
    """They are many times the rows that they are made of, which the planner's sizes do not show."""
    docs = spark.createDataFrame([(i, f"w{i} " * 300, f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    pieces = mixing.mix_plan(docs)[1]
    assert pieces.count() == pieces.distinct().count() > 60
    pieces.collect()
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin [src" in plan


def test_rows_of_the_mix_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 300, f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    plan = mixing.mix_documents(docs)._jdf.queryExecution().optimizedPlan()
    assert "row_key" in plan.toString() and plan.toString().count("strategy=merge") == 2


def test_a_price_is_not_grounded_by_a_year(spark, tmp_path):
    """Orders whose price is written like the year (or the day) of a delivered line's date."""
    day = datetime.datetime(1996, 9, 13)
    rows = [(1, 1996.0, day, "F"), (2, 1996.0, day, "O"), (2, 1500.0, day, "F"), (3, 13.0, day, "O"), (3, 1500.25, day, "F"), (4, 1996.09, day, "O"), (4, 77.0, datetime.datetime(2001, 11, 4), "F")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_shipdate timestamp, l_linestatus string")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, corpus_q.q1(spark, str(tmp_path)).select("id", "kind", "value").collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = duck.execute(f"SELECT id, kind, value FROM ({corpus_q.Q1})").fetchall()
    assert got == sorted(want) and (2, "number", "1996.00") in got and (3, "number", "13.00") in got


def test_claim_texts_stay_as_large_as_their_steps(spark):
    """Nested, the expression of the last step held the ones before some hundred times."""
    df = spark.createDataFrame([(1, "a 2026-09-30 and [[x]] 3.5 \"0123456789\" 2026.9.30 1/2")], "id long, body string")
    read = fx.claim_texts(df, "body")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 14
    assert read.select("number").first()[0].split() == ["a", "and", "3.5", "1/2"]


def test_keys_share_the_entries_of_the_store(spark, tmp_path):
    """However many keys there are, a batch reads and writes a few entries a part."""
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), None if i == 7 else i, "login_failed", "t", "") for i in range(6000)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id long, ts timestamp, user_id long, action string, target string, detail string"
    for part in (rows, [(9999, start + datetime.timedelta(days=2), -1, "login_failed", "t", "")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    append_run(stateful.coalesced_audit_stream(stream, sj.COALESCED, 10 * 86_400.0, 10 * 86_400.0, "1 minute"), out, state)
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == [r[0] for r in rows] and got.where("user_id is null").count() == 1
    assert 0 < spark.read.format("statestore").option("stateVarName", "value").load(state).count() <= stateful.PARTS < len(rows)


def test_large_numbers_beside_nulls_stay_exact(spark, tmp_path):
    """Times in nanoseconds that differ in the last digit, in parts that hold nulls."""
    start = datetime.datetime(2026, 1, 1)
    rows = [(p, start + datetime.timedelta(hours=h), 1, 1_700_000_000_000_000_001 + h * (p % 2), False) for p in range(40) for h in range(2)]
    rows += [(40, start, 1, None, True), (-1, start + datetime.timedelta(days=9), 0, 0, False)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "path long, scan_ts timestamp, size long, mtime_ns long, locked boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    append_run(stateful.stable_files_stream(spark.readStream.schema(schema).parquet(src), 1.0, 2, 86_400.0, "1 hour"), out, state)
    got = {(r.path, r.scan_ts.hour): r.status for r in spark.read.parquet(out).collect()}
    assert {p: got[p, 1] for p in range(40)} == {p: "waiting" if p % 2 else "ready" for p in range(40)} and got[40, 0] == "locked"
