"""Readers and writers of files, and streams against their batch forms."""

import datetime
import json
import random
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files as src
from corpusloom.streaming import jobs as sj


def put(root, path, data):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan(spark, tmp_path):
    for path in ("dept-a/x.md", "root.md", "_done/y.md", "dept-a/~$z.docx", "Bad Name/q.md", "dept-a/t.exe", "dept-a/p/q/r/deep.md", "Sales/EU/s.txt"):
        put(tmp_path, path, "text")
    aliases = spark.createDataFrame([("sales", "dept-s")], "alias string, space string")
    got = {r.path: (r.space, r.reason, r.category) for r in src.scan_files(spark, str(tmp_path), aliases).collect()}
    assert got == {
        "dept-a/x.md": ("dept-a", None, None), "root.md": (None, "root-file", "location"), "Bad Name/q.md": (None, "unknown-space", "location"), "dept-a/t.exe": ("dept-a", "unsupported", "unsupported"),
        "dept-a/p/q/r/deep.md": ("dept-a/p/q/r", None, None), "Sales/EU/s.txt": ("dept-s", None, None),
    }


def test_text_and_corpus(spark, tmp_path):
    put(tmp_path, "corpus/dept-a/a.md", "﻿# Title #\r\nbody\r\n")
    put(tmp_path, "corpus/dept-a/b.txt", "한글".encode("cp949"))
    put(tmp_path, "corpus/top.md", "x")
    docs = {r.path: r for r in src.read_text_docs(src.list_files(spark, str(tmp_path))).collect()}
    assert docs["corpus/dept-a/a.md"].title == "Title" and docs["corpus/dept-a/a.md"].text.endswith("body")
    small = {r.path: r for r in src.read_text_docs(src.list_files(spark, str(tmp_path)), max_bytes=5).collect()}
    assert small["corpus/dept-a/a.md"].error == "too-large" and small["corpus/dept-a/a.md"].text is None and small["corpus/top.md"].text == "x"
    assert docs["corpus/dept-a/b.txt"].text == "한글" and docs["corpus/dept-a/b.txt"].title == "b"
    assert sorted((r.doc_id, r.space) for r in src.corpus_files(spark, str(tmp_path)).collect()) == [("dept-a/a.md", "dept-a"), ("dept-a/b.txt", "dept-a")]


def test_mail(spark, tmp_path):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["References"] = "Hi", "a@x.org", "b@x.org", "<m1@x>", "<R0@x> <r1@x>"
    m.set_content("body\n")
    for data in (b"1", b"2"):
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename="a.bin")
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("x")
    m.add_attachment(inner)
    put(tmp_path, "m.eml", bytes(m))
    row = src.read_mail(src.list_files(spark, str(tmp_path))).first()
    assert (row.subject, row.body, row.sender) == ("Hi", "body", "a@x.org")
    assert [(a["name"], bytes(a["content"])) for a in row.attachments][:2] == [("a.bin", b"1"), ("a-2.bin", b"2")] and row.attachments[2]["name"] == "forwarded-1.txt"


def test_articles_round_trip(spark, tmp_path):
    schema = "path string, title string, body string, updated date, sources array<string>, related array<string>"
    a = spark.createDataFrame([("t/a.md", 'A "q"', "text\n\nmore", datetime.date(2026, 9, 30), ["raw/s/1.md"], ["t/b.md"]), ("t/b.md", "B", "x", None, [], [])], schema)
    md = src.render_articles(a, a.select("path", "title"))
    assert "- [[t/b|B]]" in {r.path: r.markdown for r in md.collect()}["t/a.md"] and "(../../raw/s/1.md)" in md.where("path = 't/a.md'").first().markdown
    for r in md.collect():
        put(tmp_path, r.path, r.markdown)
    back = {r.path: r for r in src.read_articles(spark, str(tmp_path)).collect()}
    for r in a.collect():
        assert (back[r.path].title, back[r.path].body, back[r.path].updated, back[r.path].sources, back[r.path].related) == (r.title, r.body, r.updated, r.sources, r.related)


def test_vault_reader(spark, tmp_path):
    put(tmp_path, "20_ai_wiki/A.md", "---\ntopic: t\nsources:\n  - \"[[r1]]\"\n  - '[[r2]]'\ntags: [a, b]\n---\nbody [[B]]\n")
    put(tmp_path, "20_ai_wiki/_templates/T.md", "x")
    row = src.read_vault(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0].front == {"topic": ["t"], "sources": ["[[r1]]", "[[r2]]"], "tags": ["a", "b"]} and row[0].name == "A" and row[0].body == "body [[B]]\n"


def test_qa_and_trials(spark, tmp_path):
    good = {"id": "1", "space": "s", "question": "q", "type": "lookup", "gold_docs": ["x\\corpus\\s\\d.md"], "split": "tune"}
    put(tmp_path, "qa.jsonl", json.dumps(good) + "\n" + json.dumps(good | {"id": "2", "split": "heldout"}) + "\n")
    assert [r.gold_docs for r in src.read_qa(spark, str(tmp_path / "qa.jsonl"), "tune").collect()] == [["s/d.md"]]
    put(tmp_path, "bad.jsonl", json.dumps(good | {"type": "other"}))
    with pytest.raises(Exception, match="unknown type"):
        src.read_qa(spark, str(tmp_path / "bad.jsonl")).collect()
    t = spark.createDataFrame([("s", 1, "h", {"k": "1"}, 0.5, {}, {}, False, 1.0, 1)], src.TRIALS)
    src.append_trials(t, str(tmp_path / "log"))
    put(tmp_path, "log/torn.json", '{"stage": "s", "hash": "x", "sco')
    assert [r.hash for r in src.read_trials(spark, str(tmp_path / "log")).collect()] == ["h"]


def test_save_raw(spark):
    schema = "title string, text string, source_name string, published date, space string"
    day = datetime.date(2026, 9, 30)
    parsed = spark.createDataFrame([("주간 회의", "a", "f", day, "dept-a/part-1"), ("주간 회의", "b", "f", day, "dept-a/part-1"), ("주간 회의", "b", "f", day, "dept-a/part-1"), ("X", "c", "f", None, "dept-a")], schema)
    none = spark.createDataFrame([], "raw_path string, space string, sha256 string")
    first = src.save_raw(parsed, none, "2026-10-01")
    paths = sorted(r.raw_path for r in first.collect())
    assert paths == ["raw/dept-a/2026-10-01-x.md", "raw/dept-a/part-1/2026-09-30-주간-회의-2.md", "raw/dept-a/part-1/2026-09-30-주간-회의.md"]
    assert "> Published: Unknown" in first.where("space = 'dept-a'").first().content
    again = src.save_raw(parsed.unionByName(spark.createDataFrame([("주간 회의", "new", "f", day, "dept-a/part-1")], schema)), first.select("raw_path", "space", "sha256"), "2026-10-01")
    assert sorted((r.raw_path, r.is_new) for r in again.collect()) == sorted([*((p, False) for p in paths), ("raw/dept-a/part-1/2026-09-30-주간-회의-3.md", True)])


def test_stream_ingest(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "dept-a/a.md", "# A\nmail a@b.cd")
    put(inbox, "dept-a/b.md", "# A\nmail a@b.cd")
    put(inbox, "Bad/c.md", "x")
    run = lambda: sj.stream_ingest(spark, str(inbox), str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(inbox, "dept-a/d.md", "# A\nmail a@b.cd")
    put(inbox, "dept-b/d.md", "# A\nmail a@b.cd")
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.path, r.status) for r in out.collect()) == [("Bad/c.md", "failed"), ("dept-a/a.md", "done"), ("dept-a/b.md", "duplicate"), ("dept-a/d.md", "duplicate"), ("dept-b/d.md", "done")]
    assert out.where("status = 'done'").first().text.endswith("[EMAIL]")
    sj.archive_outcome(out.withColumn("content", F.lit(b"x")), str(tmp_path / "arch"))
    assert "content" not in spark.read.parquet(str(tmp_path / "arch")).columns


EVENTS = [(i, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s), u, "login_failed", "t") for i, (s, u) in enumerate([(0, 1), (10, 1), (59, 1), (60, 1), (61, 1), (200, 1), (5, 2), (70, 2)])]


def test_repeats_batch_is_stream(spark, tmp_path):
    schema = "id long, ts timestamp, user_id long, action string, target string"
    want = [(0, 0), (3, 2), (5, 1), (6, 0), (7, 0)]
    assert sorted(map(tuple, sj.coalesce_repeats(spark.createDataFrame(EVENTS, schema)).collect())) == want
    # a later event moves the clock past the others
    beat = (99, datetime.datetime(2026, 1, 2), 9, "login_failed", "t")
    for i in range(0, 8, 3):
        spark.createDataFrame(EVENTS[i : i + 3] + [beat] * (i == 6), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = sj.run_to_memory(sj.coalesce_repeats_stream(stream), "repeats", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == want


def test_stream_reports_and_dedup(spark, tmp_path):
    schema = "ts timestamp, space string, sha256 string, action string, detail string, user_id long"
    t = datetime.datetime(2026, 1, 1)
    rows = [(t + datetime.timedelta(minutes=m), "s", h, "query", d, 1) for m, h, d in ((0, "a", "no-evidence"), (5, "a", ""), (50, "b", ""), (100, "a", "no-evidence"))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "ev"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    assert sorted(r.sha256 for r in sj.run_to_memory(sj.dedup_stream(stream()), "dedup", str(tmp_path / "c1")).collect()) == ["a", "b"]
    report = sj.run_to_memory(sj.audit_stream(stream()), "report", str(tmp_path / "c2"), "update")
    assert report.agg(F.sum("n"), F.sum("no_evidence")).first() == (4, 2)
    sessions = sj.run_to_memory(sj.sessionize_stream(stream()), "sess", str(tmp_path / "c3"))
    assert sorted(r.n for r in sessions.collect()) in ([1, 2], [1, 1, 2])


def test_files_and_retries(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    obs = [("a", at(0), 1, 0, False), ("a", at(1), 1, 0, False), ("b", at(0), 1, 0, False), ("b", at(1), 2, 0, False), ("c", at(0), 1, 0, True), ("c", at(1), 1, 0, True), ("d", at(0), 1, 0, True), ("d", at(1), 2, 0, True)]
    df = spark.createDataFrame(obs, "path string, scan_ts timestamp, size long, mtime_ns long, locked boolean")
    assert dict(map(tuple, sj.stable_files(df, 1.0, 2).collect())) == {"a": "ready", "b": "waiting", "c": "given-up", "d": "locked"}
    log = [("a", 1, "enqueued"), ("a", 2, "error"), ("a", 3, "locked"), ("a", 4, "error"), ("b", 1, "enqueued"), ("b", 2, "ok"), ("b", 3, "enqueued"), ("c", 1, "error"), ("c", 2, "error"), ("c", 3, "error")]
    got = {r.path: (r.status, r.attempts) for r in sj.retry_ledger(spark.createDataFrame(log, "path string, seq int, outcome string")).collect()}
    assert got == {"a": ("failed", 2), "b": ("new", 0), "c": ("exhausted", 3)}


def test_digest_follows_content(spark):
    m = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(50)], "path string, sha256 string")
    same = src.dataset_digest(m.orderBy(F.desc("path"))).first()
    assert src.dataset_digest(m).first() == same and src.dataset_digest(m.where("path <> 'p3'")).first().digest != same.digest


def test_folds_carry_state_over_batches(spark):
    rng = random.Random(4)
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    ev = [(i, rng.randrange(4000), rng.choice([1, 1, 1, 2, None]), rng.choice(["login_failed", "other"])) for i in range(600)]
    want, state = [], {}
    for i, s, u, a in sorted(ev, key=lambda r: (r[1], r[0])):
        since, hidden = state.get((u, a), (None, 0))
        if a == "login_failed" and since is not None and s - since < 60:
            state[u, a] = since, hidden + 1
            continue
        want.append((i, hidden))
        state[u, a] = s, 0
    cut, state = {}, {}
    for s, u in sorted((s, u) for _, s, u, _ in ev if u):
        start, last, n = state.get(u, (None, None, 0))
        if start is None or s - last > 30 or s - start > 200:
            start, n = s, n + 1
        state[u] = start, s, n
        cut[u, n] = cut.get((u, n), 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i, at(s), u, a, "t") for i, s, u, a in ev], "id long, ts timestamp, user_id long, action string, target string")
        kept, sessions = sj.coalesce_repeats(df), sj.sessionize(df.where("user_id is not null"), 30, 200)
        assert sorted(map(tuple, kept.collect())) == sorted(want)
        assert {(r.user_id, r.session): r.n for r in sessions.collect()} == cut
        for out in (kept, sessions):  # no group as one frame
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
