"""Ordered folds, ledgers, admission and extraction: batches that repeat, rows that come late, files that are broken."""

import datetime
import random
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.stream_q import _replay, append_run
from corpusloom.sources import extract
from corpusloom.streaming import admission, ledger, stateful
from corpusloom.streaming import jobs as sj

START = datetime.datetime(2026, 1, 1)
AUDIT = "id long, ts timestamp, user_id long, action string, target string, detail string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_late_rows_and_restarts_change_nothing(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, at(rng.randrange(9000)), rng.choice([1, 1, 2]), rng.choice(["login_failed", "read_denied", "query"]), rng.choice(["t", "T" * 250 + "a", "T" * 250 + "b"]), "d" * 600) for i in range(300)]
    batches = [[r for r in rows if (r[1] - START).seconds // 1800 + (r[0] % 3 == 0) == k] for k in range(6)]
    beat = (-1, at(99_000), 9, "login_failed", "", "")
    out, state, src = (str(tmp_path / x) for x in ("out", "state", "in"))
    for k, part in enumerate(batches):
        spark.createDataFrame(part + [beat] * (k == 5), AUDIT).coalesce(1).write.mode("append").parquet(src)
        if k % 2:
            stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(src)
            append_run(stateful.coalesced_audit_stream(stream, sj.COALESCED, 60.0, 600.0, "1 hour"), out, state)
    got = spark.read.parquet(out).where("id >= 0")
    want = sj.coalesced_audit(spark.createDataFrame(rows, AUDIT), window=60.0, forget=600.0)
    key = lambda df: sorted(map(tuple, df.select("id", "user_id", "action", "target", "detail", "repeats").collect()))
    assert key(got) == key(want)
    assert {len(r.target) for r in got.collect()} <= {1, 200} and max(r.repeats for r in got.collect()) > 0
    assert all(("repeats_suppressed=" in r.detail) == (r.repeats > 0) and r.detail.startswith("d" * 500) for r in got.collect())


def test_state_expires(spark, tmp_path):
    """A key that is heard of no more leaves no rows behind in the store."""
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame([(k * 100 + i, at(k * 7200 + i), k * 100 + i, "login_failed", "t", "") for i in range(20)], AUDIT).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(src)
    append_run(stateful.coalesced_audit_stream(stream, sj.COALESCED, 60.0, 60.0, "1 minute"), str(tmp_path / "out"), state)
    kept = spark.read.format("statestore").option("stateVarName", "value").load(state)
    # the first two hours' keys are gone; the last rows still wait for the clock
    assert kept.count() == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_ledger_reads_its_prefixes_and_replays(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "space string, sha256 string, raw_path string"
    rows = spark.range(400).select(F.lit("s").alias("space"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.concat(F.lit("p"), "id").alias("raw_path")).withColumn("prefix", ledger.prefix("sha256"))
    assert ledger.remembered(spark, path, schema, rows, 0).count() == 0
    for batch in (0, 1, 1):
        part = rows.where(F.substring("raw_path", 2, 9).cast("int") % 2 == batch)
        assert not ledger.first_seen(part, ledger.remembered(spark, path, schema, part, batch), ["space", "sha256"], "raw_path").where("duplicate").count()
        ledger.remember(part, path, batch)
    assert spark.read.parquet(path).count() == 400
    few = rows.where("raw_path in ('p1', 'p2', 'p3')").unionByName(rows.where("raw_path = 'p3'").withColumn("raw_path", F.lit("q")).withColumn("space", F.lit("other")))
    seen = ledger.remembered(spark, path, schema, few, 9)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0] and seen.count() < 40
    assert sorted((r.raw_path, r.duplicate) for r in ledger.first_seen(few, seen, ["space", "sha256"], "raw_path").collect()) == [("p1", True), ("p2", True), ("p3", True), ("q", False)]


def test_admission_is_fair_and_durable(spark, tmp_path):
    root, schema = str(tmp_path / "backlog"), "path string, space string, size long"
    came = [[("hot", i) for i in range(20)] + [("b", i) for i in range(2)], [("c", i) for i in range(3)] + [("hot", i) for i in range(20, 25)], [("b", 9), (None, 0)]]
    queue, last, now, want, got = [], {}, 0, [], []
    for turn in range(12):
        new = came[turn] if turn < len(came) else None
        starts = {s or "": max(last.get(s or "", 0), now) for s, _ in new or []}
        for s in sorted(starts):
            for place, (_, i) in enumerate(sorted(((x or "", i) for x, i in new if (x or "") == s), key=lambda r: f"{r[0]}{r[1]:03}"), 1):
                queue.append((starts[s] + place, turn, f"{s}{i:03}"))
                last[s] = starts[s] + place
        queue.sort()
        let, queue = queue[:4], queue[4:]
        now = max((n for n, _, _ in let), default=0) if let else 0
        want.append(sorted(k for _, _, k in let))
        rows = None if new is None else spark.createDataFrame([(f"{s or ''}{i:03}", s, i) for s, i in new], schema)
        for _ in range(2 if turn in (1, 5) else 1):  # a turn that is repeated
            out = admission.admit(rows, spark, root, turn, 4)
            rest = sorted(r.path for r in out.collect())
        got.append(rest)
    assert got == want and sum(map(len, got)) == sum(map(len, came))
    assert got[1] != got[0] and {"c000"} <= set(got[1])  # one turn's wait beside a queue of twenty
    assert admission.drain(spark, root, 4, lambda rows, turn: None) == 0


def mail(subject, *attached):
    m = EmailMessage()
    m["Subject"], m["From"], m["Date"] = subject, "a@x.org", "Thu, 01 Jan 2026 10:00:00 +0000"
    m.set_content(f"body of {subject}, write to someone@example.org\n")
    for name, data in attached:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m


def test_extractors_give_error_rows(spark):
    inner = mail("inner", ("x.txt", b"deep"))
    outer = mail("outer", ("a.txt", b"# Head\r\n1"), ("A.txt", b"2"), ("b.bin", b"\0"))
    outer.add_attachment(inner)

    def broken(name, content):
        raise ValueError("no")

    def sheets(name, content):
        yield from ({"title": t, "text": t * 2} for t in content.decode().split())

    files = [("m.eml", bytes(outer)), ("n.TXT", b"\xef\xbb\xbftext"), ("c.txt", "한글".encode("cp949")), ("e.txt", b"  "), ("z.zip", b"PK"), ("none.txt", None), ("bad.err", b"x"), ("t.csv", b"aa bb"), ("noext", b"q")]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {(r.path, r.part): (r.parent, r.name, r.title, r.text, r.error) for r in extract.extracted(df, extract.EXTRACTORS | {"err": broken, "csv": sheets}).collect()}
    body = "body of {}, write to someone@example.org"
    assert got == {
        ("m.eml", 0): (None, "m.eml", "outer", body.format("outer"), None), ("m.eml", 1): (0, "a.txt", "Head", "# Head\n1", None), ("m.eml", 2): (0, "A-2.txt", "A-2", "2", None), ("m.eml", 3): (0, "b.bin", None, None, "unsupported"),
        ("m.eml", 4): (0, "forwarded.eml", "inner", body.format("inner"), None), ("m.eml", 5): (4, "x.txt", "x", "deep", None), ("n.TXT", 0): (None, "n.TXT", "n", "text", None), ("c.txt", 0): (None, "c.txt", "c", "한글", None),
        ("e.txt", 0): (None, "e.txt", "e", "", "empty"), ("z.zip", 0): (None, "z.zip", None, None, "unsupported"), ("none.txt", 0): (None, "none.txt", None, None, "no-content"), ("bad.err", 0): (None, "bad.err", None, None, "unreadable: ValueError"),
        ("t.csv", 0): (None, "t.csv", "aa", "aaaa", None), ("t.csv", 1): (0, "t.csv", "bb", "bbbb", None), ("noext", 0): (None, "noext", None, None, "unsupported"),
    }


@pytest.mark.parametrize("mask", [True, False])
def test_mails_and_files_in_one_flow(spark, tmp_path, mask):
    """Mail, attachment, masking, numbering and a ledger; the last batch runs twice."""
    schema = "path string, length long, content binary"
    row = lambda path, data: (path, len(data), bytes(data))
    batches = [[row("dept-a/m.eml", bytes(mail("Note", ("note.txt", b"# Note\nx")))), row("dept-a/note.md", b"# Note\ny"), row("Bad/q.md", b"x")], [row("dept-a/again.md", b"# Note\ny"), row("dept-b/note.md", b"# Note\ny"), row("dept-a/third.md", b"# Note\nz")]]
    src, out, state, led, names = (str(tmp_path / x) for x in ("in", "out", "state", "ledger", "names"))
    run = lambda: sj.ingest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "", led, names, out, state, "2026-10-01", mask).awaitTermination()
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    first = sorted(map(str, spark.read.parquet(out).collect()))
    _replay(spark, state, 1)
    run()
    assert sorted(map(str, spark.read.parquet(out).collect())) == first
    got = {(r.path, r.part): r for r in spark.read.parquet(out).collect()}
    assert {k: r.status for k, r in got.items()} == {("dept-a/m.eml", 0): "done", ("dept-a/m.eml", 1): "done", ("dept-a/note.md", 0): "done", ("Bad/q.md", 0): "failed", ("dept-a/again.md", 0): "duplicate", ("dept-b/note.md", 0): "done", ("dept-a/third.md", 0): "done"}
    assert got["dept-a/m.eml", 0].raw_path == "raw/dept-a/2026-01-01-note.md" and got["dept-a/m.eml", 1].parent_raw == "raw/dept-a/2026-01-01-note.md"
    assert sorted((got["dept-a/m.eml", 1].raw_path, got["dept-a/note.md", 0].raw_path)) == ["raw/dept-a/2026-10-01-note-2.md", "raw/dept-a/2026-10-01-note.md"]
    assert got["dept-a/third.md", 0].raw_path == "raw/dept-a/2026-10-01-note-3.md" and got["dept-b/note.md", 0].raw_path == "raw/dept-b/2026-10-01-note.md"
    assert ("[EMAIL]" in got["dept-a/m.eml", 0].text) == mask and ("someone@" in got["dept-a/m.eml", 0].text) != mask
    assert spark.read.parquet(names).count() == 5 and spark.read.parquet(led).count() == 4
