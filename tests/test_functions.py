"""Hand-checked values of the column functions."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import facts as fx
from corpusloom.functions import pii
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, "VPN 접속장애 v2_x 가", tx.tokenize("t")) == ["vpn", "접속", "속장", "장애", "v2_x", "가"]
    assert one(spark, "", tx.tokenize("t")) == []


@pytest.mark.parametrize("text, counts", [
    ("900101-1234567, 010-1234-5678, 02-123-4567, a.b@corp.co.kr, 1234-5678-9012-3456", {"email": 1, "rrn": 1, "card": 1, "phone": 2}),
    ("금액 12345678901 원, 날짜 2026-09-30", {}),
    ("０１０-１２３４-５６７８", {"phone": 1}),
    ("010-12​34-5678", {"phone": 1}),
    ("900101–1234567", {"rrn": 1}),
])
def test_pii_mask(spark, text, counts):
    assert one(spark, text, pii.pii_mask("t")["counts"]) == counts


def test_mask_one_line_and_document(spark):
    assert one(spark, " a\n b@c.de  x ", pii.mask_one_line("t")["text"]) == "a [EMAIL] x"
    df = spark.createDataFrame([("x a@b.cd", "T 010-1234-5678", "s", {"k": "c@d.ef"}, True), ("x a@b.cd", "T", "s", {}, False)], "text string, title string, source_name string, metadata map<string,string>, mask boolean")
    a, b = pii.mask_document(df).collect()
    assert (a.text, a.title, a.metadata, a.pii_counts) == ("x [EMAIL]", "T [PHONE]", {"k": "[EMAIL]"}, {"email": 2, "phone": 1})
    assert (b.text, b.pii_counts) == ("x a@b.cd", {})


@pytest.mark.parametrize("fact, answer, found", [
    ("1200만원", "예산은 1,200만원입니다", True), ("2026년 9월 30일", "2026-09-30", True), ("45 분", "45분", True), ("12", "총 12대", True),
    ("12", "총 123대", False), ("12", "총 112대", False), ("45분", "54분", False), ("1200만원", "12000만원", False), ("", "x", False), (r"a\E.b", r"xA\E.by", True),
])
def test_fact_in(spark, fact, answer, found):
    row = spark.createDataFrame([(fact, answer)], "f string, a string").select(fx.fact_in("f", "a").alias("x")).first()
    assert row["x"] is found


def test_refusal(spark):
    for text, want in (("근거 없음", True), ("  근거 없음. ", True), ("'근거  없음'", True), ("근거 없음이지만 아마 3대", False), ("", False)):
        assert one(spark, text, tx.is_refusal("t")) is want


def test_claims(spark):
    dates = one(spark, "2026-09-30, 2026년 9월 30일, 2026.9.30 and 2026/9/30", fx.extract_dates("t"))
    assert {(d.y, d.m, d.d) for d in dates} == {(2026, 9, 30)} and len(dates) == 4
    assert [n.canon for n in one(spark, "1,200 and 03.50 and 7", fx.extract_numbers("t"))] == ["1200", "3.5", "7"]
    assert one(spark, "‘짧은’ ‘열 글자가 넘는 긴 인용’ \"0123456789\"", fx.extract_quotes("t")) == ["열 글자가 넘는 긴 인용", "0123456789"]


def test_names_and_titles(spark):
    assert one(spark, "  Héllo, World__ ", tx.slugify("t")) == "héllo-world"
    assert one(spark, "...", tx.slugify("t", "none")) == "none"
    assert one(spark, "a b\x00 c", tx.clean_title("t")) == "a b c"
    assert one(spark, "x[1]|y", tx.label("t")) == "x 1  y"
    for text, want in (("dept-a", True), ("dept-a/part-1", True), ("Dept", False), ("con", False), ("a/b/c/d/e", False), ("", False), (None, False)):
        assert one(spark, text, tx.valid_space("t")) is want
    for text in ("", " ", "..", "a/../b", "a//b", "a\\b", "C:evil", "nul.txt", "x."):
        assert one(spark, text, tx.valid_filename("t")) is False or text == " "


def test_body_and_fallback(spark):
    article = "---\ntitle: \"T\"\n---\n# T\n\nbody line\n\n## Sources\n- x\n"
    assert one(spark, article, tx.split_body("t")) == "# T\n\nbody line"
    f = one(spark, "\n# Title\n\n> Source: x\n> Collected: y\n\nText 1\nmore\n", tx.raw_fallback("t", F.lit("raw/a/b.md")))
    assert (f.title, f.body) == ("Title", "Text 1\nmore")
    assert one(spark, "just text", tx.raw_fallback("t", F.lit("raw/a/name.md"))).title == "name"
    assert one(spark, "abcdefghij", tx.head_tail_truncate("t", 6, "|")).text == "abcd|ij"


def test_json_and_think(spark):
    assert one(spark, "<think>{\"a\": 1}</think> text {bad {\"b\": 2} {\"c\": 3}", tx.first_json_object(tx.strip_think("t"))) == '{"b": 2}'
    assert one(spark, "none", tx.first_json_object("t")) is None


def test_links_and_markers(spark):
    assert one(spark, "[[a.md|x]] `[[no]]` [[b#c]]\n```\n[[no]]\n```", tx.wiki_links("t")) == ["a", "b"]
    assert one(spark, "x [2] y [9] z [2]", tx.cite_markers("t")) == [2, 9]
    assert one(spark, "x [2] y [9]", tx.drop_bad_markers("t", F.lit(3))) == "x [2] y "


def test_magic(spark):
    rows = spark.createDataFrame([("pdf", bytearray(b"%PDF-1.7")), ("pdf", bytearray(b"x")), ("png", bytearray(b"\x89PNG\r\n\x1a\n")), ("docx", bytearray(b"PK\x03")), ("jpg", bytearray(b"\xff\xd8\xff")), ("md", bytearray(b"x")), ("xlsx", bytearray(b"x"))], "e string, c binary")
    assert [r.x for r in rows.select(tx.magic_ok("e", "c").alias("x")).collect()] == [True, False, True, True, True, True, False]


def test_context_budget(spark):
    assert [spark.range(1).select(tx.context_budget(n).alias("x")).first().x for n in (8192, 32768, 4096, 100)] == [6692 * 9 // 10, 31268 * 9 // 10, 2596 * 9 // 10, 1500]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("inf"), 1.0],)], "v array<double>")
    assert [None if r.n is None else [round(x, 5) for x in r.n] for r in df.select(vx.vec_normalize("v").alias("n")).collect()] == [[0.6, 0.8], None, None]


def test_canonical_config(spark):
    rows = [("bm25", 30, 1.0, 0.9), ("bm25", 60, 0.5, 0.9), ("hybrid", 30, 1.0, 0.9), ("dense", 30, 1.0, 0.9)]
    out = vx.canonical_config(spark.createDataFrame(rows, "retrieval_mode string, rrf_k int, w_dense double, bm25_k1 double"))
    assert out.count() == 3 and out.where("retrieval_mode = 'bm25'").first().rrf_k == 60


def test_html_and_sql_registration(spark):
    assert one(spark, "<html><head><title>t</title></head><body><p>a  b<br>c</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>", tx.html_to_text("t")) == "a b\nc\n\n1\t2"
    tx.register(spark)
    assert spark.sql("select nfkc('ﬁ') as x, casefold('ẞ') as y").first() == ("fi", "ss")
