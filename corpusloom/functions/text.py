"""Text columns: tokens, slugs, titles, bodies, links, citations, notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Token classes: word characters of ASCII, and the CJK ranges that are cut into bigrams.
CJK = "぀-ヿ㐀-鿿가-힣"
TOKEN = f"[0-9A-Za-z_]+|[{CJK}]+"
#: The marker that stands for text left out of the middle, and the one after a cut context.
CUT_MARK = "\n\n[... truncated ...]\n\n"
DISPUTED = r"(?m)^## Disputed[ \t]*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Lower-case ASCII words, and the overlapping bigrams of CJK runs (a single character stays)."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))
    pairs = lambda m: F.transform(F.sequence(F.lit(1), F.length(m) - 1), lambda i: F.substring(m, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda m: F.when(m.rlike(f"^[{CJK}]") & (F.length(m) > 1), pairs(m)).otherwise(F.array(m))))


def term_counts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, term, tf."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokenize(text)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def slugify(text: Column | str, default: str = "untitled", size: int = 80) -> Column:
    s = F.regexp_replace(F.lower(F.trim(col(text))), r"(?U)[^\w-]+", "-")
    s = F.substring(F.regexp_replace(s, r"^[-_]+|[-_]+$", ""), 1, size)
    return F.when(s == "", F.lit(default)).otherwise(s)


def raw_slug(text: Column | str, default: str = "untitled") -> Column:
    """Words joined by single hyphens; what the cut at 60 characters leaves at the end is trimmed again."""
    s = F.lower(F.regexp_replace(F.regexp_replace(col(text), r"(?U)[^\w]+", "-"), r"^[-_]+|[-_]+$", ""))
    s = F.regexp_replace(F.substring(s, 1, 60), r"[-_]+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def clean_title(text: Column | str) -> Column:
    """One line without control and format characters, at most 200 characters."""
    t = F.regexp_replace(col(text), r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), 1, 200)


def label(text: Column | str) -> Column:
    return F.regexp_replace(clean_title(text), r"[\[\]|]", " ")


def link_target(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\.md$", "")


def front_matter(text: Column | str) -> Column:
    """The head between the first two ``---`` lines, or ''."""
    return F.regexp_extract(col(text), r"(?s)^---(.*?)\n---", 1)


def split_body(text: Column | str) -> Column:
    """Text without front matter and without the trailing Sources and Related sections."""
    body = F.regexp_replace(col(text), r"(?s)^---.*?\n---", "")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)^(.*)\n## Sources\n.*$", "$1"), r"^\s+|\s+$", ""))


def embed_text(title: Column | str, body: Column | str) -> Column:
    return F.concat_ws("\n", col(title), split_body(body))


def text_sha(text: Column | str, max_chars: int = 4000) -> Column:
    return F.sha2(F.substring(col(text), 1, max_chars), 256)


def head_tail_truncate(text: Column | str, limit: int, mark: str = CUT_MARK) -> Column:
    """STRUCT<text, cut>: two thirds of the limit from the head, the rest from the tail."""
    c, head = col(text), limit * 2 // 3
    cut = F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(limit - head)))
    return F.struct(F.when(F.length(c) > limit, cut).otherwise(c).alias("text"), (F.length(c) > limit).alias("cut"))


def has_data(text: Column | str) -> Column:
    """Three or more groups of digits."""
    return F.regexp_count(col(text), F.lit(r"\d+")) >= 3


def raw_fallback(text: Column | str, raw_path: Column | str, body_max: int = 60_000) -> Column:
    """STRUCT<title, body> from a raw text: its first heading or the file's stem; the quoted head lines go."""
    t = F.regexp_replace(F.regexp_replace(col(text), r"\r\n?", "\n"), r"^(?:[ \t]*\n)+", "")
    heading = F.trim(F.regexp_extract(t, r"^[ \t]*#+([^\n]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(t, r"^[ \t]*#[^\n]*(?:\n|$)", ""), r"^(?:[ \t]*(?:>[^\n]*)?(?:\n|$))+", "")
    rest = F.regexp_replace(rest, r"^\s+|\s+$", "")
    stem = F.regexp_replace(F.substring_index(col(raw_path), "/", -1), r"\.[^.]*$", "")
    body = F.when(F.length(rest) > body_max, F.concat(F.rtrim(F.substring(rest, 1, body_max)), F.lit("\n\n[... truncated ...]"))).otherwise(rest)
    return F.struct(F.when(heading != "", heading).when(stem != "", stem).otherwise("untitled").alias("title"), body.alias("body"))


def strip_think(text: Column | str) -> Column:
    """Without leading ``<think>…</think>`` blocks."""
    return F.regexp_replace(col(text), r"(?is)^(?:\s*<think>.*?</think>\s*)+", "")


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first decodable JSON object of a text, as JSON; null if there is none."""
    import json

    decoder = json.JSONDecoder()

    def first(text):
        at = text.find("{") if isinstance(text, str) else -1
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
            except json.JSONDecodeError:
                at = text.find("{", at + 1)
        return None

    return texts.map(first)


def is_disputed(text: Column | str) -> Column:
    return col(text).rlike(DISPUTED)


def without_code(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?s)```.*?```|`[^`\n]*`", " ")


def wiki_links(text: Column | str) -> Column:
    """Targets of ``[[target|alias#part]]`` outside code, without ``.md``."""
    found = F.regexp_extract_all(without_code(text), F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))
    return F.transform(found, lambda m: F.regexp_replace(F.trim(F.substring_index(F.substring_index(m, "|", 1), "#", 1)), r"\.md$", ""))


def cite_markers(text: Column | str) -> Column:
    """Distinct numbers of ``[n]`` markers in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda m: m.cast("int")))


def drop_bad_markers(text: Column | str, n: Column) -> Column:
    """The text without markers outside 1..n."""
    bad = F.filter(cite_markers(text), lambda k: (k < 1) | (k > n))
    return F.aggregate(bad, col(text), lambda t, k: F.replace(t, F.concat(F.lit("["), k.cast("string"), F.lit("]")), F.lit("")))


def message_ids(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"<([^<>\s]+)>"), F.lit(1)), lambda m: F.lower(m))


def thread_key(references: Column | str, in_reply_to: Column | str, message_id: Column | str) -> Column:
    """The first id of References, else In-Reply-To, else Message-ID, in lower case; null if there is none."""
    return F.coalesce(*(F.get(message_ids(c), 0) for c in (references, in_reply_to, message_id)))


DEVICES = ["con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))]


def valid_space(space: Column | str) -> Column:
    """At most four segments ``[a-z0-9][a-z0-9-]{0,62}``, none a device name."""
    parts = F.split(col(space), "/")
    good = F.forall(parts, lambda p: p.rlike("^[a-z0-9][a-z0-9-]{0,62}$") & ~p.isin(DEVICES))
    return F.coalesce((F.size(parts) <= 4) & good, F.lit(False))


def valid_filename(name: Column | str) -> Column:
    n = col(name)
    bad = n.rlike(r'[\x00-\x1f\\/:*?"<>|]') | n.rlike(r"[. ]$") | n.contains("..") | (F.length(n) > 200) | F.lower(F.trim(F.substring_index(n, ".", 1))).isin(DEVICES)
    return F.coalesce(~bad & (n != ""), F.lit(False))


def is_temp_name(name: Column | str) -> Column:
    n = F.lower(col(name))
    return n.startswith(".") | n.startswith("~$") | n.rlike(r"\.(tmp|part|crdownload|lnk|url|download)$") | n.isin("thumbs.db", "desktop.ini")


def magic_ok(extension: Column | str, content: Column | str) -> Column:
    """Whether the leading bytes fit the file extension; text formats always do."""
    first = F.hex(F.substring(col(content), 1, 8))
    e = F.lower(col(extension))
    return (
        F.when(e == "pdf", F.contains(F.hex(F.substring(col(content), 1, 1024)), F.lit("255044462D")))
        .when(e.isin("docx", "xlsx"), first.startswith("504B"))
        .when(e == "png", first.startswith("89504E470D0A1A0A"))
        .when(e.isin("jpg", "jpeg"), first.startswith("FFD8FF"))
        .otherwise(F.lit(True))
    )


# Error categories by ordered tests on the lower-cased message.
ERROR_RULES = [
    ("unsupported", ["unsupported"]),
    ("too-large", ["too large"]),
    ("corrupt", ["not a valid", "malformed", "invalid xml", "badzip", "corrupt", "zip bomb", "cannot read package"]),
    ("no-access", ["permissionerror"]),
    ("unreadable", ["oserror", "filenotfound", "no extractable", "ioerror"]),
    ("location", ["unknown space", "root folder", "no space"]),
    ("bad-name", ["file name", "filename"]),
    ("linked", ["symlink", "junction", "linked"]),
]


def categorize_error(error: Column | str) -> Column:
    low, out = F.lower(F.coalesce(col(error), F.lit(""))), None
    for category, tests in ERROR_RULES:
        hit = low.contains(tests[0])
        for t in tests[1:]:
            hit = hit | low.contains(t)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("failed")


def clean_note(title: Column | str, text: Column | str, url: Column | str) -> Column:
    """STRUCT<title, text, url>: safe title of 60 characters, text without control characters, http(s) addresses only."""
    t = F.regexp_replace(F.regexp_replace(col(text), r"\r\n?", "\n"), r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    name = F.substring(F.trim(F.regexp_replace(F.regexp_replace(clean_title(title), r'[\\/:*?"<>|]', " "), r"\s+", " ")), 1, 60)
    good = F.coalesce(col(url).rlike(r"^https?://[^\s/]+") & (F.length(col(url)) <= 2000), F.lit(False))
    return F.struct(name.alias("title"), t.alias("text"), F.when(good, col(url)).alias("url"))


def is_refusal(answer: Column | str, marker: str = "근거 없음") -> Column:
    """Only the refusal marker, apart from white space and punctuation around it."""
    # Fixed value: the characters that may surround the marker.
    trimmed = F.btrim(F.coalesce(col(answer), F.lit("")), F.lit(" \t\r\n.!?。'\"`“”‘’[]()"))
    return F.regexp_replace(trimmed, r"(?U)\s+", " ") == marker


def distinct_keep_order(values: Column | str) -> Column:
    return F.array_distinct(col(values))


def context_budget(ctx_tokens: Column | int = 8192) -> Column:
    """Characters for a model's context: 90 % of what 1,500 tokens leave, 1,500 at least."""
    c = ctx_tokens if isinstance(ctx_tokens, Column) else F.lit(ctx_tokens)
    return F.greatest(F.lit(1500), ((c - 1500) * F.lit(9) / F.lit(10)).cast("int"))


def _unicode(form: str):
    """A Unicode normal form; only texts beyond ASCII are sent to Python."""
    import unicodedata

    @F.pandas_udf(T.StringType())
    def normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    def column(text: Column | str) -> Column:
        t = col(text)
        return F.coalesce(normal(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)

    return normal, column


(nfc_udf, nfc), (nfkc_udf, nfkc) = _unicode("NFC"), _unicode("NFKC")


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """Text of a page: no script, style, head or title; block tags are line feeds, cells tabs; white space squeezed."""
    import re
    from html.parser import HTMLParser

    skip = {"script", "style", "head", "title"}
    block = set("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in skip
            if tag in block:
                self.out.append("\n")
            elif tag in ("td", "th"):
                self.out.append("\t")

        def handle_endtag(self, tag):
            if tag in skip:
                self.hidden = max(0, self.hidden - 1)
            elif tag in block:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(re.sub(r"[ \t\r\f\v\n]+", " ", data))

    def read(page):
        if page is None:
            return None
        r = Reader()
        r.feed(page)
        r.close()
        lines = (re.sub(r"[ ]+", " ", x).strip() for x in "".join(r.out).split("\n"))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    return pages.map(read)


def register(spark) -> None:
    """The Python helpers as SQL functions, and SQL functions for the normal forms that are made of them."""
    from corpusloom.functions import facts, pii

    for name, fn in {"nfc": nfc_udf, "nfkc": nfkc_udf, "casefold": casefold, "html_to_text": html_to_text, "first_json_object": first_json_object}.items():
        spark.udf.register(name, fn)
    for name, start, steps in (("fact_normalize", "lower(coalesce(nfkc(t), ''))", facts.NORMAL), ("pii_normalize", "nfkc(t)", pii.NORMAL)):
        body = start
        for pattern, by in steps:
            body = f"regexp_replace({body}, r'{pattern}', r'{by}')"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
