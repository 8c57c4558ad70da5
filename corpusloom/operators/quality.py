"""Checks of a page vault and of question sets.  Pages: folder, path, name, front MAP<STRING, ARRAY<STRING>>, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.grounding import ungrounded_claims
from corpusloom.operators.matching import occurring
from corpusloom.operators.ordering import positions

RAW, WIKI, OUT = "10_raw_data", "20_ai_wiki", "30_outputs"
SPECIAL = ("_index", "_log")
# Keys that front matter must have, by folder.
REQUIRED = {WIKI: ["topic", "updated", "sources", "status"], OUT: ["date", "based_on"], RAW: ["date", "source"]}


def _finding(df: DataFrame, level: str | Column, kind: str | Column, detail: Column | str = "") -> DataFrame:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select(as_col(level).alias("level"), as_col(kind).alias("kind"), F.col("path").alias("file"), F.coalesce(as_col(detail), F.lit("")).alias("detail"))


def _first(key: str) -> Column:
    return F.get(F.try_element_at("front", F.lit(key)), F.lit(0))


def _wiki(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("folder") == WIKI) & ~F.col("name").isin(*SPECIAL)).withColumn("hub", F.coalesce(_first("type") == "hub", F.lit(False)))


def _targets(key: str) -> Column:
    """Link targets of a front-matter list, or its plain values."""
    values = F.coalesce(F.try_element_at("front", F.lit(key)), F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.coalesce(F.get(tx.wiki_links(v), F.lit(0)), tx.link_target(F.trim(v))))


def ambiguous_pages(pages: DataFrame) -> DataFrame:
    """name, position, path, n: the pages of each name that several have, in order; a name's pages are rows of any number."""
    many = pages.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return positions(pages.select("name", "path").join(many, "name"), ["name"], ["path"]).select("name", "position", "path", "n")


def ambiguous_names(pages: DataFrame) -> DataFrame:
    """A finding for each name of several pages, at the first of them; ``ambiguous_pages`` has all."""
    per = pages.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1")
    return _finding(per, "E", "ambiguous-name", F.concat("name", F.lit(": "), "n", F.lit(" pages")))


def broken_links(pages: DataFrame) -> DataFrame:
    links = pages.where(F.col("folder").isin(WIKI, OUT)).select("path", F.explode(tx.wiki_links("body")).alias("target"))
    return _finding(links.join(pages.select(F.col("name").alias("target")), "target", "left_anti"), "E", "broken-link", F.col("target"))


def missing_frontmatter(pages: DataFrame, required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    rows = pages.where(~((F.col("folder") == WIKI) & F.col("name").isin(*SPECIAL)))
    need = F.array().cast("array<string>")
    for folder, keys in required.items():
        need = F.when(F.col("folder") == folder, F.array(*map(F.lit, keys))).otherwise(need)
    have = F.map_keys(F.map_filter("front", lambda _, v: (F.size(v) > 0) & (F.get(v, F.lit(0)) != "")))
    hub = (F.col("folder") == WIKI) & F.coalesce(_first("type") == "hub", F.lit(False))
    missing = F.array_except(F.when(hub, F.array_remove(need, "sources")).otherwise(need), have)
    rows = rows.withColumn("missing", missing).where(F.size("missing") > 0)
    return _finding(rows, F.when(F.col("folder") == RAW, "W").otherwise("E"), "missing-frontmatter", F.array_join("missing", ", "))


def bad_sources(pages: DataFrame) -> DataFrame:
    """Cited raw pages that are not there, and claims of wiki pages that their cited raw pages lack."""
    wiki = _wiki(pages).where("not hub")
    cited = wiki.select("path", F.explode(_targets("sources")).alias("name"))
    raw = pages.where(F.col("folder") == RAW).groupBy("name").agg(F.min_by("body", "path").alias("text"))
    found = cited.join(raw, "name", "left")
    gone = _finding(found.where("text is null"), "E", "bad-source", F.col("name"))
    texts = found.where("text is not null").select(F.col("path").alias("id"), "text")
    bodies = wiki.join(texts.select(F.col("id").alias("path")), "path", "left_semi").select(F.col("path").alias("id"), "body")
    claims = ungrounded_claims(bodies, texts).withColumnRenamed("id", "path")
    return gone.unionByName(_finding(claims, "E", F.concat(F.lit("ungrounded-"), "kind"), F.col("value")))


STATUS = r"(?m)^> \*\*Status: (Outdated|Disputed)\*\*[^\n]*(?:\n+[^\n]*)?"


def bad_status(pages: DataFrame) -> DataFrame:
    blocks = _wiki(pages).where("not hub").select("path", F.explode(F.regexp_extract_all("body", F.lit(STATUS), F.lit(0))).alias("b"))
    kind = F.regexp_extract("b", r"Status: (\w+)", 1)
    rest = F.trim(F.regexp_extract("b", r"\*\*Status: \w+\*\*([^\n]*)", 1))
    good = (rest != "") & F.col("b").rlike(r"\n>") & ((kind != "Outdated") | rest.rlike(r"\(\d{4}-\d{2}-\d{2}[,)]"))
    return _finding(blocks.where(~good), "E", "bad-status", F.concat(F.lit("Status: "), kind))


def stale_drafts(pages: DataFrame, today: str, days: int = 30) -> DataFrame:
    updated = _first("updated")
    rows = _wiki(pages).where("not hub").where((F.lower(_first("status")) == "draft") & (F.try_to_date(updated, "yyyy-MM-dd") < F.date_sub(F.to_date(F.lit(today)), days)))
    return _finding(rows, "W", "stale-draft", F.concat(F.lit("draft since "), updated))


def private_in_output(pages: DataFrame) -> DataFrame:
    """Private pages that feed outputs for others, and claims of outputs that their base pages lack."""
    outs = pages.where(F.col("folder") == OUT)
    wiki = pages.where(F.col("folder") == WIKI).select("name", F.lower(F.coalesce(_first("visibility"), F.lit(""))).alias("visibility"), F.col("body").alias("text"))
    base = outs.select("path", F.lower(F.coalesce(_first("audience"), F.lit("internal"))).alias("audience"), F.explode(_targets("based_on")).alias("name")).join(wiki, "name")
    private = _finding(base.where("audience <> 'private' and visibility = 'private'"), "E", "private-in-output", F.concat("name", F.lit(" is private")))
    bodies = outs.join(base.select("path"), "path", "left_semi").select(F.col("path").alias("id"), "body")
    claims = ungrounded_claims(bodies, base.select(F.col("path").alias("id"), "text")).withColumnRenamed("id", "path")
    return private.unionByName(_finding(claims, "E", F.concat(F.lit("ungrounded-"), "kind"), F.col("value")))


PENDING = "## 처리 대기"


def _index(pages: DataFrame) -> DataFrame:
    at = F.instr("body", PENDING)
    head = F.when(at > 0, F.substring("body", F.lit(1), at - 1)).otherwise(F.col("body"))
    tail = F.when(at > 0, F.substring("body", at, F.length("body"))).otherwise("")
    return pages.where((F.col("folder") == WIKI) & (F.col("name") == "_index")).select("path", head.alias("head"), tail.alias("tail"))


def index_check(pages: DataFrame) -> DataFrame:
    """Pages that the index lacks, entries without a page, and dates that differ; a long index may come as rows of its lines, without its pending part."""
    index, wiki = _index(pages), _wiki(pages)
    listed = index.select("path", F.explode(F.array_distinct(tx.wiki_links("head"))).alias("name")).distinct()
    names = wiki.select("name", _first("updated").alias("updated"))
    both = names.withColumn("page", F.lit(True)).join(listed.select("name", F.lit(True).alias("entry")), "name", "full_outer")
    kind = F.when(F.col("entry").isNull(), "index-missing").when(F.col("page").isNull(), "index-dangling")
    apart = both.withColumn("kind", kind).where("kind is not null").crossJoin(F.broadcast(index.select("path").limit(1)))
    line = r"\[\[[^\]\n]+\]\][^\n]*?\(updated: \d{4}-\d{2}-\d{2}\)"
    dated = index.select("path", F.explode(F.regexp_extract_all("head", F.lit(line), F.lit(0))).alias("m")).select("path", F.get(tx.wiki_links("m"), F.lit(0)).alias("name"), F.regexp_extract("m", r"updated: (\S+)\)", 1).alias("date"))
    differ = dated.join(names, "name").where("updated <> '' and updated <> date")
    none = pages.agg(F.count_if((F.col("folder") == WIKI) & (F.col("name") == "_index")).alias("n")).where("n = 0").select(F.lit(f"{WIKI}/_index.md").alias("path"))
    return (
        _finding(apart, "E", F.col("kind"), F.col("name"))
        .unionByName(_finding(differ, "E", "index-date", F.format_string("%s: index %s / page %s", "name", "date", "updated")))
        .unionByName(_finding(none, "E", "no-index"))
    )


def orphans(pages: DataFrame) -> DataFrame:
    wiki = _wiki(pages)
    edges = wiki.select(F.col("name").alias("src"), F.explode(tx.wiki_links("body")).alias("name")).where("src <> name")
    return _finding(wiki.where("not hub").join(edges, "name", "left_anti"), "W", "orphan", F.lit("no other wiki page links here"))


def unprocessed_raw(pages: DataFrame) -> DataFrame:
    raw = pages.where(F.col("folder") == RAW)
    cited = _wiki(pages).select(F.explode(_targets("sources")).alias("name"))
    log = pages.where((F.col("folder") == WIKI) & (F.col("name") == "_log")).select(F.explode(F.split("body", "\n")).alias("line"))
    none = log.where(F.lower("line").contains("no material")).select(F.explode(tx.wiki_links("line")).alias("name"))
    pending = _index(pages).select(F.explode(tx.wiki_links("tail")).alias("name")).distinct().withColumn("listed", F.lit(True))
    rows = raw.join(cited, "name", "left_anti").join(none, "name", "left_anti").join(pending, "name", "left")
    return _finding(rows, F.when(F.col("listed"), "I").otherwise("W"), F.when(F.col("listed"), "raw-pending").otherwise("raw-unprocessed"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind (raw-deleted, raw-changed, raw-new) of two tables ``(path, sha256)``."""
    both = old.select("path", F.col("sha256").alias("h0")).join(new.select("path", F.col("sha256").alias("h1")), "path", "full_outer")
    kind = F.when(F.col("h1").isNull(), "raw-deleted").when(F.col("h0").isNull(), "raw-new").when(F.col("h0") != F.col("h1"), "raw-changed")
    return both.select("path", kind.alias("kind")).where("kind is not null")


def check_vault(pages: DataFrame, today: str) -> DataFrame:
    """All findings, each once."""
    parts = [ambiguous_names(pages), broken_links(pages), missing_frontmatter(pages), bad_sources(pages), bad_status(pages), stale_drafts(pages, today), private_in_output(pages), index_check(pages), orphans(pages), unprocessed_raw(pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def verify_corpus(docs: DataFrame, least: int = 150, most: int = 600) -> DataFrame:
    """doc, problem: no level-1 heading, or a number of words outside the range."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    problems = F.filter(F.array(F.when(~F.col("text").rlike(r"(?m)^# \S"), "no-heading"), F.when(~words.between(least, most), "length")), lambda p: p.isNotNull())
    return docs.select("doc", F.explode(problems).alias("problem"))


def verify_qa(qa: DataFrame, docs: DataFrame) -> DataFrame:
    """id, problem, value: repeated ids, empty fields, gold, stale and leak entries that the documents do not bear out."""
    texts = docs.select(F.col("doc"), F.col("space").alias("doc_space"), "text")
    out = [qa.groupBy("id").count().where("count > 1").select("id", F.lit("repeated-id").alias("problem"), F.lit("").alias("value"))]
    out.append(qa.where("coalesce(question, '') = '' or coalesce(space, '') = '' or coalesce(type, '') = ''").select("id", F.lit("empty-field").alias("problem"), F.lit("").alias("value")))
    gold = qa.select("id", "space", "type", F.explode("gold_docs").alias("doc")).join(texts, "doc", "left")
    out.append(gold.where("text is null").select("id", F.lit("gold-missing").alias("problem"), F.col("doc").alias("value")))
    out.append(gold.where("text is not null and doc_space <> space and type <> 'cross_space'").select("id", F.lit("gold-other-space").alias("problem"), F.col("doc").alias("value")))
    facts = qa.where(F.size("gold_docs") > 0).select("id", F.explode("gold_facts").alias("fact"))
    seen = facts.join(gold.select("id", "text"), "id").groupBy("id", "fact").agg(F.coalesce(F.bool_or(F.contains("text", "fact")), F.lit(False)).alias("ok"))
    out.append(seen.where("not ok").select("id", F.lit("fact-missing").alias("problem"), F.col("fact").alias("value")))
    stale = qa.select("id", F.explode("stale_docs").alias("doc")).join(texts.select("doc"), "doc", "left_anti")
    out.append(stale.select("id", F.lit("stale-missing").alias("problem"), F.col("doc").alias("value")))
    out.append(qa.where("type = 'multi_doc'").where(F.size("gold_docs") < 2).select("id", F.lit("one-document").alias("problem"), F.lit("").alias("value")))
    found = out[0]
    for p in out[1:]:
        found = found.unionByName(p)
    return found


def absent_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc, line_no, term of lines of ``docs(doc, text)`` that hold a forbidden term or all words of a combination.

    The words of ``terms(term, words ARRAY<STRING>)`` are one automaton, and each line is read once.  Empty words are always
    held; a rule without others matches nothing.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.array_distinct(F.filter("words", lambda w: w != ""))
    rules = terms.select("term", words.alias("words")).where(F.size("words") > 0).distinct()
    rules = rules.select("term", "words", F.size("words").alias("need"), F.explode("words").alias("pattern"))
    held = occurring(lines, rules.select("pattern"), ["doc", "line_no"], "line").join(rules, "pattern")
    full = held.groupBy("doc", "line_no", "term", "words").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need")
    return full.select("doc", "line_no", "term")
