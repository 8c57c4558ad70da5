"""Whether the claims of derived texts occur in their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import facts as fx
from corpusloom.functions import text as tx
from corpusloom.storage import saved


def _matches(rows: DataFrame, found: list[tuple[str, Column]]) -> DataFrame:
    """id, kind, raw, digits (of dates): a row for each match of ``found(kind, matches)``; what is made of a match is made of
    rows, as functions over arrays are not compiled."""
    kinds = F.array(*(F.lit(kind) for kind, _ in found))
    lists = rows.select("id", F.posexplode(F.array(*(c for _, c in found))).alias("at", "all"))
    each = lists.select("id", F.get(kinds, F.col("at")).alias("kind"), F.explode("all").alias("raw"))
    return each.withColumn("digits", F.when(F.col("kind") == "date", fx.date_digits("raw")))


def _key() -> Column:
    """A match's key: equal for what is the same date, number or quote."""
    date = F.concat_ws("-", *(F.get("digits", F.lit(k)).cast("int") for k in range(3)))
    return F.when(F.col("kind") == "date", date).when(F.col("kind") == "number", fx.canonical_number(F.col("raw"))).otherwise(fx.squeeze(fx.unquoted("raw")))


def _claims(bodies: DataFrame) -> DataFrame:
    """id, kind, key, value of the quotes, dates and numbers of ``bodies(id, body)``; each text is taken apart once."""
    read = fx.claim_texts(bodies.select("id", "body"), "body")
    rows = _matches(read, [("quote", fx.find_quotes("quote")), *(("date", d) for d in fx.find_dates("date")), ("number", fx.find_numbers("number"))])
    number = F.rtrim("raw", F.lit(","))
    # single digits are noise
    rows = rows.where((F.col("kind") != "number") | (F.length(number) >= 2) | F.contains("raw", F.lit(".")))
    value = F.when(F.col("kind") == "number", number).when(F.col("kind") == "date", F.col("raw")).otherwise(fx.unquoted("raw"))
    return rows.select("id", "kind", _key().alias("key"), value.alias("value"))


def _source_keys(sources: DataFrame) -> DataFrame:
    rows = _matches(sources.select("id", "text"), [*(("date", d) for d in fx.find_dates("text")), ("number", fx.find_numbers("text"))])
    return rows.select("id", "kind", _key().alias("key")).distinct()


def ungrounded_claims(bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """id, kind, value of quotes, dates and numbers of ``bodies(id, body)`` that no text of ``sources(id, text)`` has.

    Dates and numbers meet by key; quotes are looked for in the id's own source texts only, each by itself: a quote that
    begins in one source and ends in the next is not grounded.
    """
    claims = saved(_claims(bodies), "claims")
    # a source's keys are many times what its size in files says: never broadcast by that
    loose = claims.where("kind <> 'quote'").join(_source_keys(sources).hint("merge"), ["id", "kind", "key"], "left_anti").select("id", "kind", "value")
    quotes = claims.where("kind = 'quote'").select("id", "key", "value")
    if quotes.isEmpty():  # then no source is read once more
        return loose
    texts = sources.join(quotes.select("id").distinct(), "id", "left_semi").select("id", fx.squeeze("text").alias("text"))
    missing = quotes.join(texts, "id", "left").groupBy("id", "value").agg(F.coalesce(F.bool_or(F.contains("text", "key")), F.lit(False)).alias("found")).where("not found")
    return loose.unionByName(missing.select("id", F.lit("quote").alias("kind"), "value"))


def lint_articles(articles: DataFrame, sources: DataFrame, raw_docs: DataFrame) -> DataFrame:
    """article, kind, value: no-source, invalid-source, missing-source, missing-article and ungrounded claims."""
    paths = articles.select(F.col("path").alias("article"), "body")
    edges = sources.select(F.col("article_path").alias("article"), "raw_path").distinct()
    known = edges.select("article").distinct()
    none = paths.join(known, "article", "left_anti").select("article", F.lit("no-source").alias("kind"), F.lit("").alias("value"))
    gone = known.join(paths, "article", "left_anti").select("article", F.lit("missing-article").alias("kind"), F.col("article").alias("value"))
    bad = ~F.col("raw_path").startswith("raw/") | F.col("raw_path").contains("..")
    mine = edges.join(paths.select("article"), "article", "left_semi")
    invalid = mine.where(bad).select("article", F.lit("invalid-source").alias("kind"), F.col("raw_path").alias("value"))
    texts = mine.where(~bad).join(raw_docs.select("raw_path", "text"), "raw_path", "left")
    missing = texts.where("text is null").select("article", F.lit("missing-source").alias("kind"), F.col("raw_path").alias("value"))
    with_source = paths.join(known, "article", "left_semi")
    claims = ungrounded_claims(with_source.select(F.col("article").alias("id"), "body"), texts.where("text is not null").select(F.col("article").alias("id"), "text"))
    return none.unionByName(gone).unionByName(invalid).unionByName(missing).unionByName(claims.withColumnRenamed("id", "article"))


def lint_disputed(articles: DataFrame) -> DataFrame:
    return articles.where(tx.is_disputed("body")).select("path").orderBy("path")
