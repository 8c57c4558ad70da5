"""Merge decisions of a caller's model as a table job: validate, apply, link back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.access import related_same_space
from corpusloom.operators.reports import unique_paths

REPLY = "decision string, target string, topic string, title string, body string, related array<string>"
DECISIONS = ("New", "Update", "Disputed", "No material")
CAND_MAX_CHARS, MIN_UPDATE_RATIO = 6_000, 0.5


def validate_decisions(replies: DataFrame, candidates: DataFrame, raw_docs: DataFrame) -> DataFrame:
    """raw_path, decision, target, topic, title, body, related, reason.

    ``replies(raw_path, reply)``, ``candidates(raw_path, path, body)``, ``raw_docs(raw_path, text)``.  A reason names why
    a reply cannot be followed, in this order: invalid-reply, bad-target, no-material-with-data, candidate-truncated,
    empty-body, empty-title, shrink; and refused-body, refused-title for a New (or Disputed) without a body or title,
    which makes no article at all.
    """
    data = F.from_json(tx.first_json_object(tx.strip_think("reply")), REPLY)
    rows = replies.select("raw_path", data.alias("d")).select("raw_path", "d.*").withColumn("title", tx.clean_title("title")).withColumn("body", F.trim(F.col("body")))
    target = candidates.select("raw_path", F.col("path").alias("target"), F.length("body").alias("_size"))
    rows = rows.join(target, ["raw_path", "target"], "left").join(raw_docs.select("raw_path", tx.has_data("text").alias("_data")), "raw_path", "left")
    d, empty = F.col("decision"), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(d.isin(*DECISIONS), F.lit(False)), "invalid-reply")
        .when(d.isin("Update", "Disputed") & F.col("_size").isNull(), "bad-target")
        .when((d == "No material") & F.coalesce("_data", F.lit(False)), "no-material-with-data")
        .when((d == "Update") & (F.col("_size") > CAND_MAX_CHARS), "candidate-truncated")
        .when((d == "Update") & empty("body"), "empty-body").when((d == "Update") & empty("title"), "empty-title")
        .when((d == "Update") & (F.length("body") < MIN_UPDATE_RATIO * F.col("_size")), "shrink")
        .when(d.isin("New", "Disputed") & empty("body"), "refused-body").when((d == "New") & empty("title"), "refused-title")
    )
    return rows.withColumn("reason", reason).drop("_size", "_data").select("raw_path", "decision", "target", "topic", "title", "body", "related", "reason")


def apply_decisions(decisions: DataFrame, articles: DataFrame, raw_docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """path, title, body, sources, related of the articles that decisions touch.

    New articles (also the deterministic ones of rows with a reason) come from their row; their paths are unique among
    themselves and the existing ones (the space of ``raw_docs(raw_path, text, space)``, then a number, is put behind a
    taken one).  Decisions on one target are applied in the order of their raw path: its last update replaces the body,
    disputes after that are appended.  A decision's ``related`` paths are added if they are ``candidates(raw_path, path)``
    of its document (without that table: existing articles) and not the article itself.  Columns ``related`` and ``space``
    may be absent.  A null body counts as empty, a null title or topic as untitled and general; refused rows and targets
    that are no article are left out.
    """
    none = F.array().cast("array<string>")
    decisions = decisions.where("reason is null or reason not like 'refused-%'")
    decisions = decisions if "related" in decisions.columns else decisions.withColumn("related", none)
    articles = articles if "related" in articles.columns else articles.withColumn("related", none)
    raw_docs = raw_docs if "space" in raw_docs.columns else raw_docs.withColumn("space", F.lit(""))
    rows = decisions.join(raw_docs.select("raw_path", "space", tx.raw_fallback("text", "raw_path").alias("_f")), "raw_path", "left")
    fall = F.col("reason").isNotNull()
    given = rows.where(~fall).select("raw_path", F.posexplode("related").alias("pos", "other"))
    known = candidates.select("raw_path", F.col("path").alias("other")).distinct() if candidates is not None else articles.select(F.col("path").alias("other")).distinct()
    given = given.join(known, [c for c in ("raw_path", "other") if c in known.columns])
    new = rows.where(fall | (F.col("decision") == "New")).select(
        "raw_path", "space", F.concat(tx.slugify(F.when(fall, F.lit("general")).otherwise(F.coalesce("topic", F.lit("general"))), "general"), F.lit("/"), tx.slugify(F.coalesce(F.when(fall, F.col("_f.title")).otherwise(F.col("title")), F.lit("")))).alias("base"),
        F.when(fall, tx.clean_title(F.col("_f.title"))).otherwise(F.coalesce("title", F.lit(""))).alias("title"), F.when(fall, F.col("_f.body")).otherwise(F.coalesce("body", F.lit(""))).alias("body"),
    )
    space = F.coalesce(tx.slugify(F.regexp_replace("space", "/", "-")), F.lit("untitled"))
    paths = unique_paths(new.select(F.col("raw_path").alias("id"), "base", space.alias("space")), articles.select(F.regexp_replace("path", r"\.md$", "").alias("path")))
    paths = paths.select(F.col("id").alias("raw_path"), F.concat("path", F.lit(".md")).alias("path"))
    ordered = lambda rows: F.array_distinct(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["other"]))
    own = given.groupBy("raw_path").agg(ordered(F.struct("pos", "other")).alias("related"))
    new = new.join(paths, "raw_path").join(own, "raw_path", "left").select("path", "title", "body", F.array("raw_path").alias("sources"), F.array_remove(F.coalesce("related", none), F.col("path")).alias("related"))
    merge = rows.where(~fall & F.col("decision").isin("Update", "Disputed")).select(F.col("target").alias("path"), "raw_path", "decision", F.col("body").alias("new_body"))
    # what comes before a target's last update is replaced by it
    last = F.max(F.when(F.col("decision") == "Update", F.col("raw_path"))).over(Window.partitionBy("path"))
    later = (F.col("decision") == "Disputed") & F.coalesce(F.col("raw_path") > F.col("_last"), F.lit(True))
    note = F.concat(F.lit("\n\n## Disputed\n"), F.coalesce("new_body", F.lit("")), F.lit("\n(Source: "), F.col("raw_path").cast("string"), F.lit(")"))
    per = merge.withColumn("_last", last).groupBy("path").agg(
        F.max(F.when(F.col("raw_path") == F.col("_last"), F.struct(F.coalesce("new_body", F.lit("")).alias("b")))).alias("update"),
        F.array_sort(F.collect_list(F.when(later, F.struct("raw_path", note.alias("note"))))).alias("notes"), F.array_sort(F.collect_set("raw_path")).alias("raws"),
    )
    added = given.join(merge.select("raw_path", "path"), "raw_path").groupBy("path").agg(ordered(F.struct("raw_path", "pos", "other")).alias("added"))
    body = F.concat(F.when(F.col("update").isNotNull(), F.col("update.b")).otherwise(F.coalesce("body", F.lit(""))), F.array_join(F.transform("notes", lambda x: x["note"]), ""))
    done = per.join(added, "path", "left").join(articles.select("path", "title", "body", "sources", "related"), "path").select(
        "path", "title", body.alias("body"), F.array_union(F.coalesce("sources", F.array().cast(new.schema["sources"].dataType)), "raws").alias("sources"),
        F.array_remove(F.array_union(F.coalesce("related", none), F.coalesce("added", none)), F.col("path")).alias("related"))
    return new.unionByName(done)


def backlinks(related: DataFrame, touched: DataFrame, spaces_df: DataFrame) -> DataFrame:
    """path, related after every touched article's edges ``(path, pos, other)`` are also drawn the other way round."""
    mine = related.join(touched.select("path").distinct(), "path", "left_semi")
    back = mine.select(F.col("other").alias("path"), (F.lit(1_000_000) + F.col("pos")).alias("pos"), F.col("path").alias("other"))
    return related_same_space(related.unionByName(back), spaces_df)


def raw_integrity(raw_files: DataFrame, files: DataFrame) -> DataFrame:
    """raw_path, problem: outside its space's folder, unsafe name, missing, or another content than recorded."""
    rows = raw_files.join(files.select(F.col("path").alias("raw_path"), F.sha2("content", 256).alias("now")), "raw_path", "left")
    problem = (
        F.when(F.col("raw_path").contains("..") | F.col("raw_path").rlike(r"\p{Cntrl}"), "unsafe")
        .when(~F.col("raw_path").startswith(F.concat(F.lit("raw/"), F.col("space"), F.lit("/"))), "outside-space")
        .when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    )
    return rows.select("raw_path", problem.alias("problem")).where("problem is not null")
