"""Access control and upkeep of articles, sources and ledgers: equi joins, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _labelled(sources: DataFrame, raw_files: DataFrame) -> DataFrame:
    """path, space of each source edge; an unknown or empty label is null."""
    labels = raw_files.select("raw_path", F.when(F.col("space") != "", F.col("space")).alias("space"))
    return sources.select(F.col("article_path").alias("path"), "raw_path").join(labels, "raw_path", "left").select("path", "space")


def article_spaces(sources: DataFrame, raw_files: DataFrame) -> DataFrame:
    """path, spaces: the sorted label set of an article's sources; empty if any source has no label."""
    per = _labelled(sources, raw_files).groupBy("path").agg(F.array_sort(F.collect_set("space")).alias("s"), F.bool_or(F.col("space").isNull()).alias("open"))
    return per.select("path", F.when(F.col("open"), F.array().cast("array<string>")).otherwise(F.col("s")).alias("spaces"))


def acl_keys(users: DataFrame) -> DataFrame:
    """user_id, acl_key, spaces: users with the same spaces share a key, so work is done once per key."""
    spaces = F.array_sort(F.array_distinct(F.filter(F.coalesce("spaces", F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))))
    return users.select("user_id", spaces.alias("spaces")).withColumn("acl_key", F.sha2(F.to_json("spaces"), 256))


def readable_articles(sources: DataFrame, raw_files: DataFrame, users: DataFrame) -> DataFrame:
    """acl_key, path of the articles with a source whose every source has a label that the key's spaces hold.

    Distinct label sets of articles meet distinct space sets of users: an article's set counts, per key, how many of its
    labels are held, and all must be.  The join is on the label, so its size follows the edges between them.
    """
    spaces = article_spaces(sources, raw_files).where(F.size("spaces") > 0).withColumn("set", F.to_json("spaces"))
    sets = spaces.select("set", "spaces").distinct()
    held = acl_keys(users).select("acl_key", F.explode("spaces").alias("space")).distinct()
    open_sets = (
        sets.select("set", F.size("spaces").alias("n"), F.explode("spaces").alias("space"))
        .join(held, "space").groupBy("acl_key", "set", "n").agg(F.count(F.lit(1)).alias("got")).where("got = n")
    )
    return open_sets.join(spaces.select("path", "set"), "set").select("acl_key", "path")


def can_read(doc_spaces: Column | str, user_spaces: Column | str) -> Column:
    d, u = (F.col(c) if isinstance(c, str) else c for c in (doc_spaces, user_spaces))
    return F.coalesce((F.size(d) > 0) & (F.size(F.array_except(d, u)) == 0) & ~F.exists(d, lambda s: s.isNull() | (s == "")), F.lit(False))


def filter_readable(docs: DataFrame, spaces: list[str]) -> DataFrame:
    """Rows of ``docs(…, spaces)`` that an asker with ``spaces`` may read."""
    return docs.where(can_read("spaces", F.array(*map(F.lit, spaces)).cast("array<string>")))


def articles_with_spaces(spaces_df: DataFrame, spaces: list[str]) -> DataFrame:
    """Articles whose label set is exactly ``spaces``."""
    wanted = F.array(*map(F.lit, sorted(set(spaces)))).cast("array<string>")
    return spaces_df.where(F.array_sort("spaces") == wanted).select("path")


def related_same_space(related: DataFrame, spaces_df: DataFrame) -> DataFrame:
    """path, related: edges ``(path, pos, other)`` kept to existing articles of the same label set, in order, once."""
    sets = spaces_df.select("path", F.to_json("spaces").alias("set"))
    pairs = related.where("path <> other").join(sets, "path").join(sets.toDF("other", "set"), ["other", "set"])
    first = pairs.groupBy("path", "other").agg(F.min("pos").alias("pos"))
    return first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda x: x["other"]).alias("related"))


def _ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def policy_for_space(spaces: DataFrame, policy: DataFrame, default: bool = True) -> DataFrame:
    """space, flag of the nearest ancestor (or the space itself) in ``policy(space, flag)``."""
    up = spaces.select("space").distinct().select("space", F.explode(_ancestors(F.col("space"))).alias("at"))
    found = up.join(policy.select(F.col("space").alias("at"), "flag"), "at", "left")
    near = F.max_by("flag", F.when(F.col("flag").isNotNull(), F.length("at")))
    return found.groupBy("space").agg(F.coalesce(near, F.lit(default)).alias("flag"))


def resolve_alias(folders: DataFrame, aliases: DataFrame) -> DataFrame:
    """folder, space of the longest alias that is a folder prefix (case does not count); null if there is none."""
    up = folders.select("folder").distinct().select("folder", F.explode(_ancestors(F.lower("folder"))).alias("at"))
    found = up.join(aliases.select(F.lower("alias").alias("at"), F.col("space").alias("to")), "at", "left")
    return found.groupBy("folder").agg(F.max_by("to", F.when(F.col("to").isNotNull(), F.length("at"))).alias("space"))


def register_raw(existing: DataFrame, new: DataFrame) -> DataFrame:
    """raw_path, status (new, same, conflict, refused) of ``new(raw_path, space, sha256)`` against the registered rows."""
    old = existing.select("raw_path", F.col("space").alias("s0"), F.col("sha256").alias("h0"))
    status = (
        F.when(F.coalesce(F.col("space"), F.lit("")) == "", "refused").when(F.col("h0").isNull() & F.col("s0").isNull(), "new")
        .when(F.col("space").eqNullSafe(F.col("s0")) & F.col("sha256").eqNullSafe(F.col("h0")), "same").otherwise("conflict")
    )
    return new.join(old, "raw_path", "left").select("raw_path", status.alias("status"))


def relabel_raw(raw_files: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select("raw_path", F.col("space").alias("_new"))
    return raw_files.join(new, "raw_path", "left").withColumn("space", F.coalesce("_new", "space")).select(*raw_files.columns)


def check_sources(new_edges: DataFrame, raw_files: DataFrame) -> DataFrame:
    """article_path, raw_path, reason of edges ``(article_path, raw_path, space)`` that break a rule."""
    known = raw_files.select("raw_path", F.col("space").alias("has"))
    reason = F.when(~F.col("raw_path").startswith("raw/"), "not-raw").when(F.col("has").isNull(), "unregistered").when(F.col("has") != F.col("space"), "other-space")
    return new_edges.join(known, "raw_path", "left").select("article_path", "raw_path", reason.alias("reason")).where("reason is not null")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_articles(articles: DataFrame, new: DataFrame) -> DataFrame:
    """Rows replaced by path; ``rev`` grows by one, from 0 for a new path."""
    revs = articles.select("path", F.col("rev").alias("_rev"))
    bumped = new.drop("rev").join(revs, "path", "left").withColumn("rev", F.coalesce(F.col("_rev"), F.lit(0)).cast("long") + 1).drop("_rev")
    return upsert(articles, bumped, ["path"]).select(*articles.columns)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def delete_articles(tables: dict[str, tuple[DataFrame, str]], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables ``name -> (rows, path column)`` without the given paths; revisions are kept by whoever stores them."""
    return {n: t.join(paths.select(F.col("path").alias(c)), c, "left_anti").select(*t.columns) for n, (t, c) in tables.items()}


def already_ingested(new: DataFrame, ledger: DataFrame, raw_files: DataFrame) -> DataFrame:
    """``new`` with ``duplicate``: its (space, sha256) is in a ledger, or in an earlier row of ``new`` (by raw_path)."""
    key = ["space", "sha256"]
    seen = ledger.select(*key).union(raw_files.select(*key)).distinct().withColumn("_seen", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("raw_path")) > 1
    return new.join(seen, key, "left").withColumn("duplicate", F.coalesce("_seen", F.lit(False)) | first).drop("_seen").select(*new.columns, "duplicate")


def undo_orphans(raw_files: DataFrame, sources: DataFrame, failed: DataFrame) -> DataFrame:
    """Registered rows without those of ``failed(raw_path)`` that no article uses."""
    gone = failed.select("raw_path").join(sources.select("raw_path"), "raw_path", "left_anti")
    return raw_files.join(gone, "raw_path", "left_anti").select(*raw_files.columns)


def attachments_of(ledger: DataFrame) -> DataFrame:
    """raw_path, child_raw: mails and what was attached to them."""
    child = ledger.where("parent_raw <> ''").select(F.col("raw_path").alias("child_raw"), F.col("parent_raw").alias("raw_path"))
    return ledger.select("raw_path").distinct().join(child, "raw_path")


def detect_changes(files: DataFrame, index: DataFrame, max_size: int = 50_000_000) -> DataFrame:
    """path, status of ``files(path, size, mtime, sha256)``: new, unchanged, touched, changed, too-big, empty."""
    old = index.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.col("sha256").alias("h0"))
    status = (
        F.when(F.col("size") > max_size, "too-big").when(F.col("size") == 0, "empty").when(F.col("h0").isNull(), "new")
        .when((F.col("size") == F.col("s0")) & (F.col("mtime") == F.col("m0")), "unchanged").when(F.col("sha256") == F.col("h0"), "touched").otherwise("changed")
    )
    return files.join(old, "path", "left").select("path", status.alias("status"))


def can_open(requests: DataFrame, readable: DataFrame) -> DataFrame:
    """``requests(acl_key, path)`` with ``allowed``; denied and missing paths look the same."""
    ok = readable.select("acl_key", "path").distinct().withColumn("allowed", F.lit(True))
    return requests.join(ok, ["acl_key", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
