"""Files in, files out: scans, text and mail readers, articles, vaults, question sets, trial logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.operators.ordering import positions, running_sum
from corpusloom.sources.extract import decode
from corpusloom.storage import saved

EXTENSIONS = ("md", "txt", "eml", "docx", "xlsx", "pdf", "png", "jpg", "jpeg")
MAX_BYTES = 50_000_000
MAX_DEPTH = 6


def _relative(root: str, path: Column) -> Column:
    """Path below ``root``, whatever scheme and authority Spark puts before it."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") if ":" in root else "/" + root.strip("/")
    return F.regexp_replace(F.substring(plain(path), len(base) + 1, 100_000), r"^/+", "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, content of all files below a folder; the content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(root, F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def scan_files(spark: SparkSession, root: str, aliases: DataFrame | None = None) -> DataFrame:
    """path, size, mtime, space, reason, category of inbox files; reason is null for files to take in.

    Root folders that begin with ``_`` and housekeeping names are skipped; files at the root, deeper than six folders,
    with bad names, or in folders that are no space (and have no alias) are rejected.
    """
    files = list_files(spark, root).drop("content")
    parts = F.split("path", "/")
    rows = files.withColumn("name", F.element_at(parts, -1)).withColumn("folder", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")))
    rows = rows.where(~F.col("path").startswith("_") & ~tx.is_temp_name("name"))
    if aliases is not None:
        from corpusloom.operators.access import resolve_alias

        known = resolve_alias(rows.where("folder is not null").select("folder"), aliases)
        rows = rows.join(known, "folder", "left")
    else:
        rows = rows.withColumn("space", F.lit(None).cast("string"))
    space = F.coalesce("space", F.when(tx.valid_space("folder"), F.col("folder")))
    reason = (
        F.when(F.col("folder").isNull(), "root-file").when(F.size(parts) - 1 > MAX_DEPTH, "too-deep").when(~tx.valid_filename("name"), "bad-name")
        .when(space.isNull(), "unknown-space").when(~F.lower(F.substring_index("name", ".", -1)).isin(*EXTENSIONS), "unsupported").when(F.col("size") > MAX_BYTES, "too-large")
    )
    category = F.when(reason.isin("root-file", "too-deep", "unknown-space"), "location").otherwise(reason)
    return rows.select("path", "size", "mtime", space.alias("space"), reason.alias("reason"), category.alias("category"))


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """doc_id (path below the last ``corpus`` folder), path, space (first folder); files at the root are left out."""
    files = list_files(spark, root).select("path")
    doc = F.regexp_replace("path", r"^(?:.*/)?corpus/", "")
    return files.select(doc.alias("doc_id"), "path").where(F.contains("doc_id", F.lit("/"))).withColumn("space", F.substring_index("doc_id", "/", 1))


@F.pandas_udf(T.StringType())
def decode_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as text: see ``extract.decode``."""
    for s in parts:
        yield s.map(lambda data: None if data is None else decode(bytes(data)))


def read_text_docs(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, title (first level-1 heading, else the file's stem), text, error of ``files(path, size, content)``.

    A file of more than ``max_bytes`` is a row without text whose error is ``too-large``.
    """
    fits = F.col("size") <= max_bytes
    rows = files.select("path", decode_bytes(F.when(fits, F.col("content"))).alias("text"), F.when(~fits, "too-large").alias("error"))
    heading = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*#*\s*$", 1))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return rows.select("path", F.when(heading != "", heading).otherwise(stem).alias("title"), "text", "error")


MAIL = "path string, subject string, body string, date string, sender string, recipients string, cc string, message_id string, in_reply_to string, references string, attachments array<struct<name:string,content:binary>>"


def read_mail(files: DataFrame) -> DataFrame:
    """A row per message of ``files(path, content)``, attachments with unique names, forwarded messages as text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        import email.policy
        import os

        def text_of(part):
            try:
                return part.get_content()
            except (LookupError, UnicodeDecodeError):
                return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")

        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                m = email.message_from_bytes(bytes(data), policy=email.policy.default)
                body, kept, names, forwarded = "", [], {}, 0
                for part in m.walk() if not m.is_multipart() else m.iter_parts():
                    kind = part.get_content_type()
                    if kind == "message/rfc822":
                        forwarded += 1
                        name, content = f"forwarded-{forwarded}.txt", str(part.get_payload(0)).encode("utf-8", "replace")
                    elif part.get_filename():
                        name, content = os.path.basename(part.get_filename()), part.get_payload(decode=True) or b""
                    else:
                        chosen = part.get_body(("plain", "html")) if part.is_multipart() else part
                        if not body and chosen is not None and chosen.get_content_maintype() == "text":
                            body = text_of(chosen)
                        continue
                    low = name.lower()
                    names[low] = names.get(low, 0) + 1
                    if names[low] > 1:
                        stem, ext = os.path.splitext(name)
                        while f"{stem}-{names[low]}{ext}".lower() in names:
                            names[low] += 1
                        name = f"{stem}-{names[low]}{ext}"
                        names[name.lower()] = 1
                    kept.append({"name": name, "content": content})
                head = lambda h: str(m.get(h, "") or "")
                out.append((path, head("subject"), body.replace("\r\n", "\n").strip(), head("date"), head("from"), head("to"), head("cc"), head("message-id"), head("in-reply-to"), head("references"), kept))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MAIL.split(", ")])

    return files.select("path", "content").mapInPandas(read, MAIL)


def parse_articles(texts: DataFrame) -> DataFrame:
    """path, title, body, updated, sources (``raw/…`` only), related (``….md`` only) of ``texts(path, text)``."""
    head = tx.front_matter("text")
    scalar = lambda k: F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)
    plain = lambda c: F.coalesce(F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0)), c)
    many = lambda k: F.coalesce(F.from_json(scalar(k), "array<string>"), F.array().cast("array<string>"))
    title = F.trim(plain(scalar("title")))
    return texts.select(
        "path", F.when(title != "", title).otherwise(F.col("path")).alias("title"), F.regexp_replace(F.regexp_replace(tx.split_body("text"), r"\A# [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"),
        F.try_to_date(plain(scalar("updated")), "yyyy-MM-dd").alias("updated"), F.filter(many("sources"), lambda s: s.startswith("raw/")).alias("sources"), F.filter(many("related"), lambda s: s.endswith(".md")).alias("related"),
    )


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return parse_articles(texts.select(_relative(root, F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")))


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def parse_front(heads: pd.Series) -> pd.Series:
    """Front matter as lists: ``key: value``, ``key: [a, b]``, and ``- item`` lines below a key."""

    def parse(head):
        out, key = {}, None
        for line in (head or "").split("\n"):
            item = line.strip()
            if item.startswith("- ") and key:
                out[key].append(item[2:].strip().strip("\"'"))
            elif ":" in line and not line.startswith((" ", "\t", "-")):
                key, _, value = line.partition(":")
                key, value = key.strip(), value.strip()
                many = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") and not value.startswith("[[") else [value]
                out[key] = [v.strip().strip("\"'") for v in many if v.strip()]
        return out

    return heads.map(parse)


def parse_vault(texts: DataFrame) -> DataFrame:
    """folder, path, name, front, body of ``texts(path, text)``; templates and dot files are left out."""
    rows = texts.where(F.contains("path", F.lit("/")) & ~F.col("path").rlike(r"(^|/)(\.|_templates/)"))
    return rows.select(F.substring_index("path", "/", 1).alias("folder"), "path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("name"), parse_front(tx.front_matter("text")).alias("front"), F.regexp_replace("text", r"(?s)^---.*?\n---[ \t]*\n?", "").alias("body"))


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return parse_vault(texts.select(_relative(root, F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")))


QA = "id string, space string, question string, type string, gold_docs array<string>, gold_facts array<string>, gold_answer string, split string, leak_facts array<string>, stale_docs array<string>"
TYPES = ("lookup", "numeric", "latest", "multi_doc", "paraphrase", "conflict", "unanswerable", "cross_space")


def read_qa(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """Questions as rows; an unknown type or split stops the read."""
    qa = spark.read.schema(QA).json(path)
    for c in ("gold_docs", "gold_facts", "leak_facts", "stale_docs"):
        qa = qa.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    qa = qa.withColumn("gold_docs", F.transform("gold_docs", lambda d: F.regexp_replace(F.replace(d, F.lit("\\"), F.lit("/")), r"^(?:.*/)?corpus/", "")))
    good = F.coalesce(F.col("type").isin(*TYPES) & F.col("split").isin("tune", "heldout"), F.lit(False))
    qa = qa.withColumn("type", F.when(F.assert_true(good, F.lit("unknown type or split")).isNull(), F.col("type")))
    return qa if split == "all" else qa.where(F.col("split") == split)


TRIALS = "stage string, seed long, hash string, cfg map<string,string>, score double, params map<string,string>, metrics map<string,string>, rejected boolean, ts double, trial long"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Logged trials; a torn line is dropped."""
    return spark.read.schema(TRIALS).option("mode", "DROPMALFORMED").json(path).where("hash is not null")


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").json(path)


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path", "model"), ["path", "model"], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def select_embeddings(emb: DataFrame, paths: DataFrame) -> DataFrame:
    return emb.join(paths.select("path").distinct(), "path", "left_semi")


def _numbered(stems: DataFrame, stem: str = "stem") -> DataFrame:
    """``stems`` with (base, n): a file's name is number 1 of itself and, if it ends in ``-n``, number n of what is before."""
    whole, n = F.struct(F.col(stem).alias("base"), F.lit(1).cast("long").alias("n")), F.regexp_extract(stem, r"-([1-9][0-9]{0,17})$", 1)
    parts = F.struct(F.regexp_extract(stem, r"^(.*)-[0-9]+$", 1).alias("base"), n.try_cast("long").alias("n"))
    rows = stems.select("*", F.explode(F.array(whole, parts)).alias("_x"))
    return rows.select(*stems.columns, "_x.base", "_x.n").where("base = stem or n > 1")


def _line(name: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))


def raw_base(today: str) -> Column:
    """The name of a record before its number, of title, source_name, published and space."""
    title, source = _line("title"), _line("source_name")
    named = F.when(title != "", title).otherwise(F.regexp_replace(F.substring_index(source, "/", -1), r"(?<=.)\.[^.]*$", ""))
    return F.concat(F.lit("raw/"), "space", F.lit("/"), F.date_format(F.coalesce("published", F.to_date(F.lit(today))), "yyyy-MM-dd"), F.lit("-"), tx.raw_slug(named))


def raw_content(today: str) -> Column:
    """A record's text: a head of title, source and dates, then the text."""
    published = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("Unknown"))
    return F.concat(F.lit("# "), _line("title"), F.lit("\n\n> Source: "), _line("source_name"), F.lit("\n> Collected: "), F.lit(today), F.lit("\n> Published: "), published, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))


def raw_root(stem: Column | str) -> Column:
    """What all numbered names of a base have in common: nothing but their numbers tells names of one root apart."""
    return F.regexp_replace(F.regexp_replace(F.col(stem) if isinstance(stem, str) else stem, r"\.md$", ""), r"(-[0-9]+)+$", "")


def save_raw(parsed: DataFrame, existing: DataFrame, today: str) -> DataFrame:
    """raw_path, space, sha256, content, is_new of ``parsed(title, text, source_name, published, space)``.

    A file is ``raw/<space>/<published or today>-<slug>[-n].md``: the first name that is free, counting up from the plain
    one.  Content that a name before the first free one holds already is that record; equal content of one space and base
    in ``parsed`` is one record.  New contents of a base take its free names in the order of their hash.  A name that is
    the plain one of another file of ``parsed`` (``note-3`` beside ``note``) is kept for it.  Titles and source names are
    one line; an empty title is read from the source name.
    """
    rows = parsed.withColumn("content", raw_content(today)).withColumn("sha256", F.sha2("content", 256))
    rows = rows.withColumn("base", raw_base(today))
    whole, rows = rows.select("base", "sha256", "space", "content").dropDuplicates(["base", "sha256"]), saved(rows.select("base", "sha256").distinct(), "raw")
    bases = rows.select("base").distinct()
    old = _numbered(existing.select("sha256", F.regexp_replace("raw_path", r"\.md$", "").alias("stem")))
    kept_names = _numbered(bases.select(F.col("base").alias("stem"), F.lit(None).cast("string").alias("sha256"))).where("n > 1")
    taken = old.select("base", "n", "sha256").unionByName(kept_names.select("base", "n", "sha256")).join(bases, "base", "left_semi").groupBy("base", "n").agg(F.max("sha256").alias("sha256"))
    taken = saved(positions(taken, ["base"], ["n"], "rank").withColumn("free", F.col("n") - F.col("rank")), "taken")
    same = taken.where("free = 0 and sha256 is not null").groupBy("base", "sha256").agg(F.min("n").alias("held"))
    found = rows.select("base", "sha256").join(same, ["base", "sha256"], "left")
    # the j-th new row takes the j-th free number: j and the numbers that are taken before it
    fresh = positions(found.where("held is null").select("base", "sha256"), ["base"], ["sha256"], "j")
    runs = taken.groupBy("base", "free").agg(F.count(F.lit(1)).alias("c")).select("base", (2 * F.col("free") + 1).alias("at"), "c", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("j"))
    both = running_sum(runs.unionByName(fresh.select("base", (2 * F.col("j")).alias("at"), F.lit(0).cast("long").alias("c"), "sha256", "j")), ["base"], ["at"], F.col("c"), "before")
    new = both.where("j is not null").select("base", "sha256", (F.col("j") + F.col("before")).alias("n"), F.lit(True).alias("is_new"))
    done = new.unionByName(found.where("held is not null").select("base", "sha256", F.col("held").alias("n"), F.lit(False).alias("is_new")))
    path = F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise(""), F.lit(".md"))
    # texts join last, and only where they are asked for
    return whole.join(done, ["base", "sha256"]).select(path.alias("raw_path"), "space", "sha256", "content", "is_new")


def render_articles(articles: DataFrame, titles: DataFrame) -> DataFrame:
    """path, markdown of ``articles(path, title, body, updated, sources, related)`` with ``titles(path, title)``."""
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")))
    links = articles.select("path", F.posexplode("related").alias("pos", "other")).join(titles.select(F.col("path").alias("other"), F.col("title").alias("t")), "other", "left")
    links = links.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other", "t"))), lambda x: F.concat(F.lit("- [["), tx.link_target(x["other"]), F.lit("|"), tx.label(F.coalesce(x["t"], x["other"])), F.lit("]]"))), "\n").alias("links"))
    rows = articles.join(links, "path", "left")
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    title = tx.clean_title("title")
    src = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- ["), tx.label(F.substring_index(s, "/", -1)), F.lit("]("), up, s, F.lit(")"))), "\n")
    lines = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), quoted(title)), F.concat(F.lit('updated: "'), F.coalesce(F.col("updated").cast("string"), F.lit("")), F.lit('"')), F.concat(F.lit("sources: "), F.to_json("sources")),
        F.concat(F.lit("related: "), F.to_json("related")), F.lit("---"), F.concat(F.lit("# "), title), F.lit(""), "body", F.lit(""), F.lit("## Sources"), F.when(src != "", src), F.lit(""), F.lit("## Related"), F.col("links"),
    )
    return rows.select("path", F.concat(lines, F.lit("\n")).alias("markdown"))


def export_audit(audit: DataFrame, since: str, out: str | None = None) -> DataFrame:
    """Writes rows from ``since`` on as JSON lines (if ``out`` is given) and returns the marker row to append."""
    rows = audit.where(F.col("ts") >= F.to_timestamp(F.lit(since)))
    if out:
        rows.orderBy("id").write.json(out)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("audit_export").alias("action"), F.lit(since).alias("target"), F.col("n").cast("string").alias("detail"))


def space_index(articles: DataFrame, article_spaces: DataFrame) -> DataFrame:
    """space, position, line: ordered links to the articles of each space, a row a line; a space of any size is many tasks."""
    rows = articles.select("path", "title").join(article_spaces.select("path", F.explode("spaces").alias("space")), "path")
    link = F.concat(F.lit("- [["), tx.link_target("path"), F.lit("|"), tx.label("title"), F.lit("]]"))
    return positions(rows.select("space", link.alias("line")).distinct(), ["space"], ["line"]).select("space", "position", "line")


def write_space_index(index: DataFrame, root: str) -> None:
    """Text files of ``space_index``'s lines, in order within and over the files of each space's folder."""
    index.repartitionByRange("space", "position").sortWithinPartitions("space", "position").select("space", "line").write.mode("overwrite").partitionBy("space").text(root)


def raw_manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def digest_tree(manifest: DataFrame, depth: int | None = None) -> DataFrame:
    """level, prefix, digest, n of every node of a tree over ``manifest(path, sha256)``.

    A node of level L holds the files whose path's hash begins with its L hexadecimal digits.  The lowest level, ``depth``
    (without it: so that a node has about 64 files), hashes its files' sorted lines; a node above hashes the digests of its
    16 children at most.  No level gathers more than that in one row.
    """
    lines = manifest.select("path", F.concat("path", F.lit("\n"), "sha256").alias("line"), F.sha2(F.col("path").cast("string"), 256).alias("at"))
    if depth is None:
        n, depth = manifest.count(), 1
        while n > 64 * 16**depth:
            depth += 1
    node = lines.groupBy(F.substring("at", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    node = saved(node, "digests")
    tree = node.select(F.lit(depth).alias("level"), "prefix", "digest", "n")
    for level in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit(" "), x["digest"]))
        node = node.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("digest"), F.sum("n").alias("n"))
        tree = tree.unionByName(node.select(F.lit(level).alias("level"), "prefix", "digest", "n"))
    return tree


def dataset_digest(manifest: DataFrame, depth: int | None = None) -> DataFrame:
    """digest, n: one fingerprint of a file set, the root of its tree (no row for an empty one)."""
    return digest_tree(manifest, depth).where("level = 0").select("digest", "n")


def changed_files(old: DataFrame, new: DataFrame, depth: int) -> tuple[list[tuple[int, str]], DataFrame]:
    """The branches (level, prefix) in which two file sets differ (the first 1,000 of a level), and their files: path, change
    (added, removed, changed).

    Descends from the root, asking for the children of differing nodes alone; files are compared in the last branches only.
    """
    spark = old.sparkSession
    trees = [saved(digest_tree(m, depth), "tree") for m in (old, new)]
    branches: list[tuple[int, str]] = []
    at = spark.createDataFrame([("",)], "prefix string")
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).join(at, F.substring(t["prefix"], 1, max(level - 1, 0)) == at["prefix"], "left_semi") for t in trees)
        differ = saved(a.select("prefix", F.col("digest").alias("d0")).join(b.select("prefix", F.col("digest").alias("d1")), "prefix", "full_outer").where(~F.col("d0").eqNullSafe(F.col("d1"))).select("prefix"), "branches")
        branches += [(level, r.prefix) for r in differ.orderBy("prefix").limit(1000).collect()]
        at = differ
    inside = lambda m: m.join(at, F.substring(F.sha2(m["path"].cast("string"), 256), 1, depth) == at["prefix"], "left_semi")
    pairs = inside(old).select("path", F.col("sha256").alias("h0")).join(inside(new).select("path", F.col("sha256").alias("h1")), "path", "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("changed")
    return branches, pairs.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("path", change.alias("change"))
