"""Masking of personal data in text columns: normalise, then ordered replacements with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import col, nfkc

_GAP, _AREA = r"[-\s.]?", r"(?:1[016-9]|2|[3-6]\d|70)"
# Patterns in the order of their replacement; the stricter ones come first (fixed formats).
MASKS = [
    ("email", "[EMAIL]", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,}"),
    ("rrn", "[RRN]", r"(?<!\d)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[-\s]{0,2}[1-8]\d{6}(?!\d)"),
    ("card", "[CARD]", r"(?<!\d)\d{4}([-\s]?)\d{4}\1\d{4}\1\d{4}(?!\d)"),
    ("card", "[CARD]", r"(?<!\d)\d{4}([-\s]?)\d{6}\1\d{5}(?!\d)"),
    ("brn", "[BRN]", r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)"),
    ("phone", "[PHONE]", rf"(?<!\d)(?:\+\s?82|82){_GAP}(?:\(0\){_GAP})?0?{_AREA}{_GAP}\d{{3,4}}{_GAP}\d{{4}}(?!\d)"),
    ("phone", "[PHONE]", rf"(?<!\d)\(0{_AREA}\){_GAP}\d{{3,4}}{_GAP}\d{{4}}(?!\d)"),
    ("phone", "[PHONE]", rf"(?<!\d)0{_AREA}{_GAP}\d{{3,4}}{_GAP}\d{{4}}(?!\d)"),
]
DASHES = "‐‑‒–—―−﹘﹣－"
KINDS = ("email", "rrn", "card", "brn", "phone")


#: after NFKC: dashes as ``-``, format characters dropped
NORMAL = [(f"[{DASHES}]", "-"), (r"\p{Cf}", "")]
#: every pattern but the e-mail's has nine digits or more, at most four other characters apart
_DIGITS = r"(?:\d\D{0,4}){8}\d"


def pii_normalize(text: Column | str) -> Column:
    """NFKC, dashes as ``-``, format characters dropped."""
    out = nfkc(col(text))
    for pattern, by in NORMAL:
        out = F.regexp_replace(out, pattern, by)
    return out


def _marks(text: Column, token: str) -> Column:
    """How often ``token`` occurs in a text."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return F.when(F.contains(text, F.lit(token)), (gone / len(token)).cast("int")).otherwise(0)


def mask_normalized(text: Column | str) -> Column:
    """STRUCT<text, counts MAP<kind, n>> of a text that is normalised already; kinds without a hit are left out.

    Patterns are only tried on texts that can match; a kind's count is what its marks have grown by.
    """
    tokens = {kind: token for kind, token, _ in MASKS}

    def mask(t: Column) -> Column:
        numbers = [(token, pattern) for kind, token, pattern in MASKS if kind != "email"]
        out = F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, MASKS[0][2], MASKS[0][1])).otherwise(t)
        masked = out
        for token, pattern in numbers:
            masked = F.regexp_replace(masked, pattern, token)
        return F.when(t.rlike(_DIGITS), masked).otherwise(out)

    def count(before: Column, after: Column) -> Column:
        found = F.create_map(*(x for k in KINDS for x in (F.lit(k), _marks(after, tokens[k]) - _marks(before, tokens[k]))))
        return F.struct(after.alias("text"), F.map_filter(found, lambda _, n: n > 0).alias("counts"))

    # arrays of one element bind the text and the masked text, so that neither is computed more than once
    one = F.transform(F.array(col(text)), lambda t: F.struct(t.alias("before"), mask(t).alias("after")))
    return F.get(F.transform(one, lambda x: count(x["before"], x["after"])), F.lit(0))


def pii_mask(text: Column | str) -> Column:
    return mask_normalized(pii_normalize(col(text)))


def mask_one_line(text: Column | str) -> Column:
    masked = pii_mask(text)
    return F.struct(F.trim(F.regexp_replace(masked["text"], r"(?U)\s+", " ")).alias("text"), masked["counts"].alias("counts"))


def mask_document(docs: DataFrame, flag: str = "mask", columns: tuple[str, ...] = ("text",), lines: tuple[str, ...] = ("title", "source_name")) -> DataFrame:
    """Rows with masked columns where ``flag`` holds, and ``pii_counts`` summed over them.

    ``metadata`` (a map, if there) has its values masked too; its counts are added.
    """
    out, counts = docs, []
    for c in (*columns, *lines):
        if c in docs.columns:
            out = out.withColumn(f"_m_{c}", pii_mask(c) if c in columns else mask_one_line(c))
            out = out.withColumn(c, F.when(F.col(flag), F.col(f"_m_{c}.text")).otherwise(F.col(c)))
            counts.append(F.when(F.col(flag), F.col(f"_m_{c}.counts")).otherwise(F.create_map().cast("map<string,int>")))
    if "metadata" in docs.columns:
        values = F.map_values("metadata")
        out = out.withColumn("_flat", pii_normalize(F.array_join(values, "\x01")))
        masked = F.transform(F.split("_flat", "\x01"), mask_normalized)
        out = out.withColumn("_masked", masked)
        out = out.withColumn("metadata", F.when(F.col(flag) & (F.size("metadata") > 0), F.map_from_arrays(F.map_keys("metadata"), F.transform("_masked", lambda m: m["text"]))).otherwise(F.col("metadata")))
        empty = F.create_map().cast("map<string,int>")
        total = F.aggregate("_masked", empty, lambda a, m: F.map_zip_with(a, m["counts"], lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))
        counts.append(F.when(F.col(flag), total).otherwise(empty))
    total = counts[0]
    for c in counts[1:]:
        total = F.map_zip_with(total, c, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    out = out.withColumn("pii_counts", total)
    return out.drop(*(c for c in out.columns if c.startswith("_m_")), "_flat", "_masked")


# The formats of the audit.
SCANS = {
    "rrn": r"\b\d{6}-?[1-4]\d{6}\b",
    "card": r"\b(?:\d{4}[- ]){3}\d{4}\b",
    "mobile": r"\b01[016789]-?\d{3,4}-?\d{4}\b",
    "landline": r"\b0(?:2|[3-6]\d)-\d{3,4}-\d{4}\b",
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
}


def pii_scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, kind, value of personal data that is not plainly fictitious: addresses below ``.example``, mobile numbers that
    begin with ``010-0000-``, landline numbers with ``-0000-``."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(f"(?U){pattern}"), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.flatten(F.array(*(of(k, p) for k, p in SCANS.items())))
    rows = docs.select(F.col(doc).alias("doc"), F.explode(found).alias("x")).select("doc", "x.kind", "x.value")
    kind, value = F.col("kind"), F.col("value")
    fake = (kind == "email") & value.endswith(".example") | (kind == "mobile") & value.startswith("010-0000-") | (kind == "landline") & value.contains("-0000-")
    return rows.where(~fake)
