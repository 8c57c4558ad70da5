"""Bytes to documents: a table function that calls an extractor by file extension, and gives error rows instead of failing.

An extractor takes (name, content) and yields parts: dicts of title, text, published (``YYYY-MM-DD`` or None), headers, and
``name`` and ``content`` for what is extracted in turn (attachments).  Others are added by passing a mapping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, parent int, name string, title string, text string, published string, headers map<string,string>, error string"
DEPTH = 3


def decode(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else CP949, else UTF-8 with replacements; CRLF to LF, trimmed."""
    import codecs

    marks = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
    for name in [n for mark, n in marks if data.startswith(mark)][:1] or ["utf-8", "cp949"]:
        try:
            return data.decode(name).replace("\r\n", "\n").strip()
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace").replace("\r\n", "\n").strip()


def text_parts(name: str, content: bytes) -> Iterator[dict]:
    """One part: its first level-1 heading, or the stem of its name, is the title."""
    import re

    text = decode(content)
    heading = re.search(r"(?m)^#\s+(.+?)\s*#*\s*$", text)
    yield {"title": heading[1] if heading else re.sub(r"(?<=.)\.[^.]*$", "", name.rsplit("/", 1)[-1]), "text": text}


def mail_parts(name: str, content: bytes) -> Iterator[dict]:
    """The message with its headers, then its attachments under names of their own; forwarded messages are messages."""
    import email
    import email.policy
    import email.utils
    import os

    m = email.message_from_bytes(content, policy=email.policy.default)

    def text_of(part) -> str:
        try:
            return part.get_content()
        except (LookupError, UnicodeDecodeError):
            return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")

    body, attached, taken = "", [], set()
    for part in m.iter_parts() if m.is_multipart() else [m]:
        if part.get_content_type() == "message/rfc822":
            attached.append(("forwarded.eml", part.get_payload(0).as_bytes()))
        elif part.get_filename():
            attached.append((os.path.basename(part.get_filename()), part.get_payload(decode=True) or b""))
        else:
            chosen = part.get_body(("plain", "html")) if part.is_multipart() else part
            if not body and chosen is not None and chosen.get_content_maintype() == "text":
                body = text_of(chosen)
    head = {h: str(m.get(h, "") or "") for h in ("from", "to", "cc", "date", "message-id", "in-reply-to", "references")}
    try:
        day = email.utils.parsedate_to_datetime(head["date"]).date().isoformat()
    except (TypeError, ValueError):
        day = None
    yield {"title": str(m.get("subject", "") or ""), "text": body.replace("\r\n", "\n").strip(), "published": day, "headers": head}
    for file, data in attached:
        stem, dot, ext = file.rpartition(".")
        n, unique = 1, file
        while unique.lower() in taken:
            n += 1
            unique = f"{stem}-{n}.{ext}" if dot else f"{file}-{n}"
        taken.add(unique.lower())
        yield {"name": unique, "content": data}


EXTRACTORS: Mapping[str, Callable[[str, bytes], Iterator[dict]]] = {"txt": text_parts, "md": text_parts, "eml": mail_parts}


def parts_of(name: str, content: bytes | None, extractors: Mapping, depth: int = DEPTH) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of one file: 0 is the file, then what it holds; an extractor that fails gives an error row."""
    number = 0

    def walk(name: str, data: bytes | None, parent: int | None, level: int) -> Iterator[tuple]:
        nonlocal number
        me, number = number, number + 1
        ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        error = "no-content" if data is None else "unsupported" if ext not in extractors else "too-deep" if level > depth else None
        if error:
            yield me, parent, name, None, None, None, None, error
            return
        given, inside = None, []
        try:
            for part in extractors[ext](name, data):
                if "content" in part:
                    inside.append((part["name"], part["content"]))
                elif given is None:
                    given = part
                else:
                    inside.append((name, part))
        except Exception as e:  # whatever a broken file makes of a parser is that file's row
            yield me, parent, name, None, None, None, None, f"unreadable: {type(e).__name__}"
            return
        given = given or {}
        text = given.get("text") or ""
        row = lambda n, p, g: (n, p, name, g.get("title"), g.get("text"), g.get("published"), g.get("headers"), None if (g.get("text") or "").strip() else "empty")
        yield row(me, parent, given | {"text": text})
        for sub, what in inside:
            if isinstance(what, dict):
                at, number = number, number + 1
                yield row(at, me, what)
            else:
                yield from walk(sub, what, me, level + 1)

    yield from walk(name, content, None, 0)


def extracted(files: DataFrame, extractors: Mapping[str, Callable] = EXTRACTORS) -> DataFrame:
    """``files(path, content, …)`` joined with the parts of each file."""
    known = dict(extractors)

    class Extract:
        def eval(self, path: str, content: bytes):
            yield from parts_of(path or "", None if content is None else bytes(content), known)

    table = F.udtf(Extract, returnType=SCHEMA)
    return files.lateralJoin(table(F.col("path").outer(), F.col("content").outer()))
