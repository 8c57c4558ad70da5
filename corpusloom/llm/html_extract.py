"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, with their open ancestors.  A block's features
are its ancestors' tags, the words of their ``class``, ``id`` and ``role`` values, and of its text the length, share of link text,
punctuation and position.  A chain over the blocks with labels ``content`` and ``other``, decoded by Viterbi, picks the
article's blocks.  The chain is trained on labelled pages that ``training_pages`` writes from templates (semantic tags,
class-named containers, tables, bare paragraphs) around invented sentences; nothing is copied from the table.

Raw-text elements (script, style, …), comments and the head give no blocks; an svg or math that closes itself is empty.  Character references are decoded once, white
space in a block becomes single spaces, and the kept blocks are joined by two line feeds in page order.

Defined results: null and empty html give an empty text; text outside any tag is a block; unclosed and stray tags are
tolerated, a tag cut off by the end of the page is dropped; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.chain import fit_sparse, viterbi
from corpusloom.llm.common import table

# Fixed lists of HTML: elements that start a new block, that have no end tag, whose content is not text, and inline ones that hold links.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option button svg math iframe object canvas audio video title head".split())
_CLOSES_P = BLOCK - {"body", "html"}
_ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol table dl div section article aside main nav body td th blockquote form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|<[/!?a-zA-Z][^<>]*\Z", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_SPACE = re.compile(r"\s+")

Block = tuple[str, tuple[str, ...], tuple[str, ...], float]


def blocks_of(page: str | None) -> list[Block]:
    """(text, ancestor tags, ancestor names, share of link text) of the leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if not parts:
            return
        text = _SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
        if text:
            linked = sum(len(t.strip()) for t, is_link in parts if is_link)
            out.append((text, tuple(t for t, _ in stack if t in BLOCK), tuple(n for _, ns in stack for n in ns), min(1.0, linked / len(text))))
        parts.clear()

    def leave(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            links -= tag == "a"
        del stack[k:]

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((entities.unescape(page[at:]), links > 0))
            break
        if m.start() > at:
            parts.append((entities.unescape(page[at : m.start()]), links > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in ("svg", "math") and m[0].endswith("/>"):  # these may close themselves
            continue
        if tag in RAW and tag != "head":
            if (end := _RAW_END[tag].search(page, at)) or tag in ("script", "style", "noscript", "textarea", "title", "template", "iframe"):
                close = page.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            at = at if end is None else end.start() if end[0].lower().startswith("<body") else end.end()
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        leave(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
            if alike := _ALIKE.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in alike:
                        leave(k)
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl", "select"):
                        break
        if tag in VOID or (m[3] or "").rstrip().endswith("/"):
            continue
        names: tuple[str, ...] = ()
        if m[3] and ("=" in m[3]):
            names = tuple(dict.fromkeys(n for a in _ATTR.finditer(m[3]) for n in _NAME.findall((a[1] or a[2] or a[3] or "").lower())))
        stack.append((tag, names))
        links += tag == "a"
    flush()
    return out


# --- features -----------------------------------------------------------------------------------------------------

# Name stems that pages use for parts of a layout (fixed list); a name counts as the first stem that it starts with.
STEMS = {
    "menu": "nav menu navbar breadcrumb toc topbar tabs pagination pager skip toolbar",
    "side": "sidebar aside side rail widget related recommend recommended more trending popular similar",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header masthead banner logo brand top hero",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp outbrain taboola",
    "note": "cookie consent gdpr notice alert modal popup overlay toast disclaimer newsletter subscribe signup subscription paywall",
    "talk": "comment comments reply replies discussion respond disqus feedback reviews",
    "form": "form login search signin register contact input",
    "share": "share social follow facebook twitter tools print",
    "meta": "meta byline author date timestamp tags tag category categories posted",
    "main": "article content main post entry story text body page prose richtext maincontent articlebody contentbody",
}
_STEM = {s: kind for kind, stems in STEMS.items() for s in stems.split()}
_TAGS = ("html", "body", "main", "article", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "table", "td", "figure", "figcaption", "blockquote", "div", "p", "pre", "h1", "h2", "h3", "h4", "address", "details", "dialog", "menu", "fieldset")
_KINDS = tuple(STEMS)
_ROOM = 512


def _index() -> dict[str, int]:
    names = ["bias", *(f"t:{t}" for t in _TAGS), *(f"leaf:{t}" for t in _TAGS), *(f"n:{k}" for k in _KINDS), *(f"last:{k}" for k in _KINDS)]
    names += [f"len:{i}" for i in range(8)] + [f"link:{i}" for i in range(4)] + [f"stop:{i}" for i in range(4)] + ["end", "copy", "first", "last", "same", "depth", "tags>names", "inarticle+bad", "noarticle"]
    names += [f"leaf:{t}+link:{i}" for t in ("p", "li", "div", "td", "h2", "h3", "none") for i in range(4)] + [f"leaf:{t}+len:{i}" for t in ("p", "li", "div", "td", "none") for i in range(8)]
    return {n: i for i, n in enumerate(names)}


_AT = _index()
_BAD_TAGS = frozenset("nav header footer aside form menu dialog".split())


def _kind(name: str) -> str | None:
    if name in _STEM:
        return _STEM[name]
    return next((k for s, k in _STEM.items() if len(s) > 3 and name.startswith(s)), None)


def features(blocks: list[Block]) -> list[list[int]]:
    out = []
    has_article = any("article" in b[1] or "main" in b[1] for b in blocks)
    for i, (text, tags, names, linked) in enumerate(blocks):
        kinds = [k for n in names if (k := _kind(n))]
        leaf = tags[-1] if tags and tags[-1] in _TAGS else "none"
        size = min(7, len(text).bit_length() // 2 + (len(text) > 180)) if text else 0
        link = 0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3
        stops = min(3, sum(text.count(c) for c in ".,;:!?"))
        names_of = ["bias", f"len:{size}", f"link:{link}", f"stop:{stops}", f"leaf:{leaf}", f"leaf:{leaf}+link:{link}", f"leaf:{leaf}+len:{size}"]
        names_of += [f"t:{t}" for t in set(tags)] + [f"n:{k}" for k in set(kinds)]
        if kinds:
            names_of.append(f"last:{kinds[-1]}")
        if text[-1:] in ".!?\"'”»":
            names_of.append("end")
        if "©" in text or "copyright" in text.lower():
            names_of.append("copy")
        if i == 0:
            names_of.append("first")
        if i == len(blocks) - 1:
            names_of.append("last")
        if i and blocks[i - 1][1][:-1] == tags[:-1] and blocks[i - 1][2] == names:
            names_of.append("same")
        if ("article" in tags or "main" in tags) and (set(kinds) - {"main", "meta", "head"} or _BAD_TAGS & set(tags) - {"header"}):
            names_of.append("inarticle+bad")
        if has_article and "article" not in tags and "main" not in tags:
            names_of.append("noarticle")
        out.append([_AT[n] for n in names_of if n in _AT])
    return out


# --- labelled pages -----------------------------------------------------------------------------------------------


def training_pages(n: int = 700, seed: int = 23) -> list[tuple[list[Block], list[int]]]:
    """Pages from templates as (blocks, labels); label 1 is the article.  Content is marked by a sign in its words."""
    rng = random.Random(seed)
    sign = "⁣"

    def words(k: int, mark: bool) -> str:
        w = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ske", "é", "ba", "on", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(max(1, k))]
        w[0] = w[0].capitalize()
        return (sign if mark else "") + " ".join(x + ("," if rng.random() < 0.08 else "") for x in w) + rng.choice([".", ".", ".", "", "!", "?", " |"])

    def anchor(mark=False) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(rng.randint(1, 4), mark)}</a>'

    def wrap(tag: str, name: str, inner: str) -> str:
        how = rng.random()
        attr = f' class="{name}"' if how < 0.5 else f' id="{name}"' if how < 0.75 else f' class="{rng.choice(["box", "c1", "wrap"])} {name}"'
        return f"<{tag}{attr if name else ''}>{inner}</{tag}>"

    def some(kind: str) -> str:
        return rng.choice(STEMS[kind].split()) + rng.choice(["", "", "", "-box", "-wrapper", "_list", "-1"])

    def paragraph(mark: bool) -> str:
        k = rng.choice([1, 1, 2, 3, 6, 12, 25, 60, 120, 250])
        inner = words(k, mark)
        if rng.random() < 0.15:
            inner += f" {anchor()} " + words(rng.randint(2, 12), False)
        if rng.random() < 0.15:
            inner = f"<b>{inner}<br>" if rng.random() < 0.5 else f"<em>{inner}</em>"
        return inner

    def article_body() -> str:
        out = []
        for _ in range(rng.choice([1, 2, 3, 5, 9, 16])):
            r = rng.random()
            if r < 0.72:
                out.append(f"<p>{paragraph(True)}" + ("</p>" if rng.random() < 0.8 else ""))
            elif r < 0.8:
                out.append(f"<h{(h := rng.randint(2, 4))}>{words(rng.randint(1, 8), True)}</h{h}>")
            elif r < 0.87:
                out.append("<ul>" + "".join(f"<li>{words(rng.randint(1, 25), True)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.91:
                out.append(f"<blockquote><p>{words(rng.randint(5, 30), True)}</p></blockquote>")
            elif r < 0.94:
                out.append(f"<pre>{words(rng.randint(3, 20), True)}</pre>")
            elif r < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(rng.randint(1, 3), True)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(rng.choice([bad_inside, bad_inside, lambda: ""])())
        return "".join(out)

    def bad_inside() -> str:
        kind = rng.choice(["ad", "share", "side", "note", "form"])
        return boiler(kind)

    def boiler(kind: str) -> str:
        tag = rng.choice({"menu": ["nav", "div", "ul", "nav"], "side": ["aside", "div", "aside", "section"], "foot": ["footer", "div", "footer"], "head": ["header", "div", "header"], "form": ["form", "div"], "talk": ["section", "div", "div"]}.get(kind, ["div", "div", "section", "aside"]))
        semantic = tag in ("nav", "aside", "footer", "header", "form")
        name = "" if semantic and rng.random() < 0.5 else some(kind)
        if kind in ("menu", "share"):
            items = [anchor() for _ in range(rng.randint(2, 8))]
            inner = "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)
            if tag == "ul":
                inner = "".join(f"<li>{a}</li>" for a in items)
        elif kind == "talk":
            inner = (f"<h3>{words(2, False)}</h3>" if rng.random() < 0.6 else "") + "".join(wrap("div", rng.choice(["comment", "reply", "c-item", "comment-body"]), f"<p>{words(rng.choice([3, 8, 20, 50]), False)}</p>") for _ in range(rng.randint(1, 5)))
        elif kind == "foot":
            inner = rng.choice(["&copy; ", "Copyright ", ""]) + words(rng.randint(2, 14), False) + (f"<p>{anchor()} {anchor()}</p>" if rng.random() < 0.4 else "")
        elif kind == "form":
            inner = f"<label>{words(2, False)}</label><input type=text><button>{words(1, False)}</button>" + (f"<p>{words(8, False)}</p>" if rng.random() < 0.5 else "")
        elif kind == "head":
            inner = rng.choice([f"<h1>{words(2, False)}</h1>", f"<div>{words(3, False)}</div>", anchor()]) + (f"<p>{words(5, False)}</p>" if rng.random() < 0.4 else "")
        else:
            inner = "".join(rng.choice([f"<p>{words(rng.choice([2, 6, 14, 30]), False)}</p>", words(rng.choice([3, 10, 25]), False), f"<h3>{words(3, False)}</h3>", "<ul>" + "".join(f"<li>{anchor()}</li>" for _ in range(3)) + "</ul>"]) for _ in range(rng.randint(1, 3)))
        return wrap(tag, name, inner)

    pages = []
    for _ in range(n):
        title = f"<h1>{words(rng.randint(2, 12), True)}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.12:
            title = f"<header>{title}</header>"
        body = title + article_body()
        shape = rng.random()
        if shape < 0.45:
            body = f"<article>{body}</article>" if rng.random() < 0.8 else wrap("article", some("main"), body)
        elif shape < 0.6:
            body = f"<main>{body}</main>" if rng.random() < 0.6 else f"<main><article>{body}</article></main>"
        elif shape < 0.9:
            body = wrap(rng.choice(["div", "section", "div", "td"]), some("main"), body)
        top = "".join(boiler(k) for k in ("head", "menu", "note", "ad", "form") if rng.random() < 0.45)
        end = "".join(boiler(k) for k in ("share", "side", "ad", "talk", "note", "menu", "foot") if rng.random() < 0.45)
        if rng.random() < 0.3:
            body = wrap("div", rng.choice(["container", "wrapper", "layout", "page"]), boiler("side") + body if rng.random() < 0.5 else body + boiler("side"))
        page = f"<html><head><title>{words(3, False)}</title></head><body>{top}{body}{end}</body></html>"
        found = blocks_of(page)
        pages.append(([(b[0].replace(sign, ""), *b[1:]) for b in found], [int(sign in b[0]) for b in found]))
    return [p for p in pages if p[0]]


class Extractor:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        if not blocks:
            return ""
        feats = features(blocks)
        scores = np.array([self.weights[f].sum(axis=0) for f in feats])
        return "\n\n".join(b[0] for b, y in zip(blocks, viterbi(scores, self.trans, self.start)) if y)


def fit(pages: list[tuple[list[Block], list[int]]] | None = None, epochs: int = 12) -> Extractor:
    seqs = []
    for blocks, labels in pages or training_pages():
        feats = features(blocks)
        seqs.append((np.concatenate(feats).astype(int), np.cumsum([0, *map(len, feats)]), np.array(labels)))
    return Extractor(*fit_sparse(seqs, len(_AT), 2, epochs=epochs, batch=16, rate=0.3, decay=1e-4))


def extract(pages: DataFrame, model: Extractor) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    known = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [known.value.text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), fit())
