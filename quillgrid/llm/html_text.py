"""Main text of web pages, with each site's template removed.

A first pass hashes the subtree of every block-level element of a page, menus and footers included, together with the
page's host. Spark counts the hashes; a subtree found on at least ``min_pages`` pages of a host, however many the host
has, is template. Pages with one and the same main text (mirrors of an article) count once. Inside an article only
containers can be template, never a heading or a paragraph: a sentence that many articles share is text. A second pass
deletes the template subtrees from each page.

What does not recur (reader comments, related links, a host of few pages) is left to a fallback: elements go whose tag,
class, id or role says menu, header, footer, sidebar, notice, advert, form or comments. A name says so where its first
word is one of ``FURNITURE`` and the others are such words too or ``NEUTRAL``: ``share-buttons`` does, ``share-price``
doesn't. Of what is left, the main text is the article's, else the main element's, else the body's.

The template's hashes are broadcast while there are at most ``BROADCAST_KEYS``, else each page gets its own by joins.

Text: character references decoded, white space in a block to one space, blocks joined by one space in page order.

Defined cases: null or empty html has an empty text; unclosed and stray tags are repaired as browsers do for
paragraphs, list items and cells; a null url belongs to the empty host; repeated rows give repeated results; rows with one
page_id, or none, are pages of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, small_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|object|math)\b(?>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>(?>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*))>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BREAKS = set("br wbr img".split())
DROPPED = set("nav footer aside form head title button dialog menu".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption header".split())
CLOSES = {  # an opening tag ends an open element of these kinds, up to the nearest container
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    **dict.fromkeys("article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split(), {"p"}),
}
WHOLE = set("html body article main head".split())  # never template themselves
CONTAINERS = set("article aside body div dl footer form header html main nav ol section table ul blockquote".split())
# Words in class, id or role that name furniture, and ones that say nothing beside them.
FURNITURE = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
    "notices pagination paywall popup promo recommended related replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
NEUTRAL = set(
    "alert area articles bar block body bottom box button buttons col column container content desktop entry fixed footer form "
    "header icons id inner item items left links list main menu message mobile outer overlay page panel post posts primary "
    "reader right row secondary section site slot small sticky stories text thread tools top unit user view visitor wrap "
    "wrapper".split()
)
OUTSIDE = set("header masthead footer banner search topbar".split())  # furniture only outside of the article
FALSE_MAIN = {"comment", "comments", "ad", "advert", "related"}
BROADCAST_KEYS = 2_000_000
NUMBER = re.compile(r"\d+$")


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _named(attributes: str) -> list[list[str]]:
    """The names in class, id and role, each as its words: ``ad-slot2`` is ad, slot."""
    names = [n for v in NAMED.findall(attributes) for n in v.strip("\"'").split()]
    split = [[NUMBER.sub("", w) for w in PARTS.split(CAMEL.sub("-", n).lower())] for n in names]
    return [[w for w in words if w] for words in split]


def _furniture(names: list[list[str]], words: set[str]) -> bool:
    return any(n and any(w in words for w in n) and all(w in words or w in FURNITURE or w in NEUTRAL for w in n) for n in names)


class _Element:
    __slots__ = ("tag", "listed", "region", "parts", "first")

    def __init__(self, tag: str, listed: bool, region: int, first: int):
        self.tag, self.listed, self.region, self.first = tag, listed, region, first
        self.parts: list[str] = [tag]


Block = tuple[str, int, bool]  # text, region, inside of listed furniture
Span = tuple[int, int, int]  # hash of a removable subtree, its first block, its end block


def parse(page: str) -> tuple[list[Block], list[Span]]:
    """Blocks of text in page order, and the subtrees over them that can be template."""
    stack = [_Element("", False, 0, 0)]
    blocks: list[Block] = []
    spans: list[Span] = []
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = stack[-1]
                top.parts.append(text)
                blocks.append((text, top.region, top.listed))

    def close(n: int) -> None:
        flush()
        while len(stack) > n:
            e = stack.pop()
            h = _digest("\x1f".join(e.parts))
            stack[-1].parts.append(str(h))
            if e.first < len(blocks) and e.tag not in WHOLE and not (e.region == 2 and e.tag in PROSE):
                spans.append((h, e.first, len(blocks)))

    def text(piece: str) -> None:
        held.append(entities.unescape(piece) if "&" in piece else piece)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in BREAKS:
                held.append(" ")
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                flush()
            continue
        flush()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in CLOSES.get(tag, ()):
                close(i)
            elif stack[i].tag in CONTAINERS:
                break
        top = stack[-1]
        region, listed = top.region, top.listed
        if not listed:
            names = _named(m["more"]) if m["more"] else []
            words = {w for n in names for w in n}
            if tag in ("article", "main"):
                listed = bool(words & FALSE_MAIN)
            elif tag not in ("html", "body"):
                listed = tag in DROPPED or _furniture(names, FURNITURE) or region < 2 and (tag == "header" or _furniture(names, OUTSIDE))
            if not listed:
                if tag == "article" or ["articlebody"] in names or ["article", "body"] in names:
                    region = 2
                elif region < 2 and (tag == "main" or ["main"] in names):
                    region = 1
        stack.append(_Element(tag, listed, region, len(blocks)))
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!]", rest)  # a tag that the page's end cuts off
        text(rest[: cut.start()] if cut else rest)
    close(1)
    flush()
    return blocks, spans


def _main(blocks: list[Block], gone: list[tuple[int, int]]) -> str:
    """The main text without the blocks of the ranges gone, which come in any order and may nest."""
    edge = [0] * (len(blocks) + 1)
    for first, end in gone:
        edge[first] += 1
        edge[end] -= 1
    depth, kept = 0, []
    for (text, region, listed), step in zip(blocks, edge, strict=False):
        depth += step
        if not depth and not listed:
            kept.append((text, region))
    best = max((r for _, r in kept), default=0)
    return " ".join(t for t, r in kept if r == best)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _of_host(host: int, subtree: int) -> int:
    """One key for a host and a subtree."""
    x = (host * 0x9E3779B97F4A7C15 ^ subtree) & (2**64 - 1)
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    return (x ^ x >> 29) - 2**63


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, key, main) for each distinct removable subtree of a page."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            ids, keys, mains = [], [], []
            for page_id, url, page in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                blocks, spans = parse(page or "")
                host, main = _digest(host_of(url)), _digest(_main(blocks, []))
                mine = {_of_host(host, h) for h, *_ in spans}
                ids += [page_id] * len(mine)
                keys += mine
                mains += [main] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(mains, pa.int64())], ["page_id", "key", "main"])


def _removal(template):
    """Texts of pages, with the number of template subtrees deleted. template: broadcast keys, else each page has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = set(np.frombuffer(template.value, np.int64).tolist()) if template is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                own = rows.column("keys").to_pylist() if shared is None else None
                out, count = [], []
                for i, (url, page) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("url", "html")), strict=True)):
                    blocks, spans = parse(page or "")
                    host, keys = _digest(host_of(url)), shared if own is None else set(own[i] or ())
                    gone = [(a, b) for h, a, b in spans if _of_host(host, h) in keys]
                    out.append(_main(blocks, gone))
                    count.append(len(gone))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id").cast(pa.int64()), rows.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array(count, pa.int32())],
                    ["page_id", "url", "text", "n_chars", "n_template"],
                )

    return run


def extract(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """page_id, url, text, n_chars, n_template (subtrees removed as template) for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    of_page = pages.mapInArrow(_keys, "page_id long, key long, main long")
    template = of_page.groupBy("key").agg(F.count_distinct("main").alias("on")).where(F.col("on") >= min_pages)
    template = scratch.keep(template.select("key"))
    result = "page_id long, url string, text string, n_chars long, n_template int"
    if template.count() <= BROADCAST_KEYS:
        keys = template.toArrow().column("key").to_numpy()
        return pages.mapInArrow(_removal(spark.sparkContext.broadcast(keys.tobytes())), result)
    own = of_page.join(template, "key").groupBy(F.col("page_id").alias("page")).agg(F.collect_set("key").alias("keys"))
    some = pages.join(own, F.col("page_id").eqNullSafe(F.col("page")), "left").select("page_id", "url", "html", "keys")
    return some.mapInArrow(_removal(None), result)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extract": op8_html_extract}
ORACLE_SQL: dict[str, str] = {}
