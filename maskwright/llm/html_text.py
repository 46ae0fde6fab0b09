"""HTML extraction: the main text of pages, by site template removal.

A page is read into blocks of text and the elements around them; only what is not
shown (scripts, hidden elements, ...) goes at once. Each block element's subtree is
hashed, in menus and articles too; hashes are counted per host over pages of
different content, and a subtree that recurs on many pages of its host is template
and is deleted first. Inside an article containers and elements that say what they
are (menus, adverts, comments ...) are hashed, never a paragraph of its own: texts
repeat phrases, too.

Tags and class words are a complement for what is left: elements that say they are
not the text go, unless they hold the article, that is most of the text left and
either its article or first heading, or no article stands elsewhere. Of the rest,
the blocks of articles alone are taken if they are most of the text.

Pages are parsed once and stored, their blocks packed; the count moves hashes only,
aggregated before the shuffle. A counted number of templates is sent to the pages;
beyond SENT of them, pages and templates are joined.

Defined cases: a null html is empty; a null url or one without a host has no
site, and nothing recurs for it; repeated rows are separate pages, but pages of
equal content count once; unclosed and stray tags are read as browsers do for
paragraphs, list items and table cells; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.sinks import as_table

# a subtree is template on so many pages of different content of a host, however large the host
PAGES = 5
# templates that are sent to all tasks at most, eight bytes each; copies of a host's templates beyond
SENT, SALT = 1 << 18, 16

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>", re.S
)
# name by name, so that a value is never taken for a name
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
READ = {"class", "id", "role", "style", "hidden", "aria-hidden"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
# never shown as text
DROPPED = {"head", "noscript", "template", "svg", "canvas", "object", "button", "select", "audio", "video", "math", *RAW}
BESIDES = {"nav", "footer", "aside", "form", "dialog", "menu"}
MAIN = {"article", "main"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "header", "center", "fieldset", "details"}
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
SAYS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "sidebar", "menu", "navbar", "nav", "navigation", "breadcrumb",
    "breadcrumbs", "comment", "comments", "disqus", "replies", "share", "sharing", "social", "related", "newsletter", "subscribe", "signup",
    "pagination", "pager", "widget", "toolbar", "skip", "search",
}
SAYS_OUTSIDE = {"header", "footer", "masthead", "topbar", "bottom", "copyright"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
# an open tag that ends an open element of these kinds
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Element:
    __slots__ = ("inside", "number", "out", "parts", "said", "tag")

    def __init__(self, tag: str, out: bool, inside: bool, number: int, said: bool = False):
        self.tag, self.out, self.inside, self.number, self.said, self.parts = tag, out, inside, number, said, []


class Block(NamedTuple):
    """A text; the subtree hashes around it; the numbers of elements around it that say they are not the text; whether it is in an article, and leads one."""

    text: str
    around: list[int]
    said: list[int]
    inside: bool
    leads: bool


def named(attributes: str) -> list[tuple[str, str]]:
    """The attributes that are read, in order, with their values."""
    found = ((name.lower(), value) for name, value in ATTRIBUTE.findall(attributes or ""))
    return [(name, entities.unescape(value.strip("\"'"))) for name, value in found if name in READ]


def unseen(tag: str, attributes: str) -> bool:
    """Whether an element is not shown as text."""
    if tag in DROPPED:
        return True
    for name, value in named(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return tag not in ("html", "body", *MAIN)
        if name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return tag not in ("html", "body", *MAIN)
    return False


def says_no(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's tag or attributes say that it is not the page's text.

    Outside articles any word of a class or id counts. Inside one only containers are
    asked, and only for a class or id that is such a word as a whole.
    """
    if tag in BESIDES or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", *MAIN) or (inside and tag not in CONTAINERS):
        return False
    for name, value in named(attributes):
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            said = {w.lower() for w in (value.split() if inside else WORDS.findall(value))}
            if said & SAYS or (not inside and said & SAYS_OUTSIDE):
                return True
    return False


def digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def read(html: str) -> list[Block]:
    """All shown blocks in page order."""
    stack: list[Element] = [Element("", False, False, -1)]
    blocks: list[tuple[str, list[int], list[int], bool, bool]] = []
    hashes: dict[int, int] = {}
    pending: list[str] = []
    numbers = 0

    def flush() -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                around, said = [e.number for e in stack if e.number >= 0], [e.number for e in stack if e.said]
                blocks.append((text, around, said, stack[-1].inside, stack[-1].inside or any(e.tag == "h1" for e in stack)))
                for e in reversed(stack):
                    if e.number >= 0:
                        e.parts.append(text.encode("utf-8", "surrogatepass"))
                        break

    def close() -> None:
        e = stack[-1]
        if e.tag not in INLINE:
            flush()
        stack.pop()
        if e.number >= 0:
            hashes[e.number] = value = digest(e.tag.encode(), *e.parts)
            for outer in reversed(stack):
                if outer.number >= 0:
                    outer.parts.append(value.to_bytes(8, "little", signed=True))
                    break

    def close_to(tags: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in scope:
                return

    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if not stack[-1].out:
            pending.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending = m[1] if m[2] else m[4]
        if ending:
            if any(e.tag == tag for e in stack):
                close_to({tag}, set())
            elif tag not in INLINE and not stack[-1].out:
                flush()
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in VOID:
            if tag in INLINE:
                pending.append(" ") if not stack[-1].out else None
            elif not stack[-1].out:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            if not stack[-1].out:
                flush()
            close_to({"p"}, {"article", "main", "section", "div", "td", "th", "li", "blockquote", "body", "button"}) if tag != "p" else close_to({"p"}, {"table", "button"})
            if tag in ENDS:
                close_to(ENDS[tag], SCOPE[tag])
        top = stack[-1]
        inside = top.inside or tag in MAIN
        said = says_no(tag, attributes, top.inside)
        out = top.out or unseen(tag, attributes) or (said and tag in INLINE)
        hashed = not out and tag not in INLINE and tag not in ("html", "body") and (said or tag in CONTAINERS or tag in MAIN or not inside)
        if hashed:
            numbers += 1
        stack.append(Element(tag, out, inside, numbers if hashed else -1, said and hashed))
    while len(stack) > 1:
        close()
    flush()
    return [Block(text, [hashes[n] for n in around], *rest) for text, around, *rest in blocks]


def kept(blocks: list[Block], gone: set[int] | frozenset[int] = frozenset()) -> list[Block]:
    """The page's text: blocks without ``gone`` subtrees, and of those what tags and class words leave."""
    left = [b for b in blocks if gone.isdisjoint(b.around)] if gone else blocks
    size, held, leads = sum(len(b.text) for b in left), Counter(), set()
    for b in left:
        for e in b.said:
            held[e] += len(b.text)
            if b.leads:
                leads.add(e)
    elsewhere = any(b.inside and not b.said for b in left)
    article = {e for e, n in held.items() if 2 * n > size and (e in leads or not elsewhere)}
    left = [b for b in left if article.issuperset(b.said)]
    inner = [b for b in left if b.inside]
    return inner if 2 * sum(len(b.text) for b in inner) > sum(len(b.text) for b in left) else left


def parse(html: str) -> list[tuple[str, list[int]]]:
    """A page's text without its host's templates, as blocks with the subtree hashes around them."""
    return [(b.text, b.around) for b in kept(read(html))]


PARSED = "rid long, page_id long, url string, host string, content long, hashes array<long>, blocks binary"


def packed(blocks: list[Block]) -> bytes:
    return zlib.compress(pickle.dumps([tuple(b) for b in blocks], 5), 1)


def unpacked(data: bytes) -> list[Block]:
    return [Block(*b) for b in pickle.loads(zlib.decompress(data))]


def parsed(pages: DataFrame) -> DataFrame:
    """Pages as PARSED: ``hashes`` are the different ones of the page's subtrees, ``blocks`` its blocks, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, hashes, blocks = [], [], []
            for page in b.column("html"):
                found = read(page.as_py() or "")
                blocks.append(packed(found))
                content.append(digest(*(f.text.encode("utf-8", "surrogatepass") for f in kept(found))))
                hashes.append(sorted({h for f in found for h in f.around}))
            own = [b.column(c) for c in ("rid", "page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(blocks, pa.binary())],
                ["rid", "page_id", "url", "host", "content", "hashes", "blocks"],
            )

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long"), "url", host.alias("host"), "html")
    return rows.mapInArrow(run, PARSED)


def template_hashes(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """``(host, hash)`` of the subtrees that recur on many pages of their host."""
    each = pages.filter("host <> ''").select("host", "content", F.explode("hashes").alias("hash"))
    return each.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("host", "hash")


def _rest(blocks: bytes, gone: frozenset[int]) -> str:
    return "\n".join(b.text for b in kept(unpacked(blocks), gone))


def _by_set(stored: DataFrame, templates: DataFrame) -> DataFrame:
    """Texts without templates, which are few enough (``SENT``) to be sent to all tasks as one sorted array: no page moves."""
    site = F.xxhash64("host")
    marks = np.sort(templates.select(F.col("hash").bitwiseXOR(site).alias("m")).toArrow().column("m").to_numpy())
    shared = stored.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.append(shared.value, 0)
        for b in batches:
            found = []
            for blocks, hashes, of in zip(b.column("blocks"), b.column("hashes"), b.column("site"), strict=True):
                gone = frozenset()
                if of.is_valid and len(hashes):
                    own = hashes.values.to_numpy()
                    mine = own ^ of.as_py()
                    gone = frozenset(own[marks[np.searchsorted(marks[:-1], mine)] == mine].tolist()) if len(marks) > 1 else gone
                found.append(_rest(blocks.as_py(), gone))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    of = F.when(F.col("host") != "", site)
    return stored.select("page_id", "url", "hashes", of.alias("site"), "blocks").mapInArrow(run, "page_id long, url string, text string")


def _by_join(stored: DataFrame, templates: DataFrame) -> DataFrame:
    """The same for any number of templates; a host's pages are spread over ``SALT`` copies of its templates."""
    each = stored.filter("host <> ''").select("rid", "host", F.explode("hashes").alias("hash"), F.pmod("rid", F.lit(SALT)).alias("salt"))
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    gone = each.join(spread, ["host", "hash", "salt"]).groupBy("rid").agg(F.collect_set("hash").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_rest(blocks.as_py(), frozenset(hashes.as_py() or ())) for blocks, hashes in zip(b.column("blocks"), b.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return stored.join(gone, "rid", "left").select("page_id", "url", "blocks", "gone").mapInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """``(page_id, url, text)`` of ``pages`` (page_id, url, html)."""
    stored = as_table(parsed(pages), "pages")
    templates = as_table(template_hashes(stored, least), "templates")
    return _by_set(stored, templates) if templates.count() <= SENT else _by_join(stored, templates)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
