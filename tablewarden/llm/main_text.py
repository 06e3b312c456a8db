"""Main text of web pages: blocks classified by two passes of rules over density, links, length and place."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, ship

# Common function words of some languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et en un une du que qui dans il pour pas au sur ne se ce plus par je avec tout mais "
    "el los las y que por con no su para una lo como más pero sus al del se "
    "il di che non per sono della con una gli o não uma os em do da".split()
)
# Element names and name parts of classes and ids.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav footer aside form menu select button dialog head iframe object noscript template".split())
KEPT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion promoted sidebar "
    "widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager copyright legal disclaimer toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

SHORT_CHARS, LONG_CHARS = 70, 200
LOW_STOPS, HIGH_STOPS = 0.10, 0.20
FEW_STOPS = 0.03
MOST_LINKS = 0.4

_RAW = "script|style|textarea|title|noscript|iframe|template|svg|math|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*+)>|</?[a-zA-Z][^>]*>?|([^<]++|<)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    place: str  # "kept", "left out" or ""


def _place_of(tag: str, attributes: str, inside_kept: bool) -> str:
    """What an element says about its content: "kept", "left out", "comments" (whatever is inside) or nothing."""
    place = "kept" if tag in KEPT else "left out" if tag in LEFT_OUT or tag == "header" and not inside_kept else ""
    if not attributes or tag in ("html", "body"):
        return place
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return "left out"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "left out"
        if name in ("class", "id"):
            parts = set(_PART.findall(value))
            if parts & COMMENTS:
                return "comments"
            if tag not in KEPT and parts & HINTS and not (inside_kept and parts & {"header"}):
                return "left out"
    return place


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order. Line breaks are white space, two in a row end a block."""
    out: list[Block] = []
    open_tags: list[tuple[str, str]] = []  # with what each says about its content
    parts: list[str] = []
    links = link_chars = breaks = 0
    heading = False

    def place() -> str:
        if any(p == "comments" for _, p in open_tags):
            return "left out"
        return next((p for _, p in reversed(open_tags) if p), "")

    def flush(where: str) -> None:
        nonlocal parts, link_chars
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, link_chars, heading, where))
        parts, link_chars = [], 0

    where = ""
    for match in _TOKEN.finditer(page):
        raw, closing, tag, attributes, text = match.groups()
        if text is not None:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if links:
                    link_chars += len("".join(text.split()))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush(where)
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag in BLOCKS:
            flush(where)
            breaks = 0
        if tag in HEADINGS:
            heading = not closing
        if tag in VOID:
            continue
        if closing:
            at = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), None)
            if at is not None:
                if tag in LEFT_OUT and tag not in BLOCKS:
                    flush(where)
                del open_tags[at:]
                where = place()
        elif tag in BLOCKS or tag in LEFT_OUT or attributes:
            if tag in ("p", "li", "td", "tr", "dd", "dt", "option") and open_tags and open_tags[-1][0] == tag:
                open_tags.pop()
            said = _place_of(tag, attributes, any(t in KEPT for t, _ in open_tags))
            if said and tag not in BLOCKS:
                flush(where)
            open_tags.append((tag, said))
            where = place()
    flush(where)
    return out


def _link_share(block: Block) -> float:
    return block.link_chars / max(1, len("".join(block.text.split())))


def _stops(text: str) -> tuple[int, int]:
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words), len(words)


def _unlisted(blocks: list[Block]) -> bool:
    """Whether the page's running text has hardly any listed stop word: its language is none of the listed ones."""
    found = [_stops(b.text) for b in blocks if b.place != "left out" and _link_share(b) <= MOST_LINKS]
    return sum(s for s, _ in found) < FEW_STOPS * max(1, sum(n for _, n in found))


def _first_pass(block: Block, unlisted: bool = False) -> bool | None:
    """True for content, False for the rest of the page, None where a block alone does not tell.

    In an unlisted language the stop words tell nothing: long blocks with few links are content. Length is counted
    in bytes there, as some scripts say more with a character.
    """
    if block.place == "left out":
        return False
    dense = _link_share(block)
    if block.place == "kept" and (dense < 1 or len(block.text) >= SHORT_CHARS):
        return True
    if dense > MOST_LINKS and not block.heading:
        return False
    if block.place == "kept":
        return True
    if block.heading or (len(block.text.encode()) if unlisted else len(block.text)) < SHORT_CHARS:
        return None
    if unlisted:
        return True
    stops, words = _stops(block.text)
    share = stops / max(1, words)
    if share >= HIGH_STOPS or len(block.text) >= LONG_CHARS and share >= LOW_STOPS:
        return True
    return False if share < LOW_STOPS else None


def main_blocks(blocks: list[Block]) -> list[str]:
    """The texts of the content blocks. In the second pass an undecided block takes the label of the nearest
    decided one; of two equally near ones a heading takes the following, any other block the one before.
    Without any decided block all count as content; so do all undecided ones of a page in an unlisted language
    that has no block decided as content."""
    unlisted = _unlisted(blocks)
    first = [_first_pass(b, unlisted) for b in blocks]
    if unlisted and True not in first:
        first = [True if label is None else label for label in first]
    before, after, last = [], [], None
    for k, label in enumerate(first):
        last = k if label is not None else last
        before.append(last)
    last = None
    for k in range(len(first) - 1, -1, -1):
        last = k if first[k] is not None else last
        after.append(last)
    after.reverse()
    out = []
    for k, block in enumerate(blocks):
        label = first[k]
        if label is None:
            b, a = before[k], after[k]
            if b is None and a is None:
                label = True
            elif b is None or a is None:
                label = first[a if b is None else b]
            else:
                nearer = a if a - k < k - b or a - k == k - b and block.heading else b
                label = first[nearer]
        if label:
            out.append(block.text)
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(blocks_of(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html); null html gives an empty text."""
    ship(pages.sparkSession)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [main_text(page) for page in frame["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [frame["page_id"], frame["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(frugal(batches), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
