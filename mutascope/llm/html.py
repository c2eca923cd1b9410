"""Main text of raw web pages by two-pass block rules.

The markup is read once, tag by tag, into blocks (paragraphs, headings, list items, cells) with their
length, link characters and place in the page. Pass 1 decides by stop-word density, length and link density; on a page whose language no list covers,
length and sentence marks stand in for the density. Blocks in menus, footers, sidebars, adverts, notices, forms
and reader comments are decided against. On a page with an ``article`` or ``main`` element the other blocks
are decided against, and inside it a block that only its words speak against is ambiguous. Pass 2 gives each ambiguous block the label of its nearest
decided neighbours. Unclosed tags, truncated pages and broken references are tolerated.

Defined cases: null and empty pages give empty text; pages of any length are read whole; rows are
independent, so repeated rows give repeated results and an empty table an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from mutascope.llm import text as X

LENGTH_LOW, STOP_HIGH, STOP_LOW, LINK_HIGH = 70, 0.25, 0.10, 0.5

# Frequent function words of the four languages.
STOP = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that the their
there they this to was we were which who will with you
au aux avec ce ces cette dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qu que qui sa
se ses son sont sur un une vous
als am auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im
ist kann mit nach nicht noch nur oder sich sie sind so über um und unter vom von vor war wie wird zu zum zur
al como con del el ella ellos era es esta este la las lo los más muy no nos para pero por se ser si sin sobre su sus
también tiene todo una uno y ya
""".split())

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select
summary table tbody td textarea tfoot th thead title tr ul button""".split())
CONTAINER = frozenset("""article aside blockquote button details dialog div dl fieldset figure footer form head header main
menu nav ol section select table textarea title ul""".split())
OUTSIDE = frozenset("nav footer aside form head title menu button select textarea dialog fieldset".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
HINTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent
cookie cookies disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager
pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social
sponsor sponsored subscribe teaser toolbar topbar widget""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|audio|video|math)\b(?>[^>]*)(?:(?<=/)>|>.*?(?:</\1\b[^>]*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z]+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964][\"')\]\u201d\u00bb\u300d]*\Z")
_NOTICE = re.compile(r"(?:\u00a9|\(c\)|copyright\b|all rights reserved)", re.I)


def _hinted(attributes: str) -> bool:
    """Class, id or role names of things that are not the article, or a hidden element."""
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif not HINTS.isdisjoint(_SPLIT.split(value)):
            return True
    return False


class Block:
    __slots__ = ("text", "links", "zone", "heading", "label")

    def __init__(self, text: str, links: int, zone: str, heading: bool):
        self.text, self.links, self.zone, self.heading, self.label = text, links, zone, heading, ""


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order; zone is ``main`` (inside article or main), ``out`` or ``other``."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # open containers and their zones
    pieces: list[str] = []
    state = {"links": 0, "anchor": False, "bad": False, "heading": False}

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                zone = stack[-1][1] if stack else "other"
                found.append(Block(text, state["links"], "out" if state["bad"] else zone, state["heading"]))
        state["links"] = 0

    def words(text: str) -> None:
        pieces.append(text)
        if state["anchor"]:
            state["links"] += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words(page[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] is not None and m[1].lower() in ("iframe", "object", "video", "audio"):
                pieces.append(" ")
            continue
        name, closing = name.lower(), bool(m[2])
        if name == "a":
            state["anchor"] = not closing
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCK:
            continue
        flush()
        state["anchor"] = False
        state["bad"], state["heading"] = False, name[0] == "h" and name[1:].isdigit() and not closing
        if name == "body":
            stack.clear()
        elif closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            parent = stack[-1][1] if stack else "other"
            bad = _hinted(m[4]) if m[4] else False
            if name in CONTAINER and not m[4].endswith("/"):
                if parent == "out" or bad or name in OUTSIDE or name == "header" and parent != "main":
                    zone = "out"
                else:
                    zone = "main" if name in ("article", "main") else parent
                stack.append((name, zone))
            else:
                state["bad"] = bad
    if at < len(page):
        words(page[at:])
    flush()
    return found


def stop_density(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP for w in found) / len(found) if found else 0.0


def _decide(b: Block, density: float, known: bool, has_main: bool) -> str:
    """Pass 1: ``good``, ``bad``, or empty for ambiguous."""
    size = len(b.text)
    if b.zone == "out" or has_main and b.zone != "main" or b.links > LINK_HIGH * size:
        return "bad"
    if size < LENGTH_LOW:
        label = "bad" if _NOTICE.match(b.text) else ""
    elif not known:  # no list fits the page's language: length and sentence marks stand in
        label = "good" if _SENTENCE.search(b.text) else ""
    else:
        label = "good" if density >= STOP_HIGH else "" if density >= STOP_LOW or _SENTENCE.search(b.text) else "bad"
    return "" if b.zone == "main" and label == "bad" else label


def classify(found: list[Block]) -> list[Block]:
    """Label every block: decided ones by their own figures, ambiguous ones by their neighbours.

    Votes come from blocks decided by their text (inside the article element, if there is one, from blocks
    in it only), and from the page's ends, which count as bad and lie one block further off. A heading goes with what follows it.
    """
    has_main = any(b.zone == "main" for b in found)
    density = [stop_density(b.text) if b.zone != "out" and len(b.text) >= LENGTH_LOW and b.links <= LINK_HIGH * len(b.text) else 0.0
               for b in found]
    long = [(len(b.text), d) for b, d in zip(found, density)
            if b.zone != "out" and len(b.text) >= LENGTH_LOW and b.links <= LINK_HIGH * len(b.text)]
    known = sum(n * d for n, d in long) >= STOP_LOW * sum(n for n, _ in long)
    for b, d in zip(found, density):
        b.label = _decide(b, d, known, has_main)
    _inherit([b for b in found if b.zone == "main"], False, False)
    _inherit([b for b in found if b.zone == "other"], found[:1] and found[0].zone == "other", found[-1:] and found[-1].zone == "other")
    return found


def _inherit(part: list[Block], starts: bool, stops: bool) -> None:
    """Pass 2 over the blocks of one zone; ``starts`` and ``stops`` say that no menu or footer element stands before or after it."""
    decided = [(i, b.label) for i, b in enumerate(part) if b.label]
    if decided or part and part[0].zone == "main":
        decided = [(-2, "bad")] * bool(starts) + decided + [(len(part) + 1, "bad")] * bool(stops)
    else:  # nothing but short blocks: sentences speak for themselves
        decided = [(i, "good" if _SENTENCE.search(b.text) else "bad") for i, b in enumerate(part) if not b.heading]
        for i, label in decided:
            part[i].label = label
    at = 0
    for i, b in enumerate(part):
        while at < len(decided) and decided[at][0] < i:
            at += 1
        if b.label:
            continue
        left = decided[at - 1] if at else None
        right = decided[at] if at < len(decided) else None
        if left is None or right is None:
            b.label = (left or right or (0, "good" if b.zone == "main" else "bad"))[1]
        elif left[1] == right[1] or b.heading:
            b.label = right[1]
        else:
            near = (i - left[0]) - (right[0] - i)
            tie = "good" if b.zone == "main" or _SENTENCE.search(b.text) else "bad"
            b.label = left[1] if near < 0 else right[1] if near > 0 else tie


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    def work(part: pa.RecordBatch) -> list:
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return X.map_rows(pages, ["page_id", "url"], "text string, n_chars long", lambda: work, column="html")
