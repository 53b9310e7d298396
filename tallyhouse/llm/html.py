"""Main text of web pages by two passes of rules over their blocks.

First pass: each block is judged by itself. Blocks in menus, headers, footers, asides, forms, adverts, notices and
comments are boilerplate, as are blocks outside articles that are mostly links; long blocks are content or boilerplate
by the share of stop words, or, where no block of the page has any to speak of, content. Others stay open. Second pass:
an open block takes the label of the nearest decided block of its section (the article, or what lies outside it), a
heading that of the next one; where content and boilerplate are equally near, headings and paragraphs are content.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you
    aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von war wie wir zu zum zur
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con de del el ella en entre era es esta este fue ha la las lo los más mi no para pero por que se sin su sus un una y ya""".split()
)
#: Parts of class, id and role values that mark boilerplate, and those that do outside an article only.
MARK = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|disqus|respond|reply|replies|cookies?|consent|gdpr|footer|header|masthead|menu|nav|navbar|navigation|newsletter|popup|modal|"
    r"promo\w*|related|recommend\w*|sharing|social|sidebar|skip|sponsor\w*|subscribe|subscription|toolbar|widget"
)
OUTSIDE = frozenset("notice alert share side tags discussion discussions".split())
#: Parts that say how or where something is shown, not what it is.
LAYOUT = frozenset(
    """area articles bar block body bottom box btn button buttons center col column container content feed form group holder icon icons inner item items left link links list main media message
    outer page panel posts reader readers right row section signup site slot stories thread top unit user users wrap wrapper""".split()
)
#: Parts beside which a header is that of a text.
OF_TEXT = frozenset("article blog content entry page post story".split())
#: A mark and a part of layout in one word, as in cookiebar; plain marks only, that no common word begins with.
FUSED = re.compile(rf"(?:ads?|advert|banner|comments?|cookies?|footer|nav|newsletter|popup|promo|related|share|social|sponsor)(?:{'|'.join(sorted(LAYOUT))})")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W_A-Za-z0-9]+")
BOILERPLATE = frozenset("nav footer aside form header button select menu dialog figcaption noscript template iframe object svg canvas head".split())
CONTAINERS = BOILERPLATE | frozenset("article main section div ul ol li dl dt dd table tbody thead tfoot tr td th blockquote fieldset details body html figure center".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address caption summary option legend title".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that a start tag of the same set closes, up to the elements that hold them.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",))}
VOID = frozenset("img input br wbr hr meta link source area embed col track".split())
#: A quote opens a value only after "="; a tag or declaration that never ends takes the rest, so no place is looked at twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"\w+")
LEGAL = re.compile(r"©|\(c\)\s*(?:[0-9]{4}|copyright)|copyright\s*(?:©|\(c\)|[0-9]{4})|all rights reserved", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words, or characters where words aren't set apart, of a block that can be judged by its stop words; shares of stop
#: words; share of characters in links.
LONG, LONG_CHARS, LOW, HIGH, LINKED = 12, 80, 0.05, 0.12, 0.5


def marks_boilerplate(name: str, inside: bool) -> bool:
    """Whether one name of a class, id or role marks boilerplate: outside articles by any part of it, inside only where
    all of its parts are marks or layout, so that a section on social history stays."""
    parts = [p.lower() for p in PARTS.findall(name)]
    marks = [p for p in parts if MARK.fullmatch(p) or FUSED.fullmatch(p)]
    if inside:
        return any(p not in ("header", "masthead") for p in marks) and all(p in marks or p in LAYOUT or p in OUTSIDE or p.isdigit() for p in parts)
    if marks and all(p == "header" for p in marks) and any(p in OF_TEXT - {"page"} for p in parts):
        return False
    return bool(marks) or any(p in OUTSIDE for p in parts)


class Block:
    __slots__ = ("parts", "linked", "bad", "region", "tag", "text", "label")

    def __init__(self, bad: bool, region: int, tag: str = ""):
        self.parts: list[str] = []
        self.linked = 0
        self.bad, self.region, self.tag = bad, region, tag
        self.text, self.label = "", 0


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in page order, each with its section and whether a boilerplate element holds it."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    open_now: Counter[str] = Counter()  # names on the stack
    bad, region, regions, link, breaks = False, 0, 0, 0, 0
    own, muted, depth = False, "", 0  # the paragraph, and the inline element, that say themselves to be boilerplate
    now = Block(False, 0)

    def cut(tag: str = ""):
        nonlocal now
        if now.parts:
            found.append(now)
        now = Block(bad or own, region, tag)

    def marked(rest: str) -> bool:
        names = [n for h in HINTS.findall(rest) for n in h.strip("\"'").split()] if rest else []
        return any(marks_boilerplate(n, region > 0) for n in names) or bool(rest and HIDDEN.search(rest))

    def close(i: int):
        nonlocal bad, region
        _, bad, region = stack[i]
        open_now.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def say(text: str):
        if text and not muted:
            text = unescape(text)
            now.parts.append(text)
            if link:
                now.linked += len("".join(text.split()))

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            if not piece.isspace():
                breaks = 0
            say(piece)
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name, ends = name.lower(), bool(m.group("end"))
        if name == "br":
            breaks += 1
            if breaks > 1:
                cut()
            else:
                now.parts.append(" ")
            continue
        if name == "a":
            link = 0 if ends else 1
        if name not in BREAKS:
            if muted:
                depth += (-1 if ends else 1) if name == muted and name not in VOID else 0
                muted = muted if depth else ""
            elif not ends and name not in VOID and m.group("rest") and not m.group("rest").endswith("/") and marked(m.group("rest")):
                muted, depth = name, 1
            continue
        breaks, own, muted, depth = 0, False, "", 0
        if name in CONTAINERS:
            if ends:
                for i in range(len(stack) - 1, -1, -1) if open_now[name] > 0 else ():
                    if stack[i][0] == name:
                        close(i)
                        break
            else:
                rest = m.group("rest")
                if not rest.endswith("/"):
                    closes, holders = CLOSES.get(name, ((), ()))
                    for i in range(len(stack) - 1, -1, -1) if any(open_now[c] > 0 for c in closes) else ():
                        if stack[i][0] in holders:
                            break
                        if stack[i][0] in closes:
                            close(i)
                            break
                    stack.append((name, bad, region))
                    open_now[name] += 1
                    if name in ARTICLE and not bad:
                        regions += 1
                        region = regions
                    inside = region > 0
                    if name in BOILERPLATE and not (name == "header" and inside) and not (name in ("figcaption", "noscript") and inside):
                        bad = True
                    elif name not in ("html", "body") and name not in ARTICLE and marked(rest):
                        bad = True
            link = 0
        elif not ends:
            own = marked(m.group("rest"))
        cut("" if ends else name)
    say(html[at:])
    cut()
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def classify(blocks: list[Block]) -> None:
    """label of each block: 1 content, -1 boilerplate."""
    words = [[w.lower() for w in WORD.findall(b.text)] for b in blocks]
    stops = [sum(w in STOP_WORDS for w in ws) / len(ws) if ws else 0.0 for ws in words]
    long = [len(ws) >= LONG or len(b.text) >= LONG_CHARS for b, ws in zip(blocks, words)]
    linked = [b.linked > LINKED * len(b.text.replace(" ", "")) for b in blocks]
    known = any(long[i] and stops[i] >= HIGH and not b.bad and not linked[i] for i, b in enumerate(blocks))  # the language is one of the lists'
    for i, b in enumerate(blocks):
        if b.bad or not long[i] and LEGAL.match(b.text) or linked[i] and not b.region:
            b.label = -1
        elif linked[i]:
            b.label = 0  # sources, perhaps
        elif long[i] and (stops[i] >= HIGH or not known):
            b.label = 1
        elif long[i] and stops[i] < LOW and not b.region:
            b.label = -1
    has_article = any(b.region and b.label >= 0 for b in blocks)
    before, after = _decided(blocks, range(len(blocks))), _decided(blocks, range(len(blocks) - 1, -1, -1))
    labels = []
    for i, b in enumerate(blocks):
        label = b.label
        if not label:
            near = [x for x in (before[i], after[i]) if x is not None]
            if b.tag in HEADINGS and after[i] is not None:
                label = after[i][1]
            elif near:
                least = min(abs(j - i) for j, _ in near)
                nearest = {x for j, x in near if abs(j - i) == least}
                label = nearest.pop() if len(nearest) == 1 else 1 if b.region or b.tag == "p" or b.tag in HEADINGS or stops[i] >= HIGH else -1
            else:
                label = 1 if b.region or not has_article and stops[i] >= HIGH else -1
        labels.append(label)
    for b, label in zip(blocks, labels):
        b.label = label


def _decided(blocks: list[Block], order: range) -> list[tuple[int, int] | None]:
    """For each block the last one before it, in this order, of its section that is decided by itself: place and label."""
    last: dict[int, tuple[int, int]] = {}
    found: list[tuple[int, int] | None] = [None] * len(blocks)
    for i in order:
        b = blocks[i]
        found[i] = last.get(b.region)
        if b.label and not b.bad:
            last[b.region] = (i, b.label)
    return found


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label > 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html.

    A null or empty html, and a page without content, give an empty text. Null ids and urls stay as they are; repeated
    rows are treated one by one.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
