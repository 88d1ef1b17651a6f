"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by itself. Blocks in parts that say what they
are (navigation, page headers and footers, asides, forms, adverts, notices, comments, hidden parts) are boilerplate, and so
are blocks that are mostly links, and short copyright lines. Long blocks of a fair density of stop words are content.
What is of medium length or low density is nearly content, what is short is open. A page that marks an article or main
part has its content there: long blocks outside of it are open too.

Pass two gives what is left the label of its nearest decided neighbour. The nearest is the one that shares the most
enclosing elements with the block, then the one with the fewest blocks between; the page's edges count as boilerplate.
Where both sides are as near and differ, a heading goes with what follows, and only what is nearly content is content. A
marked article in which pass one found no content, and likewise a page, keeps its undecided blocks.

Blocks keep their whole text: character references are decoded, white space becomes one space, and the content blocks
are joined in page order by two line breaks. A block that only repeats its page's heading is kept like any other.

The page is read once from front to back, and each further pass is over blocks, so time grows with the page's length
whatever its markup (unclosed tags, quotes or comments, deep nesting).

Defined results: null or empty html has the empty text; broken markup is read on leniently and never fails (an unclosed
comment, script or style reaches to the end); a page in a language without known stop words goes by length and links
alone. Repeated rows and further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.18
MAX_LINKS = 0.2
#: Link density from which even a block of an article is a list of links.
ARTICLE_LINKS = 0.6

#: Frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out a "
    "de la le et les des en un du une que est pour qui dans par plus au sur ne se pas ce il sont avec mais nous ou son aux cette elle "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei ich sind noch wie einem über "
    "el los del las por con una su para al lo como más pero sus sí porque esta entre cuando muy sin sobre también me hasta hay donde y".split()
)
_SKIPPED = frozenset("script style noscript template textarea select svg iframe object canvas title math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_BAD_TAGS = frozenset("nav aside footer form button menu dialog head fieldset search option".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article (fixed values).
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments discussion disqus respond replies reply share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup popup modal overlay login search pagination pager widget tags copyright skip".split()
)
_NEUTRAL = frozenset("has with without no is not".split())
#: Beside these words, "header" is that of an article.
_OF_ARTICLE = frozenset("article entry post story content".split())
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_EDGES = re.compile(r"^\W+|\W+$")
_WORD_GAP = re.compile(r"[\s_-]+")
_COPYRIGHT = re.compile(r"^(?:©|\(c\)|copyright\b)", re.IGNORECASE)


@dataclass
class Block:
    """``shared`` is how many enclosing elements the block shares with the one before it; ``article`` numbers the marked
    articles from 1 (0: outside of any)."""

    text: str
    linked: int
    heading: bool
    bad: bool
    article: int
    shared: int
    label: str = ""


def _part_of(tag: str, attrs: str, in_article: bool) -> str:
    """What a tag says of its content: "bad", "article" or nothing."""
    if tag in _BAD_TAGS or (tag == "header" and not in_article):
        return "bad"
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), html_lib.unescape(value.strip("\"'")).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return "bad"
            if name == "role" and value in _BAD_ROLES:
                return "bad"
            if name in ("class", "id") and tag not in ("article", "main", "h1"):
                for one in value.split():
                    words = set(_WORD_GAP.split(one))
                    if not words.isdisjoint(_NEUTRAL) or words.isdisjoint(_BAD_NAMES):
                        continue
                    if words & _BAD_NAMES == {"header"} and (in_article or words & _OF_ARTICLE):
                        continue
                    return "bad"
    return "article" if tag in ("article", "main") else ""


class _Open:
    """The open elements. All steps take constant time, but for the elements that a closing tag ends."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.count = {"bad": 0, "article": 0, "": 0}
        self.articles = 0
        self.least = 0  # the smallest depth since the last block

    def push(self, tag: str, kind: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in _BLOCK:
            self.block_places.append(len(self.tags))
        if kind == "article" and not self.count["article"]:
            self.articles += 1
        self.count[kind] += 1
        self.tags.append((tag, kind))

    def pop(self) -> None:
        tag, kind = self.tags.pop()
        self.places[tag].pop()
        if tag in _BLOCK:
            self.block_places.pop()
        self.count[kind] -= 1
        self.least = min(self.least, len(self.tags))

    def close(self, tag: str) -> None:
        """Ends the innermost such element and all in it; an inline one only within its block."""
        at = self.places.get(tag)
        if not at or (tag not in _BLOCK and self.block_places and at[-1] < self.block_places[-1]):
            return
        for _ in range(len(self.tags) - at[-1]):
            self.pop()


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    found: list[Block] = []
    open_ = _Open()
    text: list[str] = []
    linked: list[str] = []
    heading, links = False, 0

    def close() -> None:
        whole = " ".join(html_lib.unescape("".join(text)).split())
        if whole:
            chars = len(" ".join(html_lib.unescape(" ".join(linked)).split()))
            found.append(Block(whole, chars, heading, open_.count["bad"] > 0, open_.articles if open_.count["article"] else 0, open_.least))
            open_.least = len(open_.tags)
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if links:
            linked.append(piece)

    at, low = 0, page.lower()
    if len(low) != len(page):  # a few characters change length in lower case
        low = page
    last_end, quotes, absent = page.rfind(">"), True, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if start > last_end:  # no tag ends from here on, but a comment may begin
            add(page[start:].split("<!--", 1)[0])
            break
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start) if quotes else None
        if not m and (m := _LOOSE.match(page, start)):
            quotes = False  # a quote that never ends, or ends in no tag: quotes mean nothing from here on
        if not m:
            add("<")
            at = start + 1
            continue
        at, tag, closing = m.end(), m[1].lower(), page[start + 1] == "/"
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            add(" ")
        if tag in _SKIPPED:
            if not closing and not m[2].endswith("/") and tag not in absent:
                end = low.find(f"</{tag}", at)
                if end < 0:
                    absent.add(tag)
                    at = len(page) if tag in ("script", "style") else at
                else:
                    end = page.find(">", end)
                    at = len(page) if end < 0 else end + 1
            continue
        if tag in ("html", "body"):
            close()
            open_.close("head")
            continue
        if tag not in _BLOCK:
            if tag not in _VOID:  # an inline tag may say that its text is none of the article's
                if closing:
                    if tag in open_.places:
                        close()
                        open_.close(tag)
                elif _part_of(tag, m[2], True) == "bad" and not m[2].endswith("/"):
                    close()
                    open_.push(tag, "bad")
            continue
        close()
        links = 0
        if closing:
            open_.close(tag)
        else:
            top = open_.tags[-1][0] if open_.tags else ""
            if top == "p" or (top == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                open_.pop()
            if tag not in _VOID:
                open_.push(tag, _part_of(tag, m[2], open_.count["article"] > 0))
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    close()
    return found


def stop_density(text: str) -> float:
    words = [_EDGES.sub("", w) for w in text.lower().split()]
    words = [w for w in words if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _alone(b: Block, known: bool, marked: bool) -> str:
    """Pass one: "good", "bad", "near" or "short"."""
    links = b.linked / len(b.text)
    if b.bad or links > (ARTICLE_LINKS if b.article else MAX_LINKS) or (len(b.text) < LENGTH_HIGH and not b.article and _COPYRIGHT.match(b.text)):
        return "bad"
    if len(b.text) < LENGTH_LOW or (marked and not b.article):
        return "short"
    density = stop_density(b.text) if known else STOP_HIGH
    if len(b.text) >= LENGTH_HIGH and density >= STOP_LOW:
        return "good"
    return "good" if b.article and density >= STOP_HIGH else "near" if density >= STOP_LOW or b.article else "short"


def _neighbours(found: list[Block]) -> list[tuple[int, int, str]]:
    """For each block the nearest decided one before it: enclosing elements shared with it, minus the distance, label."""
    out, shared, gone, label = [], 0, 0, "bad"
    for b in found:
        shared, gone = min(shared, b.shared), gone + 1
        out.append((shared, -gone, label))
        if b.label in ("good", "bad"):
            shared, gone, label = 1 << 60, 0, b.label
    return out


def classify(found: list[Block]) -> list[Block]:
    """Labels every block "good" or "bad"."""
    if not found:
        return found
    known = any(stop_density(b.text) >= STOP_LOW for b in found if not b.bad and len(b.text) >= LENGTH_LOW)
    marked = any(b.article and not b.bad for b in found)
    for b in found:  # pass one: each block by itself
        b.label = _alone(b, known, marked)
    decided = {b.article for b in found if b.label == "good"}
    for b in found:
        if b.label in ("near", "short") and (b.article not in decided if b.article else not decided and not marked):
            b.label = "good"
    turned = [Block(b.text, b.linked, b.heading, b.bad, b.article, after.shared if after else 0, b.label) for b, after in zip(found[::-1], [None, *found[:0:-1]], strict=True)]
    labels = []
    for b, before, after in zip(found, _neighbours(found), _neighbours(turned)[::-1], strict=True):  # pass two: the others by their neighbours
        if b.label in ("good", "bad"):
            labels.append(b.label)
        elif before[2] == after[2]:
            labels.append(before[2])
        elif before[0] != after[0]:
            labels.append(max(before, after)[2])
        elif b.heading:
            labels.append(after[2])
        elif before[1] != after[1]:
            labels.append("good" if b.label == "near" else max(before, after)[2])
        else:
            labels.append("good" if b.label == "near" else "bad")
    for b, label in zip(found, labels, strict=True):
        b.label = label
    return found


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
