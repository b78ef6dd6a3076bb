"""Main text of web pages by tree scoring.

A page is read once into a tree; unclosed and crossing tags are tolerated as browsers do. Each block with text gives
points, one and one more for each comma and each hundred characters (three at most), to its parent, half of them to the
next ancestor, a quarter to the next, and so on; so a container's points are those of its own blocks and half of its
children's, in time linear in the page. A container's score is its points times the share of its text outside links. The
best container, of those within each other that score alike the outermost, is kept with siblings that score a fifth of it or are paragraphs of plain text; around it, at any height,
headings before it and containers that score a fifth of it are kept too. No tag makes a container the best.

Navigation, headers, footers, asides, forms, scripts, styles and what is hidden go by their tags and attributes. Words of
class, id or role judge containers only, never headings or blocks of text, and decide nothing alone: a container named
like boilerplate has a quarter of its score, and goes if that is under a fifth of the best and it is named by that alone,
is over a quarter links or has under SHORT characters. Containers named as reader comments go, for nothing else tells
them from an article, unless nothing would be left. Lists that are mostly links go too.

Character references are decoded, white space within a block becomes one space, blocks are joined by one space. Null or
empty html, or a page without text, gives the empty string; a page without any container gives all its text but what goes
by tag. Null or repeated page_ids are read row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices, texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Tag lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of the second set, up to the nearest element of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
# Boilerplate by tag, and by words of class, id or role.
NO_TAGS = frozenset("head nav header footer aside form button select input dialog menu svg canvas object audio video script style textarea title noscript iframe template".split())
NO_WORDS = frozenset(
    "ad adbox ads adslot adunit adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Readers' words: never a wrapper of the article.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Names that begin so tell of the layout, as in has-sidebar, or of a kind of text, as in long-form.
LAYOUT = frozenset("has with no without not is show hide long".split())
#: Words written as one.
STEMS = ("advert", "breadcrumb", "cookie", "newsletter", "sidebar", "sponsor")
TAILS = ("nav", "menu", "sidebar", "banner", "comments")
#: Never judged by name: the page, and blocks of text.
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th tr figcaption caption".split()) | INLINE
HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure".split())
#: Text of fewer characters in a container named like boilerplate is a notice, not a part of an article.
SHORT = 200
#: What a container must score of the best to belong to it, and what a name like boilerplate leaves of a score.
FIFTH, NAMED = 0.2, 0.25
#: Scores that differ by less are alike.
ALIKE = 0.9


def is_boilerplate(word: str) -> bool:
    return word in NO_WORDS or word.startswith(STEMS) or word.endswith(TAILS)


def judged(names: str) -> int:
    """0 for names (of class, id or role) of content, 1 if one holds a word of boilerplate, 2 if one is such a word, 3 if
    one names reader comments."""
    worst = 0
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in LAYOUT:
            continue
        if words[0] in COMMENTS or words[-1] in COMMENTS or words[-1].endswith("comments"):
            return 3
        if any(map(is_boilerplate, words)):
            worst = max(worst, 2 if len(words) == 1 else 1)
    return worst


def read_attributes(text: str) -> tuple[str, bool]:
    """The values of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names.append(value)
        hidden |= name == "hidden" or name == "style" and bool(NO_DISPLAY.search(value))
    return " ".join(names), hidden


class Page:
    """The tree of a page: parallel lists of its elements, and its text in page order."""

    def __init__(self, html: str, by_name: bool = True):
        self.tag, self.up, self.drop = ["#root"], [0], [False]
        #: How each element is judged by its names.
        self.name = [0]
        self.by_name = by_name
        #: (element, text); text None ends a block.
        self.flow: list[tuple[int, str | None]] = []
        self._read(html)
        n = len(self.tag)
        self.size, self.linked = [0] * n, [0] * n
        self._weigh()

    def _open(self, tag: str, attributes: str, at: int) -> int:
        drop, name = self.drop[at] or tag in NO_TAGS, 0
        if not drop and attributes:
            names, drop = read_attributes(attributes)
            name = judged(names) if self.by_name and tag not in UNNAMED else 0
        self.tag.append(tag)
        self.up.append(at)
        self.name.append(name)
        self.drop.append(drop or name == 3)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        at, done, end = 0, 0, len(html)
        flow, tags, up = self.flow, self.tag, self.up
        opened: dict[str, int] = {}

        def leave(at: int, k: int) -> int:
            """Closes the elements from at up to k; the one around it."""
            while at != up[k]:
                opened[tags[at]] -= 1
                at = up[at]
            return at

        while done < end:
            m = TOKEN.search(html, done)
            start = m.start() if m else end
            if start > done and not self.drop[at]:
                flow.append((at, html[done:start]))
            if not m:
                break
            done = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                k = at if opened.get(tag) else 0
                while k and tags[k] != tag:
                    # An inline end tag doesn't reach past a block; other end tags close what is open inside.
                    k = 0 if tag in INLINE and tags[k] not in INLINE else up[k]
                if k:
                    at = leave(at, k)
                if tag not in INLINE:
                    flow.append((at, None))
                continue
            if tag in CLOSES_P and opened.get("p"):
                k = at
                while tags[k] in INLINE:
                    k = up[k]
                if tags[k] == "p":
                    at = leave(at, k)
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                k = at
                last = 0
                while k and tags[k] not in stops:
                    if tags[k] in ends:
                        last = k
                    k = up[k]
                if last:
                    at = leave(at, last)
            if tag not in INLINE:
                flow.append((at, None))
            if tag in VOID:
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, done)
                done = close.end() if close else end
                continue
            if m[3].rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P:
                continue
            at = self._open(tag, m[3], at)
            opened[tag] = opened.get(tag, 0) + 1

    def _weigh(self) -> None:
        self.texts: list[tuple[int, str | None]] = []
        #: The text of each block's own runs.
        self.own: dict[int, list[str]] = {}
        link = [False] * len(self.tag)
        block = [0] * len(self.tag)
        for k in range(1, len(self.tag)):
            link[k] = link[self.up[k]] or self.tag[k] == "a"
            block[k] = block[self.up[k]] if self.tag[k] in INLINE else k
        for k, text in self.flow:
            if text is not None and "&" in text:
                text = unescape(text)
            self.texts.append((k, text))
            if text is not None and not self.drop[k]:
                n = len(text.strip())
                self.size[k] += n
                self.linked[k] += n * link[k]
                if n:
                    self.own.setdefault(block[k], []).append(text)
        for k in range(len(self.tag) - 1, 0, -1):
            self.size[self.up[k]] += self.size[k]
            self.linked[self.up[k]] += self.linked[k]

    def density(self, k: int) -> float:
        return self.linked[k] / self.size[k] if self.size[k] else 0.0

    def scores(self) -> list[float]:
        """Points of each container, less the share of links in its text; a quarter for those named like boilerplate."""
        points, given = [0.0] * len(self.tag), [0.0] * len(self.tag)
        for k, parts in self.own.items():
            text = " ".join("".join(parts).split())
            share = 1 + text.count(",") + min(len(text) // 100, 3)
            given[k] += share
            if not k:
                points[0] += share
        # What an element hands up: its own block's points, and half of what it was handed.
        for k in range(len(self.tag) - 1, 0, -1):
            points[self.up[k]] += given[k] + points[k] / 2
        return [p * (1 - self.density(k)) * (NAMED if self.name[k] else 1) for k, p in enumerate(points)]

    def chosen(self) -> tuple[set[int], set[int]]:
        """The containers that are kept, the best and what belongs to it; and those inside that go."""
        scores = self.scores()
        best = max(range(len(scores)), key=lambda k: (scores[k], k))
        top, least = scores[best], FIFTH * scores[best]
        # Of containers within containers that score alike the outermost is the best.
        k = best
        while k:
            k = self.up[k]
            if scores[k] >= ALIKE * top:
                best = k
        path, k = set(), best
        while k:
            path.add(k)
            k = self.up[k]
        kept = {best}
        for k in range(1, len(self.tag)):
            # Elements beside the best or beside what is around it.
            if k in path or self.up[k] == best or self.up[k] and self.up[k] not in path or self.drop[k] or not self.size[k]:
                continue
            plain = self.tag[k] in PARAGRAPHS and self.density(k) < 0.25 and (self.size[k] > 80 or not self.linked[k])
            beside = self.up[k] == self.up[best] and self.tag[best] not in ("body", "html")
            head = k < best and self.tag[k] in HEADS and not self.linked[k]
            if scores[k] >= max(10, least) or beside and plain or head:
                kept.add(k)
        # A wrapper of all that is kept stays whatever its name.
        gone = {k for k in range(1, len(self.tag)) if k not in path and self._goes(k, scores[k] < least)}
        return kept, gone

    def _goes(self, k: int, low: bool) -> bool:
        """Whether an element of the best container is boilerplate after all."""
        if self.tag[k] in ("ul", "ol") and self.density(k) > 0.8:
            return True
        return bool(self.name[k]) and low and (self.name[k] == 2 or self.density(k) > 0.25 or self.size[k] < SHORT)

    def text(self) -> str:
        kept, gone = self.chosen()
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = (k in kept or bool(k) and inside[self.up[k]]) and k not in gone
        parts = [(" " if t is None else t) for k, t in self.texts if t is None or inside[k] and not self.drop[k]]
        return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The main text; names are left out of account where they would leave none."""
    if not html:
        return ""
    return Page(html).text() or Page(html, by_name=False).text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                out = [main_text(x) for x in texts(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
