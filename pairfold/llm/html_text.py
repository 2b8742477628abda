"""Main text of HTML pages by two passes of block rules.

Markup is cut into blocks of text.  The first pass decides each block by its link density, its density of stop words, its
length and where it stands: what is in page furniture (menus, page headers and footers, sidebars, notices, adverts, forms,
comments of readers), as tags, roles, classes and ids tell, is no main text, and in articles, main and content containers
the limits are wider.  A class or id tells that if it speaks of furniture alone ("share-buttons"); where furniture is one of its
words among others ("market-share"), it speaks against a block only, and long prose is main text all the same.  On pages of
languages whose stop words aren't known, and in scripts without spaces, length and links decide.  Short blocks and blocks with few stop words stay ambiguous.  The second pass gives each of them the
label of the nearest decided neighbour.  In a container, neighbours are the container's own blocks, without furniture;
elsewhere they are all blocks of the page.  An ambiguous block of a container in which nothing is decided is main text
if it has no link.  If a page has articles or main elements, only what is in one can be main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import blocks

# Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that for on with as was be by at this are or from have not but you he his they an which we
    de la le et les des en un du une que est pour qui dans par sur au plus pas ce il elle sont avec ne se aux ou
    der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    el los que y del se las por con no una su para al lo como más pero sus le ya o fue este ha sí porque esta
    """.split()
)

# Elements without text of their own, and elements that are furniture wherever they stand.
_RAW = "script style textarea title xmp iframe noembed noframes".split()
_FURNITURE = frozenset("nav aside footer form dialog menu template noscript svg math select button object canvas video audio head datalist".split())
_STRUCTURE = _FURNITURE | frozenset("article main div section header ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote details summary fieldset address pre center hgroup".split())
_BLOCK = _STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 hr html body legend option".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of classes and ids that mark furniture; those of the second set do so outside an article alone.
_HINTS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner sidebar rail menu submenu
    nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment
    comments commentlist respond replies reply disqus widget toolbar pagination pager copyright disclaimer trending popular teaser
    paywall form
    """.split()
)
_PAGE_HINTS = frozenset("header masthead footer colophon topbar bottombar meta tags".split())
# Words of classes and ids of other pieces than the page's own, whose articles are never the page's.
_OTHERS = frozenset(
    "comment comments commentlist respond replies reply disqus related recommended recommendations trending popular teaser share sharing social".split()
)
# Words that tell nothing in a class or id, and words of furniture whatever stands beside them.
_PLAIN = frozenset(
    """
    a an and the this that on in of by for to is has no js css col row grid list lists box boxes block blocks bar bars wrap wrapper wrapped container
    inner outer area section item items unit slot button buttons btn btns link links icon icons panel body text content title heading
    header head footer author avatar date meta user users reader readers post posts page site main top bottom left right side global
    full small large big mini sticky fixed hidden open closed primary secondary widget widgets group tools card cards feed thread threads
    article articles entry story stories news blog more you now most read input field fields label submit query count counter
    facebook fb twitter tw linkedin whatsapp email mail print google video image img box inline new old first last odd even
    """.split()
)
_SURE = frozenset("adsense adslot adbox advert adverts advertisement advertising nav navbar navigation breadcrumb breadcrumbs sidebar gdpr newsletter commentlist disqus pagination pager submenu comments".split())
_LEFT_OPEN = "!"  # before the tag of a furniture element whose closing tag is missing
_CONTENT_HINTS = frozenset("content article post entry story main articlebody maincontent".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, in which ">" in quotes doesn't end it.
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: Tags whose quotes don't close are ended by the first ">"; after so many in a page, all are, so a page is read a few times at most.
_ODD_QUOTES = 16
#: Elements in deeper nests are part of the one that holds them, as in browsers.
_DEPTH = 512
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|$))""", re.I)
_ENDS = re.compile("[.!?\u061f\u06d4\u0964\u2026\u3002\uff01\uff1f]")  # of sentences
_WORDS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hints(words: list[str]) -> tuple[bool, bool]:
    """Whether the words of one class or id mark furniture, and whether they only speak against what has it."""
    hints = [w for w in words if w in _HINTS]
    if not hints:
        return False, False
    sure = any(w in _SURE or w in ("ad", "ads") for w in hints) or all(w in _HINTS or w in _PLAIN or w in _PAGE_HINTS or len(w) == 1 for w in words)
    return sure, not sure


def _marks(attributes: str) -> tuple[set[str], bool, bool]:
    """Words of class and id, whether it is furniture by these, by role or hidden, and whether it may be."""
    found, gone, doubt = set(), False, False
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for one in value.split():
                said = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", one))]
                sure, maybe = _hints(said)
                gone, doubt = gone or sure, doubt or maybe
                found.update(said)
        elif name == "role":
            gone |= not _ROLES.isdisjoint(value.lower().split())
        elif name == "style":
            gone |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            gone |= name == "hidden" or value.lower() == "true"
    return found, gone, doubt


class _Page:
    """Cuts a page into blocks: (text, characters in links, container, furniture, doubt).

    Articles and main elements are containers 1, 2, ...; elements whose class or id speaks of content are -1, -2, ...,
    which tell less; 0 is outside any.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, int, int, bool, bool]] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, furniture, container, doubt
        self.open: Counter[str] = Counter()  # tags of the stack
        self.text: list[str] = []
        self.linked, self.in_link, self.containers, self.contents = 0, False, 0, 0
        self.loose = False  # within an inline or paragraph element that is furniture; ends with the next block
        self.loose_tag = ""
        tags = list(_tags(page))
        ends = _closed(tags)
        at = 0
        for number, (begin, end, closes, tag, attributes) in enumerate(tags):
            if begin > at:
                self._say(page[at:begin])
            at = end
            if closes:
                self._close(tag)
            elif tag:
                self._open(tag, attributes, number in ends)
        if at < len(page):
            self._say(page[at:])
        self._flush()

    def _state(self) -> tuple[bool, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, 0, False)

    def _say(self, raw: str) -> None:
        if not self.loose:
            text = html.unescape(raw) if "&" in raw else raw
            self.text.append(text)
            if self.in_link:
                self.linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                away, container, doubt = self._state()
                self.blocks.append((text, self.linked, container, away, doubt))
            self.text = []
        self.linked, self.loose = 0, False

    def _pop_to(self, i: int) -> None:
        self.open.subtract(t for t, *_ in self.stack[i:])
        del self.stack[i:]

    def _open(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in _BLOCK:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.in_link = True
        if tag in _VOID or tag in ("html", "body"):
            return
        if tag in _ITEMS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in _ITEMS[tag]:
                    break
                if self.stack[i][0] == tag or {tag, self.stack[i][0]} in ({"dt", "dd"}, {"td", "th"}):
                    self._pop_to(i)
                    break
        words, gone, maybe = _marks(attributes) if "=" in attributes or "hidden" in attributes else ((), False, False)
        away, container, doubt = self._state()
        if tag not in _STRUCTURE:
            if gone and not self.loose:
                self.loose, self.loose_tag = True, tag
            return
        if len(self.stack) >= _DEPTH:
            return
        doubt |= maybe
        if tag in ("article", "main"):
            if not gone and container <= 0:
                away &= not self._left_open()
                if not away:
                    self.containers += 1
                    container = self.containers
        else:
            gone |= tag in _FURNITURE or not container and (tag == "header" or not _PAGE_HINTS.isdisjoint(words)) or "footer" in words
            if gone and not closed and tag not in _FURNITURE and _OTHERS.isdisjoint(words):
                tag = _LEFT_OPEN + tag
            if not container and not gone and not away and not _CONTENT_HINTS.isdisjoint(words):
                self.contents += 1
                container = -self.contents
        self.stack.append((tag, away or gone, container, doubt))
        self.open[tag] += 1

    def _left_open(self) -> bool:
        """Whether all furniture that is open are adverts and the like whose closing tag is missing in the page."""
        inner = False
        for tag, away, *_ in self.stack:  # furniture makes all that it holds furniture
            if away and not inner and not tag.startswith(_LEFT_OPEN) or tag in _FURNITURE:
                return False
            inner = away
        return True

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag == "a":
            self.in_link = False
        if self.loose and tag == self.loose_tag:
            self.loose = False
        if tag in _STRUCTURE:
            self.in_link = False
            if self.open[tag] > 0:
                self._pop_to(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))


def _tags(page: str):
    """(begin, end, closing, name, attributes) of tags; names are empty for comments and declarations.  One pass."""
    at, odd, size = 0, 0, len(page)
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else size
            yield begin, at, "", "", ""
        elif page.startswith(("!", "?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            yield begin, at, "", "", ""
        elif m := _NAME.match(page, at):
            rest = _REST.match(page, m.end()) if odd < _ODD_QUOTES else None
            if rest:
                at, attributes = rest.end(), rest[1]
            else:
                odd += 1
                end = page.find(">", m.end())
                if end < 0:  # a tag that never ends is dropped with what follows
                    yield begin, size, "", "", ""
                    return
                at, attributes = end + 1, page[m.end() : end]
            tag = m[2].lower()
            if tag in _RAW_END and not m[1]:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
                tag = ""
            yield begin, at, m[1], tag, attributes


def _closed(tags: list[tuple]) -> set[int]:
    """Numbers of the structural opening tags that have a closing tag of their own."""
    waiting: dict[str, list[int]] = {}
    out = set()
    for number, (_, _, closes, tag, _) in enumerate(tags):
        if tag in _STRUCTURE:
            if not closes:
                waiting.setdefault(tag, []).append(number)
            elif waiting.get(tag):
                out.add(waiting[tag].pop())
    return out


def stop_share(found: list[tuple]) -> float:
    """Share of stop words in the words of a page's blocks that are no furniture and mostly no links."""
    own = [w.lower() for text, linked, _, away, _ in found if not away and linked <= 0.3 * len(text) for w in _WORDS.findall(text)]
    return sum(w in STOP_WORDS for w in own) / max(1, len(own))


def first_pass(block: tuple[str, int, int, bool, bool], known: bool = True) -> tuple[bool | None, bool]:
    """True for main text, False for other text, None if ambiguous; and whether it leans to main text.

    ``known`` is whether the page's stop words are; if not, blocks from a length on count as
    dense in them if they hold the end of a sentence or are in a script without spaces.
    """
    text, linked, container, away, doubt = block
    inside = container != 0
    if away:
        return False, False
    size = len(text) - text.count(" ")
    found = _WORDS.findall(text)
    if linked > (0.6 if inside else 0.3) * size:
        return False, False
    unspaced = not known and size > 12 * max(1, len(found))  # a letter says as much as several of an alphabet
    if unspaced:
        size *= 3
    stops = sum(w.lower() in STOP_WORDS for w in found) / max(1, len(found)) if known else 0.2 * (size >= 100 and (unspaced or bool(_ENDS.search(text))))
    length = size if unspaced else len(text)
    if doubt and (length < 140 or stops < 0.2 or linked > 0.3 * size):
        return False, False
    if length < 70 or not found:
        return None, False
    if stops >= 0.2 and (length >= 140 or inside):
        return True, True
    return (None if inside or stops >= 0.08 else False), stops >= 0.2


def second_pass(blocks: list[tuple], first: list[tuple]) -> list[bool]:
    """Labels of all blocks: those of the first pass, and for ambiguous blocks those of the nearest decided neighbours.

    Of two that are as near, one that is main text counts; a block that leans to main text follows a farther one as well.
    """
    own: dict[int, list[int]] = {0: list(range(len(blocks)))}  # blocks among which those of a container have neighbours
    for i, (_, _, container, away, _) in enumerate(blocks):
        if container and not away:
            own.setdefault(container, []).append(i)
    out = [bool(label) for label, _ in first]
    for container, places in own.items():
        decided = [k for k, i in enumerate(places) if first[i][0] is not None]
        after = 0
        for k, i in enumerate(places):
            if first[i][0] is not None or blocks[i][2] != container:
                continue
            while after < len(decided) and decided[after] < k:
                after += 1
            near = decided[max(0, after - 1) : after + 1]
            if near:
                least = min(abs(j - k) for j in near)
                out[i] = any(first[places[j]][0] for j in near if abs(j - k) == least or first[i][1])
            else:
                out[i] = not blocks[i][1] if container else first[i][1]
    return out


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by blank lines; empty if there are none."""
    found = _Page(page).blocks
    if any(c > 0 and not away for _, _, c, away, _ in found):
        found = [b for b in found if b[2] > 0]
    known = stop_share(found) >= 0.08
    labels = second_pass(found, [first_pass(b, known) for b in found])
    return "\n\n".join(text for (text, *_), label in zip(found, labels, strict=True) if label)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: (id_col, url_col, text, n_chars in code points).

    A null or empty page, and one without main text, has an empty text.  Character references are decoded once, white
    space within a block becomes one space, and blocks are joined by two line feeds; nothing is cut off.  Repeated rows
    each give a row, and an empty table none.  Other columns are not read.
    """

    def run(batches):
        for ids, urls, pages in blocks(batches, ["id", "url", "html"]):
            texts = [main_text(p) if p else "" for p in pages]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
