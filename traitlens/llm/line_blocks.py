"""HTML main text by line-block distribution.

Markup is stripped so that every block of a page becomes a line.  Lines of
navigation, headers, footers, sidebars, notices, adverts, forms, scripts and
comments keep their place but lose their text, and text inside links does not
count.  The text lengths of a few neighbouring lines are summed over a sliding
window; where the sum surges from a low to a high value a text part begins, where
it dives to zero the part ends, and the lines between the two are kept.

An aside between lines of text is one empty line, whatever its size, so it does not end
the part around it.  Where article and main hold at least half of a page's text
they bound it: lines outside count as empty.  Inside them link text counts too, and
a part that surges there reaches back over all marked lines before the surge, elsewhere
to the first heading since the last dive.  Several parts are kept when each of them
surges; if none does, the longest one is.

An element is an aside by its tag, its role or a whole name in class or id, unless it
holds most of the page's text; headings in an article stay, and so do figures.  An
object, canvas or the like without an end tag counts as empty.

Defined results: a NULL, empty or text-free page gives an empty text; unclosed
and stray tags are read as browsers do, a block tag ends the line; repeated pages
give a row each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per sliding window, and the window sum that counts as a surge.
SPAN = 3
SURGE = 60

# Elements of HTML by their part on a page.
_RAW = "script style noscript template textarea title iframe object svg math canvas audio video select".split()
#: Raw elements that run to the end of the page when their end tag is missing; the others then count as empty.
_UNENDED = set("script style textarea title iframe".split())
_ASIDE = set("nav header footer aside form dialog menu button".split())
_VOID = set("area base br col embed hr img input link meta source track wbr param keygen".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Names that page authors give to parts outside the article, and words that may stand beside them in one name.
_COMMENT_NAME = r"comments?|comment-?(?:list|section|thread|area|form)s?|disqus\w*|replies|respond"
_ASIDE_NAME = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|nav-?bar|navigation|menu\w*|breadcrumbs?|side-?bars?|footer|header|masthead|"
    r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|sign-?up|login|share|sharing|social\w*|related\w*|recommend\w*|"
    r"widgets?|toolbar|pagination|pager|skip-?links?|copyright|legal|tags?|author-?bio|byline-?links|reply|" + _COMMENT_NAME
)
_BESIDE = r"site|main|global|top|bottom|left|right|primary|secondary|container|box|wrap|wrapper|area|bar|bars|block|section|inner|list|links?|buttons?|icons?|items?|posts?|articles?|form|media|text|unit|slot|\d+"
_ASIDE_TOKEN = re.compile(rf"(?:(?:{_BESIDE})[-_]+)*(?:{_ASIDE_NAME})(?:[-_]+(?:{_ASIDE_NAME}|{_BESIDE}))*", re.I)
_COMMENT_TOKEN = re.compile(rf"(?:(?:{_BESIDE})[-_]+)*(?:{_COMMENT_NAME})(?:[-_]+(?:{_BESIDE}))*", re.I)
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"\s+")


@dataclass
class _Line:
    parts: list[str] = field(default_factory=list)
    links: int = 0
    inside: int = 0
    aside: bool = False
    heading: bool = False
    text: str = ""


@dataclass
class _Element:
    """An open tag: its parent's place, why it may be an aside, and the characters of text in it."""

    name: str
    parent: int
    kind: str = ""
    inside: int = 0
    link: bool = False
    heading: bool = False
    plain: int = 0
    marked: int = 0
    marks: int = 0
    aside: bool = False


def _kind(name: str, attributes: str, inside: int) -> str:
    """``hidden``, ``tag``, ``comments``, ``name`` or nothing."""
    if name in _ASIDE:
        # An article's own header holds its title.
        return "" if name == "header" and inside else "tag"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return "hidden"
    if found.get("role", "").lower() in _ASIDE_ROLES:
        return "name"
    names = [x for k in ("class", "id") for x in found.get(k, "").split() if _ASIDE_TOKEN.fullmatch(x)]
    if any(_COMMENT_TOKEN.fullmatch(x) for x in names):
        return "comments"
    if name in _HEADINGS or inside and all(re.search("header|masthead", x, re.I) for x in names):
        return ""
    return "name" if names else ""


def _judge(elements: list[_Element]) -> None:
    """Which elements are asides: none that holds the page's main or most of its text, whatever it is called."""
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.plain += e.plain
        up.marked += e.marked
        up.marks += e.marked if e.name in ("article", "main") else e.marks
    page = elements[0]
    with_main = [False] * len(elements)
    for k in range(len(elements) - 1, 0, -1):
        with_main[k] |= elements[k].name == "main" and elements[k].marked > 0
        with_main[elements[k].parent] |= with_main[k]
    for k, e in enumerate(elements[1:], 1):
        if e.kind == "comments":
            keep = with_main[k]
        elif e.kind == "tag" and e.name != "form":
            keep = 2 * e.marks > page.marked
        elif page.marked:
            keep = 2 * e.marked > page.marked
        else:
            keep = 2 * e.plain > page.plain
        e.aside = elements[e.parent].aside or e.kind == "hidden" or (bool(e.kind) and not keep)


def page_lines(page: str) -> list[_Line]:
    """Lines in page order, their text cleaned."""
    # Text pieces with their element; None ends a line.
    pieces: list[tuple[int, str] | None] = []
    elements, stack, at, endless = [_Element("", 0)], [0], 0, set()

    def text_of(piece: str) -> None:
        if piece:
            e = elements[stack[-1]]
            n = len(_SPACES.sub(" ", piece).strip())
            e.plain += 0 if e.link else n
            e.marked += n if e.inside else 0
            pieces.append((stack[-1], piece))

    while tag := _TOKEN.search(page, at):
        text_of(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in _RAW_ENDS:
            if not tag["close"] and not tag["attrs"].endswith("/"):
                end = None if name in endless else _RAW_ENDS[name].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
                    at = len(page) if name in _UNENDED else at
            if name not in ("svg", "math"):
                pieces.append(None)
            continue
        if name == "br":
            text_of(" ")
            continue
        if name not in _INLINE:
            pieces.append(None)
        if tag["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == name), None)
            # An inline end tag does not close blocks around it.
            if depth is not None and (name not in _INLINE or all(elements[k].name in _INLINE for k in stack[depth:])):
                del stack[depth:]
            continue
        if name in _VOID or tag["attrs"].endswith("/"):
            continue
        if name not in _INLINE:
            # A new block ends inline elements and paragraphs left open.
            while len(stack) > 1 and ((open_name := elements[stack[-1]].name) in _INLINE or open_name == "p" or (name == open_name and name in ("li", "dt", "dd", "option", "tr", "td", "th"))):
                stack.pop()
        up = elements[stack[-1]]
        inside = max(up.inside, {"article": 2, "main": 1}.get(name, 0))
        elements.append(_Element(name, stack[-1], _kind(name, tag["attrs"], up.inside), inside, up.link or name == "a", up.heading or name in _HEADINGS))
        stack.append(len(elements) - 1)
    text_of(page[at:])
    _judge(elements)

    lines = [_Line()]
    for piece in pieces:
        line = lines[-1]
        if piece is None:
            if line.parts or line.aside:
                lines.append(_Line())
            continue
        e = elements[piece[0]]
        if e.aside:
            line.aside = True
            continue
        line.inside = max(line.inside, e.inside)
        line.heading = line.heading or e.heading
        line.parts.append(piece[1])
        if e.link:
            line.links += len(_SPACES.sub(" ", piece[1]).strip())
    for line in lines:
        line.text = _SPACES.sub(" ", html.unescape("".join(line.parts))).strip()
    return [x for x in lines if x.text or x.aside]


def main_text(page: str | None, span: int = SPAN, surge: int = SURGE) -> str:
    """The text between surge and dive points, blocks joined by a line end."""
    if not page:
        return ""
    lines = page_lines(page)
    size = lambda x: len(x.text) if x.inside else max(0, len(x.text) - x.links)
    marked, total = sum(size(x) for x in lines if x.inside), sum(map(size, lines))
    bounded = 0 < total <= 2 * marked
    rows: list[_Line] = []
    for x in lines:
        if x.text and (x.inside or not bounded):
            rows.append(x)
        elif rows and rows[-1].text:
            rows.append(_Line())
    lengths = [size(x) for x in rows]
    # The sums over windows that begin at each line; where they are zero nothing follows within a window.
    sums = [sum(lengths[k : k + span]) for k in range(len(lengths))]
    parts, low, begin = [], [], None
    for k in range(len(sums) + 1):
        alive = k < len(sums) and sums[k] > 0
        if alive and begin is None:
            begin = k
        elif not alive and begin is not None:
            rise = next((j for j in range(begin, k) if sums[j] >= surge), None)
            if rise is None:
                low.append((begin, k))
            else:
                start = next((j for j in range(begin, rise) if rows[j].heading or rows[j].inside), rise)
                while not lengths[start] and not rows[start].heading:
                    start += 1
                parts.append((start, k))
            begin = None
    if not parts and low:
        start, end = max(low, key=lambda p: sum(lengths[p[0] : p[1]]))
        while not lengths[start] and not rows[start].heading:
            start += 1
        parts = [(start, end)]
    return "\n".join(rows[k].text for part in parts for k in range(*part) if rows[k].text)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; a row map without a shuffle."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    text = extract.asNondeterministic()(F.coalesce(F.col(html_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
