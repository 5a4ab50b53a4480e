"""Main-text extraction from HTML by tree scoring.

A page is read once into a light tree of block elements. Parts that are never article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are cut by
element and by class, id or role. A class name cuts only if it says nothing else: ``social`` and
``social-links`` cut, ``social-science`` makes the part a suspect. Every remaining paragraph earns
points for its length and its commas and passes them to its ancestors (all to the parent, half to
the grandparent, a third, ... further up). A container's points are discounted by its link density.
The container with the most points is the article, or the ``article``/``main`` element around it if
that keeps ``WRAPPER_SHARE`` of the points. What lies beside it and beside the containers around it
is kept where links are few; suspects need points besides, and beside an ``article`` element another
one needs ``SIBLING_SHARE`` of its points.

Defined results for odd input
* Null, empty or text-free pages give the empty string.
* Unclosed and badly nested markup is read as browsers do for the common cases: a block opening
  closes an open paragraph, an end tag closes what is open inside it, a stray end tag is ignored, and
  a slash before ``>`` closes nothing. A quote that is never closed ends with its tag.
* Where no container scores, the text of the whole remaining body is the result.
* Ties go to the container that opens first. Repeated rows give repeated results; other columns are
  carried along unread.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# HTML element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style textarea title noscript template iframe noembed noframes xmp".split())
CUT = set(
    "head script style noscript template iframe noembed noframes textarea title nav header footer aside form "
    "button select option input label fieldset svg canvas video audio object embed applet dialog menu map".split()
)
BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address center details summary hr hgroup".split()
) | {"nav", "header", "footer", "aside", "form", "fieldset"}
CLOSES_P = BLOCK
#: Elements that an element of the same group closes when it opens.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words of a class, id or role that mark a part as not the article.
CUT_WORDS = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer foot bottombar "
    "colophon sidebar aside complementary contentinfo rail ad ads adv advert adverts advertisement advertising adbox "
    "adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notification alert "
    "disclaimer comment comments commentlist disqus respond replies reply discussion share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login popup modal overlay paywall pager "
    "pagination widget toolbar skip skiplink copyright legal form search hidden tags tagcloud outbrain taboola".split()
)
#: Words that go with those without giving them another meaning.
NEUTRAL = set(
    "area bar block bottom box button buttons card cards cell col column container content fixed global group holder home icon icons in inline "
    "inner item items js layout left links list main meta mobile modern module nav new outer page panel part post primary public region right "
    "row secondary section site slot small sticky to top ui unit user users reader readers view web wrap wrapper article story big".split()
)
#: Class names of which one beside a cutting one makes that a suspicion only.
CONTENT = set("article content post entry story main body text prose".split())
#: Elements that can be the article's container.
CONTAINERS = set("html body main article section div center table ul ol dl details".split())
KEPT_ALWAYS = {"html", "body", "main", "article"}
WRAPPER_SHARE = 0.3
SIBLING_SHARE = 0.2
#: Link densities under which text beside the article is kept, and under which a strong container is.
FEW_LINKS, SOME_LINKS = 0.25, 0.5

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:[\"'][^>]*)?>?|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "parts", "cut", "suspect", "points", "chars", "links", "order")

    def __init__(self, tag: str, parent: "_Node | None", cut: bool, order: int, suspect: bool = False):
        self.tag, self.parent, self.cut, self.order, self.suspect = tag, parent, cut, order, suspect
        self.parts: list = []  # child nodes, and (text, is_link) pieces of inline text
        self.points = 0.0
        self.chars = self.links = 0


CUT_IT, SUSPECT, CLEAR = 2, 1, 0


def _verdict_of_name(name: str) -> int:
    """What a single class name, id or role says of its part."""
    lowered, parted = set(_WORD.findall(name.lower())), set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
    for words in (lowered, parted):
        if not CUT_WORDS.isdisjoint(words):
            return CUT_IT if words <= CUT_WORDS | NEUTRAL else SUSPECT
    return CLEAR


def _verdict(tag: str, attrs: str) -> int:
    """Whether an element is cut, or suspected not to be article text."""
    if tag in CUT:
        return CUT_IT
    if not attrs or tag in ("html", "body"):
        return CLEAR
    worst, content = CLEAR, False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return CUT_IT
        if name == "style":
            if "display:none" in value.lower().replace(" ", ""):
                return CUT_IT
        elif name in ("class", "id", "role"):
            names = value.split()
            content = content or not CONTENT.isdisjoint(n.lower() for n in names)
            worst = max([worst, *map(_verdict_of_name, names)])
            # an article or main element is cut only where it is marked as a reader comment
            if tag in KEPT_ALWAYS and worst and "comment" not in value.lower():
                worst = CLEAR
    return min(worst, SUSPECT) if content else worst


def _tree(page: str) -> _Node:
    root = node = _Node("html", None, False, 0)
    links, order, at, inline_cut = 0, 0, 0, []
    opened: Counter = Counter()  # open elements by name, so that stray end tags need no look at all of them

    def closed(node: _Node, last: _Node) -> _Node:
        """What is open once the elements from ``node`` up to ``last`` are closed."""
        while node is not last:
            opened[node.tag] -= 1
            node = node.parent
        opened[last.tag] -= 1
        return last.parent

    n = len(page)
    search = _TOKEN.search
    while at < n:
        m = search(page, at)
        end = m.start() if m else n
        if end > at and not node.cut and not inline_cut:
            node.parts.append((page[at:end], links > 0))
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):  # an end tag
            if inline_cut:
                if tag in inline_cut:
                    while inline_cut.pop() != tag:
                        pass
                    continue
                if tag not in BLOCK:
                    continue
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in CUT:
                if opened[tag]:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    node, links, inline_cut = closed(node, up), 0, []
            continue
        attrs = m.group(3) or ""
        if tag in RAW_TEXT:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and tag != "wbr" and not node.cut:
                node.parts.append((" ", False))
            continue
        if tag in BLOCK or tag in CUT:
            inline_cut = []
            if tag in SAME and any(opened[t] for t in SAME[tag]):
                up = node
                while up.parent is not None and up.tag not in SCOPE[tag] and up.tag not in SAME[tag]:
                    up = up.parent
                if up.tag in SAME[tag] and up.parent is not None:
                    node, links = closed(node, up), 0
            if tag in CLOSES_P and opened["p"]:
                up = node
                while up is not None and up.tag != "p" and up.tag not in CLOSES_P:
                    up = up.parent
                if up is not None and up.tag == "p":
                    node, links = closed(node, up), 0
            if tag in ("html", "body"):
                continue
            order += 1
            verdict = CUT_IT if node.cut else _verdict(tag, attrs)
            child = _Node(tag, node, verdict == CUT_IT, order, verdict == SUSPECT)
            if not child.cut:
                node.parts.append(child)
            node = child
            opened[tag] += 1
        elif inline_cut:
            inline_cut.append(tag)
        elif tag == "a":
            links += 1
        elif attrs and _verdict(tag, attrs) == CUT_IT:
            inline_cut.append(tag)
    return root


def _clean(pieces: list[str]) -> str:
    text = "".join(pieces)
    if "&" in text:
        text = html.unescape(text)
    return _SPACE.sub(" ", text).strip()


def _runs(node: _Node):
    """Child nodes, and the runs of inline text between them as (text, link characters)."""
    run: list = []
    for part in [*node.parts, None]:
        if isinstance(part, tuple):
            run.append(part)
            continue
        if run:
            text = _clean([t for t, _ in run])
            if text:
                yield text, len(_clean([t for t, linked in run if linked])) if any(x for _, x in run) else 0
            run = []
        if part is not None:
            yield part


def _score(root: _Node) -> list[_Node]:
    """Fill points, chars and links bottom-up; containers in page order."""
    found, stack = [], [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            found.append(node)
            stack.append((node, True))
            node.parts = list(_runs(node))
            stack.extend((x, False) for x in reversed(node.parts) if isinstance(x, _Node))
            continue
        for part in node.parts:
            if isinstance(part, _Node):
                node.chars, node.links = node.chars + part.chars, node.links + part.links
                continue
            text, linked = part
            node.chars, node.links = node.chars + len(text), node.links + linked
            points = (min(len(text) / 100, 3.0) + text.count(",") + (1 if len(text) >= 25 else 0)) * (1 - linked / len(text))
            # a paragraph passes its points on; loose text in a container is the container's own
            up, share = (node if node.tag in CONTAINERS else node.parent), 1
            while up is not None and share <= 5:
                up.points += points / share
                up, share = up.parent, share + 1
    return found


def _density(node: _Node) -> float:
    return node.links / node.chars if node.chars else 1.0


def _final(node: _Node) -> float:
    return node.points * (1 - node.links / node.chars) if node.chars else 0.0


def _emit(node: _Node, out: list[str]) -> None:
    _emit_parts(node.parts, out)


def _emit_parts(parts: list, out: list[str]) -> None:
    """All text of parts of a node but for suspects that have no prose."""
    stack = list(reversed(parts))
    while stack:
        part = stack.pop()
        if not isinstance(part, _Node):
            out.append(part[0])
        elif not part.suspect or _is_prose(part):
            stack.extend(reversed(part.parts))


def _is_prose(node: _Node) -> bool:
    """A suspect is cleared by points and few links."""
    return _density(node) < FEW_LINKS and node.points >= 1


def _beside(part: _Node, best: _Node) -> bool:
    """Whether a part that lies beside the best container, or beside one around it, is article text."""
    strong = _final(part) >= max(1.0, SIBLING_SHARE * _final(best)) and _density(part) < SOME_LINKS
    if part.tag == "article" and best.tag == "article":
        return strong
    if part.suspect:
        return _is_prose(part)
    return strong or _density(part) < FEW_LINKS


def extract_main_text(page: str | None) -> str:
    """Text of the article of an HTML page, one line per block."""
    if not page:
        return ""
    root = _tree(page)
    nodes = _score(root)
    best = max((x for x in nodes if x.tag in CONTAINERS), key=lambda x: (_final(x), -x.order), default=root)
    out: list[str] = []
    if _final(best) <= 0:
        _emit(next((x for x in nodes if x.tag in ("article", "main") and x.chars), root), out)
        return "\n".join(out)
    up = best
    while up is not None and not (up.tag in ("article", "main") and _final(up) >= WRAPPER_SHARE * _final(best)):
        up = up.parent
    best = up or best
    path = [best]  # up to the outermost container whose other parts may belong to the article
    while path[-1].parent is not None and path[-1].tag != "main":
        path.append(path[-1].parent)
        if best.tag == "article":
            break  # beside an article element only further articles are article text
    on_path = {x.order for x in path}
    stack: list = [path[-1]]
    while stack:
        part = stack.pop()
        if not isinstance(part, _Node):
            out.append(part[0])
        elif part is best:
            # in a container that the page does not call its article, blocks of links are menus
            inside = part.parts if best.tag in ("article", "main") else [x for x in part.parts if not (isinstance(x, _Node) and x.tag in CONTAINERS and _density(x) >= SOME_LINKS)]
            _emit_parts(inside, out)
        elif part.order in on_path:
            for x in reversed(part.parts):
                if not isinstance(x, _Node):
                    if best.tag != "article" and x[1] < FEW_LINKS * len(x[0]):
                        stack.append(x)
                elif x.order in on_path or ((best.tag != "article" or x.tag == "article") and _beside(x, best)):
                    stack.append(x)
        else:
            _emit(part, out)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def main_text(page: pd.Series) -> pd.Series:
    """Main text of a column of HTML pages."""
    return pd.Series([extract_main_text(p) for p in page], dtype="object")


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``html_col`` replaced by the main text in ``out_col``; one map pass, no shuffle."""
    return pages.withColumn(out_col, main_text(F.col(html_col)).alias(out_col)).drop(*({html_col} - {out_col}))
