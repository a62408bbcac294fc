"""Main text of web pages by tree scoring.

A page is parsed into a tree. Paragraphs earn points for length and commas and pass them to their ancestors; link density
discounts what a container has. The best container and those of its siblings that hold up are the article.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillframe.llm.common import small_batches

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")

#: What the HTML standard says of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot"}
SAME = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}
#: Elements that are never part of an article; words of a class or id that say the same, or do unless a likely word stands with them.
NOT_TEXT = frozenset("nav footer aside form button select dialog menu head object audio video canvas map figure input".split()) - {"figure"}
BESIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|comments?|commentlist|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w*|social|sharing|related|recommend\w*|menus?|nav|navbar|navigation|breadcrumbs?|footer|pagination|pager|widgets?|toolbar)(?=$|[\s_-])", re.I)
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:rail|respond|repl(?:y|ies)|responses|discussion|notices?|alert|overlay|signup|share|header|masthead|topbar|foot|copyright|login|search)(?=$|[\s_-])", re.I)
#: Parts of names that say where or how something is laid out; an unlikely word counts if its name has no other parts.
LAYOUT = frozenset("area bar bottom box bubble btn button buttons block col column container content-wrapper divider form global group holder icon icons inner item items left links list main message minimal modal nav outer overlay page panel post row section site text title top right wrap wrapper".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content|story|main|body|text|blog)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())


#: Elements nested deeper than this, as browsers have it, lie beside each other.
DEEPEST = 512


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "score", "size", "linked", "links", "depth", "holds")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.score = 0.0
        self.size = self.linked = self.links = 0
        self.depth = parent.depth + 1 if parent else 0
        self.holds = False  # an article or main below

    def attributes(self) -> dict[str, str]:
        return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(self.attrs)} if "=" in self.attrs else {}


def _tag(page: str, at: int, last: int, plain: bool) -> tuple[int, str, str, str, bool]:
    """The markup at a `<`: (end, slash, name, attributes, whether quotes don't count from here on); name is empty for comments and
    declarations, end is -1 for a `<` that is text. last: the place of the page's last `>`.

    A quote that is never closed can't hide the end of a tag; from there on tags end at the next `>`, so no part of a page is
    searched for the end of many tags.
    """
    if page.startswith("<!--", at):
        end = page.find("-->", at + 4)
        return (len(page) if end < 0 else end + 3), "", "", "", plain
    if at > last:
        return -1, "", "", "", plain
    if page.startswith(("<!", "<?"), at):
        return page.index(">", at) + 1, "", "", "", plain
    m = NAME.match(page, at)
    if not m:
        return -1, "", "", "", plain
    rest = None if plain else REST.match(page, m.end())
    if rest:
        return rest.end(), m[1], m[2].lower(), rest[1], False
    end = page.find(">", m.end())
    if end < 0:
        return -1, "", "", "", True
    return end + 1, m[1], m[2].lower(), page[m.end() : end], True


def parse(page: str) -> Node:
    """The element tree; text nodes are strings with references decoded. Open elements close as the HTML standard implies.

    Time is linear in the page's length: nesting is bounded, and elements below the bound close for themselves.
    """
    root = Node("html", "", None)
    here, at, n, last, plain = root, 0, len(page), page.rfind(">"), False
    opened: dict[str, int] = {}  # open elements by name
    beyond: dict[str, int] = {}  # those that lie too deep to be entered

    def left(node: Node) -> Node:
        """What is open once `node` and all in it is closed."""
        x = here
        while x is not node.parent:
            opened[x.tag] -= 1
            x = x.parent
        return x

    while at < n:
        less = page.find("<", at)
        while less >= 0:
            end, slash, tag, attrs, plain = _tag(page, less, last, plain)
            if end >= 0:
                break
            less = page.find("<", less + 1) if less < last else -1
        raw = page[at:less] if less >= 0 else page[at:]
        if raw:
            here.children.append(entities.unescape(raw) if "&" in raw else raw)
        if less < 0:
            break
        at = end
        if not tag:
            continue
        if here.depth < DEEPEST - 1 and beyond:
            beyond = {}
        if slash:
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            if opened.get(tag):
                here = left(_open(here, (tag,), ()))
            continue
        if tag in ("html", "body") and (tag == "html" or opened.get("body")):
            continue
        if tag in CLOSES_P and opened.get("p"):
            p = _open(here, ("p",), ("table", "td", "th", "button", "caption"))
            if p is not None:
                here = left(p)
        if tag in SAME:
            own, stop = SAME[tag]
            same = _open(here, own.split(), stop)
            if same is not None:
                here = left(same)
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in ("article", "main"):
            for x in _line(here):
                if x.holds:
                    break
                x.holds = True
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else n
        elif tag not in VOID and not attrs.endswith("/"):
            if node.depth < DEEPEST:
                here = node
                opened[tag] = opened.get(tag, 0) + 1
            else:
                beyond[tag] = beyond.get(tag, 0) + 1
    return root


def _line(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _open(node: Node, tags, stop) -> Node | None:
    for x in _line(node):
        if x.tag in tags:
            return x
        if x.tag in stop:
            return None
    return None


def unlikely(node: Node) -> bool:
    """Whether an element, by its tag, role, class or id, stands beside the article."""
    if node.tag in NOT_TEXT or node.tag in RAW:
        return True
    if node.tag == "header" and not any(x.tag in ("article", "main") for x in _line(node.parent)):
        return True
    if node.tag in ("article", "main", "body", "html") or "=" not in node.attrs and "hidden" not in node.attrs:
        return False
    own = node.attributes()
    if own.get("role", "").lower() in ROLES or own.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=|/)", node.attrs) and "aria-" not in node.attrs:
        return True
    if "display:none" in own.get("style", "").replace(" ", "").lower():
        return True
    if node.holds:
        return False  # a wrapper whose class tells of the layout
    name = f"{own.get('class', '')} {own.get('id', '')}"
    return bool(BESIDE.search(name)) or not LIKELY.search(name) and any(_beside(x) for x in name.split())


def _beside(name: str) -> bool:
    """Whether one class or id is an unlikely word, alone or with words of layout: share-bar is, share-price isn't."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    unlikely_parts = [x for x in parts if UNLIKELY.search(x)]
    return bool(unlikely_parts) and all(x in unlikely_parts or x.lower() in LAYOUT or x.isdigit() for x in parts)


def prune(root: Node) -> list[Node]:
    """Removes unlikely elements and measures the rest. Returns the nodes, parents first."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        node.children = [x for x in node.children if isinstance(x, str) or not unlikely(x)]
        todo += [x for x in node.children if not isinstance(x, str)]
    for node in reversed(nodes):
        for x in node.children:
            node.size += len(x.strip()) if isinstance(x, str) else x.size
            node.linked += 0 if isinstance(x, str) else x.size if x.tag == "a" else x.linked
            node.links += 0 if isinstance(x, str) else x.links + (x.tag == "a")
    return nodes


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def best(nodes: list[Node]) -> list[Node]:
    """The best container and those of its siblings that belong to the article, in page order."""
    held = set()
    for node in nodes:
        own = [x for x in node.children if isinstance(x, str) and not x.isspace()]
        if node.tag in ("p", "pre", "blockquote", "td") or own and node.tag in BLOCK:
            text = "".join(own) or "x" * min(node.size, 300)
            points = (1 + text.count(",") + min(node.size / 100, 3.0)) * (1 - density(node))
            up, share = (node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "h1", "h2", "h3", "h4", "h5", "h6") else node), 1.0
            for ancestor in _line(up):
                ancestor.score += points * share
                held.add(ancestor)
                share /= 2 if share == 1.0 else 3
    if not held:
        return nodes[:1]

    def value(node: Node) -> float:
        bonus = 25.0 if node.tag in ("article", "main") else 0.0
        if node.attrs and LIKELY.search(" ".join(node.attributes().get(k, "") for k in ("class", "id"))):
            bonus += 10.0
        return (node.score + bonus) * (1 - density(node))

    order = {id(x): k for k, x in enumerate(nodes)}
    top = max(held, key=lambda x: (value(x), -order[id(x)]))
    if top.parent is None:
        return [top]
    least = max(1.0, 0.2 * value(top))
    kept = []
    like = (top.tag, top.attributes().get("class", ""))
    for x in top.parent.children:
        if isinstance(x, str):
            continue
        if x is not top and (x.tag, x.attributes().get("class", "")) == like and density(x) < 0.25 and x.size and _sentence(x):
            kept.append(x)
            continue
        if x is top or x.tag in ("article", "main") or x in held and value(x) >= least and density(x) < 0.25 or x.tag in ("p", "h1", "h2", "h3") and top.tag not in ("article", "main") and x.size and density(x) < 0.25:
            kept.append(x)
    return kept


def _sentence(node: Node) -> bool:
    """Whether an element ends as a sentence does and isn't a notice of rights."""
    text = " ".join(blocks([node]))
    return text.endswith((".", "!", "?", "…", '."', ".”", "。")) and not re.search(r"©|copyright|rights reserved", text, re.I)


def blocks(containers: list[Node]) -> list[str]:
    """Text of each block in page order, white space turned into one space, empty blocks left out."""
    out: list[str] = []
    part: list[str] = []

    def close():
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    for top in containers:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                part.append(x)
            elif x is not top and _menu(x):
                close()
            elif x.tag == "br" or x.tag in ("td", "th"):
                part.append(" ")
                todo += x.children[::-1]
            elif x.tag in BLOCK:
                close()
                todo.append(None)
                todo += x.children[::-1]
            else:
                todo += x.children[::-1]
        close()
    return out


def _menu(x: Node) -> bool:
    """A list of nothing but three or more short links, at the beginning or the end of what it is in."""
    if x.tag not in ("ul", "ol") or x.links < 3 or density(x) < 0.95 or x.size > 25 * x.links:
        return False
    beside = x.parent.children
    at_edge = lambda order: next(y for y in order if not isinstance(y, str) or not y.isspace()) is x
    return at_edge(beside) or at_edge(reversed(beside))


def main_text(page: str | None) -> str:
    """Main text of one page: blocks joined by two line ends; empty for a page without text."""
    if not page:
        return ""
    return "\n\n".join(blocks(best(prune(parse(page)))))


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Adds the main text of each page as column `into` (replacing one of that name); no shuffle, one pass.

    Null or empty html gives the empty string. Whole pages are parsed in linear time, whatever their length. Of the article only what
    its tag, role, class or id says is beside it goes, and lists of three or more short links at an edge; nothing is capped. Rows pass through one to one: repeated rows, null ids and extra columns stay; an empty table stays empty.
    """
    small_batches(pages.sparkSession)
    return pages.withColumn(into, _main_text(F.coalesce(F.col(html), F.lit(""))))
