"""Main text of HTML pages by composite text density.

A tolerant tree is built from the whole page, and elements that never hold article text are left out of it. Every node
gets a density, its characters for each tag, adjusted by the share of link characters and link tags. Children's densities
are summed up, the container with the largest sum is selected, and with it all nodes at least as dense as the least dense
one on its path to the body. Names of classes and ids remove nothing: some of them lower a node's density, and
a node so named within the selected subtree stays if it is still as dense as that threshold.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheaf.llm.common import map_column

# HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body center details div main section table tbody td blockquote dl figure ol ul".split())
NEVER = set("head script style template noscript iframe svg math canvas object embed applet audio video map nav footer aside form button select datalist textarea dialog menu".split())
CLOSES_P = BLOCK - set("body caption html legend optgroup option tbody td tfoot th thead tr summary".split())
#: Start tag -> (open tags that it ends, tags beyond which it doesn't look).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words of class and id attributes, and roles, that mark what isn't the article.
_WORDS = (
    r"ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|popup|popover|modal|overlay|newsletter|subscri\w*|signup|menu\w*|nav|navbar|"
    r"navigation|breadcrumbs?|sidebar\w*|footer|masthead|topbar|comments?|commentlist|disqus\w*|respond|replies|discussion|share|sharing|social\w*|"
    r"related|recommend\w*|widgets?|pagination|pager|paging|toolbar|login|search\w*|alert|toc|sign[_-]up|side[_-]bar|(?:site|page)[_-]header|skip[_-]link"
)
#: Words that such words are combined with, for their place or form. Other words make it another thing.
_PLACES = (
    r"site|page|main|left|right|top|bottom|primary|secondary|global|mobile|area|bar|block|box|button|buttons|container|form|group|icons?|inner|items?|links?|list|outer|panel|"
    r"posts?|articles?|section|text|title|widget|wrap|wrapper|message|center|unit|slot|[0-9]+"
)
#: A whole name; one of the layout (has-sidebar, with-comments, page-with-toc) speaks of other nodes.
CLUTTER = re.compile(rf"(?:(?:{_PLACES})[_-]+)*(?:{_WORDS})(?:[_-]+(?:{_WORDS}|{_PLACES}))*", re.I)
LARGE, LARGE_COMMENTS = 0.5, 0.9  # shares of a page's text, above which names don't lower a node's density
WEIGHT = 0.2  # of the density of a node that is named like clutter
TEXTUAL = set("h1 h2 h3 h4 h5 h6 p pre blockquote".split())  # names of these are anchors and styles
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|replies|reply)(?:$|[\s_-])", re.I)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|[^<]+|<", re.S)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "marks", "kids", "up", "chars", "tags", "link_chars", "link_tags", "density", "total", "size", "holds", "weight")

    def __init__(self, tag: str, up: Node | None, marks: dict[str, str] | None = None) -> None:
        self.tag, self.up, self.marks = tag, up, marks or {}
        self.kids: list[Node | str] = []
        self.weight = 1.0


def parse(page: str) -> Node:
    """The page as a tree; unclosed and misnested tags are put right much as browsers do."""
    root = node = Node("html", None)
    at, last = 0, page.rfind(">")
    while at < len(page):
        m = TOKEN.match(page, at) if at <= last else None
        if m is None:  # no tag can follow
            node.kids.append(page[at:])
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or len(text) == 1:
                node.kids.append(text)
            continue
        tag = tag.lower()
        if m.group(1):
            up = node
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in ("td", "th", "table", "li", "article", "section", "div"):
                    up = root  # an inline end tag doesn't reach out of its block
                    break
                up = up.up
            if up is not root:
                node = up.up
            continue
        if tag in ("html", "body") and tag == root.tag:
            continue
        if tag in CLOSES_P:
            up = node
            while up is not root and up.tag != "p" and up.tag not in ("td", "th", "button", "object", "table", "li", "div", "article", "section", "body"):
                up = up.up
            if up.tag == "p":
                node = up.up
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            up = node
            while up is not root and up.tag not in beyond:
                if up.tag in ended:
                    node = up.up
                up = up.up
        attributes = m.group(3)
        marks = {k.lower(): a or b or c for k, a, b, c in MARKS.findall(attributes)} if len(attributes) > 2 else None
        new = Node(tag, node, marks)
        node.kids.append(new)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if tag not in ("script", "style"):
                new.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        node = new
    return root


def clutter(node: Node, inside: bool, size: int) -> bool:
    """Whether an element can't be part of the article, whatever its text; inside: it is within an article or main element;
    size: of the page's text."""
    if node.tag in NEVER and not (node.tag == "form" and (node.holds or node.size > LARGE * size)):
        return True
    if node.tag in ("html", "body", "main", "article"):
        return node.tag == "article" and clutter_article(node)
    if node.tag == "header" and not inside:
        return True
    hidden = "hidden" in node.marks or node.marks.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", node.marks.get("style", ""))
    return bool(hidden) or node.marks.get("role", "").lower() in ROLES


def named_clutter(node: Node, inside: bool, size: int, elsewhere: bool) -> bool:
    """Whether a node's names speak of clutter; elsewhere: the page has article or main elements, so what is outside of
    them isn't the article, however large."""
    said = f"{node.marks.get('class', '')} {node.marks.get('id', '')}"
    if len(said) < 2 or node.holds or node.tag in TEXTUAL or node.tag in ("html", "body", "main", "article"):
        return False
    names = node.marks.get("class", "") if inside and node.tag == "section" else said  # a section's id is where contents lead to
    small = node.size <= (LARGE_COMMENTS if COMMENTS.search(said) else LARGE) * size
    return (small or elsewhere and not inside) and any(CLUTTER.fullmatch(n) for n in names.split())


def weigh(root: Node) -> bool:
    """Gives every node its size, characters of text, and whether it holds the page's title or article. Whether the page has
    an article or main element."""
    nodes = [root]
    for node in nodes:
        nodes += [k for k in node.kids if not isinstance(k, str)]
    for node in reversed(nodes):
        node.size, node.holds = 0, node.tag in ("h1", "main") or node.tag == "article" and not clutter_article(node)
        if node.tag in NEVER and node.tag != "form":
            node.holds = False
            continue
        for k in node.kids:
            if isinstance(k, str):
                node.size += len(SPACES.sub(" ", k).strip())
            else:
                node.size += k.size
                node.holds = node.holds or k.holds
    return any(n.holds and n.tag in ("article", "main") for n in nodes)


def clutter_article(node: Node) -> bool:
    """Whether an article element is a comment."""
    return bool(COMMENTS.search(f"{node.marks.get('class', '')} {node.marks.get('id', '')}"))


def prune(root: Node) -> None:
    """Takes elements that can't be part of the article out of the tree, and weighs those that are named like clutter."""
    elsewhere = weigh(root)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main") or node.marks.get("role") == "main"
        node.kids = [k for k in node.kids if isinstance(k, str) or not clutter(k, inside, root.size)]
        node.weight = WEIGHT if named_clutter(node, inside, root.size, elsewhere) else 1.0
        todo += [(k, inside) for k in node.kids if not isinstance(k, str)]


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with densities and their sums over children."""
    nodes = [root]
    for node in nodes:
        nodes += [k for k in node.kids if not isinstance(k, str)]
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(SPACES.sub(" ", k).strip())
            else:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.chars if k.tag == "a" else k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, lc = node.chars, node.chars if node.tag == "a" else node.link_chars
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        ratio = c / max(1, lc) * max(1, node.tags) / max(1, node.link_tags)
        # without links the base would be 1: its logarithm is kept from falling below 1, so that characters per tag count
        node.density = c / max(1, node.tags) * math.log(max(ratio, 1.0)) / max(1.0, math.log(base)) * node.weight if c else 0.0
        kids = [k.density for k in node.kids if not isinstance(k, str)]
        node.total = sum(kids) if kids else node.density
    return nodes


def select(root: Node) -> tuple[Node | None, float]:
    """The subtree that holds the article, and the least density on its path to the body."""
    nodes = measure(root)
    best = max((n for n in nodes if n.tag in CONTAINERS or n is root), key=lambda n: n.total)
    if not best.chars:
        return (root if root.chars else None), 0.0
    path = [best]
    while path[-1].tag != "body" and path[-1].up is not None:
        path.append(path[-1].up)
    least = min(n.density for n in path)
    # siblings as dense as the path belong to the article: go up to the container of them all
    top = best
    for up in path[1:]:
        if sum(k.density >= least and k.link_chars < 0.5 * k.chars for k in up.kids if not isinstance(k, str)) > 1:
            top = up
    for up in path:
        if up.tag in ("article", "main") or up.marks.get("role") == "main" or up.marks.get("itemprop") == "articleBody":
            return (up if up in path[path.index(top) :] else top), least
    return top, least


def thin(top: Node, least: float) -> None:
    """Takes the nodes that are named like clutter and less dense than the threshold out of the selected subtree."""
    todo = [top]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or k.weight == 1.0 or k.density >= least]
        todo += [k for k in node.kids if not isinstance(k, str)]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks within a node, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            held.append(k)
        elif k.tag in ("br", "img", "wbr"):
            held.append(" " if k.tag == "br" else "")
        else:
            if k.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(k.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one whole page, a line for each block; empty if there is none or the page is null."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    top, least = select(root)
    if top is None:
        return ""
    thin(top, least)
    return "\n".join(blocks(top))


FIELDS = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])


def extract_text(pages: DataFrame, col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of the html column.

    Null and empty pages give an empty text; pages of any length and nesting are read whole, without recursion.
    Rows are independent, so repeated rows agree and an empty table gives an empty one. Columns named text or n_chars
    (in any case) are replaced.
    """

    def make():
        def run(pages):
            texts = [main_text(p) for p in pages]
            return texts, [len(t) for t in texts]

        return run

    return map_column(pages, col, FIELDS, make).drop(col if col.lower() not in ("text", "n_chars") else "")
