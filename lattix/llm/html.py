"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements. Every paragraph (a block with text of its own) earns points for its length and
commas; all of them go to its container, half to the container above, and smaller parts further up. A container's score
is discounted by its link density. The best container is kept together with those of its siblings that score well enough
or are plain paragraphs with few links; menus, forms, adverts, notices, comments of readers and other furniture are
taken out by tag, role and class words before and inside the container. Class words that may also name a part of an article
(``discussion``, ``promotion``, ``alert`` and the like) count inside it only with a second sign: a form, links, other
furniture within, or no text that reads like a part.

How it scales: pages are independent; one pass, no shuffle, Arrow batches. The tree of one page is all that is held. Work
grows with a page's length, whatever its markup: no pattern tries a place twice, elements nested deeper than ``DEPTH`` become
siblings (as in browsers; their text stays), and sums go up the tree once.

Results for odd inputs: a null or empty page, or one without text, gives the empty string; broken markup is repaired
as browsers do where it matters here (unclosed paragraphs, stray end tags, cut files); pages of any length are read
whole; repeated pages are rows of their own; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small

#: Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph, and for list and table parts what they end.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that never belong to the text.
DROPPED = frozenset("head script style template iframe object embed svg audio video form button input select textarea nav aside footer menu dialog search title noembed noframes datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog status".split())
#: Words in class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and readers' comments.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|breadcrumbs?|pager|pagination|toolbar|skip-?link|masthead|site-?header|page-?header|footer|sidebar|side-?bar|"
    r"cookies?|consent|gdpr|notice|popup|modal|ads?|adbox|advert\w*|adsense|newsletter|subscribe|signup|login|"
    r"comments?|comment-?list|disqus|repl(?:y|ies)|reader-?comments?|visually-hidden|sr-only)(?:$|[\s_-])", re.I
)
#: Words that mark the same, but may also name a part of an article (a section "Discussion", a promoted captain).
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:widget\w*|banner|overlay|alert|sponsor\w*|promo\w*|discuss\w*|respond)(?:$|[\s_-])", re.I)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|entry|post)-?(?:body|content|text)(?:$|[\s_-])", re.I)
#: Elements that are parts of running text by themselves; others need a heading and a paragraph.
_RUNNING = frozenset("section p pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 li dd td table".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article, a part with a doubtful word goes if more of its characters than this are in links.
LINKS = 0.1
_CONTENT = re.compile(r"article|body|content|entry|main|post|story|text|prose|blog", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A tag ends at > outside quotes; one that meets another < before it is broken, and ends there.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_COMMAS = re.compile("[,،、，;；]")
#: A paragraph needs this many characters to earn points.
LEAST = 25
#: Elements nested deeper become siblings.
DEPTH = 512


class Node:
    __slots__ = ("tag", "parent", "items", "attributes", "score", "chars", "linked", "depth", "out", "running")

    def __init__(self, tag: str, parent: Node | None, attributes: dict):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.items: list = []  # nodes and strings, in order
        self.score, self.chars, self.linked = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.out: bool | None = None
        self.running = False  # a part of an article's running text, see ``parts``

    def names(self) -> str:
        return f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"

    def furniture(self) -> bool:
        if self.out is None:
            self.out = self._furniture()
        return self.out

    def _furniture(self) -> bool:
        if self.tag in DROPPED:
            return True
        a = self.attributes
        if not a:
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES or _HIDDEN.search(a.get("style", "")):
            return True
        names = self.names()
        if self.tag in ("body", "html", "article", "main") or self.tag != "section" and _ARTICLE.search(names):
            return False
        return bool(_FURNITURE.search(names)) or bool(_DOUBTFUL.search(names)) and not self.running


def parts(nodes: list[Node]) -> None:
    """Mark which nodes with a doubtful word are running text: inside an article, without a form and with few links, and
    either such an element by itself or with a heading and a paragraph of its own. Two passes over the nodes."""
    inside, facts = {}, {}
    for node in nodes:
        inside[id(node)] = node.parent is not None and (inside[id(node.parent)] or node.parent.tag in ("article", "main") or bool(_ARTICLE.search(node.parent.names())))
    for node in reversed(nodes):  # children before their parents
        chars = linked = 0
        form, heading, paragraph = node.tag in ("form", "input", "button", "textarea"), node.tag in _HEADINGS, False
        comments = bool(node.attributes) and bool(_FURNITURE.search(node.names()))
        for item in node.items:
            if isinstance(item, str):
                chars += len(item.strip())
            elif id(item) in facts:
                one = facts.pop(id(item))
                chars, linked, form, heading, paragraph, comments = chars + one[0], linked + one[1], form or one[2], heading or one[3], paragraph or one[4], comments or one[5]
        paragraph = paragraph or node.tag == "p" and chars >= LEAST
        facts[id(node)] = chars, chars if node.tag == "a" else linked, form, heading, paragraph, comments
        sound = inside[id(node)] and not form and not comments and linked <= LINKS * chars
        node.running = sound and (node.tag in _RUNNING or heading and paragraph)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree, and its nodes in page order."""
    root = Node("html", None, {})
    nodes = [root]
    at, last = root, 0
    deep: list[str] = []  # tags that are open beyond DEPTH
    opened: Counter = Counter()  # open elements by tag
    ends: dict[str, re.Pattern] = {}

    def closed(upto: Node) -> Node:
        """Leave the open elements below ``upto``."""
        here = at
        while here is not upto:
            opened[here.tag] -= 1
            here = here.parent
        deep.clear()
        return upto

    for m in _TOKEN.finditer(page):
        if m.start() < last:
            continue
        if m.start() > last:
            at.items.append(page[last : m.start()])
        last, token = m.end(), m.group()
        named = _NAME.match(token)
        if named is None:
            continue
        tag = named[1].lower()
        if token[1] == "/":
            if tag in deep[-DEPTH:]:
                while deep.pop() != tag:
                    pass
                continue
            up = at if opened[tag] else None
            while up is not None and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = None  # an inline end tag doesn't close blocks
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                at = closed(up.parent)
            elif tag == "br":
                at.items.append(Node("br", at, {}))
            continue
        if tag in ("html", "body") and at is root:
            at.attributes |= {} if tag == "html" else {}
            continue
        attributes = {}
        if len(token) > len(tag) + 2:
            attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(token[len(tag) + 1 :].rstrip(">"))}
        if tag in BLOCK:
            up = at
            while up is not None and up.tag not in BLOCK:
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                at = closed(up.parent)  # a block ends an open paragraph
        if tag in _ENDS:
            up = at
            while up is not None and up.tag not in _SCOPE[tag]:
                if up.tag in _ENDS[tag] and up.parent is not None:
                    at = closed(up.parent)
                up = up.parent
        node = Node(tag, at, attributes)
        nodes.append(node)
        at.items.append(node)
        if tag in RAW and not token.endswith("/>"):
            if tag not in ends:
                ends[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.I)
            end = ends[tag].search(page, last)
            last = len(page) if end is None else end.start()
            close = page.find(">", last)
            last = len(page) if end is None or close < 0 else close + 1
        elif tag not in VOID and not (token.endswith("/>") and tag not in BLOCK):
            if node.depth < DEPTH:
                at = node
                opened[tag] += 1
            else:
                deep.append(tag)
    if last < len(page):
        at.items.append(page[last:])
    if any(n.attributes and _DOUBTFUL.search(n.names()) for n in nodes):
        parts(nodes)
    return root, nodes


def blocks(node: Node, wanted=None) -> Iterator[tuple[Node, str, int]]:
    """(container, text, characters inside links) of each block with text below a node, in page order."""
    held: list[str] = []
    linked = 0
    stack: list = [(node, iter(node.items), False)]
    owner = node

    def text() -> str:
        return " ".join(html.unescape("".join(held)).split())

    while stack:
        here, items, in_link = stack[-1]
        for item in items:
            if isinstance(item, str):
                held.append(item)
                if in_link:
                    linked += len(item.strip())
            elif item.tag == "br":
                held.append(" ")
            elif item.furniture() or (wanted is not None and not wanted(here, item)):
                if item.tag in BLOCK or item.tag in ("form",):
                    if found := text():
                        yield owner, found, linked
                    held, linked = [], 0
            else:
                if item.tag in BLOCK:
                    if found := text():
                        yield owner, found, linked
                    held, linked = [], 0
                    owner = item
                stack.append((item, iter(item.items), in_link or item.tag == "a"))
                break
        else:
            stack.pop()
            if here.tag in BLOCK or not stack:
                if found := text():
                    yield owner, found, linked
                held, linked = [], 0
                owner = next((n for n, *_ in reversed(stack) if n.tag in BLOCK), node)


def _points(text: str) -> float:
    return 1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3) if len(text) >= LEAST else 0.0


def score(root: Node, nodes: list[Node]) -> list[Node]:
    """Pass every paragraph's points up; the containers that got some, in page order."""
    seen: dict[int, Node] = {}
    for owner, text, linked in blocks(root):
        points = _points(text)
        owner.chars += len(text)
        owner.linked += min(linked, len(text))
        if not points:
            continue
        holder = owner.parent if owner.parent is not None and owner.tag in ("p", "pre", "blockquote", "li", "dd", "td") else owner
        level = 0
        while holder is not None and level < 6:
            if id(holder) not in seen:
                seen[id(holder)] = holder
                holder.score += (10 if holder.tag in ("article", "main") else 0) + (10 if _CONTENT.search(holder.names()) else 0)
            holder.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            holder, level = holder.parent, level + 1
    for node in reversed(nodes):  # children before their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for holder in seen.values():
        holder.score *= 1 - holder.linked / max(1, holder.chars)
    return list(seen.values())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page)
    holders = score(root, nodes)
    if not holders:
        # no paragraph is long enough to earn points: what an article or main element holds, else all that is no furniture
        stack, best = [root], root
        while stack:
            node = stack.pop()
            if node.tag in ("article", "main") and not node.furniture() and best is root and node.chars:
                best = node
            stack += [n for n in reversed(node.items) if isinstance(n, Node)]
        return "\n".join(t for _, t, _ in blocks(best))
    best = max(holders, key=lambda n: n.score)
    # an article or main element around the best container is the container
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main") and not up.furniture():
            best = up
        up = up.parent
    parent, bar = best.parent, max(10.0, 0.2 * best.score)
    if parent is None or best.tag in ("article", "main") and not any(isinstance(n, Node) and n is not best and n.tag in ("article", "section", "div") and n.score >= bar for n in parent.items):
        return "\n".join(t for _, t, _ in blocks(best))

    def wanted(here: Node, item: Node) -> bool:
        if here is not parent or item is best:
            return True
        density = item.linked / max(1, item.chars)
        if item.score >= bar and density < 0.5:
            return True
        return item.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and item.chars > 0 and density < 0.25

    return "\n".join(t for _, t, _ in blocks(parent, wanted))


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in small(batches):
        pages = batch.column(2)
        texts = [main_text(pages[i].as_py()) for i in range(len(pages))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
