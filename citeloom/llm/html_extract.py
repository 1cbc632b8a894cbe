"""Main text of HTML pages by composite text density.

Follows Sun, Song and Liao, "DOM based content extraction via text density" (SIGIR 2011): every node gets a composite
density of characters per tag, lowered by the share of link characters; the sum of its children's densities ranks
subtrees; the least density on the path from ``body`` to the best subtree is the threshold for what joins it. Within an
``article`` or ``main`` around the best subtree only link lists have to pass it, and the rest of it stays.
Elements that hold no article by their kind (menus, forms, adverts, ...) are left out of the tree before that; a form
stays if it holds an article, or the only paragraphs of a page. Names in
classes and ids leave out no headings and paragraphs, and within an article only containers; whole names of menus,
adverts, notices, sign-ups, sharing and comments do. Ambiguous names (search, related, ...) leave nothing out by
themselves: what has one doesn't join the best subtree, and stays in it if it is as dense as the threshold, within an
article too. A ``header`` within an article stays if it holds a heading, which is the article's title.

Time grows with the length of a page, however it is nested or broken off: open elements are found by their names, and
the quotes of a page are paired once.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import map_texts

# HTML's void, raw-text and block elements, and the kinds that aren't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
SKIP = RAW | frozenset("head nav aside form footer select option datalist menu svg math canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SCOPE = frozenset("article body html table td th tr caption div section main li ul ol dl dd dt blockquote header footer nav aside form".split())
CLOSES_P = BLOCK - {"tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "caption", "option", "optgroup", "legend"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Left out outside of an article only: in one they hold its title or the titles of its folded parts.
OUTSIDE = frozenset("header button dialog".split())
#: What a class or id never leaves out: headings and single paragraphs, and the article itself.
KEPT = frozenset("body html article main h1 h2 h3 h4 h5 h6 p".split())
#: What a class or id can leave out within an article.
CONTAINERS = frozenset("div section ul ol dl table center details fieldset ins".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that may name what isn't article text, as parts of a name and outside of an article only.
PART = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|adbox|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disqus|feedback|footer|footnav|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|pager|pagination|popup|promo|promotion|recommended|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|tags|toolbar|topbar|widget|widgets)(?:$|[\s_\d-])",
    re.I,
)
#: Names of menus, adverts, notices, sign-ups, sharing and comments; the whole name must fit.
WHOLE = re.compile(
    r"(?:ads?|adv|adverts?|advertisements?|adbox|adsense|sponsored|navbar|nav|menu|breadcrumbs?|footnav|pager|pagination|sidebar|comments?|commentlist)(?:[_-](?:area|banner|bar|block|bottom|box|container|footer|inline|left|list|main|right|section|slot|top|unit|wrap|wrapper|\d+))*"
    r"|(?:comment|disqus)[_-](?:area|form|list|section|thread)|(?:cookies?|gdpr|consent)[_-](?:banner|bar|box|consent|message|notice|overlay|popup)"
    r"|(?:site[_-]?)?notices?(?:[_-](?:bar|box))?|(?:newsletter|subscribe|subscription)(?:[_-](?:bar|block|box|form|signup|sign-up|widget))?|sign-?up(?:[_-](?:box|form))?"
    r"|(?:social[_-])?(?:share|sharing)(?:[_-](?:bar|box|buttons?|icons?|links?|tools?|widget))?|social[_-](?:bar|buttons?|icons?|links?|media)|(?:related|recommended)[_-](?:articles?|links?|posts?|stories)",
    re.I,
)
#: Ids of sections of reader comments; other ids of a section are places of its heading.
THREAD = re.compile(r"comments|comments?[_-](?:area|form|list|section|thread)|commentlist|disqus[_-]thread", re.I)

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


_START = re.compile(r"<(?P<close>/?)[A-Za-z]")
_NAME_END = re.compile(r"[\s/>]|\Z")


class _Ends:
    """Where a page's tags end, if the quotes in them are paired from their start on: made once, asked by position."""

    def __init__(self, page: str):
        marks = [(m.start(), m[0]) for m in re.finditer("[\"'>]", page)]
        self.at, self.page, self.name = [p for p, _ in marks], page, -1
        self.end: list[int | None] = [None] * (len(marks) + 1)
        later = {}
        for i in range(len(marks) - 1, -1, -1):
            place, mark = marks[i]
            if mark == ">":
                self.end[i] = place
            elif mark in later:
                self.end[i] = self.end[later[mark] + 1]
            later[mark] = i

    def of(self, pos: int) -> tuple[int, int | None]:
        """Where the name that starts at ``pos`` ends, and where its tag does. Positions are asked in order."""
        if self.name < pos:
            self.name = _NAME_END.search(self.page, pos).start()
        return self.name, self.end[bisect_left(self.at, self.name)]


class _Stack:
    """The open elements, with the places of every name, those that bound others, and forms that are left out so far."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.bounds, self.articles, self.forms = [root], defaultdict(list), [], 0, []

    def push(self, node: Node) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.places[node.tag].append(place)
        if node.tag in SCOPE:
            self.bounds.append(place)
        if node.tag in ("article", "main"):
            self.articles += 1
        elif node.tag == "form":
            self.forms.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.bounds.pop()
            if node.tag in ("article", "main"):
                self.articles -= 1
            elif self.forms and self.forms[-1] is node:
                self.forms.pop()

    def last(self, tags) -> int:
        """The place of the innermost element of these names, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def bound(self) -> int:
        return self.bounds[-1] if self.bounds else 0

    def free_forms(self) -> None:
        for node in self.forms:
            node.skip = False
        self.forms.clear()


class Node:
    __slots__ = ("tag", "parent", "items", "skip", "maybe", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool, maybe: bool = False):
        self.tag, self.parent, self.items, self.skip, self.maybe = tag, parent, [], skip, maybe
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> Iterator[Node]:
        return (x for x in self.items if not isinstance(x, str))


def _left_out(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element goes, and whether it may go by an ambiguous name, which its density decides."""
    if tag in SKIP or (tag in OUTSIDE and not inside_article) or tag == "header":
        return True, False  # a header within an article comes back with a heading in it
    if tag in ("body", "html", "article", "main") or not attrs.strip():
        return tag == "dialog", False
    maybe, opened = False, tag != "dialog"
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or "")
        opened = opened or name == "open"
        if name == "role" and value.strip().lower() in ROLES:
            return True, False
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if name not in ("class", "id") or tag in KEPT:
            continue
        whole = THREAD if name == "id" and tag == "section" else WHOLE
        named = tag in CONTAINERS or not inside_article
        if named and any(whole.fullmatch(x) for x in value.split()):
            return True, False
        maybe = maybe or named and whole is WHOLE and bool(PART.search(value))
    return not opened, maybe


def parse(page: str, forms: bool = False) -> Node:
    """A forgiving tree: unclosed and misnested elements end where HTML ends them, stray end tags are ignored.

    Forms are left out unless one holds an ``article`` or ``main``, or ``forms`` is set.
    """
    root = Node("#root", None, False)
    stack, pos, size, ends = _Stack(root), 0, len(page), None
    while pos < size:
        if ends is None:
            m = _PART.match(page, pos)
            close, tag, attrs, stop = m["close"], m["tag"], m["attrs"], m.end()
            if tag is None and _START.match(page, pos):  # a tag that doesn't end, from here on ends are looked up
                ends = _Ends(page)
        elif m := _START.match(page, pos):
            close, (name, end) = m["close"], ends.of(m.end() - 1)
            if end is not None:
                tag, attrs, stop = page[m.end() - 1 : name], page[name:end], end + 1
            else:
                tag, stop = None, (page.find(">", pos) + 1 or size) if close else pos + 1
        else:
            m = _PART.match(page, pos)
            tag, stop = None, m.end()
        begin, pos = pos, stop
        if tag is None:
            if page[begin] != "<" or pos - begin == 1:
                stack.nodes[-1].items.append(page[begin:pos])
            continue
        tag = tag.lower()
        if close:
            place = stack.last((tag,))
            if place and (tag in BLOCK or stack.bound() <= place):
                stack.cut(place)
            continue
        if tag in CLOSES_P and (place := stack.last(("p",))) > stack.bound():
            stack.cut(place)
        if tag in CLOSES:
            inner, outer = CLOSES[tag]
            while (place := stack.last(inner)) > stack.last(outer):
                stack.cut(place)
                if tag != "tr":
                    break
        node = Node(tag, stack.nodes[-1], *_left_out(tag, attrs, stack.articles > 0))
        stack.nodes[-1].items.append(node)
        if tag in HEADINGS and stack.articles and (place := stack.last(("header",))):
            header = stack.nodes[place]
            header.skip = header.skip and place < stack.last(("article", "main"))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag == "form" and forms:
            node.skip = False
        elif tag in ("article", "main"):
            stack.free_forms()
        stack.push(node)
    return root


def _measure(root: Node) -> list[Node]:
    """Characters, tags and link shares of every node, children first; densities afterwards."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children() if not c.skip)
    for node in reversed(order):
        link = node.tag == "a"
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(html_lib.unescape(x).split()))
            elif not x.skip:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if link:
            node.link_chars = node.chars
    return order


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """C/T times log of (C/LC * T/LT) to a base that rises with the link share; counts of 0 count as 1."""
    if not chars:
        return 0.0
    tags, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    rest = max(chars - link_chars, 1)
    base = math.log(chars / rest * lc + body_links / max(body_chars, 1) * chars + math.e)
    value = math.log(max(chars / lc * tags / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9))
    return chars / tags * value


def _link_list(node: Node) -> bool:
    """Two links or more that hold at least half of the characters."""
    return node.link_tags > 1 and 2 * node.link_chars >= node.chars


def _blocks(nodes: list[Node]) -> list[str]:
    out, piece = [], []

    def flush() -> None:
        if text := " ".join(html_lib.unescape("".join(piece)).split()):
            out.append(text)
        piece.clear()

    for node in nodes:
        todo: list = [node]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                piece.append(x)
            elif x.tag == "br" or x.tag in VOID:
                piece.append(" " if x.tag in ("br", "hr") else "")
            elif not x.skip:
                block = x.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.items))
        flush()
    return out


def extract_text(page: str | None) -> str:
    """The main text of one page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars and "<form" in page.lower():
        # a form around the whole page, which has paragraphs; others have fields only
        order = _measure(parse(page, forms=True))
        body = next((n for n in order if n.tag == "body"), order[0])
        if not any(n.tag == "p" and n.chars for n in order):
            return ""
    for n in order:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, body.chars, body.link_chars)
    for n in order:
        n.total = sum(c.density for c in n.children() if not c.skip)
    inside = []
    todo = [body]
    while todo:
        n = todo.pop()
        inside.append(n)
        todo.extend(c for c in n.children() if not c.skip)
    if not body.chars:
        return ""
    best = max(inside, key=lambda n: n.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    # an article or main around the best subtree loses the link lists beside the path that are below the threshold
    core = next((n for n in reversed(path) if n.tag in ("article", "main")), best)
    on_path = {id(n) for n in path}
    within = {id(n) for n in path[1 : path.index(core) + 1]}
    # of the rest, what has an ambiguous name stays if it is as dense as the threshold
    todo = [core]
    while todo:
        node = todo.pop()
        for c in node.children():
            beside = id(node) in within and id(c) not in on_path
            c.skip = c.skip or (c.density < least and (c.maybe or beside and _link_list(c)))
            if not c.skip:
                todo.append(c)
    # siblings along the path that are as dense as the threshold join it, in page order; a marked article ends there
    path = path if core is best and best.tag not in ("article", "main") else [core]
    ahead: list[Node] = []
    behind: list[list[Node]] = []
    for node, below in zip(reversed(path), reversed(path[:-1]), strict=False):
        passed, after = False, []
        behind.append(after)
        for c in node.children():
            if c is below:
                passed = True
            elif not c.skip and not c.maybe and c.chars and c.density >= least:
                (after if passed else ahead).append(c)
    chosen = [body] if best.total <= 0 else [*ahead, core, *(n for after in reversed(behind) for n in after)]
    return "\n".join(_blocks(chosen))


def extract_pages(df: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Add the main text of every page and its length in code points; rows are mapped one by one, nothing is shuffled.

    Null and empty pages give an empty text, repeated rows equal texts, an empty table none. Pages of any length are read
    whole, in time that grows with the length; they pass to the workers in parts of a bounded number of bytes
    (``map_texts``), a very long page alone. Existing columns of the two names are replaced, others stay.
    """

    def start():
        return lambda pages: [pa.array([extract_text(p) for p in pages], pa.string())]

    out = map_texts(df, html, f"`{text}` string", start, [c for c in df.columns if c not in (text, n_chars)])
    return out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast("long"))
