"""Main text of web pages by tree scoring.

A page becomes a tree in which every paragraph gives points for its length and its commas to
its container, and half as many at each further step up; a container's points are discounted by the
share of its text that is link text. The best container, or the outermost article or main element
around it, is kept whole. On the way from it to the root its siblings are judged: those that are mostly
links go, and so do those that have less than a fifth of the best container's points and are no paragraphs,
no article and, where the best container lies in an article or main element, only hold paragraphs.

Left out first is what never belongs to an article (menus, headers, footers, asides, forms, scripts, styles,
adverts, notices, reader comments), by element, attributes and the words of class, id or role tokens. A token that
has other words too counts if its word is telling anywhere (``comment-list``), or if the others only say where or
what kind of box it is (``ad-slot``); such an element stays if it holds the page's main element, its first heading
or all of its articles (``has-sidebar``). Nothing is left out for being short.

A null or empty page, or one without text, gives the empty string. Attributes are read as browsers do; a quote
that is never closed counts as part of an unquoted value; a tag that never ends is left out. Unclosed elements are
closed as browsers do for paragraphs, list items and table cells; anything still open ends
with the page. A page is worked on by itself in time linear in its length, so memory follows the largest page.
"""

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
LEFT_OUT = frozenset(
    "nav aside footer form script style noscript template head button select textarea iframe object embed svg canvas"
    " dialog menu input label".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: Words in a class, id or role that mark page furniture where they stand alone.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner comment comments disqus respond reply"
    " cookie cookies consent notice notices alert popup modal newsletter subscribe sidebar aside menu nav navbar navigation"
    " breadcrumb breadcrumbs footer header masthead share sharing social related recommended widget toolbar pagination pager"
    " complementary contentinfo search login signup".split()
)
#: Those that mark it beside any other word.
TELLING_WORDS = frozenset(
    "advert adverts advertisement advertising sponsor sponsored promo comment comments disqus cookie cookies newsletter"
    " sidebar navbar breadcrumb breadcrumbs pagination masthead".split()
)
#: Words for places and boxes, beside which any word of furniture marks it.
BOXES = frozenset(
    "area bar block body bottom box button buttons container content desktop fixed global group holder inner item items left"
    " link links list main message mobile module outer overlay page panel popup post posts primary region right row secondary"
    " section site slot stories sticky sub text thread title top unit user wrap wrapper zone articles".split()
)
SITE = frozenset("site page global top main".split())  # beside these "header" is the site's, not the article's
DENYING = frozenset("has with no not without is hide free open closed".split())
CONTENT = frozenset("article content main entry post story text body".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*([^\s>])?)?")
UNQUOTED = re.compile(r"[^\s>]+")
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TELLING = frozenset("class id role hidden aria-hidden style".split())
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SIBLING_SHARE = 0.2
PASSED_ON = 0.5


@dataclass(eq=False, slots=True)
class Node:
    name: str
    parent: "Node | None" = None
    tokens: frozenset = frozenset()
    hidden: bool = False
    within: frozenset = frozenset()
    inside: list = field(default_factory=list)
    out: bool = False
    holds: int = 0
    articles: int = 0
    own: int = 0
    commas: int = 0
    length: int = 0
    linked: int = 0
    points: float = 0.0
    reads: bool = False

    def alone(self) -> bool:
        """Whether a token says nothing but furniture."""
        return any(words <= FURNITURE for words in self.tokens)

    def named(self) -> bool:
        """Whether a token of several words names furniture."""
        return any(_names_furniture(words) for words in self.tokens)

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def _names_furniture(words: frozenset) -> bool:
    if words & DENYING:
        return False
    rest = words - FURNITURE
    if words & TELLING_WORDS:
        return True
    return bool(words & FURNITURE) and rest <= BOXES and (words & FURNITURE != {"header"} or bool(rest & SITE))


def _words(tokens: str) -> frozenset:
    return frozenset(frozenset(w.lower() for w in WORD.findall(x)) for x in tokens.split()) - {frozenset()}


class Reader:
    """Tags of a page, from left to right; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def tag(self, place: int):
        """Of a tag whose name begins at ``place``: its name, telling attributes, whether it closes itself, and its end (None: never)."""
        name = NAME.match(self.page, place)
        place, found, n = name.end(), {}, len(self.page)
        while True:
            at = ATTRIBUTE.match(self.page, place)
            if at is None:
                end = self.page.find(">", place)
                closed = self.page[end - 1 : end] == "/" and end > place
                return name.group().lower(), found, closed, (end + 1 if end >= 0 else None)
            key, place, value = at.group(1).lower(), at.end(), ""
            if at.group(2):
                place -= 1
                value, place = self._value(place)
            elif place >= n:
                return name.group().lower(), found, False, None
            if key in TELLING:
                found.setdefault(key, entities.unescape(value))

    def _value(self, place: int) -> tuple[str, int]:
        quote = self.page[place]
        if quote in "\"'" and quote not in self.unclosed:
            end = self.page.find(quote, place + 1)
            if end >= 0:
                return self.page[place + 1 : end], end + 1
            self.unclosed.add(quote)  # none follows, wherever one looks from
        value = UNQUOTED.match(self.page, place)
        return value.group(), value.end()

    def parts(self):
        """Texts, and (name, attributes, closing, closes itself) of tags; what stands in raw elements is passed over."""
        page, place, text, n = self.page, 0, 0, len(self.page)
        while True:
            place = page.find("<", place)
            if place < 0:
                break
            closing = page.startswith("</", place)
            first = page[place + 1 + closing : place + 2 + closing]
            if not (first.isascii() and first.isalpha()) and not (first in ("!", "?") or closing) or not first:
                place += 1
                continue
            if place > text:
                yield page[text:place]
            if first.isascii() and first.isalpha():
                name, found, closed, end = self.tag(place + 1 + closing)
                if end is None:
                    text = n
                    break
                yield name, found, closing, closed
                if name in RAW and not closing:
                    after = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, end)
                    end = after.start() if after else n
            elif page.startswith("<!--", place):
                short = next((x for x in ("<!-->", "<!--->") if page.startswith(x, place)), None)
                end = place + len(short) if short else page.find("-->", place + 4) + 3
                end = end if short or end > 2 else n
            else:
                end = page.find(">", place) + 1 or n
            place = text = end
        if text < n:
            yield page[text:]


def parse(page: str) -> list[Node]:
    """Elements of a page in page order, the root first."""
    root = Node("html")
    nodes, path, depths = [root], [root], {}

    def shut(depth):
        while len(path) > depth:
            depths[path.pop().name].pop()

    def deepest(names):
        return max((depths[x][-1] for x in names if depths.get(x)), default=0)

    for part in Reader(page).parts():
        if isinstance(part, str):
            path[-1].inside.append(part)
            continue
        name, found, closing, closed = part
        if name in ("html", "body"):
            continue
        if closing:
            if depths.get(name):
                shut(depths[name][-1])
            continue
        if name in CLOSES_P and deepest(("p",)) > deepest(("table", "td", "th", "button")):
            shut(deepest(("p",)))
        if name in CLOSES:
            names, stop = CLOSES[name]
            if deepest(names.split()) > deepest(stop):
                shut(max(deepest(stop) + 1, min(depths[x][-1] for x in names.split() if depths.get(x) and depths[x][-1] > deepest(stop))))
        at = path[-1]
        tokens = _words(" ".join(found.get(x, "") for x in ("class", "id", "role"))) if found else frozenset()
        hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(UNSHOWN.search(found.get("style", "")))
        within = at.within | {at.name} if at.name in ("article", "main") else at.within
        node = Node(name, at, tokens, hidden, within)
        at.inside.append(node)
        nodes.append(node)
        if name not in VOID and name not in RAW and not closed:
            depths.setdefault(name, []).append(len(path))
            path.append(node)
    return nodes


def leave_out(nodes: list[Node]) -> list[Node]:
    """Marks page furniture; returns the other nodes in page order."""
    for node in nodes:
        node.articles = int(node.name == "article" and not node.alone() and not node.named())
        node.holds = int(node.name in ("main", "h1"))
    for node in reversed(nodes[1:]):
        node.parent.articles += node.articles
        node.parent.holds += node.holds
    every, kept = nodes[0].articles, [nodes[0]]
    for node in nodes[1:]:
        node.out = node.parent.out or node.hidden or node.name in LEFT_OUT or _furniture(node, every)
        if not node.out:
            kept.append(node)
    return kept


def _furniture(node: Node, every: int) -> bool:
    if node.name == "header":
        return not node.within
    if node.name == "main" or not node.tokens:
        return False
    if node.name == "article":
        return ("article" in node.within or every > 0) and (node.alone() or node.named()) and not node.articles
    if node.alone():
        return True
    return node.named() and not node.holds and not (every and node.articles == every)


def score(order: list[Node]) -> list[Node]:
    """Gives every container among the nodes in page order its points and lengths."""
    for node in order:
        text = "".join(x for x in node.inside if isinstance(x, str))
        node.own, node.commas = len(text.strip()), text.count(",")
    passed = {}
    for node in reversed(order):
        node.length += node.own
        if node.name == "a":
            node.linked = node.length
        points = 0.0
        if node.length and (node.name in PARAGRAPHS or (node.name in BLOCKS and node.own)):
            points = (1 + node.commas + min(node.length / 100, 3)) * (1 - node.linked / node.length)
            node.reads = node.reads or (node.name in PARAGRAPHS and points > 0)
        held = passed.get(id(node), 0.0)
        up = node.parent
        if up is not None:
            up.length += node.length
            up.linked += node.linked
            up.reads = up.reads or node.reads
            if node.name not in BLOCKS:
                up.commas += node.commas
            passed[id(up)] = passed.get(id(up), 0.0) + points + PASSED_ON * held
        node.points = held + (points if node.name not in PARAGRAPHS else 0.0)
        if node.points:
            if node.name in ("article", "main") or any(words & CONTENT for words in node.tokens):
                node.points += 25
            node.points *= 1 - node.linked / max(node.length, 1)
    return order


def article_of(nodes: list[Node]) -> tuple[Node, set[int]]:
    """The root, and which elements beside the best container's way to it do not belong to the article."""
    order = score(leave_out(nodes))
    best = max(order, key=lambda n: n.points)
    if best.points <= 0:
        return nodes[0], set()
    marked = [n for n in (best, *best.ancestors()) if n.name in ("article", "main")]
    top = marked[-1] if marked else best
    left_out, at = set(), top
    while at.parent is not None:
        for x in at.parent.inside:
            if isinstance(x, Node) and x is not at and not x.out and not _belongs(x, best, bool(marked)):
                left_out.add(id(x))
        at = at.parent
    return nodes[0], left_out


def _belongs(beside: Node, best: Node, marked: bool) -> bool:
    """Whether an element beside the article is part of it."""
    if beside.linked * 2 > beside.length:
        return False
    if beside.name not in BLOCKS or beside.name in PARAGRAPHS or beside.articles or beside.name == "main":
        return True
    return beside.points >= SIBLING_SHARE * best.points or (beside.reads and not marked)


def blocks(kept: Node, left_out: set[int]) -> list[str]:
    """Texts between block boundaries, references decoded, white space made one space."""
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack = [(kept, False)]
    while stack:
        x, leave = stack.pop()
        if isinstance(x, str):
            line.append(entities.unescape(x))
            continue
        if leave:
            flush()
            continue
        if x.out or id(x) in left_out:
            continue
        if x.name == "br":
            line.append(" ")
        if x.name in BLOCKS or x is kept:
            flush()
            stack.append((x, True))
        stack.extend((y, False) for y in reversed(x.inside))
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(*article_of(parse(page)))) if page else ""


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page its main text and the number of its code points."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
