"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import sliced

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is never text of the page.
_HIDDEN = frozenset("head script style noscript template iframe object svg math canvas video audio form button select textarea input option datalist dialog nav header footer aside menu".split())
#: Elements whose content is not markup up to their own end tag.
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A new one of the first ends an open one of the second, unless a bound lies between.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
#: Block elements end an open paragraph.
_ENDS_P = _BLOCK - frozenset("body html caption dd dt li summary tbody td tfoot th thead tr figcaption".split()) | {"p"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Around all of a page.
_TOP = frozenset(("body", "html", "#root"))

#: Names that sites give to what isn't the article: whole words of class and id values, and roles.
_NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|newsletter|subscri\w*|signup|sidebar|side|rail|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager"
    r"|header|masthead|footer|copyright|comments?|commentlist|disqus|respond|replies|reply|discussion|related|recommend\w*|share|sharing|social|popup|modal|overlay|toolbar|skip|login|search)(?:$|[\s_-])",
    re.I,
)
#: Names of the state of a page's layout; they don't say what the element itself is.
_MODIFIER = re.compile(r"(?:^|\s)(?:has|with|without|no|is|show|hide)[_-]\S*", re.I)
#: Words of _NOT_ARTICLE that also head parts of articles, unless they are the whole name or have such an ending.
_EITHER = re.compile(
    r"(?:^|\s)(?!(?:notice|alert|related|share|sharing|social|recommend\w*)(?:[_-](?:posts?|articles?|links?|stories|box|bar|buttons?|icons?|list|news|items?|widget|message|success|info|warning|danger|error))?(?:\s|$))"
    r"\S*?(?:notice|alert|side|rail|header|discussion|related|search|share|sharing|social|respond|replies|reply|overlay|skip|copyright|recommend\w*)(?=$|[\s_-])\S*",
    re.I,
)
#: Words for ways through a site: whether an element of such a name is one, its links say.
_WAYS = re.compile(r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|rail|side)(?=$|[\s_-])", re.I)
#: Names of what readers write below an article.
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?:$|[\s_-])", re.I)
#: Names that say the opposite, whatever else is said beside them.
_ARTICLE = re.compile(r"(?:^|\s)(?:article|post|entry|story|content|main)(?:[_-](?:body|content|text|main))?(?:$|\s)", re.I)
#: Text outside links, in characters, that may be an article by itself.
_ENOUGH = 200
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: End tags of other elements don't reach beyond these; those of the second do.
_FENCES, _OVER_FENCES = frozenset(("td", "th", "table")), frozenset("table tr tbody thead tfoot body html article main".split())


#: How sure it is that an element isn't of the article; WAY: it is called a way through the site; HEADER: a header element, which is one of an article if it
#: holds its title.
PERHAPS, WAY, NAMED, HEADER, SURE = 1, 2, 3, 4, 5


class Node:
    __slots__ = ("name", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "sum", "skip", "doubt")

    def __init__(self, name: str, parent: Node | None, skip: int):
        # a doubt is settled by what the element holds, when the page has been read
        self.name, self.parent, self.skip, self.doubt = name, parent, skip > 0, skip if skip < SURE else 0
        self.children: list[Node | str] = []


def _skipped(name: str, attributes: str) -> int:
    """Whether an element is left out: SURE, HEADER, NAMED if its class or id says so, PERHAPS if these may name a part of an article too, or 0."""
    if name == "header":
        return HEADER
    if name in _HIDDEN and name != "form":
        return SURE
    found = NAMED if name == "form" else 0
    if not attributes or attributes.isspace() or name in ("html", "body", "article", "main"):
        return found
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            value = _MODIFIER.sub(" ", value)
            if _NOT_ARTICLE.search(value):
                left = _EITHER.sub(" ", value)
                sure = _NOT_ARTICLE.search(left) and not _ARTICLE.search(value)
                named = NAMED if _NOT_ARTICLE.search(_WAYS.sub(" ", left)) else WAY
                # a section's own name, by which it is linked, may be any heading
                heading = key == "id" and name == "section" and not _READERS.search(value)
                found = max(found, named if sure and not heading else NAMED if key == "id" and _READERS.search(value) else PERHAPS)
        if key == "role" and value.strip().lower() in _ROLES:
            found = NAMED if value.strip().lower() == "form" else SURE
            if found == SURE:
                return SURE
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
    return found


def settle(root: Node) -> None:
    """Keep elements left out by their names alone that can't be beside the article.

    These hold all article and main elements of the page. Where it has none: if there is an article's text outside all of them,
    only those that hold an h1 element (and none is outside); else those with most of the text outside links, readers' comments
    last. Inside an article or main element, those of a name in doubt stay that hold a paragraph and more than links, and
    a header that holds a heading. Those that are called ways through the site stay anywhere, if they hold a paragraph and links are the lesser part of their text.
    """
    nodes, stack = [], [(root, False, False)]
    while stack:
        node, within, doubted = stack.pop()
        nodes.append((node, within, doubted))
        under = within or node.name in ("article", "main")
        stack.extend((c, under, doubted or c.doubt > 0) for c in node.children if not isinstance(c, str) and (not c.skip or c.doubt))
    if not any(node.doubt for node, _, _ in nodes):
        return
    own: dict[Node, tuple[int, int, int, int, int, bool]] = {}
    outside = heads_outside = 0
    for node, _, doubted in reversed(nodes):
        text, links, articles, titles, heads, paragraphs = 0, 0, 0, int(node.name == "h1"), int(node.name in _HEADINGS), node.name == "p"
        direct = sum(len(c) - sum(map(c.count, " \n\t\r")) for c in node.children if isinstance(c, str))
        text += direct
        for child in node.children:
            if not isinstance(child, str) and child in own:
                t, n, a, h1, h, p = own[child]
                text, links, articles, titles, heads, paragraphs = text + t, links + n, articles + a, titles + h1, heads + h, paragraphs or p
        if node.name == "a":
            text, links = 0, text + links
        if not doubted:
            heads_outside += node.name == "h1"
            outside += direct if node.name != "a" and not any(x.name == "a" for x in _above(node)) else 0
        own[node] = text, links, articles + (node.name in ("article", "main") and text > 0), titles, heads, paragraphs
    whole, _, all_articles, *_ = own[root]
    for node, within, _ in nodes:
        text, links, articles, titles, heads, paragraphs = own[node]
        if not node.doubt:
            continue
        if node.doubt == WAY and paragraphs and text > 2 * links:
            node.skip = False
        elif within:
            node.skip = not (heads > 0 if node.doubt == HEADER else node.doubt == PERHAPS and paragraphs and text > links)
        elif all_articles:
            node.skip = articles < all_articles
        elif outside >= _ENOUGH:
            node.skip = not (titles and not heads_outside and text > links)
        else:
            node.skip = node.doubt == HEADER or not (titles or text * 2 > whole)


def _above(node: Node) -> Iterator[Node]:
    """The closest elements around a node; links don't lie deeper than these."""
    for _ in range(4):
        node = node.parent
        if node is None:
            return
        yield node


def parse(source: str) -> Node:
    """A lenient tree of a page: end tags may be missing, and unknown or wrong ones are passed over."""
    root = Node("#root", None, 0)
    node, at, end, lower = root, 0, len(source), None
    path, open_, fences, blocks = [root], {}, [], []  # open elements, where those of a name stand in the path, and where cells and tables, and blocks

    def leave(depth: int) -> Node:
        """Close all that is open below so many elements of the path."""
        while len(path) > depth:
            gone = path.pop()
            open_[gone.name].pop()
            if gone.name in _FENCES:
                fences.pop()
            if gone.name in _BLOCK and gone.name != "p":
                blocks.pop()
        return path[-1]

    while at < end:
        found = _TAG.search(source, at)
        if found is None:
            node.children.append(source[at:])
            break
        if found.start() > at:
            node.children.append(source[at : found.start()])
        at = found.end()
        name = found[3]
        if name is None:
            if found[1]:
                node.children.append(html.escape(found[1], quote=False))
            continue
        name = name.lower()
        if found[2]:
            depth = open_[name][-1] if open_.get(name) else 0
            fence = next((f for f in reversed(fences[-2:]) if f < len(path) - 1), 0)
            if depth and (name in _OVER_FENCES or depth >= fence):
                node = leave(depth)
            elif name == "br":
                node.children.append(Node("br", node, 0))
            continue
        if name in _ENDS_P or name in _ENDS:
            ends = _ENDS.get(name, ())
            # an open paragraph or item of the same kind, with nothing but paragraphs and inline elements below it; rows end cells too
            wanted = (*ends, "p") if name in _ENDS_P else ends
            depth = max((open_[w][-1] for w in wanted if open_.get(w)), default=0)
            k = len(blocks) - 1
            while k >= 0 and blocks[k] > depth and path[blocks[k]].name in ("td", "th", "tr") and name in ("tr", "tbody", "tfoot", "thead"):
                k -= 1
            if depth and (k < 0 or blocks[k] <= depth):
                node = leave(depth)
                while node.name in wanted:
                    node = leave(len(path) - 1)
        if name == "body" and node.name == "head":
            node = leave(len(path) - 1)
        if node.name == "head" and name in _BLOCK:
            node = leave(len(path) - 1)  # a head without an end
        new = Node(name, node, _skipped(name, found[4]))
        node.children.append(new)
        if name in _VOID or found[4].endswith("/") and name in ("svg", "path", "math"):
            continue
        if name in _RAW:
            if lower is None:
                lower = source.lower()
            stop = lower.find(f"</{name}", at)
            new.children.append(source[at : stop if stop >= 0 else end])
            at = end if stop < 0 else (close + 1 if (close := source.find(">", stop)) >= 0 else end)
            continue
        open_.setdefault(name, []).append(len(path))
        if name in _FENCES:
            fences.append(len(path))
        if name in _BLOCK and name != "p":
            blocks.append(len(path))
        path.append(new)
        node = new
    return root


def _ordered(root: Node) -> list[Node]:
    """Nodes, each before those inside it, without what is skipped. Pages may nest deeply, so not recursive."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.skip)
    return out


def measure(root: Node) -> list[Node]:
    """Give each node its characters, tags, those inside links, composite density and density sum."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for child in node.children:
            if isinstance(child, str):
                chars += len(child) - child.count(" ")
            elif not child.skip:
                chars, tags = chars + child.chars, tags + child.tags + 1
                link_chars, link_tags = link_chars + child.link_chars, link_tags + child.link_tags
        if node.name == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    top = root
    overall = top.link_chars / max(1, top.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c == 0:
            node.density = 0.0
            continue
        # links make the logarithm's base larger and its argument smaller, so their text counts for less
        base = math.log(c / max(1, c - lc) * lc + overall * c + math.e)
        argument = c / max(1, lc) * t / lt
        node.density = c / t * math.log(max(argument, 1.0)) / max(base, 1e-9) if argument > 1 else 0.0
    for node in nodes:
        node.sum = math.fsum(c.density for c in node.children if not isinstance(c, str) and not c.skip)
    return nodes


def _outermost(nodes: list[Node]) -> list[Node]:
    """Article elements that no other holds, in page order, but for those that are mostly links."""
    held: set[Node] = set()
    out = []
    for node in nodes:  # each before those inside it
        if node.parent in held or node.name == "article":
            if node.parent not in held and node.link_chars * 2 <= node.chars and node.chars:
                out.append(node)
            held.add(node)
    order, stack = {}, [nodes[0]]
    while stack:
        node = stack.pop()
        order[node] = len(order)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return sorted(out, key=order.__getitem__)


def main_nodes(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the article, in page order, and the least density on the path from the densest one to the body.

    The subtree with the greatest density sum is the densest. An article or main element that holds it, or most of
    its text, is taken instead, with the article elements beside it; or all outermost article elements, if they do together. Otherwise its outermost ancestor below the body is, as all ancestors reach the least density of the
    path, and with it the body's other children that reach it and those that are headings or paragraphs, unless mostly links.
    Paragraphs' own densities are leaves' sums, so a text block counts with its element's density where it has
    no element inside.
    """
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.sum)  # the first of equals, which is the outer one
    if best.sum == 0:
        best = root
    threshold, walk = math.inf, best
    while walk is not None and walk.name not in ("html", "#root"):
        threshold = min(threshold, walk.density)
        walk = walk.parent
    if threshold is math.inf:
        threshold = 0.0
    up = best
    while up.parent is not None and up.name not in ("article", "main"):
        up = up.parent
    inside = [n for n in nodes if n.name in ("article", "main") and n.chars * 2 > best.chars]
    if up.parent is None and inside:
        up = max(inside, key=lambda n: n.chars)
    elif up.parent is None and (several := _outermost(nodes)) and sum(n.chars for n in several) * 2 > best.chars:
        return several, threshold
    if up.parent is not None:
        beside = [c for c in up.parent.children if not isinstance(c, str) and not c.skip and c.name == up.name and c.chars]
        return ([c for c in beside if c is up or c.link_chars * 2 <= c.chars] if up.name == "article" else [up]), threshold
    if best.name in _TOP:
        return [best], threshold
    up = best
    while up.parent.name not in _TOP:
        up = up.parent

    def joins(node: Node) -> bool:
        reaches = node.density >= threshold * (1 - 1e-9) or node.name in _HEADINGS or node.name == "p"
        return node is up or reaches and node.link_chars * 2 <= node.chars

    return [c for c in up.parent.children if not isinstance(c, str) and not c.skip and c.chars and joins(c)], threshold


def _set_aside(node: Node, threshold: float) -> set[Node]:
    """Children anywhere under node that are only ways on: less dense than the threshold, mostly links, and at an end of their element.

    Tables, headings and paragraphs never are, nor is what stands between other text of its element, as a list of sources does.
    """
    out, stack = set(), [node]
    while stack:
        around = stack.pop()
        parts = [c for c in around.children if (c.strip() if isinstance(c, str) else not c.skip and c.chars)]

        def aside(c: Node | str) -> bool:
            return not isinstance(c, str) and c.name in _BLOCK and c.name not in _HEADINGS and c.name not in ("p", "table", "li", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") and c.density < threshold and c.link_chars * 2 > c.chars

        low, high = 0, len(parts)
        while low < high and aside(parts[low]):
            low += 1
        while high > low and aside(parts[high - 1]):
            high -= 1
        out.update(parts[:low], parts[high:])
        stack.extend(c for c in parts[low:high] if not isinstance(c, str))
    return out


def blocks_of(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks under node, in page order, without what is set aside."""
    out: list[str] = []
    open_: list[str] = []

    def close() -> None:
        if open_:
            text = _SPACE.sub(" ", html.unescape("".join(open_))).strip()
            if text:
                out.append(text)
            open_.clear()

    aside = _set_aside(node, threshold)
    stack: list[Node | str | None] = [node]
    while stack:
        now = stack.pop()
        if now is None:
            close()
        elif isinstance(now, str):
            open_.append(now)
        elif now.name == "br":
            open_.append(" ")
        elif now.skip and now is not node:
            continue
        elif now in aside:
            close()
        else:
            block = now.name in _BLOCK
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(now.children))
    close()
    return out


def main_text(source: str | None) -> str:
    """The article's text: white space of a block folded to one space, blocks joined by line ends."""
    if not source:
        return ""
    root = parse(source)
    settle(root)
    found, threshold = main_nodes(root)
    return "\n".join(block for node in found for block in blocks_of(node, threshold))


def extract_pages(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of each page. A null page has the empty text.

    One pass without a shuffle; rows, other columns and repeated rows stay as they are. A column called as
    the new one is replaced. An empty table gives no rows. A page may be of any length that a row can hold; its task holds it
    whole, with its tree.
    """
    kept = [c for c in pages.columns if c.lower() not in (name.lower(),)]
    schema = pages.select(*kept).schema.add(name, "string")
    place = pages.columns.index(html_col)
    kept_at = [pages.columns.index(c) for c in kept]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 256):
            texts = pa.array([main_text(x) for x in part.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept_at), texts], [*kept, name])

    return pages.mapInArrow(extract, schema)
