"""Main text of web pages by wrapper induction.

The DOM tree of every page is aligned with that of a reference page of its host by simple tree
matching (Yang, 1991). A part that says the same on most aligned pages is the host's template and
goes, inside an article as well as around it, whatever it is called; slots that vary are content.
Varying parts whose element or name says what they are (adverts, forms, comments) go too. What is
left is narrowed to the articles, their titles and leads where a page has them.

Trees are arrays of nodes in page order, and all walks are loops, so neither deep nor wide pages
exhaust a stack. Sources are read in one pass, and subtrees are matched once for each pair of shapes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .url_filter import parse_url

REFERENCE_BYTES = 64 << 20
LEAST_SAME, LEAST_SHARE = 3, 0.5
#: An article, or a part before one, with this share of its text in links is a teaser.
TEASER_LINKS = 0.5
#: Pairs of shapes whose matching a wrapper remembers.
REMEMBERED = 1 << 16
#: Hosts with more than one in HOT_SHARE pages are split where references are too large to broadcast.
HOT_SHARE = 1000

# Fixed values of HTML: elements without content, raw-text elements, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of the kinds named, up to the nearest of its bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}

# Elements, roles and names that mark what is not main text. A name counts as a whole
# token of class or id, alone or between the neutral words before and behind it, joined or run together.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select input textarea dialog head title object canvas menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = (
    "nav navbar navigation menu menubar footer sidebar sidebars aside ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "banner cookie cookies consent notice notices alert popup modal overlay comment comments respond reply replies disqus "
    "breadcrumb breadcrumbs share sharing social related newsletter subscribe signup widget widgets pagination pager masthead adsbygoogle"
).split()
BEFORE = "site page main top bottom global primary secondary header footer mobile side left right reader user site-wide".split()
BEHIND = (
    "left right top bottom main primary secondary wrapper wrap container inner outer box bar area list section block item items form link links "
    "slot unit frame menu nav navigation widget widgets banner notice consent policy button buttons icons media share posts articles stories content "
    "footer header panel popup modal text title thread body"
).split()
HEADER_NAMES = frozenset({"header", "topbar", "head", "site-header", "page-header", "main-header", "top-bar", "header-bar"})
MAIN_NAMES = frozenset("content main article post entry story maincontent articlebody main-content post-content entry-content article-content article-body story-body post-body".split())

#: Names that a paragraph of an article may bear for what it is about.
TOPICS = frozenset("social related reply respond alert signup share sharing".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ASIDE = re.compile(rf"(?:(?:{'|'.join(BEFORE)})[-_]*)*(?:{'|'.join(NAMES)})(?:[-_]*(?:{'|'.join(BEHIND)}|\d+))*")


class Node:
    __slots__ = ("tag", "attributes", "parts", "kids", "parent", "at", "size", "shape", "text", "said", "mains", "drop", "bulk", "linked")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None, at: int) -> None:
        self.tag, self.attributes, self.parent, self.at = tag, attributes, parent, at
        self.parts: list[Node | str] = []
        self.kids: list[Node] = []
        self.size = 1  # nodes of the subtree, which follow each other in page order
        self.shape = self.text = self.said = 0  # hashes of the subtree's labels, of its words that stay, and of all its words
        self.mains = self.bulk = self.linked = 0
        self.drop = False

    def label(self) -> tuple[str, str]:
        return self.tag, self.attributes.get("class", "")

    def names(self) -> list[str]:
        a = self.attributes
        return f"{a.get('class', '')} {a.get('id', '')}".lower().split() if a else []


class Tags:
    """Ends of a source's tags, found in time that grows with its length alone, whatever is left open."""

    def __init__(self, source: str) -> None:
        self.source, self.last = source, {c: source.rfind(c) for c in "\"'>"}
        self.open: set[int] = set()  # places outside strings from which no > outside strings follows

    def end(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at `at`: the first one outside strings, or if there
        is none the first one; -1 without any."""
        seen, k = [], at
        while k not in self.open:
            m = _STOP.search(self.source, k)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            seen.append(k)
            close = self.source.find(m[0], m.end()) if m.end() <= self.last[m[0]] else -1
            if close < 0:
                break
            k = close + 1
        self.open.update(seen)
        return self.first(at)

    def first(self, at: int) -> int:
        return self.source.find(">", at) if at <= self.last[">"] else -1


def parse(source: str) -> list[Node]:
    """The nodes of a lenient DOM tree in page order, its root first: unclosed and misplaced tags never
    fail, and an unfinished last tag is no text. One pass; open elements are found by their names."""
    root = Node("#root", {}, None, 0)
    nodes, stack = [root], [root]
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    block_places: list[int] = []
    tags, at, k, size = Tags(source), 0, 0, len(source)

    def text(end: int) -> None:
        if end > at:
            piece = source[at:end]
            stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)

    def close(place: int) -> None:
        while len(stack) > place:
            where[stack.pop().tag].pop()
        while block_places and block_places[-1] >= place:
            block_places.pop()

    def nearest(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    while True:
        k = source.find("<", k)
        if k < 0:
            text(size)
            break
        following = source[k + 1 : k + 2]
        if following in ("!", "?"):
            is_comment = source.startswith("<!--", k)
            end = source.find("-->", k + 4) if is_comment else tags.first(k)
            text(k)
            if end < 0:
                break
            k = at = end + (3 if is_comment else 1)
            continue
        if k > tags.last[">"] and (following == "/" or (following.isascii() and following.isalpha())):
            text(k)
            break
        m = _NAME.match(source, k)
        if m is None:
            k += 1
            continue
        end = tags.end(m.end())
        text(k)
        if end < 0:
            break
        raw, name = source[m.end() : end], m[2].lower()
        k = at = end + 1
        if m[1]:
            if where.get(name):
                close(where[name][-1])
            continue
        if name in CLOSES_P and where.get("p") and block_places[-1] == where["p"][-1]:
            close(block_places[-1])
        if name in ENDS:
            kinds, bounds = ENDS[name]
            inner = nearest(kinds)
            if inner > nearest(bounds):
                close(inner)
        found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}
        node = Node(name, found, stack[-1], len(nodes))
        nodes.append(node)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if name in RAW:
            ended = re.compile(f"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(source, at) if at <= tags.last[">"] else None
            k = at = ended.end() if ended else size
        elif name not in VOID:
            where.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                block_places.append(len(stack))
            stack.append(node)
    return nodes


def is_aside(node: Node, inside: bool, mains: int) -> bool:
    """Whether a node says itself that it is no main text; inside: within an article or main element.

    What holds all of the page's article and main elements (mains) is never one by its name."""
    tag = node.tag
    whole = bool(mains) and node.mains == mains
    if tag in DROPPED:
        return not whole
    if tag == "header" and not inside:
        return not whole
    a = node.attributes
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or ("style" in a and re.search(r"display\s*:\s*none", a["style"], re.IGNORECASE)):
        return True
    if a.get("role", "").lower() in ROLES:
        return not whole
    if tag in ("body", "html", "main"):
        return False
    names = node.names()
    if inside and tag == "p":
        names = [n for n in names if n not in TOPICS]
    if any(_ASIDE.fullmatch(n) for n in names) or (not inside and tag != "h1" and HEADER_NAMES.intersection(names)):
        return tag == "article" or not whole
    return False


def mark(nodes: list[Node]) -> list[Node]:
    """Set size, shape, text, said, mains and drop of all nodes; dropped parts have no text, but say something."""
    for node in reversed(nodes):
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = hash((node.label(), *(k.shape for k in node.kids)))
        node.mains = (node.tag in ("article", "main")) + sum(k.mains for k in node.kids)
    mains, k = nodes[0].mains, 1
    inside_until = 0  # what is before this place is inside an article or main element
    while k < len(nodes):
        node = nodes[k]
        if is_aside(node, k < inside_until, mains):
            node.drop = True
            k += node.size
            continue
        if node.tag in ("article", "main"):
            inside_until = max(inside_until, k + node.size)
        k += 1
    for node in reversed(nodes):
        words = [p.text if type(p) is Node else tuple(p.split()) for p in node.parts if type(p) is not Node or not p.drop]
        words = [w for w in words if w]
        node.text = 0 if node.drop or not words else words[0] if len(words) == 1 and type(words[0]) is int else hash(tuple(words))
        every = [p.said if type(p) is Node else tuple(p.split()) for p in node.parts]
        every = [w for w in every if w]
        node.said = 0 if not every else every[0] if len(every) == 1 and type(every[0]) is int else hash(tuple(every))
    return nodes


def measure(nodes: list[Node]) -> None:
    """Set bulk and linked: characters of the text that stays, and of that within links."""
    for node in reversed(nodes):
        kids = [k for k in node.kids if not k.drop]
        own = sum(len(p) - p.count(" ") - p.count("\n") for p in node.parts if type(p) is str)
        node.bulk = own + sum(k.bulk for k in kids)
        node.linked = node.bulk if node.tag == "a" else sum(k.linked for k in kids)
        if node.drop:
            node.bulk = node.linked = 0


Plan = tuple[int, int, int, list[tuple[int, int]]]


def chain(weight: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs (i, j) of the heaviest matching of two sequences in order, where i and j weigh
    weight[x[i], y[j]]; exact, a row of all columns at a time. Only every so many rows are kept, and those
    between are worked out again on the way back, so memory is about the root of x.size rows."""
    every = int(x.size**0.5) + 1

    def rows(first: int, row: np.ndarray, until: int) -> list[np.ndarray]:
        out = [row]
        for i in range(first, until):
            new = np.zeros(y.size + 1, np.int32)
            np.maximum.accumulate(np.maximum(out[-1][1:], out[-1][:-1] + weight[x[i], y]), out=new[1:])
            out.append(new)
        return out

    kept = [np.zeros(y.size + 1, np.int32)]
    for first in range(0, x.size, every):
        kept.append(rows(first, kept[-1], min(first + every, x.size))[-1])
    pairs, j = [], y.size
    for block in range(len(kept) - 2, -1, -1):
        first = block * every
        best = rows(first, kept[block], min(first + every, x.size))
        i = len(best) - 1
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((first + i, j))
    return int(kept[-1][-1]), pairs[::-1]


def plan_of(x: Node, y: Node, plans: dict[tuple[int, int], Plan]) -> Plan | list[tuple[Node, Node]]:
    """How the children of two nodes of one label match best, or the pairs of children that must be planned
    before. Children that begin or end both lists with equal shape match as wholes, which loses nothing."""
    p, q = x.kids, y.kids
    most = min(len(p), len(q))
    low = 0
    while low < most and p[low].shape == q[low].shape:
        low += 1
    high = 0
    while high < most - low and p[-1 - high].shape == q[-1 - high].shape:
        high += 1
    total = 1 + sum(c.size for c in p[:low]) + sum(c.size for c in p[len(p) - high :])
    p, q = p[low : len(p) - high], q[low : len(q) - high]
    if not p or not q:
        return total, low, high, []
    kinds_p, kinds_q = ({n.shape: n for n in side} for side in (p, q))
    labels: dict[tuple[str, str], list[Node]] = {}
    for node in kinds_q.values():
        labels.setdefault(node.label(), []).append(node)
    wanted = [(m, n) for m in kinds_p.values() for n in labels.get(m.label(), ())]
    missing = [(m, n) for m, n in wanted if m.shape != n.shape and (m.shape, n.shape) not in plans]
    if missing:
        return missing
    of_p, of_q = ({shape: k for k, shape in enumerate(kinds)} for kinds in (kinds_p, kinds_q))
    weight = np.zeros((len(of_p), len(of_q)), np.int32)
    for m, n in wanted:
        weight[of_p[m.shape], of_q[n.shape]] = m.size if m.shape == n.shape else plans[m.shape, n.shape][0]
    got, pairs = chain(weight, np.array([of_p[n.shape] for n in p]), np.array([of_q[n.shape] for n in q]))
    return total + got, low, high, [(low + i, low + j) for i, j in pairs]


def match(a: list[Node], b: list[Node], plans: dict[tuple[int, int], Plan] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Size and pairs of the largest simple tree matching of two marked trees.

    What two subtrees share depends on their shapes alone, so it is worked out once for each pair of
    shapes; plans may be kept between pages. All pairs of children of one label count, near or far.
    """
    if a[0].label() != b[0].label():
        return 0, []
    plans = {} if plans is None else plans
    if len(plans) > REMEMBERED:
        plans.clear()
    todo = [(a[0], b[0])]
    while todo:
        x, y = todo[-1]
        if x.shape == y.shape or (x.shape, y.shape) in plans:
            todo.pop()
            continue
        found = plan_of(x, y, plans)
        if type(found) is list:
            todo += found
        else:
            plans[x.shape, y.shape] = found
    pairs, left, size = [], [(a[0], b[0])], a[0].size
    if a[0].shape != b[0].shape:
        size = plans[a[0].shape, b[0].shape][0]
    while left:
        x, y = left.pop()
        if x.shape == y.shape:
            pairs += zip(a[x.at : x.at + x.size], b[y.at : y.at + y.size])
            continue
        pairs.append((x, y))
        _, low, high, chosen = plans[x.shape, y.shape]
        left += [*zip(x.kids[:low], y.kids[:low]), *zip(x.kids[len(x.kids) - high :], y.kids[len(y.kids) - high :]), *((x.kids[i], y.kids[j]) for i, j in chosen)]
    return size, pairs


class Wrapper:
    """A host's reference tree and the places of its template nodes."""

    def __init__(self, source: str | None, constant: list[int] | None = None) -> None:
        self.nodes = mark(parse(source or ""))
        self.constant = frozenset(constant or ())
        self.plans: dict[tuple[int, int], Plan] = {}

    def evidence(self, page: list[Node]) -> Iterator[tuple[int, bool]]:
        """(place, whether the text is the same) of the aligned blocks. A page that says all the same as
        the reference is a copy of it, which tells nothing of template and content."""
        if page[0].text != self.nodes[0].text:
            for r, p in match(self.nodes, page, self.plans)[1]:
                if r.said and p.said and p.tag in BLOCK:
                    yield r.at, r.said == p.said

    def template(self, page: list[Node]) -> list[Node]:
        """The blocks of a page that say what the host's pages say in that place."""
        if not self.constant:
            return []
        return [p for r, p in match(self.nodes, page, self.plans)[1] if r.at in self.constant and p.said and r.said == p.said and not p.mains]


def drop_template(nodes: list[Node], template: list[Node]) -> None:
    """Drop the outermost template nodes; those within an article stay where they are most of its text,
    for then the page is a near copy of the reference."""
    places = {n.at for n in template}
    measure(nodes)
    k, inside = 0, {}
    while k < len(nodes):
        node = nodes[k]
        if node.drop or k in places:
            if not node.drop:
                up = node.parent
                while up is not None and up.tag != "article":
                    up = up.parent
                inside.setdefault(up.at if up else -1, []).append(node)
            k += node.size
        else:
            k += 1
    for place, found in inside.items():
        if place < 0 or 2 * sum(n.bulk for n in found) <= nodes[place].bulk:
            for n in found:
                n.drop = True


def roots_of(nodes: list[Node]) -> list[Node]:
    """The parts that hold the main text by their own word, in page order; the whole page without any."""

    def outermost(test: Callable[[Node], bool]) -> list[Node]:
        out, k = [], 0
        while k < len(nodes):
            if not nodes[k].drop and test(nodes[k]):
                out.append(nodes[k])
            k += nodes[k].size if nodes[k].drop or test(nodes[k]) else 1
        return [n for n in out if n.bulk]

    articles = outermost(lambda n: n.tag == "article" or n.attributes.get("itemprop") == "articleBody")
    if articles:
        kept = [n for n in articles if n.linked < TEASER_LINKS * n.bulk]
        if kept:
            out = []
            for article in kept:  # titles, leads and other texts that stand before it in the main element
                chain, node = [], article
                while node.parent is not None and node.tag != "main":
                    node = node.parent
                    chain.append(node)
                if node.tag == "main":
                    below = [article, *chain]
                    for inner, outer in zip(below, below[1:]):
                        ahead = outer.kids[: outer.kids.index(inner)]
                        out += [n for n in ahead if not n.drop and n.bulk and not n.mains and n.linked < TEASER_LINKS * n.bulk]
                out.append(article)
            return sorted(dict.fromkeys(out), key=lambda n: n.at)
        for n in articles:  # teasers of other pages, where there is more than them
            if nodes[0].bulk > sum(x.bulk for x in articles):
                n.drop = True
        if any(n.drop for n in articles):
            measure(nodes)
    for test in (
        lambda n: n.tag == "main" or n.attributes.get("role") == "main",
        lambda n: n.tag in ("div", "section") and bool(MAIN_NAMES.intersection(n.names())),
    ):
        if found := outermost(test):
            return found
    return [nodes[0]]


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space collapsed and empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack = [(root, iter(root.parts))]
    while stack:
        node, parts = stack[-1]
        for part in parts:
            if type(part) is str:
                line.append(part)
            elif part.tag == "br":
                line.append(" ")
            elif not part.drop:
                if part.tag in BLOCK:
                    end()
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            if node.tag in BLOCK:
                end()
    end()
    return out


def extract(source: str | None, wrapper: Wrapper) -> str:
    """Main text of a page: blocks joined by blank lines."""
    nodes = mark(parse(source or ""))
    drop_template(nodes, wrapper.template(nodes))
    measure(nodes)
    return "\n\n".join(b for root in roots_of(nodes) for b in blocks(root))


def layout(html: Column) -> Column:
    """A number for the set of element names that a page uses."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower))), " "))


def references(pages: DataFrame) -> DataFrame:
    """(host, reference) of pages(page_id, host, html): the page of smallest page_id among those of the
    host's most frequent layout. Pages without html are none; of layouts as frequent the one seen first wins."""
    seen = pages.where("html <> ''").select("host", "page_id", layout(F.col("html")).alias("layout"))
    counts = seen.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("page_id").alias("least"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("least").isNull().alias("none"), "least", "layout")).alias("x")
    hosts = materialize(counts.groupBy("host").agg(first).select(F.col("host").alias("h"), "x.least"), "hosts")
    size = hosts.agg(F.sum(F.octet_length("h") + 32)).first()[0] or 0
    wanted = F.broadcast(hosts) if size <= REFERENCE_BYTES else hosts
    held = pages.where("html <> ''").join(wanted, (F.col("host") == F.col("h")) & F.col("page_id").eqNullSafe(F.col("least")))
    return materialize(held.groupBy("host").agg(F.min("html").alias("reference")), "references")


def along(pages: DataFrame, wrappers: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run over batches of pages(page_id, url, host, html), with a function that gives a row's wrapper.

    wrappers(host, reference, constant) go to every worker while their bytes are within
    REFERENCE_BYTES. Beyond that each host's wrapper leads its pages in a sorted exchange; hosts with
    more than one in HOT_SHARE pages are dealt out to several tasks, which are at most that many hosts.
    """
    spark = pages.sparkSession
    size = wrappers.agg(F.sum(F.octet_length("reference") + F.octet_length("host") + 8 * F.size(F.coalesce("constant", F.array().cast("array<int>"))))).first()[0] or 0
    if size <= REFERENCE_BYTES:
        sent = spark.sparkContext.broadcast({r.host: (r.reference, r.constant) for r in wrappers.collect()})

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Wrapper] = {}

            def of(host: str) -> Wrapper:
                if host not in held:
                    if len(held) > 500:
                        held.clear()
                    held[host] = Wrapper(*sent.value.get(host, (None, None)))
                return held[host]

            yield from run((batch, of) for batch in batches)

        return pages.mapInArrow(here, schema)

    per_host = pages.groupBy("host").agg(F.count("*").alias("n"))
    hot = per_host.crossJoin(F.broadcast(per_host.agg(F.sum("n").alias("all")))).where(F.col("n") * HOT_SHARE > F.col("all"))
    hot = F.broadcast(materialize(hot.select(F.col("host").alias("h"), F.ceil(F.col("n") * HOT_SHARE / F.col("all")).alias("parts")), "hot"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    led = wrappers.join(hot, F.col("host") == F.col("h"), "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = pages.join(hot, F.col("host") == F.col("h"), "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts))
    both = dealt.select("*", F.lit(None).cast("string").alias("reference"), F.lit(None).cast("array<int>").alias("constant"), F.lit(1).alias("turn")).unionByName(
        led.select("*", F.lit(0).alias("turn")), allowMissingColumns=True
    ).drop("h", "parts")
    both = both.repartition(partitions(spark), "host", "part").sortWithinPartitions("host", "part", "turn")

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = [None, Wrapper(None)]

        def runs() -> Iterator[tuple[pa.RecordBatch, Callable]]:
            for batch in batches:
                hosts, turns = batch.column("host").to_pylist(), batch.column("turn").to_pylist()
                start = 0
                for k in range(len(hosts) + 1):
                    if k == len(hosts) or turns[k] == 0 or hosts[k] != now[0]:
                        if k > start:
                            yield batch.slice(start, k - start), lambda host: now[1]
                        start = k
                        if k < len(hosts):
                            lead = turns[k] == 0
                            now[:] = [hosts[k], Wrapper(batch.column("reference")[k].as_py(), batch.column("constant")[k].as_py()) if lead else Wrapper(None)]
                            start += lead

        yield from run(runs())

    return both.mapInArrow(there, schema)


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, constant) for every host of pages(page_id, url, host, html): constant lists the
    places of the reference's nodes whose text is the same on more than LEAST_SAME - 1 other pages and
    at least LEAST_SHARE of those aligned there. Each task adds up its own pages first."""
    refs = references(pages)

    def count(found: Iterator) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        same: Counter = Counter()

        def emit() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64()), pa.array([same[k] for k in keys], pa.int64())],
                names=["host", "node", "n", "same"],
            )

        for batch, of in found:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html")):
                for place, equal in of(host).evidence(mark(parse(source.as_py() or ""))):
                    total[host, place] += 1
                    same[host, place] += equal
            if len(total) > 200000:
                yield emit()
                total.clear()
                same.clear()
        yield emit()

    counts = along(pages, refs.withColumn("constant", F.lit(None).cast("array<int>")), count, "host string, node int, n long, same long")
    counts = counts.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    fixed = counts.where((F.col("same") >= LEAST_SAME) & (F.col("same") >= LEAST_SHARE * F.col("n")))
    fixed = fixed.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    return materialize(refs.join(fixed, "host", "left"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text and n_chars.

    Null and empty html give an empty text. Null and malformed urls form one host. Whole copies of a
    host's reference page are no evidence of its template, and repeated rows get equal results.
    """
    ready = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        parse_url(F.col("url"))[0].alias("host"), F.col("html").cast("string").alias("html"),
    )

    def run(found: Iterator) -> Iterator[pa.RecordBatch]:
        for batch, of in found:
            texts = [extract(source.as_py(), of(host)) for host, source in zip(batch.column("host").to_pylist(), batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return along(ready, induce(ready), run, "page_id long, url string, text string, n_chars long")
