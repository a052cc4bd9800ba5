"""Main text of web pages by wrapper induction.

Pages are sorted by host; runs of same-host pages are worked through in blocks. The DOM
trees of a block are aligned with a seed page by simple tree matching. A text slot that
says the same on nearly all aligned pages belongs to the template and goes; slots that
vary, and nodes that the seed lacks, are content. Of the content, menus, page headers,
footers, sidebars, notices, adverts, forms, scripts and reader comments go by element,
role or class, and the article (or main) element is preferred where there is one.

A hot host is split by the sort over (host, id), so no task needs a whole host, and a
block holds at most ``BLOCK`` pages; each block goes on with the votes of the host so far.

Cases: null or empty html has an empty text. Pages with a null or broken address are one
host. Repeated pages count once as evidence. Null ids are allowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128
SAME_LAYOUT = 0.5
CONSTANT = 0.9
EVIDENCE = 4

# Elements of HTML by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object title".split())
NOISE = frozenset("nav footer aside form button select fieldset menu dialog".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
                  "th": ("tr", "table"), "option": ("select",)}
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promos?|promotion|banner|cookies?"
    r"|consent|gdpr|notices?|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer"
    r"|masthead|site-?header|page-?header|share|sharing|social|newsletter|subscribe|signup|login|search|comments?"
    r"|commentlist|disqus|replies|respond|related|recommended|widget|pagination|pager|skip)(?=$|[\s_-])"
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element with its block children, or a run of text (tag ``#``)."""

    __slots__ = ("tag", "label", "noise", "kids", "text", "linked", "shape", "size", "number", "raw")

    def __init__(self, tag: str, label: str, noise: bool = False):
        self.tag, self.label, self.noise = tag, label, noise
        self.kids: list[Node] = []
        self.text, self.linked, self.shape, self.size, self.number = "", 0, 0, 1, 0
        self.raw: list[str] = []


def _noisy(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether the element is noise by itself, and its name for the alignment."""
    if not attributes.strip():
        return tag in NOISE, tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    noise = (
        tag in NOISE
        or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or found.get("role", "").lower() in NOISE_ROLE
        or bool(NOISE_NAME.search(names.strip())) and tag not in ("html", "body", "article", "main")
    )
    return noise, f"{tag}.{found.get('class', '').lower()}" if "class" in found else tag


def parse(html: str) -> Node:
    """The tree of block elements; text of inline elements belongs to the run around them."""
    root = Node("root", "root")
    stack, links = [root], 0

    def end_run() -> None:
        top = stack[-1]
        if top.raw:
            text = " ".join(unescape("".join(top.raw)).split())
            top.raw = []
            if text:
                leaf = Node("#", "#")
                leaf.text, leaf.linked = text, min(top.linked, len(text))
                top.kids.append(leaf)
        top.linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            end_run()
            stack.pop()

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].raw.append(html[at:])
            break
        if m.start() > at:
            piece = html[at : m.start()]
            stack[-1].raw.append(piece)
            if links:
                stack[-1].linked += len(piece)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close_at = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close_at.end() if close_at else n
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            elif tag == "br":
                stack[-1].raw.append(" ")
            continue
        if tag in VOID:
            end_run()
            continue
        links = 0
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in ("td", "th", "li", "article", "section", "div", "body"):
                    break
        elif tag in CLOSED_BY_SAME:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag or tag in ("dt", "dd", "td", "th") and stack[depth].tag in (
                    {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"}
                ):
                    close(depth)
                    break
                if stack[depth].tag in CLOSED_BY_SAME[tag]:
                    break
        end_run()
        noise, label = _noisy(tag, m[3])
        node = Node(tag, label, noise)
        stack[-1].kids.append(node)
        stack.append(node)
    close(0)
    _finish(root)
    return root


def _finish(root: Node) -> None:
    """Sizes, shapes and numbers in page order, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(order):
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = hash((node.label, tuple(k.shape for k in node.kids)))


def _pairs_of(a: list[Node], b: list[Node], depth: int) -> list[tuple[Node, Node]]:
    """The children aligned by simple tree matching: equal shapes at both ends, the rest by dynamic programming."""
    out, lo = [], 0
    while lo < len(a) and lo < len(b) and a[lo].shape == b[lo].shape:
        out.append((a[lo], b[lo]))
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1].shape == b[eb - 1].shape:
        ea, eb = ea - 1, eb - 1
        out.append((a[ea], b[eb]))
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    won = [[0] * len(b) for _ in a]
    for i, x in enumerate(a):
        row, above, gains = best[i + 1], best[i], won[i]
        for j, y in enumerate(b):
            gain = 0
            if x.label == y.label:
                gain = x.size if x.shape == y.shape else score(x, y, depth + 1)
            gains[j] = gain
            row[j + 1] = max(row[j], above[j + 1], above[j] + gain)
    i, j = len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
    return out


MAX_DEPTH = 200


def score(x: Node, y: Node, depth: int = 0) -> int:
    """Number of matched nodes of two trees."""
    if x.label != y.label:
        return 0
    if x.shape == y.shape:
        return x.size
    if depth > MAX_DEPTH or not x.kids or not y.kids:
        return 1
    return 1 + sum(
        a.size if a.shape == b.shape else score(a, b, depth + 1) for a, b in _pairs_of(x.kids, y.kids, depth)
    )


def align(x: Node, y: Node) -> list[tuple[Node, Node]]:
    """The pairs of text runs of two aligned trees."""
    out, todo = [], [(x, y, 0)]
    while todo:
        a, b, depth = todo.pop()
        if a.tag == "#":
            out.append((a, b))
        elif depth <= MAX_DEPTH:
            todo.extend((p, q, depth + 1) for p, q in _pairs_of(a.kids, b.kids, depth) if p.label == q.label)
    return out


def _labels(root: Node) -> Counter:
    """How many nodes of the tree have each label."""
    out, todo = Counter(), [root]
    while todo:
        node = todo.pop()
        out[node.label] += 1
        todo.extend(node.kids)
    return out


class Wrapper:
    """A seed page of every layout of a host, with the votes on their text slots."""

    def __init__(self):
        self.seeds: list[tuple[Node, Counter, dict[int, list[int]]]] = []
        self.seen: set[int] = set()

    def vote(self, page: Node, known: bool) -> tuple[dict[int, list[int]], list[tuple[Node, Node]]]:
        """Align with the first seed that fits; without one the page becomes a seed.

        Only nodes of one label are matched, so the labels that two trees share bound
        their score from above: seeds of other layouts are passed over without matching.
        """
        labels = _labels(page)
        for seed, own, votes in self.seeds:
            least = SAME_LAYOUT * (seed.size + page.size) / 2
            if (
                min(seed.size, page.size) >= least
                and sum(min(n, own[k]) for k, n in labels.items()) >= least
                and score(seed, page) >= least
            ):
                pairs = align(seed, page)
                if not known:
                    for a, b in pairs:
                        slot = votes.setdefault(a.number, [0, 0])
                        slot[a.text != b.text] += 1
                return votes, pairs
        votes: dict[int, list[int]] = {}
        self.seeds.append((page, labels, votes))
        return votes, [(leaf, leaf) for leaf in _leaves(page)]


def _leaves(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            out.append(node)
        todo.extend(reversed(node.kids))
    return out


def _content(root: Node, template: set[int]) -> str:
    """The blocks of the page that are neither template nor noise, in page order."""
    runs: list[tuple[int, Node]] = []  # (number of the article around, 0 without)
    todo = [(root, 0)]
    while todo:
        node, article = todo.pop()
        if node.tag == "#":
            if node.number not in template:
                runs.append((article, node))
            continue
        if node.noise or node.tag == "header" and not article:
            continue
        if not article and node.tag in ("article", "main"):
            article = node.number
        todo.extend((k, article) for k in reversed(node.kids))
    weight: dict[int, int] = {}
    for article, node in runs:
        weight[article] = weight.get(article, 0) + len(node.text)
    inside = {a: w for a, w in weight.items() if a}
    if inside:
        most = max(inside.values())
        # Further articles of the page count if they are of like size.
        chosen = {a for a, w in inside.items() if 2 * w >= most}
        kept = [node for article, node in runs if article in chosen]
    else:
        kept = [node for _, node in runs if 2 * node.linked < len(node.text)]
    return "\n\n".join(node.text for node in kept)


def extract_block(wrapper: Wrapper, pages: list[str]) -> list[str]:
    """Texts of the pages of one host, which first vote on the template."""
    aligned = []
    for html in pages:
        tree = parse(html)
        key = hash(html)
        aligned.append((tree, *wrapper.vote(tree, key in wrapper.seen)))
        wrapper.seen.add(key)
    out = []
    for tree, votes, pairs in aligned:
        template = set()
        for a, b in pairs:
            same, other = votes.get(a.number, (0, 0))
            # Inside an article a slot may be the same by copying; there the evidence must be complete.
            if same + other >= EVIDENCE and same >= CONSTANT * (same + other) and a.text == b.text:
                template.add(b.number)
        out.append(_content(tree, template) or (_content(tree, set()) if template else ""))
    return out


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host, wrapper, block = None, Wrapper(), []

    def done() -> pa.RecordBatch:
        texts = extract_block(wrapper, [b[2] for b in block])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b[0] for b in block], kind),
                pa.array([b[1] for b in block], pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    for batch in batches:
        kind = batch.schema.field("page_id").type
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "host")]
            for page_id, url, html, own in zip(*columns, strict=True):
                if block and (own != host or len(block) >= BLOCK):
                    yield done()
                    block = []
                if own != host:
                    host, wrapper = own, Wrapper()
                block.append((page_id, url, html))
    if block:
        yield done()


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(df[url_col].cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return (
        df.select(
            df[id_col].alias("page_id"),
            df[url_col].cast("string").alias("url"),
            F.coalesce(df[html_col].cast("string"), F.lit("")).alias("html"),
            F.coalesce(host, F.lit("")).alias("host"),
        )
        .repartitionByRange("host", "page_id")
        .sortWithinPartitions("host", "page_id")
        .mapInArrow(_extractor, f"page_id {kind}, url string, text string, n_chars long")
    )
