"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element and each text block of a page is a node with a hidden label, content or not. Node potentials
are log-odds of its features (tag, words of class and id, length, link density, punctuation); parent-child
potentials say how often a child of a kind has its parent's label. Both are counted from labelled pages: a few
written for the purpose (``SEEDS``) and at most ``SAMPLE_PAGES`` pages of the table whose own markup names their
article, chosen by a hash of page_id. Sum-product messages go up and then down the tree, so every node gets its
exact marginal; text blocks with a marginal of one half or more are the main text.

A page is handled as a row; pages are independent, so there is no shuffle but that of the small feature counts.

Defined results: a null or empty html gives an empty text; unclosed tags, comments and scripts end where the
page or their container ends; a page without markup is one block; repeated rows give equal results; a page
whose blocks are all judged not to be content gives an empty text; a null page_id or url is passed on; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400
SEED_SHARE = 0.9
SMOOTHING = 0.5

# Elements by what browsers do with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script style textarea title noscript template iframe object svg select head option button".split()
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
LIST_BOUNDS = frozenset("ul ol dl table".split())
# Words of class and id names and what they hint at.
HINTS = {
    "aside": "ad ads advert advertisement banner sponsor sponsored promo promotion related recommended widget "
    "sidebar share social rail popular trending".split(),
    "chrome": "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar pager "
    "pagination copyright legal skip login search".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "paywall".split(),
    "talk": "comment comments disqus reply replies respond discussion thread reviews".split(),
    "main": "article content post entry story body main text blog page-content prose".split(),
}
HINT_OF = {word: kind for kind, found in HINTS.items() for word in found}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>?",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARK = re.compile(r"data-content=\"([01])\"")
SPACE = re.compile(r"\s+")

# Labelled pages written for the purpose: data-content says whether what is inside is content.
SEEDS = (
    """<body><header data-content="0"><div class="masthead"><a href="/">The Daily</a></div></header><nav
    data-content="0"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav><div class="cookie-notice"
    data-content="0"><p>We use cookies to improve your visit. Accept them to go on.</p><button>Accept</button></div><main><article
    data-content="1"><h1>Harvest begins early</h1><p>Growers along the river began to pick this week, a month before the
    usual date.</p><h2>Why now</h2><p>A warm spring and little rain are the reasons, they say.</p><ul><li>Apples first</li><li>Pears
    in June</li></ul><aside class="related" data-content="0"><h3>Related</h3><ul><li><a href="/x">Older story</a></li></ul></aside></article>
    </main><section class="comments" data-content="0"><h3>2 comments</h3><div class="comment"><p>I saw this too, on my way home.</p></div>
    <form><p>Leave a reply</p></form></section><footer data-content="0"><p>All rights reserved.</p></footer></body>""",
    """<body><div class="topbar" data-content="0"><a href="/login">Log in</a></div><div id="menu" data-content="0"><a href="/1">One</a>
    <a href="/2">Two</a></div><div class="post-content" data-content="1"><h1>How bread rises</h1><p>Yeast eats sugar and gives
    off gas, which the dough holds.</p><blockquote>Patience is half of baking.</blockquote><p>Leave it for an hour.</p></div><div class="sidebar"
    data-content="0"><h4>Popular</h4><ul><li><a href="/p">Ten pies</a></li></ul><p>Subscribe to our letter for more.</p></div><div
    class="ad" data-content="0">Cheap flour, delivered to your door today.</div><div id="comments" data-content="0"><p>Great recipe, thank
    you!</p><p>Mine did not rise at all.</p></div><div class="footer" data-content="0"><p>Imprint and contact.</p></div></body>""",
    """<body><nav class="breadcrumb" data-content="0"><a href="/">Home</a> &gt; <a href="/n">Notes</a></nav><section id="main"
    data-content="1"><h1>Notes on tides</h1><p>The moon pulls the sea twice a day.</p><p>Short.</p><table><tr><td>High</td><td>6:10</td></tr></table><pre>low
    12:25</pre></section><div class="advertisement" data-content="0"><p>Boats for hire, all summer long.</p></div><form class="newsletter"
    data-content="0"><p>Get our letter by post every Friday.</p><input></form><div class="share" data-content="0"><a href="#">Share</a></div>
    <aside data-content="0"><h3>About us</h3><p>We write on the coast and what lives there.</p></aside></body>""",
    """<body><div data-content="1"><p>A plain page with only a few paragraphs has neither a menu nor a footer.</p><p>All of it
    is content, and it ends with a full stop.</p></div></body>""",
    """<body><div class="header" data-content="0"><p>Welcome, guest.</p></div><div class="story" data-content="1"><h2>Two bridges</h2>
    <p>Both were built by hand.</p><p>One stands.</p></div><div class="alert" data-content="0"><p>This site will be down on Sunday.</p></div>
    <div class="discussion" data-content="0"><ul><li><p>My uncle worked there for years.</p></li></ul></div><footer data-content="0"><ul><li><a
    href="/t">Terms</a></li></ul></footer></body>""",
)


class Node:
    """A block element, or a text block (``tag`` is "#text")."""

    __slots__ = ("tag", "hints", "kids", "text", "chars", "linked", "mark", "stop", "up")

    def __init__(self, tag: str, hints: frozenset = frozenset(), mark: int | None = None):
        self.tag, self.hints, self.kids, self.text, self.mark = tag, hints, [], "", mark
        self.chars = self.linked = 0
        self.stop = False


def _hints(attributes: str) -> frozenset:
    found = set()
    for names in NAMES.findall(attributes):
        for word in re.split(r"[^a-z0-9]+", "".join(names).lower()):
            if word in HINT_OF:
                found.add(HINT_OF[word])
    return frozenset(found)


def parse(page: str) -> Node:
    """The tree of block elements and text blocks of a page; what browsers don't show is left out."""
    root = Node("#root")
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements and the block each one's text goes to
    run: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", references.unescape("".join(t for t, _ in run))).strip()
            if text:
                leaf = Node("#text")
                leaf.text, leaf.chars = text, len(text)
                leaf.linked = min(leaf.chars, sum(len(t.strip()) for t, linked in run if linked))
                leaf.stop = text[-1] in ".!?…\"”»"
                stack[-1][1].kids.append(leaf)
            run.clear()

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal links
        if any(name not in INLINE for name, _ in stack[k:]):
            flush()
        links -= sum(name == "a" for name, _ in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        match = TOKEN.search(page, at)
        if match is None:
            run.append((page[at:], links > 0))
            break
        if match.start() > at:
            run.append((page[at : match.start()], links > 0))
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), match[1] or match[4], match[3] or match[6] or ""
        if ending:
            if tag == "br":
                run.append((" ", False))
            elif tag in ("p", *CLOSES_P) or tag not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = over.end() if over else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append((" ", False))
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            continue
        if tag in CLOSES_P or tag in SAME_KIND:
            ends = SAME_KIND.get(tag, {"p"} if tag in CLOSES_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] not in INLINE and (stack[k][0] in LIST_BOUNDS or not tag.startswith(("t", "d", "l", "o"))):
                    break
        flush()
        mark = MARK.search(attributes)
        node = Node(tag, _hints(attributes), int(mark[1]) if mark else None)
        stack[-1][1].kids.append(node)
        stack.append((tag, node))
    flush()
    _drop_hidden(root)
    return root


def _drop_hidden(root: Node) -> None:
    """Take out what isn't shown as text, and sum up the lengths below each block."""
    for node in reversed(_order(root)):
        node.kids = [k for k in node.kids if k.tag not in HIDDEN]
        for k in node.kids:
            node.chars += k.chars
            node.linked += k.linked


def _order(root: Node) -> list[Node]:
    """Nodes with parents before children (no recursion: pages may nest deeply)."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting.extend(reversed(node.kids))
    return out


def _bucket(n: int) -> int:
    return min(n, 4095).bit_length() // 2


def features(node: Node) -> list[str]:
    density = 4 * node.linked // max(1, node.chars)
    kind = "t" if node.tag == "#text" else "e"
    out = [f"{kind}-density {density}"]
    if kind == "t":
        out.append(f"stop {node.stop}")
    else:
        out += [f"tag {node.tag}", f"e-length {_bucket(node.chars)}"]
        out += [f"hint {h}" for h in sorted(node.hints)] or ["hint none"]
    return out


def edge_of(node: Node, parent: Node) -> str:
    """Parent-child potentials are counted by the kinds of both ends."""
    return f"{kind_of(parent)}-{kind_of(node)}"


KINDS = ("text", "chrome", "main", "block")


def kind_of(node: Node) -> str:
    if node.tag == "#text":
        return "text"
    if node.hints - {"main"} or node.tag in ("nav", "footer", "aside", "form", "header"):
        return "chrome"
    return "main" if node.hints or node.tag in ("article", "main") else "block"


def labelled(root: Node) -> list[tuple[Node, Node | None, int]] | None:
    """Each node with its parent and label by data-content marks; None for a page without one."""
    out, marked = [], False
    waiting: list[tuple[Node, Node | None, int]] = [(root, None, 0)]
    while waiting:
        node, parent, label = waiting.pop()
        if node.mark is not None:
            label, marked = node.mark, True
        out.append((node, parent, label))
        waiting.extend((k, node, label) for k in node.kids)
    return out if marked else None


def mark_by_markup(root: Node) -> bool:
    """Label a page whose own markup names one article; False where it doesn't."""
    nodes = _order(root)
    articles = [n for n in nodes if n.tag in ("article", "main")]
    if not articles or sum(n.tag == "article" for n in articles) > 1:
        return False
    inner = next((n for n in articles if n.tag == "article"), articles[0])
    for n in nodes:
        if kind_of(n) == "chrome":
            n.mark = 0
    inner.mark = 1
    return True


def counts_of(root: Node) -> Counter:
    """The feature and parent-child counts of a labelled page."""
    found: Counter = Counter()
    rows = labelled(root) or []
    labels = {id(node): label for node, _, label in rows}
    for node, parent, label in rows:
        found[f"y {label}"] += 1
        for f in features(node):
            found[f"f {label} {f}"] += 1
        if parent is not None:
            found[f"c {edge_of(node, parent)} {labels[id(parent)]} {label}"] += 1
    return found


class Model:
    """Log potentials from counts."""

    def __init__(self, counts: dict[str, float]):
        self.prior = math.log((counts.get("y 1", 0) + SMOOTHING) / (counts.get("y 0", 0) + SMOOTHING))
        totals: Counter = Counter()
        values: dict[str, set] = {}
        for key, n in counts.items():
            if key[0] == "f":
                _, label, rest = key.split(" ", 2)
                group = rest.split(" ")[0]
                totals[label, group] += n
                values.setdefault(group, set()).add(rest)
        self.odds = {}
        for group, rests in values.items():
            for rest in rests:
                p, q = (
                    (counts.get(f"f {y} {rest}", 0) + SMOOTHING)
                    / (totals[str(y), group] + SMOOTHING * (len(rests) + 1))
                    for y in (1, 0)
                )
                self.odds[rest] = math.log(p / q)
        self.edge = {}
        for kind in (f"{above}-{below}" for above in KINDS for below in KINDS):
            n = {(a, b): counts.get(f"c {kind} {a} {b}", 0) + SMOOTHING for a in (0, 1) for b in (0, 1)}
            self.edge[kind] = tuple(n[a, b] / (n[a, 0] + n[a, 1]) for a in (0, 1) for b in (0, 1))

    def marginals(self, root: Node) -> list[tuple[Node, float]]:
        """Every node with its probability of being content: one pass up, one down."""
        nodes = _order(root)
        place = {id(n): k for k, n in enumerate(nodes)}
        parent: list[int | None] = [None] * len(nodes)
        for k, n in enumerate(nodes):
            for child in n.kids:
                parent[place[id(child)]] = k
        # log-odds of a node's label from itself and, as messages come in, from what is below it
        up = [sum(self.odds.get(f, 0.0) for f in features(n)) for n in nodes]
        sent = [0.0] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            sent[k] = _message(up[k], *self.edge[edge_of(nodes[k], nodes[parent[k]])])
            up[parent[k]] += sent[k]
        total = up[:]
        for k in range(1, len(nodes)):
            # what the parent says without what this child told it, carried over the edge
            e00, e01, e10, e11 = self.edge[edge_of(nodes[k], nodes[parent[k]])]
            above = total[parent[k]] - sent[k]
            one = 1 / (1 + math.exp(-max(-500.0, min(500.0, above))))
            down = math.log((one * e11 + (1 - one) * e01) / (one * e10 + (1 - one) * e00))
            total[k] = up[k] + down
        return [(n, 1 / (1 + math.exp(-max(-500.0, min(500.0, t))))) for n, t in zip(nodes, total, strict=True)]


def _message(odds: float, e00: float, e01: float, e10: float, e11: float) -> float:
    """The log-odds a child with these log-odds gives its parent."""
    one = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return math.log((one * e11 + (1 - one) * e10) / (one * e01 + (1 - one) * e00))


def main_text(model: Model, page: str) -> str:
    root = parse(page)
    return "\n\n".join(n.text for n, p in model.marginals(root) if n.tag == "#text" and p >= 0.5)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """Count the seeds and a bounded sample of the table's pages that label themselves."""
    ids = pages.select("page_id").where("page_id is not null").distinct()
    sample = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    chosen = pages.select("page_id", "html").where("html is not null").join(F.broadcast(sample), "page_id")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                root = parse(page.as_py())
                if mark_by_markup(root):
                    found.update(counts_of(root))
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = chosen.mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return Model(mixed({r["key"]: r["n"] for r in rows}))


def mixed(sample: dict[str, int], share: float = SEED_SHARE) -> dict[str, float]:
    """Counts in which the written pages weigh ``share`` of all nodes, however large the sample."""
    seeds: Counter = Counter()
    for seed in SEEDS:
        seeds.update(counts_of(parse(seed)))
    nodes = [sum(n for key, n in c.items() if key[0] == "y") for c in (sample, seeds)]
    factor = nodes[1] * (1 - share) / share / nodes[0] if nodes[0] else 0.0
    return {key: seeds.get(key, 0) + factor * sample.get(key, 0) for key in {*seeds, *sample}}


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [main_text(shared.value, page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(texts, f"page_id {kind}, url string, text string")
