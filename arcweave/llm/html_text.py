"""Main text of web pages by minimum cuts.

1. A page is read into blocks: runs of text between block-level tags, outside of what is never text (scripts, styles,
   comments, form fields), with the container each lies in and what its ancestors say of themselves (hints).
2. A logistic regression on features of a block's own text and neighbourhood, none of them a hint, gives its log-odds of
   being content. It is fitted on a bounded sample of pages whose blocks the hints label.
3. A page's blocks are the nodes of a flow network. A block's log-odds and hint are its capacity from the source (content)
   or to the sink (boilerplate). Neighbours are joined by smoothness edges: those adjacent on the page the stronger the
   nearer their containers, and each block with the block before it in the same container. The minimum cut labels blocks.
   Blocks whose capacity exceeds all their edges have their label in every minimum cut, so they are fixed first and fold
   into their neighbours; augmenting paths decide the rest.

Pages are independent: one map over the table, a page at a time, and the fit, of a bounded number of pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.store import by_place, gives_back, held_schema, table

#: Pages that the classifier is fitted on, about, and blocks that a page gives to it, at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2_000, 200
STEPS, RIDGE = 200, 1e-3
#: Most that the text of a block counts for, what hints count for, and smoothness at no distance in the tree.
TEXT_LIMIT, BOILERPLATE, CONTENT, LIKELY, SMOOTH = 2.0, -6.0, 4.0, 1.5, 0.8

# Names of HTML, and words that authors name containers by.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset("audio button canvas datalist head iframe math meter noframes noscript object option progress script select style svg template textarea title video".split())
RAW_TEXT = frozenset("script style textarea title iframe noframes noscript xmp".split())
BOILERPLATE_TAGS = frozenset("aside dialog footer form menu nav".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond respondent responses".split())
BOILERPLATE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs byline caption consent cookie cookies copyright disclaimer footer gdpr hidden legal login masthead "
    "menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popup privacy promo promoted promotion recommended related search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article blogpost body content entry main post story text".split())
NEGATIONS = frozenset("has no with without".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("article aside blockquote body details div dl fieldset figure footer form header main menu nav ol section table ul".split())


@dataclass(slots=True)
class Node:
    """An open element: its name, its parent, its number, what it says of its text, and characters of text below it."""

    tag: str
    parent: Node | None
    number: int
    depth: int
    hint: str = ""
    never: bool = False
    chars: int = 0


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int
    tag: str
    prior: float = 0.0
    label: int = field(default=-1)


def hint_of(tag: str, attributes: str) -> tuple[str, bool]:
    """What an element says: "comment", "boilerplate", "content", "likely" or nothing; and whether it is hidden."""
    words: list[str] = []
    role = hidden = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            for part in value.split():
                names = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", part))]
                words.extend(w for i, w in enumerate(names) if not (i and names[i - 1] in NEGATIONS))
        elif name == "role":
            role = value.strip().lower()
        elif name == "style":
            hidden = hidden or re.sub(r"\s", "", value.lower())
        elif name == "hidden" or value.lower() == "true":
            hidden = "display:none"
    if tag in ("html", "body"):
        return "", False
    unseen = "display:none" in hidden or "visibility:hidden" in hidden
    if COMMENT_WORDS.intersection(words):
        return "comment", unseen
    if tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or BOILERPLATE_WORDS.intersection(words) or tag != "header" and "header" in words and "content" not in words:
        return "boilerplate", unseen
    if tag == "header":
        return "header", unseen
    if tag in CONTENT_TAGS or role in CONTENT_TAGS:
        return "content", unseen
    return ("likely" if CONTENT_WORDS.intersection(words) else ""), unseen


def read_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, white space turned into single blanks, character references decoded."""
    top = here = Node("", None, 0, 0)
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = links = count = 0

    def close_block() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip() if pieces else ""
        if text:
            where = here
            while where.tag and where.tag not in BLOCK_TAGS:
                where = where.parent
            blocks.append(Block(where, text, linked, where.tag))
            up = where
            while up is not None:
                up.chars += len(text)
                up = up.parent
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if not here.never:
            pieces.append(text)
            if links:
                linked += len(text)

    at, page = 0, page or ""
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue
        tag, closing = name.lower(), bool(token[1] or token[4])
        attributes = (token[3] if token[2] else token[6]) or ""
        if tag in BLOCK_TAGS:
            close_block()
        elif tag == "br":
            add(" ")
        if tag == "a":
            links = 0 if closing else 1
        if closing:
            up = here
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                here = up.parent
            continue
        if tag in _CLOSES:  # an element that the next of its kind closes
            up = here
            while up.parent is not None and up.tag not in _SCOPES and up.tag not in _CLOSES[tag]:
                up = up.parent
            if up.parent is not None and up.tag in _CLOSES[tag]:
                here = up.parent
        elif tag in BLOCK_TAGS:  # a block ends a paragraph
            up = here
            while up.parent is not None and up.tag not in _SCOPES and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        count += 1
        hint, unseen = hint_of(tag, attributes)
        here = Node(tag, here, count, here.depth + 1, hint, here.never or unseen or tag in NEVER_TEXT)
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if tag in NEVER_TEXT:
                at = end.start() if end else len(page)
            elif end:
                add(html.escape(page[at : end.start()])), (at := end.start())
    if at < len(page):
        add(page[at:])
    close_block()
    for block in blocks:
        block.prior, block.label = _prior(block, top.chars)
    return blocks


def _prior(block: Block, total: int) -> tuple[float, int]:
    """Log-odds of content by the hints of the ancestors, and the label that they are sure of: 1, 0 or -1 for none."""
    likely, within, heading = False, False, block.tag[:1] == "h" and block.tag[1:].isdigit()
    up = block.node
    while up is not None:
        if up.hint == "comment":
            return BOILERPLATE, 0
        if up.hint == "header" and not (heading or within):
            inside = up.parent
            while inside is not None and inside.hint not in ("content", "likely"):
                inside = inside.parent
            if inside is None or inside.hint == "likely":
                return BOILERPLATE, 0
            return BOILERPLATE / 2, 0
        if up.hint == "boilerplate":
            # a container of more than half the page's text is a wrapper, unless it is what its tag says
            wrapper = 2 * up.chars > total and (up.tag == "form" or up.tag not in BOILERPLATE_TAGS)
            if not wrapper:
                return BOILERPLATE, 0
        within = within or up.hint == "content"
        likely = likely or up.hint == "likely"
        up = up.parent
    return (CONTENT, 1) if within else (LIKELY, -1) if likely else (0.0, -1)


FEATURES = 14


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block, of its own text and its neighbours'; no hint is among them."""
    n = len(blocks)
    rows = np.zeros((n, FEATURES))
    for i, b in enumerate(blocks):
        text = b.text
        words = text.count(" ") + 1
        rows[i, :9] = (
            math.log1p(words),
            min(b.linked / len(text), 1.0),
            text[-1] in ".!?:;\"'”»…",
            min((text.count(",") + text.count(". ") + text.count("? ")) / words, 1.0),
            min(len(text) / words, 20) / 10,
            b.tag[:1] == "h" and b.tag[1:].isdigit(),
            b.tag in ("li", "td", "th", "dd", "dt"),
            b.tag in ("p", "blockquote", "pre"),
            any(c in text for c in "©|»›•"),
        )
    if n:
        rows[1:, 9], rows[:-1, 10] = rows[:-1, 0], rows[1:, 0]
        rows[1:, 11], rows[:-1, 12] = rows[:-1, 1], rows[1:, 1]
        rows[:, 13] = 1
    return rows


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; zeros if a label is missing."""
    w = np.zeros(FEATURES)
    if not len(labels) or labels.min() == labels.max():
        return w
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weights * (labels - p)) / weights.sum() - RIDGE * w
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows / weights.sum() + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _fit_group(pages: pa.Table) -> pa.Table:
    rows, labels, weights = [], [], []
    for page in pages.column("html"):
        blocks = read_blocks(page.as_py())
        known = [i for i, b in enumerate(blocks) if b.label >= 0][:SAMPLE_BLOCKS]
        if known:
            rows.append(features(blocks)[known])
            labels.extend(blocks[i].label for i in known)
    y = np.array(labels, float)
    ones = max(y.sum(), 1.0)
    weights = np.where(y > 0, 1 / ones, 1 / max(len(y) - ones, 1.0)) * len(y)  # both labels count alike
    return pa.table({"weights": pa.array([fit(np.concatenate(rows) if rows else np.empty((0, FEATURES)), y, weights).tolist()], pa.list_(pa.float64()))})


def fit_blocks(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[float]:
    """Weights of a block's features, fitted on about `sample_pages` of the pages, chosen by a hash of html."""
    rows = pages.select(F.col("html").cast("string").alias("html"))
    total = rows.count()
    share = min(1.0, sample_pages / max(total, 1))
    chosen = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct()
    found = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_group, "weights array<double>").first()
    return list(found.weights) if found else [0.0] * FEATURES


def _distance(a: Node, b: Node) -> int:
    """Steps in the tree between two containers."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def network(blocks: list[Block], weights: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Log-odds of content of each block, and the smoothness edges (block, block, capacity)."""
    unary = np.clip(features(blocks) @ weights, -TEXT_LIMIT, TEXT_LIMIT) + np.array([b.prior for b in blocks])
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH / (1 + _distance(blocks[i - 1].node, b.node))))
        parent = (b.node.parent or b.node).number
        before = last.get(parent)
        if before is not None and before < i - 1:
            edges.append((before, i, SMOOTH / 2))
        last[parent] = i
    return unary, edges


def min_cut(unary: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes are on the source's side of a minimum cut: capacity unary from the source if positive, to the sink if
    negative, and that of each edge both ways. Of several minimum cuts, the one with the most nodes on the sink's side."""
    n = len(unary)
    power = unary.astype(float).copy()
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    side = np.full(n, -1)
    queue = deque(range(n))
    waiting = np.ones(n, bool)
    while queue:
        v = queue.popleft()
        waiting[v] = False
        if side[v] >= 0 or abs(power[v]) <= sum(near[v].values()):
            continue
        side[v] = int(power[v] > 0)
        for u, c in near[v].items():  # the label is known, so the edge is part of the neighbour's own capacity
            power[u] += c if side[v] else -c
            del near[u][v]
            if not waiting[u]:
                waiting[u] = True
                queue.append(u)
        near[v] = {}
    left = [v for v in range(n) if side[v] < 0]
    if left:
        inner = _source_side(left, power, near)
        for v in left:
            side[v] = int(v in inner)
    return side == 1


def _source_side(nodes: list[int], power: np.ndarray, near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow, by shortest augmenting paths from a layered search."""
    supply = {v: max(power[v], 0.0) for v in nodes}
    demand = {v: max(-power[v], 0.0) for v in nodes}
    room = {v: dict(near[v]) for v in nodes}
    tiny = 1e-12
    while True:
        level = {v: 0 for v in nodes if supply[v] > tiny}
        order, found = deque(level), False
        while order:
            v = order.popleft()
            found = found or demand[v] > tiny
            for u, c in room[v].items():
                if c > tiny and u not in level:
                    level[u] = level[v] + 1
                    order.append(u)
        if not found:
            return set(level)
        turn = {v: list(room[v]) for v in level}
        for start in [v for v in level if level[v] == 0]:
            path = [start]
            while path and supply[start] > tiny:
                v = path[-1]
                if demand[v] > tiny:
                    flow = min(supply[start], demand[v], *(room[a][b] for a, b in zip(path, path[1:], strict=False)))
                    supply[start] -= flow
                    demand[v] -= flow
                    cut = len(path)
                    for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        room[a][b] -= flow
                        room[b][a] += flow
                        if room[a][b] <= tiny:
                            cut = min(cut, i + 1)
                    del path[cut:]
                    continue
                while turn[v]:
                    u = turn[v][-1]
                    if room[v][u] > tiny and level.get(u, -1) == level[v] + 1:
                        path.append(u)
                        break
                    turn[v].pop()
                else:
                    path.pop()
                    if path:
                        turn[path[-1]].pop()


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The main text of a page: its content blocks in page order, an empty line between them."""
    blocks = read_blocks(page)
    if not blocks:
        return ""
    content = min_cut(*network(blocks, weights))
    return "\n\n".join(b.text for b, c in zip(blocks, content.tolist(), strict=True) if c)


def _extractor(weights: list[float]):
    """Held columns and html last, to held columns, text and n_chars."""

    @gives_back
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            texts = [main_text(x.as_py(), w) for x in batch.column(batch.num_columns - 1)]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    return extract


def extract_main_text(pages: DataFrame, weights: list[float] | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """`pages` with text and n_chars (code points) in place of html: the main text of each page.

    Fits the classifier on the pages unless `weights` of fit_blocks are given. Null, empty and blockless html has text
    "" and n_chars 0. Repeated rows are read each. Columns of pages that clash with the new ones are replaced, all
    others stay. An empty table gives no rows. A page is read whole, whatever its length.
    """
    if weights is None:
        weights = fit_blocks(pages, sample_pages)
    held = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(*by_place(held), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extractor(weights), held_schema(pages, held, "text string, n_chars bigint"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The same rows for pages whose article is all in one <article> of headings and paragraphs, as in the driver's tables.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', chr(38), 'g'), chr(160), ' '), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
