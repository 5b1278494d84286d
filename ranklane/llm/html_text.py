"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks with the elements they lie in. A logistic model of a block's features gives
probabilities p (content) and 1 - p (boilerplate); their negative logarithms are the capacities to the two
terminals. Neighbouring blocks, and consecutive blocks of the same container, get smoothness edges that
weigh less the farther apart they are in the tree. The minimum cut (max-flow) is the cheapest labelling: it decides the blocks
whose own features say little, by their neighbours. Blocks whose own costs outweigh all their edges keep their label in any
minimum cut and are settled before.

The model is fitted to the pages themselves: in a bounded sample (SAMPLE_PAGES pages of at most SAMPLE_CHARS characters,
SAMPLE_BLOCKS blocks of each), blocks that stand in a menu, footer, sidebar or the like are examples of boilerplate, and long
sentences without links within an article examples of content; the model then weighs all features for the other blocks.
What the sample doesn't show keeps its weight of PRIOR.

Elements that never show article text (scripts, styles, forms and the like) give no blocks. Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined by one space. Null html is
empty html: empty text. Pages are read whole; unclosed or misnested tags are tolerated; repeated rows give
repeated results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import bounded_batches
from ranklane.llm.linear import fit

#: Elements whose whole inside is dropped.
DROPPED = frozenset("script style noscript template head title svg math iframe object form select button textarea input option datalist audio video canvas map".split())
#: Of these, raw text: nothing inside is a tag.
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Features of a block; words is the logarithm of their number, links their share of the characters.
FEATURES = ("article", "main", "heading", "paragraph", "words", "sentence", "links", "nav", "footer", "header", "aside", "named", "named_content", "outside")
#: Weights in log-odds of content before anything is learned, and the constant.
PRIOR = (1.5, 1.0, 0.3, 0.8, 0.6, 0.4, -2.5, -3.5, -3.5, -3.0, -3.5, -3.5, 0.8, -1.5, -1.2)
#: Pages, characters of a page, and blocks of a page that the model is fitted to, at most; the smallest hashes of the key are taken.
SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_BLOCKS = 400, 100_000, 200
#: Class, id and role names that speak for boilerplate, and for content.
BAD_NAME = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side|menu|nav(?:bar|igation)?|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|replies|respond|disqus|widget|toolbar|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|search)(?=$|[\s_-]|\d)"
)
GOOD_NAME = re.compile(r"(?i)(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?=$|[\s_-]|\d)")
#: Smoothness of adjacent blocks in the same container; it halves with each step of distance in the tree.
SMOOTH = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class Element:
    """An open element: tag, parent, depth, and what it tells about the blocks inside."""

    __slots__ = ("tag", "parent", "depth", "dropped", "bad", "good", "marks")

    def __init__(self, tag: str, parent: Element | None, attrs: str) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = tag in DROPPED or bool(parent and parent.dropped)
        self.bad, self.good = bool(parent and parent.bad), bool(parent and parent.good)
        self.marks = parent.marks if parent else frozenset()
        if tag in ("nav", "menu", "footer", "header", "aside", "article", "main", "a"):
            self.marks = self.marks | {"nav" if tag == "menu" else tag}
        if attrs and not self.dropped:
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
            named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if named.strip() and tag not in ("html", "body", "article", "main"):
                self.bad = self.bad or bool(BAD_NAME.search(named))
                self.good = self.good or bool(GOOD_NAME.search(named))
            style = found.get("style", "").replace(" ", "").lower()
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
                self.dropped = True


class Block:
    """Consecutive text of one container."""

    __slots__ = ("text", "link_chars", "element")

    def __init__(self, text: str, link_chars: int, element: Element) -> None:
        self.text, self.link_chars, self.element = text, link_chars, element


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    top = Element("", None, "")
    now, parts, links, owner = top, [], 0, top

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, links, owner))
            parts, links = [], 0

    def add(text: str) -> None:
        nonlocal links, owner
        if text and not now.dropped:
            if not parts or (not "".join(parts).strip() and text.strip()):
                owner = now
            parts.append(text)
            if "a" in now.marks:
                links += len(text.strip())

    at = 0
    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if tag in BLOCK:
            flush()
        if m[1]:
            e = now
            while e is not top and e.tag != tag:
                e = e.parent
            if e is not top:
                now = e.parent
            continue
        if tag in SELF_CLOSING:
            e = now
            while e is not top and e.tag not in ("table", "ul", "ol", "dl", "div", "article", "section", "body"):
                if e.tag == tag:
                    now = e.parent
                    break
                e = e.parent
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            now = Element(tag, now, m[3])
    add(html[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """FEATURES of the blocks of a page."""
    has_article = any(b.element.marks & {"article", "main"} for b in found)
    out = np.zeros((len(found), len(FEATURES)))
    for row, b in zip(out, found, strict=True):
        e = b.element
        own = {tag: tag in e.marks for tag in ("article", "main", "nav", "footer", "header", "aside")}
        own |= {"heading": e.tag in HEADINGS, "paragraph": e.tag in ("p", "blockquote", "pre"), "named": e.bad, "named_content": e.good}
        own["words"] = min(4.0, math.log2(b.text.count(" ") + 1))
        own["sentence"] = b.text[-1] in ".!?\"'»”)"
        own["links"] = min(1.0, b.link_chars / len(b.text))
        own["outside"] = has_article and not e.marks & {"article", "main"}
        row[:] = [own[f] for f in FEATURES]
    return out


def examples(x: np.ndarray) -> np.ndarray:
    """1 for blocks that are surely content, 0 for sure boilerplate, -1 for others, by features."""
    at = {f: x[:, k] for k, f in enumerate(FEATURES)}
    bad = at["nav"] + at["footer"] + at["aside"] + at["header"] + at["named"] > 0
    good = ~bad & (at["article"] + at["main"] > 0) & (at["words"] >= 3) & (at["sentence"] > 0) & (at["links"] < 0.3)
    return np.where(bad, 0, np.where(good, 1, -1))


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of FEATURES and the constant from examples, near PRIOR where these say little; PRIOR where one kind is missing."""
    return tuple(fit(x, y, prior=np.array(PRIOR)).tolist()) if len(y) and 0 < y.sum() < len(y) else PRIOR


def learn(pages: DataFrame, html: str = "html") -> tuple[float, ...]:
    """Weights fitted to a bounded sample of ``pages``."""
    bounded_batches(pages.sparkSession)
    usable = pages.select("page_id", F.col(html).alias("html")).where(f"page_id IS NOT NULL AND length(html) <= {SAMPLE_CHARS}")
    ids = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    chosen = usable.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))

    def described(batches):
        for b in batches:
            rows = []
            for html in b.column(1).to_pylist():
                x = features(blocks(html))
                y = examples(x)
                rows += [(*v, float(k)) for v, k in zip(x[y >= 0][:SAMPLE_BLOCKS].tolist(), y[y >= 0][:SAMPLE_BLOCKS].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["row"])

    rows = np.array([r.row for r in chosen.mapInArrow(described, "row array<double>").collect()]).reshape(-1, len(FEATURES) + 1)
    rows = rows[np.lexsort(rows.T)]  # the same sums in any order of rows
    return fit_weights(rows[:, :-1], rows[:, -1])


def _distance(a: Element, b: Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def container(e: Element) -> Element:
    while e.parent is not None and (e.tag not in BLOCK or e.tag in SELF_CLOSING or e.tag in HEADINGS):
        e = e.parent
    return e


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between adjacent blocks, and between consecutive blocks of one container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            out[k - 1, k] = SMOOTH * 0.5 ** min(8, max(0, _distance(found[k - 1].element, b.element) - 2))
        own = id(container(b.element))
        if own in last and last[own] < k - 1:
            out[last[own], k] = SMOOTH / 2
        last[own] = k
    return out


def minimum_cut(odds: list[float], smooth: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling (True: content) that minimises own costs plus the edges it cuts.

    Ties go to content.
    """
    n = len(odds)
    cost = [(math.log1p(math.exp(-abs(x))) + max(0.0, -x), math.log1p(math.exp(-abs(x))) + max(0.0, x)) for x in odds]  # -log p, -log(1 - p)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (a, b), w in smooth.items():
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * n
    extra = [b - a for a, b in cost]  # what boilerplate costs more than content
    todo = deque(range(n))
    while todo:  # settle what no neighbour can turn, passing its weight on
        k = todo.popleft()
        if label[k] is None:
            free = sum(w for j, w in near[k] if label[j] is None)
            if abs(extra[k]) > free or (extra[k] >= 0 and not free):
                label[k] = extra[k] >= 0
                for j, w in near[k]:
                    if label[j] is None:
                        extra[j] += w if label[k] else -w
                        todo.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        at = {k: i + 2 for i, k in enumerate(rest)}
        flow: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
        for k in rest:
            s, t = (0, at[k]) if extra[k] > 0 else (at[k], 1)
            flow[s][t] = abs(extra[k])
            flow[t].setdefault(s, 0.0)
            for j, w in near[k]:
                if j in at and j > k:
                    flow[at[k]][at[j]] = flow[at[k]].get(at[j], 0.0) + w
                    flow[at[j]][at[k]] = flow[at[j]].get(at[k], 0.0) + w
        max_flow(flow, 0, 1)
        # boilerplate is what still reaches the sink, so that a tie is content
        back: list[list[int]] = [[] for _ in flow]
        for a, to in enumerate(flow):
            for b, c in to.items():
                if c > 1e-9:
                    back[b].append(a)
        seen, todo = {1}, deque([1])
        while todo:
            for a in back[todo.popleft()]:
                if a not in seen:
                    seen.add(a)
                    todo.append(a)
        for k in rest:
            label[k] = at[k] not in seen
    return [bool(x) for x in label]


def max_flow(cap: list[dict[int, float]], s: int, t: int) -> float:
    """Dinic's algorithm on residual capacities, in place: shortest paths of one length at a time, without recursion."""
    total = 0.0
    while True:
        level, todo = {s: 0}, deque([s])
        while todo:
            a = todo.popleft()
            for b, c in cap[a].items():
                if c > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    todo.append(b)
        if t not in level:
            return total
        left = {a: [b for b in cap[a] if level.get(b) == level[a] + 1] for a in level}  # steps not yet tried
        path = [s]
        while path:
            a = path[-1]
            if a == t:
                push = min(cap[x][y] for x, y in zip(path, path[1:]))
                total += push
                cutoff = 0
                for k, (x, y) in enumerate(zip(path, path[1:])):
                    cap[x][y] -= push
                    cap[y][x] = cap[y].get(x, 0.0) + push
                    if cap[x][y] <= 1e-9 and not cutoff:
                        cutoff = k + 1
                del path[cutoff:]
                continue
            while left[a] and cap[a][left[a][-1]] <= 1e-9:
                left[a].pop()
            if left[a]:
                path.append(left[a][-1])
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


def labelled(html: str | None, weights: tuple[float, ...] = PRIOR) -> tuple[list[Block], list[bool], np.ndarray]:
    """The blocks of a page, whether each is content, and each block's own log-odds of it."""
    found = blocks(html or "")
    odds = features(found) @ np.array(weights[:-1]) + weights[-1]
    return found, minimum_cut(odds.tolist(), edges(found)), odds


def main_text(html: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    found, labels, _ = labelled(html, weights)
    return " ".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def extract_text(pages: DataFrame, html: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row; the weights are fitted to the pages unless given."""
    weights = weights or learn(pages, html)
    bounded_batches(pages.sparkSession)

    def extracted(batches):
        for b in batches:
            texts = [main_text(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", F.col(html).alias("html")).mapInArrow(extracted, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
