"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, runs of text inside a block are
leaves. Every node has a hidden state, content or not. A node's own evidence (element,
names of its class and id, the section it is in, amount of text, share of link text,
punctuation, length of the texts around it) gives its unary potential, and a potential joins each child to its parent. Sum-product messages,
once upward and once downward, give the exact marginal of every node; leaves that are
more likely content than not are the text. The weights are trained on labelled pages
(``html_pages``) by the gradient of the exact likelihood, which needs the same messages.

Text of a block: character references decoded, white space runs one space, trimmed;
blocks are joined by a line feed in page order. Pages are independent, so a task reads
one after the other and nothing is shuffled.

Defined results: null and empty pages, and pages without content, give an empty text; a
page that is cut off anywhere is read to its end; repeated rows give repeated results;
null ids and urls are kept; an empty table gives no rows. Only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import table
from rivermark.llm.html_pages import labelled_pages
from rivermark.registry import query

# Fixed values of HTML: elements by how they are read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins-inline kbd label link mark meta nobr q rp rt ruby s samp "
    "small source span strike strong sub sup time track tt u var wbr".split()
)
SKIPPED = frozenset("script style title textarea iframe xmp noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that say what is below them, as far as the next of them.
SECTIONS = frozenset("article main nav aside footer header form menu dialog noscript figure blockquote table".split())
#: Elements that an opening tag closes first, up to the listed borders.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]+)*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_END = tuple(".!?:;\"'»”)…")


@dataclass(slots=True)
class Page:
    """Nodes in page order, parents first; a leaf has the index of its text."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    leaves: list[int] = field(default_factory=lambda: [-1])
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)


def _named(attributes: str) -> str:
    """The words in class, id and role, in order and once each."""
    if not attributes:
        return ""
    found = [w for _, value in _ATTRIBUTE.findall(attributes) for w in _PARTS.findall(value.lower())]
    return " ".join(dict.fromkeys(found))


def parse(source: str) -> Page:
    page, stack = Page(), [0]
    pieces: list[str] = []
    # The number of open blocks where the open link began; 0 outside of links.
    at, links, in_link, begin = 0, 0, 0, 0
    tags, names, parents, leaves = page.tags, page.names, page.parents, page.leaves

    def flush() -> None:
        nonlocal links
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html_module.unescape(raw) if "&" in raw else raw).split())
            if text:
                tags.append("#text")
                names.append("")
                parents.append(stack[-1])
                leaves.append(len(page.texts))
                page.texts.append(text)
                page.linked.append(links)
                page.places.append(begin)
            pieces.clear()
        links = 0

    while True:
        m = _TAG.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            if not pieces:
                begin = at
            part = source[at:end]
            pieces.append(part)
            if in_link:
                links += len(part)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE:
                in_link = in_link if name != "a" else 0
                continue
            flush()
            if name in SKIPPED:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    del stack[k:]
                    break
            # A link ends with the block it began in, if nothing closed it.
            in_link = in_link if in_link <= len(stack) else 0
            continue
        if name in SKIPPED:
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            continue
        if name in INLINE:
            if name == "a":
                in_link = len(stack)
            elif name == "br" and pieces:
                pieces.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSES:
            own, borders = CLOSES[name]
            cut = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in borders:
                    break
                if tags[stack[k]] in own:
                    cut = k
            del stack[cut:]
        elif len(stack) > 1 and tags[stack[-1]] == "p":
            stack.pop()
        tags.append(name)
        names.append(_named(m[3]))
        parents.append(stack[-1])
        leaves.append(-1)
        stack.append(len(tags) - 1)
    flush()
    return page


def _keys(page: Page) -> list[tuple]:
    """What is seen of each node: equal keys have equal features."""
    n = len(page.tags)
    words, chars, linked = [0] * n, [0] * n, [0] * n
    for v in range(n - 1, -1, -1):
        leaf = page.leaves[v]
        if leaf >= 0:
            words[v], chars[v], linked[v] = page.texts[leaf].count(" ") + 1, len(page.texts[leaf]), page.linked[leaf]
        p = page.parents[v]
        if p >= 0:
            words[p] += words[v]
            chars[p] += chars[v]
            linked[p] += linked[v]
    # What each node is inside of, and the length of the texts that stand beside a text.
    inside, beside = [""] * n, [0] * n
    for v in range(1, n):
        p = page.parents[v]
        inside[v] = page.tags[p] + "*" * bool(page.names[p]) if page.tags[p] in SECTIONS else inside[p]
        if page.leaves[v] >= 0 or page.tags[v] not in SECTIONS:
            beside[p] = max(beside[p], words[v])
    keys = []
    for v in range(n):
        p = page.parents[v]
        leaf = page.leaves[v]
        share = linked[v] / chars[v] if chars[v] else 0.0
        around = page.parents[p] if leaf >= 0 and p > 0 else p
        keys.append((
            page.tags[v], page.names[v], page.tags[p] if p >= 0 else "", min(words[v].bit_length(), 8),
            0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.8 else 3,
            leaf >= 0 and page.texts[leaf].endswith(_END), leaf >= 0 and "©" in page.texts[leaf],
            inside[v], min(beside[around].bit_length(), 6) if around >= 0 else 0,
        ))
    return keys


def _features(key: tuple) -> list[str]:
    tag, names, parent, size, share, ends, mark, inside, beside = key
    kind = "leaf" if tag == "#text" else "inner"
    return [
        f"{kind}", f"tag {tag}", f"tag {tag} named {names != ''}", f"in {tag} {parent}", f"{kind} size {size}", f"{kind} links {share}", f"{kind} inside {inside}",
        *([f"{kind} ends {ends}", f"size {size} ends {ends}", f"{parent} links {share}", f"{parent} beside {beside}", f"inside {inside} links {share}"] if kind == "leaf" else []),
        *(["mark"] if mark else []), *[f"name {w}" for w in names.split()],
    ]


@dataclass
class Model:
    weights: dict[str, float]
    #: Potentials of (parent, child) states as logs: both not, only child, only parent, both.
    joint: list[float]
    #: Unary potentials that are known already, by what is seen of a node.
    known: dict[tuple, float] = field(default_factory=dict)

    def unary(self, key: tuple) -> float:
        value = self.known.get(key)
        if value is None:
            value = sum(self.weights.get(f, 0.0) for f in _features(key))
            if len(self.known) < 200_000:
                self.known[key] = value
        return value


def _message(odds: float, a: float, b: float, c: float, d: float) -> float:
    """Log odds that a node with log odds ``odds`` sends over an edge with these potentials."""
    x = math.exp(odds if -30 < odds < 30 else math.copysign(30, odds))
    return math.log((c + d * x) / (a + b * x))


def marginals(parents: list[int], unary: list[float], joint: list[float]) -> tuple[list[float], list[float], list[float]]:
    """Log odds of every node; what it sent up; what its parent sent down."""
    n = len(parents)
    p00, p01, p10, p11 = map(math.exp, joint)
    up, sent, down = list(unary), [0.0] * n, [0.0] * n
    for v in range(n - 1, 0, -1):
        sent[v] = _message(up[v], p00, p01, p10, p11)
        up[parents[v]] += sent[v]
    odds = up
    for v in range(1, n):
        down[v] = _message(odds[parents[v]] - sent[v], p00, p10, p01, p11)
        odds[v] += down[v]
    return odds, sent, down


def _chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(pages: list[list[tuple[str, bool]]] | None = None, rounds: int = 20, rate: float = 0.5) -> Model:
    """Gradient steps on the likelihood of the labelled pages, with shrinking steps per weight."""
    examples = []
    for runs in labelled_pages() if pages is None else pages:
        source, spans = "", []
        for part, content in runs:
            spans.append((len(source), len(source) + len(part), content))
            source += part
        page = parse(source)
        n = len(page.tags)
        good, total = [0] * n, [0] * n
        for v in range(n - 1, -1, -1):
            leaf = page.leaves[v]
            if leaf >= 0:
                place = page.places[leaf]
                total[v] = len(page.texts[leaf])
                good[v] = total[v] * any(content for a, b, content in spans if a <= place < b)
            if v:
                good[page.parents[v]] += good[v]
                total[page.parents[v]] += total[v]
        states = [2 * g > t for g, t in zip(good, total)]
        examples.append((page.parents, [_features(k) for k in _keys(page)], states))
    model, squares = Model({}, [0.5, -0.5, -0.5, 0.5]), {}
    for _ in range(rounds):
        for parents, features, states in examples:
            unary = [sum(model.weights.get(f, 0.0) for f in fs) for fs in features]
            odds, sent, down = marginals(parents, unary, model.joint)
            slope: dict = {}
            for v, fs in enumerate(features):
                miss = states[v] - _chance(odds[v])
                for f in fs:
                    slope[f] = slope.get(f, 0.0) + miss
                if v:
                    a, b = odds[parents[v]] - sent[v], odds[v] - down[v]
                    logs = [model.joint[2 * x + y] + x * a + y * b for x in (0, 1) for y in (0, 1)]
                    top = max(logs)
                    each = [math.exp(x - top) for x in logs]
                    for k in range(4):
                        slope[k] = slope.get(k, 0.0) + (2 * states[parents[v]] + states[v] == k) - each[k] / sum(each)
            for f, g in slope.items():
                now = model.joint[f] if isinstance(f, int) else model.weights.get(f, 0.0)
                g -= 0.01 * now
                squares[f] = squares.get(f, 1e-6) + g * g
                now += rate * g / math.sqrt(squares[f])
                if isinstance(f, int):
                    model.joint[f] = now
                else:
                    model.weights[f] = now
    return model


def main_text(source: str, model: Model) -> str:
    page = parse(source)
    if not page.texts:
        return ""
    unary = [model.unary(k) for k in _keys(page)]
    odds, _, _ = marginals(page.parents, unary, model.joint)
    return "\n".join(page.texts[leaf] for v, leaf in enumerate(page.leaves) if leaf >= 0 and odds[v] > 0)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    trained = train() if model is None else model
    weights, joint = trained.weights, trained.joint

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, joint)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x, own) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_html_extraction")
def op3_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
