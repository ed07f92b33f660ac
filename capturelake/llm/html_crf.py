"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks, the runs of text between block-level tags, each with its open elements. Features
are the ancestor tags, whether the nearest telling ancestor names page furniture, and shape of the text; the chain has
two labels. Training pages are labelled by the publisher's own markup: a block belongs to the article if it stands in an
article or main element and not in furniture inside it. The features leave that markup out, as they do plain containers
(div, section), so the model has to tell articles by the rest and works on pages without it. Weights are fitted to at
most `max_pages` pages in hash order by maximum likelihood; each page is decoded by Viterbi. Character references are
decoded, white space inside a block (no-break spaces too) becomes one space, blocks are joined by a line feed. Without
training pages or blocks the text is empty. Null html counts as empty. Work is linear in a page's length and nesting.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import base_columns, hash_sample

MAX_PAGES = 400
#: Fixed sets of element names.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noframes ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas", "math")
CONTENT = frozenset({"article", "main"})
#: Elements that say nothing of their own, and those that the labels come from.
CONTAINERS = frozenset("article main div section center body html".split())
ASIDE = frozenset("nav aside footer form menu dialog head title button label fieldset".split())
#: Words of class, id and role that name page furniture, or the article.
FURNITURE = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
BODY = frozenset("article articlebody content entry main maincontent post postbody postcontent story".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
#: Elements that end an open element of the same set.
_CLOSES = {"p": BLOCK - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"}}


def _role(name: str, attributes: str, inside: str) -> str:
    """What an element says about its text: 'main', 'side' or, without a say, what its parent says."""
    words = {w for m in _NAMES.finditer(attributes) for g in m.groups() if g for w in _SPLIT.split(g.lower())} if "=" in attributes else ()
    if name in ASIDE or FURNITURE.intersection(words):
        return "side"
    if name == "header":
        return inside if inside == "main" else "side"
    if name in CONTENT or BODY.intersection(words):
        return "side" if inside == "side" else "main"
    return inside


def leaf_blocks(source: str) -> list[tuple[str, tuple[str, ...], str, float]]:
    """(text, ancestor tags, role, share of characters in links) of every leaf block with text, in page order."""
    blocks: list[tuple[str, tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []  # name, role
    opened: dict[str, int] = {}  # how often a name is in the stack
    around: list[str] = []  # its block-level names, each once
    levels: list[int] = []  # places of block-level elements in the stack
    parts: list[str] = []
    linked = 0
    origin: tuple[tuple[str, ...], str] = ((), "none")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, *origin, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked, origin
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            if not text or text.isspace():
                return
            origin = tuple(around), stack[-1][1] if stack else "none"
        parts.append(text)
        if opened.get("a"):
            linked += len(text)

    def push(name: str, role: str) -> None:
        opened[name] = opened.get(name, 0) + 1
        if name in BLOCK:
            levels.append(len(stack))
            if opened[name] == 1:
                around.append(name)
        stack.append((name, role))

    def cut(place: int) -> None:
        while len(stack) > place:
            name = stack.pop()[0]
            opened[name] -= 1
            if name in BLOCK:
                levels.pop()
                if not opened[name]:
                    around.pop()

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            if opened.get(name):
                place = len(stack) - 1
                while stack[place][0] != name:
                    place -= 1
                cut(place)
            continue
        if name in _ENDS:
            if not m[3].rstrip().endswith("/"):
                end = _ENDS[name].search(source, at)
                at = end.end() if end else size
            continue
        if name in BLOCK:
            flush()
            for place in reversed(levels):
                outer = stack[place][0]
                if name in _CLOSES.get(outer, ()):
                    cut(place)
                    break
                if outer not in _CLOSES:
                    break
        elif name == "br":
            if parts:
                parts.append(" ")
            continue
        if name not in VOID and not m[3].endswith("/"):
            push(name, _role(name, m[3], stack[-1][1] if stack else "none"))
    flush()
    return blocks


def features(blocks: list[tuple[str, tuple[str, ...], str, float]]) -> list[list[str]]:
    out = []
    for i, (text, tags, role, linked) in enumerate(blocks):
        n = len(text)
        f = ["bias", f"size={min(int(math.log2(n)), 10)}", f"links={int(linked * 3.99)}", f"stops={min(sum(map(text.count, '.,;:?!')) * 20 // n, 3)}"]
        f += [f"tag={t}" for t in tags if t not in CONTAINERS]
        if role == "side":
            f.append("furniture")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        if "©" in text[:40]:
            f.append("copyright")
        out.append(f)
    return out


class Crf:
    """Two labels, one weight per feature (for label 1) and one per transition."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.2, decay: float = 1e-3) -> Crf:
        """Gradient ascent (Adam) on the penalised log-likelihood, all pages side by side, padded at the end."""
        pages = [p for p in pages if p[0]]
        index = {f: i for i, f in enumerate(sorted({f for x, _ in pages for fs in x for f in fs}))}
        if not pages or not index:
            return cls({}, np.zeros((2, 2)))
        flat = [(p, t, index[f]) for p, (x, _) in enumerate(pages) for t, fs in enumerate(x) for f in fs]
        page, time, feat = map(np.array, zip(*flat, strict=True))
        n, length = len(pages), max(len(x) for x, _ in pages)
        label, live = np.zeros((n, length), int), np.zeros((n, length), bool)
        for p, (_, y) in enumerate(pages):
            label[p, : len(y)], live[p, : len(y)] = y, True
        theta, m, v = np.zeros(len(index) + 4), 0.0, 0.0
        both = live[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:, :-1][both], label[:, 1:][both]), 1)
        total = live.sum()
        for step in range(1, rounds + 1):
            unary, moves = np.zeros((n, length, 2)), theta[-4:].reshape(2, 2)
            np.add.at(unary[:, :, 1], (page, time), theta[feat])
            ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            ahead[:, 0] = unary[:, 0]
            for t in range(1, length):
                x = ahead[:, t - 1, :, None] + moves[None]
                ahead[:, t] = np.where(live[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + unary[:, t], ahead[:, t - 1])
            norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            for t in range(length - 2, -1, -1):
                x = moves[None] + (unary[:, t + 1] + behind[:, t + 1])[:, None, :]
                behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp(x[..., 0], x[..., 1]), 0.0)
            on = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None]) * live
            pair = ahead[:, :-1, :, None] + moves[None, None] + (unary + behind)[:, 1:, None, :] - norm[:, None, None, None]
            expected = (np.exp(np.minimum(pair, 0.0)) * both[:, :, None, None]).sum((0, 1))
            grad = np.zeros(len(theta))
            np.add.at(grad, feat, (label * live - on)[page, time])
            grad[-4:] = (seen - expected).ravel()
            grad = grad / total - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls({f: float(theta[i]) for f, i in index.items()}, theta[-4:].reshape(2, 2).copy())

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); a tie takes label 0."""
        if not rows or not self.weights:
            return [0] * len(rows)
        (aa, ab), (ba, bb) = self.moves.tolist()
        get, back = self.weights.get, []
        x, y = 0.0, sum(get(f, 0.0) for f in rows[0])
        for fs in rows[1:]:
            s = sum(get(f, 0.0) for f in fs)
            to_x, to_y = (x + aa, 0) if x + aa >= y + ba else (y + ba, 1), (x + ab, 0) if x + ab >= y + bb else (y + bb, 1)
            back.append((to_x[1], to_y[1]))
            x, y = to_x[0], to_y[0] + s
        path = [int(y > x)]
        for pair in reversed(back):
            path.append(pair[path[-1]])
        return path[::-1]


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Crf:
    """pages: page_id, html. Pages whose markup names an article, at most `max_pages` of them, come to the driver as features."""
    some = hash_sample(pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")), "page_id", max_pages)

    def run(batches):
        for batch in batches:
            found = [leaf_blocks(h or "") for h in batch.column("html").to_pylist()]
            x = [features(b) for b in found]
            y = [[int(role == "main" and not CONTENT.isdisjoint(tags)) for _, tags, role, _ in b] for b in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.list_(pa.string()))), pa.array(y, pa.list_(pa.int32()))], ["x", "y"])

    return Crf.fit([(r.x, r.y) for r in some.mapInArrow(run, "x array<array<string>>, y array<int>").collect()])


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_blocks, n_kept."""
    rows = base_columns(pages, {"page_id": "long", "url": "string", "html": "string"})
    model = rows.sparkSession.sparkContext.broadcast(train(rows, max_pages))

    def run(batches):
        for batch in batches:
            out = []
            for source in batch.column("html").to_pylist():
                blocks = leaf_blocks(source or "")
                kept = [b[0] for b, y in zip(blocks, model.value.decode(features(blocks)), strict=True) if y]
                text = "\n".join(kept)
                out.append((text, len(text), len(blocks), len(kept)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
