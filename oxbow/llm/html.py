"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text in page order and the elements around them, all nodes of a graph.

- Terminals. A linear classifier scores a block from its text alone: length, links, punctuation, heading.
  Its log odds, within +-SURE, are the block's capacity from the source (content) or to the sink
  (boilerplate). Elements whose kind, role or names tell something (an article, a menu, a comment
  list) have a capacity too: what they and the elements around them tell, once for each block that
  they are the nearest to tell of.
- Smoothness. A block is tied to its element, an element to the one around it as strongly as it holds
  blocks (weakly if it tells something itself), and neighbours in the page to each other, the weaker
  the more steps lie between them in the element tree.
- The maximum flow's cut labels every node: what the source still reaches is content. So a short line
  stays in an article although its text alone looks like boilerplate, and a long comment goes.

The classifier's weights are fitted by logistic regression on all pages: blocks inside telling elements
are its labels. What is gathered for that is a count per combination of its few discrete features, so
its size is fixed. With few labels, or none, the weights stay near DEFAULT (a normal prior).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.llm.caches import tidy

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|([^<]+)", re.DOTALL)
#: Where quotes don't balance, a tag ends at the next `>`.
LOOSE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
NAME = re.compile(r"[a-z]+")
#: Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text of a page: code, titles of heads and drawings, other pages, controls of forms.
RAW = frozenset("script style template textarea title iframe select head".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What elements tell, in units of log odds.
AWAY = -8.0
WITHIN = 3.0
KIND = {"nav": AWAY, "footer": AWAY, "aside": AWAY, "form": AWAY, "menu": AWAY, "dialog": AWAY, "button": AWAY, "header": AWAY, "noscript": AWAY / 2, "article": WITHIN, "main": WITHIN / 2}
ROLES = {"navigation": AWAY, "banner": AWAY, "contentinfo": AWAY, "complementary": AWAY, "search": AWAY, "dialog": AWAY, "alert": AWAY, "alertdialog": AWAY, "form": AWAY, "menu": AWAY, "main": WITHIN / 2, "article": WITHIN}
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown feedback foot footer gdpr legal login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended register related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
CONTENT_NAMES = frozenset("article content entry post story main maintext articlebody body text".split())
#: Weights of the classifier before it is fitted: bias, length, sentence, heading, linked share.
DEFAULT = (-0.6, 1.1, 0.8, 0.6, -6.0)
#: The most that a block's own text says for or against it.
SURE = 3.0
#: Labelled blocks of a class count as this many at most against the prior, of precision STIFF.
EVIDENCE, STIFF = 1000.0, 1.0
#: Ties: of a block to its element; of an element to the one around it, for each block in it below a telling one,
#: once where nothing tells, for each block if it tells something itself.
TIE, NEST, PLAIN, LOOSE_NEST = 6.0, 4.0, 0.6, 0.5
ADJACENT, FADE = 1.5, 0.75
#: Steps in the element tree beyond which neighbours aren't tied.
FAR = 12


def name_score(kind: str, attributes: str) -> float:
    """What an element says about the text in it."""
    score = KIND.get(kind, 0.0)
    if attributes and not attributes.isspace():
        for key, a, b, c, bare in ATTRIBUTE.findall(attributes):
            key, value = (key or bare).lower(), unescape(a or b or c).lower()
            if key in ("class", "id"):
                names = set(NAME.findall(value))
                if names & BOILER_NAMES and kind not in ("body", "html"):
                    score += AWAY
                elif names & CONTENT_NAMES:
                    score += WITHIN / 3
            elif key == "role":
                score += ROLES.get(value, 0.0)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                score += 2 * AWAY
    return score


_scores: dict[tuple[str, str], float] = {}


def element_score(kind: str, attributes: str) -> float:
    """name_score, remembered: pages of a site repeat their elements."""
    if len(attributes) > 200:
        return name_score(kind, attributes)
    key = (kind, attributes)
    if (known := _scores.get(key)) is None:
        if len(_scores) > 50_000:
            _scores.clear()
        known = _scores[key] = name_score(kind, attributes)
    return known


class Place:
    """An element of the tree that is a block, or that tells something; score: what it and those around it tell."""

    __slots__ = ("above", "depth", "score", "teller", "held", "owned", "node")

    def __init__(self, above: "Place | None", score: float, tells: bool) -> None:
        self.above, self.depth, self.score = above, 0 if above is None else above.depth + 1, score
        self.teller = self if tells else None if above is None else above.teller
        self.held = self.owned = 0
        self.node = -1

    def steps_to(self, other: "Place") -> int:
        """Steps between two elements, FAR at most."""
        a, b, steps = self, other, 0
        while a is not b and steps < FAR:
            if a.depth >= b.depth:
                a = a.above
            else:
                b = b.above
            steps += 1
        return steps


class Block:
    __slots__ = ("text", "linked", "place", "heading")

    def __init__(self, text: str, linked: int, place: "Place", heading: bool) -> None:
        self.text, self.linked, self.place, self.heading = text, linked, place, heading

    def features(self) -> tuple[int, int, int, int]:
        """Twice the binary logarithm of the length, sentence, heading, quarters of the text in links."""
        n = len(self.text)
        return min(int(2 * log2(1 + n / 40)), 23), int(self.text[-1] in ".!?…。”\""), int(self.heading), round(4 * self.linked / n)

    def label(self) -> int:
        """1 or 0 where the elements around it tell content or boilerplate, else -1."""
        score = self.place.score
        return 1 if score >= WITHIN else 0 if score <= AWAY + WITHIN else -1


def log_odds(features: tuple[int, int, int, int], weights: tuple[float, ...]) -> float:
    """Of content, by the text of a block alone."""
    size, sentence, heading, linked = features
    score = weights[0] + weights[1] * size / 2 + weights[2] * sentence + weights[3] * heading + weights[4] * linked / 4
    return max(-SURE, min(SURE, score))


def fit(counts: list[tuple[int, int, int, int, int, int]]) -> tuple[float, ...]:
    """Weights from rows (size, sentence, heading, linked, label, times): logistic regression about DEFAULT by Newton's steps, both classes alike in weight."""
    table = np.array(sorted(counts), float).reshape(-1, 6)
    label, times = table[:, 4], table[:, 5]
    totals = [times[label == k].sum() for k in (0, 1)]
    if not all(totals):
        return DEFAULT
    weight = times * np.where(label == 1, min(totals[1], EVIDENCE) / totals[1], min(totals[0], EVIDENCE) / totals[0])
    x = np.column_stack([np.ones(len(table)), table[:, 0] / 2, table[:, 1], table[:, 2], table[:, 3] / 4])
    prior = w = np.array(DEFAULT)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + STIFF * (w - prior)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + STIFF * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return tuple(round(float(v), 6) for v in w)


def blocks_of(html: str) -> tuple[list[Block], list[Place]]:
    """The non-empty blocks of text in page order, and the elements, each after the one around it."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    stack: list[tuple[str, float, bool]] = []  # open elements: kind, what it tells, whether it is a place
    open_kinds: dict[str, int] = {}
    place = Place(None, 0.0, False)
    places = [place]
    score, within, heading = 0.0, 0, False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), place, heading))
            parts = []
        linked = 0

    def shut(depth: int) -> None:
        """Close all elements from `depth` on."""
        nonlocal place, score, links, within, heading
        if any(kind in BLOCKS for kind, _, _ in stack[depth:]):
            flush()
        for kind, own, placed in reversed(stack[depth:]):
            score -= own
            open_kinds[kind] -= 1
            if placed:
                place = place.above
            if kind == "a":
                links -= 1
            elif kind == "article":
                within -= 1
            elif kind in HEADINGS:
                heading = False
        del stack[depth:]

    def close_back(kinds: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in kinds:
                shut(k)
                return
            if stack[k][0] in stop:
                return

    at, last, match = 0, html.rfind(">"), TOKEN.match
    while at < len(html):
        if at > last:  # no tag ends here any more
            parts.append(html[at:])
            break
        found = match(html, at)
        if found is None:
            match = LOOSE.match
            continue
        at = found.end()
        closing, kind, attributes, text = found.groups()
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if kind is None:
            continue
        kind = kind.lower()
        if closing:
            if kind in BLOCKS:
                flush()
            if open_kinds.get(kind):
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == kind))
            continue
        if kind in RAW and not attributes.endswith("/"):
            # without an end it reaches to the next block; a head without one holds no text itself
            gone = RAW_END[kind].search(html, at)
            if gone:
                at = gone.end()
            elif kind != "head":
                begin = BLOCK_START.search(html, at)
                at = begin.start() if begin else len(html)
            parts.append(" ") if kind not in ("script", "style", "head") else None
            continue
        if kind in VOID:
            if kind in BLOCKS:
                flush()
            elif kind == "br":
                parts.append(" ")
            continue
        if kind in BLOCKS:
            flush()
            close_back(P, NOT_P)
        if kind in CLOSES:
            close_back(*CLOSES[kind])
        if kind in ("td", "th"):
            parts.append(" ")
        own = element_score(kind, attributes)
        if kind == "header" and within:
            own -= KIND["header"]
        elif kind == "article":
            own = own if not within else own - WITHIN
            within += 1
        elif kind == "a":
            links += 1
        elif kind in HEADINGS:
            heading = True
        score += own
        placed = kind in BLOCKS or own != 0
        if placed:
            place = Place(place, score, own != 0)
            places.append(place)
        stack.append((kind, own, placed))
        open_kinds[kind] = open_kinds.get(kind, 0) + 1
    flush()
    return blocks, places


P = frozenset(["p"])
NOT_P = BLOCKS - P
RAW_END = {kind: re.compile(rf"</{kind}[^>]*>", re.IGNORECASE) for kind in RAW}
BLOCK_START = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.IGNORECASE)


def graph_of(blocks: list[Block], places: list[Place], weights: tuple[float, ...]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the nodes (blocks first, then the elements that hold any) and the smoothness edges."""
    costs = [log_odds(b.features(), weights) for b in blocks]
    for b in blocks:
        b.place.held += 1
        if b.place.teller is not None:
            b.place.teller.owned += 1
    for p in reversed(places):
        if p.held and p.above is not None:
            p.above.held += p.held
    edges = []
    for p in places:
        if p.held:
            p.node = len(costs)
            costs.append(p.score * p.owned)
            if p.above is not None:
                edges.append((p.above.node, p.node, PLAIN if p.teller is None else (LOOSE_NEST if p.teller is p else NEST) * p.held))
    for i, b in enumerate(blocks):
        edges.append((i, b.place.node, TIE))
        if i:
            steps = blocks[i - 1].place.steps_to(b.place)
            if steps < FAR:
                edges.append((i - 1, i, ADJACENT * FADE**steps))
    return costs, edges


def cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (Dinic's maximum flow).

    costs: capacity from the source if positive, to the sink if negative.
    """
    n = len(costs)
    heads: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, w in edges:
        heads[i].append(len(to))
        heads[j].append(len(to) + 1)
        to += [j, i]
        room += [w, w]
    excess, need = [max(0.0, c) for c in costs], [max(0.0, -c) for c in costs]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if excess[i] > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            reached |= need[i] > tiny
            for e in heads[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for source in range(n):
            while excess[source] > tiny:
                # walk down the levels to a node that can drain, then push along the walk
                walk, node = [], source
                while need[node] <= tiny:
                    while turn[node] < len(heads[node]):
                        e = heads[node][turn[node]]
                        if room[e] > tiny and level[to[e]] == level[node] + 1:
                            break
                        turn[node] += 1
                    else:
                        if not walk:
                            node = -1
                            break
                        e = walk.pop()
                        node = to[e ^ 1]
                        turn[node] += 1
                        continue
                    walk.append(e)
                    node = to[e]
                if node < 0:
                    break
                push = min(excess[source], need[node], *(room[e] for e in walk)) if walk else min(excess[source], need[node])
                excess[source] -= push
                need[node] -= push
                for e in walk:
                    room[e] -= push
                    room[e ^ 1] += push


def main_text(html: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    """The content blocks, joined by empty lines; '' if there are none."""
    blocks, places = blocks_of(html or "")
    if not blocks:
        return ""
    kept = cut(*graph_of(blocks, places, weights))
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=False) if k)


@tidy
def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, sentence, heading, linked, label, times) of the labelled blocks of the pages (html)."""
    names = ["size", "sentence", "heading", "linked", "label", "times"]
    for batch in batches:
        times: Counter = Counter()
        for html in batch.column(0):
            for b in blocks_of(html.as_py() or "")[0]:
                if (label := b.label()) >= 0:
                    times[(*b.features(), label)] += 1
        rows = [(*k, n) for k, n in times.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)


def fit_costs(df: DataFrame, html_col: str = "html") -> tuple[float, ...]:
    """The classifier's weights for these pages, all of them; at most 24 * 2 * 2 * 5 * 2 counts reach the driver."""
    found = df.select(F.col(f"`{html_col}`").alias("html")).mapInArrow(count_features, "size long, sentence long, heading long, linked long, label long, times long")
    keys = ["size", "sentence", "heading", "linked", "label"]
    return fit([tuple(r) for r in found.groupBy(*keys).agg(F.sum("times").alias("times")).collect()])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """id_col, url, text, n_chars for every row of `df`; two passes over the pages, no shuffle of them (one pass with given weights).

    The whole html is read, however long; null html is empty, and a page without content has text ''. An element of
    RAW without an end tag ends at the next block. Null ids and urls, repeated rows, and other columns of any name
    are fine; an empty table gives an empty result.
    """
    costs = weights or fit_costs(df, html_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), costs) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    source = df.select(*(F.col(f"`{c}`") for c in (id_col, url_col, html_col)))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
