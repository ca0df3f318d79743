"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes blocks of text between block-level tags. A logistic classifier, fitted on pages that training_pages() writes, gives each
block the cost of either label: its capacities to the two terminals. Edges between neighbours in page order and between blocks near to
each other in the tree (fewer steps, larger capacity) make labels smooth. The minimum cut, found by maximum flow after blocks whose label
no edge can change are settled, separates content from boilerplate.

Defined cases: null, empty and tagless pages are allowed (a null page has no text); cut-off pages end where they end, an unfinished tag
is dropped, an unfinished character reference stays as it is; pages of any length and depth take memory in proportion to their size;
blocks keep their order; repeated rows are treated each; an empty table gives an empty result; input columns come back inside `row`.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import ship

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_words = lambda s: frozenset(s.split())
BLOCK = _words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Elements whose text is never shown as running text.
SILENT = _words("script style noscript template svg math iframe object canvas head title textarea select button datalist audio video")
RAW = _words("script style textarea title")
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {"p": BLOCK, "li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "td": _words("td th tr tbody tfoot"), "th": _words("td th tr tbody tfoot"), "tr": _words("tr tbody tfoot"), "head": _words("body")}
AROUND = _words("nav header footer aside form menu dialog")
AROUND_NAMES = _words(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget related recommended recommendations "
    "share sharing social footer foot header masthead topbar cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup login comment comments disqus "
    "reply replies respond reader readers pagination pager copyright legal toolbar skip tags meta byline hidden form search contentinfo complementary"
)
MAIN_NAMES = _words("article content contents post entry main story body text maintext articlebody postbody")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
UNSEEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
HEADING = re.compile("h[1-6]")
IN_AROUND, IN_NAMED, IN_MAIN, IN_LINK, IN_SILENT = 1, 2, 4, 8, 16


def _marks(tag: str, attributes: str) -> int:
    found = IN_AROUND * (tag in AROUND) | IN_MAIN * (tag in ("article", "main")) | IN_LINK * (tag == "a") | IN_SILENT * (tag in SILENT)
    if attributes and "=" in attributes or "hidden" in attributes:
        names = {x.lower() for m in NAMES.findall(attributes) for x in re.split(r"[^a-zA-Z0-9]+", "".join(m))}
        if names & AROUND_NAMES or UNSEEN.search(NAMES.sub("", attributes)):
            found |= IN_NAMED
        elif names & MAIN_NAMES:
            found |= IN_MAIN
    return found


class Block(NamedTuple):
    """A text block: its text, the tag around it, marks, letters inside links, the number of the element around its block element, and the
    steps in the tree from the block before."""

    text: str
    tag: str
    marks: int
    linked: int
    parent: int
    steps: int


class Open(NamedTuple):
    """An open element: its tag, marks, the number and depth of its block element (itself, if it is one), that element's parent, and the
    places on the stack of the nearest block element and of the nearest one that a begin tag may end."""

    tag: str
    marks: int
    number: int
    depth: int
    parent: int
    block: int
    ends: int


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. An element costs the same however deep it lies."""
    out: list[Block] = []
    stack = [Open("", 0, 0, 0, 0, 0, 0)]
    places: dict[str, list[int]] = {}  # of open elements on the stack, by tag
    text: list[str] = []
    linked = at = number = low = before = 0  # low: the least depth since the block before, whose depth is before

    def close(place: int) -> None:
        nonlocal low
        for e in reversed(stack[place:]):
            places[e.tag].pop()
        del stack[place:]
        low = min(low, stack[-1].depth)

    def end() -> None:
        nonlocal linked, low, before
        if text:
            if joined := " ".join("".join(text).split()):
                top = stack[-1]
                out.append(Block(joined, stack[top.block].tag, top.marks, linked, top.parent, before + top.depth - 2 * low))
                low = before = top.depth
            text.clear()
        linked = 0

    def add(a: int, b: int) -> None:
        nonlocal linked
        if a < b and not stack[-1].marks & IN_SILENT:
            text.append(html.unescape(page[a:b]))
            if stack[-1].marks & IN_LINK:
                linked += len(text[-1].strip())

    size, search = len(page), TOKEN.search
    while at < size and (m := search(page, at)):
        add(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        block = tag in BLOCK
        if tag == "br":
            text.append(" ")
        if block:
            end()
        if closing:
            if (found := places.get(tag)) and (block or found[-1] > stack[-1].block):
                close(found[-1])
            continue
        if tag in VOID or tag == "head" and places.get("head"):
            continue
        place = stack[-1].ends
        if stack[place].tag == "head" and tag not in ENDS["head"]:
            place = stack[place].block
        if tag in ENDS.get(stack[place].tag, ()):
            close(place)
        attributes = m[3] if m[2] else m[6]
        if attributes.endswith("/") and not block:
            continue
        top, place = stack[-1], len(stack)
        number += block
        own = (number, top.depth + 1, top.number) if block else (top.number, top.depth, top.parent)
        stack.append(Open(tag, top.marks | _marks(tag, attributes), *own, place if block else top.block, place if block or tag in ENDS else top.ends))
        places.setdefault(tag, []).append(place)
        if tag in RAW:
            end_of = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end_of.start() if end_of else size
    add(at, size)
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    rows = []
    for text, tag, marks, linked, _, _ in found:
        words = text.count(" ") + 1
        rows.append((
            1.0, math.log1p(words), linked / len(text), bool(marks & IN_AROUND), bool(marks & IN_NAMED), bool(marks & IN_MAIN), tag == "p", tag in ("li", "dt", "dd", "td", "th"),
            HEADING.fullmatch(tag) is not None, text[-1] in ".!?…:;\"'”»)", "©" in text or "·" in text or "|" in text, text.count(",") > 1,
        ))
    return np.array(rows, np.float64)


def training_pages(n: int = 300, seed: int = 7) -> Iterator[str]:
    """Pages of invented words in several layouts; blocks of content contain the letter of MARKED, others don't."""
    r = random.Random(seed)
    syllables = "ka lo mi ten ra so ve du pin gor ash el um bri tor".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: some(2, 18).capitalize() + r.choice(("", ",", ", " + some(2, 6))) + "."
    links = lambda: "".join(f'<li><a href="/">{some(1, 2)}</a></li>' for _ in range(r.randint(2, 8)))
    named = lambda name, inner: f'<div class="{name}">{inner}</div>'
    for _ in range(n):
        before = [f"<nav><ul>{links()}</ul></nav>", named("menu", f"<ul>{links()}</ul>"), f"<header><h1>{some(1, 4)}</h1><p>{sentence()}</p></header>", named("ad", sentence()), named("cookie-notice", f"<p>{sentence()} {sentence()}</p>"), f"<ul>{links()}</ul>", f"<div>{some(1, 2)} | {some(1, 2)}</div>"]
        after = [f"<footer>© {some(1, 3)} · {sentence()}</footer>", f"<aside><h3>{some(1, 2)}</h3><ul>{links()}</ul></aside>", named("sidebar", f"<p>{sentence()}</p>"), named("related", f"<ul>{links()}</ul>"), f"<form><p>{some(1, 4)}</p><input></form>", named("comments", "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(r.randint(1, 5)))), f"<div>© {some(2, 5)}</div>", named("newsletter", f"<p>{sentence()}</p>")]
        inside = [named("ad", sentence()), f"<aside>{sentence()}</aside>", named("share", some(1, 3))]
        body = [f"<h1>{MARKED}{some(1, 9)}</h1>"]
        for _ in range(r.randint(1, 14)):
            text = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 6))))
            body.append(r.choice((f"<p>{MARKED}{text}</p>",) * 6 + (f"<ul><li>{MARKED}{text}</li></ul>", f"<h2>{MARKED}{some(1, 5)}</h2>", f"<blockquote>{MARKED}{text}</blockquote>", f'<p>{MARKED}{text} <a href="/">{word()}</a>{MARKED}</p>', f"<p>{MARKED}{some(1, 3)}.</p>", r.choice(inside))))
        main = r.choice(("<article>{}</article>",) * 4 + ("<main>{}</main>", '<div class="content">{}</div>', '<div id="post-body">{}</div>', "<div>{}</div>")).format("".join(body))
        yield f"<html><head><title>{some(1, 4)}</title></head><body>{''.join(r.sample(before, r.randint(1, 4)))}{main}{''.join(r.sample(after, r.randint(1, 4)))}</body></html>"


MARKED = "¤"


@functools.cache
def fitted() -> tuple[float, ...]:
    """Weights of the logistic classifier, by Newton's steps with a small ridge."""
    x, y = [], []
    for page in training_pages():
        found = blocks(page)
        y += [MARKED in b.text for b in found]
        x.append(features([b._replace(text=b.text.replace(MARKED, "")) for b in found]))
    x, y = np.concatenate(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (p - y) + w)
    return tuple(w.tolist())


def min_cut(source: list[int], sink: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """For each node, whether it is on the source's side of a minimum cut. source, sink: terminal capacities; edges: both ways alike."""
    n = len(source)
    excess = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node whose terminals outweigh its edges has its label in any minimum cut; its neighbours then lean to it
        i = todo.popleft()
        if label[i] is None and abs(excess[i]) >= sum(near[i].values()) and excess[i]:
            label[i] = excess[i] > 0
            for j, c in near[i].items():
                excess[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:  # shortest augmenting paths on what is left; a residual capacity for each direction
        left = {i: dict(near[i]) for i in rest}
        giving, taking = {i: max(excess[i], 0) for i in rest}, {i: max(-excess[i], 0) for i in rest}
        while True:
            came: dict[int, int] = {i: -1 for i in rest if giving[i]}
            line, found = deque(came), None
            while line:
                i = line.popleft()
                if taking[i]:
                    found = i
                    break
                for j, c in left[i].items():
                    if c and j not in came:
                        came[j] = i
                        line.append(j)
            if found is None:
                for i in rest:
                    label[i] = i in came
                break
            path = [found]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            flow = min(giving[path[-1]], taking[found], *(left[b][a] for a, b in zip(path, path[1:])))
            giving[path[-1]] -= flow
            taking[found] -= flow
            for a, b in zip(path, path[1:]):
                left[b][a] -= flow
                left[a][b] += flow
    return [bool(x) for x in label]


#: Capacities: of one nat of a label's cost, and of edges between neighbours and between siblings.
NAT, BESIDE, KIN = 100, 40, 120


def content(page: str, weights: tuple[float, ...]) -> list[str]:
    """The page's blocks of content, in page order."""
    found = blocks(page)
    if not found:
        return []
    z = np.clip(features(found) @ np.array(weights), -12, 12)
    source, sink = (NAT * np.logaddexp(0, z)).astype(int).tolist(), (NAT * np.logaddexp(0, -z)).astype(int).tolist()
    edges: dict[tuple[int, int], int] = {}
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = BESIDE // (1 + b.steps)
        above = (b.parent, b.marks & (IN_AROUND | IN_NAMED))  # children of one element, if they carry the same marks
        if above in last:
            edges[last[above], i] = edges.get((last[above], i), 0) + KIN
        last[above] = i
    return [b.text for b, keep in zip(found, min_cut(source, sink, edges)) if keep]


def _extract(weights: tuple[float, ...]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [" ".join(content(x or "", weights)) for x in part.column("page").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["row", "text", "n_chars"])

    return extract


def extract(pages: DataFrame, page: str = "html", carry: list[str] | None = None) -> DataFrame:
    """For every row of pages: row (a struct of its columns, or of carry), text (the page's main text) and n_chars (its code points)."""
    ship(pages.sparkSession)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry or pages.columns]).alias("row"), F.col(f"`{page}`").cast("string").alias("page"))
    return rows.mapInArrow(_extract(fitted()), T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
