"""Main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks. Two logistic models give each block its cost of being content and of being boilerplate, which are its
terminal capacities: one of its text (length, links, punctuation, kind of element), learned without any structure, and one of the names
on its path (region elements, roles, class and id words). The labels of both are what the semantic elements of the sample's pages say;
names are also learned from ``REGIONS``, labelled examples of regions that a sample need not hold. Neighbouring blocks are tied by
smoothness edges by their distance in the element tree; how much each distance ties is learned from how often such neighbours of the
sample agree. The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

# Element kinds and the class or id words that tell boilerplate from content.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(title)(?=[\s/>])[^>]*>(?:(?!<(?:title|body|/head)[\s/>]).)*?</title\s*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)  # fmt: skip
HIDDEN = set("noscript template svg iframe select button title".split())  # their text is not shown or no prose
NESTING = set("template svg".split())  # may hold their own kind
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("html body div section article main nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th blockquote figure figcaption details summary fieldset center address dialog menu".split())
BREAKS = CONTAINERS | set("head p h1 h2 h3 h4 h5 h6 pre hr".split())  # end a hidden element that has no end tag
REGION_TAGS = set("article main nav header footer aside form menu dialog fieldset".split())
# Labelled examples for the path model, names of regions in the singular.
REGIONS = {
    1: "article main post entry story content prose text body".split(),
    0: "nav navbar navigation menu header footer sidebar aside ad advert advertisement banner cookie consent gdpr notice alert promo promotion sponsor sponsored share sharing social related~ recommended~ popular~ sponsored~ related recommended recommendation comment reply replie discussion disqus form fieldset dialog search login signin signup subscribe newsletter breadcrumb pagination pager widget popup modal overlay copyright legal toolbar topbar masthead tag meta skip".split(),
}
GENERIC = set("list item box wrapper wrap container block area section inner outer left right top bottom link button btn bar group panel content body text title label row col column unit slot this us me main form".split())
MODIFIERS = set("has with no is js without".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "form": "form", "dialog": "dialog", "alert": "alert", "main": "main", "article": "article"}
SITE = set("site page global top blog main masthead".split())  # whose header is the page's

LABEL = {name: label for label, names in REGIONS.items() for name in names}
NEXT, NEAR, DECAY = 0.1, 1.5, 0.25  # smoothness of neighbours, and in addition by the steps between their containers, before learning
PSEUDO = 50  # pairs that these count for
FAR = 6  # steps from here on are one distance
TEXT_LIMIT = 4.0  # most that the text says for or against a block
NAMES, NAME_PAGES, SMALL = 1000, 3, 1.0  # names learned at most, pages that must hold one, weights dropped
TEXT_FEATURES, KIND = 12, slice(8, 12)  # of which these are the element's kind, and whether the page has paragraphs


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    path: tuple[int, ...] = ()  # numbers of the containers, outermost first
    names: tuple[str, ...] = ()  # region names on the path
    linked: int = 0
    tag: str = ""
    text: str = ""


@dataclass
class Model:
    text: np.ndarray  # weights of the text features
    outside: float  # of a block without a telling name, on a page with named content
    names: dict[str, float]
    ties: list[float]  # capacity between neighbours by steps, 0 to FAR


def name_of(word: str) -> list[str]:
    """The region that a class or id word names: its last noun, behind words such as "list" or "box" the one before them.

    ``share-buttons`` and ``shareBox`` name ``share``, ``share-prices`` names ``price``; what stands first is given as a modifier too."""
    pieces = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower()) if p]
    if not pieces or pieces[0] in MODIFIERS:
        return []
    singular = [p[:-1] if p.endswith("s") and not p.endswith("ss") and len(p) > 2 else p for p in pieces]
    last = len(singular) - 1
    while last and (singular[last] in GENERIC or pieces[last] in GENERIC):
        last -= 1
    name = singular[last] if singular[last] in LABEL or singular[-1] not in LABEL else singular[-1]
    if len(singular) > 1 and all(p in GENERIC for p in singular):
        name = "".join(singular) if "".join(singular) in LABEL else name
    if name == "header" and len(singular) > 1 and singular[0] not in SITE | {"header"}:
        return []
    return [name, singular[0] + "~"] if len(singular) > 1 and singular[0] != name else [name]


def region_names(tag: str, attributes: str, inside: bool) -> tuple[str, ...]:
    """Names that one element gives its blocks; a header inside content is the content's own and gives none."""
    if tag in ("html", "body"):
        return ()
    found = [tag] if tag in REGION_TAGS else []
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role":
            found += [ROLES[value.lower()]] if value.lower() in ROLES else []
        else:
            found += [x for w in value.split() for x in name_of(w)]
    return tuple(x for x in found if not (inside and x == "header"))


def wrapping_forms(tokens: list[re.Match]) -> set[int]:
    """Forms that wrap a page rather than ask for something: they hold a region of the page, or more than half of its text."""
    out, opened, total = set(), None, 0
    sizes: dict[int, int] = {}
    at = 0
    for i, m in enumerate(tokens):
        size = len("".join(m.string[at : m.start()].split()))
        at, total = m.end(), total + size
        if opened is not None:
            sizes[opened] += size
        tag = (m[4] or "").lower()
        if tag == "form":
            opened = None if m[3] else i
            if opened is not None:
                sizes[opened] = 0
        elif opened is not None and tag in ("article", "main", "nav", "footer", "h1") and not m[3]:
            out.add(opened)
    return out | {i for i, size in sizes.items() if 2 * size > total}


def hidden_spans(tokens: list[re.Match]) -> dict[int, int]:
    """Start tag -> end tag (positions in ``tokens``) of the hidden elements that are closed inside their container."""
    spans: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i, m in enumerate(tokens):
        tag = (m[4] or "").lower()
        if tag not in HIDDEN and tag not in CONTAINERS:
            continue
        if m[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in HIDDEN:
                        spans[stack[k][1]] = i
                    del stack[k:]
                    break
        elif tag in CONTAINERS or tag in NESTING:
            if stack and stack[-1][0] == tag and tag in ("li", "tr", "td", "th", "dt", "dd"):
                stack.pop()
            if not (tag == "svg" and m[5].endswith("/")):
                stack.append((tag, i))
        else:  # a second one ends the first, which has no end tag then
            stack = [x for x in stack if x[0] != tag] + [(tag, i)]
    return spans


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple, tuple]] = [("", (), ())]  # tag, path, names
    number, link, current = 0, 0, None
    tag_of_block, at = "", 0

    def put(text: str):
        nonlocal current
        if not text:
            return
        if current is None:
            if not text.strip():
                return
            current = Block(path=stack[-1][1], names=stack[-1][2], tag=tag_of_block)
            out.append(current)
        current.parts.append(text)
        if link:
            current.linked += len(text.strip())

    tokens = list(TOKEN.finditer(page))
    spans = hidden_spans(tokens) if any((m[4] or "").lower() in HIDDEN for m in tokens) else {}
    wraps = wrapping_forms(tokens) if any((m[4] or "").lower() == "form" for m in tokens) else set()
    past, hush = -1, False  # last token of a hidden element; whether one without an end tag is open
    for i, m in enumerate(tokens):
        if i <= past:
            continue
        if not hush:
            put(page[at : m.start()])
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            current = None if m[2] else current
            continue
        if tag in HIDDEN:
            if i in spans:
                past, hush = spans[i], False
                at = tokens[past].end()
            else:
                hush = not m[3] and not m[5].endswith("/")
            continue
        if tag in BREAKS:
            hush = False
        if tag == "br":
            put("" if hush else " ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[3] else 1
            continue
        current, tag_of_block = None, tag
        if tag in CONTAINERS:
            link = 0
            if m[3]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                tag_of_block = ""
            else:
                if tag in ("li", "tr", "td", "th", "dt", "dd") and stack[-1][0] == tag:
                    stack.pop()
                _, path, names = stack[-1]
                number += 1
                more = () if i in wraps else region_names(tag, m[5] or "", any(LABEL.get(x) == 1 for x in names))
                stack.append((tag, (*path, number), names + more))
        elif m[3]:
            tag_of_block = ""
    put("" if hush else page[at:])
    kept = []
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def features(blocks: list[Block]) -> np.ndarray:
    """Text features, one row a block."""
    out = np.zeros((len(blocks), TEXT_FEATURES))
    paragraphs = float(any(b.tag == "p" for b in blocks))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        out[i] = [
            1.0, math.log1p(words), min(1.0, b.linked / max(1, len(b.text))), sum(map(b.text.count, ".,!?;")) / words, float(b.text[-1] in ".!?\"'"),
            min(12.0, len(b.text) / words), float(i == 0), float(i == len(blocks) - 1),
            float(b.tag == "p"), float(b.tag == "li"), float(len(b.tag) == 2 and b.tag[0] == "h"), paragraphs,
        ]
    return out


#: Where learning starts and what it is drawn to: longer, less linked, punctuated text is content.
TEXT_PRIOR = np.array([-2.5, 1.0, -4.0, 1.5, 0.8, 0.0, -0.2, -0.5, 0.5, -0.8, 0.2, 0.0])
DRAW_TEXT, DRAW_NAMES = 1e-3, 1e-5  # how much so


def labels_of(blocks: list[Block]) -> list[int]:
    """1 content, 0 boilerplate, -1 unknown: content is what an article or main element holds, but for other regions' elements in it;
    what a class there calls boilerplate stays unknown."""
    semantic = any("article" in b.names or "main" in b.names for b in blocks)
    out = []
    for b in blocks:
        against = [x for x in b.names if LABEL.get(x) == 0]
        held = "article" in b.names or "main" in b.names
        out.append(-1 if not semantic else 0 if not held or any(x in REGION_TAGS for x in against) else -1 if against else 1)
    return out


def outside_of(sums: list[float], told: list[bool]) -> list[bool]:
    """Which blocks bear no telling name although the page has named content."""
    named = any(s > 0 for s in sums)
    return [named and not t for t in told]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray, start: np.ndarray, draw: float, steps: int = 25) -> np.ndarray:
    """Newton steps from ``start``, drawn to it; ``weight`` sums to 1."""
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        slope = (weight * (p - y)) @ x + draw * (w - start)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + draw * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
    return w


def balanced(y: np.ndarray) -> np.ndarray:
    share = y.mean()
    return np.full(len(y), 1 / len(y)) if share in (0.0, 1.0) else np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)


def text_gain(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    return np.clip(features(blocks) @ weights, -TEXT_LIMIT, TEXT_LIMIT)


def example_paths() -> list[tuple[tuple[str, ...], int]]:
    """Names on a path with the label of what lies there: each region of ``REGIONS`` alone, and boilerplate within or around content."""
    out = [((c,), 1) for c in REGIONS[1]] + [(("",), 0)]
    for r in REGIONS[0]:
        out += [((r,), 0), (("", r), 0), *(((c, r), 0) for c in REGIONS[1])]
    return out


def fit(pages: list[str]) -> Model:
    """Text weights, name weights and ties; the blocks that semantic elements label are the rows."""
    parsed = [(b, np.array(labels_of(b))) for b in (blocks_of(p or "") for p in pages) if b]
    known = [(b, y) for b, y in parsed if (y >= 0).any()]
    y = np.concatenate([y[y >= 0] for _, y in known]).astype(float) if known else np.zeros(0)
    enough = len(y) >= 20 and y.min() < y.max()
    text = TEXT_PRIOR
    if enough:
        x = np.concatenate([features(b)[y >= 0] for b, y in known])
        plain = x.copy()
        plain[:, KIND] = 0.0  # each block also without its element's kind, so that the text itself is learned
        x, twice = np.concatenate([x, plain]), np.concatenate([y, y])
        text = logistic(x, twice, balanced(twice), np.zeros(len(twice)), TEXT_PRIOR, DRAW_TEXT)

    # the names, beside what the text says; examples come with texts for, without opinion and against
    held = Counter(x for b, _ in parsed for x in {x for block in b for x in block.names})
    frequent = sorted((x for x, n in held.items() if n >= NAME_PAGES and x not in LABEL), key=lambda x: (-held[x], x))[: NAMES - len(LABEL)]
    column = {x: k for k, x in enumerate(["", *LABEL, *frequent])}
    rows: Counter = Counter()
    for names, label in example_paths():
        for offset in (-TEXT_LIMIT, 0.0, TEXT_LIMIT):
            rows[(frozenset(names), label, offset, True)] += 1
    for b, labels in known if enough else ():
        sums = [0.0 if any(LABEL.get(x) == 0 for x in block.names) else float(any(LABEL.get(x) == 1 for x in block.names)) for block in b]
        bare = outside_of(sums, [any(x in LABEL for x in block.names) for block in b])
        for block, label, gain, out in zip(b, labels, text_gain(b, text), bare, strict=True):
            if label >= 0:
                rows[(frozenset(x for x in (*block.names, *([""] if out else [])) if x in column), int(label), round(float(gain), 1), False)] += 1
    kinds = sorted(rows, key=lambda r: (sorted(r[0]), *r[1:]))
    x = np.zeros((len(kinds), len(column)))
    for i, (names, *_rest) in enumerate(kinds):
        x[i, [column[n] for n in names]] = 1.0
    label, offset, example = (np.array([r[k] for r in kinds], float) for k in (1, 2, 3))
    count = np.array([rows[r] for r in kinds], float)
    weight = np.zeros(len(kinds))
    for part in (0, 1):
        for side in (0, 1):
            chosen = (example == part) & (label == side)
            if chosen.any():
                weight[chosen] = count[chosen] / count[chosen].sum()
    w = logistic(x, label, weight / weight.sum(), offset, np.zeros(len(column)), DRAW_NAMES)
    names = {n: float(w[k]) for n, k in column.items() if n and abs(w[k]) >= SMALL}

    same, other = np.zeros(FAR + 1), np.zeros(FAR + 1)
    for b, labels in known:
        for i in range(len(b) - 1):
            if labels[i] >= 0 and labels[i + 1] >= 0:
                (same if labels[i] == labels[i + 1] else other)[min(FAR, steps_between(b[i].path, b[i + 1].path))] += 1
    ties = []
    for steps in range(FAR + 1):
        before, pairs = NEXT + NEAR * DECAY**steps, same[steps] + other[steps]
        learned = min(NEXT + NEAR, max(0.0, math.log((same[steps] + 1) / (other[steps] + 1))))
        ties.append((PSEUDO * before + pairs * learned) / (PSEUDO + pairs))
    return Model(text, float(w[0]), names, ties)


def steps_between(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps from one container to another in the element tree."""
    common = 0
    while common < min(len(a), len(b)) and a[common] == b[common]:
        common += 1
    return len(a) + len(b) - 2 * common


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    A positive gain is the capacity source -> node, a negative one node -> sink; edges are undirected
    (a, b, capacity). Flow is pushed along shortest paths, many per search; what still
    reaches no sink at the end is the source side (the larger of the minimum cuts' source sides is not needed)."""
    n = len(gain)
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        near[a].append(len(to))
        to.append(b)
        room.append(c)
        near[b].append(len(to))
        to.append(a)
        room.append(c)
    left = [max(g, 0.0) for g in gain]
    need = [max(-g, 0.0) for g in gain]
    tiny = 1e-12
    while True:
        came = [-2] * n
        queue = deque(i for i in range(n) if left[i] > tiny)
        for i in queue:
            came[i] = -1
        ends = []
        while queue:
            i = queue.popleft()
            if need[i] > tiny:
                ends.append(i)
            for e in near[i]:
                if room[e] > tiny and came[to[e]] == -2:
                    came[to[e]] = e
                    queue.append(to[e])
        pushed = False
        for end in ends:
            path, i = [], end
            while came[i] >= 0:
                path.append(came[i])
                i = to[came[i] ^ 1]
            flow = min([left[i], need[end], *(room[e] for e in path)])
            if flow > tiny:
                pushed = True
                left[i] -= flow
                need[end] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
        if not pushed:
            return [c != -2 for c in came]


def terms(blocks: list[Block], model: Model):
    """Log-odds of content of each block, and the smoothness edges.

    Of the names on a path the strongest for and the strongest against count."""
    told = [[model.names[x] for x in b.names if x in model.names] for b in blocks]
    sums = [max([0.0, *t]) + min([0.0, *t]) for t in told]
    bare = outside_of(sums, [bool(t) for t in told])
    gain = [float(g) + s + (model.outside if o else 0.0) for g, s, o in zip(text_gain(blocks, model.text), sums, bare, strict=True)]
    edges = [(i, i + 1, model.ties[min(FAR, steps_between(blocks[i].path, blocks[i + 1].path))]) for i in range(len(blocks) - 1)]
    last: dict[tuple, int] = {}
    for i, b in enumerate(blocks):  # nearest earlier block of the container, when others lie between
        if b.path in last and last[b.path] < i - 1:
            edges.append((last[b.path], i, model.ties[0]))
        last[b.path] = i
    return gain, edges


#: Without pages to learn from.
DEFAULT = fit([])


def extract(page: str, weights: Model) -> str:
    """Main text of one page."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return " ".join(b.text for b, inside in zip(blocks, min_cut(*terms(blocks, weights)), strict=True) if inside)


def train(pages: DataFrame, sample_rows: int = 400) -> Model:
    """Fit on at most ``sample_rows`` pages, in a task of its own; the labels come from the pages' own semantic elements."""
    rows = bounded_sample(pages.where("page_id is not null and html is not null").select("page_id", F.col("html").cast("string")), "page_id", sample_rows)

    def run(batches):
        pairs = sorted((k, h) for b in batches for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if pairs:
            m = fit([h for _, h in pairs])
            yield pa.RecordBatch.from_arrays([pa.array([m.text.tolist()]), pa.array([m.outside]), pa.array([list(m.names)]), pa.array([list(m.names.values())]), pa.array([m.ties])], names=["text", "outside", "names", "weights", "ties"])

    found = rows.coalesce(1).mapInArrow(run, "text array<double>, outside double, names array<string>, weights array<double>, ties array<double>").collect()
    if not found:
        return DEFAULT
    m = found[0]
    return Model(np.array(m["text"]), m["outside"], dict(zip(m["names"], m["weights"], strict=True)), list(m["ties"]))


def extract_pages(pages: DataFrame, weights: Model) -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html gives an empty text.

    Whole pages are read; every row gives a row, so that null and repeated page_ids stay and equal rows get equal results; of minimum
    cuts the one with least content is taken; extra columns of any name are ignored; an empty table gives no rows."""
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [extract(h or "", weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, schema)
