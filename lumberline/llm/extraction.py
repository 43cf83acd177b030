"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of elements. Each element has features: its tag's kind, attribute tokens that hint at either side, depth,
size and density of its subtree's text, its share of links, paragraphs, punctuation and form controls, and how its siblings
compare. Gradient-boosted trees give the log-odds that an element belongs to the main text. Decoding chooses, for the whole tree
at once, a label for each element: undecided, content or excluded. Content stands only below undecided or content elements and
everything below an excluded element is excluded, so that no ancestor and descendant contradict each other; of all such
labellings the one with the greatest sum of weighted log-odds wins.

The trees are trained on the driver on ``PAGES`` pages that this module makes itself, labelled as it makes them, from a fixed
seed; the model has a fixed size and is broadcast. Pages are then worked on one by one, whole, in Arrow batches.

Text: character references are decoded, white space inside a block becomes one space, ends are trimmed, blocks join in page
order by one space. Scripts, styles, templates, comments and form controls never have text.

Defined cases: a null, empty or blank page, and one without content, gives an empty text; text outside any element counts as
text of the body; unclosed and misplaced tags close as browsers do for common cases; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

PAGES = 700
ROUNDS = 60
DEPTH = 4
RATE = 0.2
BINS = 32
TOGETHER = 128

# Kinds of HTML elements, and attribute tokens that hint at main text or at what stands around it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg iframe object canvas select option button textarea audio video map datalist".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table")}
KINDS = ("article main", "section", "div", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset label legend input", "table tbody thead tfoot tr td th caption", "a", "b strong i em span code mark u s small sub sup q cite abbr time", "figure figcaption", "dialog details summary", "html body")
HINTS = {
    "main": "article content entry post story body text main page lead prose markdown hentry editorial".split(),
    "menu": "nav menu navbar breadcrumb breadcrumbs toc tabs pager pagination skip links".split(),
    "head": "header masthead banner topbar logo branding hero head sitename".split(),
    "foot": "footer foot copyright legal colophon bottom credits imprint".split(),
    "side": "sidebar side aside related recommended widget more rail trending popular tags".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp commercial partner".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall message warning disclaimer".split(),
    "talk": "comment comments reply replies discussion respond disqus thread feedback reader readers".split(),
    "form": "form search login register contact input poll share social follow".split(),
}
HINT_OF = {word: i for i, words in enumerate(HINTS.values()) for word in words}
KIND_OF = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}

UNQUOTED = re.compile(r"=\s*[^\s\"'>]+$")
TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
TOKEN = re.compile(r"[a-z]+")
VALUES = re.compile(r"\b(?:class|id|role|itemprop|aria-label|data-[\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。،]")


class Page:
    """Elements in page order: tag, attributes, parent, and the runs of text with the element that each stands in (-1: a break)."""

    def __init__(self, html: str):
        self.tags, self.attrs, self.parents, self.texts = ["body"], [""], [-1], []
        stack, at, end = [0], 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            if m is None or m.start() > at:
                self._text(html[at : m.start() if m else end], stack[-1])
            if m is None:
                break
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if self._open(tag, m[3], stack) and tag in RAW:
                    close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else end
                    stack.pop()
            elif m[1]:
                self._close(m[1].lower(), stack)

    def _text(self, text: str, node: int) -> None:
        self.texts.append((node, unescape(text)))

    def _closes_itself(self, tag: str, attrs: str, stack: list[int]) -> bool:
        """A slash before '>' counts in svg and math only, and not as the end of a value without quotes."""
        if not attrs.endswith("/") or UNQUOTED.search(attrs):
            return False
        return tag in ("svg", "math") or next((self.tags[i] != "foreignobject" for i in reversed(stack) if self.tags[i] in ("svg", "math", "foreignobject")), False)

    def _open(self, tag: str, attrs: str, stack: list[int]) -> bool:
        """Whether the element stays open."""
        if tag in CLOSES_P:
            self._close_until(stack, "p", "button td th li div article section table")
        if tag in CLOSED_BY:
            closed, stop = CLOSED_BY[tag]
            for x in closed.split():
                self._close_until(stack, x, stop)
        if tag in ("html", "body") and len(self.tags) > 1 and tag in self.tags[1:]:
            return False
        if tag in BLOCKS:
            self.texts.append((-1, ""))
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(stack[-1])
        if tag in VOID or self._closes_itself(tag, attrs, stack):
            return False
        stack.append(len(self.tags) - 1)
        return True

    def _close_until(self, stack: list[int], tag: str, stop: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = self.tags[stack[i]]
            if name == tag:
                del stack[i:]
                return
            if name in stop.split():
                return

    def _close(self, tag: str, stack: list[int]) -> None:
        if tag in BLOCKS:
            self.texts.append((-1, ""))
        if tag in ("html", "body"):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] == tag:
                del stack[i:]
                return


N_HINTS, N_KINDS = len(HINTS), len(KINDS)
N_FEATURES = 15 + 2 * N_HINTS + N_KINDS


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tags)
    tags, parents = page.tags, page.parents
    depth, silent, kinds = [0] * n, [False] * n, np.full(n, -1)
    hints = np.zeros((n, N_HINTS), np.float32)
    for i in range(n):
        tag, up = tags[i], parents[i]
        if up >= 0:
            depth[i] = depth[up] + 1
            silent[i] = silent[up] or tag in SILENT
        kinds[i] = KIND_OF.get(tag, -1)
        if page.attrs[i]:
            for m in VALUES.finditer(page.attrs[i]):
                for word in TOKEN.findall(HUMP.sub(" ", m[1] or m[2] or m[3] or "").lower()):
                    if (k := HINT_OF.get(word)) is not None:
                        hints[i, k] += 1
    chars, stops, links = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in page.texts:
        if node >= 0 and not silent[node]:
            size = len(text) - text.count(" ") if not text.isspace() else 0
            chars[node] += size
            stops[node] += len(PUNCTUATION.findall(text)) if size else 0
            if size and tags[node] == "a":
                links[node] += size
    own = chars.copy()
    elements, paragraphs, controls, longest, above = np.ones(n), np.zeros(n), np.zeros(n), chars.copy(), hints.copy()
    for i in range(n):
        if tags[i] == "p":
            paragraphs[i] += 1
        if tags[i] in ("input", "select", "textarea", "button", "label"):
            controls[i] += 1
        if parents[i] >= 0:
            above[i] += above[parents[i]]
    for i in range(n - 1, 0, -1):
        up = parents[i]
        chars[up] += chars[i]
        stops[up] += stops[i]
        links[up] += chars[i] if tags[i] == "a" else links[i]
        elements[up] += elements[i]
        paragraphs[up] += paragraphs[i]
        controls[up] += controls[i]
        longest[up] = max(longest[up], longest[i])
    up = np.maximum(np.array(parents), 0)
    siblings = np.bincount(up[1:], minlength=n)[up] if n > 1 else np.ones(n)
    place, seen = np.zeros(n), [0] * n
    for i in range(1, n):
        place[i] = seen[parents[i]]
        seen[parents[i]] += 1
    total = max(1.0, chars[0])
    numbers = [np.array(depth), np.log1p(chars), np.log1p(own), chars / elements, links / np.maximum(chars, 1), stops / np.maximum(chars, 1) * 100, np.log1p(paragraphs), controls, np.log1p(longest), chars / total, chars / np.maximum(chars[up], 1), siblings, place / np.maximum(siblings, 1), own / np.maximum(chars, 1), kinds[up]]
    kind = np.zeros((n, N_KINDS), np.float32)
    kind[(kinds >= 0).nonzero()[0], kinds[kinds >= 0]] = 1
    return np.concatenate([np.stack(numbers, axis=1).astype(np.float32), hints, above - hints, kind], axis=1)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        self.depth, self.trees = depth, []
        self.start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        raw = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][leaf]

    def _grow(self, binned: np.ndarray, grad: np.ndarray, curve: np.ndarray) -> tuple:
        """A complete tree: the feature and the threshold of each inner node, the value of each leaf; and each row's leaf."""
        feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best, choice = np.full(width, 1e-6), [None] * width
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                cell = node * (BINS + 1) + binned[:, f]
                g = np.bincount(cell, grad, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(cell, curve, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain = gain[:, : len(edges)]
                top = gain.argmax(axis=1)
                for k in (gain.max(axis=1) > best).nonzero()[0]:
                    best[k], choice[k] = gain[k, top[k]], (f, top[k])
            right = np.zeros(len(node), bool)
            for k, found in enumerate(choice):
                if found:
                    f, b = found
                    feature[first + k], threshold[first + k] = f, self.edges[f][b]
                    here = node == k
                    right[here] = binned[here, f] > b
            node = node * 2 + right
        leaves = 2**self.depth
        value = -RATE * np.bincount(node, grad, leaves) / (np.bincount(node, curve, leaves) + 1)
        return (feature, threshold, value), node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
            out += value[node]
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which elements are content: the best labelling with undecided above content above excluded."""
    n = len(page.tags)
    own = np.zeros(n)
    for node, text in page.texts:
        if node >= 0:
            own[node] += len(text.strip())
    gain = odds * (0.2 + np.sqrt(own))
    content, excluded, undecided = gain.copy(), -gain, np.zeros(n) - np.where(own > 0, 0.5, 0.0) * np.sqrt(own)
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        excluded[up] += excluded[i]
        content[up] += max(content[i], excluded[i])
        undecided[up] += max(undecided[i], content[i], excluded[i])
    label = np.zeros(n, np.int8)  # 0 undecided, 1 content, 2 excluded
    for i in range(n):
        above = label[page.parents[i]] if i else 0
        if page.tags[i] in SILENT or above == 2:
            label[i] = 2
        elif above == 1:
            label[i] = 1 if content[i] >= excluded[i] else 2
        else:
            label[i] = int(np.argmax((undecided[i], content[i], excluded[i])))
    return label == 1


def text_of(page: Page, chosen: np.ndarray) -> str:
    parts = []
    for node, text in page.texts:
        if node < 0:
            parts.append(" ")
        elif chosen[node]:
            parts.append(text)
    return " ".join("".join(parts).split())


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and, for its elements in order, the side that each is on: c content, x around it, or a space for what holds both."""
    html, sides = [], []
    words = ["".join(rng.choice(("ka", "lo", "mi", "ter", "na", "sh", "ing", "ou", "re", "de", "é", "ü", "st")) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    stops = rng.random() < 0.9

    def prose(low: int, high: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            out.append(rng.choice(words) + ((rng.choice((".", ",", ".")) if rng.random() < 0.15 and stops else "")))
        return " ".join(out)

    def name(hint: str, chance: float = 0.85) -> str:
        if rng.random() > chance:
            return ""
        token = rng.choice(HINTS[hint])
        token = rng.choice((token, f"{token}-{rng.choice(('box', 'wrap', 'list', 'block', 'inner', '1'))}", f"site-{token}", f"{token}_{rng.choice(words)}"))
        return f' {rng.choice(("class", "id", "class"))}="{token}"'

    def put(tag: str, attrs: str, side: str, inside) -> None:
        html.append(f"<{tag}{attrs}>")
        sides.append(side)
        if callable(inside):
            inside()
        else:
            html.append(inside)
        if tag not in VOID and not (tag in ("p", "li") and rng.random() < 0.15):
            html.append(f"</{tag}>")

    def links(side: str = "x") -> None:
        def item() -> None:
            put("a", f' href="/{rng.choice(words)}"', side, prose(1, 4))

        if rng.random() < 0.7:
            put(rng.choice(("ul", "ul", "ol")), "", side, lambda: [put("li", "", side, item) for _ in range(rng.randint(2, 9))])
        else:
            for _ in range(rng.randint(2, 9)):
                item()
                html.append(rng.choice((" ", " | ", "")))

    def menu() -> None:
        put(*rng.choice((("nav", name("menu", 0.4)), ("nav", ""), ("div", name("menu", 1)), ("ul", name("menu", 1)))), "x", links)

    def simple(hint: str, tags: tuple[str, ...]) -> None:
        tag = rng.choice(tags)

        def inside() -> None:
            if rng.random() < 0.35:
                put(rng.choice(("h2", "h3", "h4", "strong")), "", "x", prose(1, 5))
            for _ in range(rng.randint(1, 3)):
                if rng.random() < 0.4:
                    html.append(prose(2, 25))
                elif rng.random() < 0.4:
                    links()
                else:
                    put(rng.choice(("p", "div", "span")), "", "x", prose(2, 30))

        put(tag, name(hint, 1 if tag in ("div", "section", "p", "ul") else 0.5), "x", inside)

    def form() -> None:
        def inside() -> None:
            for _ in range(rng.randint(1, 4)):
                put("label", "", "x", prose(1, 4))
                put("input", ' type="text"', "x", "")
            put("button", "", "x", prose(1, 2))
            if rng.random() < 0.4:
                put("p", "", "x", prose(3, 15))

        put("form", name("form", 0.5), "x", inside)

    def talk() -> None:
        def one() -> None:
            if rng.random() < 0.6:
                put(rng.choice(("b", "span", "h4", "cite")), "", "x", prose(1, 2))
            for _ in range(rng.randint(1, 2)):
                put("p", "", "x", prose(3, 50))

        def inside() -> None:
            put("h3", "", "x", prose(1, 3)) if rng.random() < 0.6 else None
            for _ in range(rng.randint(1, 6)):
                put(rng.choice(("div", "li", "article")), name("talk", 0.7), "x", one)

        put(rng.choice(("div", "section", "ol", "aside")), name("talk", 1), "x", inside)

    def around() -> None:
        rng.choice((menu, form, talk, lambda: simple("advert", ("div", "aside", "section", "p")), lambda: simple("notice", ("div", "section", "dialog", "p")), lambda: simple("side", ("aside", "div", "section"))))()

    def paragraph(side: str = "c") -> None:
        def inside() -> None:
            html.append(prose(1, 60))
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                put(rng.choice(("b", "em", "a", "span", "strong", "i", "code")), "", side, prose(1, 6))
                html.append(" " + prose(1, 20))
            if rng.random() < 0.15:
                put("br", "", side, "")
                html.append(prose(1, 30))

        put("p", "", side, inside)

    def part() -> None:
        r = rng.random()
        if r < 0.72:
            paragraph()
        elif r < 0.82:
            put(rng.choice(("h2", "h3")), "", "c", prose(1, 8))
        elif r < 0.88:
            put(rng.choice(("ul", "ol")), "", "c", lambda: [put("li", "", "c", prose(1, 30)) for _ in range(rng.randint(2, 6))])
        elif r < 0.91:
            put("blockquote", "", "c", paragraph if rng.random() < 0.6 else prose(5, 30))
        elif r < 0.94:
            put("table", "", "c", lambda: [put("tr", "", "c", lambda: [put("td", "", "c", prose(1, 5)) for _ in range(3)]) for _ in range(rng.randint(1, 4))])
        elif r < 0.96:
            put("figure", "", "c", lambda: put("figcaption", "", "c", prose(2, 12)))
        elif r < 0.98:
            put("pre", "", "c", prose(3, 30))
        else:
            around()

    def story() -> None:
        def body() -> None:
            if rng.random() < 0.8:
                put(rng.choice(("h1", "h1", "h2")), "", "c", prose(1, 14))
            for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13))):
                part()
            if rng.random() < 0.15:
                around()

        tag = rng.choice(("article", "article", "main", "div", "section"))
        if rng.random() < 0.3:
            put(tag, name("main", 0.8), "c", lambda: put(rng.choice(("div", "section")), name("main", 0.6), "c", body))
        else:
            put(tag, name("main", 0.4 if tag in ("article", "main") else 1), "c", body)

    def head() -> None:
        def inside() -> None:
            put(rng.choice(("div", "a", "h1", "span")), name("head", 0.5), "x", prose(1, 4))
            if rng.random() < 0.6:
                menu()

        put(*rng.choice((("header", name("head", 0.4)), ("div", name("head", 1)))), "x", inside)

    def foot() -> None:
        put(*rng.choice((("footer", name("foot", 0.3)), ("footer", ""), ("div", name("foot", 1)))), "x", lambda: html.append("&copy; " + prose(1, 30)) if rng.random() < 0.6 else links())

    def middle() -> None:
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            around()
        story()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            around()

    html.append("<!DOCTYPE html>")
    if rng.random() < 0.6:
        head()
    if rng.random() < 0.6:
        menu()
    for _ in range(rng.choice((0, 0, 1))):
        around()
    if rng.random() < 0.4:
        put("div", rng.choice(("", ' id="wrapper"', ' class="container"', ' class="page"')), " ", middle)
    else:
        middle()
    if rng.random() < 0.85:
        foot()
    return "".join(html), sides


@lru_cache(maxsize=1)
def model() -> Trees:
    rng, rows, labels = random.Random(20), [], []
    for _ in range(PAGES):
        html, sides = made_page(rng)
        page = Page(html)
        if len(page.tags) != len(sides) + 1:
            continue
        known = np.array([" ", *sides])
        x = features(page)
        rows.append(x[known != " "])
        labels.append((known[known != " "] == "c").astype(float))
    return Trees(np.concatenate(rows), np.concatenate(labels))


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    read = [Page(html) if html else None for html in pages]
    rows = [features(p) for p in read if p]
    odds = trees.score(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for page in read:
        if page is None:
            out.append("")
            continue
        n = len(page.tags)
        out.append(text_of(page, decode(page, odds[at : at + n])))
        at += n
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), TOGETHER):
                part = b.slice(i, TOGETHER)
                texts = main_texts(part["html"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
