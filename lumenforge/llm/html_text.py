"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page from the whole page."""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import ship_package

#: Pages of the table (of at most SAMPLE_BYTES, with an element that HTML itself calls the article) and pages laid out by rule that the labeller is trained on.
SAMPLE_PAGES, SAMPLE_BYTES, SYNTHETIC_PAGES = 160, 100_000, 1300
#: Pages for each boilerplate name, with boxes of that name before, in and behind their article.
PAGES_A_NAME = 12
#: Further pages whose markup says nothing of what is what.
PLAIN_PAGES = 500
PATH_DIM, BOX_DIM, WORD_DIM, NUMBERS = 64, 192, 96, 8
INPUT = PATH_DIM + BOX_DIM + WORD_DIM + NUMBERS
HIDDEN = 24
#: Labellers that decide together.
MEMBERS = 3
EPOCHS, BATCH, RATE, SEED = 16, 24, 0.015, 6
#: Words of a block that count as said alone.
SHORT = 6
#: Blocks labelled at once.
INFER_BLOCKS = 4096

#: How HTML treats elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style template noscript iframe svg math head title textarea select option button object canvas audio video".split())
#: What may stand in a head; any other element, or text, ends one that is still open.
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = set("script style template noscript iframe title textarea".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Names and phrases that pages laid out by rule use, fixed values: of boilerplate, of articles, around either, and names that mislead.
BOILERPLATE_NAMES = "ad ads advert advertisement sponsor promo banner nav menu navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share social comment comments reply replies discussion respond notice cookie cookies consent popup modal dialog newsletter subscribe signup login form search toolbar pagination pager".split()
CONTENT_NAMES = "article content main post entry body story text".split()
NEUTRAL_NAMES = "wrapper container page row col inner outer box layout grid site app root".split()
AROUND_NAMES = "top bottom list area item wrap block inner left right site global primary".split()
MISLEADING = "has no with without hide enabled disabled open closed free ready".split()
PHRASES = [
    "All rights reserved", "Copyright", "Privacy policy", "Terms of use", "Contact us", "About", "Home", "Sign up", "Log in", "Subscribe to our newsletter", "Accept all cookies",
    "We use cookies", "Share this", "Related posts", "Leave a reply", "Read more", "Advertisement", "Sponsored", "Search", "Next", "Previous", "Follow us", "Comments", "Menu",
]
BOILERPLATE_TAGS = set("nav header footer aside form menu dialog".split())
_TOLD = BOILERPLATE_TAGS | {"." + n for n in BOILERPLATE_NAMES}
_DOUBTFUL = {"~" + n for n in BOILERPLATE_NAMES}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _names(token: str) -> list[str]:
    """Names in a tag's class, id and role: ``.word`` for one word, ``~word`` for each part of a compound."""
    out = set()
    for _, a, b, c in _ATTRIBUTE.findall(token):
        for name in (a or b or c).lower().split():
            words = _WORDS.findall(name)
            out.update(("." if len(words) == 1 else "~") + w for w in words)
    return sorted(out)


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order: the path of elements (with words of class, id and role) and the text.

    Text is decoded, white space joined. Comments, scripts, styles and what is never shown are no blocks. Unclosed
    elements end with the element around them; text outside of any element has an empty path.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[str] = []
    named: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked = 0
    skip = 0

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(tuple(x for n in named for x in n), text, linked))
        parts, linked = [], 0

    def close_to(depth: int):
        nonlocal skip
        while len(stack) > depth:
            name = stack.pop()
            named.pop()
            skip -= name in SKIPPED

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and stack and stack[-1] == "head" and not page[at:stop].isspace():
            close_to(len(stack) - 1)
        if stop > at and not skip:
            parts.append(page[at:stop])
            if "a" in stack:
                linked += stop - at
        if not m:
            break
        at = m.end()
        token = m[0]
        if token[1] in "!?":
            if token.startswith("<![CDATA[") and not skip:
                parts.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if name not in INLINE:
                flush()
            if name in stack:
                close_to(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name not in INLINE:
            flush()
        if stack and stack[-1] == "head" and name not in IN_HEAD:
            close_to(len(stack) - 1)
        if name in CLOSES_P and "p" in stack:
            close_to(len(stack) - 1 - stack[::-1].index("p"))
        if name in ("li", "dt", "dd", "tr", "td", "th") and name in stack:
            inner = len(stack) - 1 - stack[::-1].index(name)
            if not any(x in ("ul", "ol", "dl", "table") for x in stack[inner + 1 :]):
                close_to(inner)
        if name == "br":
            parts.append(" ")
        if name in VOID or token.endswith("/>"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(name)
        named.append((name, *_names(token)) if "=" in token else (name,))
        skip += name in SKIPPED
    flush()
    return out


def article_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels by HTML's own elements, for training: within ``article`` (else ``main``), outside of boilerplate in it, told by element or by a name of one word.

    None without either element, and where a compound name in it mentions boilerplate: ``post-comments`` may be the post or its comments.
    """
    for name in ("article", "main"):
        inside = [_within(b.path, name) for b in blocks]
        if any(x is not None for x in inside):
            if any(x is not None and not _DOUBTFUL.isdisjoint(x) for x in inside):
                return None
            return np.array([x is not None and _TOLD.isdisjoint(x) for x in inside], np.float32)
    return None


def _within(path: tuple[str, ...], name: str) -> tuple[str, ...] | None:
    """The path below its last element ``name``, whose own names are left out; None where there is none."""
    if name not in path:
        return None
    i = len(path) - path[::-1].index(name)
    while i < len(path) and path[i][0] in ".~":
        i += 1
    return path[i:]


def _hashed(words: list[bytes], dim: int) -> np.ndarray:
    """A fixed vector of four signed entries for each word."""
    h = np.array([xxhash.xxh64_intdigest(w, k) for w in words for k in range(4)], np.uint64)
    at = np.repeat(np.arange(len(words)), 4) * dim + (h % np.uint64(dim)).astype(np.int64)
    return np.bincount(at, np.where(h >> np.uint64(63), 0.5, -0.5), len(words) * dim).reshape(-1, dim).astype(np.float32)


class Vectors(dict):
    """Hashed vectors of words, numbered as they are met; started anew between pages when there are ``limit``."""

    def __init__(self, dim: int, limit: int = 60_000):
        super().__init__()
        self.dim, self.limit = dim, limit
        self.table = np.zeros((1024, dim), np.float32)
        self.fresh: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word.encode("utf-8", "surrogatepass"))
        return n

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        """The sum of each list's vectors."""
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64)
        if self.fresh:  # a page's new words at once
            while len(self) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[len(self) - len(self.fresh) : len(self)] = _hashed(self.fresh, self.dim)
            self.fresh = []
        out = np.zeros((len(lists), self.dim), np.float32)
        sizes = np.array([len(x) for x in lists])
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.table[at], (np.cumsum(sizes) - sizes)[full], axis=0)
        return out


class Reader:
    """Turns a page's blocks into the labeller's inputs: a row for each block with hashed tag path, all hashed words, lengths, links, place."""

    def __init__(self):
        self.steps, self.boxes, self.words = Vectors(PATH_DIM), Vectors(BOX_DIM), Vectors(WORD_DIM)

    def features(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), INPUT), np.float32)
        if not blocks:
            return out
        # what stands on html and body says little of one block
        out[:, :PATH_DIM] = self.steps.sums([[f"^{s}" if i < _outer(b.path) else s for i, s in enumerate(b.path)] for b in blocks])
        out[:, PATH_DIM : PATH_DIM + BOX_DIM] = self.boxes.sums([_box(b.path) for b in blocks])
        words = [b.text.lower().split() for b in blocks]
        n_words = np.array([len(w) for w in words], np.float32)
        words = [w + ["^" + x for x in w] if len(w) <= SHORT else w for w in words]  # what a word says alone is not what it says in prose
        out[:, PATH_DIM + BOX_DIM : PATH_DIM + BOX_DIM + WORD_DIM] = self.words.sums(words) / (2 * np.sqrt(n_words))[:, None]
        n = np.array([len(b.text) for b in blocks], np.float32)
        linked = np.minimum(1, np.array([b.linked for b in blocks], np.float32) / n)
        ends = np.array([b.text[-1] in ".!?" for b in blocks])
        deep = np.array([len(b.path) for b in blocks])
        place = np.arange(len(blocks)) / len(blocks)
        out[:, -NUMBERS:] = np.stack([np.log1p(n) / 8, linked, ends, deep / 10, place, np.full(len(blocks), np.log1p(len(blocks)) / 8), n_words > 12, linked > 0.6], axis=1)
        return out


def _outer(path: tuple[str, ...]) -> int:
    """How many entries of a path belong to html and body."""
    i = path.index("body") + 1 if "body" in path else 0
    while 0 < i < len(path) and path[i][0] in ".~":
        i += 1
    return i


def _box(path: tuple[str, ...]) -> list[str]:
    """The nearest element around a block that has names or is a landmark of HTML's, with its names."""
    i = len(path)
    while i > 0:
        j = i - 1
        while path[j][0] in ".~":
            j -= 1
        if i - j > 1 or path[j] in BOILERPLATE_TAGS or path[j] in ("article", "main", "section"):
            return list(path[j:i])
        i = j
    return []


def synthetic_page(rng: np.random.Generator, name: str | None = None, plain_page: bool = False) -> tuple[list[Block], np.ndarray]:
    """Blocks of a page laid out by rule and which of them are its article.

    With ``name``, its boxes are of that name and hold prose like the article's; a ``plain_page`` has no telling markup at all.

    Pages differ in how they say what is what: by HTML's elements, by names (single, compound, misleading ones on both
    sides), or not at all, as bare or div-only markup and plain text do; then only text, links and place tell.
    """
    letters = list("abcdefghijklmnoprstuvwz")
    some = lambda x: x[rng.integers(len(x))]

    def word() -> str:
        return "".join(rng.choice(letters, rng.integers(2, 9)))

    def sentences(low: int, high: int) -> str:
        out = []
        for _ in range(rng.integers(low, high)):
            out.append(" ".join(word() for _ in range(rng.integers(3, 18))).capitalize() + some([".", ".", ".", "!", "?"]))
        return " ".join(out)

    def few(high: int = 6) -> str:
        return " ".join(word() for _ in range(rng.integers(1, high))).capitalize()

    def compound(names: list[str]) -> list[str]:
        n = some(names)
        kind = rng.random()
        if kind < 0.45:
            return ["." + n]
        if kind < 0.6:
            return sorted({"~" + n, "~" + some(names)})
        return sorted({"~" + n, "~" + some(AROUND_NAMES)}) if kind < 0.9 else sorted({"~" + n, "~" + some(NEUTRAL_NAMES)})

    def misleading() -> list[str]:
        """Names on an article, or around the whole page, that mention boilerplate."""
        out = {"~" + some(BOILERPLATE_NAMES), "~" + some(MISLEADING)}
        if rng.random() < 0.5:
            out.add("~" + some(CONTENT_NAMES))
        if rng.random() < 0.4:
            out.add("." + some(NEUTRAL_NAMES))
        return sorted(out)

    style = some(["elements", "elements", "names", "names", "both", "none", "none", "bare"] if name is None else ["elements", "elements", "names", "both", "none"])
    style = some(["none", "none", "bare"]) if plain_page else style
    blocks: list[Block] = []
    labels: list[int] = []
    body = () if style == "bare" and rng.random() < 0.3 else ("html", "body", *(misleading() if rng.random() < 0.25 else []))

    def add(path, text, kept, share=0.0):
        blocks.append(Block(tuple(path), text, int(share * len(text))))
        labels.append(kept)

    def boilerplate(base, inside=False):
        plain = style in ("none", "bare") and not inside and name is None
        box: list[str] = []
        if name is not None:
            own = [some(["div", "div", "section", "ul", "p"]), *(["." + name] if rng.random() < 0.6 else sorted({"~" + name, "~" + some([*AROUND_NAMES, *NEUTRAL_NAMES, *CONTENT_NAMES])}))]
            near = some([n for n in BOILERPLATE_NAMES if n[:4] == name[:4]])
            box = own + (["div", some([".", "~"]) + near] if rng.random() < 0.35 else [])
        elif plain:
            box = ["div"] * int(rng.integers(1, 3)) + (["." + some(NEUTRAL_NAMES)] if rng.random() < 0.3 else [])
        elif rng.random() < {"elements": 0.5, "both": 0.5}.get(style, 0.15) * (0.6 if inside else 1):
            box = [some(sorted(BOILERPLATE_TAGS))]
        else:
            box = [some(["div", "section", "p", "ul", "span", "aside"]), *compound(BOILERPLATE_NAMES)]
            if rng.random() < 0.2:  # footer-content, sidebar-text
                box[1:] = sorted({"~" + some(BOILERPLATE_NAMES), "~" + some(CONTENT_NAMES)})
        kind = some(["links", "links", "short", "phrase"]) if plain else some(["links", "links", "short", "phrase", "prose", "prose"] if name is None else ["links", "short", "phrase", "prose", "prose", "prose", "prose"])
        for _ in range(rng.integers(2, 9) if kind == "links" else rng.integers(1, 4)):
            if kind == "links":
                add((*base, *box, *some([("a",), ("ul", "li"), ("ul", "li"), ()])), some([few(4), some(PHRASES)]), 0, 1.0)
            elif kind == "prose":
                add((*base, *box, *some([(), ("p",), ("p",), ("div",), ("h3",)])), sentences(1, 5), 0, some([0, 0, 0.2]))
            else:
                add((*base, *box, *some([(), ("p",), ("div",), ("span",)])), some(PHRASES) + (" " + some([few(4), str(rng.integers(1990, 2040))]) if rng.random() < 0.5 else "") if kind == "phrase" or plain else few(), 0, some([0, 0, 0.5]))

    outer = some([(), ("div",), ("div", "." + some(NEUTRAL_NAMES)), ("section",), ("div", "div")]) if style != "bare" else ()
    if style in ("elements", "both"):
        core = list(some([("article",), ("main",), ("main", "article")]))
        core += misleading() if rng.random() < 0.3 else []
    elif style == "names":
        core = ["div", *(compound(CONTENT_NAMES) if rng.random() < 0.55 else sorted({*misleading(), "." + some(CONTENT_NAMES)}))]
    else:
        core = ["div"] * int(rng.integers(0, 3)) if style == "none" else []
    alone = style == "bare" and rng.random() < 0.6
    here = (*body, *outer)
    for _ in range(0 if alone else rng.integers(1, 4)):
        boilerplate(here)
    if rng.random() < 0.93:
        if rng.random() < 0.7:
            add((*here, *core, *some([("h1",), ("h1",), ("header", "h1") if style == "none" else ("h1",), ("h2",)])), few(9), 1)
        for _ in range(rng.integers(1, 14)):
            if rng.random() < 0.2 and (style not in ("none", "bare") or name is not None):
                boilerplate((*here, *core), inside=True)
            tail = some([("p",)] * 5 + [("p", "b"), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("div",), (), ("pre",)])
            if not body and rng.random() < 0.5 or style == "none" and rng.random() < 0.3:
                tail = some([(), ("div",), ("div", "div")])
            heading = tail and tail[-1][0] == "h"
            text = few(8) if heading else some([sentences(1, 8), sentences(1, 3), sentences(1, 3), few(14)])
            add((*here, *core, *tail), text, 1, some([0, 0, 0, 0.1, 0.3]) if not heading else 0)
        if rng.random() < (0.3 if name is None else 0.6) and (style not in ("none", "bare") or name is not None):
            boilerplate((*here, *core), inside=True)
    for _ in range(0 if alone else rng.integers(1, 4)):
        boilerplate(here)
    return blocks, np.array(labels, np.float32)


class BlockLabeller:
    """A bidirectional LSTM with a logistic output for every block, which also sees the block's inputs directly."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p[f"c{d}"] = bias
        self.p["s"] = np.zeros(INPUT, np.float32)
        self.p["v"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states along axis 1 of x (pages, blocks, inputs), from the end for direction b."""
        b, t, _ = x.shape
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        out, tape = np.zeros((b, t, HIDDEN), np.float32), []
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, s] + h @ self.p[f"u{d}"]
            i, f, o = (self._sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, s, None]
            c_new = np.where(m, f * c + i * g, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            if keep:
                tape.append((s, h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[:, s] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, _ = self._run(x, mask, "f", False)
        hb, _ = self._run(x, mask, "b", False)
        return self._output(x, hf, hb)

    def _output(self, x: np.ndarray, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        return hf @ self.p["v"][:HIDDEN] + hb @ self.p["v"][HIDDEN:] + x @ self.p["s"] + self.p["o"]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        hf, tf = self._run(x, mask, "f", True)
        hb, tb = self._run(x, mask, "b", True)
        v = self.p["v"]
        p = self._sigmoid(self._output(x, hf, hb))
        e = ((p - y) * mask / max(1, mask.sum())).astype(np.float32)
        grad = {"v": np.concatenate([np.einsum("bt,bth->h", e, hf), np.einsum("bt,bth->h", e, hb)]), "s": np.einsum("bt,bti->i", e, x), "o": e.sum(keepdims=True).ravel()}
        for d, tape, part in (("f", tf, v[:HIDDEN]), ("b", tb, v[HIDDEN:])):
            u = self.p[f"u{d}"]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for s, h, c, i, f, o, g, tc, m in reversed(tape):
                dh = dh + e[:, s, None] * part
                dcs = np.where(m, dc + dh * o * (1 - tc * tc), 0)
                dz = np.hstack([dcs * g * i * (1 - i), dcs * c * f * (1 - f), np.where(m, dh * tc * o * (1 - o), 0), dcs * i * (1 - g * g)])
                dz_all[:, s] = dz
                du += h.T @ dz
                dh = np.where(m, dz @ u.T, dh)
                dc = np.where(m, dcs * f, dc)
            grad[f"u{d}"] = du
            grad[f"w{d}"] = x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * HIDDEN)
            grad[f"c{d}"] = dz_all.sum(axis=(0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = SEED) -> BlockLabeller:
        """Adam on the log loss of all blocks; the result is the mean over the later epochs, which sways less than any of them."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        mean = {k: np.zeros(v.shape) for k, v in self.p.items()}
        step = 0
        sizes = np.array([len(x) for x, _ in pages])
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            order = order[np.argsort(sizes[order], kind="stable")]  # pages of like length run together
            starts = np.arange(0, len(order), BATCH)
            for a in rng.permutation(starts).tolist():
                x, y, mask = _padded([pages[j] for j in order[a : a + BATCH]])
                step += 1
                for k, g in self.gradients(x, y, mask).items():
                    norm = float(np.abs(g).max())
                    g = g / max(1.0, norm)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = RATE / (1 + epoch / 4)
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            if epoch >= EPOCHS // 2:
                mean = {k: v + self.p[k].astype(float) for k, v in mean.items()}
        self.p = {k: (v / (EPOCHS - EPOCHS // 2)).astype(np.float32) for k, v in mean.items()}
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of pages' blocks; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        group: list[int] = []
        for k, i in enumerate(order):
            group.append(i)
            last = k + 1 == len(order)
            if last or len(pages[order[k + 1]]) * (len(group) + 1) > INFER_BLOCKS:
                x, _, mask = _padded([(pages[j], np.zeros(len(pages[j]))) for j in group])
                z = self.logits(x, mask)
                for row, j in enumerate(group):
                    out[j] = z[row, : len(pages[j])] > 0
                group = []
        return out


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]):
    t = max(len(x) for x, _ in pages)
    x = np.zeros((len(pages), t, INPUT), np.float32)
    y, mask = np.zeros((len(pages), t), np.float32), np.zeros((len(pages), t), bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, True
    return x, y, mask


def _with_boxes(blocks: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A sampled page with named boxes put into its article: comments, adverts and the like, in any wording."""
    out, kept = list(blocks), labels.tolist()
    for _ in range(rng.integers(1, 4)):
        inside = [i for i, k in enumerate(kept) if k]
        i = inside[rng.integers(len(inside))] if rng.random() < 0.6 else inside[-1]
        base = out[i].path
        base = base[: len(base) - base[::-1].index("article")] if "article" in base else base[:-1]
        name = BOILERPLATE_NAMES[rng.integers(len(BOILERPLATE_NAMES))]
        box = (["div", "section", "ul", "span"][rng.integers(4)], *(("." + name,) if rng.random() < 0.7 else sorted({"~" + name, "~" + AROUND_NAMES[rng.integers(len(AROUND_NAMES))]})))
        words = out[inside[rng.integers(len(inside))]].text.split()
        for _ in range(rng.integers(1, 4)):
            n = int(rng.integers(1, 40 if rng.random() < 0.5 else 5))
            text = " ".join(words[int(rng.integers(len(words))) :][:n]) if rng.random() < 0.8 else PHRASES[rng.integers(len(PHRASES))]
            out.insert(i + 1, Block((*base, *box, *([], ["p"], ["div"], ["h3"])[rng.integers(4)]), text, 0))
            kept.insert(i + 1, 0.0)
    return out, np.array(kept, np.float32)


def train_labeller(pages: list[str], seed: int = SEED) -> BlockLabeller:
    """Fit on all blocks of sampled pages that HTML's elements label, and of pages laid out by rule."""
    rng = np.random.default_rng(seed)
    reader = Reader()
    told = [synthetic_page(rng) for _ in range(SYNTHETIC_PAGES)]
    told += [synthetic_page(rng, name) for name in BOILERPLATE_NAMES for _ in range(PAGES_A_NAME)]
    told += [synthetic_page(rng, plain_page=True) for _ in range(PLAIN_PAGES)]
    for page in pages:
        blocks = leaf_blocks(page)
        labels = article_labels(blocks)
        if labels is not None and labels.any():
            told += [(blocks, labels), _with_boxes(blocks, labels, rng)]
    return BlockLabeller(seed).fit([(reader.features(b), y) for b, y in told if b], seed)


class Committee(BlockLabeller):
    """Labellers from different starts; a block's logit is the mean of theirs, so that one's accident does not decide."""

    def __init__(self, members: list[dict[str, np.ndarray]]):
        self.members = [BlockLabeller() for _ in members]
        for m, p in zip(self.members, members, strict=True):
            m.p = p

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.mean([m.logits(x, mask) for m in self.members], axis=0)


def train_committee(spark: SparkSession, pages: list[str], seed: int = SEED) -> Committee:
    """MEMBERS labellers of seeds from ``seed`` on, each trained by a task of its own."""
    shared = spark.sparkContext.broadcast(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "p": [pickle.dumps(train_labeller(shared.value, seed + int(i)).p) for i in b["id"]]})

    found = spark.range(0, MEMBERS, 1, MEMBERS).mapInPandas(run, "id long, p binary").collect()
    return Committee([pickle.loads(bytes(r[1])) for r in sorted(found)])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page: the blocks that the labeller keeps, joined by a line break.

    MEMBERS labellers decide together. They learn from a bounded sample of pages (SAMPLE_PAGES of at most SAMPLE_BYTES, by a hash of the id; of them those with an
    ``article`` or ``main``) and from pages laid out by rule, then read each page's whole sequence of blocks with all their words. Null html counts as empty; a page without kept blocks has
    empty text; a page without markup is one block outside of any element. Repeated ids are each returned. Empty input gives no rows.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    # ids first: no long page moves for the choice of the sample
    short = rows.where((F.octet_length("x") <= SAMPLE_BYTES) & F.col("id").isNotNull())
    ids = short.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES).collect()
    chosen = spark.createDataFrame([(r[0],) for r in ids], f"id {kind}")
    # of an id with several pages one trains
    sample = sorted({r[1] for r in short.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("x")).collect()})
    model = spark.sparkContext.broadcast([m.p for m in train_committee(spark, sample).members])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Committee(model.value)
        reader = Reader()
        for b in batches:
            blocks = [leaf_blocks(x) for x in b["x"]]
            kept = labeller.label([reader.features(z) for z in blocks])
            text = ["\n".join(z.text for z, k in zip(p, y, strict=True) if k) for p, y in zip(blocks, kept, strict=True)]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": pd.Series(text, dtype=object), "n_chars": pd.Series([len(t) for t in text], dtype="int64")})

    return rows.mapInPandas(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
