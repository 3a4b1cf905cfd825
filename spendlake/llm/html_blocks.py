"""HTML extraction with a recurrent block labeller.

A page is cut into blocks: the leaf text between block-level tags (inline tags and ``<br>``
do not end a block). Every block becomes a vector: hashed features of its tag path with
class and id words, hashed features of its words, and a few measures. A bidirectional LSTM,
written in numpy, reads the page's whole sequence of vectors and labels every block main
text or not, so that a block is judged with what stands before and after it.

The network is trained on a bounded sample of pages (``max_pages``, the first by a hash of
url, id and html; a documented bound). Its teacher is the pages' own markup: blocks under
elements or class names that stand for navigation, adverts, forms, comments and the like
(``ASIDE``) are not main text; blocks under ``article`` or ``main`` are, and elsewhere
paragraphs, headings, list items, quotes, code and cells are. Scripts, styles and the head
hold no page text and are left out before the network is asked.

Character references are decoded; white space inside a block becomes one space; blocks are
trimmed and empty ones skipped; the main blocks are joined by ``\\n`` in page order. Nothing
is capped: sequences of any length are read in full. Null or empty html gives empty text.
Repeated rows get equal results; columns of the input named ``text`` are replaced.
"""
from __future__ import annotations

import functools
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import Step, apply_steps, texts_of

MAX_PAGES, EPOCHS, HIDDEN, RATE = 600, 6, 16, 0.02
PATH_DIM, WORD_DIM = 48, 32

#: Elements whose content is no page text.
SILENT = frozenset("script style noscript template head title svg math iframe object select textarea canvas audio video".split())
#: Elements that may stand in the head; any other ends it.
HEAD_TAGS = frozenset("html head title meta link script style base noscript template".split())
#: Elements of page text: each ends an open drawing, formula or choice list.
BREAKS_OUT = frozenset("article aside b big blockquote body br center code dd div dl dt em footer form h1 h2 h3 h4 h5 h6 header hr i img "
                       "li main menu nav ol p pre s section small span strike strong sub sup table tt u ul".split())
ENDED_BY_TEXT = frozenset("svg math select".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that stand for other things than main text.
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu header".split())
ASIDE_WORDS = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|cookie|cookies|"
                         r"consent|disqus|footer|header|login|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|pager|"
                         r"pagination|popup|promo|promoted|related|reply|replies|search|share|sharing|sidebar|signup|social|"
                         r"sponsor|sponsored|subscribe|toolbar|widget)(?:$|[-_ ])", re.I)
MAIN_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption summary".split())
#: A new element of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
#: Elements that an open paragraph does not survive.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main menu nav ol p pre section table ul".split())

_ASIDE = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_BLANK = re.compile(r"[ \t\n\r\f\v  -     　 \x85]+")


def tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """End of a tag's attributes and of the tag. A ``>`` in a quoted value does not end the tag,
    unless the value's second quote is missing: none follows, or the next one opens the value of
    a later tag or stands inside a word. ``last`` has the last place of each quote in the page."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return len(page), len(page)
        if m[1] is None:
            return m.start(), m.end()
        begin = m.end()
        close = page.find(m[1], begin) if begin <= last[m[1]] else -1
        inner = page.find(">", begin, close if close >= 0 else len(page))
        if inner >= 0 and (close < 0 or page[close + 1:close + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">")
                           or page[begin:close].rstrip().endswith("=")):
            return inner, inner + 1
        if close < 0:
            return len(page), len(page)
        at = close + 1


class Place:
    """What stands open around a block, made from the place outside it and one more element: a
    deep stack costs no more than a flat one. ``seen`` holds the slots of all names and marks as
    bits, ``near`` the last two names that end blocks."""
    __slots__ = ("seen", "near", "kinds", "marked")

    def __init__(self, seen: int = 0, near: tuple = (), kinds: int = 0, marked: bool = False):
        self.seen, self.near, self.kinds, self.marked = seen, near, kinds, marked

    def inside(self, name: str, marks: str) -> "Place":
        seen, kinds, marked = _element(name, marks)
        if not seen and not marked and name in INLINE:
            return self
        near = self.near if name in INLINE else (*self.near[-1:], name)
        return Place(self.seen | seen, near, self.kinds | kinds, self.marked or marked)


ASIDE_KIND, HEADER_KIND, MAIN_KIND, TEXT_KIND = 1, 2, 4, 8


@functools.lru_cache(maxsize=100_000)
def _element(name: str, marks: str) -> tuple[int, int, bool]:
    """Slots, kinds and an aside word of one element."""
    seen = kinds = 0
    if name not in INLINE:
        seen |= 1 << _slot("tag", name, PATH_DIM)
        kinds = (ASIDE_KIND * (name in ASIDE_TAGS and name != "header") | HEADER_KIND * (name == "header")
                 | MAIN_KIND * (name in MAIN_TAGS) | TEXT_KIND * (name in TEXT_TAGS))
    for w in re.split(r"[^A-Za-z0-9]+", marks.lower()):
        if w:
            seen |= 1 << _slot("mark", w, PATH_DIM)
    return seen, kinds, ASIDE_WORDS.search(marks) is not None


class Block:
    __slots__ = ("place", "text", "link", "parts", "linked")

    def __init__(self, place):
        self.place, self.parts, self.linked, self.text, self.link = place, [], 0, "", 0.0


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order, tolerant of unclosed and unmatched tags, as browsers are:
    a head without an end tag ends at the first element or text of the body, drawings, formulas
    and choice lists at the first element of page text. Open elements are found by name, so that
    time grows with the length of the page, however broken."""
    stack: list[tuple[str, Place]] = []  # open elements and what they make of their content
    where: dict[str, list[int]] = {}  # name -> its places in the stack
    solid: list[int] = []  # places of the elements that end a block
    silent = links = 0
    out: list[Block] = []
    now: Block | None = None
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    outside = Place()

    def text(raw: str) -> None:
        nonlocal now
        if not raw or now is None and raw.isspace():
            return
        if stack and stack[-1][0] == "head":
            pop(len(stack) - 1)
        if silent:
            return
        if now is None:
            now = Block(stack[-1][1] if stack else outside)
        raw = entities.unescape(raw) if "&" in raw else raw
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    def end() -> None:
        nonlocal now
        if now is not None:
            now.text = _BLANK.sub(" ", "".join(now.parts)).strip(" ")
            if now.text:
                now.link = min(1.0, now.linked / max(1, len(now.text)))
                out.append(now)
            now = None

    def pop(to: int) -> None:
        nonlocal silent, links
        for n, _ in stack[to:]:
            where[n].pop()
            silent -= n in SILENT
            links -= n == "a"
        while solid and solid[-1] >= to:
            solid.pop()
        del stack[to:]

    def top(names) -> int:
        """Place of the innermost open element of these names, -1 without one."""
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _NAME.match(page, lt)
        if m is None:
            note = _ASIDE.match(page, lt)
            text(page[at:lt] if note else page[at:lt + 1])  # a bare "<" is text
            at = note.end() if note else lt + 1
            continue
        text(page[at:lt])
        name = m[2].lower()
        stop, at = tag_end(page, m.end(), last)
        if name not in INLINE:
            end()
        elif name == "br":
            text(" ")
        if m[1]:
            if where.get(name):
                pop(where[name][-1])
            continue
        if name not in HEAD_TAGS and where.get("head"):
            pop(where["head"][-1])
        if silent and name in BREAKS_OUT and (k := top(ENDED_BY_TEXT)) > top(("foreignobject", "desc")):
            pop(k)
        if name in VOID or page[stop - 1] == "/" and stop > m.end():
            continue
        if name in ENDS_P and solid and stack[solid[-1]][0] == "p":
            pop(solid[-1])
        if name in CLOSES and (k := top(CLOSES[name])) > top(("ul", "ol", "dl", "table", "tbody", "select")):
            pop(k)
        marks = " ".join(a or b or c for _, a, b, c in _ATTR.findall(page, m.end(), stop)) if stop > m.end() else ""
        place = (stack[-1][1] if stack else outside).inside(name, marks)
        where.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, place))
        silent += name in SILENT
        links += name == "a"
        if name in _RAW_END:
            close = _RAW_END[name].search(page, at)
            at = close.start() if close else size
    end()
    return out


def teacher(b: Block) -> int:
    """Label that the markup itself suggests."""
    kinds = b.place.kinds
    if kinds & ASIDE_KIND or kinds & HEADER_KIND and not kinds & MAIN_KIND or b.place.marked:
        return 0
    return int(bool(kinds & (MAIN_KIND | TEXT_KIND)))


def _slot(kind: str, value: str, dim: int) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % dim


DIM = PATH_DIM + WORD_DIM + 8


class Features:
    """Block vectors; equal paths and words are hashed once per worker batch."""

    def __init__(self):
        self.paths: dict = {}
        self.words: dict = {}

    def path(self, b: Block) -> np.ndarray:
        key = (b.place.seen, b.place.near)
        v = self.paths.get(key)
        if v is None:
            bits = b.place.seen
            for n in b.place.near:
                bits |= 1 << _slot("near", n, PATH_DIM)
            bits |= 1 << _slot("leaf", b.place.near[-1] if b.place.near else "", PATH_DIM)
            v = self.paths[key] = np.array([bits >> k & 1 for k in range(PATH_DIM)], np.float32)
        return v

    def slots(self, words: list[str]) -> list[int]:
        got = []
        for w in words:
            s = self.words.get(w)
            if s is None:
                if len(self.words) > 200_000:
                    self.words.clear()
                s = self.words[w] = _slot("word", w, WORD_DIM)
            got.append(s)
        return got

    def page(self, blocks: list[Block]) -> np.ndarray:
        x = np.zeros((len(blocks), DIM), np.float32)
        for i, b in enumerate(blocks):
            words = b.text.lower().split(" ")
            x[i, :PATH_DIM] = self.path(b)
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(self.slots(words), minlength=WORD_DIM) / len(words)
            x[i, -8:] = (np.log1p(len(words)) / 5, b.link, b.text[-1] in ".!?:…", sum(w.isdigit() for w in words) / len(words),
                         i / len(blocks), 1 - i / len(blocks), "©" in b.text or "|" in b.text, len(b.text) / len(words) / 10)
        return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstm:
    """Two LSTMs (forward, backward) over padded batches and a logistic output."""

    def __init__(self, seed: int = 7, dim: int = DIM, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": scale(dim, 4 * hidden), f"U{d}": scale(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden:2 * hidden] = 1  # forget gates start open
        self.p |= {"V": scale(2 * hidden, 1)[:, 0], "v": np.zeros(1, np.float32)}
        self.h = hidden

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, t, _ = x.shape
        H, U = self.h, self.p[f"U{d}"]
        z0 = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((n, H), np.float32)
        hs, memo = np.zeros((n, t, H), np.float32), []
        for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = z0[:, k] + h @ U
            i, f, o, g = _sigmoid(z[:, :H]), _sigmoid(z[:, H:2 * H]), _sigmoid(z[:, 2 * H:3 * H]), np.tanh(z[:, 3 * H:])
            m = mask[:, k, None]
            c2 = (f * c + i * g) * m
            th = np.tanh(c2)
            h2 = o * th * m
            if keep:
                memo.append((k, h, c, i, f, o, g, th, m))
            h, c = h2, c2
            hs[:, k] = h
        return hs, memo

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        (hf, mf), (hb, mb) = self._run("f", x, mask, keep), self._run("b", x, mask, keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["V"] + self.p["v"][0], both, mf, mb

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict:
        logit, both, mf, mb = self.logits(x, mask, keep=True)
        dl = (_sigmoid(logit) - y) * mask / mask.sum()
        g = {"V": np.einsum("nt,nth->h", dl, both), "v": np.array([dl.sum()], np.float32)}
        for d, memo, part in (("f", mf, slice(0, self.h)), ("b", mb, slice(self.h, None))):
            dh_out = dl[:, :, None] * self.p["V"][part]
            H, U = self.h, self.p[f"U{d}"]
            dz_all = np.zeros((*x.shape[:2], 4 * H), np.float32)
            gu = np.zeros_like(U)
            dh = dc = np.zeros((len(x), H), np.float32)
            for k, h0, c0, i, f, o, gg, th, m in reversed(memo):
                dht = (dh + dh_out[:, k]) * m
                dct = (dc * m) + dht * o * (1 - th * th)
                dz = np.concatenate([dct * gg * i * (1 - i), dct * c0 * f * (1 - f), dht * th * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
                dz_all[:, k] = dz
                gu += h0.T @ dz
                dh, dc = dz @ U.T, dct * f
            g[f"U{d}"], g[f"W{d}"] = gu, np.einsum("ntd,ntz->dz", x, dz_all, optimize=True)
            g[f"c{d}"] = dz_all.sum(axis=(0, 1))
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, batch: int = 24, seed: int = 5) -> None:
        """Adam over shuffled batches. Tag paths are dropped from a part of the blocks, so that
        words and neighbours are learned too."""
        rng = np.random.default_rng(seed)
        m1, m2, step = {k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}, 0
        for _ in range(epochs if pages else 0):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                x, y, mask = pad([pages[i] for i in order[lo:lo + batch]])
                x = x.copy()
                x[:, :, :PATH_DIM] *= rng.random(x.shape[:2])[:, :, None] > 0.15
                step += 1
                for k, g in self.gradients(x, y, mask).items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def label(self, pages: list[np.ndarray], cells: int = 40_000) -> list[np.ndarray]:
        """Main text or not for every block of every page; pages of like length share a batch
        of at most ``cells`` blocks (a longer page is a batch of its own)."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            t = len(pages[order[-1]])
            take = order[-max(1, cells // t):]
            del order[-len(take):]
            x, _, mask = pad([(pages[i], None) for i in take])
            logit = self.logits(x, mask)[0]
            for row, i in zip(logit, take):
                out[i] = row[:len(pages[i])] > 0
        return out


def pad(rows):
    t = max(len(x) for x, _ in rows)
    x, y, mask = np.zeros((len(rows), t, DIM), np.float32), np.zeros((len(rows), t), np.float32), np.zeros((len(rows), t), np.float32)
    for i, (a, b) in enumerate(rows):
        x[i, :len(a)], mask[i, :len(a)] = a, 1
        if b is not None:
            y[i, :len(b)] = b
    return x, y, mask


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> BiLstm:
    """Train on at most ``max_pages`` distinct pages (``page_id, url, html``) with the smallest
    hashes. Only pages under a mark, set by the number of different pages so that about twice
    as many as wanted are left, go further: what reaches the driver does not grow."""
    pages = pages.filter(F.length("html") > 0).select("html", F.xxhash64("page_id", "url", "html").alias("h"))
    total = pages.agg(F.approx_count_distinct("h")).first()[0]
    least, span = -(1 << 63), 1 << 64
    mark = least + min(span - 1, span * 2 * max_pages // max(1, total))
    rows = pages.filter(F.col("h") <= mark).dropDuplicates(["h"]).orderBy("h").limit(max_pages).collect()
    f, data = Features(), []
    for page, _ in rows:
        b = blocks_of(page)
        if b:
            data.append((f.page(b), np.array([teacher(x) for x in b], np.float32)))
    net = BiLstm()
    net.train(data)
    return net


_FEATURES = Features()


def extract(df: DataFrame, net: BiLstm, html_col: str = "html", out: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: the main text of the page."""
    def fn(get):
        pages = [blocks_of(p) for p in texts_of(get(html_col))]
        labels = net.label([_FEATURES.page(b) for b in pages])
        return [pa.array(["\n".join(x.text for x, keep in zip(b, lab) if keep) for b, lab in zip(pages, labels)], pa.string())]

    return apply_steps(df, [Step([(out, T.StringType())], fn)], drop)
