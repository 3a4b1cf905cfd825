"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into ``FEATURES`` numbers (lengths, character classes,
repetition, word shapes); nothing else of a row is an input. ``fit`` bins every statistic
by quantiles, grows depth-limited trees on gradient histograms and flattens them into
arrays (feature, threshold, children, leaf value); ``Trees.score`` walks all trees for all
rows of a batch at once with numpy.

Fitting uses at most ``max_rows`` labelled rows, chosen by a hash of the id: a documented
bound. Scoring covers every row and whole texts.

Null text counts as empty and gets a score like any other. Without labelled rows the score
is 0.5; with one class only, that class' share. Null labels are left out; when an id has
several labels, their mean decides (a tie counts as 1). Columns of the input named
``score`` are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import Step, apply_steps, takes_over, texts_of

MAX_ROWS = 12_000
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 60, 4, 64, 0.15, 1.0, 8

#: Classes of bytes: letters, capitals, digits, blanks, line ends, sentence marks, other
#: ASCII signs, bytes of longer characters.
_KIND = np.full(256, 6, np.int64)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"-")):
    _KIND[list(_set)] = _k
_KIND[128:] = 7
_SIGNS = b"!#$%&*|<>{}[]=_@/\\~^+"

FEATURES = ("log_bytes", "log_words", "mean_word", *(f"share_{k}" for k in ("lower", "upper", "digit", "blank", "line", "stop", "sign", "wide")),
            *(f"sign_{chr(c)}" for c in _SIGNS), "distinct_words", "repeat_next", "distinct_pairs", "top_word", "distinct_lines",
            "line_words", "sign_words", "upper_words", "long_words", "digit_words", "repeat_second")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(codes, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / n
    words = raw.split()
    m = max(1, len(words))
    lines = raw.split(b"\n")
    pairs = list(zip(words, words[1:]))
    same = sum(a == b for a, b in pairs)
    second = sum(a == b for a, b in zip(words, words[2:]))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    signs = sum(c for w, c in tally.items() if not (w[-1:].isalnum() or w[-1] in b".,;:?'\"" or w[-1] > 127))
    upper = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
    digits = sum(c for w, c in tally.items() if w[0] in b"0123456789")
    long = sum(c for w, c in tally.items() if len(w) > 20)
    return [np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - counts[32]) / m, *kinds.tolist(),
            *(counts[c] / n for c in _SIGNS), len(tally) / m, same / m, len(set(pairs)) / max(1, len(pairs)),
            max(tally.values(), default=0) / m, len(set(lines)) / len(lines), len(words) / len(lines), signs / m, upper / m,
            long / m, digits / m, second / m]


def matrix(texts: list[str]) -> np.ndarray:
    takes_over("quality")
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Boosted trees, flattened: all trees share the arrays, ``roots`` are their first nodes."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):  # leaves lead to themselves
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting on logistic loss with per-feature quantile bins."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    constant = len(np.unique(y)) < 2
    if not constant:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width = BINS + 1
        flat = bins + np.arange(x.shape[1]) * width
        raw = np.full(len(y), base)
    for _ in range(0 if constant else trees):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = q - y, q * (1 - q)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[node][4] = leaf = -RATE * g / (h + L2)
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * MIN_ROWS:
                size, cells = x.shape[1] * width, flat[rows].ravel()
                gs, hs, ns = (np.bincount(cells, weights=np.repeat(w, x.shape[1]), minlength=size).reshape(-1, width).cumsum(axis=1)
                              for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + L2) + (g - gs) ** 2 / (h - hs + L2) - g * g / (h + L2)
                gain[(ns < MIN_ROWS) | (len(rows) - ns < MIN_ROWS)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                best = max(best, (float(gain[j, b]), int(j), int(b)))
            if best[1] < 0:
                raw[rows] += leaf
                continue
            _, j, b = best
            go = bins[rows, j] <= b
            nodes[node][:4] = [j, cuts[j][min(b, len(cuts[j]) - 1)], len(nodes), len(nodes) + 1]
            for part in (rows[go], rows[~go]):
                todo.append((len(nodes), part, level + 1))
                nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(base, np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int),
                 a[:, 4], depth)


def training_rows(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, y`` of at most ``max_rows`` labelled rows that pass ``keep`` (a condition on
    ``doc_id``), the first by a hash of the id. The rows are chosen among the labels, so the
    join's small side holds ``max_rows`` ids at most and is broadcast."""
    picked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(keep)
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Fit on ``text, y``. Statistics are computed by Spark; at most ``max_rows`` rows of
    numbers reach the driver (repeated ids could give more rows, hence the second limit)."""
    def stats(get):
        m = matrix(texts_of(get("text")))
        return [pa.array(m.tolist(), pa.list_(pa.float64()))]

    got = apply_steps(rows, [Step([("x", T.ArrayType(T.DoubleType()))], stats)], drop=("text",)).limit(max_rows).collect()
    got = sorted((r["y"], *r["x"]) for r in got)  # the order of arrival must not matter
    a = np.array(got, float).reshape(len(got), 1 + len(FEATURES))
    return fit(a[:, 1:], a[:, 0])


def score(df: DataFrame, model: Trees, text_col: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: the model's probability (0 to 1) that the text is of good quality."""
    def fn(get):
        return [pa.array(model.score(matrix(texts_of(get(text_col)))), pa.float64())]

    return apply_steps(df, [Step([(out, T.DoubleType())], fn)], drop)
