"""Document fingerprints: improbable-feature digests.

Every window of ``WINDOW`` bytes of a text has an entropy. Entropy values, in ``BINS`` steps,
are ranked by how rare they are among the windows of the corpus: the rarer, the better the
rank. A window gains a point for every run of ``RUN`` neighbouring windows in which it has
the best rank (the first on ties); windows with ``POINTS`` or more points are the text's
improbable features. Their hashes go, in order of position, into Bloom filters of ``BITS`` bits
with five hash functions; when a filter holds ``FILL`` features the next one of the chain is begun.

Likeness of two digests: each filter of the one with fewer filters takes its best partner in
the other; the shared bits, less the overlap that chance gives for filters so filled, are
divided by the most that could be shared. The mean over its filters is between 0 and 1.

Texts too short for a feature (under ``WINDOW`` bytes, or without a winning window) fall back to
one feature, the whole text, so that equal texts are always alike and equal fingerprints
mean 1. Null text counts as empty. A digest's length grows with its text; nothing is cut.
Repeated rows get equal digests; input columns named like an output are replaced.

Rarity is counted over the windows of all documents: every task sums a histogram of ``BINS``
cells, which Spark adds up.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import Step, apply_steps, texts_of

WINDOW, BINS, RUN, POINTS = 64, 256, 64, 16
BITS, HASHES, FILL = 2048, 5, 160
#: Bytes worked on at once: keeps the kernel's arrays in bounds for any batch and text.
CHUNK = 1 << 15

#: ``c log c`` of a count in whole steps of 2**-20: sums are exact, so a window's entropy does
#: not depend on what was worked on before it. And its growth from c - 1 to c.
_XLOG = np.rint(np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1))) * (1 << 20)).astype(np.int64)
_GROWTH = np.concatenate([[0], np.diff(_XLOG)])


def window_bins(codes: np.ndarray) -> np.ndarray:
    """Entropy step (0..BINS-1) of every window. The sum of ``c log c`` over a window's byte
    counts changes from one window to the next only by the byte that leaves and the byte that
    enters; their counts are sums of 63 comparisons of the text with itself, shifted."""
    n = len(codes)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (codes[:-k] == codes[k:]).view(np.uint8)
        ahead[:-k] += same  # equal bytes in the window that begins here
        behind[k:] += same  # and in the window that ends here
    first = _XLOG[np.bincount(codes[:WINDOW], minlength=256)].sum()
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = first
    np.cumsum(_GROWTH[behind[WINDOW:]] - _GROWTH[ahead[:n - WINDOW]], out=total[1:])
    total[1:] += first
    entropy = np.log2(WINDOW) - total / float(WINDOW << 20)
    return np.clip(np.rint(entropy * ((BINS - 1) / np.log2(WINDOW))), 0, BINS - 1).astype(np.int64)


def best_of_runs(rank: np.ndarray) -> np.ndarray:
    """For every run of ``RUN`` windows the one with the lowest rank, the first on ties."""
    n = len(rank)
    low = rank * n + np.arange(n)
    width = 1
    while width < RUN:  # minima over windows of doubling width
        step = min(width, RUN - width)
        low = np.minimum(low[:len(low) - step], low[step:])
        width += step
    return low % n


def groups_of(raws: list[bytes]) -> list[list[int]]:
    """Texts worked on together: up to ``CHUNK`` bytes, or one longer text."""
    out: list[list[int]] = []
    size = 0
    for i, r in enumerate(raws):
        if not out or size + len(r) > CHUNK:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(r)
    return out


def features(raws: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the improbable features of every text."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for group in groups_of(raws):
        codes = np.frombuffer(b"".join(raws[i] for i in group), np.uint8)
        sizes = np.array([len(raws[i]) for i in group])
        starts = np.cumsum(sizes) - sizes
        points = np.zeros(len(codes), np.int32)
        span = WINDOW + RUN - 2  # a run's windows reach so far beyond its first byte
        for lo in range(0, max(0, len(codes) - span), CHUNK):
            part = codes[lo:lo + CHUNK + span]
            best = best_of_runs(rank[window_bins(part)])
            at = np.arange(lo, lo + len(best))
            text = np.searchsorted(starts, at, side="right") - 1
            whole = at + span < starts[text] + sizes[text]  # runs that lie in one text
            points[lo:lo + len(part)] += np.bincount(best[whole], minlength=len(part)).astype(np.int32)
        won = np.flatnonzero(points >= POINTS)
        cut = np.searchsorted(won, np.concatenate([starts, [len(codes)]]))
        hashes = window_hashes(codes, won)
        out += [(won[a:b] - s, hashes[a:b]) for a, b, s in zip(cut[:-1], cut[1:], starts)]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows that begin at ``at``."""
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(0, WINDOW, 8):
        h = _mix(h ^ np.ascontiguousarray(eight[at + k]).view("<u8")[:, 0])
    return h


def rarity_rank(histogram: np.ndarray) -> np.ndarray:
    """Rank of every entropy step: 0 the rarest. Equal counts: the lower step."""
    rank = np.empty(BINS, np.int64)
    rank[np.lexsort((np.arange(BINS), histogram))] = np.arange(BINS)
    return rank


def whole_hash(raw: bytes) -> np.ndarray:
    """The one feature of a text without improbable windows."""
    padded = np.frombuffer(raw + bytes(WINDOW - len(raw) % WINDOW), np.uint8)
    parts = window_hashes(padded, np.arange(0, len(padded), WINDOW))
    return _mix(np.bitwise_xor.reduce(parts * np.arange(1, 2 * len(parts), 2, dtype=np.uint64)) ^ np.uint64(len(raw)))[None]


def digests(texts: list[str], rank: np.ndarray) -> list[str]:
    """Chains of filters, in base64: per filter 2 bytes (features held) and its BITS bits."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes = [h if len(h) else whole_hash(r) for r, (_, h) in zip(raws, features(raws, rank))]
    out = []
    for lo in range(0, len(hashes), 64):
        part = hashes[lo:lo + 64]
        chain = [-(-len(h) // FILL) for h in part]  # filters per text
        first = np.cumsum([0, *chain])
        own = np.concatenate([f + np.arange(len(h)) // FILL for f, h in zip(first, part)])
        flat = np.concatenate(part)
        bits = np.zeros((first[-1], BITS), np.uint8)
        for k in range(HASHES):
            bits[own, (flat >> np.uint64(11 * k)) % np.uint64(BITS)] = 1
        held = np.bincount(own, minlength=first[-1]).astype(">u2").view(np.uint8).reshape(-1, 2)
        rows = np.concatenate([held, np.packbits(bits, axis=1)], axis=1)
        out += [base64.b64encode(rows[a:b].tobytes()).decode() for a, b in zip(first[:-1], first[1:])]
    return out


_UNPACK = BITS // 8 + 2


def _filters(fp: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fp), np.uint8).reshape(-1, _UNPACK)
    return np.unpackbits(raw[:, 2:], axis=1).astype(np.float32), raw[:, 0].astype(int) * 256 + raw[:, 1]


def likeness(a: str | None, b: str | None) -> float | None:
    """0 to 1; None if a digest is missing."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (x, nx), (y, ny) = _filters(a), _filters(b)
    if len(x) > len(y) or (len(x) == len(y) and nx[-1] > ny[-1]):
        (x, nx), (y, ny) = (y, ny), (x, nx)
    fx, fy = x.sum(axis=1), y.sum(axis=1)
    best = np.zeros(len(x))
    for lo in range(0, len(x), 512):  # blocks: long chains stay within memory
        shared = x[lo:lo + 512] @ y.T
        most = np.minimum(fx[lo:lo + 512, None], fy)
        chance = fx[lo:lo + 512, None] * fy / BITS
        base = chance + 0.1 * (most - chance)
        best[lo:lo + 512] = (np.maximum(0, shared - base) / np.maximum(1e-9, most - base)).max(axis=1)
    return float(np.clip((best * nx).sum() / nx.sum(), 0, 1))


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Histogram of entropy steps over all windows of all texts (BINS numbers)."""
    def count(batches):
        total = np.zeros(BINS, np.int64)
        for b in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in texts_of(b.column(0))]
            for group in groups_of(raws):
                codes = np.frombuffer(b"".join(raws[i] for i in group), np.uint8)
                ends = np.cumsum([len(raws[i]) for i in group])
                for lo in range(0, max(0, len(codes) - WINDOW + 1), CHUNK):
                    bins = window_bins(codes[lo:lo + CHUNK + WINDOW - 1])
                    at = np.arange(lo, lo + len(bins))
                    total += np.bincount(bins[at + WINDOW <= ends[np.searchsorted(ends, at, side="right")]], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], names=["step", "n"])

    rows = df.select(text_col).mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n")).collect()
    out = np.zeros(BINS, np.int64)
    for step, n in rows:
        out[step] = n
    return out


def digest_step(columns: dict[str, str], rank: np.ndarray) -> Step:
    """Digests of text columns (input: output). Equal texts of a batch are worked on once."""
    def fn(get):
        texts = {c: texts_of(get(c)) for c in columns}
        distinct = list(dict.fromkeys(t for col in texts.values() for t in col))
        known = dict(zip(distinct, digests(distinct, rank)))
        return [pa.array([known[t] for t in texts[c]], pa.string()) for c in columns]

    return Step([(o, T.StringType()) for o in columns.values()], fn)


def likeness_step(pairs: dict[str, tuple[str, str]]) -> Step:
    def fn(get):
        return [pa.array([likeness(x, y) for x, y in zip(get(a).to_pylist(), get(b).to_pylist())], pa.float64()) for a, b in pairs.values()]

    return Step([(o, T.DoubleType()) for o in pairs], fn)


def fingerprint(df: DataFrame, rank: np.ndarray, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the digest of a text column."""
    return apply_steps(df, [digest_step({text_col: out}, rank)])


def _rank_among(col: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` (sorted) that are at most ``col``, by halving; null: 0."""
    given = F.array(*(F.lit(c).cast("long") for c in cuts))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        up = (a["lo"] < a["hi"]) & (F.coalesce(given[F.least(mid, F.lit(len(cuts) - 1))] <= col, F.lit(False)))
        return F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(F.least(mid, a["hi"])).alias("hi"))

    if not cuts:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())),
                       F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda a: a["lo"])


def with_next(df: DataFrame, order_col: str, value_col: str, out: str, parts: int) -> DataFrame:
    """Adds ``out``: the value of the next row by ``order_col`` (after the last: of the first).

    Rows are dealt into blocks of neighbouring ids whose borders are quantiles of the ids: at
    most ``parts`` numbers, however large the table. The first row of a block is also sent to
    the block before it and the first of all to the last block, so every row finds its
    successor in its own block, and one shuffle moves each value once. Null ids come first;
    rows of one id are ordered by value. Of an empty table nothing is made."""
    key = F.col(order_col)
    least, nulls, cuts = df.agg(F.min(key), F.count_if(key.isNull()),
                                F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()
    cuts = sorted({c for c in cuts or [] if c != least})
    first = key.isNull() if nulls else F.coalesce(key == F.lit(least), F.lit(False))
    block = _rank_among(key, cuts)
    opens = F.array_contains(F.array(*(F.lit(c).cast("long") for c in cuts)), key) if cuts else F.lit(False)
    to = F.filter(F.array(F.struct(block.alias("block"), F.lit(False).alias("tail")),
                          F.when(opens, F.struct((block - 1).alias("block"), F.lit(True).alias("tail"))),
                          F.when(first, F.struct(F.lit(len(cuts)).alias("block"), F.lit(True).alias("tail")))),
                  lambda x: x.isNotNull())
    w = Window.partitionBy("_to.block").orderBy("_to.tail", key.asc_nulls_first(), value_col)
    return df.withColumn("_to", F.explode(to)).withColumn(out, F.lead(value_col).over(w)).filter("not _to.tail").drop("_to")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by as many of the following one's
    first (all of them if it is shorter)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
