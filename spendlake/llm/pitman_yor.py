"""LM scoring with a hierarchical Pitman-Yor model.

Tokens are words (runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased) and one end per text. Words
with at least 1/``SYMBOLS`` of all training tokens are symbols of their own (at most ``SYMBOLS``),
as is the end; all other words share one symbol. The model is

* a restaurant for every word (and the end) as a context, whose customers are the words that follow
  it, all pairs counted; its base is what the levels above give the pair;
* a context restaurant for every symbol, whose customers are the symbols that follow it; all of
  them share one parent, the restaurant of the single symbols, whose base is uniform;
* for words without a symbol of their own, a restaurant of words below the shared symbol, with
  a uniform base over its words and one unknown word.

The base of a pair is its symbol's probability after the symbol before it (the end before the first)
times, for the shared symbol, its word's. The levels above the pairs are fitted to all tokens first and
held while the pairs are seated; tables of pairs are not fed back to them.

Pairs are counted, and seated, in a Spark table dealt by context. With ``x ~ Gamma(theta / d + T)`` for each
context the tables of its pairs are independent, ``p(t | c, x) ~ S(c, t) (d x P(pair))^t``, so a sweep draws all
of them at once; chains and samples are as below. A context of more than ``SALT`` tokens is dealt in parts by a
hash of the follower; a part takes its own tables times the number of parts for ``T``, while the
probabilities use the tables of all parts.

Above the pairs, seating is sampled by Gibbs. The state is the number of tables of every dish in every restaurant;
a dish's tables are drawn, given everything else, from their exact conditional

    p(t | c) ~ S(c, t) * P(dish)^t * prod_{k<t} (theta + d (T + k))

(``S`` generalised Stirling numbers, ``T`` the other dishes' tables), dish after dish, side by side in
all restaurants of a level; the parent's distribution is then drawn given its customers, which are
the tables below. Customers beyond ``CROWD`` of a dish open tables as a Poisson draw of the summed
chance: by then it is small and hardly depends on the tables. Words of equal count are
exchangeable and drawn together. ``CHAINS`` chains run in Spark tasks of their own; predictive
probabilities are averaged over the samples after burn-in of all chains.

The corpus counts cover all training rows. What travels to every task is bounded: words with at
least 1/``SENT`` of all tokens (at most ``SENT``), the end, and the symbol table (at most (SYMBOLS + 2)^2
numbers). Pairs are dealt to groups of about ``SPLIT * HELD`` tokens by context, counted, seated and met by the pairs of the
texts there; words travel in them as places among the words that every task has, others as 64-bit hashes, in
compressed columns (see ``packed``), a row for a group and some ``CHUNK`` tokens of texts. Unseen pairs take the
share that their context leaves to the base; a rare word's count is kept beside its pairs, and only those of
unseen pairs are joined with the counts, on a 64-bit hash; none of them is frequent, so no key is hot. Shuffle
files are given up when the table that they led to is written.

Null text counts as empty: it has one token, the end. Repeated rows get equal results. With no
training rows every probability is the base's. Other columns than ``doc_id`` and the text are
not carried.
"""
from __future__ import annotations

import math
import struct
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm import common
from spendlake.llm.common import give_back, texts_of

SYMBOLS, SENT = 1024, 1 << 19
#: Tokens of a context (or of a part of it) and pairs of a block that are seated together.
SALT, BLOCK = 1 << 14, 1 << 14
CHAINS, BURN, SAMPLES, CROWD, THETA = 4, 8, 12, 300, 1.0
#: Blocks whose draws a task works out side by side.
TOGETHER = 32
#: Tokens of the contexts whose pairs are held at a time, how many of these make a group that a task gets, and tokens of the
#: texts whose pairs a task deals at a time.
HELD, SPLIT, CHUNK = 1 << 19, 8, 1 << 19
#: Words that a task counts before it passes them on.
FLUSH = 1 << 21
#: Spark's settings while a table is written: shuffle files go when the query that wrote them ends, and long records travel
#: to Python in few.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: The end token; no word contains white space.
END = b"\n"
#: The base of ``base_score``: added to every count.
ADD = 0.1


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``common.written``; the shuffle files behind the table are given up with it."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        conf.set(k, v)
    try:
        return common.written(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and how many each text has: as ``words_of``, for a column."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty ones
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return words.filter(real), np.diff(before[np.append(0, ends)])


def bytes_of(words: pa.Array) -> list[bytes]:
    _, ends, data = words.cast(pa.large_binary()).buffers()
    if not len(words):
        return []
    ends, data = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1].tolist(), data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def hashes_of(words: pa.Array) -> np.ndarray:
    """Spark's ``xxhash64`` of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, bytes_of(words), repeat(42)), np.uint64, len(words)).view(np.int64)


def chained(codes: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The words' codes with the end's before the first text and after each: neighbours are the pairs, as
    the end of a text is the context of the next one's first word."""
    flat = np.full(len(codes) + len(lengths) + 1, end, np.int64)
    word = np.ones(len(flat), bool)
    word[np.append(0, np.cumsum(lengths + 1))] = False
    flat[word] = codes
    return flat


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``n``: all tokens of the texts, ends included."""
    def counted(held, texts):
        found = pc.value_counts(pa.concat_arrays(held))
        words = pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([END], pa.binary())])
        return pa.RecordBatch.from_arrays([words, pa.concat_arrays([found.field("counts"), pa.array([texts])])], names=["word", "n"])

    def run(batches):
        held, tokens, texts = [], 0, 0
        for b in batches:
            held.append(tokens_of(b.column(0))[0])
            tokens += len(held[-1])
            texts += b.num_rows
            if tokens >= FLUSH:
                yield counted(held, texts)
                held, tokens, texts = [], 0, 0
        if texts:
            yield counted(held, texts)
        held.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_counts(docs: DataFrame, symbol: dict[bytes, int]) -> np.ndarray:
    """How often each symbol follows each other one; unlisted words are the last symbol."""
    size, rest = len(symbol) + 1, len(symbol)
    end = symbol[END]

    def run(batches):
        total, listed = np.zeros(size * size, np.int64), pa.array([*symbol], pa.binary())
        for b in batches:
            words, lengths = tokens_of(b.column(0))
            s = chained(pc.index_in(words.cast(pa.binary()), listed).fill_null(rest).to_numpy(), lengths, end)
            np.add.at(total, s[:-1] * size + s[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros(size * size, np.int64)
    for pair, n in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(size, size)


#: Columns of a record of pairs, of their seats, and of what texts sum up to.
PAIRS, SEATS, SUMS = ("u", "u_other", "n", "w", "w_other", "k", "text"), ("tables", "left", "rare"), ("uid", "score", "base", "known")
COLUMN = struct.Struct("<cBII")


def packed(**columns: np.ndarray) -> bytes:
    """Columns of any lengths in one record, each in the smallest type and compressed."""
    out = [bytes([len(columns)])]
    for x in columns.values():
        if x.dtype.kind == "i" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(x.max()))
        raw = x.tobytes()
        small = pa.compress(raw, "zstd", asbytes=True) if len(raw) > 64 else raw
        small = small if len(small) < len(raw) else raw
        out += [COLUMN.pack(x.dtype.kind.encode(), x.dtype.itemsize, len(x), len(small)), small]
    return b"".join(out)


def unpacked(record: pa.Scalar, names: tuple[str, ...] = PAIRS) -> dict[str, np.ndarray]:
    data, at, out = record.as_py(), 1, {}
    for name in names[:data[0]]:
        kind, width, length, size = COLUMN.unpack_from(data, at)
        at += COLUMN.size + size
        raw = data[at - size:at]
        if size < length * width:
            raw = pa.decompress(raw, length * width, "zstd", asbytes=True)
        x = np.frombuffer(raw, f"{kind.decode()}{width}")
        out[name] = x if x.dtype.kind == "f" else x.astype(np.int64)
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[:len(x)])
    return at, np.diff(np.append(at, len(x)))


def distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns with values under ``sizes``, in order, and how often each occurs."""
    if math.prod(sizes) < 1 << 62:
        key = columns[0]
        for x, size in zip(columns[1:], sizes[1:]):
            key = key * size + x
        key = np.sort(key)
        at, k = runs(key)
        key, out = key[at], []
        for size in sizes[:0:-1]:
            key, x = np.divmod(key, size)
            out.append(x)
        return [key, *out[::-1]], k
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def context_hash(u: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(u, salt)`` of a long and an int."""
    p1, p2, p3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    p4, p5 = np.uint64(0x85EBCA77C2B2AE63), 0x27D4EB2F165667C5
    h = np.uint64(42 + 8 + p5) ^ (_turned(u.view(np.uint64) * p2, 31) * p1)
    h = _mixed(_turned(h, 27) * p1 + p4)
    h = (h + np.uint64(p5 + 4)) ^ (salt.astype(np.uint64) * p1)
    return _mixed(_turned(h, 23) * p2 + p3).view(np.int64)


def deal(docs: DataFrame, known: "Known", by_text: bool) -> DataFrame:
    """``g, pairs, uid``: how often a word follows another in some texts (``by_text``: in each of them, ``uid``), for each
    group of contexts; ``pairs`` has a packed record for each of its ``SPLIT`` shares."""
    end = signed_hash(END)

    def rows(held):
        words, lengths, uid = (list(x) for x in zip(*held))
        coded = pa.concat_arrays(words).dictionary_encode()
        h = np.append(hashes_of(coded.dictionary), end)
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h = h[order]
        lengths, uid = np.concatenate(lengths), np.concatenate(uid)
        flat = chained(rank[coded.indices.to_numpy()], lengths, rank[-1])
        if by_text:
            (u, w, text), k = distinct([flat[:-1], flat[1:], np.repeat(np.arange(len(uid)), lengths + 1)], [len(h), len(h), len(uid)])
        else:
            (u, w), k = distinct([flat[:-1], flat[1:]], [len(h), len(h)])
        at = known.at(h)
        share = known.dealt(h, at, u, h[w]) % known.shares
        order = np.argsort(share.astype(np.min_scalar_type(known.shares)), kind="stable")
        spans = {int(share[order[i]]): order[i:i + n] for i, n in zip(*runs(share[order]))}
        groups = sorted({i // SPLIT for i in spans})
        records, uids = [], []
        for g in groups:
            here = [spans.get(i, order[:0]) for i in range(g * SPLIT, g * SPLIT + SPLIT)]
            used = np.zeros(len(uid), bool)
            if by_text:
                for i in here:
                    used[text[i]] = True
            place = np.cumsum(used) - 1
            records.append([packed(**known.coded(h[u[i]], h[w[i]], at[u[i]], at[w[i]]), k=k[i], **({"text": place[text[i]]} if by_text else {}))
                            if len(i) else None for i in here])
            uids.append(uid[used])
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(records, pa.list_(pa.binary())), pa.array(uids, pa.list_(pa.int64()))],
                                          names=["g", "pairs", "uid"])

    def run(batches):
        held, tokens = [], 0
        for b in batches:
            text = b.column("text")
            words, lengths = tokens_of(text)
            ids = [text_id(i, t) for i, t in zip(b.column("doc_id").to_pylist(), texts_of(text))] if by_text else [0] * len(text)
            if len(lengths):
                held.append((words, lengths, np.array(ids, np.int64)))
            tokens += len(words) + len(lengths)
            if tokens >= CHUNK:
                yield rows(held)
                held, tokens = [], 0
                give_back()
        if held:
            yield rows(held)
        held.clear()
        give_back()

    return docs.select(*["doc_id"] * by_text, "text").mapInArrow(run, "g int, pairs array<binary>, uid array<long>")


def count_pairs(docs: DataFrame, known: "Known") -> DataFrame:
    """A row per share of a group of contexts: ``g, share``, its pairs in order with their counts, packed, how many these are,
    and how many have one and two customers."""
    def counted(cells: list[pa.Scalar]) -> tuple[bytes, np.ndarray]:
        all_u, all_w, all_k = [], [], []
        for record in cells:
            x = unpacked(record)
            u, n, w = known.decoded(x)
            all_u.append(np.repeat(u, n))
            all_w.append(w)
            all_k.append(x["k"])
        u, w, k = (np.concatenate(x) for x in (all_u, all_w, all_k))
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
        c = np.add.reduceat(k[order], first)
        return packed(**known.coded(u[first], w[first]), k=c), c

    def run(cells: pa.Table) -> pa.Table:
        rows = []
        for i in range(SPLIT):
            if here := [r for x in cells["pairs"] if (r := x.values[i]).is_valid]:
                record, c = counted(here)
                give_back()
                rows.append({"g": cells["g"][0].as_py(), "share": i, "pairs": record, "total": len(c), "ones": int((c == 1).sum()), "twos": int((c == 2).sum())})
        return pa.Table.from_pylist(rows, pa.schema([("g", pa.int32()), ("share", pa.int32()), ("pairs", pa.binary()), ("total", pa.int64()),
                                                     ("ones", pa.int64()), ("twos", pa.int64())]))

    return deal(docs, known, False).groupBy("g").applyInArrow(run, "g int, share int, pairs binary, total long, ones long, twos long")


def seat(ctx: np.ndarray, c: np.ndarray, base: np.ndarray, parts: np.ndarray, d: float, stirling: np.ndarray, seed,
         starts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of pairs with ``c`` customers in the contexts ``ctx`` (0, 1, ..), and of the contexts, over the
    samples of all chains. ``parts``: in how many parts each context is dealt. Blocks of pairs that draw with a
    ``seed`` each may be given together: ``starts`` are their first pairs and their first contexts."""
    row_at, ctx_at = starts or (np.zeros(1, np.int64), np.zeros(1, np.int64))
    rngs = [np.random.default_rng(int(x)) for x in np.atleast_1d(seed)]
    size, k = len(parts), CHAINS * SAMPLES
    ctx_ends = np.append(ctx_at[1:], size)
    alone = np.bincount(ctx[c == 1], minlength=size).astype(float)
    more = np.flatnonzero(c > 1)
    block = np.searchsorted(row_at, more, "right") - 1
    order = np.lexsort((c[more], block))
    more, block = more[order], block[order]
    # a block draws for its pairs by their number of customers, in slices, chain after chain
    edges = [3, 4, 6, 10, 18, 40, 100]
    slices, n = runs(block * (len(edges) + 1) + np.searchsorted(edges, c[more], "right"))
    first, width = np.repeat(slices, n), np.repeat(n, n)
    place = CHAINS * first + (np.arange(len(more)) - first) + np.arange(CHAINS)[:, None] * width
    draws = np.bincount(block, minlength=len(rngs)) * CHAINS
    order = np.argsort(c[more], kind="stable")
    rows, place, block = more[order], place[:, order], block[order]
    n, at, strength = c[rows], ctx[rows], d * base[rows]
    cells = (at + size * np.arange(CHAINS)[:, None]).ravel()
    alike = [(int(n[i]), slice(i, i + m)) for i, m in zip(*runs(n)) if n[i] < 18]
    wide = []
    widths = [18, 24, 31, 40, 55, 75, 100, 150, 220]
    for low, high in zip(widths, [*widths[1:], None]):
        here = slice(np.searchsorted(n, low), len(n) if high is None else np.searchsorted(n, high))
        if here.start < here.stop:
            most = int(min(CROWD, n[here].max()))
            wide.append((here, np.arange(1, most + 1), stirling[np.minimum(n[here], most), 1:most + 1]))
    crowded = np.flatnonzero(n > CROWD)
    crowds = [(rngs[i], crowded[block[crowded] == i]) for i in np.unique(block[crowded])]
    tables = np.repeat(np.bincount(ctx, minlength=size)[None].astype(float), CHAINS, axis=0)
    drawn, sums, mean_all = np.ones((CHAINS, len(rows))), np.zeros(len(rows)), np.zeros(size)
    for sweep in range(BURN + SAMPLES):
        shape = THETA / d + tables * parts
        x, r = [], []
        for rng, i, j, m in zip(rngs, ctx_at, ctx_ends, draws):
            x.append(rng.gamma(shape[:, i:j]))
            r.append(rng.random(m))
        a = strength * np.maximum(np.concatenate(x, axis=1), 1e-300)[:, at]
        r = np.concatenate(r)[place]
        for most, here in alike:  # in the chances' own scale: powers of so few tables stay small
            s, power, upto = np.exp(stirling[most, 1:most + 1] - stirling[most, 1]), a[:, here], [1.0]
            for t in range(1, most):
                upto.append(upto[-1] + s[t] * power)
                power = power * a[:, here]
            y = r[:, here] * upto.pop()
            drawn[:, here] = 1 + sum((z < y).astype(float) for z in upto)
        for here, t, s in wide:
            p = np.log(a[:, here])[:, :, None] * t
            p += s
            p -= p.max(axis=2, keepdims=True)
            p = np.cumsum(np.exp(p, out=p), axis=2, out=p)
            drawn[:, here] = np.minimum(1 + (p < r[:, here, None] * p[:, :, -1:]).sum(axis=2), len(t))
        for rng, i in crowds:
            late = a[:, i] * np.log(np.maximum(n[i] - d * drawn[:, i] + a[:, i], 1e-9) / np.maximum(CROWD - d * drawn[:, i] + a[:, i], 1e-9))
            drawn[:, i] += np.minimum(rng.poisson(late), n[i] - CROWD)
        tables = alone + np.bincount(cells, weights=drawn.ravel(), minlength=CHAINS * size).reshape(CHAINS, size)
        if sweep >= BURN:
            sums += drawn.sum(axis=0)
            mean_all += tables.sum(axis=0) / k
    mean = np.where(c == 1, 1.0, 0.0)
    mean[rows] = sums / k
    return mean, mean_all


def log_stirling(d: float, most: int = CROWD) -> np.ndarray:
    """Logarithms of generalised Stirling numbers ``S(c, t)``, 0 <= t <= c <= most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = s[c] + np.log(np.maximum(c - d * t, 0))
            s[c + 1, 0] = -np.inf
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay[1:])
    return s


def table_weights(c: np.ndarray, strength: np.ndarray, others: np.ndarray, d: float, stirling: np.ndarray) -> np.ndarray:
    """Normalised conditional of the number of tables (columns 0..most) of dishes with ``c``
    customers, base probability ``strength`` and ``others`` tables of other dishes."""
    most = int(min(CROWD, c.max()))
    t = np.arange(most + 1)
    rise = np.concatenate([np.zeros((len(c), 1)), np.cumsum(np.log(THETA + d * (others[:, None] + t[:-1])), axis=1)], axis=1)
    w = stirling[np.minimum(c, most), :most + 1] + t * np.log(strength)[:, None] + rise
    w = np.exp(w - w.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True)


def draw_tables(rng, c, strength, others, d, stirling) -> np.ndarray:
    """One Gibbs draw of the tables of each dish (0 where there are no customers)."""
    out = np.zeros(len(c), np.int64)
    has = np.flatnonzero(c > 0)
    if len(has):
        c, strength, others = c[has], strength[has], others[has]
        w = table_weights(c, strength, others, d, stirling).cumsum(axis=1)
        t = (w < rng.random((len(c), 1))).sum(axis=1)
        t = np.clip(t, 1, np.minimum(c, CROWD))
        many = c > CROWD
        a = (THETA + d * (others + t)) * strength
        late = a * np.log((c - d * t + a) / (CROWD - d * t + a), out=np.zeros(len(c)), where=many)
        t = t + np.minimum(rng.poisson(np.maximum(late, 0)), np.maximum(c - CROWD, 0))
        out[has] = t
    return out


def discount(ones: float, twos: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.1, 0.95))


def run_chain(counts: np.ndarray, coc: list[tuple[int, int, int]], seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One chain: sums over samples of the predictive table ``P(next | symbol)``, of the mean
    tables per count bin of words, and of their total."""
    rng = np.random.default_rng(seed)
    size = len(counts)
    d = discount((counts == 1).sum(), (counts == 2).sum())
    d1 = 0.5
    s2, s1 = log_stirling(d), log_stirling(d1)
    tables = np.minimum(counts, 1)
    g = np.full(size, 1 / size)
    t1 = np.ones(size, np.int64)
    total = counts.sum(axis=1)
    predictive = np.zeros((size, size))
    reps = np.array([c for _, c, _ in coc], np.int64)
    n = np.array([k for _, _, k in coc], np.int64)
    types = int(n.sum())
    dw = discount(int(n[reps == 1].sum()), int(n[reps == 2].sum()))
    sw = log_stirling(dw)
    mean = np.ones(len(coc))
    mean_sum, total_sum = np.zeros(len(coc)), 0.0
    all_tables = float(types)
    for sweep in range(BURN + SAMPLES):
        for w in range(size):  # dish after dish, in all context restaurants at once
            others = tables.sum(axis=1) - tables[:, w]
            tables[:, w] = draw_tables(rng, counts[:, w], np.full(size, g[w]), others, d, s2)
        c1 = tables.sum(axis=0)
        for w in np.flatnonzero(c1):
            t1[w] = draw_tables(rng, c1[w:w + 1], np.array([1 / size]), np.array([t1[c1 > 0].sum() - t1[w]]), d1, s1)[0]
        t1[c1 == 0] = 0
        g = rng.dirichlet(np.maximum(c1 - d1 * t1, 0) + (THETA + d1 * t1.sum()) / size)
        g = np.maximum(g, 1e-12) / np.maximum(g, 1e-12).sum()
        if types:
            others = np.full(len(coc), max(all_tables - 1, 0))
            p = table_weights(reps, np.full(len(coc), 1 / (types + 1)), others, dw, sw)
            drawn = rng.multinomial(n, p) @ np.arange(p.shape[1])
            a = (THETA + dw * others) / (types + 1)
            base = drawn / n
            late = np.where(reps > CROWD, a * np.log(np.maximum(reps - dw * base + a, 1) / np.maximum(CROWD - dw * base + a, 1)), 0)
            mean = base + rng.poisson(np.maximum(late, 0) * n) / n
            all_tables = float((mean * n).sum())
        if sweep >= BURN:
            predictive += (np.maximum(counts - d * tables, 0) + (THETA + d * tables.sum(axis=1, keepdims=True)) * g) / (THETA + total[:, None])
            mean_sum += mean
            total_sum += all_tables
    return predictive, mean_sum, total_sum


def _bin(n: Column) -> Column:
    """Count bin of a word: its count up to CROWD, then eighths of doublings."""
    return F.when(n <= CROWD, n).otherwise(CROWD + 1 + F.floor(8 * F.log2(n / CROWD))).cast("int")


class Model:
    """Averaged predictive probabilities, in base-10 logarithms, and what scoring needs."""

    def __init__(self, sent: list[tuple[bytes, int]], tokens: int, types: int):
        self.tokens, self.types = tokens, types
        self.symbol: dict[bytes, int] = {}
        for w, n in sent:
            if n * SYMBOLS >= tokens or w == END:
                self.symbol[w] = len(self.symbol)
        self.symbol.setdefault(END, len(self.symbol))
        self.sent = dict(sent)

    def base(self, n):
        return np.log10((n + ADD) / (self.tokens + ADD * (self.types + 1)))

    def finish(self, chains, coc) -> None:
        k = CHAINS * SAMPLES
        self.pairs = np.log10(sum(c[0] for c in chains) / k)
        self.words = int(sum(n for _, _, n in coc))
        self.customers = int(sum(s for s, _, _ in self.coc_sums)) if self.words else 0
        self.discount = discount(sum(n for _, c, n in coc if c == 1), sum(n for _, c, n in coc if c == 2))
        self.mean_tables = {b: m / k for (b, _, _), m in zip(coc, sum(c[1] for c in chains))}
        tables = sum(c[2] for c in chains) / k
        #: probability that the shared symbol's word is a given one of its base
        self.open = (THETA + self.discount * tables) / (self.words + 1) / (THETA + self.customers)

    def log_words(self, n: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of the probabilities of words of the shared symbol, by count."""
        of, back = np.unique(n, return_inverse=True)
        return np.array([math.log10(self.word_probability(int(k), self.mean_tables.get(_bin_of(int(k)), 1.0) if k else 0.0)) for k in of] + [0.0])[back]

    def word_probability(self, n: int, tables: float) -> float:
        return max(n - self.discount * tables, 0) / (THETA + self.customers) + self.open


def _bin_of(n: int) -> int:
    return n if n <= CROWD else CROWD + 1 + math.floor(8 * math.log2(n / CROWD))


class Known:
    """By hash: what travels of words to every task."""

    def __init__(self, model: Model):
        rest = len(model.symbol)
        sent = {**model.sent, END: model.sent.get(END, 0)}
        h = np.array([signed_hash(w) for w in sent], np.int64)
        order = np.argsort(h)
        n, symbol = np.array([*sent.values()], np.int64), np.array([model.symbol.get(w, rest) for w in sent], np.int64)
        word = np.where(symbol == rest, model.log_words(n), 0.0)
        self.h = h[order]
        # the last entry stands for all other words
        self.n, self.symbol, self.word = np.append(n[order], 0), np.append(symbol[order], rest), np.append(word[order], 0.0)
        self.parts = np.maximum(1, -(-self.n // SALT))
        self.shares = max(1, -(-model.tokens // HELD))
        self.groups = -(-self.shares // SPLIT)

    def at(self, h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[i] == h, i, -1)

    def dealt(self, h: np.ndarray, at: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What pairs are dealt by: a hash of the context and, if it is dealt in parts, of its part. ``u``: places in
        the hashes ``h``, ``at`` theirs among the words that travel; ``w``: hashes of the followers."""
        out = context_hash(h, np.zeros(len(h), np.int64))[u]
        parts = self.parts[at]
        more = np.flatnonzero(parts[u] > 1)
        salt = w[more].view(np.uint64) % parts[u[more]].astype(np.uint64)
        out[more] = context_hash(h[u[more]], salt)
        return out

    def coded(self, u: np.ndarray, w: np.ndarray, ku: np.ndarray | None = None, kw: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Columns of pairs (hashes) whose contexts stand together: the places of words that travel (``ku, kw``), from 1,
        and the hashes of the others (0)."""
        first, n = runs(u)
        u = u[first]
        ku, kw = self.at(u) if ku is None else ku[first], self.at(w) if kw is None else kw
        return {"u": ku + 1, "u_other": u[ku < 0], "n": n, "w": kw + 1, "w_other": w[kw < 0]}

    def decoded(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts (hashes), how many pairs each has, and the words of the pairs."""
        out = []
        for name in "uw":
            h = self.h[x[name] - 1]
            h[x[name] == 0] = x[f"{name}_other"]
            out.append(h)
        return out[0], x["n"], out[1]


def rare_words(vocab: DataFrame, model: Model) -> DataFrame:
    """Hash and count of the words that do not travel."""
    return vocab.filter((F.col("n") * SENT < model.tokens) & (F.col("word") != F.lit(END))).select(F.xxhash64("word").alias("h"), "n")


class Seated:
    """The seated pairs of the training texts. Unpacks to all pairs with their log-probability (``u, w, lp``), the share
    that each context leaves to the base (``u, left, dealt``), and the words that travel."""

    def __init__(self, rows: DataFrame, known: Known, model: Model, discount: float, hot: list[tuple[int, float]]):
        #: ``g, share, pairs, seats``: for each share of a group of contexts a row with its pairs and one with their seats
        self.rows, self.known, self.discount = rows, known, discount
        self.symbols, self.size, self.log_words = model.pairs.ravel(), len(model.pairs), model.log_words
        hot = sorted(hot)
        #: contexts dealt in parts (at most SENT words are as frequent), and what they leave to the base
        self.hot, self.hot_left = np.array([u for u, _ in hot], np.int64), np.array([x for _, x in hot], float)

    def __getstate__(self):
        return self.__dict__ | {"rows": None}

    def __iter__(self):
        return iter((self.pairs(), self.contexts(), self.known))

    def log_symbols(self, ku: np.ndarray, kw: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of what the levels above give pairs, without rare words' own part."""
        return self.symbols[self.known.symbol[ku] * self.size + self.known.symbol[kw]] + self.known.word[kw]

    def log_base(self, ku: np.ndarray, kw: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The same with it; ``rare``: counts of the words that do not travel, in order."""
        out = self.log_symbols(ku, kw)
        out[kw < 0] += self.log_words(rare)
        return out

    def opened(self, pairs: pa.Scalar, seats: pa.Scalar) -> tuple[np.ndarray, ...]:
        """Contexts of a share, how many pairs each has, and what it leaves to the base; the pairs' words, log-probabilities
        and (of rare words) counts."""
        x, y = unpacked(pairs), unpacked(seats, SEATS)
        u, n, w = self.known.decoded(x)
        ku, kw = self.known.at(u), self.known.at(w)
        first = np.cumsum(n) - n
        left, several = y["left"].copy(), np.isnan(y["left"])
        left[several] = self.hot_left[np.searchsorted(self.hot, u[several])]
        customers = np.where(several, self.known.n[ku], np.add.reduceat(x["k"], first))
        a = np.maximum(x["k"] - self.discount * (y["tables"] / (CHAINS * SAMPLES)), 0) / (THETA + np.repeat(customers, n))
        lp = np.log10(a + np.repeat(left, n) * 10 ** self.log_base(np.repeat(ku, n), kw, y["rare"]))
        rare = np.zeros(len(w), np.int64)
        rare[kw < 0] = y["rare"]
        return u, n, left, several, w, lp, rare

    def _unpacked(self, of, schema: str) -> DataFrame:
        def run(batches):
            for b in batches:
                for pairs, seats in zip(b.column("pairs"), b.column("seats")):
                    yield pa.RecordBatch.from_pydict(of(self.opened(pairs, seats)))

        return self.rows.groupBy("g", "share").agg(F.max("pairs").alias("pairs"), F.max("seats").alias("seats")).select("pairs", "seats").mapInArrow(run, schema)

    def pairs(self) -> DataFrame:
        return self._unpacked(lambda x: {"u": np.repeat(x[0], x[1]), "w": x[4], "lp": x[5]}, "u long, w long, lp double")

    def contexts(self) -> DataFrame:
        return self._unpacked(lambda x: {"u": x[0], "left": x[2], "dealt": x[3]}, "u long, left double, dealt boolean").distinct()


def seat_pairs(docs: DataFrame, vocab: DataFrame, model: Model) -> Seated:
    """All pairs of the training texts ``docs``, seated."""
    known = Known(model)
    counted = written(count_pairs(docs, known), "pair-counts")
    total, ones, twos = counted.agg(F.sum("total"), F.sum("ones"), F.sum("twos")).first()
    d = discount(ones or 0, twos or 0)
    # a block of pairs that are seated together lies in one share
    blocks = known.shares * max(1, -(-(total or 0) // (BLOCK * known.shares)))
    stirling = log_stirling(d)
    base_of = Seated(counted, known, model, d, [])

    def others(batches):
        group, held = None, []

        def listed():
            w = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"g": pa.array([group] * len(w), pa.int32()), "h": w})

        for b in batches:  # the shares of a group follow each other
            for g, record in zip(b.column("g").to_pylist(), b.column("pairs")):
                if held and g != group:
                    yield listed()
                    held = []
                group = g
                held.append(unpacked(record)["w_other"])
        if held:
            yield listed()

    def seated(record: pa.Scalar, h: np.ndarray, found: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        x = unpacked(record)
        first_u, n, w = known.decoded(x)
        c, u = x["k"], np.repeat(first_u, n)
        ku, kw = known.at(u), known.at(w)
        at = np.minimum(np.searchsorted(h[:-1], w[kw < 0]), len(h) - 1)
        rare = np.where(h[at] == w[kw < 0], found[at], 0)
        base = 10 ** base_of.log_base(ku, kw, rare)
        starts, place = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        block = known.dealt(first_u, ku[starts], place, w) % blocks
        order = np.argsort(block, kind="stable")
        tables, all_tables = np.zeros(len(c), np.int64), np.zeros(len(n))
        at, sizes = runs(block[order])
        for i in range(0, len(at), TOGETHER):
            here = order[at[i]:at[i:i + TOGETHER][-1] + sizes[i:i + TOGETHER][-1]]
            inside = at[i:i + TOGETHER] - at[i]
            new = np.append(True, u[here][1:] != u[here][:-1])
            new[inside] = True
            first, ctx = np.flatnonzero(new), np.cumsum(new) - 1
            t, all_t = seat(ctx, c[here], base[here], known.parts[ku[here[first]]], d, stirling, block[here[inside]], (inside, ctx[inside]))
            tables[here] = np.rint(t * (CHAINS * SAMPLES))
            np.add.at(all_tables, place[here[first]], all_t)
        several = known.parts[ku[starts]] > 1
        left = (THETA + d * all_tables) / (THETA + np.add.reduceat(c, starts))
        return packed(tables=tables, left=np.where(several, np.nan, left), rare=rare), first_u[several], all_tables[several]

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        h, found = words["h"].to_numpy(), words["n"].to_numpy()
        order = np.argsort(h)
        h, found = np.append(h[order], 0), np.append(found[order], 0)
        record, dealt, tables = zip(*(seated(r, h, found) for r in pairs["pairs"]))
        give_back()
        return pa.table({"g": pairs["g"], "share": pairs["share"], "seats": pa.array(record, pa.binary()), "dealt": pa.array(dealt, pa.list_(pa.int64())),
                         "tables": pa.array(tables, pa.list_(pa.float64()))})

    words = counted.select("g", "pairs").mapInArrow(others, "g int, h long").join(rare_words(vocab, model), "h")
    seats = written(counted.select("g", "share", "pairs").groupBy("g").cogroup(words.groupBy("g"))
                    .applyInArrow(run, "g int, share int, seats binary, dealt array<long>, tables array<double>"), "pair-seats")
    dealt = seats.select(F.explode(F.arrays_zip("dealt", "tables")).alias("x")).groupBy("x.dealt").agg(F.sum("x.tables")).collect()
    hot = [(u, (THETA + d * t) / (THETA + float(known.n[known.at(np.array([u]))][0]))) for u, t in dealt]
    rows = counted.select("g", "share", "pairs").unionByName(seats.select("g", "share", "seats"), allowMissingColumns=True)
    return Seated(rows, known, model, d, hot)


def pair_scores(docs: DataFrame, vocab: DataFrame, model: Model, seated: Seated) -> DataFrame:
    """``uid, score, base, known``: summed log-probabilities of each text's pairs, and of their words by the base, and how
    many of these are known (of equal rows together)."""
    known = seated.known
    none = np.zeros(0, np.int64)
    word_base, word_known = model.base(known.n), known.n > 0

    def met(pairs: pa.Scalar | None, seats: pa.Scalar | None, cells: list[tuple[pa.Scalar, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
        """Adds the pairs of one share to the texts' sums; text, word and number of the pairs whose words' counts are elsewhere."""
        u, left, w, lp, rare, keys = none, np.zeros(0), none, np.zeros(0), none, none
        if pairs is not None:
            u, n, left, _, w, lp, rare = seated.opened(pairs, seats)
            words, w = np.unique(w, return_inverse=True)
            keys = np.repeat(np.arange(len(n)), n) * len(words) + w
            traveling = np.minimum(np.searchsorted(words, known.h), len(words) - 1)
        rare_base, out = model.base(rare), []
        for record, uid, sums in cells:
            x = unpacked(record)
            cu, n, cw = known.decoded(x)
            k, text = x["k"], x["text"]
            ku, kw = x["u"] - 1, x["w"] - 1
            share = np.ones(len(cu))
            i = np.searchsorted(seated.hot, cu)
            hot = (i < len(seated.hot)) & (np.append(seated.hot, 0)[i] == cu)
            share[hot] = seated.hot_left[i[hot]]
            seen, at = np.zeros(len(cw), bool), np.zeros(len(cw), np.int64)
            if len(keys):
                i = np.minimum(np.searchsorted(u, cu), len(u) - 1)
                same = (u[i] == cu) & ~hot
                share[same] = left[i[same]]
                j = traveling[kw]
                j[kw < 0] = np.minimum(np.searchsorted(words, cw[kw < 0]), len(words) - 1)
                key = np.repeat(i, n) * len(words) + j
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                seen = np.repeat(u[i] == cu, n) & (words[j] == cw) & (keys[at] == key)
            own, unseen = kw < 0, ~seen
            s = np.empty(len(cw))
            s[seen] = lp[at[seen]]
            s[unseen] = seated.log_symbols(np.repeat(ku, n)[unseen], kw[unseen]) + np.log10(np.repeat(share, n)[unseen])
            base, found = word_base[kw], word_known[kw]
            base[own], found[own] = 0.0, False
            both = own & seen
            base[both], found[both] = rare_base[at[both]], True
            sums += [np.bincount(text, k * y, len(uid)) for y in (s, base, found)]
            rows = np.flatnonzero(own & unseen)
            out.append((uid[text[rows]], cw[rows], k[rows]))
        return out

    def run(pairs: pa.Table, cells: pa.Table) -> pa.Table:
        texts = [(x.values, uid, np.zeros((3, len(uid)))) for x, uid in zip(cells["pairs"], (y.values.to_numpy() for y in cells["uid"]))]
        out = [(none, none, none)]
        have: list[dict] = [{}, {}]
        for i, *records in zip(pairs["share"].to_pylist(), pairs["pairs"], pairs["seats"]):
            for known_by, record in zip(have, records):
                if record.is_valid:
                    known_by[i] = record
        for i in range(SPLIT) if texts else ():
            if here := [(x[i], uid, sums) for x, uid, sums in texts if x[i].is_valid]:
                out += met(have[0].get(i), have[1].get(i), here)
                give_back()
        uid, h, k = (np.concatenate(x) for x in zip(*out))
        rows = [{"uid": uid, "h": h, "k": k}]
        if texts:
            sums = added(np.concatenate([x for _, x, _ in texts]), np.concatenate([x for *_, x in texts], axis=1))
            dealt = sums["uid"] % deals
            order = np.argsort(dealt, kind="stable")
            at, n = runs(dealt[order])
            rows.append({"deal": dealt[order][at], "sums": pa.array([packed(**{c: x[order[i:i + m]] for c, x in sums.items()}) for i, m in zip(at, n)], pa.binary())})
        schema = pa.schema([("deal", pa.int64()), ("sums", pa.binary()), ("uid", pa.int64()), ("h", pa.int64()), ("k", pa.int64())])
        return pa.concat_tables([schema.empty_table(), *map(pa.table, rows)], promote_options="default")

    def added(uid: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
        uid, back = np.unique(uid, return_inverse=True)
        score, base, found = (np.bincount(back, x, len(uid)) for x in sums)
        return {"uid": uid, "score": score, "base": base, "known": np.rint(found).astype(np.int64)}

    def total(parts: pa.Table) -> pa.Table:
        found = [unpacked(r, SUMS) for r in parts["sums"]]
        out = added(np.concatenate([x["uid"] for x in found]), np.concatenate([[x[c] for c in SUMS[1:]] for x in found], axis=1))
        give_back()
        return pa.table(out)

    deals = known.groups
    cells = deal(docs, known, True)
    parts = written(seated.rows.groupBy("g").cogroup(cells.groupBy("g"))
                    .applyInArrow(run, "deal long, sums binary, uid long, h long, k long"), "pair-scores")
    n = F.coalesce("n", F.lit(0))
    base = F.log10((n + ADD) / F.lit(model.tokens + ADD * (model.types + 1)))
    unseen = parts.filter("sums is null").select("uid", "h", "k").join(rare_words(vocab, model), "h", "left").select(
        "uid", (F.col("k") * F.log10(word_chance(model, n))).alias("score"), (F.col("k") * base).alias("base"),
        F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("known"))
    whole = parts.filter("sums is not null").groupBy("deal").applyInArrow(total, "uid long, score double, base double, known long")
    return whole.unionByName(unseen).groupBy("uid").agg(*(F.sum(c).alias(c) for c in SUMS[1:]))


def word_chance(model: Model, n: Column) -> Column:
    """Probability of a word of the shared symbol with count ``n``."""
    most = max([0, *model.mean_tables])
    means = F.array(*(F.lit(float(model.mean_tables.get(i, 1.0 if i else 0.0))) for i in range(most + 1)))
    tables = F.coalesce(F.get(means, _bin(n)), F.lit(1.0))
    return F.greatest(n - model.discount * tables, F.lit(0.0)) / (THETA + model.customers) + model.open


def fit(docs: DataFrame, vocab: DataFrame) -> Model:
    """Model of the training texts ``docs`` whose words are counted in ``vocab``."""
    spark = docs.sparkSession
    tokens, types = vocab.agg(F.sum("n"), F.count("*")).first()
    tokens, types = tokens or 0, types or 0
    sent = [(bytes(w), n) for w, n in vocab.filter((F.col("n") * SENT >= tokens) | (F.col("word") == F.lit(END))).collect()]
    model = Model(sorted(sent, key=lambda x: (-x[1], x[0])), tokens, types)
    counts = symbol_counts(docs, model.symbol)
    lone = vocab.filter((F.col("n") * SYMBOLS < tokens) & (F.col("word") != F.lit(END)))
    rows = lone.groupBy(_bin(F.col("n")).alias("b")).agg(F.sum("n"), F.count("*")).orderBy("b").collect()
    model.coc_sums = [(s, b, n) for b, s, n in rows]
    coc = [(b, max(1, round(s / n)), n) for b, s, n in rows]
    packed = counts.astype(np.int64).tobytes()
    size = len(counts)

    def run(batches):
        for b in batches:
            for seed in b.column(0).to_pylist():
                p, m, t = run_chain(np.frombuffer(packed, np.int64).reshape(size, size).copy(), coc, 1000 + seed)
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]), pa.array([m.tobytes()]), pa.array([float(t)])], names=["p", "m", "t"])

    got = spark.range(CHAINS).repartitionByRange(CHAINS, "id").mapInArrow(run, "p binary, m binary, t double").collect()
    got.sort(key=lambda r: r["t"])
    model.finish([(np.frombuffer(r["p"]).reshape(size, size), np.frombuffer(r["m"]), r["t"]) for r in got], coc)
    return model


def signed_hash(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def text_id(doc, text: str) -> int:
    return signed_hash(f"{doc}:".encode() + text.encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, vocab: DataFrame, model: Model, seated: Seated) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` per row of ``docs`` (``doc_id, text``)."""
    def run(batches):
        for b in batches:
            doc, text = b.column("doc_id"), b.column("text")
            uid = [text_id(i, t) for i, t in zip(doc.to_pylist(), texts_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), doc, pa.array(tokens_of(text)[1] + 1)], names=["uid", "doc_id", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {id_type}, n_tokens long")
    # equal rows share a hash: their sums are divided and the rows given back
    texts = rows.groupBy("uid").agg(F.count("*").alias("copies"), F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    per = (texts.join(pair_scores(docs, vocab, model, seated), "uid")
           .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
    return per.select("doc_id", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
                      (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def score_texts(docs: DataFrame, training: DataFrame) -> tuple[DataFrame, Model]:
    """Scores of all ``docs`` under a model of the texts ``training``."""
    vocab = written(count_words(training), "word-counts")
    model = fit(training, vocab)
    return score(docs, vocab, model, seat_pairs(training, vocab, model)), model


def perplexity(scores: DataFrame) -> float | None:
    """Per token, of scored rows."""
    s, n = scores.agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-s / n) if n else None
