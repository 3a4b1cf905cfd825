"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of two neighbouring cells of ``CELL`` words (words: A-Z lower-cased,
ASCII punctuation taken as white space). Terms are the benchmark's words, weighted by the
inverse of how many cells of the whole corpus hold them; no weight is 0, as an item that leaks into
many documents makes its own words frequent. A randomised SVD of the TF-IDF rows of
the benchmark's own passages (each ``OWN_WEIGHT`` times) and of all passages of the corpus gives a latent space of
``RANK`` dimensions. Tasks add up their share of the terms-by-terms table ``A'A`` once, in parts of at most
``TABLE`` numbers; every power iteration is a Spark job over these shares that gives a table as long as the
benchmark's vocabulary. Texts are cut into words once per block of items and read as word ids from then on.

Then every passage of every document is compared with every benchmark passage by the cosine of
their latent vectors; ``COSINE`` or more makes a candidate. So does, whatever the weights, a run of ``GRAM``
words of an item in the document (hashed; items with fewer words are only found by their cosine).

Candidates are checked on the text: the longest common subsequence of words between item and
the document around the passage, as a share of the item's words. A document is contaminated by an
item if the share is ``SHARE`` or more; or for a paraphrase, if it is ``LOOSE`` or more and the item's
answer (its last sentence of three words or more) stands there word by word.

Benchmarks are searched in blocks of about ``BLOCK`` items, each of which travels to all tasks. Items
without words match nothing; an empty benchmark or empty documents give no rows. Null text counts
as empty. Repeated documents are each reported; repeated items are reported under each id.
"""
from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import UPPER, LOWER, lean, takes_over, texts_of, written

CELL, RANK, EXTRA, POWER, BINS = 16, 288, 16, 2, 12
SAMPLE_DOCS, BLOCK, OWN_WEIGHT = 600, 512, 12
#: Numbers of ``A'A`` that a task holds, and that a row of its share holds.
TABLE, PIECE = 1 << 23, 1 << 17
MASS, COSINE, SHARE, LOOSE, ANSWER_WORDS, GRAM = 0.45, 0.45, 0.6, 0.45, 3, 4

_PLAIN = bytes.maketrans(UPPER.encode() + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", LOWER.encode() + b" " * 32)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Items:
    """A block of the benchmark: vocabulary, word ids, answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, t or "") for i, t in rows if words(t or "")]
        self.ids = [i for i, _ in rows]
        self.vocab: dict[bytes, int] = {}
        self.words = [[self.vocab.setdefault(w, len(self.vocab)) for w in words(t)] for _, t in rows]
        self.answers = []
        for _, t in rows:
            parts = [p for p in (words(s) for s in re.split(r"[.!?\n]+", t)) if len(p) >= ANSWER_WORDS]
            self.answers.append([self.vocab[w] for w in parts[-1]] if len(parts) > 1 else [])

    def passages(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Windows of two cells over the items, half a cell apart, and the item of each."""
        out, own = [], []
        for k, w in enumerate(self.words):
            for lo in range(0, max(1, len(w) - CELL), CELL // 2):
                out.append(np.array(w[lo:lo + 2 * CELL]))
                own.append(k)
        return out, np.array(own, np.int64)


def word_ids(texts: list[str], vocab: dict[bytes, int]) -> list[np.ndarray]:
    """Word ids of texts (-1: not a benchmark word)."""
    rows = [words(t) for t in texts]
    return [np.fromiter(map(vocab.get, w, repeat(-1)), np.int32, len(w)) for w in rows]


class Cells:
    """A batch of texts as word ids, in cells that end with their text."""

    def __init__(self, texts: list[str], vocab: dict[bytes, int]):
        self._lay(word_ids(texts, vocab))

    @classmethod
    def of(cls, ids: pa.Array) -> "Cells":
        """From a column that ``encoded`` wrote."""
        out = cls.__new__(cls)
        out._lay([np.frombuffer(x, np.int32) for x in ids.to_pylist()])
        return out

    def _lay(self, rows: list[np.ndarray]) -> None:
        self.ids = rows
        counts = np.array([-(-len(w) // CELL) for w in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.n = int(self.first[-1])
        self.text = np.repeat(np.arange(len(rows)), counts)
        table = np.full((self.n + 1, CELL), -1, np.int32)  # one empty cell stands after the last
        for a, i in zip(self.first, self.ids):
            table[a:a + -(-len(i) // CELL)].ravel()[:len(i)] = i
        self.table = table

    def passages(self) -> np.ndarray:
        """Passages as rows of 2 x CELL ids; the last cell of a text stands alone only if the text
        has no other (its words are in the passage before)."""
        nxt = np.arange(1, self.n + 1)
        last = np.concatenate([self.text[1:] != self.text[:-1], [True]]) if self.n else np.zeros(0, bool)
        nxt = np.where(last, self.n, nxt)
        self.keep = np.flatnonzero(~last | (self.first[self.text + 1] - self.first[self.text] == 1)) if self.n else np.zeros(0, np.int64)
        return np.concatenate([self.table[self.keep], self.table[nxt[self.keep]]], axis=1)


def encoded(docs: DataFrame, vocab: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids``: word ids of every text as 32-bit integers, written to the shared folder."""
    def run(batches):
        takes_over("leaks")
        for b in batches:
            ids = [x.tobytes() for x in word_ids(texts_of(b.column("text")), vocab)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(id_col, "text").mapInArrow(lean(run), f"{id_col} {kind}, ids binary"), "leak-word-ids")


def cell_counts(texts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many cells of the corpus (``ids``) each of ``size`` terms occurs, and the number of cells."""
    def count(batches):
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            c = Cells.of(b.column(0))
            own, at = c.table[:c.n], np.arange(c.n)[:, None]
            found = np.unique((at * size + own)[own >= 0])
            df += np.bincount(found % size, minlength=size)
            n += c.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(df, n))], names=["term", "n"])

    got = np.zeros(size + 1, np.int64)
    for t, n in texts.select("ids").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        got[t] = n
    return got[:size], int(got[size])


def row_starts(size: int) -> np.ndarray:
    """Where column 0 of each row would stand if rows of the upper triangle follow each other (row ``i`` begins
    with column ``i``)."""
    i = np.arange(size, dtype=np.int64)
    return i * size - i * (i + 1) // 2


def add_pairs(total: np.ndarray, begin: int, passages: np.ndarray, weight: np.ndarray) -> None:
    """Adds to ``total``, numbers ``begin`` and on of the upper triangle of ``A'A`` (without the weights of its two
    terms; the diagonal halved), what ``passages`` give. Unlisted words are the last term, of weight 0."""
    rest = len(weight) - 1
    start = row_starts(rest + 1)
    whole = len(total) == (rest + 1) * (rest + 2) // 2
    p = np.sort(np.where(passages < 0, rest, passages), axis=1)  # unlisted words come last
    new = np.ones(p.shape, bool)
    new[:, 1:] = p[:, 1:] != p[:, :-1]
    runs = np.diff(np.append(np.flatnonzero(new.ravel()), p.size))
    times = np.repeat(runs, runs).reshape(p.shape)
    square = (times * weight[p].astype(float) ** 2).sum(axis=1)
    count = (p < rest).sum(axis=1)
    order = np.argsort(-count, kind="stable")
    p, count, share = np.ascontiguousarray(p[order].T, np.int64), count[order], 1 / np.maximum(1e-18, square[order])
    row = start[p] - begin
    for j in range(int(count[0]) if len(count) else 0):
        n = int(np.searchsorted(-count, -j, side="left"))  # passages with more than j listed words
        for k in range(j + 1):
            at, v = row[k, :n] + p[j, :n], share[:n] / 2 if k == j else share[:n]
            if not whole:
                inside = (at >= 0) & (at < len(total))
                at, v = at[inside], v[inside]
            np.add.at(total, at, v)


def pair_sums(texts: DataFrame, weight: np.ndarray) -> DataFrame:
    """``at, share``: for every task its share of ``A'A`` of all passages of ``texts`` (``ids``), in pieces that begin
    with number ``at`` of the upper triangle. As many tasks as cores, each with one table of ``TABLE`` numbers."""
    weight = np.append(weight, 0)
    numbers = len(weight) * (len(weight) + 1) // 2
    few = texts.select("ids").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    out = None
    for begin in range(0, numbers, TABLE):
        def run(batches, begin=begin):
            total = np.zeros(min(TABLE, numbers - begin))
            for b in batches:
                add_pairs(total, begin, Cells.of(b.column(0)).passages(), weight)
            for lo in range(0, len(total), PIECE):
                part = total[lo:lo + PIECE]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([begin + lo]), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["at", "share"])

        got = written(few.mapInArrow(lean(run), "at long, share binary"), "leak-pair-sums")
        out = got if out is None else out.unionByName(got)
    return out


def randomised_svd(sums: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF rows whose ``A'A`` has the shares
    ``sums`` (``pair_sums``). A task sends a table of vocabulary x (rank + EXTRA) numbers."""
    size = len(weight)
    width = min(size, rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    few = sums.coalesce(sums.sparkSession.sparkContext.defaultParallelism)

    def gram(q: np.ndarray) -> np.ndarray:
        q = np.append(weight[:, None] * q, np.zeros((1, width)), axis=0).astype(np.float32)  # the last term: unlisted words

        def part(batches):
            start = row_starts(size + 1)
            total = np.zeros((size + 1, width))
            for b in batches:
                for at, share in zip(b.column("at").to_pylist(), b.column("share").to_pylist()):
                    x = np.frombuffer(share, np.float32)
                    ends = start + size + 1
                    lo, hi = np.searchsorted(ends, [at, at + len(x) - 1], "right")
                    rows = np.zeros((hi - lo + 1, size + 1 - lo), np.float32)
                    for r in range(lo, hi + 1):
                        a, z = max(at, start[r] + r), min(at + len(x), ends[r])
                        rows[r - lo, a - start[r] - lo:z - start[r] - lo] = x[a - at:z - at]
                    total[lo:hi + 1] += rows @ q[lo:]
                    total[lo:] += rows.T @ q[lo:hi + 1]
            yield pa.RecordBatch.from_arrays([pa.array([total[:size].astype(np.float32).tobytes()], pa.binary())], names=["share"])

        out = np.zeros((size, width))
        for r in few.mapInArrow(lean(part), "share binary").toLocalIterator():  # one task's table at a time
            out += np.frombuffer(r[0], np.float32).reshape(size, width)
        return weight[:, None] * out

    for _ in range(POWER):
        basis = np.linalg.qr(gram(basis))[0]
    small = basis.T @ gram(basis)  # A'A seen in the basis
    value, vector = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-value)[:min(rank, width)]
    return (basis @ vector[:, top]).astype(np.float32)


def places_of(a: list[int]) -> dict[int, int]:
    """Where each word stands in ``a``, as bit rows."""
    out: dict[int, int] = {}
    for i, w in enumerate(a):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(places: dict[int, int], n: int, b: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence of a sequence of ``n`` words (as bit rows) and
    ``b``; 0 if fewer than ``least`` words of ``b`` occur in the first."""
    hits = [places[w] for w in b if w in places]
    if len(hits) < least:
        return 0
    row = full = (1 << n) - 1
    for at in hits:
        hit = row & at
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def stands_in(a: list[int], b: np.ndarray) -> bool:
    """Does the word sequence ``a`` stand in ``b``?"""
    n = len(b) - len(a) + 1
    if not a or n < 1:
        return False
    at = np.flatnonzero(b[:n] == a[0])
    return any(b[i:i + len(a)].tolist() == a for i in at)


def grams_of(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` word ids."""
    n = max(0, len(ids) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64) + np.uint64(1)
    return h


class Index:
    """What a task needs to search: items, term weights, term vectors, benchmark vectors."""

    def __init__(self, items: Items, weight: np.ndarray, latent: np.ndarray):
        self.items = items
        self.places = [places_of(w) for w in items.words]
        self.terms = np.concatenate([latent * weight[:, None], np.zeros((1, latent.shape[1]), np.float32)]).astype(np.float32)
        self.mass = np.append(weight, 0).astype(np.float32)  # id -1: the last, 0
        own, item = items.passages()
        least = np.array([float(self.mass[np.unique(p)].sum()) for p in own]) * MASS
        order = np.argsort(least, kind="stable")
        q = np.stack([self.terms[own[i]].sum(axis=0) for i in order])
        q /= np.maximum(1e-9, np.linalg.norm(q, axis=1, keepdims=True))
        #: per bin: weight that a passage needs, latent vectors, their items
        self.bins = [(max(1e-6, float(least[part[0]])), np.ascontiguousarray(q[cols].T, np.float32), item[part])
                     for part, cols in zip(np.array_split(order, BINS), np.array_split(np.arange(len(order)), BINS)) if len(part)]
        self.queries, self.item = q, item[order]
        runs = [grams_of(np.array(w, np.int64)) for w in items.words]
        self.gram = np.concatenate(runs)
        by = np.argsort(self.gram, kind="stable")
        self.gram, self.gram_item = self.gram[by], np.repeat(np.arange(len(runs)), [len(g) for g in runs])[by]

    def sums(self, ids: np.ndarray) -> np.ndarray:
        """Sum of term vectors per row of ids, one column of weighted ids at a time."""
        light = self.mass[ids] == 0
        ids = np.take_along_axis(ids, np.argsort(light, axis=1, kind="stable"), axis=1)
        count = (~light).sum(axis=1)
        order = np.argsort(-count, kind="stable")
        ids, count = ids[order], count[order]
        x = np.zeros((len(ids), self.terms.shape[1]), np.float32)
        for j in range(int(count[0]) if len(count) else 0):
            n = int(np.searchsorted(-count, -j, side="left"))  # rows with more than j ids
            x[:n] += self.terms[ids[:n, j]]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return x[back]

    def candidates(self, cells: Cells, cosine: float = COSINE) -> dict[tuple[int, int], tuple[float, list[int]]]:
        """(text, item) -> best cosine and the cells where the pair's passages begin."""
        p = cells.passages()
        out: dict = {}
        floor = self.bins[0][0]
        for lo in range(0, len(p), 4096):
            good = np.flatnonzero(self.mass[p[lo:lo + 4096]].sum(axis=1) >= floor)
            part = np.sort(p[lo + good], axis=1)
            new = np.concatenate([np.ones((len(part), 1), bool), part[:, 1:] != part[:, :-1]], axis=1)
            mass = (self.mass[part] * new).sum(axis=1)
            good, part, mass = good[mass >= floor], part[mass >= floor], mass[mass >= floor]
            if not len(good):
                continue
            x = self.sums(part)
            x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
            for need, queries, items in self.bins:
                rows = np.flatnonzero(mass >= need)
                if not len(rows):
                    break
                cos = x[rows] @ queries
                for r, q in zip(*np.nonzero(cos >= cosine)):
                    cell = int(cells.keep[lo + good[rows[r]]])
                    key = (int(cells.text[cell]), int(items[q]))
                    best, at = out.get(key, (0.0, []))
                    out[key] = (max(best, float(cos[r, q])), at if cell in at[-8:] else at + [cell])
        for t, k, cell in self.runs(cells):
            best, at = out.get((t, k), (0.0, []))
            out[t, k] = (best, at if cell in at else at + [cell])
        return out

    def runs(self, cells: Cells) -> list[tuple[int, int, int]]:
        """(text, item, cell) of every run of ``GRAM`` words that a text and an item share."""
        out: set = set()
        for t, ids in enumerate(cells.ids):
            known = ids >= 0
            n = len(ids) - GRAM + 1
            if n < 1:
                continue
            whole = known[:n].copy()
            for k in range(1, GRAM):
                whole &= known[k:k + n]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            g = grams_of(ids)[at]
            lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
            for i in np.flatnonzero(hi > lo):
                cell = int(cells.first[t]) + int(at[i]) // CELL
                out.update((t, int(k), cell) for k in self.gram_item[lo[i]:hi[i]])
        return sorted(out)

    def cosine(self, ids: np.ndarray, item: int, starts: list[int]) -> float:
        """Best cosine of the item with the passages of a text that hold the cells at ``starts``."""
        begin = sorted({b for s in starts for b in (s - CELL, s) if b >= 0})
        p = np.full((len(begin), 2 * CELL), -1, np.int64)
        for row, b in zip(p, begin):
            row[:len(ids[b:b + 2 * CELL])] = np.sort(ids[b:b + 2 * CELL])
        x = self.sums(p)
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        return float((x @ self.queries[self.item == item].T).max())

    def check(self, ids: np.ndarray, item: int, starts: list[int]) -> tuple[float, bool]:
        """Best share of the item's words found in order around the passages, and the answer."""
        w = self.items.words[item]
        best, answer, done = 0.0, False, -1
        for s in sorted(starts):
            lo, hi = max(0, s - len(w)), s + 2 * CELL + len(w)
            if hi <= done:
                continue
            done = hi
            near = ids[lo:hi]
            share = lcs(self.places[item], len(w), near.tolist(), int(LOOSE * len(w))) / len(w)
            best = max(best, share)
            answer = answer or (share >= LOOSE and stands_in(self.items.answers[item], near))
        return best, answer


RESULT = "doc_id long, item_id long, cosine double, share double, answer boolean"


def search(texts: DataFrame, index: Index, id_col: str = "doc_id") -> DataFrame:
    """Contaminated pairs ``doc_id, item_id, cosine, share, answer`` of encoded texts."""
    def run(batches):
        for b in batches:
            cells = Cells.of(b.column("ids"))
            found = []
            for (t, k), (cos, at) in index.candidates(cells).items():
                share, answer = index.check(cells.ids[t], k, [(c - int(cells.first[t])) * CELL for c in at])
                if share >= SHARE or (share >= LOOSE and answer):
                    if not cos:  # found by a run of words only
                        cos = index.cosine(cells.ids[t], k, [(c - int(cells.first[t])) * CELL for c in at])
                    found.append((t, index.items.ids[k], round(cos, 4), round(share, 4), answer))
            rows = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()),
                 pa.array(rows[3], pa.float64()), pa.array(rows[4], pa.bool_())], names=["doc_id", "item_id", "cosine", "share", "answer"])

    return texts.select(id_col, "ids").mapInArrow(lean(run), RESULT)


def sample_passages(docs: DataFrame, vocab: dict[bytes, int], sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """For trials on part of a corpus (``find_leaks`` takes all of it): passages (``ids``) of the documents that a hash of the id picks, ``sample_docs`` to twice as many (all, if
    fewer). Of more than 20 a document, a hash of id, text and cell number keeps about 20 * ``sample_docs``,
    so that neither the order of tasks nor a few long documents decide."""
    def sample(batches):
        for b in batches:
            c = Cells(texts_of(b.column("text")), vocab)
            p = c.passages()
            at = pa.array(c.text[c.keep])
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), pa.array(c.keep - c.first[c.text[c.keep]]),
                                              pa.array(p.tolist(), pa.list_(pa.int32()))], names=["key", "cell", "ids"])

    part = F.pmod(F.xxhash64("doc_id", F.lit("svd")), F.lit(max(1, docs.count() // sample_docs)).cast("long")) == 0
    found = written(docs.filter(part).select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(sample, "key long, cell long, ids array<int>"),
                    "svd-passages")
    n, most = found.count(), 20 * sample_docs
    if n > most:
        found = found.filter(F.pmod(F.xxhash64("key", "cell"), F.lit(1 << 30).cast("long")) < most * (1 << 30) // n)
    return found.select("ids")


def own_passages(spark: SparkSession, items: Items) -> DataFrame:
    """``ids`` of the items' passages, ``OWN_WEIGHT`` times. An Arrow table: rows from a Python list would
    start a second set of Python workers on every executor, which stay."""
    rows = [p.astype(np.int32).tobytes() for p in items.passages()[0]] * OWN_WEIGHT
    return spark.createDataFrame(pa.table({"ids": pa.array(rows, pa.binary())}))


def build(texts: DataFrame, items: Items) -> Index:
    """Index of one block of items: corpus statistics and SVD over all encoded texts."""
    count, cells = cell_counts(texts, len(items.vocab))
    weight = np.log((1 + cells) / (1 + np.minimum(count, cells))).astype(np.float32) + 0.05
    own = own_passages(texts.sparkSession, items)
    return Index(items, weight, randomised_svd(pair_sums(texts.select("ids").unionByName(own), weight), weight))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """All contaminated pairs of ``docs`` (``doc_id, text``) and ``benchmark`` (``item_id, text``). Items without an id
    are left out: a pair could not name them."""
    bench = benchmark.select("item_id", "text").filter("item_id is not null")
    blocks = max(1, -(-bench.count() // block))
    out = None
    for k in range(blocks):
        own = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        items = Items(sorted((r[0], r[1] or "") for r in own.collect()))
        if items.ids:
            texts = encoded(docs, items.vocab)
            found = search(texts, build(texts, items))
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out
