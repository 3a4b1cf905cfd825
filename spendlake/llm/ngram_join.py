"""N-gram Jaccard join by a blocked sparse matrix product.

A document is the set of its distinct shingles of ``width`` words (words: runs outside
``[\\x20\\x09-\\x0D]``, A-Z lower-cased), as 64-bit hashes; with fewer words the whole sequence is
one shingle, without words the set is empty and links with nothing. Two documents link when
``100 * intersection >= percent * union``. The join is exact on these sets:

1. Documents with equal sets form a class, represented by its smallest id.
2. Rows and columns that can meet are found first. In the order of the hashes, two sets that
   link share at least ``l`` of the first ``n - ceil(percent * n / 100) + l`` shingles of each, ``l``
   being a tenth of the smaller set. A set in whose beginning fewer shingles occur in other
   sets of like size than that has no links; this drops documents that only share passages. It is
   asked again among the rest, then sets with a common first shingle and like size are
   joined to the smallest of them (a star, never all pairs). The connected groups of these stars are
   the diagonal blocks of the incidence matrix outside of which no two sets can link.
3. A group of more than ``BLOCK`` shingles or ``BLOCK_SETS`` sets is cut into bands of set sizes, so wide that linked sets
   lie in the same or in neighbouring bands, and bands into blocks of about ``BLOCK`` shingles. For every pair of
   blocks of a group in the same or neighbouring bands one product of the documents-by-shingles matrix
   with the other's transpose accumulates the overlaps, and pairs below the bound that their sizes
   give are discarded. Blocks of one group are dealt over tasks.
4. A product returns one row per document: the smallest document it is connected with inside
   the product and its number of links. Connected components of these rows are the classes
   of the join.

No pair is sampled or capped: a very large group only makes more products.

Null text counts as empty. Rows with a null id are left out (``join_all`` returns them without component and links); repeated rows give repeated results,
and rows of one id are one document: if their texts differ, they have one component; links are counted by text.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import give_back, lean, takes_over, texts_of, words_of, written
from spendlake.llm.components import components

WIDTH, PERCENT = 4, 85
#: Shingles and sets of a block.
BLOCK, BLOCK_SETS = 2_000_000, 2048
#: Shingles of a product after which the worker gives its memory back.
LARGE = 500_000


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Hashes()


def _forget_words() -> None:
    _WORDS.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, len(h) if len(h) < width else width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(total)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs; independent of order."""
    with np.errstate(over="ignore"):
        a = _mix(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - (percent * n + 99) // 100 + max(1, n // 10))


def documents_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, s1, s2, first`` of every document: size and signature of its set, and its first
    shingles (smallest hashes). Written once; later steps read the columns that they need."""
    def run(batches):
        takes_over("shingles", _forget_words)
        for b in batches:
            sets = [shingles(t, width) for t in texts_of(b.column("text"))]
            sig = [signature(s) for s in sets]
            first = [s[:prefix_length(len(s), percent)].astype(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in sig], pa.int64()),
                 pa.array([y for _, y in sig], pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "first"])

    return written(docs.mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, first array<long>"), "shingle-sets")


def _shared(entries: DataFrame, key: list[str]) -> DataFrame:
    """The entries whose shingle occurs in two sets or more, with the smallest set of the list."""
    lists = entries.groupBy(*key).agg(F.min("s").alias("least"), F.max("s").alias("most")).filter("least <> most").select(*key, "least")
    return entries.join(lists, key)


def stars_of(every: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: sets (by their first hash) joined to the smallest set that they share a first
    shingle and like size with."""
    sizes = classes.select(F.col("s1").alias("s"), "n").distinct()
    entries = every.select(F.explode("first").alias("h"), F.col("s1").alias("s"))
    found = written(_shared(entries, ["h"]).select("h", "s").distinct(), "first-shingles")
    need = F.greatest(F.lit(1), F.floor(F.floor((F.lit(percent) * F.col("n") + 99) / 100) / 10))
    for _ in range(2):
        enough = (found.groupBy("s").agg(F.countDistinct("h").alias("k")).join(sizes, "s").filter(F.col("k") >= need)
                  .select("s", size_band(percent).alias("band")).distinct())
        # a set of band b meets others in the lists of (b - 1, b) and (b, b + 1)
        near = written(found.select("h", "s").distinct().join(enough, "s")
                       .select("h", "s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")), "near-sizes")
        found = written(_shared(near, ["h", "band"]), "first-shingles")
    return found.filter("s <> least").select(F.col("s").alias("a"), F.col("least").alias("b")).distinct()


def size_band(percent: int) -> Column:
    """Bands of set sizes ``n``: linked sets are at most one band apart (the margin is for rounding)."""
    if percent >= 100:
        return F.col("n").cast("int")
    return F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))).cast("int")


def product(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse product of the incidence matrices of two blocks (``None``: of one with itself), a row
    at a time: for every row the columns that reach the bound; pairs within a block once.

    A shingle that more than half of the documents have is stored by the documents that lack it,
    so near copies are compared by the few shingles in which they differ:
    ``|A & B| = |A' & B'| + |A & M| + |B & M| - |M|`` for the majority's shingles ``M`` and ``A' = A ^ M``."""
    every = left if right is None else left + right
    if not left or not every[len(left) if right is not None else 0:]:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(left)
    sizes = np.array([len(x) for x in every], np.int64)
    owner = np.repeat(np.arange(len(every)), sizes)
    keys, column = np.unique(np.concatenate(every), return_inverse=True)
    common = 2 * np.bincount(column, minlength=len(keys)) > len(every)
    many = np.flatnonzero(common)
    seen = common[column]
    lacks = np.ones((len(every), len(many)), bool)  # at most twice as large as the sets together
    lacks[owner[seen], np.searchsorted(many, column[seen])] = False
    has = len(many) - lacks.sum(axis=1)
    who, what = np.nonzero(lacks)
    owner, column = np.concatenate([owner[~seen], who]), np.concatenate([column[~seen], many[what]])

    by_row = np.argsort(owner, kind="stable")
    row_start = np.searchsorted(owner[by_row], np.arange(len(every) + 1))
    first = 0 if right is None else len(left)
    by_column = np.flatnonzero(owner >= first)
    by_column = by_column[np.argsort(column[by_column], kind="stable")]
    start = np.searchsorted(column[by_column], np.arange(len(keys) + 1))
    docs, width = owner[by_column] - first, len(every) - first
    out = []
    for i in range(len(left)):
        row = column[by_row[row_start[i]:row_start[i + 1]]]
        lens = start[row + 1] - start[row]
        where = np.repeat(start[row] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        overlap = np.bincount(docs[where], minlength=width) + has[i] + has[first:] - len(many)
        ok = (100 * overlap >= percent * (sizes[i] + sizes[first:] - overlap)) & (overlap > 0)
        if right is None:
            ok[:i + 1] = False
        hits = np.flatnonzero(ok)
        out.append((hits, overlap[hits]))
    return out


def _links(percent: int):
    """Pandas function of one pair of blocks: ``doc, root, links`` per document with links."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc", kind="stable")  # the first of a group is its smallest
        docs, copies = frame["doc"].to_numpy(), frame["copies"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in frame["shingles"]]
        side = frame["side"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = bool(frame["same"].iloc[0])
        label, links = np.arange(len(docs)), np.zeros(len(docs), np.int64)
        cols = a if own else b
        for i, (hits, _) in zip(a, product([sets[k] for k in a], None if own else [sets[k] for k in b], percent)):
            if len(hits):
                found = cols[hits]
                links[i] += copies[found].sum()
                links[found] += copies[i]
                met = np.unique(label[np.append(found, i)])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        if sum(map(len, sets)) > LARGE:
            give_back()
        keep = np.flatnonzero(links > 0)
        return pd.DataFrame({"doc": docs[keep], "root": docs[label[keep]], "links": links[keep]})

    return run


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per document (``doc_id, text``): ``doc_id, n_shingles, component_id`` (smallest id reachable by
    links, itself included), ``n_links`` (documents it links with)."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    every = documents_of(docs, width, percent)
    classes = written(every.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")),
                      "set-classes")
    groups = components(stars_of(every, classes, percent))
    members = written(classes.join(groups, F.col("s1") == F.col("node")).select("rep", "s1", "s2", "n", "copies", F.col("label").alias("g")), "group-members")

    banded = members.withColumn("band", size_band(percent))
    sizes = banded.groupBy("g", "band").agg(F.sum("n").alias("held"), F.count("*").alias("sets"))
    sizes = sizes.withColumn("parts", F.ceil(F.greatest(F.col("held") / block, F.col("sets") / BLOCK_SETS)).cast("int"))
    whole = sizes.groupBy("g").agg(((F.sum("held") <= block) & (F.sum("sets") <= BLOCK_SETS)).alias("whole"))
    near = (sizes.join(sizes.select("g", (F.col("band") + 1).alias("band"), F.col("parts").alias("below")), ["g", "band"], "left")
            .join(sizes.select("g", (F.col("band") - 1).alias("band"), F.col("parts").alias("above")), ["g", "band"], "left").join(whole, "g"))
    near = written(near.fillna(0, ["below", "above"]).drop("held", "sets"), "bands")
    # a group that fits into one block is one block, without bands
    one = lambda c, n: F.when(F.col("whole"), F.lit(n)).otherwise(F.col(c)).alias(c)
    placed = (banded.join(near, ["g", "band"]).select(*members.columns, one("band", 0), one("parts", 1), one("below", 0), one("above", 0))
              .withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    band, p = F.col("band"), F.col("p")
    none = F.array().cast("array<struct<low:int,same:boolean,i:int,j:int,side:int>>")

    def pairs(n, one):
        return F.when(n > 0, F.transform(upto(n), one)).otherwise(none)

    def cell(low, same, i, j, side):
        return F.struct(low.alias("low"), same.alias("same"), i.alias("i"), j.alias("j"), side.alias("side"))

    yes, no, left, right = F.lit(True), F.lit(False), F.lit(0), F.lit(1)
    within = pairs(F.col("parts"), lambda q: cell(band, yes, F.least(p, q), F.greatest(p, q), F.when(p <= q, left).otherwise(right)))
    above = pairs(F.col("above"), lambda q: cell(band, no, p, q, left))
    below = pairs(F.col("below"), lambda q: cell(band - 1, no, q, p, right))
    keys = ["rep", "s1", "s2"]
    dealt = placed.select(*keys, "g", "copies", F.explode(F.concat(within, above, below)).alias("c")).select(*keys, "g", "copies", "c.*")

    def sets(batches):
        takes_over("shingles", _forget_words)
        for b in batches:
            found = [shingles(t, width) for t in texts_of(b.column("text"))]
            sig = [signature(s) for s in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in sig], pa.int64()) for k in (0, 1)),
                                              pa.array([s.tobytes() for s in found], pa.binary())], names=[*keys, "shingles"])

    # the members grow with the documents: they are never broadcast, and the long side is not sorted
    needed = docs.join(members.select("rep").hint("shuffle_hash"), F.col("doc_id") == F.col("rep"), "left_semi")
    content = written(needed.mapInArrow(lean(sets), "rep long, s1 long, s2 long, shingles binary"), "group-sets").dropDuplicates(keys)
    blocks = dealt.join(content, keys).select(F.col("rep").alias("doc"), "g", "copies", "low", "i", "j", "side",
                                               (F.col("same") & (F.col("i") == F.col("j"))).alias("same"), F.col("same").alias("own_band"), "shingles")
    found = written(blocks.groupBy("g", "low", "own_band", "i", "j").applyInPandas(_links(percent), "doc long, root long, links long"), "links")
    # an id with several sets connects their classes
    several = every.groupBy("doc_id").agg(*(f(c).alias(k + c) for c in ("s1", "s2") for k, f in (("x", F.min), ("y", F.max)))).filter("xs1 <> ys1 or xs2 <> ys2")
    same = every.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
    tree = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    result = classes.join(tree, F.col("rep") == F.col("node"), "left").select("s1", "s2", "copies", "rep", F.coalesce("label", "rep").alias("component_id"))
    result = written(result.join(links, F.col("rep") == F.col("doc"), "left")
                     .select("s1", "s2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-classes")
    of_words = every.filter("n > 0").join(result, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("n_links").cast("long").alias("n_links"))
    empty = every.filter("n = 0").join(tree, F.col("doc_id") == F.col("node"), "left")
    return of_words.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def join_all(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``join`` with a row for every row of ``docs``: without an id ``component_id`` and ``n_links`` are null."""
    def sizes(batches):
        for b in batches:
            n = [len(shingles(t, width)) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_shingles"])

    linked = join(docs, width, percent)
    types = {f.name: f.dataType for f in linked.schema}
    rows = docs.select("doc_id", "text").filter("doc_id is null").mapInArrow(sizes, f"doc_id {types['doc_id'].simpleString()}, n_shingles long")
    nothing = [F.lit(None).cast(types[c]).alias(c) for c in ("component_id", "n_links")]
    return linked.unionByName(rows.select("doc_id", F.col("n_shingles").cast(types["n_shingles"]).alias("n_shingles"), *nothing))
