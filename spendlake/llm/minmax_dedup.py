"""Near-duplicate removal by min-max hashing.

A document is the set of its distinct shingles of ``width`` words (words: runs outside
``[\\x20\\x09-\\x0D]``, A-Z lower-cased), as 64-bit hashes; with fewer words the whole sequence is one
shingle, without words the set is empty and linked with nothing. Documents link when
``100 * intersection >= percent * union``; a group is what links connect.

1. **Signatures.** Every permutation of the hashes is evaluated once per shingle and gives two values of
   the signature, its minimum and its maximum. Both agree between two sets with the
   probability of their Jaccard similarity, so the signature stays unbiased at half the evaluations,
   and its variance is lower than that of as many minima. A band is ``BAND`` permutations, that is ``2 * BAND`` values;
   two sets of similarity ``J`` share none of the ``BANDS`` bands with probability ``(1 - J^(2 BAND))^BANDS``, 3e-7 at 0.85.
2. **Candidates.** Documents with equal sets are one class. Classes that share a band and are of like size meet in
   a bucket. No pairs within a bucket are made: every class meets the bucket's smallest.
3. **Confirmation on full sets.** These stars are confirmed by exact intersections, hot centres
   in chunks. Connected classes get one label.
4. **The rest, exactly.** Stars say nothing of two classes of a bucket of which one or both missed the centre. In
   buckets with more than one label left, every class outside the most frequent label of its group is compared with the
   whole group, in blocks of bounded size. So every pair of classes that shares a bucket is confirmed, or connected already.

Null text counts as empty. Rows of one id are one document: their links are added up. Rows without an id are
returned with their number of shingles, without component and ``kept``. Repeated rows give repeated results;
other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import texts_of, written
from spendlake.llm.components import components
from spendlake.llm.ngram_join import product, shingles, signature

WIDTH, PERCENT = 3, 85
BANDS, BAND = 32, 3
#: Sets and shingles of a side of a comparison.
SETS, SHINGLES = 512, 1_000_000

_draw = np.random.default_rng(20240611)
_FLIP = _draw.integers(0, 1 << 64, BANDS * BAND, dtype=np.uint64)
_ODD = _draw.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], bands: int = BANDS, band: int = BAND) -> np.ndarray:
    """Minimum and maximum of every permutation, sets by ``bands * band * 2`` values (sets without shingles: 0)."""
    out = np.zeros((len(sets), bands * band, 2), np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        start = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        with np.errstate(over="ignore"):
            for p in range(bands * band):
                v = (every ^ _FLIP[p]) * _ODD[p]
                v ^= v >> np.uint64(32)
                v *= _ODD[p]
                out[full, p, 0], out[full, p, 1] = np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)
    return out.reshape(len(sets), -1)


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per set and band, different between bands."""
    parts = values.reshape(len(values), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = (key ^ parts[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures."""
    return float((a == b).mean())


def documents_of(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, s1, s2, keys`` of every document: size and signature of its set, its band keys."""
    def run(batches):
        for b in batches:
            sets = [shingles(t, width) for t in texts_of(b.column("text"))]
            sig, keys = [signature(s) for s in sets], band_keys(signatures(sets))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in sig], pa.int64()) for k in (0, 1)),
                                              pa.array(list(keys), pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "keys"])

    return written(docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>"), "minmax-signatures")


def _shared(entries: DataFrame, key: str) -> DataFrame:
    """Entries of buckets with two classes or more, with the bucket's smallest class."""
    lists = entries.groupBy(key).agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select(key, "least")
    return entries.join(lists, key)


def buckets_of(classes: DataFrame, percent: int) -> DataFrame:
    """``key, c, least``: classes by bucket of a band and like size. A class of size band ``b`` enters ``b`` and
    ``b + 1``, so any two of neighbouring bands meet."""
    entries = classes.select(F.explode("keys").alias("key"), "c", "n")
    found = written(_shared(entries, "key").select("key", "c", "n"), "band-buckets")
    size = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / min(percent, 99))) * (1 + 1e-9)))
    near = found.select(F.explode(F.array(F.xxhash64("key", size), F.xxhash64("key", size + 1))).alias("key"), "c")
    return written(_shared(near, "key"), "size-buckets")


def parts(held: str, count: str):
    """Chunks of a side: at most about ``SETS`` sets and ``SHINGLES`` shingles each."""
    return F.ceil(F.greatest(F.col(held) / SHINGLES, F.col(count) / SETS)).cast("int")


def confirmed(units: DataFrame, content: DataFrame, percent: int) -> DataFrame:
    """``a, b`` (ids of representatives): for every set of the left or right side of a unit that links with
    one of the other side, the smallest id that it is connected with inside the unit. Units: ``u, i, j, side, c``."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, side = frame["rep"].to_numpy(), frame["side"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        label, hit = ids.copy(), np.zeros(len(ids), bool)
        for i, (found, _) in zip(left, product([sets[k] for k in left], [sets[k] for k in right], percent)):
            if len(found):
                met = np.append(right[found], i)
                hit[met] = True
                near = np.unique(label[met])
                if len(near) > 1:
                    label[np.isin(label, near)] = near[0]
        return pd.DataFrame({"a": ids[hit], "b": label[hit]}).query("a != b").drop_duplicates()

    full = units.join(content, "c").select("u", "i", "j", "side", "rep", "shingles")
    return written(full.groupBy("u", "i", "j").applyInPandas(run, "a long, b long"), "confirmed")


def stars(buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Units of the bucket centres with the classes that met them."""
    met = buckets.filter("c <> least").select("c", F.col("least").alias("u")).distinct().join(sizes, "c")
    chunks = written(met.groupBy("u").agg(F.sum("n").alias("held"), F.count("*").alias("sets")).select("u", parts("held", "sets").alias("p")), "star-chunks")
    none = F.lit(0).alias("i")
    members = met.join(chunks, "u").select("u", none, F.pmod(F.xxhash64("c"), F.col("p")).cast("int").alias("j"), F.lit(1).alias("side"), "c")
    centres = chunks.select("u", none, F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("j"), F.lit(0).alias("side"), F.col("u").alias("c"))
    return members.unionByName(centres)


def leftovers(buckets: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Units of the groups of buckets in which more than one label is left: classes outside the group's most
    frequent label by the whole group."""
    labelled = buckets.select("key", "c").join(labels, "c")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("c").alias("centre")).filter("least <> most")
    rest = written(labelled.join(mixed.select("key", "centre"), "key").select("c", "label", "centre").distinct(), "mixed-buckets")
    groups = connected(rest.select(F.col("c").alias("a"), F.col("centre").alias("b"))).select(F.col("node").alias("c"), F.col("label").alias("u"))
    member = written(rest.select("c", "label").distinct().join(groups, "c").join(sizes, "c"), "mixed-groups")
    usual = (member.groupBy("u", "label").agg(F.count("*").alias("k")).groupBy("u").agg(F.max_by("label", F.struct("k", "label")).alias("usual")))
    member = member.join(usual, "u").withColumn("odd", F.col("label") != F.col("usual"))
    chunks = (member.groupBy("u").agg(F.sum("n").alias("held"), F.count("*").alias("sets"), F.sum(F.when(F.col("odd"), F.col("n"))).alias("odd_held"),
                                      F.count(F.when(F.col("odd"), 1)).alias("odd_sets"))
              .select("u", parts("held", "sets").alias("p"), parts("odd_held", "odd_sets").alias("q")))
    dealt = member.join(written(chunks, "mixed-chunks"), "u")
    at = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("odd").select("u", at("q").alias("i"), upto("p").alias("j"), F.lit(0).alias("side"), "c")
    right = dealt.select("u", upto("q").alias("i"), at("p").alias("j"), F.lit(1).alias("side"), "c")
    return left.unionByName(right)


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` (smallest node that can be reached) of edges ``a, b`` with ``b < a``. Every node hangs on its
    smallest neighbour, and that neighbour is joined to the node's others; most nodes are no one's
    neighbour, so only the few centres go through the rounds of ``components``, and the others take their centre's label."""
    edges = written(edges.filter("b < a").distinct(), "confirmed-edges")
    least = written(edges.groupBy("a").agg(F.min("b").alias("least")), "smallest-neighbours")
    between = edges.join(least, "a").filter("b <> least").select(F.col("least").alias("a"), "b")
    centres = edges.select(F.col("b").alias("a")).distinct()
    inner = least.join(centres, "a", "left_semi").select("a", F.col("least").alias("b"))
    core = components(between.unionByName(inner).distinct()).withColumnRenamed("node", "least")
    hung = least.join(centres, "a", "left_anti").select(F.col("a").alias("node"), "least").unionByName(centres.select(F.col("a").alias("node"), F.col("a").alias("least")))
    return written(hung.join(core, "least", "left").select("node", F.coalesce("label", "least").alias("label")), "connected")


def groups_of(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document with an id: ``doc_id, n_shingles, component_id``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    every = documents_of(docs, width)
    # a class gets a number as it is written; its representative is its smallest id
    classes = written(every.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
                      .withColumn("c", F.monotonically_increasing_id()), "set-classes")
    sizes = classes.select("c", "n")
    buckets = buckets_of(classes, percent)
    needed = written(classes.join(buckets.select("c").distinct(), "c", "left_semi").select("rep", "s1", "s2", "c"), "bucket-classes")

    def sets(batches):
        for b in batches:
            found = [shingles(t, width) for t in texts_of(b.column("text"))]
            sig = [signature(s) for s in found]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in sig], pa.int64()) for k in (0, 1)), pa.array([s.tobytes() for s in found], pa.binary())],
                                             names=["s1", "s2", "shingles"])

    texts = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    content = texts.mapInArrow(sets, "s1 long, s2 long, shingles binary").dropDuplicates(["s1", "s2"])
    content = written(content.join(needed, ["s1", "s2"]).select("c", "rep", "shingles"), "bucket-sets")

    two = every.groupBy("doc_id").agg(*(f(c).alias(f"{k}_{c}") for c in ("s1", "s2") for k, f in (("min", F.min), ("max", F.max))))
    two = two.filter("min_s1 <> max_s1 or min_s2 <> max_s2").select("doc_id")
    ids = every.join(two, "doc_id", "left_semi").join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
    edges = confirmed(stars(buckets, sizes), content, percent).unionByName(written(ids.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "same-ids"))
    first = connected(edges)
    labels = written(needed.join(first, F.col("rep") == F.col("node"), "left").select("c", F.coalesce("label", "rep").alias("label")), "labels")
    more = confirmed(leftovers(buckets, sizes, labels), content, percent)
    # the links found last connect labels of the first round: few are left of them
    for end in ("a", "b"):
        more = more.join(first, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("label", end)).select("a", "b")
    second = components(more).select(F.col("node").alias("component_id"), F.col("label").alias("_last"))

    def placed(rows, node):
        """``rows`` with the ``component_id`` of their column ``node``."""
        found = rows.join(first, F.col(node) == F.col("node"), "left").withColumn("component_id", F.coalesce("label", node)).drop("node", "label")
        return found.join(second, "component_id", "left").withColumn("component_id", F.coalesce("_last", "component_id")).drop("_last")

    named = placed(classes.select("s1", "s2", "rep"), "rep").drop("rep")
    out = every.select("doc_id", "n", "s1", "s2")
    alone = placed(out.filter("n = 0"), "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.filter("n > 0").join(named, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row for every row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``."""
    def sizes(batches):
        for b in batches:
            n = [len(shingles(t, width)) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), pa.array(n, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    found = groups_of(docs, width, percent)
    nameless = docs.filter("doc_id is null").select("text").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")
    return found.unionByName(nameless).withColumn("kept", F.col("doc_id") == F.col("component_id"))
