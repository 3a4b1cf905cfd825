"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

1. Rows are quantised to integers and sorted by their place on a Hilbert curve through the ``AXES``
   dimensions of largest variance (range-partitioned, equal vectors dealt by id). Runs of
   ``GROUP`` rows become one Parquet row: ids, labels and vectors packed, and for every block of ``BLOCK``
   rows its zone map, the minimum and maximum of each dimension and of the label.
2. An anchor asks for windows of scores ``low <= score <= high`` and wants the first ``k`` rows of each.
   Interval arithmetic over a zone map bounds the scores of a block from both sides; only blocks
   that meet a window can matter. Anchors meet zone maps in packs: a stated query set against all
   blocks, joined on the number of a pack of zone maps.
3. An anchor's own group is read first. If it yields ``k`` rows for a window, the worst of them raises
   ``low``. Then the other groups that bounds leave over are read: one stream per task has each
   group's matrix followed by the anchors that must read it.

Positives are one window without limits over rows of the anchor's label; every positive with score ``p``
then opens the window ``[ceil(floor_percent * p / 100), p]`` over rows of other labels. The result is exact:
blocks are left out only if no row of theirs can count.

Rows without id or label, with a null vector or a null or non-finite component take no part. Vectors of
unlike length are compared as if the shorter one ended in zeros; scaled components saturate at
``vectors.LIMIT``. Other rows are those with another id; repeated rows count as often as they
occur, as anchors too. An anchor without positives, a positive without negatives and an empty
table give no rows. Columns other than id, label and vector are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spendlake.llm.common import small_batches, written
from spendlake.llm.vectors import padded, quantised

AXES, BITS = 16, 4
BLOCK, GROUP = 256, 16_384
#: Anchors of a pack and groups of a pack of zone maps.
ANCHORS, ZONES = 16_384, 256
#: Anchors that are scored at once.
CHUNK = 128
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62

ROWS = "vec_id long, label long, vec binary, hilbert long"
GROUPS = "g long, ids binary, labels binary, vecs binary, lo binary, hi binary, first binary, last binary"
ANCHOR = "a long, anchor_id long, anchor_label long, home long, vec binary"
SLOTS = "slots array<struct<slot:int,low:long,high:long>>"
GROUP_CELLS = ("ids", "labels", "vecs", "lo", "hi", "first", "last")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of ``axes`` cells in [0, 2^bits), ``axes * bits <= 64``, as signed
    longs in curve order: the published transpose form (J. Skilling, 2004), for all rows at once."""
    x = cells.T.astype(np.uint64).copy()
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):  # undo the excess work of the inverse
        q = one << np.uint64(bit)
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & (q - one))
            x[0] ^= np.where(up, q - one, swap)
            x[i] ^= swap
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
    x ^= t
    place = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = (place << one) | ((row >> np.uint64(bit)) & one)
    return (place ^ (one << np.uint64(63))).view(np.int64)


def spreads(rows: DataFrame, scale: int) -> list:
    """Per dimension: count, minimum, maximum and variance of the scaled components (rows: dimensions)."""
    def run(batches):
        parts = []
        for b in batches:
            _, lens, flat = quantised(b.column("v"), scale)
            if not len(flat):
                continue
            dim = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            dims = int(lens.max())
            lo, hi = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
            np.minimum.at(lo, dim, flat)
            np.maximum.at(hi, dim, flat)
            wide = flat.astype(float)
            parts.append([np.arange(dims), lo, hi, np.bincount(dim, minlength=dims), np.bincount(dim, wide, dims), np.bincount(dim, wide * wide, dims)])
        if parts:
            cols = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()] * 2)], names=["dim", "lo", "hi", "n", "s", "q"])

    return (rows.select("v").mapInArrow(run, "dim long, lo long, hi long, n long, s double, q double").groupBy("dim")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("var")).orderBy("dim").collect())


def ordered(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """The usable rows packed, with their place on the curve; the number of dimensions."""
    stats = spreads(rows, scale)
    dims = len(stats)
    axes = sorted(sorted(range(dims), key=lambda d: (-stats[d]["var"], d))[:AXES])
    low = np.array([stats[d]["lo"] for d in axes], float)
    width = np.array([max(1, stats[d]["hi"] - stats[d]["lo"] + 1) for d in axes], float)

    def run(batches):
        for b in batches:
            usable, lens, flat = quantised(b.column("v"), scale)
            m, keep = padded(lens, flat, dims), pa.array(usable)
            cells = np.clip((m[:, axes] - low) / width * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            place = hilbert(cells, BITS) if axes else np.zeros(len(m), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(keep), b.column("label").filter(keep), pa.array([r.tobytes() for r in m], pa.binary()),
                                              pa.array(place, pa.int64())], names=["vec_id", "label", "vec", "hilbert"])

    return written(rows.mapInArrow(run, ROWS), "hilbert-rows"), dims


def grouped(rows: DataFrame, dims: int, block: int, group: int) -> DataFrame:
    """Groups of the sorted rows, each with the zone maps of its blocks; ``g`` plus a row's place is unique."""
    def pack(g, ids, labels, vecs):
        m = np.frombuffer(b"".join(vecs), np.int32).reshape(len(ids), dims)
        ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
        cut = np.arange(0, len(ids), block)
        zones = [f.reduceat(x, cut, axis=0) for x in (m, labels) for f in (np.minimum, np.maximum)]
        cells = [ids, labels, m, *(z.astype(np.int32) for z in zones[:2]), *zones[2:]]
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                                          names=["g", "ids", "labels", "vecs", "lo", "hi", "first", "last"])

    def run(batches):
        g, held = TaskContext.get().partitionId() << 32, ([], [], [])
        for b in batches:
            for kept, name in zip(held, ("vec_id", "label", "vec")):
                kept.extend(b.column(name).to_pylist())
            while len(held[0]) >= group:
                yield pack(g, *(x[:group] for x in held))
                g, held = g + group, tuple(x[group:] for x in held)
        if held[0]:
            yield pack(g, *held)

    spread = rows.repartitionByRange(F.col("hilbert"), F.xxhash64("vec_id")).sortWithinPartitions("hilbert", "vec_id")
    return written(spread.select("vec_id", "label", "vec").mapInArrow(run, GROUPS), "hilbert-groups")


def anchors_of(groups: DataFrame, dims: int, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``, with a key of their own and their group."""
    def run(batches):
        for b in batches:
            for g, ids, labels, vecs in zip(*(b.column(c).to_pylist() for c in ("g", "ids", "labels", "vecs"))):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                at = np.flatnonzero(ids % every == 0)
                m = np.frombuffer(vecs, np.int32).reshape(len(ids), dims)[at]
                yield pa.RecordBatch.from_arrays([pa.array(g + at, pa.int64()), pa.array(ids[at]), pa.array(labels[at]), pa.array(np.full(len(at), g)),
                                                  pa.array([r.tobytes() for r in m], pa.binary())], names=["a", "anchor_id", "anchor_label", "home", "vec"])

    return written(groups.select("g", "ids", "labels", "vecs").mapInArrow(run, ANCHOR), "anchors")


class Asked:
    """Anchors of some Arrow or Python rows, with their windows as ragged arrays."""

    def __init__(self, rows: list[dict], dims: int):
        self.rows = rows
        self.m = np.frombuffer(b"".join(r["vec"] for r in rows), np.int32).reshape(len(rows), dims).astype(float)
        self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("anchor_id", "anchor_label"))
        n = [len(r["slots"]) for r in rows]
        self.owner = np.repeat(np.arange(len(rows)), n)
        self.slot, self.low, self.high = (np.array([s[c] for r in rows for s in r["slots"]], np.int64) for c in ("slot", "low", "high"))

    def must_read(self, lo, hi, first, last, same: bool) -> np.ndarray:
        """Anchors by blocks: whether a row of the block can lie in a window of the anchor."""
        plus, minus = np.maximum(self.m, 0), np.minimum(self.m, 0)
        most, least = plus @ hi.T + minus @ lo.T, plus @ lo.T + minus @ hi.T
        meets = np.zeros(most.shape, bool)
        for o, low, high in zip(self.owner, self.low, self.high):
            meets[o] |= (most[o] >= low) & (least[o] <= high)
        mine = self.labels[:, None]
        return meets & ((first <= mine) & (mine <= last) if same else ~((first == mine) & (last == mine)))


def zones_of(row: dict, dims: int):
    lo, hi = (np.frombuffer(row[c], np.int32).reshape(-1, dims).astype(float) for c in ("lo", "hi"))
    return lo, hi, *(np.frombuffer(row[c], np.int64) for c in ("first", "last"))


def to_read(groups: DataFrame, anchors: DataFrame, dims: int, same: bool) -> DataFrame:
    """``g`` and the anchors that must read a block of that group, their own group left out."""
    n_groups, n_anchors = groups.count(), anchors.count()
    sets, packs = max(1, -(-n_groups // ZONES)), max(1, -(-n_anchors // ANCHORS))
    zones = (groups.select(F.pmod(F.xxhash64("g"), F.lit(sets)).cast("int").alias("z"), F.struct("g", "lo", "hi", "first", "last").alias("zone"))
             .groupBy("z").agg(F.collect_list("zone").alias("zones")))
    asked = (anchors.groupBy(F.pmod(F.xxhash64("a"), F.lit(packs)).cast("int").alias("pack")).agg(F.collect_list(F.struct(*anchors.columns)).alias("asked"))
             .select("asked", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("z")))
    out = f"g long, {ANCHOR}, {SLOTS}"

    def run(batches):
        for b in batches:
            for zones, rows in zip(b.column("zones").to_pylist(), b.column("asked").to_pylist()):
                for at in range(0, len(rows), CHUNK):
                    part = Asked(rows[at:at + CHUNK], dims)
                    found = []
                    for zone in zones:
                        hit = part.must_read(*zones_of(zone, dims), same).any(axis=1)
                        found += [{"g": zone["g"], **part.rows[i]} for i in np.flatnonzero(hit) if part.rows[i]["home"] != zone["g"]]
                    if found:
                        yield from pa.Table.from_pylist(found, schema).to_batches()

    schema = _schema(out)
    return asked.join(zones, "z").select("zones", "asked").mapInArrow(run, out)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def best(part: Asked, group: dict, dims: int, k: int, same: bool, size: int) -> list[np.ndarray]:
    """Columns anchor index, slot, id, score: the first ``k`` rows of the group for every window."""
    ids, labels = (np.frombuffer(group[c], np.int64) for c in ("ids", "labels"))
    m = np.frombuffer(group["vecs"], np.int32).reshape(len(ids), dims)
    read = part.must_read(*zones_of(group, dims), same)
    found = [[np.zeros(0, np.int64)] * 3]
    lows, highs = np.full(len(part.rows), NO_HIGH), np.full(len(part.rows), NO_LOW)
    np.minimum.at(lows, part.owner, part.low)
    np.maximum.at(highs, part.owner, part.high)
    for block in np.flatnonzero(read.any(axis=0)):
        who, cut = np.flatnonzero(read[:, block]), slice(block * size, (block + 1) * size)
        score = (part.m[who] @ m[cut].T.astype(float)).astype(np.int64)
        alike = labels[cut] == part.labels[who][:, None]
        fits = (score >= lows[who][:, None]) & (score <= highs[who][:, None]) & ((alike & (ids[cut] != part.ids[who][:, None])) if same else ~alike)
        i, j = np.nonzero(fits)
        found.append([who[i], ids[cut][j], score[i, j]])
    owner, row, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((row, -score, owner))
    owner, row, score = owner[order], row[order], score[order]
    start = np.searchsorted(owner, np.arange(len(part.rows) + 1))
    out = [[np.zeros(0, np.int64)] * 4]
    for o, slot, low, high in zip(part.owner, part.slot, part.low, part.high):
        own = score[start[o]:start[o + 1]]  # falling
        a = start[o] + np.searchsorted(-own, -high, "left")
        z = min(a + k, start[o] + np.searchsorted(-own, -low, "right"))
        if a < z:
            out.append([np.full(z - a, o), np.full(z - a, slot), row[a:z], score[a:z]])
    return [np.concatenate(c) for c in zip(*out)]


def read_groups(groups: DataFrame, asked: DataFrame, dims: int, k: int, same: bool, block: int) -> DataFrame:
    """``a, anchor_id, slot, vec_id, score``: for every window the first ``k`` rows of every group that its anchor reads."""
    fields = _schema(f"g long, {ANCHOR}, {SLOTS}")
    cols = [c for c in fields.names if c != "g"]
    stream = groups.select("g", F.lit(0).alias("kind"), *GROUP_CELLS).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("g").sortWithinPartitions("g", "kind")

    def answer(group, rows):
        part = Asked(rows, dims)
        o, slot, ids, score = best(part, group, dims, k, same, block)
        keys = (np.array([r[c] for r in rows], np.int64)[o] for c in ("a", "anchor_id"))
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(slot, pa.int32()), pa.array(ids), pa.array(score)],
                                          names=["a", "anchor_id", "slot", "vec_id", "score"])

    def run(batches):
        group, rows = None, []
        for b in batches:
            kinds = b.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if rows:
                        yield answer(group, rows)
                    rows = []
                    group = {c: b.column(c)[i].as_py() for c in GROUP_CELLS}
                else:
                    rows.append({c: b.column(c)[i].as_py() for c in cols})
                    if len(rows) == CHUNK:
                        yield answer(group, rows)
                        rows = []
        if rows:
            yield answer(group, rows)

    return stream.mapInArrow(run, "a long, anchor_id long, slot int, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(groups: DataFrame, anchors: DataFrame, dims: int, k: int, same: bool, block: int = BLOCK) -> DataFrame:
    """``a, anchor_id, slot, vec_id, score, rank``: the first ``k`` rows of each window of ``anchors`` (with ``slots``)."""
    home = written(read_groups(groups, anchors.withColumn("g", F.col("home")), dims, k, same, block), "home-groups")
    worst = home.groupBy("a", "slot").agg(F.min("score").alias("worst"), F.count("*").alias("n")).filter(F.col("n") == k)
    seeds = worst.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("seeds"))
    raised = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), F.coalesce(F.try_element_at("seeds", s["slot"]), s["low"]).alias("low"), s["high"].alias("high")))
    anchors = written(anchors.join(seeds, "a", "left").withColumn("slots", raised).drop("seeds"), "raised-anchors")
    rest = read_groups(groups, to_read(groups, anchors, dims, same), dims, k, same, block)
    return written(_first(home.unionByName(rest), k), "found")


def mine(rows: DataFrame, label: Column | str = "label", every: int = 100, k: int = 5, floor_percent: int = 80, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Per anchor (id divisible by ``every``), its first ``k`` positives and the first ``k`` negatives of each:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = rows.sparkSession
    small_batches(spark, 2048)
    label = F.col(label) if isinstance(label, str) else label
    rows = (rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"))
            .filter("vec_id is not null and label is not null"))
    packed, dims = ordered(rows, scale)
    groups = grouped(packed, dims, block, group)
    small_batches(spark, 16)  # from here a row can be a group of some megabytes
    anchors = anchors_of(groups, dims, every)

    open_ = F.array(F.struct(F.lit(0).alias("slot"), F.lit(NO_LOW).cast("long").alias("low"), F.lit(NO_HIGH).cast("long").alias("high")))
    positives = search(groups, anchors.withColumn("slots", open_), dims, k, True, block)
    windows = (positives.withColumn("low", -F.expr(f"(score * -{floor_percent} - pmod(score * -{floor_percent}, 100)) div 100"))
               .filter(F.col("low") <= F.col("score")).groupBy("a")
               .agg(F.collect_list(F.struct(F.col("rank").alias("slot"), "low", F.col("score").alias("high"))).alias("slots")))
    negatives = search(groups, anchors.join(windows, "a"), dims, k, False, block)
    return (positives.select("a", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            .join(negatives.select("a", "slot", "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["a", "slot"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
