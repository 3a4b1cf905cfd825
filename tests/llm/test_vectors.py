"""Hard-negative search and centroid clustering against brute force."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm import centroids, queries, zone_search
from spendlake.llm.zone_search import hilbert

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def clustered(seed: int, n: int, dims: int):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    v = centres[r.integers(0, 6, n)] + 0.3 * r.normal(size=(n, dims))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    return [(i, [float(x) for x in v[i]], int(r.integers(0, 4))) for i in range(n)]


def odd(dims: int):
    one = [0.5] * dims
    return [(7001, None, 1), (7002, [None] + one[1:], 1), (7003, [float("nan")] + one[1:], 2), (7004, [float("inf")] + one[1:], 2), (None, one, 1),
            (7005, one, None), (7100, one, 3), (7101, one, 3), (7102, one, 3), (7103, one, 2), (7104, one, 2), (7200, [0.0] * dims, 1), (7201, [-x for x in one], 1)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def brute_mine(rows, every=100, k=5):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in (r for r in kept if r[0] % every == 0):
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            found = [x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, rank, x[1], -s, -x[0]) for rank, x in enumerate(found, 1)]
    return sorted(out)


def mined(df, **args):
    return sorted(tuple(r) for r in zone_search.mine(df, **args).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed,n,dims,every,block,group", [(1, 400, 8, 20, 8, 64), (2, 300, 5, 50, 256, 16_384), (3, 250, 17, 10, 16, 32)])
def test_negatives_equal_brute_force(spark, seed, n, dims, every, block, group):
    rows = clustered(seed, n, dims) + odd(dims)
    assert mined(frame(spark, rows), every=every, block=block, group=group) == brute_mine(rows, every)


def test_hot_vector_and_unlike_lengths(spark):
    rows = clustered(5, 120, 6)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]  # one vector in more than half of the rows
    rows += [(2000, [0.25, 0.5], 1), (2001, [], 2), (2002, [0.1] * 9, 1)]
    assert mined(frame(spark, rows, 7), every=40, block=8, group=32) == brute_mine(rows, 40)


def test_mine_empty_table_and_clashing_columns(spark):
    assert mined(frame(spark, [], 1)) == []
    rows = clustered(6, 60, 4)
    wide = frame(spark, rows).withColumns({c: F.lit(1) for c in ("a", "g", "v", "vec", "slot", "score", "rank", "anchor_id")})
    assert mined(wide, every=20) == brute_mine(rows, 20)


def test_blocks_far_from_the_windows_are_not_read(spark):
    """Zone maps of two tight bundles: an anchor of one need not read blocks of the other."""
    r = np.random.default_rng(9)
    m = np.concatenate([r.integers(90, 100, (64, 6)), r.integers(-100, -90, (64, 6))]).astype(np.int32)
    zone = [f.reduceat(m, [0, 64], axis=0).astype(float) for f in (np.minimum, np.maximum)]
    asked = zone_search.Asked([{"vec": m[3].tobytes(), "anchor_id": 3, "anchor_label": 0, "slots": [{"slot": 0, "low": 1, "high": 1 << 40}]}], 6)
    read = asked.must_read(*zone, np.zeros(2, np.int64), np.ones(2, np.int64), True)
    assert read.tolist() == [[True, False]]


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij")).reshape(axes, -1).T
        place = hilbert(cells, bits)
        assert len(set(place.tolist())) == len(cells)
        steps = np.abs(np.diff(cells[np.argsort(place)].astype(int), axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_op11_query(spark, sf_dir):
    rows = clustered(11, 320, 6) + odd(6)
    got = sorted(tuple(r) for r in queries.op11(spark, sf_dir(embeddings=frame(spark, rows))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_mine([(i, v, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab) for i, v, lab in rows])


def brute_clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    little = lambda v: np.array(v, np.int32).tobytes()
    c = [v for _, _, v in sorted((sha(i), little(v), v) for i, v in kept)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            c[j] = tuple(sum(x) // len(own) for x in zip(*own))
    at = assign()
    d = [far(v, c[a]) for (_, v), a in zip(kept, at)]
    sums = [sum(x for x, a in zip(d, at) if a == j) for j in range(len(c))]
    return sorted(((i, a, x, sums[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d)), key=repr)


def clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed,n,dims,k,rounds", [(1, 300, 8, 16, 3), (2, 200, 3, 5, 8), (3, 9, 4, 16, 3)])
def test_clusters_equal_plain_rounds(spark, seed, n, dims, k, rounds):
    rows = clustered(seed, n, dims) + odd(dims) + [(8000, [0.1] * (dims + 1), 1), (8001, [], 1)]
    got = clusters(centroids.cluster(frame(spark, rows), k, rounds, dims))
    assert got == brute_clusters(rows, k, rounds, dims)


def test_clusters_of_equal_vectors_and_empty_table(spark):
    rows = [(i, [0.5, -0.25], 0) for i in range(40)] + [(3, [0.5, -0.25], 0)]  # ties everywhere, a repeated row
    assert clusters(centroids.cluster(frame(spark, rows), 4, 3, 2)) == brute_clusters(rows, 4, 3, 2)
    assert clusters(centroids.cluster(frame(spark, [], 1), 4, 3, 2)) == []


def test_op13_query(spark, sf_dir):
    rows = clustered(13, 150, 64) + odd(64)
    table = frame(spark, rows).withColumns({c: F.lit(1) for c in ("v", "cluster", "distance", "upper")})
    assert clusters(queries.op13(spark, sf_dir(embeddings=table))) == brute_clusters(rows, 16, 3, 64)


def test_bounds_skip_most_distances_and_never_the_nearest():
    """Ten rounds on clustered data: loosened by the norm of the total displacement, bounds leave most
    distances unmeasured, and every assignment is the exact one."""
    r = np.random.default_rng(4)
    m = (r.integers(-60, 60, (8, 16))[r.integers(0, 8, 2000)] + r.integers(-8, 9, (2000, 16))).astype(np.int32)
    history = m[r.choice(2000, 16, replace=False)].astype(np.int64)[None]
    exact = lambda c: ((m[:, None].astype(np.int64) - c[None]) ** 2).sum(axis=2)
    d = exact(history[0])
    cluster, root = d.argmin(axis=1), np.sqrt(d.astype(float))
    upper, upper_at = centroids._up(root.min(axis=1)), np.zeros(2000, np.int64)
    lower, lower_at = centroids._down(root), np.zeros((2000, 16), np.uint8)
    measured = 0
    for _ in range(10):
        new = history[-1].copy()
        for j in np.unique(cluster):
            new[j] = m[cluster == j].sum(axis=0, dtype=np.int64) // (cluster == j).sum()
        history = np.append(history, new[None], axis=0)
        measured += centroids.reassign(m, cluster, upper, upper_at, lower, lower_at, history)
        assert (cluster == exact(new).argmin(axis=1)).all()
    assert measured < 0.3 * 10 * 2000 * 16
