"""Near-duplicate removal by min-max hashing against all pairs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import minmax_dedup as M
from spendlake.llm import queries
from spendlake.llm.ngram_join import shingles
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_joins_lines import corpus, edited


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """Rows with ids in the order of ``rows``; rows of one id are one document."""
    found = [(i, sets_of(t)) for i, t in rows]
    root = {i: i for i, _ in found if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, s) in enumerate(found):
        for j, t in found[x + 1:]:
            both = len(s & t)
            if i is not None and j is not None and both and 100 * both >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(s), None if i is None else find(i), None if i is None else find(i) == i) for i, s in found), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("seed,sets", [(1, M.SETS), (2, 3)])
def test_groups_equal_all_pairs(docs_of, monkeypatch, seed, sets):
    monkeypatch.setattr(M, "SETS", sets)
    rows = corpus(seed)
    assert got(M.dedup(docs_of(rows))) == brute(rows)


def test_odd_rows_and_ids_with_two_texts(docs_of):
    a, b = prose(1, 60), prose(77, 60)
    rows = odd_rows() + [(50, a + " and more"), (40, b), (41, b), (40, prose(78, 50)), (30, prose(78, 50)), (None, b), (60, ""), (60, b)]
    assert got(M.dedup(docs_of(rows))) == brute(rows)
    assert got(M.dedup(docs_of([]))) == []


def test_links_past_the_centre(docs_of):
    """A chain whose ends do not link, in the order that makes an end the smallest id of its buckets."""
    words = prose(5, 240).split()
    rows = [(k, " ".join(words[6 * k:6 * k + 160])) for k in range(12)]
    rows += [(100 + k, edited(" ".join(words[:160]), random.Random(k), 0.02)) for k in range(60)]
    assert got(M.dedup(docs_of(rows))) == brute(rows)


def test_hot_group_in_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(M, "SETS", 16)
    base = prose(9, 90)
    rows = [(i, edited(base, random.Random(i), 0.01 if i % 3 else 0.05)) for i in range(150)] + [(500 + i, base) for i in range(50)]
    assert got(M.dedup(docs_of(rows, parts=5))) == brute(rows)


def test_signature_estimates_the_similarity():
    """Unbiased, and of lower variance than as many minima alone."""
    r = np.random.default_rng(3)
    both, minima = [], []
    for _ in range(150):
        a = r.integers(0, 1 << 64, 300, dtype=np.uint64)
        s = M.signatures([np.unique(a[:230]), np.unique(a[70:])])  # 160 of 300
        both.append(M.likeness(s[0, :96], s[1, :96]))  # 48 permutations
        minima.append(M.likeness(s[0, ::2][:96], s[1, ::2][:96]))  # 96 permutations
    assert abs(np.mean(both) - 160 / 300) < 0.02
    assert np.var(both) < 1.25 * np.var(minima)


def test_recall_of_the_bands():
    """Pairs at the bound meet in a band: at least 0.999 of 500."""
    hits = 0
    for k in range(500):
        r = np.random.default_rng(k)
        a = r.integers(0, 1 << 64, 200, dtype=np.uint64)
        cut = r.integers(14, 17)
        keys = M.band_keys(M.signatures([np.unique(a[:200 - cut]), np.unique(a[cut:])]))
        hits += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert hits >= 500 * 0.999


def test_op12_query(spark, sf_dir, docs_of):
    rows = corpus(8) + odd_rows()
    docs = docs_of([(None if i is None else i + 1000, t) for i, t in rows]).withColumns({c: F.lit("x") for c in ("n", "c", "rep", "label", "component_id", "key")})
    assert got(queries.op12(spark, sf_dir(documents=docs))) == brute([(None if i is None else i + 1000, t) for i, t in rows])
    assert shingles("a b").size == 1
