"""Jaccard join and line dedup against brute force."""
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import line_dedup, ngram_join
from spendlake.llm.components import components
from tests.llm.conftest import DOCS, odd_rows, prose


def sets_of(rows, width=4):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute(rows, percent=85, width=4):
    s = sets_of(rows, width)
    root, links = {i: i for i in s}, defaultdict(int)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i), links[i]) for i in s}


def edited(text, r, share):
    return " ".join(w if r.random() > share else f"new{r.randrange(999)}" for w in text.split())


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, prose(seed * 100 + i, r.randrange(1, 90))) for i in range(25)]
    for base in range(6):  # copies, near copies around the bound, passages shared by many
        text = prose(seed + base, 120)
        for _ in range(6):
            rows.append((len(rows), edited(text, r, r.choice((0, 0.005, 0.01, 0.02, 0.04)))))
    passage = prose(999, 60)
    rows += [(len(rows) + k, passage + " " + prose(5000 + k, r.randrange(0, 25))) for k in range(20)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, ngram_join.BLOCK), (2, 150), (3, 700)])
def test_join_equals_all_pairs(docs_of, seed, block):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs_of(rows), block=block).collect()}
    assert got == brute(rows)


def test_join_at_the_bound(docs_of):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words[:103]))]  # 100 shingles
    rows += [(10 + k, " ".join(words[:103 - k])) for k in (14, 15, 16)]  # 86, 85 and 84 of them
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.join(docs_of(rows)).collect()}
    assert got == {i: v[2] for i, v in brute(rows).items()}
    assert got[1] == 2


def test_ids_with_two_texts_connect_them(docs_of):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (5, a), (5, b), (2, b), (7, ""), (7, c), (6, c)]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.join(docs_of(rows)).collect()}
    assert got == {(1, 57): 1, (5, 57): 1, (2, 57): 1, (7, 0): 6, (7, 57): 6, (6, 57): 6}


def test_groups_cut_by_sets(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    rows = corpus(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_join_odd_rows(docs_of):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs_of(odd_rows())).collect())
    assert got[0] == (1, 0, 1, 0) and got[1] == (2, 0, 2, 0) and got[2] == (3, 0, 3, 0)
    assert [g[:3] for g in got if g[0] in (4, 5)] == [(4, 57, 4), (4, 57, 4), (5, 57, 4)]
    assert len(got) == len(odd_rows()) - 1  # the null id is left out
    assert ngram_join.join(docs_of([])).collect() == []


def test_every_row_is_returned(docs_of):
    rows = odd_rows() + [(None, None), (None, prose(1, 60))]
    got = [tuple(r) for r in ngram_join.join_all(docs_of(rows)).collect()]
    key = lambda r: [(x is not None, x or 0) for x in r]
    assert len(got) == len(rows)
    assert sorted((r for r in got if r[0] is None), key=key) == [(None, 0, None, None), (None, 1, None, None), (None, 57, None, None)]
    assert sorted(r for r in got if r[0] is not None) == sorted(tuple(r) for r in ngram_join.join(docs_of(rows)).collect())


def test_near_copies_without_an_id(spark):
    import corpus_pipeline
    near, other = prose(1, 120), prose(2, 120)
    rows = [(None, near), (None, near + " end"), (None, near), (7, other), (None, other + " end"), (None, prose(3, 50)), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "").collect()]
    assert len(got) == 5 and {(7, other), (None, prose(3, 50)), (None, None), (8, "")} <= set(got)
    assert sum(i is None and t is not None and t.startswith(near) for i, t in got) == 1


def test_product_counts_overlaps():
    r = np.random.default_rng(1)
    left = [np.unique(r.integers(0, 40, 20).astype(np.uint64)) for _ in range(12)]
    right = [np.unique(r.integers(0, 40, 22).astype(np.uint64)) for _ in range(9)]
    for a, (hits, overlap) in zip(left, ngram_join.product(left, right, 40)):
        want = {j: len(np.intersect1d(a, b)) for j, b in enumerate(right)}
        want = {j: o for j, o in want.items() if 100 * o >= 40 * (len(a) + len(right[j]) - o)}
        assert dict(zip(hits.tolist(), overlap.tolist())) == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 300), (200, 300), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(rows, min_docs, min_chars):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blanks).translate(lower)
    found = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                found[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(found.get(key(x), ())) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs,min_chars,batches,fanout", [(3, 1, 4, 2), (2, 4, 3, 3), (4, 1, 1, 2), (3, 1, 7, 2)])
def test_lines_equal_brute_force(docs_of, min_docs, min_chars, batches, fanout):
    r = random.Random(min_docs * 10 + batches)
    pool = ["Buy now!", " buy NOW!\t", "é", "", "  ", "License\x0b", "LICENSE", "tail\r", "ÉCLAIR", "éclair", "a "]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.4 else f"own {i} {k}" for k in range(r.randrange(1, 12)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "x" * 50_000 + "\nBuy now!")]
    got = line_dedup.drop_frequent(docs_of(rows), min_docs, min_chars, batches, fanout).collect()
    assert sorted((g["doc_id"], g["n_lines"], g["n_dropped"], g["kept"]) for g in got) == sorted(brute_lines(rows, min_docs, min_chars))


def test_lines_odd_rows_and_columns(spark, docs_of):
    df = docs_of(odd_rows()).withColumn("kept", F.lit("old")).withColumn("lang", F.lit("en"))
    got = line_dedup.drop_frequent(df, 2)
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped", "kept"]
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    same = [r for r in rows if r["doc_id"] in (4, 5)]
    assert {(r["n_dropped"], r["kept"]) for r in same} == {(1, "")} and len(same) == 3
    assert line_dedup.drop_frequent(spark.createDataFrame([], DOCS), 2).collect() == []
