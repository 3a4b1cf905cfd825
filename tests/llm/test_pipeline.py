"""The corpus pipeline against a brute-force version of its stages."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_joins_lines import brute
from tests.llm.test_models import junk, leak_fixture

NOTICE = "Shared notice of the site"
ODD = 10_000


def corpus():
    """Rows, ids of junk and ids with a benchmark item."""
    r = random.Random(8)
    leaked, bench, planted = leak_fixture()
    verbatim = {i for i, k in planted if i % 10 == 0 and bench[k][1] in dict(leaked)[i]}
    rows = [(i, t) for i, t in leaked[:120] if i in verbatim or i % 5]
    rows += [(300 + i, junk(i)) for i in range(60)]
    for i in range(12):  # groups of copies and near copies; a chain of linked texts
        text = prose(700 + i, 140).split()
        rows += [(400 + 10 * i + k, " ".join(text[:140 - 3 * k])) for k in range(4)]
        rows += [(400 + 10 * i + 5, " ".join(text))]
    rows = [(i, f"{t}\n {NOTICE.upper() if r.random() < 0.5 else NOTICE}\t\nlast words {i}" if i % 4 == 1 and i < 300 else t) for i, t in rows]
    return rows, bench, set(range(300, 360)), verbatim


def expected(rows, bad, leaks):
    docs = [(i, t) for i, t in rows if i not in bad]
    keys = Counter(k for _, t in docs for k in {x.strip(" \t\n\v\f\r").lower() for x in t.split("\n")})
    docs = [(i, "\n".join(x for x in t.split("\n") if not (y := x.strip(" \t\n\v\f\r").lower()) or keys[y] < 10)) for i, t in docs]
    groups = brute(docs, 80, 5)
    docs = [(i, t) for i, t in docs if groups[i][1] == i and i not in leaks]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        out[i] = (len(t), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_copies_are_dropped_by_row(spark):
    a, b, c, d = (prose(k, 80) for k in (1, 2, 3, 4))
    near = " ".join(d.split()[:72])  # 68 of 76 shingles
    rows = [(1, a), (5, a), (5, c), (None, b), (9, b), (None, near), (None, d), (3, ""), (4, ""), (3, "")]
    assert rows_of(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")) in (
        sorted([(1, a), (5, c), (9, b), (None, x), (3, ""), (4, "")], key=repr) for x in (d, near))
    assert rows_of(corpus_pipeline.drop_near_copies(spark, frame(spark, []), "")) == []


def test_leaks_are_dropped_by_row(spark, sf_dir):
    item, clean, other = prose(21, 60), prose(22, 80), prose(23, 80)
    at = sf_dir(benchmark=spark.createDataFrame([(1, item), (None, prose(24, 60))], "item_id long, text string"))
    rows = [(1, clean + " " + item), (None, item), (2, clean), (2, item + " " + other), (None, other)]
    assert rows_of(corpus_pipeline.drop_leaks(spark, frame(spark, rows), at)) == sorted([(2, clean), (None, other)], key=repr)


def test_pipeline_against_brute_force(spark, sf_dir):
    rows, bench, bad, leaks = corpus()
    odd = [(i + ODD if i is not None else None, t) for i, t in odd_rows()]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 0) for i, t in rows + odd],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string, ids int")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    at = sf_dir(documents=docs.repartition(3), labels=labels, benchmark=spark.createDataFrame(bench, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in corpus_pipeline.run(spark, at).collect() if r["doc_id"] is not None and r["doc_id"] < ODD}
    want = expected(rows, bad, leaks)
    assert leaks and len(want) < len(rows) - len(bad) - len(leaks)
    assert set(got) == set(want)
    assert got == want


def test_workers_drop_what_other_operators_remember():
    from pyspark import cloudpickle
    from spendlake.llm import bpe, common, ngram_join, quality, queries

    for forget in (ngram_join._forget_words, bpe._forget_built):  # a worker gets the function, not a copy of what it holds
        assert cloudpickle.loads(cloudpickle.dumps(forget)) is forget
    ngram_join.shingles("some words to remember")
    common.takes_over("shingles", ngram_join._forget_words)
    assert len(ngram_join._WORDS) >= 4
    spec = bpe.read_spec(queries.BPE_FILE)
    kept = bpe.automaton(spec)
    assert not ngram_join._WORDS and bpe.automaton(spec) is kept
    quality.matrix(["another stage"])
    assert not bpe._BUILT


def test_a_task_gives_memory_back_when_it_ends(monkeypatch):
    from spendlake.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.lean(lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3] and given == [1]
    task = common.lean(lambda batches: (x for x in batches))([1, 2])
    next(task)
    task.close()
    assert given == [1, 1]


def test_leak_search_needs_no_second_set_of_workers(spark):
    from spendlake.llm import decontaminate

    items = decontaminate.Items([(1, prose(1, 60)), (2, prose(2, 20))])
    own = decontaminate.own_passages(spark, items)
    want = [p.astype(np.int32).tobytes() for p in items.passages()[0]] * decontaminate.OWN_WEIGHT
    assert sorted(bytes(r[0]) for r in own.collect()) == sorted(want)
    docs = decontaminate.written(spark.createDataFrame([(1, prose(1, 60))], "doc_id long, text string"), "leak-docs")
    leaks = decontaminate.find_leaks(docs, docs.toDF("item_id", "text"))
    for df in (own, leaks):  # rows of a Python list are an RDD that Python workers write
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert [r["doc_id"] for r in leaks.collect()] == [1]
