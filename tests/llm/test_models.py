"""Language model, classifier, page labeller, decontamination, personal data, fingerprints."""
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlake.llm import decontaminate, fingerprints, html_blocks, pii, pitman_yor, quality, queries
from spendlake.llm.common import held_out
from tests.llm.conftest import odd_rows, prose


# ------------------------------------------------------------------ language model

def test_stirling_numbers_and_table_conditionals():
    s = pitman_yor.log_stirling(0.5, 6)
    assert np.exp(s[3, 1]) == pytest.approx(0.75) and np.exp(s[3, 3]) == pytest.approx(1)
    c, p, others = np.array([3]), np.array([0.2]), np.array([2])
    got = pitman_yor.table_weights(c, p, others, 0.5, pitman_yor.log_stirling(0.5))[0]
    theta, d = pitman_yor.THETA, 0.5
    weigh = [np.exp(s[3, t]) * 0.2**t * math.prod(theta + d * (2 + k) for k in range(t)) for t in range(1, 4)]
    assert got[1:4] == pytest.approx(np.array(weigh) / sum(weigh))


def test_chain_gives_distributions():
    rng = np.random.default_rng(3)
    counts = rng.poisson(3, (6, 6)) * (rng.random((6, 6)) < 0.6)
    coc = [(1, 1, 50), (2, 2, 20), (9, 9, 3), (400, 400, 1)]
    p, mean, total = pitman_yor.run_chain(counts, coc, 1)
    assert (p / pitman_yor.SAMPLES).sum(axis=1) == pytest.approx(np.ones(6))
    mean = mean / pitman_yor.SAMPLES
    assert mean[0] == 1 and np.all(np.diff(mean) > 0) and mean[3] < 400


def brute_base(rows, mod=10):
    out = lambda i: zlib.crc32(str(i).encode()) % mod == 0
    c = Counter()
    for i, t in rows:
        if not out(i):
            c.update((t or "").encode().lower().split())
            c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want[i] = (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return want, n


def test_scores_and_base(docs_of, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SENT", 50)  # most words go the way of the join
    rows = [(i, prose(i, 40) + f" rare{i}") for i in range(60)] + [(100, None), (101, ""), (102, "Unseen WORDS only"), (103, prose(7, 9000))]
    docs = docs_of(rows + [(5, rows[5][1])])
    scores, model = pitman_yor.score_texts(docs, docs.filter(~held_out(10)).dropDuplicates(["doc_id"]))
    got = scores.collect()
    want, n = brute_base(rows)
    assert model.tokens == n and len(got) == len(rows) + 1
    for r in got:
        t, k, b = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (t, k)
        assert r["base_score"] == pytest.approx(b) and r["score"] < 0
    probs = np.power(10, model.pairs)
    assert probs.sum(axis=1) == pytest.approx(np.ones(len(probs)))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert pitman_yor.perplexity(scores) > 1


def test_seats_of_pairs_follow_the_posterior():
    d, theta, c, base = 0.6, pitman_yor.THETA, (3, 2, 1), (0.2, 0.05, 0.3)
    st = pitman_yor.log_stirling(d, 6)
    mean, norm = np.zeros(3), 0.0
    for t in [(i, j, 1) for i in (1, 2, 3) for j in (1, 2)]:
        p = math.prod(np.exp(st[n, k]) * b**k for n, k, b in zip(c, t, base)) * math.prod(theta + d * k for k in range(sum(t)))
        mean, norm = mean + p * np.array(t), norm + p
    times = 3000
    got, all_t = pitman_yor.seat(np.repeat(np.arange(times), 3), np.array(c * times), np.array(base * times), np.ones(times, np.int64), d,
                                 pitman_yor.log_stirling(d), 1)
    assert got.reshape(times, 3).mean(axis=0) == pytest.approx(mean / norm, abs=0.01)
    assert all_t.mean() == pytest.approx(sum(mean) / norm, abs=0.02)


@pytest.mark.parametrize("salt", [1 << 14, 25])
def test_pairs_of_rare_words_have_contexts(docs_of, monkeypatch, salt):
    monkeypatch.setattr(pitman_yor, "SYMBOLS", 12)  # nearly all words share one symbol
    monkeypatch.setattr(pitman_yor, "SENT", 200)
    monkeypatch.setattr(pitman_yor, "SALT", salt)  # 25: frequent contexts are dealt in parts
    monkeypatch.setattr(pitman_yor, "BLOCK", 100)
    rows = [(i, prose(i, 30).replace("the", f"left{i % 20} right{i % 20}")) for i in range(80)]
    training = docs_of(rows)
    vocab = pitman_yor.written(pitman_yor.count_words(training), "word-counts")
    model = pitman_yor.fit(training, vocab)
    pairs, contexts, known = seated = pitman_yor.seat_pairs(training, vocab, model)
    seen = {(r["u"], r["w"]): r["lp"] for r in pairs.collect()}
    want = {x for _, t in rows for w in [[b"\n", *t.encode().lower().split(), b"\n"]] for x in zip(w, w[1:])}
    h = pitman_yor.signed_hash
    assert set(seen) == {(h(a), h(b)) for a, b in want}  # all pairs, whatever their words' counts
    left = {r["u"]: r["left"] for r in contexts.collect()}
    assert (max(known.parts) > 1) == (salt == 25) == any(r["dealt"] for r in contexts.collect())
    words = {bytes(r["word"]): r["n"] for r in vocab.collect()}
    rest = len(model.symbol)

    def base(u, w):
        own = 1 if w in model.symbol else model.word_probability(words.get(w, 0), model.mean_tables.get(pitman_yor._bin_of(words[w]), 1.0) if w in words else 0)
        return 10 ** model.pairs[model.symbol.get(u, rest), model.symbol.get(w, rest)] * own

    for u in words:  # all words and the unknown one add up to 1 in every context
        p = sum(10 ** seen[h(u), h(w)] if (h(u), h(w)) in seen else left[h(u)] * base(u, w) for w in [*words, b"unknown"])
        assert p == pytest.approx(1, abs=0.01)
    texts = [(1, "left3 right3"), (2, "left3 right4"), (3, "new left3 new"), (4, ""), (4, "")]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs_of(texts), vocab, model, seated).collect()}
    for i, t in texts:
        w = [b"\n", *t.encode().split(), b"\n"]
        assert got[i] == pytest.approx(sum(seen[h(a), h(b)] if (h(a), h(b)) in seen else math.log10(left.get(h(a), 1) * base(a, b)) for a, b in zip(w, w[1:])))
    assert got[1] > got[2] + 0.5


def test_pairs_take_few_bytes_on_disk(docs_of, spark):
    r = random.Random(5)
    words = [f"{r.choice('bcdfgh')}{i:x}" for i in range(3000)]
    rows = [(i, " ".join(words[int(3000 * r.random() ** 3)] for _ in range(250))) for i in range(400)]
    docs = docs_of(rows).repartition(2).localCheckpoint()

    def held():  # shuffle files of this session
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return sum(os.path.getsize(f) for f in files if "shuffle" in os.path.basename(f) and os.path.exists(f))

    before = held()
    pitman_yor.score_texts(docs, docs)[0].collect()
    pairs = sum(len(t.split()) + 1 for _, t in rows)
    assert held() - before < 1.1 * pairs  # 1.37 while single pairs were shuffled


def test_records_hold_columns_of_any_size():
    rng = np.random.default_rng(1)
    for _ in range(60):
        cols = {n: rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 40)) if "other" in n else rng.integers(0, 10 ** rng.integers(1, 12), rng.integers(0, 300))
                for n in pitman_yor.PAIRS}
        got = pitman_yor.unpacked(pa.scalar(pitman_yor.packed(**cols), pa.binary()))
        assert all(np.array_equal(got[n], x) for n, x in cols.items())


def test_shares_of_contexts_change_no_score(docs_of, monkeypatch):
    rows = [(i, prose(i, 60) + f" rare{i} rare{i % 7}") for i in range(80)] + [(90, None), (91, "Unseen WORDS only")]
    docs = docs_of(rows + [(5, rows[5][1])])
    monkeypatch.setattr(pitman_yor, "SENT", 60)
    got = []
    for held, chunk in ((1 << 19, 1 << 20), (150, 300)):  # one share, and some in several groups, met by many batches of texts
        monkeypatch.setattr(pitman_yor, "HELD", held)
        monkeypatch.setattr(pitman_yor, "CHUNK", chunk)
        scores, model = pitman_yor.score_texts(docs, docs.filter(~held_out(10)))
        got.append(sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in scores.collect()))
    assert model.tokens > 8 * 2 * 150
    for a, b in zip(*got):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == pytest.approx(b[4], rel=0.02)  # blocks draw anew


def test_without_training_rows(docs_of):
    scores, _ = pitman_yor.score_texts(docs_of([(1, "a b"), (2, None)]), docs_of([]))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in scores.collect()) == [(1, 3, 0), (2, 1, 0)]


# ------------------------------------------------------------------ quality

def junk(seed):
    r = random.Random(seed)
    return " ".join(w + r.choice(("###", "$$$", "!!!", " |")) for w in prose(seed, 60).split())


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.random((900, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    t = quality.fit(x[:600], y[:600])
    assert ((t.score(x[600:]) > 0.5) == y[600:]).mean() > 0.95

    def walk(row):  # node by node
        total = t.base
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + math.exp(-total))

    assert t.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_classifier_on_held_out_rows(docs_of, spark):
    rows = [(i, junk(i) if i % 3 == 0 else prose(i, 70)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = quality.train(quality.training_rows(docs, labels, ~held_out(5)))
    got = quality.score(docs.withColumn("score", F.lit("x")), model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in held]) > 0.95
    odd = quality.score(docs_of(odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)


def test_classifier_without_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(quality.training_rows(docs_of(odd_rows()), none, ~held_out(5)))
    assert {r["score"] for r in quality.score(docs_of(odd_rows()), model).collect()} == {0.5}


# ------------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) x="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>{h}</h1><p>{a}<p><b>{b}</b> &amp; more&nbsp;text<br>end
<form><input name=q><button>Go</button></form><p>{c}</article>
<aside class="sidebar"><p>Popular</p></aside><div id="comments"><p>{d}</p></div><footer>&copy; x</footer></body></html>"""


def page(k):
    return PAGE.format(h=f"Title {k}", a=prose(k, 30), b=prose(k + 500, 10), c=prose(k + 900, 20), d=prose(k + 1300, 25))


def wanted(k):
    return "\n".join([f"Title {k}", prose(k, 30), prose(k + 500, 10) + " & more text end", prose(k + 900, 20)])


def test_labeller_extracts_the_article(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", page(k)) for k in range(90)], "page_id long, url string, html string")
    net = html_blocks.fit(pages.filter("page_id < 60"))
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(pages.withColumn("text", F.lit("old")), net).collect()}
    assert sum(got[k] == wanted(k) for k in range(60, 90)) >= 29
    odd = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<"), (4, "u", "plain text"), (5, "u", "<p>" * 3000 + "deep"),
                                 (6, "u", "<article><p>" + "long " * 40000), (6, "u", "a<b")], "page_id long, url string, html string")
    rows = html_blocks.extract(odd, net).collect()
    assert len(rows) == 7 and {r["text"] for r in rows if r["page_id"] < 3} == {""}
    assert html_blocks.extract(odd.limit(0), html_blocks.fit(odd.limit(0))).collect() == []


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    net = html_blocks.BiLstm(dim=html_blocks.DIM, hidden=3)
    data = [(rng.random((n, html_blocks.DIM)).astype(np.float32), (rng.random(n) > 0.5).astype(np.float32)) for n in (4, 2)]
    x, y, mask = html_blocks.pad(data)

    def loss():
        z = net.logits(x, mask)[0].astype(np.float64)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    g = net.gradients(x, y, mask)
    for name in ("Uf", "Ub", "Wf", "cb", "V"):
        at = tuple(int(rng.integers(s)) for s in net.p[name].shape)
        old, e = net.p[name][at], 1e-2
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_blocks_of_broken_markup():
    texts = lambda h: [b.text for b in html_blocks.blocks_of(h)]
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert texts("<p>x &lt;y&gt; <i>z</i></p></div>q") == ["x <y> z", "q"]
    assert texts("<script>a<p>b</script>t<style>s") == ["t"]
    assert texts("<p title='a>b'>k</p><!-- c <p>d") == ["k"]
    assert texts("<p a>x<!-->y<!-- z --!>w</p>") == ["xyw"]


def test_blocks_of_left_out_tags_and_quotes():
    texts = lambda h: [b.text for b in html_blocks.blocks_of(h)]
    assert texts("<html><head><meta charset=u><title>T</title><article><h1>Head</h1><p>One.</p></article>") == ["Head", "One."]
    assert texts("<head><title>T</title> words <p>y") == ["words", "y"]
    assert texts("<title>T</title>hello") == ["hello"]
    assert texts('<p class="x>Hello world.</p>') == ["Hello world."]
    assert texts('<p class="x>Hello</p><p class="y">b</p>') == ["Hello", "b"]
    assert texts('<p class="x>he said "no" twice</p>') == ['he said "no" twice']
    assert texts('<p data-h="<b>x</b>">k</p><a href=/x/>l</a>') == ["k", "l"]
    assert texts("<svg><path d='x'><title>t</title><p>a</p>") == ["a"]
    assert texts("<svg><foreignObject><p>in</p></foreignObject></svg>b") == ["b"]
    assert texts("<select><option>u<option>v<p>after</p>") == ["after"]


@pytest.mark.parametrize("piece", ["<div>x</span>", "<div>x", "<b>x<div></div>", "<li><ul><div>", '<p class="x>a', "<p a='x", "<li><b><div></div>", "<svg><p>x",
                                   "<head><p>x", "<!-- <p>", "<select><option>"])
def test_time_on_broken_markup_grows_with_length(piece):
    start = time.process_time()
    html_blocks.blocks_of(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 5


def test_op2_query_over_odd_pages(spark, tmp_path):
    rows = [(k, f"http://x/{k}", page(k)) for k in range(80)] + [(None, None, None), (80, "", ""), (3, "http://x/3", page(3)), (3, "other", page(4)),
                                                                (81, "u", page(81).replace("</head><body>", ""))]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op2_html_extraction"](spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, "" if not h else wanted(4 if u == "other" else i)) for i, u, h in rows]
    found = [(r["page_id"], r["url"], r["text"]) for r in got.collect()]
    assert len(found) == len(want) and len(Counter(found) & Counter(want)) >= len(set(want)) - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_page_sample_is_bounded_and_holds_repeated_pages_once(spark):
    pages = spark.range(3000).select((F.col("id") % 1000).alias("page_id"), F.lit("u").alias("url"),
                                     F.when(F.col("id") < 1000, F.lit("<p>hot")).otherwise(F.concat(F.lit("<p>"), F.col("id"))).alias("html"))
    seen = []
    blocks = html_blocks.blocks_of
    try:
        html_blocks.blocks_of = lambda p: seen.append(p) or blocks(p)
        html_blocks.fit(pages.union(pages), max_pages=40)
    finally:
        html_blocks.blocks_of = blocks
    assert 30 <= len(seen) <= 40


# ------------------------------------------------------------------ decontamination

def leak_fixture(seed=4):
    r = random.Random(seed)
    own = [f"q{a}{b}" for a in "bcdfgh" for b in ("ano", "eli", "imu", "oka", "ura", "yse")]
    item = lambda k: " ".join(r.choice(own) + (str(r.randrange(40)) if r.random() < 0.6 else "") for _ in range(18 + k % 25))
    bench = [(k, item(k) + ". the answer is " + item(0)[:20] + ".") for k in range(40)]
    rows, want = [], set()
    for i in range(300):
        text = prose(i, 150)
        if i % 5 == 0:
            k = r.randrange(40)
            w = [x if r.random() > (0.2 if i % 10 else 0) else r.choice(("of", "kalana", "risor")) for x in bench[k][1].split()]
            at = r.randrange(100)
            t = text.split()
            text = " ".join(t[:at] + w + t[at:])
            want.add((i, k))
        rows.append((i, text))
    return rows, bench, want


def test_leaks_against_brute_force(docs_of, spark):
    rows, bench, planted = leak_fixture()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(
        docs_of(rows), spark.createDataFrame(bench, "item_id long, text string"), block=25).collect()}
    brute = set()
    for i, t in rows:  # every document against every item, over the whole text
        w = decontaminate.words(t)
        for k, b in bench:
            q = decontaminate.words(b)
            ids = {x: n for n, x in enumerate(dict.fromkeys(q))}
            if decontaminate.lcs(decontaminate.places_of([ids[x] for x in q]), len(q), [ids.get(x, -1) for x in w]) / len(q) >= decontaminate.SHARE:
                brute.add((i, k))
    assert planted >= {p for p in brute if p in planted} and len(brute & planted) >= 0.9 * len(planted)
    assert len(got & brute) >= 0.9 * len(brute)
    assert {i for i, _ in got} <= {i for i, _ in planted}


def test_item_in_a_third_of_all_documents(docs_of, spark):
    _, bench, _ = leak_fixture()
    r = random.Random(6)
    rows, want = [], set()
    for i in range(300):
        t = prose(i, 380).split()
        if i % 3 == 0:  # one item in a third of the documents, every second time with some words replaced
            w = [x if i % 2 or r.random() > 0.15 else "risor" for x in bench[0][1].split()]
            at = r.randrange(300)
            t[at:at] = w
            want.add((i, 0))
        if i % 50 == 1:  # another one in a few
            t[40:40] = bench[7][1].split()
            want.add((i, 7))
        rows.append((i, " ".join(t)))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(
        docs_of(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want


def test_runs_of_words_need_no_weight():
    items = decontaminate.Items([(1, "a b c d e f g"), (2, "a b")])
    index = decontaminate.Index(items, np.full(len(items.vocab), 1e-3, np.float32), np.eye(len(items.vocab), dtype=np.float32))
    cells = decontaminate.Cells(["x " * 21 + "b c d e y", "a b c x d e f", "", "c d e f"], items.vocab)
    assert index.runs(cells) == [(0, 0, int(cells.first[0]) + 1), (3, 0, int(cells.first[3]))]
    assert index.cosine(cells.ids[3], 0, [0]) == pytest.approx(4 / math.sqrt(28), abs=1e-3)


def test_sample_does_not_depend_on_the_order_of_rows(docs_of):
    rows = [(i, prose(i, 400)) for i in range(30)] + [(100, prose(100, 9000)), (101, None)]
    vocab = {w: k for k, w in enumerate(dict.fromkeys(decontaminate.words(prose(5, 500))))}
    one, other = ([tuple(r[0]) for r in decontaminate.sample_passages(docs_of(x, parts=n), vocab, 20).collect()]
                  for x, n in ((rows, 2), (rows[::-1], 5)))
    assert sorted(one) == sorted(other) and 300 < len(one) < 500
    long = {tuple(p) for p in decontaminate.Cells([rows[30][1]], vocab).passages().tolist()}
    assert 0.25 < sum(p in long for p in one) / len(one) < 0.6  # 562 of 1282 passages


def test_latent_space_is_fitted_to_all_passages(docs_of, monkeypatch):
    rows = [(i, prose(i, 3 + 13 * i)) for i in range(40)] + [(90, None), (91, "unlisted words only"), (5, prose(5, 68))]
    items = decontaminate.Items([(1, prose(50, 60)), (2, prose(51, 20) + " " + prose(52, 20))])
    size = len(items.vocab)
    weight = np.linspace(0.1, 2, size).astype(np.float32)
    texts = decontaminate.encoded(docs_of(rows), items.vocab)
    p = decontaminate.Cells([t or "" for _, t in rows], items.vocab).passages()
    a = np.zeros((len(p), size))
    for r, ids in zip(a, p):
        np.add.at(r, ids[ids >= 0], weight[ids[ids >= 0]])
    a /= np.maximum(1e-9, np.linalg.norm(a, axis=1, keepdims=True))
    value, vector = np.linalg.eigh(a.T @ a)
    want = (vector * value) @ vector.T
    for held in (1 << 23, 700):  # in one table, in parts
        monkeypatch.setattr(decontaminate, "TABLE", held)
        monkeypatch.setattr(decontaminate, "PIECE", 300)
        basis = decontaminate.randomised_svd(decontaminate.pair_sums(texts, weight), weight).astype(float)
        assert basis.shape == (size, size)
        got = np.diag(basis.T @ want @ basis)
        assert got == pytest.approx(value[::-1], abs=1e-3)


def test_leaks_odd_rows(docs_of, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (None, "a b c"), (4, prose(2, 30)), (5, prose(2, 30))], "item_id long, text string")
    rows = decontaminate.find_leaks(docs_of(odd_rows() + [(50, prose(9, 20) + " " + prose(2, 30))] * 2), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(50, 4), (50, 5)}
    assert decontaminate.find_leaks(docs_of([]), bench).collect() == []
    assert decontaminate.find_leaks(docs_of(odd_rows()), bench.limit(0)).collect() == []


def test_lcs():
    r = random.Random(1)
    for _ in range(50):
        a, b = [[r.randrange(5) for _ in range(r.randrange(1, 14))] for _ in "ab"]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontaminate.lcs(decontaminate.places_of(a), len(a), b) == d[-1][-1]


# ------------------------------------------------------------------ personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m.group())
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or k == "card" and 13 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def private_rows():
    r = random.Random(8)

    def card():
        stem = f"4{r.randrange(10**14):014d}"
        return next(f"{stem}{x}" for x in range(10) if luhn(f"{stem}{x}"))

    make = (lambda: f"u{r.randrange(99)}.x@mail{r.randrange(9)}.example.com", lambda: ".".join(str(r.randrange(1, 300)) for _ in range(4)),
            card, lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(10**4):04d}", lambda: str(r.randrange(10**r.randrange(1, 19))))
    rows = [(i, prose(i, 12) + " " + r.choice(make)() + " é😀 " + r.choice(make)() + (" " if i % 7 else ", ") + prose(i + 400, 5)) for i in range(400)]
    rows += [(900, "Call +1 (269) 555-3296 " + card() + " now"), (901, "a@b.c.d@e.f x@y a@b.c_d@e.f 1.2..3.4.5.6 1.2.3.4.5.6.7.8"),
             (902, "9" * 20000 + " " + "a" * 20000 + "@" + "b." * 3000 + "c"), (903, "\x01 1\x012 4111 1111 1111 1111-")]
    return rows


def test_base_spans_and_added_ones(docs_of):
    rows = private_rows()
    docs = docs_of(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = pii.train(docs)
    assert "Python" not in (plan := pii.detect(docs, model)._jdf.queryExecution().toString()) and "Arrow" not in plan
    text = dict(rows)
    for r in pii.detect(docs, model).withColumn("clean", pii.redact(F.col("text"), F.col("spans"))).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert got == base(text[r["doc_id"]]), r["doc_id"]
        assert set(got) <= {(s["kind"], s["start"], s["end"]) for s in r["spans"]}
        if r["doc_id"] == 900:
            assert {s["kind"] for s in r["spans"]} >= {"card"} or not got
        if r["doc_id"] < 900 and not r["spans"]:
            assert r["clean"] == text[r["doc_id"]]


def test_pii_odd_rows(docs_of):
    docs = docs_of(odd_rows())
    model = pii.train(docs)
    rows = pii.detect(docs.withColumn("spans", F.lit(1)), model).collect()
    assert len(rows) == len(odd_rows()) and all(r["spans"] == [] for r in rows)
    assert pii.detect(docs_of([]), pii.train(docs_of([]))).collect() == []


# ------------------------------------------------------------------ fingerprints

def test_window_entropies():
    codes = np.random.default_rng(1).integers(97, 110, 700).astype(np.uint8)

    def entropy(w):
        k = np.bincount(w)
        k = k[k > 0] / len(w)
        return -(k * np.log2(k)).sum()

    n, b = fingerprints.WINDOW, fingerprints.BINS
    want = [round(entropy(codes[i:i + n]) * (b - 1) / np.log2(n)) for i in range(len(codes) - n + 1)]
    assert np.abs(fingerprints.window_bins(codes) - want).max() <= 1


def test_digests_do_not_depend_on_neighbours(monkeypatch):
    rank = fingerprints.rarity_rank(np.random.default_rng(2).integers(0, 99, fingerprints.BINS))
    texts = ["", "short", prose(1, 40), prose(2, 800), "z" * 4000, prose(3, 3000)]
    together = fingerprints.digests(texts, rank)
    assert together == [fingerprints.digests([t], rank)[0] for t in texts]
    monkeypatch.setattr(fingerprints, "CHUNK", 300)
    assert together == fingerprints.digests(texts, rank)


def test_likeness():
    rank = fingerprints.rarity_rank(np.arange(fingerprints.BINS))
    a, b = prose(10, 600), prose(11, 600)
    half = a[:len(a) // 2] + b[:len(a) // 2]
    x, y, z = fingerprints.digests([a, b, half], rank)
    assert fingerprints.likeness(x, x) == 1 and fingerprints.likeness(x, y) < 0.15 < 0.3 < fingerprints.likeness(x, z) < 0.8
    assert fingerprints.likeness(x, None) is None


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_row(docs_of, parts):
    rows = [(i * 7 % 101, f"t{i}") for i in range(60)] + [(None, "n"), (500, ""), (500, "x")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["nx"]) for r in
                 fingerprints.with_next(docs_of(rows), "doc_id", "text", "nx", parts).collect())
    order = sorted((i if i is not None else -1, t) for i, t in rows)
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    ties = {500}  # rows of one id: the next is another of the id or the first of the next id
    assert [g for g in got if g[0] not in ties] == [w for w in want if w[0] not in ties]
    assert len(got) == len(want)
    assert fingerprints.with_next(docs_of([]), "doc_id", "text", "nx", parts).collect() == []


def test_edited_text(docs_of):
    df = docs_of([(1, "abcde😀"), (2, "x"), (3, "")]).withColumn("e", fingerprints.edited(F.col("text"), F.lit("12")))
    assert {r["doc_id"]: r["e"] for r in df.collect()} == {1: "abc12", 2: "x", 3: ""}
