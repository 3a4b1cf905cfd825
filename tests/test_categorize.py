"""Categorizer cases from the reference tests and worked fixtures, plus property
tests of the fuzzy score and of learning against small sequential Python models."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlake.functions import similarity as S
from spendlake.operators import categorize as C
from spendlake.operators import memory as M
from spendlake.operators import rules as R


def label(spark, descs, rules=None, memory=None, threshold=80):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(descs)], "id long, description string")
    out = C.categorize(df, rules, memory, threshold).orderBy("id").collect()
    return [(r.category, round(r.confidence, 7)) for r in out]


def test_reference_examples(spark):
    got = label(spark, ["COSTCO WHOLESALE #123", "STARBUCKS COFFEE #456", "ROGERS INTERNET SERVICES",
                        "UNKNOWN MERCHANT XYZ", "", None])
    assert got[0][0] == "Groceries" and got[0][1] > 0
    assert got[1][0] == "Dining" and got[1][1] > 0
    assert got[2][0] == "Utilities" and got[2][1] > 0
    assert got[3:] == [("Uncategorized", 0.0)] * 3


@pytest.mark.parametrize("desc,cat,conf", [
    ("STARBUCKS", "Dining", 0.8888889), ("TIM HORTONS #4432", "Dining", 0.8181818),
    ("tim hortons 4432", "Dining", 0.5), ("COFFEE", "Dining", 0.8333333), ("MARKET", "Groceries", 0.8333333),
    ("COMPASS CARD", "Transport", 0.8333333), ("EVOLVE STRENGTH POST", "Fitness", 0.85),
    ("THE BLARNEY STONE", "Avoidable Expenses", 0.8235294), ("UBER", "Transport", 0.5),
    ("UBER EATS", "Dining", 0.5), ("E-TRANSFER SENT", "Transfer", 0.5), ("PAYROLL DEPOSIT", "Salary", 0.5),
    ("TORRENT CO", "Rent", 0.5), ("BUSINESS LUNCH", "Transport", 0.5), ("STARBUX COFFE", "Uncategorized", 0.0),
    ("PETCO #123", "Uncategorized", 0.0), ("Café", "Uncategorized", 0.0),
])
def test_worked_fixtures(spark, desc, cat, conf):
    assert label(spark, [desc]) == [(cat, conf)]


def test_memory_wins(spark):
    mem = M.learn_batch(M.empty_memory(spark),
                        spark.createDataFrame([("STARBUCKS", "Coffee", 1)], "merchant string, category string, v int"), version="v")
    assert label(spark, ["STARBUCKS"], memory=mem) == [("Coffee", 0.95)]


def test_added_rule(spark):
    rules = R.extend_rules(R.rules_frame(spark), "Pet Store", ["petco", "petsmart"])
    assert label(spark, ["PETCO #123"], rules=rules)[0][0] == "Pet Store"
    last = rules.orderBy(F.col("ord").desc()).first()
    assert (last.category, last.keyword) == ("Pet Store", "petsmart")


def test_extend_existing_category_keeps_position(spark):
    rules = R.extend_rules(R.rules_frame(spark), "Rent", ["rent", "strata"])
    rows = rules.orderBy("ord").collect()
    rent = [r.keyword for r in rows if r.category == "Rent"]
    assert rent == ["rent", "lease", "landlord", "strata"]
    assert [r.ord for r in rows] == list(range(len(rows)))


def test_memory_size_membership_roundtrip(spark, tmp_path):
    pairs = spark.createDataFrame([("TIM HORTONS #1", "Dining", 1), ("tim hortons", "Coffee", 2), ("", "X", 3)],
                                  "merchant string, category string, v int")
    mem = M.learn_batch(M.empty_memory(spark), pairs, version="v")
    assert M.size(mem) == 1 and mem.first().category == "Coffee"
    probe = spark.createDataFrame([("Tim Hortons",), ("Other",)], "merchant string")
    assert [r.merchant for r in M.has_merchant(mem, probe).collect()] == ["Tim Hortons"]
    for fmt in ("json", "json_object", "parquet"):
        p = str(tmp_path / fmt)
        M.save(mem, p, fmt)
        assert sorted(map(tuple, M.load(spark, p, fmt).collect())) == [("Tim Hortons", "Coffee")]
    assert M.load(spark, str(tmp_path / "missing")).count() == 0


# ----------------------------------------------------------------- property tests

def py_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ch in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ch == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def py_token_set_ratio(s1, s2):
    a, b = set(s1.split()), set(s2.split())
    if not a or not b:
        return 0.0
    inter, x_set, y_set = a & b, a - b, b - a
    if inter and (not x_set or not y_set):
        return 100.0
    x, y = " ".join(sorted(x_set)), " ".join(sorted(y_set))
    s = len(" ".join(sorted(inter)))
    sep = 1 if s else 0
    la, lb = s + sep + len(x), s + sep + len(y)
    r1 = 100.0 - 100.0 * (len(x) + len(y) - 2 * py_lcs(x, y)) / (la + lb)
    if not s:
        return r1
    return max(r1, 100.0 - 100.0 * (sep + len(x)) / (s + la), 100.0 - 100.0 * (sep + len(y)) / (s + lb))


def test_token_set_ratio_matches_model(spark):
    rnd = random.Random(7)
    alphabet = "abcAB "
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        b = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        pairs.append((a, b))
    pairs.append(("x" * 70 + " y", "x" * 66 + "z"))  # pattern over 62 chars: DP fallback
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", S.token_set_ratio("a", "b").alias("r"), S.lcs("a", "b").alias("l")).collect()
    for r in got:
        assert r.l == py_lcs(r.a, r.b)
        assert r.r == pytest.approx(py_token_set_ratio(r.a, r.b), abs=1e-9)


def test_learning_matches_sequential_model(spark):
    rules = {"Food": ["pizza", "cafe"], "Car": ["fuel", "pizza cafe"]}
    words = ["PIZZA", "CAFE", "FUEL", "PIZZA CAFE", "PIZZA HUT", "SHELL FUEL", "NOPE", ""]
    rnd = random.Random(3)
    descs = [rnd.choice(words) for _ in range(200)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(descs)], "seq long, description string")
    # row-by-row model: unlearned categorize, then memory of first hits
    base = {r.description: (r.category, r.confidence, r.matched_by)
            for r in C.categorize(df.dropDuplicates(["description"]), rules).collect()}
    from spendlake.functions.text import merchant_name
    keys = {r.d: r.k for r in spark.createDataFrame([(d,) for d in set(descs)], "d string")
            .select("d", merchant_name(merchant_name("d")).alias("k")).collect()}
    memory, expected = {}, []
    for d in descs:
        k = keys[d]
        if d and k in memory:
            expected.append((memory[k], 0.95))
            continue
        cat, conf, how = base[d]
        if how in ("fuzzy", "keyword") and k:
            memory[k] = cat
        expected.append((cat, round(conf, 7)))
    out, mem = C.categorize_learn(df, "seq", rules)
    got = [(r.category, round(r.confidence, 7)) for r in out.orderBy("seq").collect()]
    assert got == expected
    assert dict((r.merchant, r.category) for r in mem.collect()) == memory


def test_equi_candidates_equal_prefilter_and_brute_force(spark):
    """Candidates lie within the length/token bound and hold every pair that reaches the
    threshold; the fuzzy argmax over them equals the argmax over every pair."""
    rnd = random.Random(9)
    words = ["cafe", "Cafe", "pizza", "Pizza", "hut", "gas", "station", "x", "7", "shop", "café", "aaaa", "a a a"]
    merchants = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(300)})
    rules = {"A": ["cafe", "pizza hut", "gas station"], "B": ["7 shop", "x", "aaaaa é"], "C": ["pizza", "station"]}
    m = spark.createDataFrame([(x,) for x in merchants], "_merchant string")
    kw = C.prepared_keywords(R.rules_frame(spark, rules))
    joined = F.array_join("m_tokens", " ")
    mm = m.withColumn("m_tokens", S.token_set("_merchant")).withColumns(
        {"m_len": F.length(joined), "m_chars": S.chars(joined), "m_bits": S.char_bits(joined)})
    for thr in (0, 1, 50, 80, 95, 100):
        equi = {(r._merchant, r.ord) for r in C.candidate_pairs(mm, kw, thr).collect()}
        if thr:
            cond = S.may_reach(F.col("m_len"), F.col("k_len"), F.col("m_tokens"), F.col("k_tokens"), thr)
            assert equi <= {(r._merchant, r.ord) for r in mm.crossJoin(kw).where(cond).collect()}
        ords = {k: min(o for o, _, q in R.rule_rows(rules) if q == k) for _, _, k in R.rule_rows(rules)}
        assert {(x, o) for x in merchants for k, o in ords.items() if py_token_set_ratio(x, k) >= max(thr, 1e-9)} <= equi
        got = {r._merchant: (r.fuzzy_category, round(r.fuzzy_confidence, 9))
               for r in C.fuzzy_best(m, R.rules_frame(spark, rules), thr).collect()}
        kws = {}
        for o, c, k in R.rule_rows(rules):
            kws.setdefault(k, [o, c])[1] = c
        want = {}
        for x in merchants:
            best, cat = 0.0, None
            for k, (o, c) in sorted(kws.items(), key=lambda kv: kv[1][0]):
                sc = py_token_set_ratio(x, k) / 100.0
                if sc > best:
                    best, cat = sc, c
            if cat is not None and best * 100 >= thr:
                want[x] = (cat, round(best, 9))
        assert got == want


def test_common_bound_is_at_least_the_lcs(spark):
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice("aaabbcdez AZ09é~") for _ in range(rnd.randint(0, 40)))
    rows = [(text(), text()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.common_bound(S.char_bits("a"), S.char_bits("b")).alias("bound"))
    for r in df.collect():
        common = sum((Counter(r.a) & Counter(r.b)).values())
        assert r.bound >= common >= py_lcs(r.a, r.b)
        if max(Counter(r.a + r.b).values(), default=0) < 3 and not set(r.a + r.b) & set("é~"):
            assert r.bound == common


def test_long_patterns(spark):
    """F9 with patterns of 63 to 400 characters: several words, carries between them."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("ab cdé") for _ in range(n))
    rows = [(text(rnd.randint(1, 150)), text(n)) for n in (63, 64, 124, 125, 187, 400)]
    rows += [("a" * 130, "a" * 125), (text(90),) * 2, ("", text(70)), (text(70), "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.n for r in df.select(S.lcs_words("a", "b").alias("n")).collect()] == [py_lcs(a, b) for a, b in rows]
    got = df.select(F.round(S.token_set_ratio("a", "b"), 9).alias("s")).collect()
    assert [r.s for r in got] == [round(py_token_set_ratio(a, b), 9) for a, b in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_keyword_index_equals_first_substring(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abc é") for _ in range(n))
    keys = sorted({text(rnd.randint(0, 12)) for _ in range(400)} | {"", "a"})
    rules = [(i, f"c{i % 7}", text(rnd.randint(1, 6))) for i in range(60)]  # short ones, repeated ones, two orders of one keyword
    rules += [(60, "none", "zzzz")] + ([(61, "all", "")] if seed == 2 else [])
    got = C.keyword_first(spark.createDataFrame([(k,) for k in keys], "_dkey string"), spark.createDataFrame(rules, R.RULES))
    want = {k: next((c for _, c, w in rules if w in k), None) for k in keys}
    assert {r._dkey: r.keyword_category for r in got.collect()} == {k: v for k, v in want.items() if v is not None}
    empty = C.keyword_first(spark.createDataFrame([("a",)], "_dkey string"), spark.createDataFrame([], R.RULES))
    assert empty.collect() == []


def test_keyword_index_has_no_nested_loop(spark):
    d = spark.range(100).select(F.concat(F.lit("key "), "id").alias("_dkey"))
    rules = spark.range(3000).select(F.col("id").cast("int").alias("ord"), F.lit("c").alias("category"), F.concat(F.lit("y "), "id").alias("keyword"))
    out = C.keyword_first(d, rules)
    out.collect()
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_number_rows(spark):
    from spendlake.session import number_rows
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("k"))
    assert [(r.k, r.n) for r in number_rows(df, "n", "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert number_rows(df.limit(0), "n", "k").collect() == []


def test_rule_text_with_quotes_and_backslashes(spark):
    rules = {"It's \\ odd": ["joe's", "a\\b", "100%"], "Plain": ["x"]}
    got = [tuple(r) for r in R.rules_frame(spark, rules).orderBy("ord").collect()]
    assert got == R.rule_rows(rules)
    df = spark.createDataFrame([("JOE'S",), ("a\\b c",), ("100% sure",)], "d string")
    df = df.withColumn("k", F.lower("d"))
    cats = [r.c for r in df.select(C.keyword_case("k", rules).alias("c")).collect()]
    assert cats == ["It's \\ odd"] * 3


def test_relabeling_replaces_labels(spark):
    df = spark.createDataFrame([(1, "STARBUCKS")], "id long, description string")
    once = C.categorize(df)
    twice = C.categorize(once, {"Coffee": ["starbucks"]})
    assert twice.columns == ["id", "description", "category", "confidence", "matched_by"]
    assert twice.first().category == "Coffee"


def test_threshold_zero_matches_brute_force(spark):
    merchants = ["Cafe", "Zzz", "Pizza Hut", "Qq", "Gas"]
    rules = {"A": ["cafe", "pizza hut"], "B": ["gas"]}
    m = spark.createDataFrame([(x,) for x in merchants], "_merchant string")
    got = {r._merchant: r.fuzzy_category for r in C.fuzzy_best(m, R.rules_frame(spark, rules), 0).collect()}
    want = {}
    for x in merchants:
        best, cat = 0.0, None
        for o, c, k in R.rule_rows(rules):
            sc = py_token_set_ratio(x, k)
            if sc > best:
                best, cat = sc, c
        if cat is not None:
            want[x] = cat
    assert got == want


def test_keywords_of_all_lengths_against_brute_force(spark):
    text = "the quick brown fox 0123456789 jumps over a lazy dog and runs on"
    keys = [text, text[3:40], text[10:], "fox", "", "qu", "01234567 89"]
    rules = [(k, f"c{k}", w) for k, w in enumerate(
        [text[a:a + n] for n in (33, 32, 31, 17, 16, 15, 9, 8, 7, 5, 4, 3, 2, 1) for a in (0, 5, 22)] + ["zzzz", "fox 1", None])]
    got = dict(C.keyword_first(spark.createDataFrame([(k,) for k in keys], "_dkey string"),
                               spark.createDataFrame(rules, "ord int, category string, keyword string")).collect())
    want = {k: next((c for _, c, w in rules if w is not None and w in k), None) for k in keys}
    assert got == {k: c for k, c in want.items() if c is not None}
    assert C.keyword_first(spark.createDataFrame([("a",)], "_dkey string"), spark.createDataFrame([], "ord int, category string, keyword string")).collect() == []


def test_keyword_pairs_grow_with_the_input(spark):
    def pairs(n):  # every keyword shares its short substrings with many keys
        keys = spark.range(n).selectExpr("concat('large anvil ', 10000 + id) AS _dkey")
        rules = spark.range(n).selectExpr("cast(id AS int) AS ord", "'c' AS category", "concat('large anvil ', 10000 + id) AS keyword")
        return C.keyword_pairs(keys, rules).count()
    assert pairs(4000) <= 5 * pairs(1000)


def broadcast_rows(df):
    """Rows of each table that was broadcast for ``df``."""
    def walk(p):
        name = p.nodeName()
        if name == "BroadcastExchange":
            yield p.metrics().apply("numOutputRows").value()
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
        for kid in kids:
            yield from walk(kid)
    df.collect()
    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("chars", [0, 100_000])  # of keywords, beyond which their index is not broadcast
def test_many_keywords_are_met_without_broadcasting_substrings(spark, monkeypatch, chars):
    monkeypatch.setattr(C, "MAX_BROADCAST_CHARS", chars, raising=False)
    keys = spark.range(3000).selectExpr("concat('large anvil ', 10000 + id) AS _dkey")
    rules = spark.range(1500).selectExpr("cast(id AS int) AS ord", "concat('c', id) AS category", "concat('anvil ', 10000 + 2 * id) AS keyword")
    out = C.keyword_first(keys, rules)
    assert {r._dkey: r.keyword_category for r in out.collect()} == {f"large anvil {10000 + 2 * i}": f"c{i}" for i in range(1500)}
    rows = broadcast_rows(C.keyword_first(keys, rules))
    assert max(rows, default=0) <= (2000 if chars else 1500)  # the keys have some 30 000 substrings, the keywords 1 833


@pytest.fixture(scope="module")
def purchases(spark, tmp_path_factory):
    """A folder with lineitem and part of 2 000 descriptions, some in two rows, and (key, line, description) of its rows."""
    names = [f"{c} {n}" for c in ("small", "large", "hot", "cold", "red", "blue", "new", "odd") for n in ("ring", "bolt", "plate", "gizmo", "rod")]
    lines = [(k, i, p, s) for k, (p, s) in enumerate((p, s) for p in range(40) for s in range(10_000, 10_050)) for i in range(1 + k % 2)]
    path = str(tmp_path_factory.mktemp("purchases"))
    spark.createDataFrame([*enumerate(names)], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(*x, 1.0, "A", None) for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                          "l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return path, [(k, i, f"{names[p]} #{s}") for k, i, p, s in lines]


def test_replaced_rules_are_met_without_broadcasting_substrings(spark, purchases):
    from spendlake.plans import catalog_io
    path, rows = purchases
    got = {(r.l_orderkey, r.l_linenumber): r.category for r in catalog_io.rules_replace(spark, path).collect()}
    assert got == {(k, i): "Round" if "ring" in d else "Has L" if "l" in d else "Uncategorized" for k, i, d in rows}
    assert max(broadcast_rows(catalog_io.rules_replace(spark, path)), default=0) <= 2000  # labels of keys; the keys have some 46 000 substrings


def test_joined_rules_are_met_without_broadcasting_substrings(spark, purchases):
    from spendlake.plans import catalog
    from spendlake.plans.views import RULES_P
    path, rows = purchases
    first = lambda d: next((c for _, c, k in R.rule_rows(RULES_P) if k in d), "Uncategorized")
    got = {(r.l_orderkey, r.l_linenumber): (r.description, r.category) for r in catalog.keyword_category_join(spark, path).collect()}
    assert got == {(k, i): (d, first(d.replace("#", ""))) for k, i, d in rows}
    assert max(broadcast_rows(catalog.keyword_category_join(spark, path)), default=0) <= 2000  # labels of keys
