"""Categorization (C0-C5): memory lookup -> fuzzy argmax -> first keyword rule -> default.

Plan shape (per call):
  rows -> distinct descriptions                       [partial + final hash aggregate]
       -> keys (merchant F1, description key F2, memory key F1(F1)) per description
       -> memory (equi join), fuzzy best per merchant (broadcast rules, prefiltered theta
          join, max(struct) argmax), first keyword per dkey (broadcast rules, instr theta
          join, min_by) -> one resolution table, one row per distinct description
       -> joined back to the rows once on the description.
Rows never meet the rules directly; the per-pair work is done once per distinct value.
AQE turns the join back into a broadcast when the resolution table is small, and splits
hot keys (skew join) when it is not.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.similarity import (
    MAX_BITS, char_bits, chars, common_bound, pattern_code_masks, pattern_masks, score_pairs, token_set,
)
from spendlake.functions.text import description_key, merchant_name
from spendlake.operators.rules import MAX_INLINE_KEYWORDS, keyword_table, rules_frame
from spendlake.session import distinct_spread, spread
from spendlake.schema import CONFIDENCE_KEYWORD, CONFIDENCE_MEMORY, DEFAULT_CATEGORY, FUZZY_THRESHOLD


def _rules_df(df: DataFrame, rules) -> tuple[DataFrame, int, Mapping | None]:
    """(rule table, its row count, the mapping when rules were given inline): the count is
    known without a job for a mapping."""
    if rules is None or isinstance(rules, Mapping):
        from spendlake.operators.rules import DEFAULT_RULES, rule_rows
        return rules_frame(df.sparkSession, rules), len(rule_rows(rules)), (rules or DEFAULT_RULES)
    return rules, rules.count(), None


def add_keys(df: DataFrame, description: str = "description") -> DataFrame:
    """Key columns used by every step: ``_merchant`` (F1), ``_dkey`` (F2), ``_mkey`` (F1 of F1)."""
    return (df.withColumn("_merchant", merchant_name(description))
              .withColumn("_dkey", description_key(description))
              .withColumn("_mkey", merchant_name("_merchant")))


def prepared_keywords(rules: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Keyword side of the fuzzy join, with tokens, joined text and LCS masks precomputed."""
    kw = keyword_table(rules)
    text = F.lower("keyword") if case_insensitive else F.col("keyword")
    return (kw.withColumn("k_tokens", token_set(text))
              .withColumn("k_join", F.array_join("k_tokens", " "))
              .withColumn("k_len", F.length("k_join"))
              .withColumn("k_bits", char_bits("k_join"))
              .withColumn("k_masks", F.when(F.col("k_len") <= MAX_BITS, pattern_masks("k_join")))
              .withColumn("k_codes", F.when(F.col("k_len") <= MAX_BITS, pattern_code_masks("k_join"))))


def fuzzy_best(merchants: DataFrame, rules: DataFrame, threshold: int = FUZZY_THRESHOLD,
               case_insensitive: bool = False, merchant: str = "_merchant",
               n_keywords: int | None = None, spread_input: bool = True) -> DataFrame:
    """C2 on distinct merchants: best keyword by token-set ratio, earliest keyword on ties,
    accepted when ratio >= threshold (and > 0). Returns (merchant, fuzzy_category,
    fuzzy_confidence) for accepted merchants only."""
    text = F.lower(merchant) if case_insensitive else F.col(merchant)
    # (no filter on empty merchants here: it would be pushed below the aggregates to the
    # scan; an empty merchant has no tokens, scores 0 and is never accepted)
    m = merchants.select(merchant)
    m = ((spread(m) if spread_input else m).withColumn("m_tokens", token_set(text))
         .withColumn("m_join", F.array_join("m_tokens", " ")))
    # characters of the token string, split once per merchant (the LCS text whenever the
    # merchant and keyword share no token)
    m = m.select("*", F.length("m_join").alias("m_len"), chars("m_join").alias("m_chars"),
                 char_bits("m_join").alias("m_bits")).drop("m_join")
    m = m.withColumn("m_codes", F.transform("m_chars", lambda ch: F.ascii(ch)))
    pairs = candidate_pairs(m, prepared_keywords(rules, case_insensitive), threshold, merchant, n_keywords)
    pairs = score_pairs(pairs.select(merchant, "ord", "category", "m_tokens", "m_chars", "m_codes",
                                     "k_tokens", "k_join", "k_masks", "k_codes"),
                        "m_tokens", "k_tokens", "k_join", "k_masks", a_chars="m_chars",
                        a_codes="m_codes", b_code_masks="k_codes")
    # argmax first, threshold after: acceptance depends only on the best score, so this is
    # the same result, and a filter on the aggregate cannot be pushed into the join (where
    # Catalyst would evaluate the whole score for every pair before the cheap prefilter)
    scored = pairs.select(merchant, "ord", "category", (F.col("score") / 100.0).alias("conf"))
    best = scored.groupBy(merchant).agg(
        F.max(F.struct("conf", (-F.col("ord")).alias("neg_ord"), "category")).alias("b"))
    best = best.where((F.col("b.conf") > 0) & (F.col("b.conf") * 100 >= threshold))
    return best.select(merchant, F.col("b.category").alias("fuzzy_category"),
                       F.col("b.conf").alias("fuzzy_confidence"))


def candidate_pairs(m: DataFrame, kw: DataFrame, threshold: int, merchant: str = "_merchant",
                    n_keywords: int | None = None) -> DataFrame:
    """(merchant, keyword) pairs that can reach the threshold, without a nested loop, in two steps.

    1. One equi-join on probe keys: a merchant probes with its token-string length and each
       of its tokens; a keyword is listed under every length inside its reachable band
       [k*t/(2-t), k*(2-t)/t] and under each of its tokens (a shared token is the only way to
       score high outside the band). At threshold 0 any positive score counts, which needs a
       shared character: merchant and keyword probe with their characters.
    2. The bound on the common characters (``common_bound``): without a shared token the score
       is 200 * LCS / (|x| + |y|), so pairs whose common multiset is too small go before
       anything of them is scored.

    A pair found twice is scored twice; the per-merchant max does not care. The probe table is
    broadcast under a bound on its own rows, the keywords' attributes under one on keywords."""
    if threshold > 0:
        t = threshold / 100.0
        lo = F.greatest(F.ceil(F.col("k_len") * t / (2.0 - t) - 1e-9).cast("int"), F.lit(1))
        hi = F.greatest(F.floor(F.col("k_len") * (2.0 - t) / t + 1e-9).cast("int"), F.lit(1))
        lens = F.transform(F.sequence(lo, hi), lambda n: F.concat(F.lit("L"), n.cast("string")))
        listed = F.concat(lens, F.transform("k_tokens", lambda x: F.concat(F.lit("T"), x)))
        probes = F.concat(F.array(F.concat(F.lit("L"), F.col("m_len").cast("string"))),
                          F.transform("m_tokens", lambda x: F.concat(F.lit("T"), x)))
    else:
        listed, probes = chars("k_join"), F.col("m_chars")
    listed = kw.select("ord", F.array_distinct(listed).alias("_listed"))
    used = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_listed")), F.lit(0)).alias("probes")).first()
    probes_kw, attrs = listed.select(F.explode("_listed").alias("_probe"), "ord"), kw
    if used.probes <= MAX_BROADCAST_PROBES:
        probes_kw = F.broadcast(probes_kw)
    if used.n <= MAX_INLINE_KEYWORDS:
        attrs = F.broadcast(attrs)
    found = m.withColumn("_probe", F.explode(F.array_distinct(probes))).join(probes_kw, "_probe").drop("_probe")
    if threshold <= 0:  # pairs share many characters: each is scored once
        found = found.dropDuplicates([merchant, "ord"])
    enough = F.lit(200.0) * common_bound("m_bits", "k_bits") >= F.lit(float(threshold)) * (F.col("m_len") + F.col("k_len")) - 1e-6
    keep = enough | F.arrays_overlap("m_tokens", "k_tokens")
    return found.join(attrs, "ord").where(keep)


def grams(text, size: int) -> Column:
    """All substrings of ``size`` characters (0: the empty one)."""
    if size == 0:
        return F.array(F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


#: Lengths of the substrings that keywords are listed under.
GRAMS = (4, 8, 16, 32)

#: Characters of keywords and categories whose index is broadcast: it has as many substrings at most.
MAX_BROADCAST_CHARS = 100_000

#: 64-bit words of the bitmap of indexed substrings, a power of two: some MB whatever the number of keywords.
BITMAP_WORDS = 1 << 18


def keyword_pairs(dkeys: DataFrame, rules: DataFrame, dkey: str = "_dkey", spread_input: bool = True) -> DataFrame:
    """(dkey, keyword, k_ord, k_cat) pairs among which are all whose keyword is a substring of the key.

    Every keyword is listed under the one of its substrings that occurs in the fewest keys, these being as long as
    the largest of ``GRAMS`` that fits (a shorter keyword under itself): short substrings of long keywords would be
    shared by ever more keys and keywords as both grow. Keys meet keywords by an equi-join of the hashes of their
    distinct substrings with this index. A keyword none of whose substrings occurs anywhere drops out before the join.

    Spark takes a table of substrings to have as many rows as there are keys or keywords, and would broadcast that of
    the keys through the driver. So the joins are told what to do: the keywords' side is broadcast under a bound on its
    characters. Beyond it they are merge joins, which split a substring that many keys have; before the last one a bitmap
    of a fixed size drops most of the keys' substrings that the index lacks."""
    size = F.length("keyword")
    for n in GRAMS:
        size = F.when(F.length("keyword") >= n, F.lit(n)).otherwise(size)
    kw = (rules.where("keyword is not null").groupBy("keyword")  # the filter that a join adds: both uses of the index below are one plan
          .agg(F.min("ord").alias("k_ord"), F.min_by("category", "ord").alias("k_cat")).withColumn("_size", size))
    text = F.length("keyword") + F.coalesce(F.length("k_cat"), F.lit(0)) + 1
    used = kw.groupBy("_size").agg(F.sum(text).alias("chars")).collect()  # at most GRAMS[0] + len(GRAMS) rows
    sizes, few = sorted(r._size for r in used), sum(r.chars for r in used) <= MAX_BROADCAST_CHARS
    if not sizes:
        return dkeys.select(dkey).crossJoin(kw.drop("_size").limit(0))
    own = F.array("keyword")
    for n in GRAMS:
        own = F.when(F.col("_size") == n, grams(F.col("keyword"), n)).otherwise(own)
    d = dkeys.select(dkey)
    d = spread(d) if spread_input else d
    hashed = F.xxhash64("_gram").alias("_gram")
    listed = kw.select("keyword", "k_ord", "k_cat", F.explode(F.array_distinct(own)).alias("_gram")).select("keyword", "k_ord", "k_cat", hashed)
    held = d.select(dkey, F.explode(F.array_distinct(F.concat(*[grams(F.col(dkey), n) for n in sizes]))).alias("_gram")).select(dkey, hashed)
    how = "broadcast" if few else "merge"
    common = held.groupBy("_gram").agg(F.count("*").alias("_keys")).join(listed.select("_gram").distinct().hint(how), "_gram", "left_semi")
    index = (listed.join(common.hint(how), "_gram").groupBy("keyword", "k_ord", "k_cat")
             .agg(F.min(F.struct("_keys", "_gram")).alias("_rarest"))
             .select("keyword", "k_ord", "k_cat", F.col("_rarest._gram").alias("_gram")))
    if few:
        return held.join(index.hint(how), "_gram").drop("_gram")
    word, bit = F.expr(f"shiftrightunsigned(_gram, 6) & {BITMAP_WORDS - 1}L"), F.expr("shiftleft(1L, cast(_gram & 63 AS int))")
    bitmap = index.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = held.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return held.select(dkey, "_gram").join(index.hint(how), "_gram").drop("_gram")


def keyword_first(dkeys: DataFrame, rules: DataFrame, dkey: str = "_dkey", spread_input: bool = True) -> DataFrame:
    """C3 on distinct description keys: category of the first rule (in order) whose keyword
    is a substring, for any number of rules. Returns (dkey, keyword_category) for matched keys only.
    Of the ``keyword_pairs``, ``contains`` decides and the smallest order wins."""
    hits = keyword_pairs(dkeys, rules, dkey, spread_input).where(F.contains(F.col(dkey), F.col("keyword")))
    return hits.groupBy(dkey).agg(F.min_by("k_cat", "k_ord").alias("keyword_category"))


def keyword_case(dkey, rules: Mapping[str, Sequence[str]] | None = None) -> Column:
    """C3 for an inline rule mapping as one generated CASE chain (no join, no shuffle). For
    mappings of up to some hundred keywords; ``keyword_first`` takes any number."""
    from spendlake.operators.rules import rule_rows, sql_string
    rows = rule_rows(rules)
    if isinstance(dkey, str) and rows:
        # one SQL CASE parsed in the JVM (the column is referenced by name)
        col = "`" + dkey.replace("`", "``") + "`"
        whens = " ".join(f"WHEN instr({col}, {sql_string(kw)}) > 0 THEN {sql_string(cat)}" for _, cat, kw in rows)
        return F.expr(f"CASE {whens} END")
    d = F.col(dkey) if isinstance(dkey, str) else dkey
    expr = None
    for _, cat, kw in rows:
        cond = F.instr(d, F.lit(kw)) > 0
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr if expr is not None else F.lit(None).cast("string")


MAX_BROADCAST_PROBES = 500_000   # (probe key, keyword id) rows of some tens of bytes
LABELS = ("category", "confidence", "matched_by")


def _memory_hits(memory: DataFrame | None, spark) -> DataFrame:
    """Valid memory entries (non-empty category), one per key."""
    if memory is None:
        return spark.range(0).select(F.lit(None).cast("string").alias("_mkey"),
                                     F.lit(None).cast("string").alias("memory_category"))
    return (memory.where(F.col("category").isNotNull() & (F.col("category") != ""))
            .groupBy(F.col("merchant").alias("_mkey"))
            .agg(F.max("category").alias("memory_category")))


def resolve(descs: DataFrame, rules: DataFrame, memory: DataFrame | None,
            threshold: int, case_insensitive: bool, description: str = "description",
            n_keywords: int | None = None, rules_map: Mapping | None = None) -> DataFrame:
    """Resolution table over distinct descriptions: keys, memory, fuzzy and keyword
    results. Every per-text cost (F1/F2, similarity, substring rules) is paid once per
    distinct description, never per row."""
    spark = descs.sparkSession
    # Spread + barrier: without the repartition Catalyst folds "distinct merchants of
    # distinct descriptions" into one aggregate over the rows (RemoveRedundantAggregates)
    # and evaluates F1 per row; the shuffle moves only the distinct-description table.
    keyed = add_keys(spread(descs), description)
    mem = _memory_hits(memory, spark)
    keyed = keyed.join(mem, "_mkey", "left")
    # short-circuit: only merchants / keys without a memory hit are scored
    open_ = keyed.where(F.col("memory_category").isNull())
    fz = fuzzy_best(distinct_spread(open_, "_merchant"), rules, threshold, case_insensitive,
                    n_keywords=n_keywords, spread_input=False)
    out = keyed.join(fz, "_merchant", "left")
    if rules_map is not None and n_keywords is not None and n_keywords <= MAX_INLINE_KEYWORDS:
        # inline rules: one generated CASE on the (already distinct) descriptions, no join
        return out.withColumn("keyword_category", F.when(F.col("memory_category").isNull(),
                                                         keyword_case("_dkey", rules_map)))
    kw = keyword_first(distinct_spread(open_, "_dkey"), rules, spread_input=False)
    return out.join(kw, "_dkey", "left")


def _label_columns():
    category = (F.when(F.col("memory_category").isNotNull(), F.col("memory_category"))
                .when(F.col("fuzzy_category").isNotNull(), F.col("fuzzy_category"))
                .when(F.col("keyword_category").isNotNull(), F.col("keyword_category"))
                .otherwise(F.lit(DEFAULT_CATEGORY)))
    confidence = (F.when(F.col("memory_category").isNotNull(), F.lit(CONFIDENCE_MEMORY))
                  .when(F.col("fuzzy_category").isNotNull(), F.col("fuzzy_confidence"))
                  .when(F.col("keyword_category").isNotNull(), F.lit(CONFIDENCE_KEYWORD))
                  .otherwise(F.lit(0.0)))
    matched = (F.when(F.col("memory_category").isNotNull(), F.lit("memory"))
               .when(F.col("fuzzy_category").isNotNull(), F.lit("fuzzy"))
               .when(F.col("keyword_category").isNotNull(), F.lit("keyword"))
               .otherwise(F.lit("default")))
    return category, confidence, matched


def categorize(df: DataFrame, rules=None, memory: DataFrame | None = None,
               threshold: int = FUZZY_THRESHOLD, description: str = "description",
               case_insensitive: bool = False) -> DataFrame:
    """Label every row: adds ``category``, ``confidence``, ``matched_by``.

    ``rules``: None (defaults), a mapping category -> keywords, or an (ord, category,
    keyword) DataFrame. ``memory``: (merchant, category) DataFrame of learned merchants.
    Plan: distinct descriptions (partial + final hash aggregate) -> resolution -> one
    join back on the description.
    """
    rules, n_kw, rules_map = _rules_df(df, rules)
    df = df.drop(*LABELS)  # re-labeling replaces earlier labels
    descs = df.select(description).where(F.col(description).isNotNull()).distinct()
    res = resolve(descs, rules, memory, threshold, case_insensitive, description, n_kw, rules_map)
    category, confidence, matched = _label_columns()
    res = res.select(description, category.alias("category"), confidence.alias("confidence"),
                     matched.alias("matched_by"))
    out = df.join(res, description, "left")
    guard = F.coalesce(F.col(description), F.lit("")) == ""
    return out.select(*df.columns,
                      F.when(guard, F.lit(DEFAULT_CATEGORY)).otherwise(F.col("category")).alias("category"),
                      F.when(guard, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
                      F.when(guard, F.lit("default")).otherwise(F.col("matched_by")).alias("matched_by"))


def categorize_learn(df: DataFrame, order: str, rules=None, memory: DataFrame | None = None,
                     threshold: int = FUZZY_THRESHOLD, description: str = "description",
                     case_insensitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Categorize with learning, as if rows were processed one by one in ``order``.

    After a fuzzy/keyword hit the merchant is remembered, so every later row with the same
    memory key is a memory hit (0.95) with the first row's category. Set-based form:
      rows -> per description: min(order)             [one hash aggregate over the rows]
      descriptions -> resolution -> own result (fuzzy or keyword, when no memory hit)
      per memory key: the (min order, own) of its earliest description   [small]
      rows join back on description; a row is a learned hit when the key's first order
      is before its own order.
    No per-key window: a merchant holding a third of all rows is combined map-side.
    Returns (labeled rows, new memory).
    """
    rules, n_kw, rules_map = _rules_df(df, rules)
    df = df.drop(*LABELS)  # re-labeling replaces earlier labels
    descs = (df.where(F.col(description).isNotNull() & (F.col(description) != ""))
             .groupBy(description).agg(F.min(order).alias("_first_seq")))
    res = resolve(descs, rules, memory, threshold, case_insensitive, description, n_kw, rules_map)
    own = (F.when(F.col("memory_category").isNull(),
                  F.coalesce(F.col("fuzzy_category"), F.col("keyword_category"))))
    res = res.withColumn("_own", own)
    first = (res.where(F.col("_own").isNotNull() & (F.col("_mkey") != ""))
             .groupBy("_mkey")
             .agg(F.min(F.struct(F.col("_first_seq").alias("seq"), F.col("_own").alias("cat"))).alias("f")))
    category, confidence, matched = _label_columns()
    res = (res.join(first, "_mkey", "left")
           .select(description, category.alias("_c"), confidence.alias("_p"), matched.alias("_m"),
                   F.col("f.seq").alias("_fseq"), F.col("f.cat").alias("_fcat")))
    lab = df.join(res, description, "left")
    learned = F.col("_fseq") < F.col(order)
    guard = F.coalesce(F.col(description), F.lit("")) == ""
    out = lab.select(
        *df.columns,
        F.when(guard, F.lit(DEFAULT_CATEGORY)).when(learned, F.col("_fcat")).otherwise(F.col("_c")).alias("category"),
        F.when(guard, F.lit(0.0)).when(learned, F.lit(CONFIDENCE_MEMORY)).otherwise(F.col("_p")).alias("confidence"),
        F.when(guard, F.lit("default")).when(learned, F.lit("memory")).otherwise(F.col("_m")).alias("matched_by"))
    new_mem = first.select(F.col("_mkey").alias("merchant"), F.col("f.cat").alias("category"))
    if memory is not None:
        kept = memory.join(new_mem.select("merchant"), "merchant", "left_anti")
        new_mem = kept.select("merchant", "category").unionByName(new_mem)
    return out, new_mem
