"""Token-set similarity (F9) as native Column expressions.

Score of two strings a, b (0..100), the published token-set ratio:
  A, B = whitespace token sets; either empty -> 0. I = A & B, X = A - B, Y = B - A.
  I non-empty and (X or Y empty) -> 100.
  x, y = sorted X, Y joined by a space; s = len(join(I)); sep = 1 if s else 0.
  la = s + sep + |x|, lb = s + sep + |y|.
  r1 = 100 - 100 * indel(x, y) / (la + lb), indel = |x| + |y| - 2 * LCS(x, y).
  s = 0 -> r1, else max(r1, 100 - 100*(sep+|x|)/(s+la), 100 - 100*(sep+|y|)/(s+lb)).

The LCS is the bit-parallel algorithm (Allison-Dix / Crochemore et al. 2001 / Hyyro 2004)
written as an ``aggregate`` over the characters of one string with a 64-bit state, so it
runs inside the JVM. Character masks of the pattern are computed once per keyword
(``pattern_masks``), the small side of every join. Longer patterns take several words per
state (``lcs_words``); there is no Python in the plan.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = 62  # pattern length that fits a signed 64-bit state without overflow


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bit(j) -> Column:
    """1L << j for a Column j."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _col(j))


def token_set(c) -> Column:
    """Sorted distinct whitespace tokens (``sorted(set(s.split()))``)."""
    toks = F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+")
    return F.sort_array(F.array_distinct(F.filter(toks, lambda t: t != "")))


def chars(c) -> Column:
    """The characters of a string as an array (empty string -> empty array)."""
    s = _col(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def pattern_masks(c) -> Column:
    """map<char, bigint>: bit j set where the pattern has that char at position j."""
    s = _col(c)
    cs = F.array_distinct(chars(s))
    n = F.length(s)

    def mask(ch):
        return F.aggregate(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"),
            lambda acc, j: acc.bitwiseOR(F.when(F.substring(s, j + 1, 1) == ch, _bit(j))
                                         .otherwise(F.lit(0).cast("long"))))
    return F.map_from_arrays(cs, F.transform(cs, mask))


ASCII = r"^[\x00-\x7F]*$"


def pattern_code_masks(c) -> Column:
    """For an ASCII pattern: array of 128 bigints, entry ``code + 1`` = positions of that
    character (an O(1) lookup per step instead of a map scan). Null for other patterns."""
    s = _col(c)
    n = F.length(s)

    def mask(code):
        return F.aggregate(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"),
            lambda acc, j: acc.bitwiseOR(F.when(F.ascii(F.substring(s, j + 1, 1)) == code, _bit(j))
                                         .otherwise(F.lit(0).cast("long"))))
    return F.when(s.rlike(ASCII), F.transform(F.sequence(F.lit(0), F.lit(127)), mask))


def lcs_bits_codes(codes, code_masks, m) -> Column:
    """``lcs_bits`` over character codes with an ASCII pattern's code-indexed masks."""
    full = _bit(m) - 1
    zero = F.lit(0).cast("long")

    def step(v, code):
        u = v.bitwiseAND(F.when(code < 128, F.element_at(_col(code_masks), code + 1)).otherwise(zero))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)
    return _col(m) - F.bit_count(F.aggregate(_col(codes), full, step))


def lcs_bits(text, masks, m, text_chars=None) -> Column:
    """LCS length of ``text`` and a pattern of length ``m`` (<= 62) given its masks
    (``text_chars``: the text already split into characters, if at hand)."""
    full = _bit(m) - 1

    def step(v, ch):
        u = v.bitwiseAND(F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("long")))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)
    v = F.aggregate(chars(text) if text_chars is None else _col(text_chars), full, step)
    return _col(m) - F.bit_count(v)


def lcs_words(x, y) -> Column:
    """LCS length for patterns of any length: the bit-parallel step over words of ``MAX_BITS``
    bits, lowest first, the carry of the addition handed from word to word. Per character of
    ``x`` one pass over the words of ``y``."""
    x, y = _col(x), _col(y)
    n_words = F.ceil(F.length(y) / MAX_BITS).cast("int")
    words = F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0)))
    full = F.lit((1 << MAX_BITS) - 1)
    zero = F.lit(0).cast("long")
    # per distinct character of y, its positions as one mask per word
    masks = F.map_from_arrays(F.array_distinct(chars(y)), F.transform(F.array_distinct(chars(y)), lambda ch: F.transform(
        words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(MAX_BITS - 1)), zero, lambda acc, j: acc.bitwiseOR(
            F.when(F.substring(y, w * MAX_BITS + j + 1, 1) == ch, _bit(j)).otherwise(zero))))))

    def step(state, hit):
        def word(acc, w):
            v = F.element_at(state["v"], w + 1)
            u = v.bitwiseAND(F.element_at(hit, w + 1))
            total = v + u + acc["carry"]  # v + u < 2^63 and the carry is a bit: no overflow
            return F.struct(F.concat(acc["v"], F.array(total.bitwiseOR(v - u).bitwiseAND(full))).alias("v"),
                            F.call_function("shiftright", total, F.lit(MAX_BITS)).alias("carry"))
        moved = F.aggregate(words, F.struct(F.array().cast("array<bigint>").alias("v"), zero.alias("carry")), word)
        return F.struct(moved["v"].alias("v"))

    none = F.transform(words, lambda w: zero)
    hits = F.transform(chars(x), lambda ch: F.coalesce(F.try_element_at(masks, ch), none))
    end = F.aggregate(hits, F.struct(F.transform(words, lambda w: full).alias("v")), step)
    # bits of the last word beyond the pattern start as ones and stay so
    left = F.aggregate(end["v"], F.lit(0), lambda acc, v: acc + F.bit_count(v))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0)).otherwise(n_words * MAX_BITS - left)


def char_bits(c) -> Column:
    """The characters of a text as a multiset: struct(lo, hi, rest). A bit stands for the first, second
    or third occurrence of a character (a-z three, the space two, digits and A-Z one); ``rest`` counts
    the occurrences without a bit. The runs of the sorted characters lose one each between levels."""
    s = _col(c)
    level = F.array_join(F.array_sort(chars(s)), "")
    levels = []
    for _ in range(3):
        levels.append(F.array_distinct(chars(level)))
        level = F.regexp_replace(level, r"(?s)(.)(\1*)", "$2")

    def word(*parts):
        """Bits of (level, first code, last code, first bit) ranges."""
        total = F.lit(0).cast("long")
        for k, first, last, at in parts:
            total = total.bitwiseOR(F.aggregate(levels[k], F.lit(0).cast("long"), lambda acc, ch: acc.bitwiseOR(
                F.when(F.ascii(ch).between(first, last), _bit(F.ascii(ch) - (first - at))).otherwise(F.lit(0).cast("long")))))
        return total
    a, z = ord("a"), ord("z")
    lo = word((0, a, z, 0), (1, a, z, 26), (0, ord("0"), ord("9"), 52), (0, 32, 32, 62))
    hi = word((2, a, z, 0), (0, ord("A"), ord("Z"), 26), (1, 32, 32, 52))
    return F.struct(lo.alias("lo"), hi.alias("hi"), (F.length(s) - F.bit_count(lo) - F.bit_count(hi)).alias("rest"))


def common_bound(a_bits, b_bits) -> Column:
    """At least the size of the common multiset of characters, hence of any common subsequence,
    from two ``char_bits``: three bit operations in generated code."""
    a, b = _col(a_bits), _col(b_bits)
    return (F.bit_count(a["lo"].bitwiseAND(b["lo"])) + F.bit_count(a["hi"].bitwiseAND(b["hi"]))
            + F.least(a["rest"], b["rest"]))


def lcs(x, y, y_masks=None) -> Column:
    """LCS length of two string Columns; uses precomputed masks of ``y`` when given."""
    x, y = _col(x), _col(y)
    ly, lx = F.length(y), F.length(x)
    masks = y_masks if y_masks is not None else pattern_masks(y)
    return (F.when(ly <= MAX_BITS, lcs_bits(x, masks, ly))
            .when(lx <= MAX_BITS, lcs_bits(y, pattern_masks(x), lx))
            .otherwise(lcs_words(x, y)))


def token_set_ratio_parts(a_tokens, b_tokens, b_joined=None, b_masks=None) -> Column:
    """Score 0..100 from two sorted distinct token arrays.

    ``b_joined``/``b_masks`` are the joined tokens of b and their masks, precomputed on the
    small (keyword) side; they are used whenever the intersection is empty (x = all of a,
    y = all of b), the common case.
    """
    a, b = _col(a_tokens), _col(b_tokens)
    inter = F.array_intersect(a, b)
    xa, yb = F.array_except(a, b), F.array_except(b, a)
    x, y = F.array_join(xa, " "), F.array_join(yb, " ")
    s = F.length(F.array_join(inter, " "))
    sep = F.when(s > 0, 1).otherwise(0)
    la, lb = s + sep + F.length(x), s + sep + F.length(y)
    if b_joined is not None and b_masks is not None:
        common = F.size(inter) == 0
        lcs_len = F.when(common & (F.length(b_joined) <= MAX_BITS),
                         lcs_bits(x, b_masks, F.length(b_joined))).otherwise(lcs(x, y))
    else:
        lcs_len = lcs(x, y)
    indel = F.length(x) + F.length(y) - 2 * lcs_len
    r1 = F.lit(100.0) - F.lit(100.0) * indel / (la + lb)
    r_ab = F.lit(100.0) - F.lit(100.0) * (sep + F.length(x)) / (s + la)
    r_ba = F.lit(100.0) - F.lit(100.0) * (sep + F.length(y)) / (s + lb)
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .when((F.size(inter) > 0) & ((F.size(xa) == 0) | (F.size(yb) == 0)), F.lit(100.0))
            .when(s == 0, r1)
            .otherwise(F.greatest(r1, r_ab, r_ba)))


def score_pairs(pairs, a_tokens: str, b_tokens: str, b_joined: str | None = None,
                b_masks: str | None = None, out: str = "score", a_chars: str | None = None,
                a_codes: str | None = None, b_code_masks: str | None = None):
    """DataFrame form of ``token_set_ratio_parts``: the same score computed in staged
    projections (set parts, then LCS, then the ratio), so each intermediate is evaluated
    once per pair and the plan stays small."""
    a, b = F.col(a_tokens), F.col(b_tokens)
    p = pairs.withColumns({"_inter": F.array_intersect(a, b), "_xa": F.array_except(a, b),
                           "_yb": F.array_except(b, a)})
    p = p.withColumns({"_x": F.array_join("_xa", " "), "_y": F.array_join("_yb", " "),
                       "_s": F.length(F.array_join("_inter", " ")),
                       "_na": F.size(a), "_nb": F.size(b), "_ni": F.size("_inter"),
                       "_nx": F.size("_xa"), "_ny": F.size("_yb")})
    lx, ly = F.length("_x"), F.length("_y")
    if b_joined is not None and b_masks is not None:
        fast = (F.col("_ni") == 0) & (F.length(b_joined) <= MAX_BITS)
        lcs_len = F.when(fast, lcs_bits(F.col("_x"), F.col(b_masks), F.length(b_joined),
                                        text_chars=a_chars))
        if a_codes is not None and b_code_masks is not None:
            fastest = fast & F.col(b_code_masks).isNotNull()
            lcs_len = F.when(fastest, lcs_bits_codes(F.col(a_codes), F.col(b_code_masks),
                                                     F.length(b_joined))).when(
                fast, lcs_bits(F.col("_x"), F.col(b_masks), F.length(b_joined), text_chars=a_chars))
        lcs_len = lcs_len.otherwise(lcs(F.col("_x"), F.col("_y")))
    else:
        lcs_len = lcs(F.col("_x"), F.col("_y"))
    need = (F.col("_na") > 0) & (F.col("_nb") > 0) & ~((F.col("_ni") > 0) & ((F.col("_nx") == 0) | (F.col("_ny") == 0)))
    p = p.withColumns({"_lcs": F.when(need, lcs_len), "_lx": lx, "_ly": ly,
                       "_sep": F.when(F.col("_s") > 0, 1).otherwise(0)})
    s_, sep, lx, ly = F.col("_s"), F.col("_sep"), F.col("_lx"), F.col("_ly")
    la, lb = s_ + sep + lx, s_ + sep + ly
    r1 = F.lit(100.0) - F.lit(100.0) * (lx + ly - 2 * F.col("_lcs")) / (la + lb)
    r_ab = F.lit(100.0) - F.lit(100.0) * (sep + lx) / (s_ + la)
    r_ba = F.lit(100.0) - F.lit(100.0) * (sep + ly) / (s_ + lb)
    score = (F.when((F.col("_na") == 0) | (F.col("_nb") == 0), F.lit(0.0))
             .when((F.col("_ni") > 0) & ((F.col("_nx") == 0) | (F.col("_ny") == 0)), F.lit(100.0))
             .when(s_ == 0, r1)
             .otherwise(F.greatest(r1, r_ab, r_ba)))
    tmp = ["_inter", "_xa", "_yb", "_x", "_y", "_s", "_na", "_nb", "_ni", "_nx", "_ny", "_lcs", "_lx",
           "_ly", "_sep"]
    return p.withColumn(out, score).drop(*tmp)


def token_set_ratio(a, b) -> Column:
    """F9 on two string Columns (0..100, case-sensitive, no preprocessing)."""
    return token_set_ratio_parts(token_set(a), token_set(b))


def may_reach(a_len, b_len, a_tokens, b_tokens, threshold: float) -> Column:
    """Lossless prefilter: False only when the score is certainly below ``threshold``.

    Without a shared token the score is at most 200*min(|x|,|y|)/(|x|+|y|).
    """
    t = threshold / 100.0
    lo, hi = F.least(_col(a_len), _col(b_len)), F.greatest(_col(a_len), _col(b_len))
    band = lo * (2.0 - t) >= hi * t - 1e-9
    return band | F.arrays_overlap(_col(a_tokens), _col(b_tokens))
