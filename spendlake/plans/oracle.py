"""DuckDB SQL fragments for the correctness oracle (test scaffolding, not used by Spark).

Each helper returns SQL text; queries in ``catalog`` assemble them over the pre-registered
parquet views. The F1 title case needs the character list twice (current and previous
character), so it is computed in two SELECT levels: ``merchant_select``.
"""
from __future__ import annotations

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def f2(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^a-z0-9]+', ' ', 'g'))"


def f1_collapse(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), "
            r"'\s*#\d+\s*', '', 'g'), '\s+', ' ', 'g'))")


def title_from_chars(cs: str) -> str:
    return (f"array_to_string(list_transform({cs}, lambda c, i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches({cs}[i - 1], '{CASED}') THEN (CASE WHEN c = 'ß' THEN 'Ss' "
            f"ELSE upper(c) END) ELSE c END), '')")


def merchant_select(src: str, col: str, out: str = "merchant", keep: str = "*") -> str:
    """SELECT keep, F1(col) AS out FROM (src)."""
    return (f"SELECT {keep}, {title_from_chars('_cs')} AS {out} FROM "
            f"(SELECT *, string_split(lower({f1_collapse(col)}), '') AS _cs FROM ({src}) _s) _t")


def tokens(x: str) -> str:
    return (f"list_sort(list_distinct(list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), "
            f"lambda t: t <> '')))")


def lcs(x: str, y: str) -> str:
    """Bit-parallel LCS (|y| <= 62) with list_reduce."""
    mask = (f"list_sum(list_transform(range(length({y})), lambda j: CASE WHEN {y}[j + 1] = c "
            f"THEN (1::BIGINT << j) ELSE 0::BIGINT END))")
    full = f"((1::BIGINT << length({y})) - 1)"
    return (f"(length({y}) - bit_count(list_reduce(string_split({x}, ''), lambda v, c: "
            f"((v + (v & {mask})) | (v - (v & {mask}))) & {full}, {full})))")


def token_set_score(a: str, b: str) -> str:
    """Score 0..100 of two token lists ``a``, ``b`` (sorted, distinct). Needs columns
    computed by ``token_set_prep``: inter, xa, yb, x, y, s."""
    r1 = "(100::DOUBLE - 100::DOUBLE * (length(x) + length(y) - 2 * lcs_len) / (s + sep + length(x) + s + sep + length(y)))"
    rab = "(100::DOUBLE - 100::DOUBLE * (sep + length(x)) / (s + s + sep + length(x)))"
    rba = "(100::DOUBLE - 100::DOUBLE * (sep + length(y)) / (s + s + sep + length(y)))"
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE "
            f"WHEN len(inter) > 0 AND (len(xa) = 0 OR len(yb) = 0) THEN 100::DOUBLE "
            f"WHEN s = 0 THEN {r1} ELSE greatest({r1}, {rab}, {rba}) END")


def long_lcs(x: str, y: str) -> str:
    """LCS of texts of any length by the classical table, a row per character of ``x``: the running maximum
    of a row is the last row's value plus one where characters match, or what stands left of it."""
    row = (f"list_reduce(range(1, length({y}) + 1), lambda acc, j: list_append(acc, greatest(acc[len(acc)], prev[j + 1], "
           f"CASE WHEN {y}[j] = c THEN prev[j] + 1 ELSE 0 END)), [0::BIGINT])")
    return (f"list_reduce(string_split({x}, ''), lambda prev, c: {row}, list_transform(range(length({y}) + 1), lambda q: 0::BIGINT))[length({y}) + 1]")


def token_set_prep(src: str, a: str, b: str, lcs=lcs) -> str:
    """Adds inter, xa, yb, x, y, s, sep, lcs_len to ``src`` (which has list columns a, b)."""
    step1 = (f"SELECT *, list_filter({a}, lambda t: list_contains({b}, t)) AS inter, "
             f"list_filter({a}, lambda t: NOT list_contains({b}, t)) AS xa, "
             f"list_filter({b}, lambda t: NOT list_contains({a}, t)) AS yb FROM ({src}) _p1")
    step2 = (f"SELECT *, array_to_string(xa, ' ') AS x, array_to_string(yb, ' ') AS y, "
             f"length(array_to_string(inter, ' ')) AS s FROM ({step1}) _p2")
    step3 = (f"SELECT *, CASE WHEN s > 0 THEN 1 ELSE 0 END AS sep, "
             f"CASE WHEN length(y) > 0 THEN {lcs('x', 'y')} ELSE 0 END AS lcs_len FROM ({step2}) _p3")
    return step3


def rules_values(rows) -> str:
    """(ord, category, keyword) rows as a VALUES table."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    vals = ", ".join(f"({o}, {q(c)}, {q(k)})" for o, c, k in rows)
    return f"(SELECT * FROM (VALUES {vals}) AS _r(ord, category, keyword))"


def keyword_case(d: str, rows) -> str:
    """Ordered CASE: category of the first rule whose keyword is a substring of ``d``."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN contains({d}, {q(k)}) THEN {q(c)}" for _, c, k in rows)
    return f"(CASE {whens} END)"


def fuzzy_best(merchants_sql: str, rows, threshold: int) -> str:
    """(merchant, fuzzy_category, fuzzy_confidence) for accepted merchants."""
    kw = (f"SELECT keyword, min(ord) AS ord, arg_max(category, ord) AS category "
          f"FROM {rules_values(rows)} GROUP BY keyword")
    pairs = (f"SELECT m.merchant, k.ord, k.category, {tokens('m.merchant')} AS a, "
             f"{tokens('k.keyword')} AS b FROM (SELECT DISTINCT merchant FROM ({merchants_sql}) _m "
             f"WHERE merchant <> '') m CROSS JOIN ({kw}) k")
    scored = (f"SELECT merchant, ord, category, ({token_set_score('a', 'b')}) / 100.0::DOUBLE AS conf "
              f"FROM ({token_set_prep(pairs, 'a', 'b')}) _sc")
    acc = f"SELECT * FROM ({scored}) _a WHERE conf > 0 AND conf * 100 >= {threshold}"
    return (f"SELECT merchant, arg_max(category, (conf, -ord)) AS fuzzy_category, "
            f"max(conf) AS fuzzy_confidence FROM ({acc}) _b GROUP BY merchant")


def txn_id(date: str, merchant: str, amount: str, account: str) -> str:
    return (f"sha1(concat_ws('-', strftime({date}, '%Y-%m-%d'), {merchant}, "
            f"printf('%.2f', {amount}), coalesce(trim(CAST({account} AS VARCHAR)), 'None')))")
