"""Personal data: candidate spans scored by gradient-boosted trees; DataFrame functions only.

*Base* spans are defined by a pattern and a check per kind (leftmost, not overlapping within a
kind; matches that fail the check are dropped and not retried). They are always kept. The
*generators* propose further spans with looser or tighter patterns that may overlap each
other and the base spans: a telephone number next to other digits, a card number beside
one, an address written with ``[at]``. Boosted trees over small whole-number features of a
candidate's format and context decide on those; thresholds are calibrated per kind.

Labels come from the corpus itself: a candidate that is a base span is positive, one that
overlaps no base span is negative, others teach nothing. Candidates of all documents are
grouped by kind and feature vector into positive and negative counts before anything is
shuffled; the trees are fitted on the ``max_groups`` most frequent vectors (a documented bound)
with histograms gathered by Spark. A fifth of the documents (by crc32 of the id) is kept out
of fitting and calibrates: a kind's threshold is the lowest score from which the share of positive
candidates is at least ``PRECISION``; without such a score the kind gets no further spans.

Everything about a document happens inside its row: no join or shuffle of texts. Patterns
are written without nested repetition (inner dots and blanks are first replaced by one mark
character each), so that very long runs neither recurse nor go back over themselves.

Null or empty text has no spans. Positions are code points, ends exclusive. Repeated rows get
equal results. Input columns named like an output are replaced.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import held_out, written

KINDS = ("email", "ip", "card", "phone")
PRECISION, FOLDS, MAX_GROUPS = 0.95, 5, 4096
TREES, RATE, L2, TOP = 12, 0.4, 1.0, 31

#: Stand-in for an inner dot or blank; in the text itself it is first replaced by ``OTHER``.
MARK, OTHER = "\x01", "\x02"
_LOCAL = "A-Za-z0-9._%+" + MARK + "-"
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("value", T.StringType())]))


def _marked(text: Column, kind: str) -> Column:
    plain = F.translate(text, MARK, OTHER)
    if kind == "email":
        return F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    if kind == "card":
        return F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", MARK)
    return plain


#: Per kind: what a text must contain to be searched, and the pattern on the marked text.
BASE = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9][0-9 -][0-9]", rf"[0-9][0-9{MARK}]++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Candidate generators: kind, condition, pattern on the plain text.
GENERATORS = (
    ("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _END),
    ("email", r"[\[(](?:at|AT)[\])]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63} ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z]{2,24}" + _END),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("ip", r"[0-9]\[\.\]", r"(?<![0-9.\]])(?:[0-9]{1,3}\[\.\]){3}[0-9]{1,3}(?![0-9\[])"),
    ("card", "[0-9]{13}", _EDGE + "[0-9]{13,19}" + _END),
    ("card", "[0-9]{4}[ .-][0-9]{4}", _EDGE + "(?:[0-9]{4}[ .-]){3}[0-9]{1,7}" + _END),
    ("phone", "[0-9]{4}", r"(?<![0-9A-Za-z+(.-])\+?(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}" + _END),
    ("phone", r"\+[0-9]", r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]\(?[0-9]{2,4}\)?){2,5}" + _END),
)
FEATURES = ("digits", "letters", "groups", "plus", "paren", "dots", "blanks", "luhn", "octets", "before", "after", "word", "first", "kind")


def _spans(searched: Column, pattern: str, when: Column) -> Column:
    """Matches of a pattern with their places: what a split leaves between the matches gives
    the distances."""
    pairs = F.zip_with(F.regexp_extract_all(searched, F.lit(pattern), F.lit(0)), F.split(searched, pattern, -1),
                       lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    none = F.array().cast(_SPAN)

    def add(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("pos"), F.concat(a["out"], one).alias("out")))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), add, lambda a: a["out"])
    return F.when(when, found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of 13 to 19 digits; false for other lengths."""
    def one(s: Column, i: Column) -> Column:
        d = s.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:(?:\.|\[\.\]){_PART}){{3}}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(kind: str, text_col: str) -> Column:
    condition, pattern = BASE[kind]
    text = F.col(text_col)
    found = _spans(_marked(text, kind), pattern, text.rlike(condition))
    return F.filter(found, lambda s: _valid(kind, s["value"]))


def _side(c: Column) -> Column:
    """Class of a neighbouring character: none or blank, letter, digit, sentence mark, bracket
    or quote, other."""
    return (F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2)
            .when(c.rlike("[.,;:?!]"), 3).when(c.rlike("[()\\[\\]<>\"']"), 4).otherwise(5))


def _count(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def _features(text: Column, kind: str, s: Column) -> Column:
    v = s["value"]
    before = F.when(s["start"] > 0, F.substr(text, s["start"], F.lit(1))).otherwise("")
    after = F.substr(text, s["end"] + 1, F.lit(1))
    lead = F.lower(F.substr(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16))))
    word = (F.when(lead.rlike("(?:tel|phone|fax|call|mobile|cell)"), 1).when(lead.rlike("mail"), 2)
            .when(lead.rlike("(?:card|visa|credit)"), 3).when(lead.rlike(r"(?:\bip\b|host|server|addr)"), 4)
            .when(lead.rlike("(?:order|invoice|isbn|part|version|serial|#)"), 5).otherwise(0))
    flags = [_count(v, "[0-9]"), _count(v, r"\p{L}"), F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[^0]", "")),
             v.startswith("+").cast("int"), v.contains("(").cast("int"), _count(v, r"\."), _count(v, "[ -]"),
             _luhn(_digits(v)).cast("int"), _valid("ip", v).cast("int"), _side(before), _side(after), word,
             F.coalesce(F.substr(_digits(v), F.lit(1), F.lit(1)).try_cast("int"), F.lit(10)), F.lit(KINDS.index(kind))]
    return F.array(*(F.least(F.coalesce(x.cast("int"), F.lit(0)), F.lit(TOP)) for x in flags))


def _with_kind(spans: str, kind: str, text: Column | None = None) -> Column:
    """Spans with their kind's number and, given the text, with features instead of the value."""
    def one(s: Column) -> Column:
        more = [] if text is None else [_features(text, kind, s).alias("f")]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *more)

    return F.transform(spans, one)


def candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``cands``: arrays of ``kind`` (number), ``start``, ``end``, the latter
    with the features ``f``. A span proposed twice for a kind stays once."""
    text = F.col(text_col)
    for kind in KINDS:
        df = df.withColumn(f"_b_{kind}", base_spans(kind, text_col))
    base = F.flatten(F.array(*(_with_kind(f"_b_{k}", k) for k in KINDS)))
    for i, (_, condition, pattern) in enumerate(GENERATORS):
        df = df.withColumn(f"_c_{i}", _spans(text, pattern, text.rlike(condition)))
    cands = F.array_distinct(F.flatten(F.array(*(_with_kind(f"_c_{i}", g[0], text) for i, g in enumerate(GENERATORS)))))
    return (df.withColumn("base", base).withColumn("cands", cands)
            .drop(*(f"_b_{k}" for k in KINDS), *(f"_c_{i}" for i in range(len(GENERATORS)))))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Model:
    """Boosted trees of depth two and one threshold per kind (``None``: never)."""

    def __init__(self, base: float = 0.0):
        self.base, self.trees, self.thresholds = base, [], [None] * len(KINDS)

    def margin(self, f: Column) -> Column:
        total = F.lit(self.base)
        for (j, t), low, high in self.trees:
            side = lambda b: F.when(f[b[0][0]] <= b[0][1], b[1]).otherwise(b[2]) if isinstance(b, tuple) else F.lit(b)
            total = total + F.when(f[j] <= t, side(low)).otherwise(side(high))
        return total

    def score(self, f: Column) -> Column:
        return F.round(1 / (1 + F.exp(-self.margin(f))), 6)

    def accepts(self, s: Column) -> Column:
        ok = F.lit(False)
        for k, t in enumerate(self.thresholds):
            if t is not None:
                ok = ok | ((s["kind"] == k) & (self.score(s["f"]) >= t))
        return ok


def _best(hist: list, g: float, h: float) -> tuple[float, int, int, float, float] | None:
    """Best split of a node from its histogram rows ``(feature, value, g, h)``."""
    best = None
    by: dict[int, list] = {}
    for j, v, gv, hv in hist:
        by.setdefault(j, []).append((v, gv, hv))
    for j, cells in sorted(by.items()):
        gl = hl = 0.0
        for v, gv, hv in sorted(cells)[:-1]:
            gl, hl = gl + gv, hl + hv
            gain = gl * gl / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g * g / (h + L2)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (gain, j, v, gl, hl)
    return best


def fit(groups: DataFrame, trees: int = TREES, max_groups: int = MAX_GROUPS) -> Model:
    """Boosting on ``f, held, pos, neg``. Every round Spark sums gradients by node, feature and
    value: at most 2 x features x 32 rows come to the driver."""
    train = written(groups.filter(~F.col("held")).orderBy((F.col("pos") + F.col("neg")).desc(), "f").limit(max_groups), "pii-groups")
    pos, neg = train.agg(F.sum("pos"), F.sum("neg")).first()
    if not pos:
        return Model()
    model = Model(math.log((pos + 0.5) / ((neg or 0) + 0.5)))
    for _ in range(trees if neg else 0):
        p = 1 / (1 + F.exp(-model.margin(F.col("f"))))
        rows = train.select("f", (p * (F.col("pos") + F.col("neg")) - F.col("pos")).alias("g"),
                            (p * (1 - p) * (F.col("pos") + F.col("neg"))).alias("h"))

        def histogram(node: Column) -> dict:
            got: dict = {}
            for n, j, v, g, h in (rows.select(node.alias("n"), F.posexplode("f").alias("j", "v"), "g", "h")
                                  .groupBy("n", "j", "v").agg(F.sum("g"), F.sum("h")).collect()):
                got.setdefault(n, []).append((j, v, round(g, 9), round(h, 9)))
            return got

        sums = lambda cells: (sum(c[2] for c in cells if c[0] == 0), sum(c[3] for c in cells if c[0] == 0))
        root = histogram(F.lit(0))[0]
        split = _best(root, *sums(root))
        if split is None:
            break
        j, t = split[1:3]
        sides = histogram(F.when(F.col("f")[j] <= t, 0).otherwise(1))
        leaf = lambda g, h: -RATE * g / (h + L2)
        parts = []
        for n in (0, 1):
            g, h = sums(sides[n])
            s = _best(sides[n], g, h)
            parts.append(leaf(g, h) if s is None else ((s[1], s[2]), leaf(s[3], s[4]), leaf(g - s[3], h - s[4])))
        model.trees.append(((j, t), *parts))
    return calibrate(model, groups)


def calibrate(model: Model, groups: DataFrame, precision: float = PRECISION) -> Model:
    """Thresholds from the held-out groups; the rows are one per kind and score, and the trees
    have at most 4 leaves each."""
    rows = (groups.filter("held").select(F.col("f")[FEATURES.index("kind")].alias("k"), model.score(F.col("f")).alias("s"), "pos", "neg")
            .groupBy("k", F.round("s", 3).alias("s")).agg(F.sum("pos"), F.sum("neg")).collect())
    for k in range(len(KINDS)):
        pos = neg = 0
        for s, p, n in sorted(((r[1], r[2], r[3]) for r in rows if r[0] == k), reverse=True):
            pos, neg = pos + p, neg + n
            if pos and pos / (pos + neg) >= precision:
                model.thresholds[k] = s - 0.0005
    return model


def train(df: DataFrame, text_col: str = "text") -> Model:
    """Fit on the candidates of all documents (``doc_id`` and the text column)."""
    c = (candidates(df, text_col).filter(F.size("cands") > 0)
         .select(held_out(FOLDS).alias("held"), "base", F.explode("cands").alias("c")))
    same = F.exists("base", lambda b: (b["kind"] == F.col("c")["kind"]) & (b["start"] == F.col("c")["start"]) & (b["end"] == F.col("c")["end"]))
    touched = F.exists("base", lambda b: _overlap(b, F.col("c")))
    groups = (c.select("held", F.col("c")["f"].alias("f"), same.alias("pos"), (~touched).alias("neg")).filter("pos or neg")
              .groupBy("held", "f").agg(F.sum(F.col("pos").cast("long")).alias("pos"), F.sum(F.col("neg").cast("long")).alias("neg")))
    return fit(written(groups, "pii-vectors"))


def detect(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans`` (base and accepted candidates by kind, start, end): arrays of
    ``kind`` (name), ``start``, ``end``. Of accepted candidates that overlap each other the
    best scored stays, then the longer, then the earlier; those that overlap base spans go."""
    kept = df.drop("base", "cands", "spans")
    found = candidates(kept, text_col)
    base = F.col("base")
    ranked = F.array_sort(F.transform(
        F.filter("cands", lambda s: model.accepts(s) & ~F.exists(base, lambda b: _overlap(b, s))),
        lambda s: F.struct((-model.score(s["f"])).alias("o"), (s["start"] - s["end"]).alias("l"), s["start"].alias("start"),
                           s["end"].alias("end"), s["kind"].alias("kind"))))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.filter(base, lambda s: F.lit(False))
    picked = F.aggregate(ranked, none, lambda a, s: F.when(F.exists(a, lambda b: _overlap(b, s)), a).otherwise(F.concat(a, F.array(bare(s)))))
    names = F.array(*(F.lit(k) for k in KINDS))
    named = lambda col: F.transform(F.array_sort(col), lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    some = F.when(F.size("cands") > 0, picked).otherwise(none)
    empty = F.transform(none, lambda s: F.struct(F.lit("").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*kept.columns, F.coalesce(named(base), empty).alias("base"),
                        F.coalesce(named(F.concat(base, some)), empty).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones together) replaced by ``[KIND]`` of its first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(a["out"], F.substr(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.when(s["start"] >= a["pos"], cut).otherwise(a["out"]).alias("out"))

    return F.aggregate(order, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                       lambda a: F.concat(a["out"], F.substr(text, a["pos"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
