"""Value coercion and row identity (F5-F8) as native Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.text import merchant_name
from spendlake.schema import require_columns

# What counts as a number (pandas.to_numeric), the date shapes the
# statement readers meet: year first, slashes, day and month name in either order, and
# what str.strip() takes off.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TIME_OF_DAY = r"[T ] *(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?: *[AaPp][Mm])?(?: *(?:Z|[+-]\d{2}:?\d{2}))?$"
MONTH = ("(?=(?:jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|"
         "oct|october|nov|november|dec|december)\\b)([a-z]{3})[a-z]*")
YY_PIVOT = 69                                          # 00-68 -> 20xx, 69-99 -> 19xx
PYTHON_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HASH_ALGORITHMS = ("sha1", "md5", "sha256")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(c, strip_currency: bool = True) -> Column:
    """text to double; ``$`` and ``,`` removed; anything not numeric gives 0.0."""
    s = _col(c).cast("string")
    if strip_currency:
        s = F.regexp_replace(s, r"[$,]", "")
    return F.coalesce(F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double")), F.lit(0.0))


def parse_date(c, yy_pivot: int = YY_PIVOT) -> Column:
    """first shape that fits and parses, per row; otherwise null. Returns DATE.

    Shapes: year first with ``-`` or ``/``; slashes with the month first, or the day when the
    first number cannot be a month; day and month name in either order (``Jan 16, 2024``,
    ``16-Jan-2024``, ``16-Jan-24``). A time of day may follow, with fractions of seconds and
    an offset; the day is the written one. Eight bare digits are a number, not a date.

    Two-digit years below ``yy_pivot`` are 20yy, the others 19yy (strptime's fixed rule,
    deterministic). pandas' fallback parser slides the window with the current year
    instead (in 2026: 00-75 -> 20yy); pass ``yy_pivot`` to reproduce a given year's window."""
    # each step rewrites one shape to year-month-day and names its input once, so that the
    # expression stays small where Catalyst inlines it; the final parse rejects the rest
    low = "|".join(f"{y:02d}" for y in range(yy_pivot)) or "(?!)"
    day = F.regexp_replace(F.trim(_col(c).cast("string")), TIME_OF_DAY, "")
    for shape, ymd in ((r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
                       (r"^(0?[1-9]|1[0-2])/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
                       (r"^(1[3-9]|2\d|3[01])/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
                       (rf"(?i)^{MONTH}\.? +(\d{{1,2}}),? +(\d{{4}})$", "$3-$1-$2"),
                       (rf"(?i)^(\d{{1,2}})[ -]{MONTH}[ -](\d{{4}})$", "$3-$2-$1"),
                       (rf"^(\d{{1,2}})-([A-Za-z]{{3}})-({low})$", "20$3-$2-$1"),
                       (r"^(\d{1,2})-([A-Za-z]{3})-(\d{2})$", "19$3-$2-$1")):
        day = F.regexp_replace(day, shape, ymd)
    return F.to_date(F.try_to_timestamp(day, F.lit("yyyy-[MMM][M]-d")))


def money_text(amount) -> Column:
    """Amount rounded to cents as text, like ``f"{round(x, 2):.2f}"`` for inputs with at
    most two decimals (bank data). See ``exact_money_text`` for arbitrary doubles."""
    return F.format_string("%.2f", _col(amount).cast("double"))


def exact_money_text(amount) -> Column:
    """Cents text of the true value of a double, ties to the even cent, as
    ``f"{round(x, 2):.2f}"`` gives it, in generated code. Null stays null.

    Below 2^53 the fraction ``f`` of ``|x|`` is exact, and so is the error of the rounded product
    ``p = 100 * f``: with ``f`` cut after 26 bits both parts times 100 are exact. What is left of ``p``
    after the whole cents and that error decide together. Larger doubles are whole numbers: a long below 2^63,
    two decimals of 63 and 53 bits below 2^116, ``format_string`` beyond."""
    x = _col(amount).cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    f = size - whole.cast("double")
    high = F.floor(f * float(1 << 26)).cast("double") / float(1 << 26)
    p = f * 100.0
    error = (high * 100.0 - p) + (f - high) * 100.0  # 100 * f - p
    down = F.floor(p)
    past = (p - down.cast("double") - 0.5) + error   # its sign is exact
    up = (past > 0) | ((past == 0) & (down % 2 == 1))
    cents = whole * 100 + down + F.when(up, 1).otherwise(0)
    digits = F.concat(F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    top = F.floor(size / float(1 << 63))
    low = (size - top.cast("double") * float(1 << 63)).cast("long")
    long_digits = (top.cast("decimal(16,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("string")
    minus = F.when((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")), F.lit("-")).otherwise(F.lit(""))
    return (F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.concat(minus, F.lit("inf")))
            .when(size < float(1 << 53), F.concat(minus, digits))
            .when(size < float(1 << 63), F.concat(minus, size.cast("long").cast("string"), F.lit(".00")))
            .when(size < float(1 << 116), F.concat(minus, long_digits, F.lit(".00")))
            .otherwise(F.format_string("%.2f", x)))


def _date_part(date, dtype=None) -> Column:
    """ISO day for dates/timestamps; text dates are used as they are (``str(date)``)."""
    if isinstance(dtype, T.StringType):
        return _col(date)
    return F.date_format(_col(date), "yyyy-MM-dd")


def id_key(date, description, amount, account=None, exact_rounding: bool = False,
           date_type=None) -> Column:
    """The text that is hashed: ``yyyy-MM-dd-<F1 description>-<cents>-<account>``.
    A null description or account stringifies to "None", as ``str(None)`` does."""
    desc = F.coalesce(_col(description).cast("string"), F.lit("None"))
    money = exact_money_text(amount) if exact_rounding else money_text(amount)
    acct = (F.lit("") if account is None
            else F.coalesce(F.btrim(_col(account).cast("string"), F.lit(PYTHON_SPACES)), F.lit("None")))
    return F.concat_ws("-", _date_part(date, date_type), merchant_name(desc), money, acct)


def transaction_hash(date, description, amount, account=None, algorithm: str = "sha1",
                     exact_rounding: bool = False, date_type=None) -> Column:
    """hex digest of ``id_key``."""
    key = id_key(date, description, amount, account, exact_rounding, date_type)
    if algorithm == "sha1":
        return F.sha1(key)
    if algorithm == "md5":
        return F.md5(key)
    if algorithm == "sha256":
        return F.sha2(key, 256)
    raise ValueError(f"unknown hash algorithm {algorithm!r}; use one of {HASH_ALGORITHMS}")


def add_transaction_id(df: DataFrame, algorithm: str = "sha1", exact_rounding: bool = False) -> DataFrame:
    """F8: append ``transaction_id``; requires date, description, amount; account optional."""
    require_columns(df, ("date", "description", "amount"),
                    "transaction ids need the columns date, description and amount")
    acct = "account" if "account" in df.columns else None
    return df.withColumn("transaction_id", transaction_hash(
        "date", "description", "amount", acct, algorithm, exact_rounding,
        date_type=df.schema["date"].dataType))
