"""Column-level helpers (the B rows of the inventory).

All of these return ``Column`` expressions built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none of them is a Python UDF.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Implicit-feedback weight per event type (a purchase row counts once, not per unit).
EVENT_WEIGHTS = {
    "view": 1.0,
    "click": 2.0,
    "add_to_wishlist": 3.0,
    "add_to_cart": 4.0,
    "purchase": 5.0,
    "remove_from_cart": -2.0,
    "remove_from_wishlist": -1.0,
}
# Interaction vocabulary (six types; the pivots below have a fixed schema).
INTERACTION_TYPES = ["view", "click", "add_to_cart", "add_to_wishlist",
                     "remove_from_wishlist", "remove_from_cart"]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# B1 ------------------------------------------------------------------------
def parse_ts(c) -> Column:
    """Parse timestamp text (any ISO-like form, sub-microsecond digits allowed) and
    floor it to the second. A value that does not parse raises under ANSI mode,
    as the reference does."""
    col = _c(c)
    return F.date_trunc("second", col.cast("timestamp"))


def floor_second(c) -> Column:
    """Floor an existing timestamp column to the second (as a zoned timestamp)."""
    return F.date_trunc("second", _c(c).cast("timestamp"))


# B2 / B25 ------------------------------------------------------------------
# Every character that counts as white space in text (Unicode).
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim(c) -> Column:
    """Text without white space of any kind at either end."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def trim_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: trim(c) for c in cols if c in df.columns})


# B3 / B7 -------------------------------------------------------------------
def flag(cond) -> Column:
    return _c(cond).cast("bigint")


def is_verified(purchase_id) -> Column:
    return flag(_c(purchase_id).isNotNull())


# B4 / B6 -------------------------------------------------------------------
def first_line(c, n: int = 180) -> Column:
    return F.substring(F.split(_c(c), "\n").getItem(0), 1, n)


def truncate(c, n: int = 400) -> Column:
    return F.substring(_c(c), 1, n)


# B8 / B14 ------------------------------------------------------------------
def zero_fill_long(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
                           for c in cols})


def to_number(c) -> Column:
    """Coerce to a number; text that is not numeric, NaN and NULL become 0."""
    number = F.expr(f"try_cast({_sql(c)} as double)")
    return F.nanvl(F.coalesce(number, F.lit(0.0)), F.lit(0.0))


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("to_number expects a column name")


# B9 ------------------------------------------------------------------------
def safe_ratio(num, den) -> Column:
    """num / den with a zero (or NULL) denominator giving NULL, never an error."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# B10–B13 -------------------------------------------------------------------
def hour_of(ts) -> Column:
    return F.hour(_c(ts)).cast("bigint")


def day_of_week(ts) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(_c(ts)).cast("bigint")


def is_weekend(dow) -> Column:
    return flag(_c(dow) >= 5)


def seconds_between(a, b) -> Column:
    """b - a in seconds, as double."""
    return (F.unix_timestamp(_c(b).cast("timestamp"))
            - F.unix_timestamp(_c(a).cast("timestamp"))).cast("double")


def tenure_days(start, signup) -> Column:
    """Whole days from signup to start, floored toward minus infinity
    (one hour *before* signup is day -1, not 0)."""
    secs = (F.unix_timestamp(_c(start).cast("timestamp"))
            - F.unix_timestamp(_c(signup).cast("timestamp")))
    return F.floor(secs / F.lit(86400)).cast("bigint")


def net(add, remove) -> Column:
    return _c(add) - _c(remove)


# B15–B18 -------------------------------------------------------------------
def event_weight(type_col) -> Column:
    """Weight per event type; an unknown type maps to NULL and contributes nothing."""
    pairs = []
    for k, v in EVENT_WEIGHTS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(type_col))


def tag_purchases(df: DataFrame) -> DataFrame:
    return df.withColumn("interaction_type", F.lit("purchase"))


def clip_low(c, lo=0) -> Column:
    return F.greatest(_c(c), F.lit(lo))


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


# B21 -----------------------------------------------------------------------
def month_key(ts) -> Column:
    """'YYYY-MM' text of a timestamp or date."""
    return F.date_format(_c(ts), "yyyy-MM")


def pct(c, digits: int = 2) -> Column:
    """Ratio -> percent, rounded; NULL ratio reads as 0."""
    return F.round(F.coalesce(_c(c), F.lit(0.0)) * 100, digits)


def short_name(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def bubble_size(revenue) -> Column:
    return F.least(F.lit(24.0), F.lit(6.0) + F.coalesce(_c(revenue), F.lit(0.0)) / 260)

