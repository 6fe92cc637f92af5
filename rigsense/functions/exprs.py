"""Null-safe column expressions.

NaN and infinities are turned into NULL where data enters, and every helper here
passes NULL through: ``greatest`` and ``least`` skip NULL, so a bare clamp would
turn a missing reading into the bound.
"""

from __future__ import annotations

from zoneinfo import available_timezones
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NULL_WORDS = ["nan", "none", "null"]


def lit_d(x: float) -> Column:
    return F.lit(float(x))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < lit_d("inf")), c)


def to_number(c: Column) -> Column:
    """Text or number to a finite double, else NULL."""
    return finite(F.trim(c.cast("string")).try_cast("double"))


def to_int(c: Column) -> Column:
    """Text or number to an integer, truncating, else NULL."""
    return to_number(c).try_cast("int")


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    bounded = c
    if hi is not None:
        bounded = F.least(bounded, lit_d(hi))
    if lo is not None:
        bounded = F.greatest(bounded, lit_d(lo))
    return F.when(c.isNotNull(), bounded)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or the result is not finite."""
    return F.try_divide(a, b)


def pct_of(a: Column, b: Column) -> Column:
    return ratio(a, b) * lit_d(100.0)


def text_or_null(c: Column, null_words: bool = False) -> Column:
    """Trimmed text; blank (and optionally nan/none/null) become NULL."""
    t = F.trim(c)
    bad = t == ""
    if null_words:
        bad = bad | F.lower(t).isin(_NULL_WORDS)
    return F.when(~bad, t)


def mode_name(c: Column, modes: Iterable[str]) -> Column:
    """Lower-case trimmed mode; anything unknown, NULL included, is 'normal'."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(list(modes)), t).otherwise(F.lit("normal"))


def label01(c: Column) -> Column:
    """NULL to 0, round half to even, clip to 0..1."""
    return F.greatest(F.least(F.bround(F.coalesce(c.cast("double"), lit_d(0.0))), lit_d(1.0)),
                      lit_d(0.0)).cast("int")


def parse_time(c: Column) -> Column:
    """ISO-8601 text, with or without zone, to a timestamp (naive text is session time)."""
    return F.trim(c).try_cast("timestamp")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; NULL when a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, b)))
    return ratio(F.covar_pop(a, b), spread)


def flag(c: Column) -> Column:
    """A condition as 0/1, NULL counting as false."""
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def count_where(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def percent_text(c: Column) -> Column:
    return F.format_string("%.2f%%", c * lit_d(100.0))


def html_escape(c: Column) -> Column:
    out = c
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def round_half_even(c: Column, digits: int) -> Column:
    """Round a double the way numeric array libraries do: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(c * lit_d(scale)) / lit_d(scale)


def r6(c: Column) -> Column:
    """Round to six digits, nudged off decimal ties.

    Readings carry few decimals, so means over 16 or 32 of them end exactly in a 5;
    the nudge makes engines with different half-way rounding agree.
    """
    return F.round(c.cast("double") + lit_d(1e-9), 6)


def known_zone(zone: Column) -> Column:
    """True for the names in the time zone database of the driver."""
    return zone.isin(sorted(available_timezones() - {"Factory", "localtime"}))
