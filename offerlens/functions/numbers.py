"""Number parsing and two-decimal arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of Unicode, with the four ASCII separators.
_WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(_WHITE_SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it.

    Nested CASE expressions that repeat their input grow without bound when predicates are
    pushed through projections; binding the input keeps them linear.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def text(c: Column) -> Column:
    """Trimmed text with NULL read as blank."""
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def has_value(c: Column) -> Column:
    return text(c) != ""


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` in ``c``, NULL where there is none (``c`` is read once)."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def when_value(c: Column, keep) -> Column:
    """``c`` where ``keep(c)`` holds, else NULL; ``c`` is evaluated once, unlike in CASE."""
    return F.try_element_at(F.filter(F.array(c), keep), F.lit(1))


def parse_price(c: Column) -> Column:
    """Whole text must be a number once ``$`` and ``,`` are gone."""
    number = first_group(strip(F.regexp_replace(text(c), r"[$,]", "")), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$", 0)
    return number.try_cast("double")


def _present(t: Column) -> Column:
    """The text itself unless it is a word for "no value"."""
    return F.when(~F.lower(t).isin("n/a", "none", "nan"), t)


def parse_float(c: Column) -> Column:
    """First signed decimal in the text after dropping commas."""
    known = let(text(c), _present)
    return first_group(F.regexp_replace(known, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def parse_money(c: Column) -> Column:
    """``parse_float`` that also drops a dollar sign between sign and digits."""
    known = let(text(c), _present)
    return first_group(F.regexp_replace(known, r"[$,]", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def parse_int(c: Column) -> Column:
    """First run of digits (commas allowed inside); sign and decimals are ignored."""
    known = let(text(c), _present)
    return F.regexp_replace(first_group(known, r"\d[\d,]*", 0), ",", "").try_cast("long")


def parse_compact_count(c: Column) -> Column:
    """``4.5k`` / ``1M`` / ``1,234`` to a whole number, truncating."""

    def read(raw: Column) -> Column:
        suffix = F.lower(F.substring(raw, -1, 1))
        digits = F.regexp_replace(raw, "[kKmM]$", "")
        factor = F.when(suffix == "k", 1000.0).when(suffix == "m", 1000000.0).otherwise(1.0)
        return strip(digits).try_cast("double") * factor

    return let(F.regexp_replace(text(c), ",", ""), read).cast("long")


def _rounded(c: Column, scale: int) -> Column:
    """Nearest 1/scale, the same for both signs; amounts that stand exactly between two go to the even one."""

    def step(x: Column) -> Column:
        size = F.abs(x) * scale
        up = F.floor(size + 0.5).cast("double")
        tie = (size - F.floor(size) == 0.5) & (F.abs(x) * 64 == F.floor(F.abs(x) * 64)) & (up % 2 == 1)
        return F.signum(x) * F.when(tie, up - 1).otherwise(up) / scale + 0.0

    return let(c.cast("double"), step)


def round2(c: Column) -> Column:
    """Two decimals by the same IEEE steps in every engine.

    Differs from decimal rounding of the exact binary value only where ``x * 100`` itself rounds to a
    half in binary.
    """
    return _rounded(c, 100)


def round4(c: Column) -> Column:
    return _rounded(c, 10000)


def hundredths(c: Column) -> Column:
    """An amount in hundredths as a decimal of eight further digits, so that sums are exact and do not depend on row order."""
    return (c * 100).cast("decimal(26,8)")


def mean2(c: Column) -> Column:
    """Mean of the raw amounts, ignoring NULL, to two decimals.

    The sum is exact, so a retried task or another partitioning gives the same mean.
    """
    return F.floor(F.sum(hundredths(c)).cast("double") / F.count(c) + 0.5).cast("double") / 100


def weighted_mean(c: Column, weight: Column) -> Column:
    """Mean of the raw amounts under whole-number weights of up to twelve digits, from exact sums."""
    return F.sum(hundredths(c) * weight.cast("decimal(12,0)")).cast("double") / F.sum(weight) / 100
