"""Number cleaners (C01 basic, C02 locale-aware) as native expressions.

Spark's ``try_cast('12f' as double)`` is 12.0, so every cast is gated by a
strict decimal regex first; text ``inf``/``nan`` never parse (deviation D10).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .text import _c, strip_ws

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Signs and blanks that may stand in a number.
DROPPED = "€$£% \t\n\x0b\f\r\u00a0\u202f"
SCI_RE = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"
PLAIN_RE = r"^-?(\d+\.?\d*|\.\d+)$"


def _to_double_gated(s: Column, regex: str) -> Column:
    # the cheap cast first (fails fast on text), the exact regex gate second
    d = s.try_cast("double")
    return F.when(d.isNotNull() & s.rlike(regex), d)


def clean_number_basic(col) -> Column:
    """Trim, comma -> dot, parse or NULL."""
    s = F.replace(strip_ws(_c(col).cast("string")), F.lit(","), F.lit("."))
    return _to_double_gated(s, NUM_RE)


def clean_number_locale(col) -> Column:
    """C02 (documented intent, D3).

    Currency signs, percent and blanks are dropped; a scientific literal is
    parsed as is; otherwise everything but digits, separators and minus is
    stripped, then: with both ``,`` and ``.`` the last one is the decimal
    mark; a repeated single separator is a thousands mark; a lone one is the
    decimal mark.
    """
    text = _c(col).cast("string")
    without = lambda x, characters: F.call_function("translate", x, characters, F.lit(""))
    let = lambda x, body: F.transform(F.array(x), body)[0]  # noqa: E731  x is computed once, whatever body does with it

    def parsed(s0: Column) -> Column:
        # everything that is not wanted, as the characters to be removed
        s1 = without(s0, without(s0, F.lit("0123456789.,-")))
        return F.when(s0.rlike(SCI_RE), s0.try_cast("double")).otherwise(let(s1, separated))

    def separated(s1: Column) -> Column:
        drop_dots, drop_commas = F.replace(s1, F.lit("."), F.lit("")), F.replace(s1, F.lit(","), F.lit(""))
        has_comma, has_dot = F.contains(s1, F.lit(",")), F.contains(s1, F.lit("."))
        many = lambda c: F.substring_index(s1, c, 2) != s1  # noqa: E731  the mark occurs more than once
        comma_last = F.locate(".", F.substring_index(s1, ",", -1)) == 0
        norm = (
            F.when(has_comma & has_dot & comma_last, F.replace(drop_dots, F.lit(","), F.lit(".")))
            .when(has_comma & has_dot, drop_commas)
            .when(has_comma & many(","), drop_commas)
            .when(has_comma, F.replace(s1, F.lit(","), F.lit(".")))
            .when(has_dot & many("."), drop_dots)
            .otherwise(s1))
        return let(norm, lambda x: _to_double_gated(x, PLAIN_RE))

    # a plain number needs none of this
    plain = F.when(text.rlike(PLAIN_RE), text.try_cast("double"))
    return F.coalesce(plain, let(without(text, F.lit(DROPPED)), parsed))
