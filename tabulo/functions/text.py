"""Text scalar expressions (native Column expressions, no UDF).

Accent stripping is a ``translate`` with FROM/TO strings generated once from
``unicodedata`` (canonical decomposition, combining marks dropped), followed by
a regex that removes stand-alone combining marks.  Characters whose
decomposition keeps more than one base character (e.g. Hangul syllables) are
left unchanged.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_TRIM = r"^\s+|\s+$"

# Tokens read as "empty" by the category cleaner (C09),
# compared after trim + lower-case.
EMPTY_TOKENS = ["", "nan", "null", "none", "?", "inconnu", "-", "--"]


@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def qname(name: str) -> str:
    """Backtick-quoted column reference that survives dots and backticks in names."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    return F.col(qname(name))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()`` for the usual whitespace."""
    return F.regexp_replace(_c(col), WS_TRIM, "")


def strip_accents(col) -> Column:
    src, dst = accent_table()
    return F.regexp_replace(F.translate(_c(col), src, dst), r"\p{Mn}+", "")


def normalize_category(col) -> Column:
    """Trim, empty -> NULL, strip accents, lower-case."""
    s = strip_ws(_c(col).cast("string"))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(strip_ws(F.lower(strip_accents(s))))


def empty_to_null(col) -> Column:
    """Trimmed value, NULL when it is one of the empty tokens."""
    s = strip_ws(_c(col).cast("string"))
    return F.when(F.lower(s).isin(*EMPTY_TOKENS), F.lit(None).cast("string")).otherwise(s)
