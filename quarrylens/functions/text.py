"""Column expressions shared by the operators.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.spec import NA_TOKENS

_EDGE_WS = r"^\s+|\s+$"
_EDGE_QUOTES = r'^"+|"+$'


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Whitespace strip on both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(col_(c), _EDGE_WS, "")


def clean_string(c) -> Column:
    """Strip whitespace, then surrounding quotes; NA tokens become null."""
    s = F.regexp_replace(strip_ws(c), _EDGE_QUOTES, "")
    return F.when(s.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(s)


def invalid_code(c) -> Column:
    """Null, blank after strip, or '?'."""
    return F.coalesce(strip_ws(col_(c).cast("string")), F.lit("")).isin("", "?")


def canonical_code(c, width: int = 2) -> Column:
    """M1: string, strip, left zero-pad to ``width`` without truncating."""
    s = strip_ws(col_(c).cast("string"))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def first_number(c, digits: int = 18) -> Column:
    """First number of at most ``digits`` digits after removing thousands
    commas. 18 is what a bigint holds; 6 is the original's limit, which
    misses counts of a million and more."""
    found = F.regexp_extract(F.regexp_replace(col_(c), ",", ""), rf"\b(\d{{1,{digits}}})\b", 1)
    return F.when(found == "", F.lit(None)).otherwise(found).cast("bigint")


def all_numbers(c, digits: int = 18) -> Column:
    """Every number of at most ``digits`` digits (commas removed) as an array
    of bigint."""
    found = F.regexp_extract_all(F.regexp_replace(col_(c), ",", ""), F.lit(rf"\b(\d{{1,{digits}}})\b"), 1)
    return F.transform(found, lambda x: x.cast("bigint"))


def after_first_marker(c, markers) -> Column:
    """Q6: text after the first marker found (markers tried in order), stripped.

    Falls back to the whole stripped text when no marker occurs.
    """
    text = col_(c)
    low = F.lower(text)
    out = strip_ws(text)
    for marker in reversed(list(markers)):
        pos = F.instr(low, marker)
        out = F.when(pos > 0, strip_ws(F.substring(text, pos + len(marker), 1 << 30))).otherwise(out)
    return out


def after_last_marker(c, markers) -> Column:
    """Q6: text after that marker whose first occurrence ends last, stripped;
    the whole stripped text when none occurs. A marker that only introduces
    another one ("similar to this narrative snippet: ...") is passed over."""
    text = col_(c)
    low = F.lower(text)
    ends = [F.when(F.instr(low, m) > 0, F.instr(low, m) + len(m)).otherwise(1) for m in markers]
    return strip_ws(F.substring(text, F.greatest(*ends), F.lit(1 << 30)))


def any_of(cols) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def all_of(cols) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def md5_order(*parts) -> Column:
    """Deterministic pseudo-random order key: md5 of the '|'-joined parts."""
    return F.md5(F.concat_ws("|", *[col_(p).cast("string") if not isinstance(p, Column) else p for p in parts]))
