"""Cleaning expressions.  Missing is NULL throughout: NaN and infinities become NULL on entry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SUPPRESSED_AT_OR_BELOW = -999000.0  # fixed value: suppression sentinels are -999999


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, else the double itself."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def key_text(c: Column, upper: bool = False) -> Column:
    """Trimmed key text, upper-cased on request; NULL stays NULL."""
    text = F.trim(c.cast("string"))
    return F.upper(text) if upper else text


def to_day(c: Column, fmt: str | None = None) -> Column:
    """Date, or NULL where the text does not parse."""
    if fmt is None:
        return F.try_to_timestamp(c.cast("string")).cast("date")
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("date")


def compact_day(c: Column) -> Column:
    """Date from ``yyyyMMdd`` text or number, also when a trailing ``.0`` was read with it."""
    return to_day(F.regexp_replace(c.cast("string"), r"\.0$", ""), "yyyyMMdd")


def to_number(c: Column) -> Column:
    """Finite double, or NULL where the text is not a number."""
    return finite(c.cast("string").try_cast("double"))


def unsuppress(c: Column) -> Column:
    """NULL for suppression sentinels."""
    return F.when(c > SUPPRESSED_AT_OR_BELOW, c)


def per(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def bounded_ratio(numerator: Column, denominator: Column, upper: float = 2.0) -> Column:
    """Quotient, NULL unless the denominator is positive and the result lies in [0, upper]."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.when((denominator > 0) & ratio.between(0.0, upper), ratio)


def digits(c: Column, width: int | None = None) -> Column:
    """First run of digits, zero-padded on the left to ``width`` but never cut."""
    found = F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit(""))
    if width is None:
        return found
    return F.when(F.length(found) < width, F.lpad(found, width, "0")).otherwise(found)


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value for a key from a small fixed table (tens of entries), else ``default``."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hit = F.try_element_at(pairs, c)
    return hit if default is None else F.coalesce(hit, default)


def one_hot(c: Column, levels: list, prefix: str) -> dict[str, Column]:
    """0/1 columns per level; a level outside the list gives zeros everywhere."""
    return {
        f"{prefix}_{level}": F.coalesce((c == F.lit(level)).cast("double"), F.lit(0.0))
        for level in levels
    }


def composite_key(*cols: Column) -> Column:
    return F.concat_ws("__", *cols)


# Word replacements applied in this order before comparing facility names.
NAME_REPLACEMENTS = [
    (r"&", " and "),
    (r"\buniversity\b", " univ "),
    (r"\bmedical center\b", " med center "),
    (r"\bmedical centre\b", " med center "),
    (r"\bhospital\b", " hosp "),
    (r"\bhealthcare\b", " health care "),
    (r"\bsaint\b", " st "),
    (r"[^a-z0-9]+", " "),
]


def facility_name(c: Column) -> Column:
    """Lower-case name with common words abbreviated and punctuation removed."""
    text = F.lower(c)
    for pattern, replacement in NAME_REPLACEMENTS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)
