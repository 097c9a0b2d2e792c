"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: Column | str) -> Column:
    """The number, or null where it is 0."""
    return F.nullif(col(c), F.lit(0.0))


def filled(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(col(c), F.lit(""))


def finite(c: Column | str) -> Column:
    return col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(float("inf")))


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+\z", "")


def half_up(c: Column | str, digits: int) -> Column:
    """Rounded to digits with halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(col(c) * scale + 0.5) / F.lit(scale)


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """part of whole in percent, 0 where the whole is 0."""
    return F.when(col(whole) > 0, half_up(col(part) / F.nullif(col(whole), F.lit(0.0)) * 100, digits)).otherwise(0.0)


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def fmt_compact(c: Column | str, sign: str = "$") -> Column:
    """1.2B, 3.4M, 5.6K; 'No data' for what isn't a finite number."""
    n = col(c).cast("double")
    short = lambda by, unit: F.concat(F.lit(sign), F.format_string("%.1f", n / F.lit(by)), F.lit(unit))
    small = F.concat(F.lit(sign), F.format_string("%.2f" if sign else "%.0f", n))
    return F.when(~finite(n), "No data").when(n >= 1e9, short(1e9, "B")).when(n >= 1e6, short(1e6, "M")).when(n >= 1e3, short(1e3, "K")).otherwise(small)


def fmt_grouped(c: Column | str) -> Column:
    return F.format_number(col(c), 0)


def fmt_price(c: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(c), 3))


def fmt_pct(c: Column | str) -> Column:
    return F.concat(F.format_number(col(c), 2), F.lit("%"))


def clean_numeric(c: Column | str, fallback: float = 0.0) -> Column:
    """The number at the start of a text, or fallback."""
    head = F.regexp_extract(trimmed(c), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.coalesce(F.nullif(head, F.lit("")).try_cast("double"), F.lit(fallback))


def first_valid(*cs: Column | str) -> Column:
    """The first of the numbers that is neither null nor 0."""
    return F.coalesce(*[truthy(c) for c in cs])


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
