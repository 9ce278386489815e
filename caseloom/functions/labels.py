"""Text for reports: labels, shortened text, percentages and metrics as column expressions; small parameter parsers.

Defined results: a null stays null in ``month_label`` and ``percent``; a null or blank label is the fallback; a null metric is ``n/a``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "Other / tail"  # fixed value: label of what has none


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def percent(share: Column, decimals: int = 1) -> Column:
    """A share as text, 0.256 as 25.6%."""
    return F.when(share.isNotNull(), F.format_string(f"%.{decimals}f%%", share.cast("double") * 100))


def metric(value: Column) -> Column:
    """Four decimals, or n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.4f", value.cast("double")))


def shorten(text: Column, most: int = 40) -> Column:
    """Text of at most so many characters, three of them dots if any were cut."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def label_or_other(text: Column, other: str = OTHER) -> Column:
    return F.coalesce(F.nullif(F.trim(text.cast("string")), F.lit("")), F.lit(other))


def budget_label(fraction: float) -> str:
    """top_5pct for 0.05."""
    return f"top_{round(fraction * 100, 6):g}pct"


def number_list(text: str, least: float = 0.0) -> list[float]:
    """Numbers of a comma-separated list in order, repeats dropped; an error if none is left or one is not above ``least``."""
    values = list(dict.fromkeys(float(x) for x in text.split(",") if x.strip()))
    if not values or min(values) <= least:
        raise ValueError(f"expected numbers above {least:g}: {text!r}")
    return values


def check_registry(topics: int, labels: dict[int, str], groups: dict[str, list[int]]) -> None:
    """Every topic has a label and stands in exactly one group."""
    expected = set(range(topics))
    placed = [t for members in groups.values() for t in members]
    if set(labels) != expected:
        raise ValueError(f"topics without label, or labels without topic: {sorted(set(labels) ^ expected)}")
    if len(placed) != len(set(placed)) or set(placed) != expected:
        raise ValueError("each topic must stand in exactly one group")
