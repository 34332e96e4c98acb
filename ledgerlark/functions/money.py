"""Amounts, fiscal years and inflation as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTOBER, _QUARTER = r"(?i)October\s+1\s*,?\s*(\d{4})", r"(?i)first\s+quarter\s+of\s+fiscal\s+year\s+(\d{4})"


def first_year(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1).try_cast("int")


def availability_year(text: Column) -> Column:
    """OP-DATE-01: ``October 1, Y`` is fiscal year Y + 1; else ``first quarter of fiscal year Y`` is Y; else null."""
    return F.coalesce(first_year(text, _OCTOBER) + 1, first_year(text, _QUARTER))


def fiscal_year(day: Column) -> Column:
    """OP-DATE-02: October to December belong to the next year."""
    return F.year(F.add_months(day, 3))


def is_stale(retrieved: Column, today: Column | None = None, days: int = 60) -> Column:
    """OP-DATE-03: older than ``days``."""
    return F.coalesce(F.datediff(today if today is not None else F.current_date(), retrieved) > days, F.lit(False))


def delta_pct(base: Column, current: Column) -> Column:
    """OP-MATH-01: null where the base is zero."""
    return F.when(base != 0, (current - base) / base * 100)


def real_delta_pct(nominal: Column, inflation: Column) -> Column:
    """OP-MATH-02."""
    return ((1 + nominal / 100) / (1 + inflation) - 1) * 100


def inflation_flag(nominal: Column, inflation: Column) -> Column:
    """OP-MATH-03: real_increase, real_cut, inflation_erosion or unchanged."""
    real = real_delta_pct(nominal, inflation)
    still = nominal.isNull() | ((F.abs(nominal) < 0.001) & (F.abs(inflation) < 0.001))
    return F.when(still, "unchanged").when(real > 0.05, "real_increase").when((real < -0.05) & (nominal < -0.05), "real_cut").when(real < -0.05, "inflation_erosion").otherwise("unchanged")


def is_budget_authority(any_detail: bool = False) -> Column:
    """OP-FLT-12 over the provisions view; ``any_detail`` keeps sub-allocations and proviso amounts (T-1)."""
    kind = (F.col("provision_type") == "appropriation") & (F.col("semantics") == "new_budget_authority")
    return kind if any_detail else kind & ~F.col("detail_level").isin("sub_allocation", "proviso_amount")


def is_rescission() -> Column:
    return (F.col("provision_type") == "rescission") & (F.col("semantics") == "rescission")


def dollars() -> Column:
    """T-2: missing amounts add nothing."""
    return F.coalesce(F.col("dollars"), F.lit(0))
