"""Totals per bill and department, current-year against advance money, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import dollars, is_budget_authority, is_rescission
from ..functions.text import parent_department


def totals(view: DataFrame) -> DataFrame:
    """OP-AGG-01/02: per bill: provisions, budget authority, rescissions (of their size), net."""
    ba = F.sum(F.when(is_budget_authority(), dollars()).otherwise(0))
    cut = F.sum(F.when(is_rescission(), F.abs(dollars())).otherwise(0))
    return view.groupBy("bill_dir", "identifier").agg(F.count("*").alias("provisions"), ba.alias("budget_authority"), cut.alias("rescissions"), (ba - cut).alias("net_ba"))


def summarized(view: DataFrame, bills: DataFrame, timings: DataFrame) -> DataFrame:
    """OP-AGG-02: totals with classification, completeness and the advance split; bills without provisions stay."""
    about = bills.select("bill_dir", "identifier", "congress", "fiscal_years", F.coalesce("meta.bill_nature", "classification").alias("classification"), F.col("verification.counts.completeness_pct").alias("completeness_pct"))
    counts = totals(view).drop("identifier")
    split = advance_split(view, timings).drop("identifier")
    return about.join(counts, "bill_dir", "left").join(split, "bill_dir", "left").fillna(0, ["provisions", "budget_authority", "rescissions", "net_ba"])


def advance_split(view: DataFrame, timings: DataFrame) -> DataFrame:
    """OP-AGG-03/JOIN-02: advance money against all other timings; provisions without a timing are in neither (T-7)."""
    rows = view.where(is_budget_authority()).drop("timing").join(timings.select("bill_dir", "provision_index", "timing"), ["bill_dir", "provision_index"])
    part = lambda c: F.sum(F.when(c, dollars()).otherwise(0))
    return rows.groupBy("bill_dir", "identifier").agg(part(F.col("timing") != "advance").alias("current_year_ba"), part(F.col("timing") == "advance").alias("advance_ba"))


def timing_breakdown(view: DataFrame, timings: DataFrame) -> DataFrame:
    """OP-AGG-25/RES-09: per bill the four timings; here only *current_year* counts as current."""
    rows = view.where(is_budget_authority()).drop("timing").join(timings.select("bill_dir", "provision_index", "timing"), ["bill_dir", "provision_index"])
    part = lambda *t: F.sum(F.when(F.col("timing").isin(*t), dollars()).otherwise(0))
    total = F.sum(dollars())
    return rows.groupBy("bill_dir").agg(part("current_year").alias("current_year"), part("advance").alias("advance"), part("supplemental").alias("supplemental"), (total - part("current_year", "advance", "supplemental")).alias("other"), F.when(total != 0, F.round(part("advance") / total * 100, 6)).otherwise(0.0).alias("advance_pct"))


def by_department(view: DataFrame) -> DataFrame:
    """OP-AGG-04: per parent department, largest first; any detail level counts (T-1)."""
    rows = view.where("agency <> ''").select(parent_department(F.col("agency")).alias("department"), "provision_type", "semantics", "detail_level", "dollars")
    ba = F.sum(F.when(F.col("semantics") == "new_budget_authority", dollars()).otherwise(0))
    return rows.groupBy("department").agg(ba.alias("budget_authority"), F.sum(F.when(is_rescission(), F.abs(dollars())).otherwise(0)).alias("rescissions"), F.count("*").alias("provision_count")).orderBy(F.desc("budget_authority"), "department")


def audit(view: DataFrame, amount_checks: DataFrame, text_checks: DataFrame, completeness: DataFrame) -> DataFrame:
    """OP-AGG-05/09: per bill the counts of check results; zeros where a bill has none."""
    count = lambda c, *v: F.count_if(F.col(c).isin(*v))
    amounts = amount_checks.groupBy("bill_dir").agg(count("status", "verified").alias("amounts_verified"), count("status", "not_found").alias("amounts_not_found"), count("status", "ambiguous").alias("amounts_ambiguous"))
    texts = text_checks.groupBy("bill_dir").agg(*[count("match_tier", t).alias(f"raw_text_{t}") for t in ("exact", "normalized", "spaceless", "no_match")])
    bills = view.groupBy("bill_dir", "identifier").agg(F.count("*").alias("total_provisions"))
    return bills.join(amounts, "bill_dir", "left").join(texts, "bill_dir", "left").join(completeness.select("bill_dir", "completeness_pct"), "bill_dir", "left").fillna(0)


def with_grand_total(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """OP-AGG-08: the rows by key and their total, whose key is ``TOTAL``."""
    return rows.rollup(key).agg(F.grouping(key).alias("__all"), *[F.sum(m).alias(m) for m in measures]).select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(key)).alias(key), *measures)


def semantics_warning(view: DataFrame) -> DataFrame:
    """OP-SNK-07: counts per semantics and the budget authority in a mixed export."""
    return view.groupBy("semantics").agg(F.count("*").alias("provisions"), F.sum(F.when(F.col("semantics") == "new_budget_authority", dollars()).otherwise(0)).alias("budget_authority"))


def incomplete(audited: DataFrame, least: float = 50.0) -> DataFrame:
    """OP-FLT-20."""
    return audited.where(F.col("completeness_pct") < least)
