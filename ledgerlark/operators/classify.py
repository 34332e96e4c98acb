"""Enrichment: jurisdictions, funding timing, bill nature (OP-CLS-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import availability_year, first_year
from ..functions.text import normalized_account
from . import rules


def _first_match(lower: Column, table: list[tuple[str, str]], otherwise: Column) -> Column:
    out = otherwise
    for text, value in reversed(table):  # the first of the table is asked first
        out = F.when(F.contains(lower, F.lit(text)), value).otherwise(out)
    return out


def jurisdiction(title: Column) -> Column:
    """OP-CLS-01: the first rule whose text the title contains; plain health titles; else other."""
    lower = F.lower(F.coalesce(title, F.lit("")))
    plain = F.when((lower == "health") | F.startswith(lower, F.lit("health ")), "labor_hhs").otherwise(F.lit("other"))
    return _first_match(lower, rules.JURISDICTIONS, plain)


def jurisdiction_pattern(title: Column) -> Column:
    """The text that decided, or ``default_rule``."""
    lower = F.lower(F.coalesce(title, F.lit("")))
    plain = F.when((lower == "health") | F.startswith(lower, F.lit("health ")), "health").otherwise(F.lit("default_rule"))
    return _first_match(lower, [(t, t) for t, _ in rules.JURISDICTIONS], plain)


def timing(availability: Column, raw_text: Column, notes: Column, fiscal_years: Column) -> tuple[Column, Column, Column]:
    """OP-CLS-02: timing, available_fy and what decided: dates first, then notes, then words, then later years (T-35)."""
    bill_fy, text = F.array_max(fiscal_years), F.concat_ws(" ", F.coalesce(availability, F.lit("")), F.coalesce(raw_text, F.lit("")))
    dated = F.coalesce(availability_year(availability), availability_year(raw_text))
    noted = F.exists(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.contains(F.lower(n), F.lit("supplemental")))
    named = F.contains(F.lower(text), F.lit("advance appropriation"))
    later = first_year(text, r"(?i)fiscal\s+year\s+(\d{4})")
    none = F.lit(None).cast("int")
    kind = F.when(bill_fy.isNull(), "current_year").when(dated.isNotNull(), F.when(dated > bill_fy, "advance").otherwise("current_year")).when(noted, "supplemental").when(named, "advance").when(later > bill_fy, "unknown").otherwise("current_year")
    year = F.when(bill_fy.isNull(), none).when(dated.isNotNull(), dated).when(noted | named, none).when(later > bill_fy, later)
    source = F.when(bill_fy.isNull(), "default_rule").when(dated.isNotNull(), "fiscal_year_comparison").when(noted, "note_text").when(named, "pattern_match").otherwise("default_rule")
    return kind, year, source


def timings(view: DataFrame) -> DataFrame:
    """Timing of each appropriation of new budget authority."""
    kind, year, source = timing(F.col("availability"), F.col("raw_text"), F.col("notes"), F.col("fiscal_years"))
    rows = view.where("provision_type = 'appropriation' and semantics = 'new_budget_authority'")
    return rows.select("bill_dir", "provision_index", kind.alias("timing"), year.alias("available_fy"), source.alias("source"))


def bill_nature(view: DataFrame, divisions: DataFrame) -> DataFrame:
    """OP-CLS-03: (bill_dir, bill_nature). ``divisions``: (bill_dir, division, jurisdiction).

    Five real subcommittees make an omnibus, two a minibus; a continuing baseline among more than fifty appropriations
    a full-year one; else the stated classification.
    """
    types = view.groupBy("bill_dir").agg(F.count_if(F.col("provision_type") == "appropriation").alias("appropriations"), F.count_if(F.col("provision_type") == "continuing_resolution_baseline").alias("baselines"), F.first("classification").alias("stated"))
    real = divisions.groupBy("bill_dir").agg(F.count_if(~F.col("jurisdiction").isin(*rules.NOT_SUBCOMMITTEES)).alias("real"))
    stated = F.lower(F.coalesce("stated", F.lit("")))
    kept = stated.isin("regular", "continuing_resolution", "omnibus", "minibus", "supplemental", "rescissions")
    fallback = F.when(kept, stated).when(F.contains(stated, F.lit("supplemental")), "supplemental").when(F.contains(stated, F.lit("authorization")), "authorization").otherwise(F.col("stated"))
    count = F.coalesce("real", F.lit(0))
    nature = F.when(count >= 5, "omnibus").when(count >= 2, "minibus").when((F.col("baselines") > 0) & (F.col("appropriations") > 50), "full_year_cr_with_appropriations").otherwise(fallback)
    return types.join(real, "bill_dir", "left").select("bill_dir", nature.alias("bill_nature"))


def canonical_accounts(view: DataFrame) -> DataFrame:
    return view.where("account_name <> ''").select("bill_dir", "provision_index", normalized_account(F.col("account_name")).alias("canonical_name"))


def enriched(view: DataFrame, division_titles: DataFrame) -> dict[str, DataFrame]:
    """OP-CLS-04: all sidecar tables. ``division_titles``: (bill_dir, division, title)."""
    divisions = division_titles.select("bill_dir", "division", "title", jurisdiction(F.col("title")).alias("jurisdiction"), jurisdiction_pattern(F.col("title")).alias("source"))
    return {"subcommittees": divisions, "provision_timing": timings(view), "canonical_accounts": canonical_accounts(view), "bill_nature": bill_nature(view, divisions)}


def to_enrich(bills: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """OP-ENR-01: bills without a sidecar yet, or all."""
    return bills if force else bills.join(done.select("bill_dir"), "bill_dir", "left_anti")


def naive_timing(raw_text: Column) -> Column:
    """OP-RES-03: the keyword rule that the year-aware one is held against."""
    lower = F.lower(raw_text)
    return F.when(F.contains(lower, F.lit("advance")) | F.contains(lower, F.lit("shall become available on october 1")), "advance").otherwise("current_year")


def confusion(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """OP-RES-03/06: counts of (expected, actual); what is missing on the right is null."""
    return expected.select(*key, F.col(value).alias("expected")).join(actual.select(*key, F.col(value).alias("actual")), key, "left").groupBy("expected", "actual").agg(F.count("*").alias("n"))
