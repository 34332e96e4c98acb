"""Reports over the provisions view (OP-AGG-19 to 39, OP-WIN-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dollars, is_budget_authority, is_rescission


def by_agency(view: DataFrame) -> DataFrame:
    """OP-AGG-19/WIN-02: budget authority by agency and its share of all, in percent."""
    rows = view.where(is_budget_authority()).groupBy(F.when(F.col("agency") == "", "Unknown").otherwise(F.col("agency")).alias("agency")).agg(F.sum(dollars()).alias("budget_authority"))
    return rows.withColumn("share_pct", F.col("budget_authority") / F.sum("budget_authority").over(Window.partitionBy()) * 100)


def scorecard(view: DataFrame, jurisdictions: DataFrame, years: list[int]) -> DataFrame:
    """OP-AGG-20/JOIN-03: budget authority by jurisdiction and fiscal year (a bill's latest), a column per year."""
    rows = view.where(is_budget_authority()).join(jurisdictions.select("bill_dir", "division", "jurisdiction"), ["bill_dir", "division"], "left")
    keyed = rows.select(F.coalesce("jurisdiction", F.lit("other")).alias("jurisdiction"), F.array_max("fiscal_years").alias("fy"), dollars().alias("d"))
    pivoted = keyed.groupBy("jurisdiction").pivot("fy", years).agg(F.sum("d"))
    return pivoted.select("jurisdiction", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"fy{y}") for y in years])


def defense_trend(view: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """OP-AGG-21: defense and other budget authority by fiscal year."""
    rows = view.where(is_budget_authority()).join(jurisdictions.select("bill_dir", "division", "jurisdiction"), ["bill_dir", "division"], "left")
    is_defense = F.coalesce(F.col("jurisdiction") == "defense", F.lit(False))
    per = rows.groupBy(F.array_max("fiscal_years").alias("fy")).agg(F.sum(F.when(is_defense, dollars()).otherwise(0)).alias("defense"), F.sum(F.when(is_defense, 0).otherwise(dollars())).alias("non_defense"))
    total = F.col("defense") + F.col("non_defense")
    return per.withColumn("defense_pct", F.when(total != 0, F.col("defense") / total * 100).otherwise(0.0))


def cr_impact(view: DataFrame) -> DataFrame:
    """OP-AGG-22/PRJ-17: substitutions per bill: cuts, increases and net; missing amounts are zero."""
    delta = F.coalesce("dollars", F.lit(0)) - F.coalesce("old_dollars", F.lit(0))
    rows = view.where("provision_type = 'cr_substitution'").select("bill_dir", delta.alias("delta"))
    return rows.groupBy("bill_dir").agg(F.count("*").alias("substitutions"), F.sum(F.when(F.col("delta") < 0, F.col("delta")).otherwise(0)).alias("cuts"), F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("increases"), F.sum("delta").alias("net"))


def type_histogram(view: DataFrame) -> DataFrame:
    """OP-AGG-23."""
    return view.groupBy("provision_type").agg(F.count("*").alias("provisions")).orderBy(F.desc("provisions"), "provision_type")


def detail_levels(view: DataFrame) -> DataFrame:
    """OP-AGG-09: provisions by detail level; *unspecified* for appropriations without one, *n/a* for other types."""
    level = F.when(F.col("provision_type") != "appropriation", "n/a").when(F.col("detail_level") == "", "unspecified").otherwise(F.col("detail_level"))
    return view.groupBy(level.alias("detail_level")).agg(F.count("*").alias("provisions"))


def treemap(view: DataFrame, titles: DataFrame) -> DataFrame:
    """OP-AGG-33: positive budget authority by division title, agency and account, names cut before grouping."""
    rows = view.where(is_budget_authority() & (F.col("dollars") > 0)).join(titles.select("bill_dir", "division", "division_title"), ["bill_dir", "division"], "left")
    return rows.groupBy(F.left(F.coalesce("division_title", F.lit("Other")), F.lit(50)).alias("jurisdiction"), F.left("agency", F.lit(50)).alias("agency"), F.left("account_name", F.lit(60)).alias("account")).agg(F.sum("dollars").alias("budget_authority"))


def verification_heatmap(audited: DataFrame) -> DataFrame:
    """OP-AGG-34: each count over the bill's provisions in percent; bills without provisions are left out."""
    metrics = ["amounts_verified", "amounts_ambiguous", "amounts_not_found", "raw_text_exact", "raw_text_normalized", "raw_text_spaceless", "raw_text_no_match"]
    return audited.where("total_provisions > 0").select("bill_dir", *[(F.col(m) / F.col("total_provisions") * 100).alias(f"{m}_pct") for m in metrics])


def top_trends(years: DataFrame, top: int = 6, first: int = 2019, last: int = 2026) -> DataFrame:
    """OP-AGG-31/35/SORT-09: yearly dollars of the accounts with the largest totals, where positive."""
    best = years.groupBy("fas_code").agg(F.sum("total_dollars").alias("t")).orderBy(F.desc("t"), "fas_code").limit(top).select("fas_code")
    return years.join(F.broadcast(best), "fas_code").where(F.col("fy").between(first, last) & (F.col("total_dollars") > 0)).select("fas_code", "fy", "total_dollars")


def first_to_last(years: DataFrame) -> DataFrame:
    """OP-WIN-03: per code the first and last year's nonzero dollars and the change in percent."""
    rows = years.where("total_dollars <> 0").groupBy("fas_code").agg(F.min_by("total_dollars", "fy").alias("first_dollars"), F.max_by("total_dollars", "fy").alias("last_dollars"), F.min("fy").alias("first_fy"), F.max("fy").alias("last_fy"))
    return rows.withColumn("change_pct", (F.col("last_dollars") - F.col("first_dollars")) / F.abs("first_dollars") * 100)


def biggest(view: DataFrame, provision_type: str, top: int) -> DataFrame:
    """OP-AGG-36/37: the largest provisions of a type."""
    return view.where(F.col("provision_type") == provision_type).orderBy(F.desc(F.abs("dollars")), "bill_dir", "provision_index").limit(top).select("account_name", F.abs("dollars").alias("dollars"), "bill_dir", "provision_index")


def big_ticket(view: DataFrame, least: int = 50_000_000_000) -> DataFrame:
    """OP-AGG-39."""
    return view.where(F.abs("dollars") >= least)


def earmarks(view: DataFrame) -> DataFrame:
    """OP-FLT-19: directed spending, and named recipients inside other provisions."""
    directed = view.where("provision_type = 'directed_spending'").select("bill_dir", "provision_index", F.col("earmark.recipient").alias("recipient"), "dollars")
    nested = view.select("bill_dir", "provision_index", F.explode("earmarks.recipient").alias("recipient"), "dollars").where("recipient <> ''")
    return directed.unionByName(nested)


def summary_card(view: DataFrame) -> DataFrame:
    """OP-AGG-29: one row on the whole data set."""
    return view.agg(F.count_distinct("bill_dir").alias("bills"), F.count("*").alias("provisions"), F.sum(F.when(is_budget_authority(), dollars()).otherwise(0)).alias("budget_authority"), F.sum(F.when(is_rescission(), F.abs(dollars())).otherwise(0)).alias("rescissions"), F.count_distinct(F.when(F.col("agency") != "", F.col("agency"))).alias("agencies"), F.count_distinct(F.when(F.col("account_name") != "", F.col("account_name"))).alias("accounts"))


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """OP-AGG-17/WIN-06: from (bill_dir, ord, n_provisions): each chunk's range of provision indices, in numeric order."""
    upto = F.sum("n_provisions").over(Window.partitionBy("bill_dir").orderBy("ord"))
    return chunks.select("bill_dir", "ord", (upto - F.col("n_provisions")).alias("first_index"), upto.alias("end_index"))


def type_division_counts(view: DataFrame) -> DataFrame:
    """OP-AGG-17: counts by type and by division (``?`` where there is none)."""
    return view.groupBy("bill_dir", "provision_type", F.when(F.col("division") == "", "?").otherwise(F.col("division")).alias("division")).agg(F.count("*").alias("provisions"))


def code_quality(mappings: DataFrame) -> DataFrame:
    """OP-AGG-24: per confidence the provisions and their share."""
    per = mappings.groupBy("confidence").agg(F.count("*").alias("provisions"))
    return per.withColumn("share_pct", F.col("provisions") / F.sum("provisions").over(Window.partitionBy()) * 100)


def available_years(view: DataFrame) -> DataFrame:
    """OP-SET-07."""
    return view.select(F.explode("fiscal_years").alias("fy")).distinct()


def token_rate(events: DataFrame, *, key: str = "user_id", at: str = "ts", value: str = "value", seconds: int = 10) -> DataFrame:
    """OP-WIN-07: at each event the rise of ``value`` a second over the last ``seconds``, rounded down; null with one
    event or less than a second in the window. Events of one instant count in the order of their values."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.select(key, at, value, t.alias("t"))
    w = Window.partitionBy(key).orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    first, span = F.min(F.struct("t", value)).over(w), F.col("t") - F.min("t").over(w)
    rise = F.greatest(F.max(F.struct("t", value)).over(w)[value] - first[value], F.lit(0.0))
    return rows.select(key, at, value, F.when((F.count("*").over(w) >= 2) & (span >= 1_000_000), F.floor(rise / (span / 1e6))).alias("rate"))
