"""Comparison of accounts between two sets of bills (OP-CMP-*, OP-JOIN-04 to 08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import delta_pct, dollars, inflation_flag, is_budget_authority, real_delta_pct
from ..functions.text import normalized_account
from .containment import either

GROUPS, ALIASES = "ord int, canonical string, member string", "ord int, canonical string, alias string"


def keyed(view: DataFrame, groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """OP-JOIN-14: ``k_agency`` and ``k_account``, by the rules where one fits (the first group wins), and ``ruled``."""
    first = lambda t, c: F.broadcast(t.select(F.lower(c).alias("__m"), "ord", F.lower("canonical").alias("__c")).groupBy("__m").agg(F.min_by("__c", "ord").alias("__c")))
    shown = view.withColumn("agency_shown", F.when(F.col("agency") == "", "(unknown)").otherwise(F.col("agency")))
    named = shown.withColumn("__m", F.trim(F.lower("agency_shown"))).join(first(groups, "member"), "__m", "left")
    named = named.select(*shown.columns, F.coalesce("__c", "__m").alias("k_agency"), F.col("__c").isNotNull().alias("ruled")).withColumn("__m", normalized_account(F.col("account_name")))
    # an alias rule's own name goes through the same normalisation, as keys that differ by a dash prefix are one (T-9)
    return named.join(first(aliases, "alias"), "__m", "left").select(*shown.columns, "k_agency", "ruled", normalized_account(F.coalesce("__c", "__m")).alias("k_account"))


def account_totals(base: DataFrame, current: DataFrame) -> DataFrame:
    """OP-AGG-06/07: per key and side (b, c) the sum, the names of the first provision that counts, and the sum under any
    semantics; all of both sides in one aggregation. Sums are null where a side has no such provision."""
    wide = F.col("provision_type").isin("appropriation", "limitation") & (F.col("amount_kind") != "")
    at = F.struct("identifier", "bill_dir", "provision_index")
    side = lambda rows, name: rows.select("k_agency", "k_account", F.lit(name).alias("side"), dollars().alias("d"), is_budget_authority(any_detail=True).alias("counts"), wide.alias("wide"), at.alias("at"), F.struct("agency_shown", "account_name", "ruled").alias("names"))
    part = lambda s: [F.sum(F.when((F.col("side") == s) & F.col("counts"), F.col("d"))).alias(s), F.sum(F.when((F.col("side") == s) & F.col("wide"), F.col("d"))).alias(f"{s}w"), F.min_by("names", F.when((F.col("side") == s) & F.col("counts"), F.col("at"))).alias(f"{s}f")]
    return side(base, "b").unionByName(side(current, "c")).where("counts or wide").groupBy("k_agency", "k_account").agg(*part("b"), *part("c"))


def status(base: Column, current: Column) -> Column:
    """By value, not by presence (T-8)."""
    return F.when(base == 0, "only in current").when(current == 0, "only in base").when(base == current, "unchanged").otherwise("changed")


def compare(base: DataFrame, current: DataFrame, groups: DataFrame, aliases: DataFrame, *, agency: str | None = None, rescue: bool = True) -> DataFrame:
    """OP-CMP-01: accounts with base and current dollars, delta, delta_pct, status, normalized; keys as k_agency, k_account.

    Accounts at zero on both sides are dropped. With ``rescue`` an account on one side only that the other side has
    under any semantics is *reclassified* and takes that sum (OP-JOIN-06).
    """
    sides = [keyed(view, groups, aliases) for view in (base, current)]
    if agency is not None:
        sides = [rows.where(F.contains(F.lower("agency_shown"), F.lit(agency.lower()))) for rows in sides]
    both, key = account_totals(*sides), ["k_agency", "k_account"]
    rows = both.select(
        *key,
        F.coalesce("bf.account_name", "cf.account_name").alias("account_name"),
        F.coalesce("bf.agency_shown", "cf.agency_shown").alias("agency"),
        F.coalesce("b", F.lit(0)).alias("base_dollars"),
        F.coalesce("c", F.lit(0)).alias("current_dollars"),
        (F.coalesce("bf.ruled", F.lit(False)) | F.coalesce("cf.ruled", F.lit(False))).alias("normalized"),
        "bw",
        "cw",
    ).where("base_dollars <> 0 or current_dollars <> 0")
    rows = rows.withColumn("status", status(F.col("base_dollars"), F.col("current_dollars")))
    if rescue:
        lost, new = (F.col("status") == "only in base") & F.col("cw").isNotNull(), (F.col("status") == "only in current") & F.col("bw").isNotNull()
        rows = rows.select(*key, "account_name", "agency", F.when(new, F.col("bw")).otherwise(F.col("base_dollars")).alias("base_dollars"), F.when(lost, F.col("cw")).otherwise(F.col("current_dollars")).alias("current_dollars"), "normalized", F.when(lost | new, "reclassified").otherwise(F.col("status")).alias("status"))
    return with_delta(rows.drop("bw", "cw"))


def with_delta(rows: DataFrame) -> DataFrame:
    return rows.withColumn("delta", F.col("current_dollars") - F.col("base_dollars")).withColumn("delta_pct", delta_pct(F.col("base_dollars"), F.col("current_dollars")))


def ordered(rows: DataFrame) -> DataFrame:
    """OP-SORT-02: largest change first."""
    return rows.orderBy(F.desc(F.abs("delta")), "k_agency", "k_account")


def with_inflation(rows: DataFrame, rate: float) -> DataFrame:
    """OP-CMP-03: real change, rounded to one place, and the flag; later rescues leave both as they are (T-10)."""
    return rows.withColumn("real_delta_pct", F.round(real_delta_pct(F.col("delta_pct"), F.lit(rate)), 1)).withColumn("inflation_flag", inflation_flag(F.col("delta_pct"), F.lit(rate)))


def inflation_counts(rows: DataFrame) -> DataFrame:
    """OP-AGG-26."""
    return rows.agg(F.count_if(F.col("inflation_flag") == "real_increase").alias("beat_inflation"), F.count_if(F.col("inflation_flag").isin("real_cut", "inflation_erosion")).alias("fell_behind"))


def status_counts(rows: DataFrame) -> DataFrame:
    """OP-AGG-27."""
    return rows.groupBy("status").agg(F.count("*").alias("accounts"))


def rescued_by_code(rows: DataFrame, base_codes: DataFrame, current_codes: DataFrame) -> DataFrame:
    """OP-JOIN-07: an account on one side whose dollars equal a code's sum there takes the code's sum of the other side.

    Codes come as (fas_code, dollars). Of several codes of equal dollars the smallest is taken (T-11).
    """
    shared = base_codes.select("fas_code", F.col("dollars").alias("b")).join(current_codes.select("fas_code", F.col("dollars").alias("c")), "fas_code")
    by_base = shared.groupBy("b").agg(F.min_by("c", "fas_code").alias("to_c"), F.min("fas_code").alias("code_b"))
    by_current = shared.groupBy("c").agg(F.min_by("b", "fas_code").alias("to_b"), F.min("fas_code").alias("code_c"))
    joined = rows.join(by_base, rows.base_dollars == by_base.b, "left").join(by_current, rows.current_dollars == by_current.c, "left")
    lost, new = (F.col("status") == "only in base") & F.col("to_c").isNotNull(), (F.col("status") == "only in current") & F.col("to_b").isNotNull()
    kept = [c for c in rows.columns if c not in ("base_dollars", "current_dollars", "status", "delta", "delta_pct")]
    out = joined.select(*kept, F.when(new, F.col("to_b")).otherwise(F.col("base_dollars")).alias("base_dollars"), F.when(lost, F.col("to_c")).otherwise(F.col("current_dollars")).alias("current_dollars"), F.when(lost | new, "matched (TAS)").otherwise(F.col("status")).alias("status"))
    return with_delta(out)


def relabelled_by_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """OP-JOIN-08: an account on one side becomes *linked* where a link's label and its name contain one another.

    ``links`` (source_label, target_label) holds accepted links whose ends lie in both compared sets. Names and labels meet
    as ``containment.either`` says. Only the status changes.
    """
    orphan = F.col("status").isin("only in base", "only in current")
    rows = rows.withColumn("__n", F.when(orphan, F.lower("account_name")))
    labels = links.select(F.explode(F.array(F.lower("source_label"), F.lower("target_label"))))
    hit = either(rows.select("__n"), labels).select(F.col("name").alias("__n"), F.lit(True).alias("__hit")).distinct()
    # an orphan without a name is within any label
    named = F.coalesce("__hit", (F.col("__n") == "") & F.lit(not labels.where("col <> ''").isEmpty()))
    return rows.join(hit, "__n", "left").withColumn("status", F.when(named, "linked").otherwise(F.col("status"))).drop("__hit", "__n")


def cross_type_warning(base: DataFrame, current: DataFrame) -> str | None:
    """OP-CMP-02: a sentence where the first bills of both sides are of different classes."""
    first = lambda t: t.orderBy("identifier", "bill_dir").select("classification").first()
    b, c = first(base), first(current)
    if b is None or c is None or b[0] == c[0]:
        return None
    return f"Comparing {b[0]} to {c[0]}: accounts on one side only may be expected and need not be policy changes."


def described(bills: DataFrame) -> str:
    """OP-PRJ-15: up to three labels, or the number and the first two; reads three rows and a count."""
    rows = bills.orderBy("identifier", "bill_dir").select("identifier", "congress").limit(3).collect()
    count = bills.count()
    names = [f"{r.identifier} ({r.congress}th)" if r.congress is not None else r.identifier for r in rows]
    return ", ".join(names) if count <= 3 else f"{count} bills ({names[0]}, {names[1]}, ...)"


def movements(rows: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """OP-AGG-38: one row of counts and sums, and the ``top`` rises and falls."""
    up, down = F.col("delta") > 0, F.col("delta") < 0
    base = F.sum("base_dollars")
    card = rows.agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.count_if(F.col("delta") == 0).alias("unchanged"), F.coalesce(F.sum(F.when(up, F.col("delta"))), F.lit(0)).alias("increases"), F.coalesce(F.sum(F.when(down, F.col("delta"))), F.lit(0)).alias("decreases"), F.when(base != 0, F.sum("delta") / base * 100).alias("net_pct"))
    side = lambda c, o: rows.where(c).orderBy(o, "k_agency", "k_account").limit(top)
    return card, side(up, F.desc("delta")).unionByName(side(down, F.asc("delta")))
