"""Verification of provisions against their source text (OP-VER-*, OP-JOIN-17 to 19, OP-SET-05, OP-AGG-09).

Per bill: ``claims`` (key, provision_index, text_as_written, raw_text), ``sources`` (key, source), ``refs``
(key, position, amount, value). Source texts are normalised once per bill, and provisions meet them by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, preview, spaceless

GUARD = 10  # bytes: shorter texts are only looked for as they are (OP-VER-02)


def amounts(claims: DataFrame, sources: DataFrame, refs: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-VER-01/JOIN-17: status of each written amount: by how often it is among the amounts of the text; if never, by
    whether the text holds it anywhere (an empty one always, T-16)."""
    rows = claims.where("text_as_written is not null").select(key, "provision_index", "text_as_written")
    by = refs.groupBy(key, "amount").agg(F.count("*").alias("n"))
    counted = rows.join(by, (rows[key] == by[key]) & (rows.text_as_written == by.amount), "left").select(rows[key], "provision_index", "text_as_written", F.coalesce("n", F.lit(0)).alias("matches"))
    # only what the index lacks needs the text itself
    lost = counted.where("matches = 0").select(key, "text_as_written").distinct().join(sources, key).select(key, "text_as_written", F.contains("source", "text_as_written").alias("anywhere"))
    status = F.when(F.col("matches") > 1, "ambiguous").when((F.col("matches") == 1) | F.coalesce("anywhere", F.lit(False)), "verified").otherwise("not_found")
    return counted.join(lost, [key, "text_as_written"], "left").select(key, "provision_index", "text_as_written", "matches", status.alias("status"))


def texts(claims: DataFrame, sources: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-VER-01/JOIN-19: the tier by which each raw text is found: exact, normalized, spaceless, no_match; empty ones have none (T-18)."""
    rows = claims.where("raw_text <> ''").select(key, "provision_index", "raw_text")
    # one row per distinct text of a bill is compared; the source joins once per bill and never per row of the result
    distinct = rows.select(key, "raw_text").distinct().withColumn("n", comparable(F.col("raw_text"))).withColumn("s", F.replace("n", F.lit(" "), F.lit("")))
    source = sources.select(key, "source", comparable(F.col("source")).alias("ns"), spaceless(F.col("source")).alias("ss"))
    tier = (
        F.when(F.contains("source", "raw_text"), "exact")
        .when((F.octet_length("n") > GUARD) & F.contains("ns", "n"), "normalized")
        .when((F.octet_length("s") > GUARD) & F.contains("ss", "s"), "spaceless")
        .otherwise("no_match")
    )
    found = distinct.join(source, key, "left").select(key, "raw_text", tier.alias("match_tier"), F.when(F.contains("source", "raw_text"), F.expr("octet_length(left(source, locate(raw_text, source) - 1))")).alias("found_at"))
    return rows.join(found, [key, "raw_text"]).select(key, "provision_index", preview(F.col("raw_text")).alias("raw_text_preview"), "match_tier", "found_at")


def accounted(checks: DataFrame, sources: DataFrame, refs: DataFrame, key: str = "bill_dir") -> DataFrame:
    """Positions that some provision accounts for: all of an amount that matched (T-17); for one found only in the plain
    text the nearest of the index, the first of equals (OP-JOIN-18)."""
    hit = refs.join(checks.where("matches > 0").select(key, F.col("text_as_written").alias("amount")).distinct(), [key, "amount"], "left_semi").select(key, "position")
    plain = checks.where("matches = 0 and status = 'verified'").select(key, "text_as_written").distinct().join(sources, key)
    placed = plain.select(key, "text_as_written", F.expr("octet_length(left(source, greatest(locate(text_as_written, source) - 1, 0)))").alias("at"))
    return hit.unionByName(nearest(placed, refs, key).select(key, "position")).distinct()


def nearest(placed: DataFrame, refs: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-JOIN-18: (key, at, position) for each place ``at``: the nearest position of the same key, the first of equals.

    An as-of merge: places and positions stand in one sorted run per key; the last position up to a place and the first
    from it on are the only ones to compare. Keys without positions have no row.
    """
    wanted = placed.select(key, F.col("at").cast("long").alias("at")).distinct()
    there = refs.join(wanted.select(key).distinct(), key, "left_semi").select(key, F.col("position").cast("long").alias("position")).distinct()
    run = wanted.select(key, "at", F.lit(None).cast("long").alias("position"), F.col("at").alias("__o")).unionByName(there.select(key, F.lit(None).cast("long").alias("at"), "position", F.col("position").alias("__o")))
    order = Window.partitionBy(key).orderBy("__o")
    before = F.last("position", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.last("position", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("__o")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = run.withColumns({"__b": before, "__a": after}).where("at is not null")
    near = F.when(F.col("__a").isNull() | (F.col("at") - F.col("__b") <= F.col("__a") - F.col("at")), F.col("__b")).otherwise(F.col("__a"))
    return both.select(key, "at", near.alias("position")).where("position is not null")


def completeness(refs: DataFrame, covered: DataFrame, keys: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-AGG-09: per bill the amounts in its text, how many are accounted for, and the share (100 without any)."""
    total = refs.groupBy(key).agg(F.count_distinct("position").alias("total_amounts"))
    have = covered.groupBy(key).agg(F.count("*").alias("accounted_for"))
    out = keys.select(key).distinct().join(total, key, "left").join(have, key, "left").fillna(0)
    return out.withColumn("completeness_pct", F.when(F.col("total_amounts") > 0, F.col("accounted_for") / F.col("total_amounts") * 100).otherwise(100.0))


def unaccounted(refs: DataFrame, covered: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-SET-05."""
    return refs.join(covered, [key, "position"], "left_anti")


def summary(amount_checks: DataFrame, text_checks: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-AGG-09: counts of results per bill."""
    a = amount_checks.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(f"amounts_{s}") for s in ("verified", "not_found", "ambiguous")])
    t = text_checks.groupBy(key).agg(*[F.count_if(F.col("match_tier") == s).alias(f"raw_text_{s}") for s in ("exact", "normalized", "spaceless", "no_match")])
    return a.join(t, key, "full_outer").fillna(0)


def attribution_gap(amount_checks: DataFrame, view: DataFrame) -> DataFrame:
    """OP-AGG-30: per bill, amounts by status and the money behind each."""
    rows = view.select("bill_dir", "provision_index", "dollars").join(amount_checks, ["bill_dir", "provision_index"], "left")
    size = F.abs(F.coalesce("dollars", F.lit(0)))
    part = lambda s: [F.count_if(F.col("status") == s).alias(s), F.sum(F.when(F.col("status") == s, size).otherwise(0)).alias(f"{s}_dollars")]
    return rows.groupBy("bill_dir").agg(*part("verified"), *part("ambiguous"), *part("not_found"), F.count_if(F.col("status").isNull()).alias("no_amount"))


def ambiguous_amounts(amount_checks: DataFrame, top: int = 20) -> DataFrame:
    """OP-AGG-30: the amounts that stand in the most places."""
    return amount_checks.where("status = 'ambiguous'").groupBy("text_as_written").agg(F.max("matches").alias("positions"), F.count("*").alias("provisions")).orderBy(F.desc("positions"), "text_as_written").limit(top)


def misses(claims: DataFrame, sources: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-RES-02: written amounts that their text holds neither as they are nor normalised."""
    rows = claims.where("text_as_written <> ''").join(sources.select(key, "source", comparable(F.col("source")).alias("ns")), key)
    return rows.where(~F.contains("source", "text_as_written") & ~F.contains("ns", comparable(F.col("text_as_written")))).select(key, "provision_index", "text_as_written")


def staleness(bills: DataFrame) -> DataFrame:
    """OP-STALE-01: from (bill_dir, source_sha256, extracted_from, extraction_sha256, meta_of, vectors_of): stages whose
    recorded input isn't the present one; stages that never ran don't count."""
    pairs = [("extraction", "extracted_from", "source_sha256"), ("bill_meta", "meta_of", "extraction_sha256"), ("embeddings", "vectors_of", "extraction_sha256")]
    stages = F.filter(F.array(*[F.when(F.col(told) != F.col(now), F.lit(stage)) for stage, told, now in pairs]), lambda s: s.isNotNull())
    return bills.select("bill_dir", F.explode(stages).alias("stale"))


def audit_details(amount_checks: DataFrame, text_checks: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-AUD-01: the verbose part of an audit: amounts that weren't found and texts without a match."""
    amounts_ = amount_checks.where("status = 'not_found'").select(key, "provision_index", F.lit("amount").alias("kind"), F.col("text_as_written").alias("shown"))
    return amounts_.unionByName(text_checks.where("match_tier = 'no_match'").select(key, "provision_index", F.lit("raw_text").alias("kind"), F.col("raw_text_preview").alias("shown")))


def tier_histogram(claims: DataFrame, sources: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-RES-01: per bill how many raw texts are found at each tier, empty ones apart."""
    found = texts(claims, sources, key).select(key, "match_tier")
    empty = claims.where("coalesce(raw_text, '') = ''").select(key, F.lit("empty").alias("match_tier"))
    return found.unionByName(empty).groupBy(key, "match_tier").agg(F.count("*").alias("n"))


def miss_context(claims: DataFrame, sources: DataFrame, key: str = "bill_dir", before: int = 100, after: int = 500) -> DataFrame:
    """OP-RES-01: the source around the section or account name of each text without a match."""
    lost = texts(claims, sources, key).where("match_tier = 'no_match'").select(key, "provision_index")
    rows = claims.join(lost, [key, "provision_index"]).join(sources, key)
    at = F.coalesce(*[F.nullif(F.call_function("instr", "source", F.coalesce(c, F.lit("\x00"))), F.lit(0)) for c in ("section", "account_name")])
    start = F.greatest(at - before, F.lit(1))
    return rows.select(key, "provision_index", F.substring("source", start, at + after - start).alias("context"))
