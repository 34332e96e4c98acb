"""The canonical provisions view: one flat row per provision with the accessor columns (OP-PRJ-01 to 11, 16, 17).

Rows are keyed by (bill_dir, provision_index) for good; filters never renumber them (T-31). Absent texts are empty
strings, so that comparisons are never null (T-3, T-34).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Discriminators that the model knows; any other is kept as text and treated as ``other``.
TYPES = ["appropriation", "rescission", "transfer_authority", "limitation", "directed_spending", "cr_substitution", "mandatory_spending_extension", "directive", "rider", "continuing_resolution_baseline", "other"]
KNOWN_SEMANTICS = ["new_budget_authority", "transfer_ceiling", "rescission", "reference_amount", "limitation", "mandatory_spending"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fields() -> list[Column]:
    """The accessor columns of a provision ``p`` with its ``provision_index``."""
    kind = F.col("p.provision_type")
    of = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(f"p.{c}"))
    amount = F.when(kind == "cr_substitution", F.col("p.new_amount")).when(kind.isin("appropriation", "rescission", "limitation", "directed_spending", "mandatory_spending_extension"), F.col("p.amount"))
    specific = lambda a: F.when(a["value"]["kind"] == "specific", a["value"]["dollars"])
    described = (
        F.when(kind.isin("limitation", "directive", "rider", "other"), F.col("p.description"))
        .when(kind == "mandatory_spending_extension", F.col("p.program_name"))
        .when(kind == "transfer_authority", F.concat(_text(F.col("p.from_scope")), F.lit(" → "), _text(F.col("p.to_scope"))))
        .when(kind == "cr_substitution", F.concat_ws(" ", "p.reference_act", "p.reference_section"))
        .when(kind == "appropriation", F.col("p.program"))
    )
    return [
        F.col("provision_index").cast("long").alias("provision_index"),
        kind.alias("provision_type"),
        _text(F.col("p.section")).alias("section"),
        _text(F.col("p.division")).alias("division"),
        _text(F.col("p.title")).alias("title"),
        F.col("p.confidence").alias("confidence"),
        _text(F.col("p.raw_text")).alias("raw_text"),
        F.coalesce("p.notes", F.array().cast("array<string>")).alias("notes"),
        _text(of("account_name", "appropriation", "rescission", "directed_spending", "limitation", "cr_substitution")).alias("account_name"),
        _text(of("agency", "appropriation", "rescission")).alias("agency"),
        specific(amount).alias("dollars"),
        _text(amount["semantics"]).alias("semantics"),
        _text(amount["value"]["kind"]).alias("amount_kind"),
        amount["text_as_written"].alias("text_as_written"),
        of("fiscal_year", "appropriation").alias("fiscal_year"),
        _text(of("detail_level", "appropriation", "directed_spending")).alias("detail_level"),
        _text(described).alias("description"),
        F.when(kind == "cr_substitution", specific(F.col("p.old_amount"))).alias("old_dollars"),
        _text(of("availability", "appropriation")).alias("availability"),
        F.coalesce("p.earmarks", F.array().cast("array<struct<recipient:string,location:string,requesting_member:string>>")).alias("earmarks"),
        F.col("p.earmark").alias("earmark"),
    ]


def provisions(bills: DataFrame) -> DataFrame:
    """From ``sources.bills`` or ``sources.listed``: one row per provision. A part's provisions count from its ``first_index``."""
    first = F.col("first_index") if "first_index" in bills.columns else F.lit(0)
    rows = bills.select("bill_dir", "identifier", "congress", "classification", "fiscal_years", first.alias("first"), F.posexplode("provisions").alias("pos", "p")).withColumn("provision_index", F.col("first") + F.col("pos"))
    return rows.select("bill_dir", "identifier", "congress", "classification", "fiscal_years", *fields())


def embedding_text(view: DataFrame) -> DataFrame:
    """OP-PRJ-16: the text to embed, without empty parts."""
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    return view.select("bill_dir", "provision_index", F.concat_ws(" | ", part("Account", "account_name"), part("Agency", "agency"), part("Description", "description"), part("Text", "raw_text")).alias("embedding_text"))


def semantics_shown(semantics: Column) -> Column:
    """OP-PRJ-11: unknown semantics print as *other*, no amount as nothing (T-32)."""
    return F.when(semantics.isin(*KNOWN_SEMANTICS, ""), semantics).otherwise("other")


def timings(bills: DataFrame) -> DataFrame:
    """(bill_dir, provision_index, timing, available_fy) from the sidecar."""
    return bills.select("bill_dir", F.inline("meta.provision_timing")).select("bill_dir", "provision_index", "timing", "available_fy")


def checks(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bill_dir, provision_index, ordinal, status) of amounts and (…, match_tier) of texts, from the sidecar; ``ordinal`` counts
    within a file, and a provision's checks lie in one."""
    amounts = bills.select("bill_dir", F.posexplode("verification.amount_checks").alias("ordinal", "c")).select("bill_dir", "c.provision_index", "ordinal", "c.status")
    texts = bills.select("bill_dir", F.posexplode("verification.raw_text_checks").alias("ordinal", "c")).select("bill_dir", "c.provision_index", "ordinal", "c.match_tier")
    return amounts, texts


def jurisdictions(bills: DataFrame) -> DataFrame:
    """(bill_dir, division, jurisdiction) from the sidecar."""
    return bills.select("bill_dir", F.inline("meta.subcommittees")).select("bill_dir", "division", "jurisdiction", F.col("title").alias("division_title"))
