"""Account codes: resolution, authorities and their timelines (OP-TAS-*, OP-AUT-*, OP-AGG-10 to 14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import is_budget_authority
from ..functions.text import normalized_account, short_title
from . import rules

SHORTEST_TITLE = 4  # bytes; shorter short titles aren't looked up (T-26)


def agency_code(agency: Column, account: Column) -> Column:
    """OP-STR-17: defence agencies by the account's branch (T-27), else an equal name, else the first that contains
    the agency or is contained in it; null for an empty agency."""
    lower, name = F.lower(agency), F.lower(F.coalesce(account, F.lit("")))
    branch, part, same = F.lit("097"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, code in reversed(rules.BRANCH_CODES):
        branch = F.when(F.contains(name, F.lit(text)), code).otherwise(branch)
    for text, code in reversed(rules.AGENCY_CODES):
        same = F.when(lower == text, code).otherwise(same)
        if len(text.encode()) > 8:
            part = F.when(F.contains(lower, F.lit(text)) | F.contains(F.lit(text), lower), code).otherwise(part)
    defence = F.contains(lower, F.lit("defense")) | (lower == "dod")
    return F.when(agency == "", None).when(defence, branch).otherwise(F.coalesce(same, part))


def to_resolve(view: DataFrame) -> DataFrame:
    """OP-TAS-01: top-level budget authority with an account name."""
    return view.where(is_budget_authority() & (F.col("account_name") != ""))


def _candidates(reference: DataFrame) -> DataFrame:
    """Per short title: how many accounts, the only one if so, and the only ones by agency code (OP-JOIN-12)."""
    rows = reference.withColumn("key", short_title(F.col("title"))).where(F.octet_length("key") >= SHORTEST_TITLE)
    hit = F.struct("fas_code", F.col("title").alias("fas_title"))
    single = lambda: F.when(F.count("*") == 1, F.first(hit))
    every = rows.groupBy("key").agg(single().alias("only"))
    each = rows.groupBy("key", "agency_code").agg(single().alias("hit")).where("hit is not null").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("agency_code", "hit"))).alias("by_agency"))
    return every.join(each, "key", "left")


def resolve(rows: DataFrame, reference: DataFrame, agency_codes: DataFrame | None = None) -> DataFrame:
    """OP-TAS-02/03: fas_code, fas_title, confidence and method of each row.

    The name as it is, its short title and what follows its last dash are tried in turn; a title counts if one account
    alone has it, or one alone within the agency. Names are resolved once each and joined back. ``agency_codes``:
    (agency, code) where the built-in table doesn't apply.
    """
    names = rows.select("agency", "account_name").distinct()
    if agency_codes is None:
        names = names.withColumn("code", agency_code(F.col("agency"), F.col("account_name")))
    else:
        names = names.join(agency_codes, "agency", "left")
    after = F.when(F.col("account_name").rlike("[—–]"), short_title(normalized_account(F.col("account_name"))))
    keys = F.array(F.lower(F.trim("account_name")), short_title(F.col("account_name")), after)
    tried = names.select("agency", "account_name", "code", F.posexplode(keys).alias("try", "key")).where("key is not null").join(_candidates(reference), "key")
    direct, within = F.col("only"), F.element_at("by_agency", F.coalesce("code", F.lit("")))
    method = F.when(F.col("try") == 2, "suffix_match").when(direct.isNotNull(), "direct_match").otherwise("agency_disambiguated")
    hits = tried.select("agency", "account_name", "try", F.coalesce(direct, within).alias("hit"), method.alias("method")).where("hit is not null")
    resolved = hits.groupBy("agency", "account_name").agg(F.min_by(F.struct("hit", "method"), "try").alias("r")).select("agency", "account_name", "r.hit.*", "r.method")
    out = rows.join(resolved, ["agency", "account_name"], "left").withColumn("method", F.coalesce("method", F.lit("none")))
    return out.withColumn("confidence", F.when(F.col("fas_code").isNotNull(), "verified").otherwise("unmatched"))


def resolution_summary(mappings: DataFrame) -> DataFrame:
    """OP-AGG-14: one row; a rate of zero without rows."""
    matched = F.count_if(F.col("fas_code").isNotNull())
    return mappings.agg(F.count("*").alias("total_provisions"), F.count_if(F.col("confidence") == "verified").alias("deterministic_matched"), F.count_if(F.col("confidence").isin("high", "inferred")).alias("llm_matched"), F.count_if(F.col("confidence") == "unmatched").alias("unmatched"), F.count_distinct("fas_code").alias("unique_fas_codes"), F.when(F.count("*") > 0, matched / F.count("*") * 100).otherwise(0.0).alias("match_rate_pct"))


def resolution_by_bill(mappings: DataFrame) -> DataFrame:
    """OP-AGG-32: per bill and, as ``TOTAL``, over all."""
    rolled = mappings.rollup("bill_dir").agg(F.grouping("bill_dir").alias("g"), F.count("*").alias("provisions"), F.count_if(F.col("fas_code").isNotNull()).alias("matched"))
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("bill_dir")).alias("bill_dir"), "provisions", "matched", F.when(F.col("provisions") > 0, F.col("matched") / F.col("provisions") * 100).otherwise(0.0).alias("match_pct"))


def applied(mappings: DataFrame, answers: DataFrame, reference: DataFrame) -> DataFrame:
    """OP-JOIN-21: answers (bill_dir, provision_index, fas_code) fill unmatched rows; known codes are *high*, others *inferred*."""
    codes = reference.select("fas_code").distinct().withColumn("known", F.lit(True))
    told = answers.select("bill_dir", "provision_index", F.col("fas_code").alias("told")).join(codes.withColumnRenamed("fas_code", "told"), "told", "left")
    both = mappings.join(told, ["bill_dir", "provision_index"], "left")
    take = (F.col("confidence") == "unmatched") & F.col("told").isNotNull()
    return both.withColumn("fas_code", F.when(take, F.col("told")).otherwise(F.col("fas_code"))).withColumn("method", F.when(take, "llm_resolved").otherwise(F.col("method"))).withColumn("confidence", F.when(take, F.when(F.col("known"), "high").otherwise("inferred")).otherwise(F.col("confidence"))).drop("told", "known")


def by_code(reference: DataFrame) -> DataFrame:
    """OP-TAS-05/JOIN-13: one account per code, the active before the discontinued one."""
    return reference.groupBy("fas_code").agg(F.min_by(F.struct("title", "agency_name", "agency_code"), F.struct((F.col("status") != "active").alias("d"), "title")).alias("a")).select("fas_code", F.col("a.title").alias("fas_title"), F.col("a.agency_name").alias("agency_name"), F.col("a.agency_code").alias("agency_code"))


def discontinued(changes: DataFrame, active: DataFrame) -> DataFrame:
    """OP-SET-06: changed accounts that aren't active, once each."""
    return changes.join(active.select("fas_code"), "fas_code", "left_anti").groupBy("fas_code").agg(F.min_by(F.struct(*[c for c in changes.columns if c != "fas_code"]), F.col("title")).alias("a")).select("fas_code", "a.*")


def general_fund(reference: DataFrame, agency: str) -> DataFrame:
    """OP-FLT-13: an agency's general fund accounts; numbers from 4000 on are other kinds of funds."""
    return reference.where((F.col("agency_code") == agency) & (F.col("fund_type") == "general") & ~F.coalesce(F.col("main_account").try_cast("int") >= 4000, F.lit(False)))


def collapsed(tas: DataFrame) -> DataFrame:
    """OP-AGG-16: from (fas_code, title, last_updated, no_year, annual, ord): per code the longest title (the first of
    equals), the newest date, whether any variant is no-year or annual, and how many there are."""
    return tas.groupBy("fas_code").agg(F.max_by("title", F.struct(F.length("title"), -F.col("ord"))).alias("title"), F.max("last_updated").alias("last_updated"), F.bool_or("no_year").alias("has_no_year_variant"), F.bool_or("annual").alias("has_annual_variant"), F.count("*").alias("tas_variants"))


def variants(mapped: DataFrame) -> DataFrame:
    """OP-AGG-11: per code and name the bills and fiscal years, from rows with fas_code, account_name, bill_dir, fiscal_years."""
    return mapped.where("fas_code is not null").groupBy("fas_code", F.col("account_name").alias("name")).agg(F.array_sort(F.collect_set("bill_dir")).alias("bills"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("fiscal_years")))).alias("fiscal_years"))


def classified(named: DataFrame) -> DataFrame:
    """OP-AUT-01: ``variants`` with a classification each.

    The name in most bills is canonical, the last by name among equals (T-24). Names alike after normalisation are case
    or prefix variants. With just two normalised names whose years don't overlap the others are name changes (T-25).
    """
    norm = normalized_account(F.col("name"))
    rows = named.withColumn("norm", norm)
    code = Window.partitionBy("fas_code")
    per = rows.groupBy("fas_code", "norm").agg(F.min(F.array_min("fiscal_years")).alias("lo"), F.max(F.array_max("fiscal_years")).alias("hi"), F.min("name").alias("first_name"))
    two = per.groupBy("fas_code").agg(F.count("*").alias("norms"), F.min_by(F.struct("lo", "hi", "first_name"), F.struct("lo", "hi", "norm")).alias("a"), F.max_by(F.struct("lo", "hi", "first_name"), F.struct("lo", "hi", "norm")).alias("b"))
    renamed = (F.col("norms") == 2) & (F.col("a.hi") < F.col("b.lo"))
    top = F.max_by(F.struct("name", "norm"), F.struct(F.size("bills"), F.col("name"))).over(code)
    joined = rows.withColumn("top", top).join(two, "fas_code")
    kind = F.when(F.col("name") == F.col("top.name"), "canonical").when(renamed, "name_change").when(F.col("norm") == F.col("top.norm"), F.when(F.lower("name") == F.lower("top.name"), "case_variant").otherwise("prefix_variant")).otherwise("inconsistent_extraction")
    return joined.select("fas_code", "name", "bills", "fiscal_years", kind.alias("classification"), F.when(renamed, F.struct(F.col("b.lo").alias("fiscal_year"), F.col("a.first_name").alias("from"), F.col("b.first_name").alias("to"))).alias("event"))


def rename_events(classed: DataFrame) -> DataFrame:
    """OP-AUT-05."""
    return classed.where("event is not null").select("fas_code", F.lit("rename").alias("event_type"), "event.*").distinct()


def authorities(mapped: DataFrame, reference: DataFrame) -> DataFrame:
    """OP-AGG-10: per code title, agency, provisions, bills, fiscal years, names and dollars; titles fall back to a name."""
    rows = mapped.where("fas_code is not null")
    agg = rows.groupBy("fas_code").agg(F.count("*").alias("provision_count"), F.count_distinct("bill_dir").alias("bill_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("fiscal_years")))).alias("fiscal_years"), F.count_distinct("account_name").alias("name_count"), F.sum(F.coalesce("dollars", F.lit(0))).alias("total_dollars"), F.min("account_name").alias("__name"))
    return agg.join(by_code(reference), "fas_code", "left").withColumn("fas_title", F.coalesce("fas_title", "__name")).drop("__name").orderBy("fas_code")


def timeline(mapped: DataFrame) -> DataFrame:
    """OP-AGG-12: per code and fiscal year: dollars, bills, names; a bill of two years counts in both (T-4)."""
    rows = mapped.where("fas_code is not null").select("fas_code", F.explode("fiscal_years").alias("fy"), "dollars", "identifier", "account_name")
    return rows.groupBy("fas_code", "fy").agg(F.sum(F.coalesce("dollars", F.lit(0))).alias("total_dollars"), F.array_sort(F.collect_set("identifier")).alias("bill_identifiers"), F.array_sort(F.collect_set("account_name")).alias("account_names"))


def search_authorities(named: DataFrame, query: str) -> DataFrame:
    """OP-AUT-02: from (fas_code, fas_title, agency_name, names): those whose texts together hold all words of two bytes
    or more; if none does, those with a text that holds the whole query."""
    lower = query.lower()
    words = [w for w in lower.split() if len(w.encode()) >= 2]
    if not words:
        return named.limit(0)
    fields = F.array("fas_title", "agency_name", "fas_code")
    joined = F.lower(F.concat_ws(" ", fields, "names"))
    all_words = named.where(F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(joined, w)))
    if not all_words.isEmpty():
        return all_words
    return named.where(F.exists(F.concat(fields, F.coalesce("names", F.array().cast("array<string>"))), lambda x: F.contains(F.lower(x), F.lit(lower))))


def resolved_query(named: DataFrame, query: str) -> DataFrame:
    """OP-AUT-03/TRC-01: the authority of that very code, else what the search gives (one row is unique, more are candidates)."""
    exact = named.where(F.col("fas_code") == query)
    return exact if not exact.isEmpty() else search_authorities(named, query)


def trace(mapped: DataFrame, reference: DataFrame, query: str) -> dict[str, DataFrame]:
    """OP-TRC-01: the authority, its timeline, variants and events."""
    names = mapped.where("fas_code is not null").groupBy("fas_code").agg(F.collect_set("account_name").alias("names"))
    found = resolved_query(authorities(mapped, reference).join(names, "fas_code"), query)
    mine = mapped.join(found.select("fas_code"), "fas_code", "left_semi")
    classed = classified(variants(mine))
    return {"authority": found, "timeline": timeline(mine), "variants": classed.drop("event"), "events": rename_events(classed)}


def biggest_changes(years: DataFrame, base_fy: int, current_fy: int) -> DataFrame:
    """OP-AUT-04: codes with dollars in both years, by size of change."""
    pick = lambda fy: F.sum(F.when(F.col("fy") == fy, F.col("total_dollars")).otherwise(0))
    both = years.groupBy("fas_code").agg(pick(base_fy).alias("base_dollars"), pick(current_fy).alias("current_dollars")).where("base_dollars > 0 and current_dollars > 0")
    return both.withColumn("delta", F.col("current_dollars") - F.col("base_dollars")).withColumn("delta_pct", F.col("delta") / F.col("base_dollars") * 100)


def shared_codes(mapped: DataFrame, base_fy: int, current_fy: int) -> DataFrame:
    """OP-SET-02/JOIN-16/RES-07: each code's side: shared, only_base or only_current."""
    rows = mapped.where("fas_code is not null").select("fas_code", F.explode("fiscal_years").alias("fy")).where(F.col("fy").isin(base_fy, current_fy))
    sides = rows.groupBy("fas_code").agg(F.bool_or(F.col("fy") == base_fy).alias("b"), F.bool_or(F.col("fy") == current_fy).alias("c"))
    return sides.select("fas_code", F.when(F.col("b") & F.col("c"), "shared").when(F.col("b"), "only_base").otherwise("only_current").alias("side"))


def of_agency(rows: DataFrame, agency: str) -> DataFrame:
    """OP-FLT-14."""
    return rows.where(F.col("agency_code") == agency)


def labelled_timeline(mapped: DataFrame, natures: DataFrame) -> DataFrame:
    """OP-JOIN-20: per code and year the bills with their nature: ``(CR)``, ``(supplemental)`` and so on where it is special."""
    suffix = F.when(F.col("bill_nature").isin("continuing_resolution", "full_year_cr_with_appropriations"), " (CR)").when(F.col("bill_nature") == "supplemental", " (supplemental)").when(F.col("bill_nature") == "authorization", " (authorization)").otherwise("")
    rows = mapped.where("fas_code is not null").join(natures.select("bill_dir", "bill_nature"), "bill_dir", "left")
    years = rows.select("fas_code", F.explode("fiscal_years").alias("fy"), F.concat("identifier", suffix).alias("label"))
    return years.groupBy("fas_code", "fy").agg(F.array_sort(F.collect_set("label")).alias("bills"))
