"""The registered queries over the bridge views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import link_hash
from ..functions.money import availability_year, is_budget_authority
from ..functions.text import dollars_text, quality
from ..operators import accounts, classify, compare, entities, inflation, links, model, reports, search, summary, verify
from ..operators import repair as repairs
from ..operators import text as texts
from . import bridge

BASE_FY, CURRENT_FY = 1997, 1998
HIGH, UNCERTAIN, FLOOR = 0.40, 0.35, 0.30
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _view(spark: SparkSession, d: str) -> DataFrame:
    return bridge.provisions(spark, d)


def _year(view: DataFrame, fy: int) -> DataFrame:
    return view.where(F.array_contains("fiscal_years", fy))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    view = _view(spark, d)
    return accounts.resolve(accounts.to_resolve(view), bridge.fas_accounts(spark, d), bridge.agency_codes(view))


def _compared(spark: SparkSession, d: str, *, ruled: bool = False, rescue: bool = True) -> DataFrame:
    view = _view(spark, d)
    groups, aliases = bridge.agency_rules(spark), bridge.account_rules(spark)
    if not ruled:
        groups, aliases = groups.limit(0), aliases.limit(0)
    return compare.compare(_year(view, BASE_FY), _year(view, CURRENT_FY), groups, aliases, rescue=rescue)


_ROW = ["k_agency", "k_account", "base_dollars", "current_dollars", "delta", "status"]
_PCT = "round(delta_pct, 6) AS delta_pct"


@_query
def summary_by_bill(spark, d):
    return summary.totals(_view(spark, d))


@_query
def advance_split(spark, d):
    view = _view(spark, d)
    return summary.advance_split(view, bridge.timings(view))


@_query
def advance_breakdown(spark, d):
    view = _view(spark, d)
    return summary.timing_breakdown(view, bridge.timings(view))


@_query
def rollup_department(spark, d):
    return summary.by_department(_view(spark, d))


@_query
def audit(spark, d):
    view = _view(spark, d)
    a, t = bridge.checks(view)
    return summary.audit(view, a, t, view.groupBy("bill_dir").agg((F.count_if(F.col("amount_status") == "verified") / F.count("*") * 100).alias("completeness_pct"))).withColumn("completeness_pct", F.round("completeness_pct", 6))


@_query
def verification_heatmap(spark, d):
    view = _view(spark, d)
    a, t = bridge.checks(view)
    rows = reports.verification_heatmap(summary.audit(view, a, t, view.select("bill_dir", F.lit(0.0).alias("completeness_pct")).distinct()))
    return rows.select("bill_dir", *[F.round(c, 6).alias(c) for c in rows.columns if c != "bill_dir"])


@_query
def totals_rollup(spark, d):
    return summary.with_grand_total(summary.totals(_view(spark, d)), "bill_dir", ["provisions", "budget_authority", "rescissions", "net_ba"])


@_query
def export_semantics(spark, d):
    return summary.semantics_warning(_view(spark, d))


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("bill_dir", "provision_index", "account_name", "dollars", "amount_status", "match_tier", "quality")


@_query
def search_filters(spark, d):
    view = _view(spark, d)
    return _found(search.search(view, search.Criteria(provision_type="appropriation", agency="Inspector General", account="red", keyword="for ", bill="URGENT", division="b"), search.evidence(*bridge.checks(view))))


@_query
def search_dollar_range(spark, d):
    view = _view(spark, d)
    return _found(search.search(view, search.Criteria(provision_type="rescission", min_dollars=9_000_000, max_dollars=9_500_000, fiscal_year=CURRENT_FY), search.evidence(*bridge.checks(view))))


@_query
def search_quality(spark, d):
    view = _view(spark, d)
    rows = search.search(view, search.Criteria(), search.evidence(*bridge.checks(view)))
    return rows.groupBy("quality", "provision_type").agg(F.count("*").alias("provisions"))


@_query
def search_subcommittee(spark, d):
    view = _view(spark, d)
    rows = search.in_subcommittee(search.Criteria(fiscal_year=CURRENT_FY, min_dollars=9_900_000).apply(view), bridge.jurisdictions(view), "milcon-va")
    return rows.select("bill_dir", "provision_index", "division", "dollars")


@_query
def compare_accounts(spark, d):
    return _compared(spark, d, rescue=False).selectExpr(*_ROW, _PCT)


@_query
def compare_rescue(spark, d):
    return _compared(spark, d).selectExpr(*_ROW, _PCT)


@_query
def compare_groups(spark, d):
    return _compared(spark, d, ruled=True, rescue=False).select(*_ROW, "normalized")


@_query
def compare_real(spark, d):
    rows = compare.with_inflation(_compared(spark, d, rescue=False), 0.03)
    return rows.select("k_agency", "k_account", "real_delta_pct", "inflation_flag")


@_query
def compare_inflation_counts(spark, d):
    return compare.inflation_counts(compare.with_inflation(_compared(spark, d, rescue=False), 0.03))


@_query
def compare_status_counts(spark, d):
    return compare.status_counts(_compared(spark, d))


@_query
def compare_movements(spark, d):
    return compare.movements(_compared(spark, d, rescue=False))[0].withColumn("net_pct", F.round("net_pct", 6))


@_query
def compare_top_changes(spark, d):
    return compare.movements(_compared(spark, d, rescue=False))[1].select("k_agency", "k_account", "delta")


@_query
def tas_rescue(spark, d):
    mapped = _mapped(spark, d)
    side = lambda fy: _year(mapped, fy).where("fas_code is not null").groupBy("fas_code").agg(F.sum(F.coalesce("dollars", F.lit(0))).alias("dollars"))
    return compare.rescued_by_code(_compared(spark, d, rescue=False), side(BASE_FY), side(CURRENT_FY)).select(*_ROW)


@_query
def link_relabel(spark, d):
    labels = bridge.table(spark, d, "part").select(F.concat(F.lit("the "), "p_name").alias("source_label"), F.lit("").alias("target_label")).distinct()
    return compare.relabelled_by_links(_compared(spark, d, rescue=False), labels).select("k_agency", "k_account", "status")


@_query
def jurisdiction(spark, d):
    titles = bridge.table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ["Energy and Water Development", "Department of Defense", "Health", "Other Matters", "Further Continuing Appropriations", "Science, and Related Agencies", "Homeland Security"])), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("title"))
    return titles.groupBy(classify.jurisdiction(F.col("title")).alias("jurisdiction"), classify.jurisdiction_pattern(F.col("title")).alias("pattern")).agg(F.count("*").alias("n"))


@_query
def timing(spark, d):
    rows = classify.timings(_view(spark, d))
    return rows.groupBy("timing", "available_fy", "source").agg(F.count("*").alias("n"))


@_query
def timing_confusion(spark, d):
    view = _view(spark, d)
    return classify.confusion(bridge.timings(view), classify.timings(view), ["bill_dir", "provision_index"], "timing")


@_query
def availability(spark, d):
    return _view(spark, d).where("availability <> ''").select(availability_year(F.col("availability")).alias("fy")).groupBy("fy").agg(F.count("*").alias("n"))


@_query
def bill_nature(spark, d):
    view = _view(spark, d)
    return classify.bill_nature(view, bridge.jurisdictions(view))


@_query
def tas_resolve(spark, d):
    return _mapped(spark, d).select("bill_dir", "provision_index", "fas_code", "method", "confidence")


@_query
def tas_summary(spark, d):
    return accounts.resolution_summary(_mapped(spark, d)).withColumn("match_rate_pct", F.round("match_rate_pct", 6))


@_query
def tas_by_bill(spark, d):
    return accounts.resolution_by_bill(_mapped(spark, d)).withColumn("match_pct", F.round("match_pct", 6))


@_query
def agency_codes(spark, d):
    names = bridge.table(spark, d, "part").select("p_name", "p_partkey").select(F.element_at(F.array(*map(F.lit, ["Department of Defense", "Forest Service, USDA", "DoD", "the Coast Guard", "Department of Energy", "national park", ""])), (F.col("p_partkey") % 7 + 1).cast("int")).alias("agency"), F.concat("p_name", F.element_at(F.array(*map(F.lit, [", Army", " Marine Corps", ""])), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("account"))
    return names.groupBy("agency", accounts.agency_code(F.col("agency"), F.col("account")).alias("code")).agg(F.count("*").alias("n"))


@_query
def code_quality(spark, d):
    return reports.code_quality(_mapped(spark, d)).withColumn("share_pct", F.round("share_pct", 6))


@_query
def authorities(spark, d):
    return accounts.authorities(_mapped(spark, d), bridge.fas_accounts(spark, d)).select("fas_code", "fas_title", "agency_name", "provision_count", "bill_count", "name_count", "total_dollars")


@_query
def variants(spark, d):
    return accounts.classified(accounts.variants(_mapped(spark, d))).select("fas_code", "name", F.size("bills").alias("bills"), "classification")


@_query
def rename_events(spark, d):
    named = _mapped(spark, d).withColumn("account_name", F.when(F.col("fy") < CURRENT_FY, F.regexp_replace("account_name", "^(.*—)?(.*)$", "$1Old $2")).otherwise(F.col("account_name")))
    return accounts.rename_events(accounts.classified(accounts.variants(named))).select("fas_code", "event_type", "fiscal_year", "from", "to")


def _years(spark: SparkSession, d: str) -> DataFrame:
    return accounts.timeline(_mapped(spark, d))


@_query
def authority_timeline(spark, d):
    return _years(spark, d).select("fas_code", "fy", "total_dollars", F.size("bill_identifiers").alias("bills"), F.size("account_names").alias("names"))


@_query
def authority_search(spark, d):
    mapped = _mapped(spark, d)
    names = mapped.where("fas_code is not null").groupBy("fas_code").agg(F.collect_set("account_name").alias("names"))
    return accounts.search_authorities(accounts.authorities(mapped, bridge.fas_accounts(spark, d)).join(names, "fas_code"), "economy nation_1").select("fas_code", "fas_title")


@_query
def biggest_changes(spark, d):
    return accounts.biggest_changes(_years(spark, d), BASE_FY, CURRENT_FY).withColumn("delta_pct", F.round("delta_pct", 6))


@_query
def set_overlap(spark, d):
    return accounts.shared_codes(_mapped(spark, d), BASE_FY, CURRENT_FY)


@_query
def top_trends(spark, d):
    return reports.top_trends(_years(spark, d), first=1995, last=2002)


@_query
def first_to_last(spark, d):
    return reports.first_to_last(_years(spark, d)).withColumn("change_pct", F.round("change_pct", 6))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("bill_dir"), F.col("vec_id").alias("provision_index"), F.col("embedding").alias("vec"))


def _about(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    return bridge.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("bill_dir"), k.alias("provision_index"), F.col("label").alias("ord"), F.concat(F.lit("n"), (k % 50).cast("string")).alias("canonical_name"), F.concat(F.lit("a"), (k % 3).cast("string")).alias("norm_agency"), F.array(F.col("label") % 4).alias("fiscal_years"), F.when(k % 7 == 0, None).otherwise(k * 100).alias("dollars"), F.when(k % 5 == 0, "advance").when(k % 5 == 1, "supplemental").otherwise("current_year").alias("timing"), F.concat(F.lit("b"), F.col("label").cast("string")).alias("identifier"))


def _source(spark: SparkSession, d: str):  # noqa: ANN202
    return bridge.table(spark, d, "embeddings").where("vec_id = 7").select("label", "embedding").first()


@_query
def similar_topn(spark, d):
    me = _source(spark, d)
    return search.similar(_vectors(spark, d), list(me.embedding), _about(spark, d), 20, exclude=(str(me.label), 7)).select("bill_dir", "provision_index", "similarity")


@_query
def similar_many(spark, d):
    """OP-SORT-04/05, SRCH-02: all ids divisible by 20 against all rows, 20 each."""
    rows = _vectors(spark, d)
    searches = rows.where("provision_index % 20 = 0").withColumnsRenamed({"bill_dir": "source_dir", "provision_index": "source_index"})
    return search.similar_many(rows, searches, 20).withColumn("similarity", F.round("similarity", 6))


@_query
def relate_tiers(spark, d):
    rows = links.related(_vectors(spark, d), _about(spark, d), str(_source(spark, d).label), 7, floor=0.1, high=0.2, uncertain=0.15)
    return rows.select("tier", "rank", "bill_dir", "provision_index", "confidence", F.round("similarity", 6).alias("similarity"))


@_query
def relate_timeline(spark, d):
    rows = links.related(_vectors(spark, d), _about(spark, d), str(_source(spark, d).label), 7, floor=0.1, high=0.2, uncertain=0.15).where("tier = 'same_account'")
    mine = _about(spark, d).where("provision_index = 7")
    return links.timeline(rows.select(*mine.columns).unionByName(mine)).select("fy", "current_year_ba", "advance_ba", "supplemental_ba", F.size("source_bills").alias("bills"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return links.suggest(links.similar_pairs(_vectors(spark, d), FLOOR), _about(spark, d), "m", scope="all", high=HIGH, uncertain=UNCERTAIN)


@_query
def link_suggest(spark, d):
    return _candidates(spark, d).select("source_dir", "source_index", "target_dir", "target_index", "confidence", "hash", F.round("similarity", 6).alias("similarity"))


@_query
def link_accept(spark, d):
    found = _candidates(spark, d)
    before = links.accept(found.limit(0).withColumns({"relationship": F.lit(""), "evidence": F.lit(""), "note": F.lit(None).cast("string")}).withColumn("similarity", F.col("similarity").cast("float")), found.where("confidence = 'verified'"), auto=True)
    return links.accept(before, found, auto=True).select("hash", "relationship", "evidence")


@_query
def link_hashes(spark, d):
    return bridge.table(spark, d, "nation").select("n_nationkey", link_hash(F.col("n_name"), F.col("n_nationkey"), F.lit("t"), F.col("n_regionkey"), "m").alias("hash"))


@_query
def embedding_text(spark, d):
    return model.embedding_text(_view(spark, d))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per document two claims: an excerpt of its own text and a benchmark passage, dealt round; each as it is, with line
    breaks, without spaces or with another start, by the document's id. The amount written is the passage's first word."""
    docs = bridge.table(spark, d, "documents").select(F.col("doc_id").alias("bill_dir"), F.col("text").alias("source"))
    items = bridge.table(spark, d, "benchmark")
    dealt = docs.join(items.withColumnRenamed("text", "t"), F.pmod("bill_dir", F.lit(items.count())) == F.col("item_id")).select("bill_dir", F.lit(1).cast("long").alias("provision_index"), "t")
    both = docs.select("bill_dir", F.lit(0).cast("long").alias("provision_index"), F.trim(F.substring("source", 11, 70)).alias("t")).unionByName(dealt)
    t, k = F.col("t"), F.col("bill_dir") % 4
    told = F.when(k == 0, t).when(k == 1, F.replace(t, F.lit(" "), F.lit("\n"))).when(k == 2, F.replace(t, F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("zz "), t))
    return both.select("bill_dir", "provision_index", told.alias("raw_text"), F.regexp_extract("t", r"^[A-Za-z]+", 0).alias("text_as_written")), docs


@_query
def verify_text_tiers(spark, d):
    claims, docs = _pairs(spark, d)
    return verify.texts(claims, docs).groupBy("match_tier").agg(F.count("*").alias("n"))


def _refs(docs: DataFrame) -> DataFrame:
    """Capitalised words stand for amounts: the tables have no dollar signs."""
    def scan(t: bytes) -> list[tuple]:
        import re

        return [(m.start(), m.group().decode(), len(m.group())) for m in re.finditer(rb"(?<![^ \n])[A-Z][a-z]+(?=[ \n]|\Z)", t)]

    return texts.scanned(docs, "bill_dir", "source", "position long, amount string, value long", scan)


@_query
def verify_amounts(spark, d):
    claims, docs = _pairs(spark, d)
    return verify.amounts(claims, docs, _refs(docs)).groupBy("status").agg(F.count("*").alias("n"))


@_query
def completeness(spark, d):
    claims, docs = _pairs(spark, d)
    refs = _refs(docs)
    covered = verify.accounted(verify.amounts(claims, docs, refs), docs, refs)
    return verify.completeness(refs, covered, docs.select("bill_dir")).withColumn("completeness_pct", F.round("completeness_pct", 6))


@_query
def unaccounted(spark, d):
    claims, docs = _pairs(spark, d)
    refs = _refs(docs)
    covered = verify.accounted(verify.amounts(claims, docs, refs), docs, refs)
    return verify.unaccounted(refs, covered).groupBy("bill_dir").agg(F.count("*").alias("n"))


@_query
def text_index(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id", "text")
    return texts.amount_refs(docs, "doc_id", "text", r"(?<![0-9.,])[0-9][0-9,.]*").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).cast("string").alias("total"))


@_query
def repair(spark, d):
    claims, docs = _pairs(spark, d)
    return repairs.report(repairs.repaired(claims, docs)).withColumn("traceable_pct", F.round("traceable_pct", 6))


@_query
def chunks(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id", "text")
    return texts.chunk_table(docs, "doc_id", "text", 200).select("doc_id", "ord", "start", "end", "estimated_tokens")


@_query
def xml_text(spark, d):
    from ..sources.xml import page_text

    return page_text(bridge.table(spark, d, "pages"), "page_id", "html")


@_query
def suggest_text_match(spark, d):
    view = _view(spark, d).withColumn("account_name", F.concat_ws(" ", "account_name", "nation")).withColumn("agency", F.concat(F.when(F.col("fy") < CURRENT_FY, "Bureau of Nation ").otherwise("Nation "), F.col("nation")))
    return entities.suggest(view).select("canonical", "member", "evidence", "orphan_pairs_resolved", "hash")


@_query
def regex_variants(spark, d):
    n = F.lower("n_name")
    names = bridge.table(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("Office of "), n), F.concat(F.lit("Office for "), n), F.concat(F.lit("U.S. "), n), F.concat(F.lit("United States "), n), F.concat(n, F.lit("—army")), F.concat(n, F.lit("—department of the army")))).alias("agency"))
    return entities.name_variants(names)


@_query
def by_agency_share(spark, d):
    return reports.by_agency(_view(spark, d)).withColumn("share_pct", F.round("share_pct", 6))


@_query
def scorecard(spark, d):
    view = _view(spark, d)
    return reports.scorecard(view, bridge.jurisdictions(view), [1996, 1997, 1998, 1999])


@_query
def defense_trend(spark, d):
    view = _view(spark, d)
    return reports.defense_trend(view, bridge.jurisdictions(view)).withColumn("defense_pct", F.round("defense_pct", 6))


@_query
def cr_impact(spark, d):
    view = _view(spark, d).where("provision_type = 'limitation'").withColumn("provision_type", F.lit("cr_substitution")).withColumn("old_dollars", F.lit(5_000_000).cast("long"))
    return reports.cr_impact(view)


@_query
def type_histogram(spark, d):
    return reports.type_histogram(_view(spark, d))


@_query
def detail_levels(spark, d):
    return reports.detail_levels(_view(spark, d))


@_query
def type_division_counts(spark, d):
    return reports.type_division_counts(_view(spark, d))


@_query
def treemap(spark, d):
    view = _view(spark, d)
    return reports.treemap(view, bridge.jurisdictions(view))


@_query
def biggest_rescissions(spark, d):
    return reports.biggest(_view(spark, d), "rescission", 5)


@_query
def big_ticket(spark, d):
    return reports.big_ticket(_view(spark, d), 10_400_000).select("bill_dir", "provision_index", "dollars")


@_query
def earmarks(spark, d):
    recipient = F.array(F.struct(F.when(F.col("line") == 3, F.col("part_type")).otherwise("").alias("recipient"), F.lit("").alias("location"), F.lit("").alias("requesting_member")))
    view = _view(spark, d).withColumn("earmarks", recipient).withColumn("earmark", F.col("earmarks")[0]).withColumn("provision_type", F.when(F.col("provision_type") == "limitation", "directed_spending").otherwise(F.col("provision_type")))
    return reports.earmarks(view).groupBy("recipient").agg(F.count("*").alias("n"), F.sum("dollars").alias("dollars"))


@_query
def summary_card(spark, d):
    return reports.summary_card(_view(spark, d))


@_query
def chunk_ranges(spark, d):
    per = _view(spark, d).groupBy("bill_dir", F.col("line").alias("ord")).agg(F.count("*").alias("n_provisions"))
    return reports.merged_chunks(per)


@_query
def available_years(spark, d):
    return reports.available_years(_view(spark, d))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*")).alias("value"))


@_query
def fiscal_year_cpi(spark, d):
    return inflation.fiscal_year_cpi(_monthly(spark, d)).withColumn("cpi", F.round("cpi", 4))


@_query
def inflation_context(spark, d):
    rows = inflation.context(inflation.fiscal_year_cpi(_monthly(spark, d)), BASE_FY, CURRENT_FY)
    return rows.select("base_months", "current_months", F.round("rate", 8).alias("rate"))


@_query
def token_rate(spark, d):
    return reports.token_rate(bridge.table(spark, d, "events"), seconds=36_000).select("user_id", "ts", "rate")


@_query
def dollars_shown(spark, d):
    return _view(spark, d).where(is_budget_authority() & F.col("dollars").isNotNull()).select(dollars_text(F.col("dollars")).alias("shown")).groupBy("shown").agg(F.count("*").alias("n"))


@_query
def quality_grades(spark, d):
    view = _view(spark, d)
    status = F.when(F.col("amount_status") == "verified", "found").when(F.col("amount_status") == "ambiguous", "found_multiple").otherwise(F.col("amount_status"))
    return view.groupBy(quality(status, F.col("tier")).alias("quality"), F.coalesce(status, F.lit("-")).alias("status"), F.coalesce("tier", F.lit("-")).alias("tier")).agg(F.count("*").alias("n"))


@_query
def attribution_gap(spark, d):
    view = _view(spark, d)
    a, _ = bridge.checks(view)
    return verify.attribution_gap(a, view)
