"""Registered queries over real artifacts: the star tables are written as bill folders, which the sources then read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as texts_
from ..functions.money import fiscal_year, is_stale
from ..operators import accounts, classify, compare, entities, lenient, links, model, repair, search, services, summary, verify
from ..operators import text as texts
from ..sources import bills as sources
from ..sources import fastbook, shared, sinks, xml
from ..streaming import token_rate as token_rates
from . import bridge
from .queries import BASE_FY, CURRENT_FY, _about, _candidates, _compared, _mapped, _pairs, _query, _vectors, _view, _year

_ROOTS: dict[tuple[str, str], tuple[str, set[str]]] = {}
#: By such a folder, what was read of it and kept as Parquet for the session: its provisions, and its bills.
_READ: dict[str, DataFrame] = {}
_HEADS: dict[str, DataFrame] = {}
#: So many provisions of a bill go into one file.
PART = 8192


def _dir(c: str = "bill_dir") -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit("_"))


def _written(spark: SparkSession, d: str, *names: str) -> str:
    """The folder that holds the tables' bills as artifacts, those of the given names at least; each is written once per session."""
    known = (spark.sparkContext.applicationId, d)
    root, done = _ROOTS.setdefault(known, (f"{shared.folder(spark)}/ledgerlark-bills/{uuid.uuid4().hex}", set()))
    lists = {"extraction.json": _extractions, "verification.json": _checked, "bill_meta.json": _meta}
    view = _view(spark, d).withColumn("bill_dir", _dir())
    parted = view.withColumn("part", F.expr(f"provision_index div {PART}").cast("int"))
    for name in names:
        if name in done:
            continue
        if name in lists:
            sinks.write_artifact(lists[name](parted, _dealt(parted)), root, f"{name}.gz")
        else:
            plain, marked = _bill_texts(view)
            sinks.write_artifact(plain, root, "BILLS-118hr1enr.txt")
            sinks.write_artifact(plain.where("bill_dir < '1995'"), root, "BILLS-118hr1rh.txt")
            sinks.write_artifact(marked, root, "BILLS-118hr1enr.xml")
        done.add(name)
    return root


_TEXTS, _JSON = "BILLS", ("extraction.json", "verification.json", "bill_meta.json")


def _listed(order: str, fields: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, fields.alias("f")))), lambda e: e["f"])


def _array(order: str, fields: Column, where: Column | None = None) -> Column:
    """The rows' fields, in order, as the text of a JSON array: a group holds a text per row and no rows of columns."""
    row = F.struct(order, F.to_json(fields).alias("f"))
    texts = F.transform(F.array_sort(F.collect_list(row if where is None else F.when(where, row))), lambda e: e["f"])
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _object(head: Column, *arrays: str) -> Column:
    """A JSON object of the head's fields, one of them at least not null, and of arrays that are text already."""
    text = F.to_json(head)
    return F.concat(F.left(text, F.length(text) - 1), *[F.concat(F.lit(f',"{a}":'), F.col(a)) for a in arrays], F.lit("}"))


def _dealt(view: DataFrame) -> DataFrame:
    """The provisions of a part in one task, and those of about four parts in each: lists are made where their rows have been
    brought, and a task holds as many whatever the size of the tables."""
    return view.repartition(view.count() // (4 * PART) + 1, "bill_dir", "part")


def _with_parts(per: DataFrame, view: DataFrame, *heads: Column) -> DataFrame:
    """Parts with the number of their bill's, and its heads; a row a bill is broadcast."""
    return per.join(F.broadcast(view.groupBy("bill_dir").agg((F.max("part") + 1).alias("parts"), *heads)), "bill_dir")


def _extractions(view: DataFrame, dealt: DataFrame) -> DataFrame:
    """Limitations of even index become substitutions of a continuing resolution."""
    kind = F.when((F.col("provision_type") == "limitation") & (F.col("provision_index") % 2 == 0), "cr_substitution").otherwise(F.col("provision_type"))
    swap = F.col("kind") == "cr_substitution"
    amount = F.struct(F.struct(F.col("amount_kind").alias("kind"), F.col("dollars")).alias("value"), F.col("semantics"), F.concat(F.lit("$"), F.format_number("dollars", 0)).alias("text_as_written"))
    old = F.struct(F.struct(F.lit("specific").alias("kind"), F.col("provision_index").alias("dollars")).alias("value"), F.lit("x").alias("semantics"))
    rows = dealt.withColumn("kind", kind).withColumn("agency", F.when(F.col("agency") == "", "not shown").otherwise(F.col("agency")))
    fields = F.struct(F.col("kind").alias("provision_type"), "division", "confidence", "raw_text", "notes", "account_name", "agency", "availability", "detail_level", "description", F.col("fy").alias("fiscal_year"), F.col("part_type").alias("program"), F.lit("Act").alias("reference_act"), F.col("line").cast("string").alias("reference_section"), F.when(~swap, amount).alias("amount"), F.when(swap, amount).alias("new_amount"), F.when(swap, old).alias("old_amount"))
    per = rows.groupBy("bill_dir", "part").agg(F.first(F.struct("identifier", "classification", "fiscal_years")).alias("bill"), F.min("provision_index").alias("first_index"), _array("provision_index", fields).alias("provisions"))
    return _with_parts(per, view).select("bill_dir", "part", _object(F.struct(F.lit("1.0").alias("schema_version"), "bill", "first_index", "parts"), "provisions").alias("value"))


def _checked(view: DataFrame, dealt: DataFrame) -> DataFrame:
    amounts = _array("provision_index", F.struct("provision_index", F.col("amount_status").alias("status")), F.col("amount_status").isNotNull())
    texts = _array("provision_index", F.struct("provision_index", F.col("tier").alias("match_tier")), F.col("tier").isNotNull())
    share = (F.count_if(F.col("amount_status") == "verified") * 100 / F.count("*")).alias("completeness_pct")
    per = dealt.groupBy("bill_dir", "part").agg(amounts.alias("amount_checks"), texts.alias("raw_text_checks"))
    whole = _with_parts(per, view, F.struct(F.count("*").alias("total_provisions"), share).alias("summary"))
    return whole.select("bill_dir", "part", _object(F.struct("parts", "summary"), "amount_checks", "raw_text_checks").alias("value"))


def _meta(view: DataFrame, dealt: DataFrame) -> DataFrame:
    """Bills of odd years have none."""
    money = (F.col("provision_type") == "appropriation") & (F.col("semantics") == "new_budget_authority")
    timing = _array("provision_index", F.struct("provision_index", "timing"), money & F.col("timing").isNotNull())
    parts = F.array_sort(F.collect_set(F.struct("division", F.concat(F.lit("j"), "division").alias("jurisdiction"), F.concat(F.lit("Division "), "division").alias("title"))))
    mine = view.where("fy % 2 = 0")
    per = dealt.where("fy % 2 = 0").groupBy("bill_dir", "part").agg(timing.alias("provision_timing"))
    whole = _with_parts(per, mine, F.when(F.min("identifier") < "3", 118).alias("congress"), parts.alias("divisions"))
    first = F.when(F.col("part") == 0, F.col("divisions")).alias("subcommittees")  # the list is short and in the first part alone
    return whole.select("bill_dir", "part", _object(F.struct("congress", "parts", F.lit("omnibus").alias("bill_nature"), first), "provision_timing").alias("value"))


#: A title that is cut before its third section at 12 tokens.
_RULES = "<title><enum>II</enum><header>Rules</header><section><enum>1.</enum><text>Rule one is long enough.</text></section><section><enum>2.</enum><text>Rule two.</text></section><section><enum>3.</enum><text>Rule three.</text></section></title>"


def _bill_texts(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain text: a section per division. XML: text before and after divisions, which have two titles and a section each, and a short division behind each."""
    held = view.groupBy("bill_dir", "division", "identifier").agg(F.count("*").alias("n"))  # a least text of all rows would have them sorted
    per = held.groupBy("bill_dir", "division").agg(F.sum("n").alias("n"), F.min("identifier").alias("identifier"))
    bills = per.groupBy("bill_dir").agg(F.first("identifier").alias("identifier"), F.array_sort(F.collect_list(F.struct("division", "n"))).alias("parts"))
    each = lambda f: F.array_join(F.transform("parts", f), "")
    plain = each(lambda p: F.concat(F.lit("SEC. "), p["n"].cast("string"), F.lit(". For part "), p["division"], F.lit(", $"), F.format_number(p["n"] * 1000, 0), F.lit(": Provided, That it lasts.\n")))
    body = each(lambda p: F.concat(F.lit("<division><enum>"), p["division"], F.lit(".</enum><header>Part  "), p["division"], F.lit("</header><title><enum>I</enum><header>Money</header><appropriations-small><header>Pay</header></appropriations-small><section><enum>"), p["n"].cast("string"), F.lit(".</enum><text>For <quote>pay</quote> and rent.</text></section></title>"), F.lit(_RULES), F.lit("<section><enum>9.</enum><text>After "), p["division"], F.lit(".</text></section></division><division><enum>Z"), p["division"], F.lit("</enum><header>Short</header></division>")))
    marked = F.concat(F.lit("<!DOCTYPE bill><bill><form><legis-num>"), "identifier", F.lit("</legis-num><short-title>Act of Tests</short-title></form><legis-body><section><enum>1.</enum><text>What is before.</text></section>"), body, F.lit("<section><enum>99.</enum><text>At last.</text></section></legis-body></bill>"))
    marked = F.when(F.col("bill_dir").startswith("1996"), F.lit("<bill><legis-body>")).otherwise(marked)  # a year's are cut off
    return bills.select("bill_dir", plain.alias("value")), bills.select("bill_dir", marked.alias("value"))


def _bills(spark: SparkSession, d: str) -> DataFrame:
    root = _written(spark, d, *_JSON)
    if root not in _HEADS:
        _HEADS[root] = shared.kept(sources.heads(spark, root, _READ.get(root)), "heads")
    return _HEADS[root].orderBy("identifier", "bill_dir")


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The bills, and the provisions that they list: a part's JSON is parsed once for both, and for all queries of a session."""
    root = _written(spark, d, *_JSON)
    if root not in _READ:
        _READ[root] = shared.kept(sources.extracted(spark, root).select("bill_dir", "head", *model.fields()), "extracted")
    return _bills(spark, d), _READ[root]


def _text(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A one-row table as one file in the shared folder."""
    path = f"{shared.folder(spark)}/ledgerlark-bills/{name}-{uuid.uuid4().hex}"
    rows.coalesce(1).write.text(path)
    return path


@_query
def artifact_bills(spark, d):
    """OP-SRC-01/02/07, PRJ-12/14."""
    rows = _bills(spark, d)
    return rows.select("bill_dir", "identifier", "congress", texts_.bill_label(F.col("identifier"), F.col("congress")).alias("label"), F.col("meta.bill_nature").alias("nature"), F.col("n_provisions").alias("provisions"), F.round("verification.counts.completeness_pct", 6).alias("completeness_pct"))


@_query
def artifact_provisions(spark, d):
    """OP-PRJ-01 to 11: the accessor view of what was read."""
    bills, listed = _whole(spark, d)
    rows = sources.of_bills(listed, bills)
    return rows.select("bill_dir", "provision_index", "identifier", F.col("fiscal_years")[0].alias("fy"), "provision_type", "division", "account_name", "agency", "raw_text", "dollars", model.semantics_shown(F.col("semantics")).alias("semantics"), "amount_kind", "text_as_written", "fiscal_year", "detail_level", "description", "old_dollars", "availability")


@_query
def artifact_sidecars(spark, d):
    """OP-SRC-07, JOIN-01 to 03: checks, timings and divisions from their files."""
    root = _written(spark, d, "verification.json", "bill_meta.json")
    meta = sources.metadata(spark, root)
    a, t = model.checks(sources.verifications(spark, root))
    count = lambda rows, kind, value: rows.groupBy("bill_dir", F.lit(kind).alias("kind"), F.col(value).alias("value")).agg(F.count("*").alias("n"), F.sum("provision_index").alias("indices"))
    found = count(a, "amount", "status").unionByName(count(t, "text", "match_tier")).unionByName(count(model.timings(meta), "timing", "timing"))
    return found.unionByName(count(model.jurisdictions(meta).withColumn("provision_index", F.lit(0).cast("long")), "division", "jurisdiction"))


@_query
def artifact_summary(spark, d):
    """OP-AGG-02 over files: totals with class, completeness and the advance split."""
    bills, listed = _whole(spark, d)
    rows = summary.summarized(sources.of_bills(listed, bills), bills, model.timings(sources.metadata(spark, _written(spark, d, *_JSON))))
    return rows.select("bill_dir", "classification", "provisions", "budget_authority", "rescissions", "current_year_ba", "advance_ba")


@_query
def incomplete_bills(spark, d):
    """OP-FLT-20."""
    bills = _bills(spark, d).select("bill_dir", F.col("verification.counts.completeness_pct").alias("completeness_pct"))
    return summary.incomplete(bills, 60.0).select("bill_dir")


@_query
def artifact_sources(spark, d):
    """OP-SRC-03/04/05, PRJ-13: the text or XML to read of each bill."""
    rows = sources.sources(spark, _written(spark, d, _TEXTS))
    return rows.select("bill_dir", "stem", "kind", texts_.congress_of(F.col("path")).alias("congress"))


@_query
def artifact_text(spark, d):
    """OP-TXT-10, HASH-03, EXT-02."""
    rows = sources.source_text(spark, _written(spark, d, _TEXTS)).withColumns({"chunks_total": F.lit(1), "chunks_completed": F.lit(1)})
    return services.provenance(rows, "m", "1").select("bill_dir", "extracted_text_sha256", "model", "extraction_version")


@_query
def text_positions(spark, d):
    """OP-TXT-01 to 04, WIN-04, FLT-17: the whole index of each bill's text."""
    found = texts.index(sources.source_text(spark, _written(spark, d, _TEXTS)), "bill_dir", "source")
    money = found["dollar_amounts"].select("bill_dir", F.lit("amount").alias("kind"), F.col("amount").alias("label"), "position", F.col("value").alias("to"))
    early = texts.in_range(found["dollar_amounts"], 0, 60).select("bill_dir", F.lit("early").alias("kind"), F.col("amount").alias("label"), "position", F.col("value").alias("to"))
    heads = found["section_headers"].select("bill_dir", F.lit("section").alias("kind"), "label", F.col("start").alias("position"), F.col("end").alias("to"))
    clauses = found["proviso_clauses"].select("bill_dir", F.lit("proviso").alias("kind"), F.lit("").alias("label"), "position", F.lit(0).cast("long").alias("to"))
    return money.unionByName(early).unionByName(heads).unionByName(clauses)


@_query
def xml_bills(spark, d):
    """OP-SRC-14/15/16, TXT-09/11, STR-14: whole texts with what stands before, between and after divisions; broken files."""
    rows = xml.bills(spark, _written(spark, d, _TEXTS), most_tokens=12)
    shown = F.array_join(F.transform("divisions", lambda x: F.concat(x["letter"], F.lit("="), x["title"])), ";")
    return rows.select("bill_dir", "identifier", "short_title", "preamble", "full_text", "accounts", F.size("chunks").cast("long").alias("chunks"), shown.alias("divisions"), F.col("error").isNotNull().alias("failed"))


@_query
def xml_chunks(spark, d):
    """OP-SRC-14, TXT-09: chunks by division and title, with their place in the text and that text."""
    return xml.chunks(xml.bill_parts(spark, _written(spark, d, _TEXTS), most_tokens=12)).drop("path")


@_query
def xml_accounts(spark, d):
    """OP-SRC-14: accounts of each division's markup."""
    return xml.accounts_by_division(xml.bill_parts(spark, _written(spark, d, _TEXTS))).drop("path", "ord")


@_query
def xml_contexts(spark, d):
    """OP-STR-13: around the first mention of rent in each XML."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(_written(spark, d, _TEXTS), wholetext=True)
    return files.select(sources.directory().alias("bill_dir"), texts_.xml_context(F.col("value"), F.lit("and rent"), 45, 9).alias("context"))


@_query
def vector_files(spark, d):
    """OP-SRC-06, SNK-06, VEC-02: vectors written as flat files by bill, read back and scaled to length one."""
    from ..functions.vectors import unit

    root = f"{shared.folder(spark)}/ledgerlark-bills/{uuid.uuid4().hex}"
    numbered = _vectors(spark, d).withColumn("vec", F.col("vec").cast("array<float>"))
    sinks.write_vector_files(numbered, root, "m")
    rows = sources.vectors(spark, root)
    one = unit(F.col("vec"))
    return rows.select("bill_dir", "provision_index", "model", F.size("vec").alias("dimensions"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.aggregate(one, F.lit(0.0), lambda a, x: a + x * x), 4).alias("unit_length"))


def _fas_file(spark: SparkSession, d: str) -> DataFrame:
    n = bridge.table(spark, d, "nation")
    rows = n.select(F.concat(F.lpad(F.col("n_regionkey").cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("n_nationkey") * 400).cast("string"), 4, "0")).alias("fas_code"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("agency_code"), F.lpad((F.col("n_nationkey") * 400).cast("string"), 4, "0").alias("main_account"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 3 == 0, "revolving").otherwise("general").alias("fund_type"), "n_nationkey")
    fields = F.struct("fas_code", "agency_code", "main_account", "title", "fund_type")
    text = rows.agg(F.to_json(F.struct(F.collect_list(F.when(F.col("n_nationkey") % 5 < 4, fields)).alias("accounts"), F.collect_list(F.when(F.col("n_nationkey") % 5 == 4, fields)).alias("discontinued"))).alias("value"))
    return sources.fas_reference(spark, _text(spark, text, "fas"))


@_query
def account_reference(spark, d):
    """OP-SRC-09, FLT-13/14, TAS-05: active and discontinued accounts; which are an agency's, and of its general fund."""
    rows = _fas_file(spark, d)
    mine = accounts.of_agency(rows, "001").select("fas_code", F.lit(True).alias("mine"))
    general = accounts.general_fund(rows, "001").select("fas_code", F.lit(True).alias("general"))
    return accounts.by_code(rows.withColumn("agency_name", F.lit("x"))).select("fas_code", "fas_title", "agency_code").join(rows.select("fas_code", "status"), "fas_code").join(mine, "fas_code", "left").join(general, "fas_code", "left").fillna(False)


@_query
def spreadsheet_accounts(spark, d):
    """OP-SRC-19, STR-18, AGG-16, SET-06: account strings collapsed to codes; changed ones that aren't active."""
    p, k = bridge.table(spark, d, "part"), F.col("p_partkey")
    tas = F.concat(F.lpad((k % 7).cast("string"), 3, "0"), F.when(k % 2 == 0, "-X-").otherwise("-2024-"), F.lpad((k % 20).cast("string"), 4, "0"))
    active = p.where("p_partkey % 20 < 15").select(tas.alias("tas"), F.col("p_name").alias("title"), F.lpad((k % 28 + 1).cast("string"), 2, "0").alias("last_updated"), k.alias("ord"))
    changes = p.where("p_partkey % 20 >= 10").select(tas.alias("tas"), F.col("p_name").alias("title"), F.lit("end").alias("action"))
    rows = fastbook.reference(active, changes)
    kinds = fastbook.fund_type(F.element_at(F.array(*map(F.lit, ["General Fund", "Trust funds", "x Special", "Deposit", " Own "])), (F.length("title") % 5 + 1).cast("int")))
    return rows.select("fas_code", "title", "status", "last_updated", "has_no_year_variant", "has_annual_variant", "tas_variants", "agency_code", "main_account", kinds.alias("fund"))


@_query
def registry_file(spark, d):
    """OP-SRC-10: authorities written to their file and read back."""
    mapped = _mapped(spark, d)
    made = accounts.authorities(mapped, bridge.fas_accounts(spark, d)).select("fas_code", "agency_code", "fas_title", "agency_name", "total_dollars", "fiscal_years")
    file = made.agg(F.to_json(F.struct(F.collect_list(F.struct(*made.columns)).alias("authorities"))).alias("value"))
    return sources.authorities(spark, _text(spark, file, "registry")).select("fas_code", "total_dollars", F.array_join("fiscal_years", ",").alias("years"))


@_query
def tas_file(spark, d):
    """OP-SRC-08: account codes written beside the bills and read back; a year's files are broken and left out."""
    fields = F.struct("provision_index", "account_name", "agency", "dollars", "fas_code", "fas_title", "confidence", "method")
    per = _mapped(spark, d).groupBy(_dir().alias("bill_dir"), F.expr(f"provision_index div {PART}").cast("int").alias("part")).agg(F.first("identifier").alias("identifier"), F.collect_list(fields).alias("mappings"))
    text = F.to_json(F.struct(F.col("bill_dir"), F.col("identifier").alias("bill_identifier"), "mappings"))
    root = f"{shared.folder(spark)}/ledgerlark-bills/{uuid.uuid4().hex}"
    sinks.write_artifact(per.select("bill_dir", "part", F.when(F.col("bill_dir").startswith("1995"), F.left(text, F.lit(50))).otherwise(text).alias("value")), root, "tas_mapping.json.gz")
    rows = sources.tas_mappings(spark, root)
    return rows.groupBy("bill_dir", "confidence").agg(F.count("*").alias("n"), F.sum("provision_index").alias("indices"), F.count_distinct("fas_code").alias("codes"), F.coalesce(F.sum("dollars"), F.lit(0)).alias("dollars"))


@_query
def missing_metadata(spark, d):
    """OP-FLT-08: the bills for which a subcommittee can't be asked."""
    return search.without_metadata(_bills(spark, d)).select("bill_dir", "error")


@_query
def subcommittee_files(spark, d):
    """OP-FLT-08, OP-JOIN-03: provisions of a subcommittee's divisions, by the metadata files of bills that have one."""
    bills, listed = _whole(spark, d)
    bills = bills.where("meta is not null")
    parts = model.jurisdictions(sources.metadata(spark, _written(spark, d, *_JSON)))
    rows = search.of_subcommittee(sources.of_bills(listed, bills), bills, parts.withColumn("jurisdiction", F.lower("jurisdiction")), "jb")
    return rows.groupBy("bill_dir", "division").agg(F.count("*").alias("n"), F.sum("provision_index").alias("indices"))


@_query
def rules_file(spark, d):
    """OP-SRC-11."""
    n = bridge.table(spark, d, "nation")
    text = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")).agg(_listed("n_regionkey", F.struct(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("canonical"), F.col("names").alias("members"))).alias("g"), _listed("n_regionkey", F.struct(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("canonical"), F.col("names").alias("aliases"))).alias("a"))
    file = text.select(F.to_json(F.struct(F.struct(F.col("g").alias("agency_groups"), F.col("a").alias("account_aliases")).alias("entities"))).alias("value"))
    groups, aliases = sources.rules(spark, _text(spark, file, "rules"))
    return groups.select("ord", "canonical", F.col("member").alias("name"), F.lit("group").alias("kind")).unionByName(aliases.select("ord", "canonical", F.col("alias").alias("name"), F.lit("alias").alias("kind")))


@_query
def links_file(spark, d):
    """OP-SRC-12, FLT-15, JOIN-15, LNK-03: accepted links from their file, without one removed, of one bill, and as flags."""
    c = _candidates(spark, d)
    chosen = c.where("confidence = 'verified'")
    ref = lambda s: F.struct(F.col(f"{s}_dir").alias("bill_dir"), F.col(f"{s}_index").alias("provision_index"), F.lit("l").alias("label")).alias(s)
    listed = chosen.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("hash", ref("source"), ref("target"), F.col("similarity").cast("float").alias("similarity")))).alias("accepted"))).alias("value"))
    held = sources.links(spark, _text(spark, listed, "links"))
    flat = held.select("hash", F.col("source.bill_dir").alias("source_dir"), F.col("target.bill_dir").alias("target_dir"), F.col("source.provision_index").alias("source_index"))
    kept = links.of_bill(links.removed(flat, [r.hash for r in flat.orderBy("hash").limit(1).collect()]), "3")
    return links.with_accepted(links.with_accepted(c, flat), kept, "kept").groupBy("already_accepted", "kept").agg(F.count("*").alias("n"))


@_query
def cpi_file(spark, d):
    """OP-SRC-13."""
    n = bridge.table(spark, d, "nation")
    month = F.concat(F.lit("2024-"), F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0"))
    rows = n.where("n_nationkey < 12").select(month.alias("k"), (F.col("n_regionkey") + 0.5).alias("v"), "n_nationkey")
    text = rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("monthly"), F.map_from_entries(F.collect_list(F.struct((F.col("n_nationkey") + 2000).cast("string"), "v"))).alias("annual_averages"), F.expr("map('2001', named_struct('months', 3))").alias("partial_years"))).alias("value"))
    monthly, annual = sources.cpi(spark, _text(spark, text, "cpi"))
    return monthly.select("ym", "value", F.lit(0).alias("months")).unionByName(annual.select(F.col("fy").cast("string").alias("ym"), "value", "months"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers, one per order: fenced or chatty, dollars as numbers or texts, unknown types, elements that are no objects."""
    items, k = bridge.table(spark, d, "lineitem"), F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ["appropriation", "rescission", "earmark_list", "rider"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    price = F.col("l_extendedprice").cast("long")
    worth = F.when(k % 3 == 0, F.concat(F.lit('"$'), F.format_number(price, 0), F.lit('"'))).otherwise(price.cast("string"))
    when = F.when(k % 2 == 0, '"until spent"').when(k == 5, '{"period":"one-year"}').otherwise("null")
    limit = F.when(k == 1, '{"percentage":5.5}').when(k == 2, '{"fixed_amount":7}').when(k == 3, '"unlimited"').when(k == 4, "9").otherwise("null")
    one = F.concat(F.lit('{"provision_type":"'), kind, F.lit('","account_name":"a'), F.col("l_suppkey").cast("string"), F.lit('","fiscal_year":2024,"confidence":0.5,"amount":{"value":{"kind":"specific","dollars":'), worth, F.lit('},"semantics":"new_budget_authority"},"availability":'), when, F.lit(',"limit":'), limit, F.lit(',"earmarks":[{"recipient":"r"}]}'))
    element = F.when(k == 7, '"lost"').otherwise(one)
    per = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", element.alias("e")))), lambda e: e["e"]), ",").alias("all"))
    body = F.concat(F.lit('{"provisions":['), "all", F.lit("]}"))
    told = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("Sure! "), body)).otherwise(F.concat(F.lit("["), "all", F.lit("]")))
    return per.select(F.col("l_orderkey").alias("id"), told.alias("answer"))


@_query
def lenient_provisions(spark, d):
    """OP-JSON-01 to 04, 07, 08: answers to chunks, whose provisions stand alone or in a bare list."""
    rows = lenient.provisions(_answers(spark, d), "id", "answer", chunks=True)
    return rows.select("id", "ord", "failed", "provision_type", "llm_classification", "account_name", "fiscal_year", "confidence", F.coalesce("amount.dollars", F.get("amounts", F.lit(0))["dollars"]).alias("dollars"), "type_coercions", F.col("availability.text").alias("availability"))


@_query
def lenient_report(spark, d):
    """OP-AGG-18."""
    per = lenient.report(lenient.provisions(_answers(spark, d), "id", "answer", chunks=True), "id")
    return per.agg(*[F.sum(c).alias(c) for c in per.columns if c not in ("id", "error", "warnings")], F.count("error").alias("errors"), F.sum(F.size("warnings")).alias("warnings"))


def _typed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whole answers, one per order, of all eleven types: every provision names the fields of every type, in shapes that
    differ by line; seven kinds of answers are broken."""
    items, k, price = bridge.table(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_extendedprice").cast("long").cast("string")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), k)
    kind = F.element_at(F.array(*map(F.lit, [*model.TYPES[:-1], "novelty"])), (F.col("l_partkey") % 11 + 1).cast("int"))
    money = F.when(k == 1, F.concat(F.lit('{"dollars":'), price, F.lit(',"semantics":"rescission","text_as_written":"$x"}'))).otherwise(pick("", '{"dollars":"$1,234"}', '{"kind":"such_sums"}', '{"value":{"kind":"none"},"dollars":4}', "null", '{"dollars":12.5}', '"text"'))
    name = F.when(k % 3 == 0, F.lit("null")).when(k % 3 == 1, F.concat(F.lit('"a'), F.col("l_suppkey").cast("string"), F.lit('"'))).otherwise(F.lit("12"))
    fields = {
        "provision_type": F.concat(F.lit('"'), kind, F.lit('"')), "section": F.concat(F.lit('"S'), k.cast("string"), F.lit('"')), "division": F.lit('"A"'), "confidence": pick("0.5", '"0.25"', "null", '"much"', "1", "0", "0.75"), "raw_text": F.lit('"r"'),
        "notes": F.lit('["n",5,"m"]'), "cross_references": F.lit('[{"ref_type":"amends","target":"t"},7]'), "account_name": name, "agency": pick('"g"', "3", '"h"', "null", '"g"', '"g"', '"g"'), "amount": money,
        "new_amount": F.concat(F.lit('{"value":{"kind":"specific","dollars":'), price, F.lit("}}")), "old_amount": F.when(k % 2 == 0, F.concat(F.lit('{"dollars":"'), price, F.lit('"}'))).otherwise("null"), "fiscal_year": pick("2024", '"2025"', "-1", "2024.5", "null", '"x"', "2030"),
        "availability": pick('"no_year"', '"until spent"', '{"no_year":true}', '{"fiscal_year":2026}', '{"through":2027}', '{"x":1}', "9"), "limit": pick('{"percentage":5.5}', '{"fixed_amount":{"dollars":7}}', '"unlimited"', "9", "null", '{"dollars":8}', '{"fixed_amount":7}'),
        "provisos": F.lit('[{"proviso_type":"limitation","amount":{"dollars":3},"references":["x",1]},1]'), "earmarks": F.lit('[{"recipient":"r"},"no"]'), "recipient": F.lit('"rr"'), "detail_level": F.lit('"line_item"'), "from_scope": F.lit('"from"'), "conditions": F.lit('["c"]'), "reference_act": F.lit('"act"'),
        "program_name": F.lit('"pn"'), "period": F.lit('"pe"'), "description": pick('"de"', "null", "[1]", '"de"', '"de"', '"de"', '"de"'), "deadlines": F.lit('["dl"]'), "policy_area": F.lit('"pol"'), "reference_year": pick("2020", '"2021"', "null", "2020", "2020", "2020", "2020"), "rate": F.lit("0.5"), "foo": F.lit('{"bar":[1,"z"]}'),
    }
    one = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), c) for n, c in fields.items())), F.lit("}"))
    element = F.when((k == 7) & (F.col("l_suppkey") % 2 == 0), '"lost"').otherwise(one)
    per = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", element.alias("e")))), lambda e: e["e"]), ",").alias("all"))
    broken = F.col("l_orderkey") % 13
    head = F.when(broken == 2, "").when(broken == 3, '"bill":7,').otherwise('"bill":{"identifier":"H.R. 1","classification":"omnibus","fiscal_years":[2024,"x",2025],"divisions":["A",2]},')
    tail = F.when(broken == 4, "").when(broken == 5, ',"summary":[]').otherwise(F.concat(F.lit(',"summary":{"total_provisions":'), F.col("l_orderkey").cast("string"), F.lit(',"by_type":{"rider":2,"x":"y"},"total_budget_authority":"5","flagged_issues":["i"]}')))
    told = F.when(broken == 0, "no json here").when(broken == 1, "[1,2]").otherwise(F.concat(F.lit("{"), head, F.lit('"provisions":'), F.when(broken == 6, '"none"').otherwise(F.concat(F.lit("["), "all", F.lit("]"))), tail, F.lit("}")))
    return per.select(F.col("l_orderkey").alias("id"), told.alias("answer"))


@_query
def lenient_union(spark, d):
    """OP-JSON-01 to 06: every field of every type, failed elements and failed answers."""
    rows = lenient.provisions(_typed_answers(spark, d), "id", "answer")
    money = lambda c: F.concat_ws("/", f"{c}.kind", F.col(f"{c}.dollars").cast("string"), f"{c}.semantics", f"{c}.text_as_written")
    texts_of = lambda c: F.array_join(c, "+")
    return rows.select(
        "id", "ord", "failed", "error", "provision_type", "llm_classification", "section", "division", "confidence", texts_of("notes").alias("notes"), F.array_size("cross_references").alias("refs"), "account_name", "agency", "description", "detail_level", "from_scope", "to_scope", "reference_act", "reference_section", "program_name", "period", "policy_area", "rate", texts_of("conditions").alias("conditions"), texts_of("deadlines").alias("deadlines"),
        money("amount").alias("amount"), money("new_amount").alias("new_amount"), money("old_amount").alias("old_amount"), F.array_size("amounts").alias("amounts"), F.get("amounts", F.lit(0))["dollars"].alias("other_dollars"), "fiscal_year", "reference_year", F.concat_ws("/", "availability.kind", F.col("availability.year").cast("string"), "availability.text").alias("availability"),
        F.concat_ws("/", "limit.kind", F.col("limit.percentage").cast("string"), F.col("limit.amount.dollars").cast("string"), "limit.text").alias("limit"), F.array_size("provisos").alias("provisos"), F.get("provisos", F.lit(0))["amount"]["dollars"].alias("proviso_dollars"), F.array_size("earmarks").alias("earmarks"), "earmark.recipient", F.array_size(F.map_keys("metadata")).alias("leftover"), F.col("metadata")["foo"].alias("foo"), "null_to_default", "type_coercions", "warning",
    )


@_query
def lenient_answers(spark, d):
    """OP-JSON-01, OP-AGG-18: what answers say of the bill, their summary, and the report on each, failed ones by name."""
    def heads(v):  # noqa: ANN001, ANN202
        b, s = lenient.bill(v), lenient.summary(v)
        return F.struct(b["identifier"].alias("identifier"), F.array_join(b["fiscal_years"].cast("array<string>"), ",").alias("years"), F.array_join(b["divisions"], ",").alias("divisions"), s["total_provisions"].alias("told"), (s["by_type"]["rider"] + s["by_type"]["x"]).alias("riders"), s["total_budget_authority"].alias("told_authority"), F.array_join(s["flagged_issues"], ",").alias("issues"))

    per = lenient.report(lenient.provisions(_typed_answers(spark, d), "id", "answer", heads=heads), "id")
    good = F.col("error").isNull()
    return per.select("id", "error", "provisions_parsed", "provisions_failed", "null_to_default", "type_coercions", "unknown_provision_types", F.size("warnings").alias("warnings"), *(F.when(good, F.col(f"heads.{c}")).alias(c) for c in ("identifier", "years", "divisions", "told", "riders", "told_authority", "issues")))


@_query
def upgraded_files(spark, d):
    """OP-JSON-09, UPG-01: extractions without a version, their zero and missing amounts migrated; versioned ones stay."""
    o, k = bridge.table(spark, d, "orders"), F.col("o_orderkey")
    amount = F.struct(F.struct(F.lit("specific").alias("kind"), F.when(k % 2 == 0, F.lit(0)).otherwise(k).cast("bigint").alias("dollars")).alias("value"), F.when(k % 3 == 0, "missing").otherwise("limitation").alias("semantics"), F.when(k % 5 == 0, "$0").otherwise("").alias("text_as_written"))
    rows = o.select(k.alias("id"), F.when(k % 7 == 0, "1.0").alias("schema_version"), F.array(F.struct(amount.alias("amount"))).alias("provisions"))
    new = lenient.upgraded(rows).select("schema_version", F.col("provisions")[0]["amount"].alias("a"), "id")
    return new.groupBy("schema_version", F.col("a.value.kind").alias("kind"), F.col("a.semantics").alias("semantics")).agg(F.count("*").alias("n"), F.sum("a.value.dollars").alias("dollars"))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    view = _view(spark, d)
    return search.search(view, search.Criteria(provision_type="rescission", fiscal_year=CURRENT_FY), search.evidence(*bridge.checks(view)))


@_query
def export_csv(spark, d):
    """OP-SNK-03: search results written as CSV and read back as text."""
    path = f"{shared.folder(spark)}/ledgerlark-bills/csv-{uuid.uuid4().hex}"
    sinks.write_csv(_exported(spark, d), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("bill", "provision_index", "account_name", F.coalesce("agency", F.lit("")).alias("agency"), "dollars", F.coalesce("old_dollars", F.lit("")).alias("old_dollars"), "amount_status", "quality", "confidence", "raw_text")


@_query
def export_jsonl(spark, d):
    """OP-SNK-02."""
    path = f"{shared.folder(spark)}/ledgerlark-bills/jsonl-{uuid.uuid4().hex}"
    sinks.write_jsonl(_exported(spark, d).select("bill_dir", "provision_index", "dollars", "account_name", F.lit(None).cast("string").alias("nothing")), path)
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", "bill_dir string, provision_index long, dollars long, account_name string").alias("j"), F.contains("value", F.lit('"nothing":null')).alias("nulls_kept")).select("j.*", "nulls_kept")


@_query
def shown_texts(spark, d):
    """OP-STR-09 to 12, 15, DATE-02/03: formats of amounts, sizes, texts and days."""
    o, p = bridge.table(spark, d, "orders"), F.col("o_totalprice")
    t = F.concat(F.lit("Éé"), "o_orderpriority", F.lit("—ü\nend"))
    cents = F.round(p * 100).cast("long") * F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1_000_000)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", texts_.dollars_short(cents).alias("short"), texts_.bytes_text(F.floor(p * 10)).alias("size"), texts_.truncated(t, 10).alias("cut_bytes"), texts_.shortened(t, 10).alias("cut_chars"), texts_.context(t, F.lit(12), 9).alias("around"), fiscal_year(F.col("o_orderdate")).alias("fy"), is_stale(F.col("o_orderdate"), F.lit("1996-06-01").cast("date")).alias("stale"))


@_query
def bill_filters(spark, d):
    """OP-FLT-10/11."""
    o, k = bridge.table(spark, d, "orders"), F.col("o_orderkey")
    bills = o.select(k.alias("id"), F.when(k % 3 == 0, "Became Public Law No: 1").when(k % 3 == 1, "BECAME LAW").otherwise("Referred").alias("latest_action"), F.when(k % 2 == 0, "Energy Appropriations Act").otherwise("Farm Act").alias("title"))
    return services.about_appropriations(services.enacted(bills)).groupBy("latest_action").agg(F.count("*").alias("n"))


@_query
def applied_answers(spark, d):
    """OP-JOIN-21: answers for unmatched rows; codes of the reference are high, others inferred."""
    mapped, fas = _mapped(spark, d), bridge.fas_accounts(spark, d)
    known = fas.agg(F.min("fas_code").alias("c"))
    answers = mapped.select("bill_dir", "provision_index").join(F.broadcast(known)).select("bill_dir", "provision_index", F.when(F.col("provision_index") % 3 == 0, F.col("c")).when(F.col("provision_index") % 3 == 1, "999-9999").alias("fas_code")).where("fas_code is not null")  # known: one row
    return accounts.applied(mapped, answers, fas).groupBy("confidence", "method").agg(F.count("*").alias("n"))


@_query
def labelled_years(spark, d):
    """OP-JOIN-20: bills of each code and year with what is special about them."""
    mapped = _mapped(spark, d)
    nature = F.when(F.col("identifier") < "2", "continuing_resolution").when(F.col("identifier") < "3", "supplemental").otherwise("regular")
    rows = accounts.labelled_timeline(mapped, mapped.select("bill_dir", "identifier").distinct().select("bill_dir", nature.alias("bill_nature")))
    return rows.select("fas_code", "fy", F.array_join("bills", ";").alias("bills"))


@_query
def traced(spark, d):
    """OP-AUT-03, TRC-01: all codes of which the words are found, with their years, names and events."""
    found = accounts.trace(_mapped(spark, d), bridge.fas_accounts(spark, d), "economy nation_1")
    counted = lambda name: found[name].groupBy("fas_code").agg(F.count("*").alias(name))
    return found["authority"].select("fas_code", "total_dollars").join(counted("timeline"), "fas_code").join(counted("variants"), "fas_code")


def _suggested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    view = _view(spark, d).withColumn("account_name", F.concat_ws(" ", "account_name", "nation")).withColumn("agency", F.concat(F.when(F.col("fy") < CURRENT_FY, "Bureau of Nation ").otherwise("Nation "), F.col("nation")))
    return view, entities.suggest(view)


@_query
def suggestions_left(spark, d):
    """OP-FLT-16, ER-04: suggestions with enough accounts that no group knows."""
    _, found = _suggested(spark, d)
    groups = found.where("member < 'Nation 2'").select("canonical", "member")
    return entities.accepted(entities.not_known(found, groups, 2)).select("canonical", "member", "orphan_pairs_resolved")


@_query
def suggestion_clusters(spark, d):
    """OP-JOIN-22."""
    view, found = _suggested(spark, d)
    exact = found.withColumn("example_accounts", F.array(F.lit("red ")))
    return entities.clusters(view, exact).select(F.array_join("agencies", ";").alias("agencies"), "provisions")


@_query
def audit_verbose(spark, d):
    """OP-AUD-01."""
    claims, docs = _pairs(spark, d)
    from .queries import _refs

    rows = verify.audit_details(verify.amounts(claims, docs, _refs(docs)), verify.texts(claims, docs))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("provision_index").alias("indices"))


@_query
def text_tiers_by_bill(spark, d):
    """OP-RES-01."""
    claims, docs = _pairs(spark, d)
    return verify.tier_histogram(claims, docs)


@_query
def lost_contexts(spark, d):
    """OP-RES-01: the source around an account name, for texts that aren't found."""
    claims, docs = _pairs(spark, d)
    named = claims.join(docs, "bill_dir").select(*claims.columns, F.lit(None).cast("string").alias("section"), F.substring("source", 31, 12).alias("account_name"))
    return verify.miss_context(named, docs, before=5, after=20)


@_query
def amount_misses(spark, d):
    """OP-RES-02."""
    claims, docs = _pairs(spark, d)
    return verify.misses(claims, docs)


@_query
def stale_stages(spark, d):
    """OP-STALE-01."""
    o, k = bridge.table(spark, d, "orders"), F.col("o_orderkey")
    as_text = lambda c: c.cast("string")
    bills = o.select(as_text(k).alias("bill_dir"), as_text(k).alias("source_sha256"), as_text(k - k % 2).alias("extracted_from"), as_text(k).alias("extraction_sha256"), F.when(k % 3 == 0, as_text(k + 1)).when(k % 3 == 1, as_text(k)).alias("meta_of"), as_text(k % 5 + k).alias("vectors_of"))
    return verify.staleness(bills).groupBy("stale").agg(F.count("*").alias("n"))


@_query
def enrichment(spark, d):
    """OP-CLS-04, ENR-01: the sidecar tables of bills that have none yet."""
    view = _view(spark, d)
    todo = classify.to_enrich(view.select("bill_dir").distinct(), view.where("fy % 2 = 0").select("bill_dir").distinct())
    mine = view.join(todo, "bill_dir", "left_semi")
    made = classify.enriched(mine, mine.select("bill_dir", "division").distinct().withColumn("title", F.element_at(F.array(*map(F.lit, ["Department of Defense", "Homeland Security", "Other Matters", "Energy and Water Development", "Further Continuing Appropriations"])), F.ascii("division") - 64)))
    tables = [made["subcommittees"].select("bill_dir", F.lit("subcommittee").alias("kind"), F.col("jurisdiction").alias("value")), made["provision_timing"].select("bill_dir", F.lit("timing").alias("kind"), F.col("timing").alias("value")), made["canonical_accounts"].select("bill_dir", F.lit("account").alias("kind"), F.lit("").alias("value")), made["bill_nature"].select("bill_dir", F.lit("nature").alias("kind"), F.col("bill_nature").alias("value"))]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("bill_dir", "kind", "value").agg(F.count("*").alias("n"))


@_query
def compare_described(spark, d):
    """OP-PRJ-15, CMP-02, SORT-02: both sides in words, the warning, and the largest changes in order."""
    view = _view(spark, d)
    sides = {"base": _year(view, BASE_FY), "current": _year(view, CURRENT_FY)}
    said = {k: compare.described(v.select("identifier", "bill_dir", "congress").distinct()) for k, v in sides.items()}
    first = compare.ordered(_compared(spark, d, rescue=False)).select("k_account", "delta").limit(3).collect()
    warning = compare.cross_type_warning(sides["base"].withColumn("classification", F.lit("omnibus")), sides["current"].withColumn("classification", F.lit("regular")))
    rows = [*said.items(), ("warned", str(warning is not None).lower()), *[(f"change {i}", f"{r.k_account}: {r.delta}") for i, r in enumerate(first)]]
    return spark.createDataFrame(rows, "name string, value string")


@_query
def centroid_labels(spark, d):
    """OP-VEC-04, RES-05: labels' centroids from the first half of their vectors, tried on the second half."""
    e = bridge.table(spark, d, "embeddings")
    half = F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("bill_dir")
    labelled = e.select(half, F.col("vec_id").alias("provision_index"), F.col("label").cast("string").alias("label"))
    vectors = e.select(half, F.col("vec_id").alias("provision_index"), F.col("embedding").alias("vec"))
    chosen, tests = links.exemplars(labelled)
    found = links.nearest_centroid(vectors.join(tests, ["bill_dir", "provision_index"], "left_semi"), links.centroids(vectors, chosen))
    return found.withColumnRenamed("label", "nearest").join(tests, ["bill_dir", "provision_index"]).groupBy("label").agg(F.count("*").alias("tested"), F.count_if(F.col("nearest") == F.col("label")).alias("right"))


class _Lengths:
    """A stand-in for a model: lengths of texts."""

    model = "lengths"

    def embed(self, told: list[str]) -> list[list[float]]:
        return [[float(len(t)), 1.0] for t in told]

    def extract(self, chunk: str) -> str:
        if len(chunk) % 2:
            raise ValueError("odd")
        return str(len(chunk))


@_query
def embedded_texts(spark, d):
    """OP-EMB-01: texts of bills that weren't embedded yet, by a stand-in for the model."""
    told = model.embedding_text(_view(spark, d)).withColumn("extraction_sha256", F.lit("h"))
    done = told.where("bill_dir < '1996'").select("bill_dir", "extraction_sha256").distinct()
    return services.embedded(told, _Lengths(), done).groupBy("bill_dir").agg(F.count("*").alias("n"), F.sum(F.col("vec")[0].cast("long")).alias("letters"))


@_query
def extracted_chunks(spark, d):
    """OP-EXT-01: answers of a stand-in for the model, and the error of those it always fails on."""
    rows = bridge.table(spark, d, "nation").select("n_name", F.col("n_name").alias("bill_dir"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("text"))
    return services.extracted(rows, _Lengths(), tries=1).select("bill_dir", "answer", "error")


@_query
def repaired_spans(spark, d):
    """OP-REP-01 to 04, VTX-01: excerpts with another start or with changed line breaks get their source's text and span."""
    docs = bridge.table(spark, d, "documents").where("length(text) >= 400").select(F.col("doc_id").alias("bill_dir"), F.col("text").alias("source"))
    k, t = F.col("bill_dir") % 3, F.substring("source", 101, 200)
    claims = docs.select("bill_dir", F.lit(0).cast("long").alias("provision_index"), F.when(k == 0, t).when(k == 1, F.concat(F.left(t, F.lit(120)), F.lit(" zzzzzz"))).otherwise(F.lit("ǂǂ")).alias("raw_text"))
    _, new = repair.verify_text(claims, docs, write=True)
    rows = new.select("bill_dir", "provision_index", F.col("source_span.start").alias("start"), F.col("source_span.end").alias("end"), F.col("raw_text").alias("text"), F.col("source_span.match_tier").alias("match_tier"))
    held = repair.span_holds(rows, docs)
    return rows.join(held, ["bill_dir", "provision_index"], "left").groupBy("match_tier", "holds").agg(F.count("*").alias("n"))


@_query
def repaired_tiers(spark, d):
    """OP-REP-01 to 04: an order is a bill of one section a line; each section is claimed as it stands, with another end,
    with another start, with other blanks, or backwards."""
    keys = [c for c in bridge.ROW_ORDER if c != "l_orderkey"]
    listed = F.array_sort(F.collect_list(F.struct(*keys)))
    root = f"{shared.folder(spark)}/ledgerlark-repair/{uuid.uuid4().hex}"
    # lines are shuffled once, as numbers; an order's are kept together, so that its text needs no shuffle
    orders = bridge._kept(bridge.table(spark, d, "lineitem").groupBy("l_orderkey").agg(listed.alias("lines")), f"{root}/orders")
    money = lambda c: F.round(c * 100).cast("long").cast("string")
    section = lambda x, n: F.concat(F.lit("SEC. "), n.cast("string"), F.lit(". For part "), x["l_partkey"].cast("string"), F.lit(" of "), x["l_suppkey"].cast("string"), F.lit(", $"), money(x["l_extendedprice"]), F.lit(", available until spent."))
    docs = orders.select(F.col("l_orderkey").alias("bill_dir"), F.array_join(F.transform("lines", lambda x, i: section(x, i + 1)), "\n").alias("source"))
    each = orders.select(F.col("l_orderkey").alias("bill_dir"), F.posexplode("lines").alias("pos", "x"))
    rows = each.select("bill_dir", (F.col("pos") + 1).cast("long").alias("provision_index"), section(F.col("x"), F.col("pos") + 1).alias("s"))
    k = (F.col("bill_dir") + F.col("provision_index")) % 5
    raw = F.when(k == 0, F.col("s")).when(k == 1, F.concat("s", F.lit(" (as amended)"))).when(k == 2, F.concat(F.lit("zzzzzzzzzz"), "s")).when(k == 3, F.replace("s", F.lit(" "), F.lit("  "))).otherwise(F.reverse("s"))
    found = repair.repaired(rows.select("bill_dir", "provision_index", raw.alias("raw_text")), docs)
    return repair.with_holds(found, docs)


@_query
def token_rate_stream(spark, d):
    """OP-WIN-07 over the events as a stream: rates of all events that the watermark has passed."""
    store, mine = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    had, root = spark.conf.get(store, None), f"{shared.folder(spark)}/ledgerlark-stream/{uuid.uuid4().hex}"
    events = spark.readStream.schema(bridge.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")  # a pattern, so that a single file will do
    spark.conf.set(store, mine)
    try:
        rates = token_rates.event_rate(events, seconds=36_000, late="1 hour")
        rates.writeStream.format("parquet").option("path", f"{root}/rates").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store) if had is None else spark.conf.set(store, had)
    return spark.read.parquet(f"{root}/rates").select("user_id", "ts", "rate")


@_query
def nearest_amounts(spark, d):
    """OP-JOIN-18: an amount found only in the plain text accounts for the nearest one of the index."""
    docs = sources.source_text(spark, _written(spark, d, _TEXTS))
    refs = texts.amount_refs(docs, "bill_dir", "source")
    claims = docs.select("bill_dir", F.lit(0).cast("long").alias("provision_index"), F.lit("part B").alias("text_as_written"))
    return verify.accounted(verify.amounts(claims, docs, refs), docs, refs)


@_query
def repaired_report(spark, d):
    """OP-AGG-28."""
    docs = bridge.table(spark, d, "documents").where("length(text) >= 400").select(F.col("doc_id").alias("bill_dir"), F.col("text").alias("source"))
    k = F.col("bill_dir") % 3
    claims = docs.select("bill_dir", F.lit(0).cast("long").alias("provision_index"), F.when(k == 0, F.substring("source", 101, 200)).when(k == 1, F.concat(F.substring("source", 101, 120), F.lit(" zzzzzz"))).otherwise(F.lit("ǂǂ")).alias("raw_text"))
    return repair.report(repair.repaired(claims, docs)).select("bill_dir", "total", "exact", "repaired_prefix", "unverified", F.round("traceable_pct", 6).alias("traceable_pct"))


@_query
def bill_chunks(spark, d):
    """OP-TXT-05 to 08: divisions past the table of contents, their titles, and long titles cut at paragraphs."""
    per = _view(spark, d).groupBy(_dir().alias("bill_dir"), "division").agg((F.count("*") % 50).cast("int").alias("n"))
    body = F.concat(F.lit("DIVISION "), "division", F.lit("-HEAD\nTITLE I-X\n"), F.rpad(F.lit("a"), F.col("n") + 40, F.lit("a")), F.lit("\nTITLE II-Y\n"), F.repeat(F.lit("b"), F.lit(100)), F.lit("\n\n"), F.repeat(F.lit("c"), F.lit(100)), F.lit("\n"))
    bills = per.groupBy("bill_dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("division", body.alias("t")))), lambda e: e["t"]), "").alias("t"))
    rows = texts.chunk_table(bills.select("bill_dir", F.concat(F.lit("DIVISION A-CONTENTS\n"), F.repeat(F.lit("p"), F.lit(2600)), F.lit("\n"), "t").alias("text")), "bill_dir", "text", 40)
    return rows.select("bill_dir", "label", "division", "title", "start", "end", "estimated_tokens")
