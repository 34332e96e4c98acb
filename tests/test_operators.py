import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import accounts, classify, compare, containment, entities, inflation, lenient, links, model, repair, reports, search, summary, text, verify
from ledgerlark.sources import bills as source
from ledgerlark.sources import xml


def provision(kind, dollars=None, **more):
    amount = {"value": {"kind": "specific", "dollars": dollars}, "semantics": more.pop("semantics", "new_budget_authority"), "text_as_written": f"${dollars:,}"} if dollars is not None else None
    return {"provision_type": kind, "section": "1", "division": more.pop("division", None), "confidence": 0.9, "raw_text": more.pop("raw_text", "For x, $1"), "amount": amount} | more


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    one = at / "118-hr1"
    one.mkdir()
    provisions = [
        provision("appropriation", 100, account_name="VA—Pensions", agency="Department of VA", detail_level="top_level", availability="to remain available until October 1, 2030", fiscal_year=2024),
        provision("appropriation", 40, account_name="Pensions", agency="Department of VA", detail_level="sub_allocation"),
        provision("appropriation", 7, account_name="Other", agency="Office of Inspector General, Department of VA", availability={"two_year": {"through": 2025}}),
        provision("rescission", -30, semantics="rescission", account_name="Pensions", agency="Department of VA"),
        provision("limitation", 9, semantics="limitation", account_name="Cap"),
        provision("rider", description="none shall"),
    ]
    (one / "extraction.json").write_text(json.dumps({"schema_version": "1.0", "bill": {"identifier": "H.R. 1", "classification": "regular", "fiscal_years": [2024]}, "provisions": provisions}, indent=1))
    (one / "bill_meta.json").write_text(json.dumps({"congress": 118, "bill_nature": "supplemental", "fiscal_years": [2024], "subcommittees": [], "provision_timing": [{"provision_index": 0, "timing": "advance", "available_fy": 2031, "source": {"type": "x"}}, {"provision_index": 2, "timing": "unknown", "available_fy": None, "source": {"type": "x"}}, {"provision_index": 99, "timing": "advance"}]}))
    (one / "verification.json").write_text("{broken")
    (one / "BILLS-118hr1enr.txt").write_text("For x, $1 and $1.50; SEC. 9. x\nSEC. 10. y")
    (one / "BILLS-118hr1ih.xml").write_text("<bill/>")
    (at / "sidecar-only").mkdir()
    (at / "sidecar-only" / "bill_meta.json").write_text("{}")
    return str(at)


def test_load_and_totals(spark, root):
    loaded = source.bills(spark, root).cache()
    assert [r.bill_dir for r in loaded.collect()] == ["118-hr1"]
    view = model.provisions(loaded).cache()
    row = summary.summarized(view, loaded, model.timings(loaded)).first()
    assert (row.provisions, row.budget_authority, row.rescissions, row.net_ba, row.classification, row.congress, row.completeness_pct) == (6, 107, 30, 77, "supplemental", 118, None)
    assert (row.current_year_ba, row.advance_ba) == (7, 100)  # an index out of range is dropped
    limits = {r.provision_index: r for r in view.collect()}
    assert limits[4].agency == "" and limits[5].dollars is None and json.loads(limits[2].availability) == {"two_year": {"through": 2025}}
    dept = {r.department: (r.budget_authority, r.rescissions, r.provision_count) for r in summary.by_department(view).collect()}
    assert dept == {"Department of VA": (147, 30, 4)}  # any detail level counts here
    timing = {r.provision_index: (r.timing, r.available_fy) for r in classify.timings(view).collect()}
    assert timing == {0: ("advance", 2031), 1: ("current_year", None), 2: ("current_year", None)}
    assert [r.stem for r in source.sources(spark, root).collect()] == ["BILLS-118hr1enr"]
    assert [(r.file, "SEC. 10" in r.source) for r in source.source_text(spark, root).collect()] == [("BILLS-118hr1enr.txt", True)]
    found = search.search(view, search.Criteria(provision_type="appropriation", account="pens", max_dollars=50), spark.createDataFrame([("118-hr1", 1, "found", "exact")], "bill_dir string, provision_index long, amount_status string, match_tier string"))
    assert [(r.provision_index, r.quality) for r in found.collect()] == [(1, "strong")]
    assert "Account: Cap" in {r.provision_index: r.embedding_text for r in model.embedding_text(view).collect()}[4]


def small(spark, rows):
    cols = "bill_dir string, identifier string, fiscal_years array<int>, provision_index long, provision_type string, account_name string, agency string, dollars long, semantics string, amount_kind string, detail_level string, classification string"
    return spark.createDataFrame([(d, d, [fy], i, t, a, g, v, s, "specific", lvl, "regular") for d, fy, i, t, a, g, v, s, lvl in rows], cols)


NBA, NONE = "new_budget_authority", ("ord int, canonical string, member string", "ord int, canonical string, alias string")


def test_compare(spark):
    base = small(spark, [("b", 2024, 0, "appropriation", "X—One", "A", 10, NBA, ""), ("b", 2024, 1, "appropriation", "Gone", "A", 5, NBA, ""), ("b", 2024, 2, "appropriation", "Zero", "A", 0, NBA, ""), ("b", 2024, 3, "appropriation", "Cap", "", 6, NBA, "")])
    current = small(spark, [("c", 2025, 0, "appropriation", "one", "a", 15, NBA, "sub_allocation"), ("c", 2025, 1, "appropriation", "New", "B", 3, NBA, ""), ("c", 2025, 2, "limitation", "cap", "", 8, "limitation", "")])
    groups, aliases = spark.createDataFrame([], NONE[0]), spark.createDataFrame([], NONE[1])
    rows = {r.k_account: r for r in compare.compare(base, current, groups, aliases).collect()}
    assert {k: (r.status, r.base_dollars, r.current_dollars) for k, r in rows.items()} == {"one": ("changed", 10, 15), "gone": ("only in base", 5, 0), "new": ("only in current", 0, 3), "cap": ("reclassified", 6, 8)}
    assert rows["one"].account_name == "X—One" and rows["one"].delta_pct == 50 and rows["new"].delta_pct is None
    ruled = compare.compare(base, current, spark.createDataFrame([(0, "B", "a")], NONE[0]), spark.createDataFrame([(0, "Q—New", "gone")], NONE[1]), rescue=False)
    merged = {r.k_account: r for r in ruled.collect()}["new"]
    assert merged.status == "changed" and merged.normalized and merged.k_agency == "b"
    done = compare.rescued_by_code(compare.compare(base, current, groups, aliases, rescue=False), spark.createDataFrame([("1", 5), ("2", 5)], "fas_code string, dollars long"), spark.createDataFrame([("1", 70), ("2", 80)], "fas_code string, dollars long"))
    assert {r.k_account: (r.status, r.current_dollars) for r in done.collect()}["gone"] == ("matched (TAS)", 70)
    linked = compare.relabelled_by_links(compare.compare(base, current, groups, aliases), spark.createDataFrame([("A new thing", "")], "source_label string, target_label string"))
    assert {r.k_account: r.status for r in linked.collect()}["new"] == "linked"
    assert compare.described(base.select("identifier", "bill_dir", F.lit(118).alias("congress")).distinct()) == "b (118th)"


@pytest.mark.parametrize(("title", "want"), [("National Security, Department of State, and Related Programs", "state_foreign_ops"), ("Health Extenders", "extenders"), ("Health", "labor_hhs"), ("FEND Off Fentanyl Act", "other"), ("Department of Defense", "defense")])
def test_jurisdiction(spark, title, want):
    assert spark.range(1).select(classify.jurisdiction(F.lit(title)).alias("x")).first().x == want


def test_bill_nature(spark):
    rows = [("m", 2024, i, "appropriation", "a", "g", 1, NBA, "") for i in range(60)] + [("m", 2024, 60, "continuing_resolution_baseline", "", "", None, "", "")]
    got = classify.bill_nature(small(spark, rows), spark.createDataFrame([], "bill_dir string, division string, jurisdiction string"))
    assert got.first().bill_nature == "full_year_cr_with_appropriations"


REFERENCE = [("070-0400", "070", "Operations and Support, United States Secret Service"), ("070-0530", "070", "Operations and Support, Customs"), ("021-2020", "021", "Operation and Maintenance, Army"), ("017-1804", "017", "Operation and Maintenance, Navy"), ("015-0100", "015", "Salaries and Expenses, Justice"), ("020-0100", "020", "Salaries and Expenses, Treasury")]


def test_resolution(spark):
    ref = spark.createDataFrame([(a, b, c, "x", "active") for a, b, c in REFERENCE], "fas_code string, agency_code string, title string, agency_name string, status string")
    asked = [("Operation and Maintenance, Army", ""), ("Operation and Maintenance, Army", "Department of Defense"), ("Secret Service—Operations and Support", "Department of Homeland Security"), ("Salaries and Expenses", "Department of Justice"), ("Salaries and Expenses", "")]
    rows = spark.createDataFrame([(i, a, g) for i, (a, g) in enumerate(asked)], "provision_index long, account_name string, agency string")
    got = {r.provision_index: (r.fas_code, r.method) for r in accounts.resolve(rows, ref).collect()}
    assert got == {0: (None, "none"), 1: ("021-2020", "agency_disambiguated"), 2: (None, "none"), 3: ("015-0100", "agency_disambiguated"), 4: (None, "none")}


@pytest.mark.parametrize(("agency", "account", "want"), [("Department of Defense", "X, Army", "021"), ("Department of Defense", "X, Navy", "017"), ("Department of Defense", "X, Air Force", "057"), ("DoD", "Marine Corps", "017"), ("Department of Defense", "X, Defense-Wide", "097"), ("Department of Justice", "X, Army", "015"), ("", "X", None)])
def test_agency_code(spark, agency, account, want):
    assert spark.range(1).select(accounts.agency_code(F.lit(agency), F.lit(account)).alias("x")).first().x == want


def mapped(spark, rows):
    return spark.createDataFrame(rows, "fas_code string, account_name string, bill_dir string, identifier string, fiscal_years array<int>, dollars long")


def test_authority(spark):
    rows = mapped(spark, [("c1", "Allowances and Expenses", "a", "A", [2021], 5), ("c1", "Members' Representational Allowances", "b", "B", [2025], 7), ("c2", "X—Ops", "a", "A", [2021, 2022], 3), ("c2", "Ops", "b", "B", [2021], 2), ("c3", "Pay", "a", "A", [2020], 1), ("c3", "PAY", "b", "B", [2020], 1)])
    classed = accounts.classified(accounts.variants(rows))
    got = {(r.fas_code, r.name): r.classification for r in classed.collect()}
    assert got[("c1", "Allowances and Expenses")] == "name_change" and got[("c1", "Members' Representational Allowances")] == "canonical"
    assert got[("c2", "Ops")] == "prefix_variant" and got[("c3", "PAY")] == "case_variant" and got[("c3", "Pay")] == "canonical"
    event = accounts.rename_events(classed).first()
    assert (event.fas_code, event.fiscal_year, event["from"]) == ("c1", 2025, "Allowances and Expenses")
    years = {(r.fas_code, r.fy): r.total_dollars for r in accounts.timeline(rows).collect()}
    assert years[("c2", 2021)] == 5 and years[("c2", 2022)] == 3
    named = spark.createDataFrame([("070-0400", "Operations and Support", "Department of Homeland Security", ["Secret Service—Operations", "USSS"])], "fas_code string, fas_title string, agency_name string, names array<string>")
    for query, n in (("secret service", 1), ("USSS", 1), ("homeland", 1), ("070-0400", 1), ("NASA", 0), ("a", 0)):
        assert accounts.search_authorities(named, query).count() == n, query


def test_entities(spark):
    view = small(spark, [("b", 2024, 0, "appropriation", "Pay", "Office of Rights", 1, NBA, ""), ("c", 2025, 1, "appropriation", "pay", "Office for Rights", 1, NBA, "")])
    row = entities.suggest(view).first()
    assert (row.canonical, row.member, row.evidence, row.orphan_pairs_resolved) == ("Office for Rights", "Office of Rights", "regex_pattern", 2)
    assert entities.merged([("A", ["b"])], [("B", ["c"]), ("X", ["y"])]) == [("A", ["b", "c"]), ("X", ["y"])]


def test_links(spark):
    rows = [("a", 0, [1.0, 0.0]), ("b", 0, [0.8, 0.6]), ("b", 1, [0.0, 1.0]), ("c", 0, [0.6, 0.8])]
    vectors = spark.createDataFrame(rows, "bill_dir string, provision_index long, vec array<float>")
    pairs = {(r.a_dir, r.a_index, r.b_dir, r.b_index) for r in links.similar_pairs(vectors, 0.59, block=2).collect()}
    assert {frozenset([p[:2], p[2:]]) for p in pairs} == {frozenset(x) for x in ([("a", 0), ("b", 0)], [("a", 0), ("c", 0)], [("b", 0), ("c", 0)], [("b", 1), ("c", 0)])}
    about = spark.createDataFrame([("a", 0, 0, "n", "g", [2024]), ("b", 0, 1, "n", "g", [2025]), ("b", 1, 1, "m", "h", [2025]), ("c", 0, 2, "z", "g", [2024])], "bill_dir string, provision_index long, ord int, canonical_name string, norm_agency string, fiscal_years array<int>")
    got = {(r.source_dir, r.source_index, r.target_dir, r.target_index): r.confidence for r in links.suggest(links.similar_pairs(vectors, 0.59), about, "m").collect()}
    assert got == {("a", 0, "b", 0): "verified", ("a", 0, "c", 0): "uncertain", ("b", 0, "c", 0): "high", ("b", 1, "c", 0): "uncertain"}
    assert links.suggest(links.similar_pairs(vectors, 0.59), about, "m", scope="intra").count() == 1
    with pytest.raises(ValueError, match="no provision"):
        links.related(vectors, about, "zz", 0)


def test_text():
    t = b"$51,181,397,000 and also $500,000. $1.50 $, SEC.\nSEC. 101. x\nSec. 102. y\nSEC. 103 z"
    assert [(a, v) for _, a, v in text.amounts(t)] == [("$51,181,397,000", 51181397000), ("$500,000", 500000), ("$1.50", 150)]
    got = text.sections(t)
    assert [s[0] for s in got] == ["SEC. 101", "SEC. 103"] and got[0][2] == got[1][1] and got[1][2] == len(t)
    long = b"DIVISION A x\n" + b"y" * 2600 + "\nDIVISION B—Two\né".encode() * 1
    assert [(d[0], d[3]) for d in text.divisions(long)] == [("B", len(long))]
    body = ("pé" * 100 + "\n\n" + "q" * 100).encode()
    spans = text.paragraphs(body, 20)
    assert b"".join(body[a:b] for a, b in spans) == body and all(body[a:b].decode() is not None for a, b in spans)


def test_verify_and_repair(spark):
    src = "Alpha one. For “care” of veterans — é — there is $5 and $5 and $7 and more words follow here to make a long text."
    sources = spark.createDataFrame([("k", src)], "bill_dir string, source string")
    raw = ["For “care” of", 'For "care" of veterans - é - there', "For“care”ofveterans", "nowhere in the text at all", "", "veterans — é — there is $5 yet other words"]
    claims = spark.createDataFrame([("k", i, r, w) for i, (r, w) in enumerate(zip(raw, ["$5", "$7", "$9", "", None, "one"], strict=True))], "bill_dir string, provision_index long, raw_text string, text_as_written string")
    refs = text.amount_refs(sources, "bill_dir", "source").cache()
    checks = verify.amounts(claims, sources, refs).cache()
    assert {r.provision_index: r.status for r in checks.collect()} == {0: "ambiguous", 1: "verified", 2: "not_found", 3: "verified", 5: "verified"}
    covered = verify.accounted(checks, sources, refs)
    done = verify.completeness(refs, covered, sources).first()
    assert (done.total_amounts, done.accounted_for) == (3, 3)
    tiers = {r.provision_index: r.match_tier for r in verify.texts(claims, sources).collect()}
    assert tiers == {0: "exact", 1: "normalized", 2: "spaceless", 3: "no_match", 5: "no_match"}
    fixed = repair.repaired(claims, sources).cache()
    got = {r.provision_index: r.match_tier for r in fixed.collect()}
    assert got[0] == "exact" and got[1] in ("repaired_normalized", "repaired_substring") and got[3] == "unverified" and got[4] == "exact" and got[5] == "repaired_prefix"
    assert all(r.holds for r in repair.span_holds(fixed, sources).collect())
    assert {r.bill_dir: r.total for r in repair.report(fixed).collect()} == {"k": 6, "TOTAL": 6}


def _held(raw, source, offset, most):
    """By trying every length: the longest held piece, cut to whole characters."""
    size = max((n for n in range(15, min(most, len(raw) - offset) + 1) if raw[offset : offset + n] in source), default=0)
    while size > 15 and offset + size < len(raw) and raw[offset + size] & 0xC0 == 0x80:
        size -= 1
    whole = size and not (offset + size < len(raw) and raw[offset + size] & 0xC0 == 0x80)
    return (size, source.find(raw[offset : offset + size])) if whole else (0, -1)


def test_repair_index():
    """Every piece and place is the one that trying all lengths finds, with repeats and characters of several bytes."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "é", "the sum of ", "—", "$5", "\n", "x" * 20]) for _ in range(rng.randint(0, 60)))
        raw = "".join(rng.choice([text[i : i + rng.randint(1, 40)], "é", "qq "]) for i in (rng.randint(0, len(text)) for _ in range(4)))
        source, raw = repair.Source(text.encode()), raw.encode()
        assert source.first(raw) == text.encode().find(raw)
        for offset, places in enumerate(source.places(repair._grams(np.frombuffer(raw, dtype=np.uint8)))):
            assert source.longest(raw, offset, places, 60) == _held(raw, text.encode(), offset, 60)
        tier, start, end = repair.locate(raw, source)
        assert tier == "unverified" or text.encode()[start:end].decode() is not None
    many = repair.Source(b"spaces and more " * 200 + b"spaces and less")  # more places than are tried one by one
    assert many.first(b"spaces and less") == 3200 and many.first(b"spaces and none") == -1
    assert repair.Source(b"").first(b"abc") == -1 and repair.locate(b"abc" * 9, repair.Source(b""))[0] == "unverified"


def test_repair_parts(spark):
    """Claims of one bill dealt into parts give what one part gives; bills without a source or a key have rows too."""
    source = " ".join(f"For item {i} the sum of ${i}." for i in range(200))
    rows = [("k", i, f"For item {i} the sum of ${i}." if i % 2 else f"zzzz For item {i} the sum") for i in range(120)] + [("gone", 0, "For item 1"), (None, 1, None), ("k", 7, None)]
    claims = spark.createDataFrame(rows, "bill_dir string, provision_index long, raw_text string")
    docs = spark.createDataFrame([("k", source), ("unclaimed", "x")], "bill_dir string, source string")
    one, dealt = (sorted(map(tuple, repair.repaired(claims, docs, claims_per_task=n).collect()), key=repr) for n in (10**6, 7))
    assert one == dealt and len(one) == len(rows)
    assert ("gone", 0, "unverified", None, None, "For item 1") in one and (None, 1, "exact", None, None, "") in one
    assert repair.repaired(claims.limit(0), docs).collect() == []


def test_cpi(spark):
    rows = [(f"{y}-{m:02}", 300.0 + m) for y, m in [(2023, 10), (2023, 11), (2023, 12), (2024, 1), (2025, 10), (2025, 12)]]
    got = {r.fy: (r.cpi, r.months) for r in inflation.fiscal_year_cpi(spark.createDataFrame(rows, "ym string, value double"), spark.createDataFrame([(2026, 9.0, 4)], "fy int, value double, months int")).collect()}
    assert got == {2024: (308.5, 4), 2026: (9.0, 4)}


def _answer(*provisions, **more):
    return json.dumps({"bill": {"identifier": "H.R. 1", "classification": "regular", "fiscal_years": [2024], "divisions": ["A"]}, "provisions": list(provisions), "summary": {"total_provisions": 0}} | more)


def test_lenient(spark):
    given = {
        "fence": 'Sure:\n```json\n' + _answer({"provision_type": "novel", "amount": {"dollars": "$1,234", "semantics": "x"}, "own": [1]}, 5, {"provision_type": "appropriation", "section": "SEC. 1", "availability": {"a": 1}}) + "\n```",
        "cr": _answer({"provision_type": "cr_substitution", "new_amount": {"dollars": 5, "semantics": "new_budget_authority", "text_as_written": "$5"}, "old_amount": {"dollars": 7}, "confidence": "0.5"}),
        "none": "nothing", "list": "[]", "bill": json.dumps({"summary": {}, "provisions": []}), "late": _answer(summary=3), "empty": _answer(),
    }
    rows = lenient.provisions(spark.createDataFrame(list(given.items()), "k string, t string"), "k", "t").cache()
    got = {(r.k, r.ord): r for r in rows.collect()}
    first, lost, third = (got["fence", i] for i in range(3))
    assert (first.provision_type, first.llm_classification, first.amounts[0].dollars, first.metadata, first.type_coercions) == ("other", "novel", 1234, {"own": "[1]"}, 1)
    assert lost.failed and lost.warning == "Provision 1: provision not an object" and lost.provision_type is None
    assert (third.availability.kind, json.loads(third.availability.text), third.amount.dollars, third.amount.semantics, third.warning) == ("other", {"a": 1}, 0, "indefinite", "SEC SEC. 1: missing amount on appropriation")
    swap = got["cr", 0]
    assert (swap.new_amount.dollars, swap.new_amount.text_as_written, swap.old_amount.dollars, swap.amount, swap.confidence, swap.null_to_default) == (5, "$5", 7, None, 0.5, 2)
    assert {k: got[k, None].error for k in ("none", "list", "bill", "late")} == {"none": "Answer is not JSON", "list": "Expected root object", "bill": "Missing 'bill'", "late": "summary not an object"}
    report = {r.k: r for r in lenient.report(rows, "k").collect()}
    assert "empty" not in report  # nothing to report
    r = report["fence"]
    assert (r.provisions_parsed, r.provisions_failed, r.unknown_provision_types, r.type_coercions, len(r.warnings)) == (2, 1, 1, 1, 2)
    assert report["none"].error and report["none"].provisions_parsed == 0


BILL = '<!DOCTYPE bill [<!ENTITY x "y">]><bill><form><legis-num>H.R. 1</legis-num></form><legis-body><section><enum>1.</enum><header>Short</header><text>Before <short-title>An Act</short-title>.</text></section><division><enum>A</enum><header>First</header><title><enum>I</enum><header>Gen</header><section><enum>1.</enum><text>A <quote>b</quote> c.</text></section><section><enum>2.</enum><text>More of it.</text></section></title><title><enum>II</enum><appropriations-small><header>Pay</header><text>For pay, $5.</text></appropriations-small></title><section><enum>9</enum><text>end</text></section></division><division><enum>B</enum><header>Sec</header><text>x</text></division><section><enum>3.</enum><text>After.</text></section></legis-body></bill>'


def test_xml_parts():
    rows = {m: [r[1:6] for r in xml.parts(BILL, m)] for m in (3, 8, 3000)}
    assert rows[3000] == [
        ("preamble", None, "", "", "SEC. 1.\nShort\nBefore An Act.\n"),
        ("division", "A", "A", "", "A\nFirst\nI\nGen\nSEC. 1. A ''b'' c.\nSEC. 2. More of it.\nII\nPay\nFor pay, $5.\nSEC. 9 end\n"),
        ("division", "B", "B", "", "B\nSec\nx\n"),
        ("rest", None, "", "", "SEC. 3. After.\n"),
        ("bill", None, "", "", "H.R. 1\nAn Act\n\n"),
    ]
    assert [r[1] for r in rows[8] if r[1]] == ["A-I", "A-II", "A", "B"] and [r[1] for r in rows[3] if r[1]] == ["A-Ia", "A-Ib", "A-II", "A", "B"]
    assert len({"".join(r[4] for r in rows[m]) for m in rows}) == 1  # cut as one likes, the text is the same
    assert [r[6] for r in xml.parts(BILL) if r[1] in ("division", "bill")] == [1, 0, 1]


def test_xml_without_divisions():
    full, bill = xml.parts("<bill><toc-entry level='division'>Division A — Things</toc-entry><legis-body><section><enum>1</enum><text>For \n  x, $100,000.</text></section></legis-body></bill>")
    assert full[1:6] == ("full", "full", "", "", "SEC. 1 For\nx, $100,000.") and bill[9] == [("A", "Things")]
    for broken in ("<bill/>", "<bill><legis-body>", "no markup"):
        with pytest.raises((ValueError, SyntaxError)):
            list(xml.parts(broken))


def test_xml_bills(spark, tmp_path):
    for name, text in (("a", BILL), ("b", "<bill>"), ("c", "<bill><legis-num>S. 2</legis-num><legis-body><text>All of it.</text></legis-body></bill>")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "BILLS-118hr1enr.xml").write_text(text)
    got = {r.bill_dir: r for r in xml.bills(spark, str(tmp_path), 3).collect()}
    assert got["b"].error and got["b"].full_text is None and got["a"].error is None
    text = got["a"].full_text.encode()
    assert [text[c.start : c.end].decode().split("\n")[0] for c in got["a"].chunks] == ["I", "SEC. 2. More of it.", "II", "SEC. 9 end", "B"]
    assert (got["a"].accounts, got["a"].preamble, got["c"].full_text) == (1, "SEC. 1.\nShort\nBefore An Act.", "S. 2\n\nAll of it.")
    assert [(c.start, c.end) for c in got["c"].chunks] == [(0, 16)]


def test_token_rate(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.0), (1, "2024-01-01 00:00:04", 100.0), (1, "2024-01-01 00:00:20", 130.0)], "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [r.rate for r in reports.token_rate(rows).orderBy("ts").collect()] == [None, 25, None]


def test_small_helpers(spark, tmp_path):
    from ledgerlark.functions.text import congress_of, xml_context
    from ledgerlark.sources import fastbook, sinks

    assert spark.range(1).select(congress_of(F.lit("BILLS-118hr1enr.xml")).alias("x")).first().x == 118
    got = spark.range(1).select(xml_context(F.lit("<a><header>Top</header><text>For  pay, $5.</text></a>"), F.lit("pay")).alias("x")).first().x
    assert got == "## Top\nFor pay, $5."
    rows = spark.createDataFrame([("H.R. 1", 3, None, 0.5, 'a "b", c')], "identifier string, provision_index long, amount_status string, confidence double, raw_text string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.bill, back.amount_status, back.confidence, back.raw_text) == ("H.R. 1", "n/a", "0.50", 'a "b", c') and len(back) == len(sinks.CSV_COLUMNS)
    sinks.json_array(rows, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text())[0]["amount_status"] is None
    assert sinks.shown(rows.select("identifier")).split() == ["IDENTIFIER", "H.R.", "1"]
    active = spark.createDataFrame([("070-X-0400-000", "Ops", "2024", "General", 0), ("070-2024/2025-0400-000", "Operations", "2025", "General", 1)], "tas string, title string, last_updated string, fund string, ord int")
    changes = spark.createDataFrame([("70-X-0400-000", "Ops", "gone"), ("15-X-0100-000", "Old", "gone"), ("15-X-0100-000", "Old", "gone")], "tas string, title string, action string")
    ref = {r.fas_code: r for r in fastbook.reference(active, changes).collect()}
    assert (ref["070-0400"].title, ref["070-0400"].tas_variants, ref["070-0400"].has_no_year_variant) == ("Operations", 2, True) and ref["015-0100"].status == "discontinued"


def test_services(spark, tmp_path):
    from ledgerlark.operators import services

    class Twice:
        calls = 0

        def extract(self, chunk):
            if chunk == "bad":
                raise RuntimeError("no")
            return chunk.upper()

    chunks = spark.createDataFrame([("b", 0, "x"), ("b", 1, "bad")], "bill_dir string, ord long, text string")
    got = {r.ord: (r.answer, r.error) for r in services.extracted(chunks, Twice(), tries=1).collect()}
    assert got == {0: ("X", None), 1: (None, "no")}
    data = tmp_path / "d"
    data.mkdir()
    (data / "extraction.json").write_text("{}")
    cache = services.SuggestionCache(str(tmp_path / "c"))
    cache.write("link", str(data), [{"hash": "a"}, {"hash": "b"}])
    assert cache.find("link", str(data), ["b"]) == [{"hash": "b"}]
    (data / "more").mkdir()
    (data / "more" / "extraction.json").write_text("{}")
    assert cache.read("link", str(data)) is None and cache.clear() == 1


def test_streaming(spark, tmp_path):
    from ledgerlark.streaming.token_rate import windowed_rate

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.0), (1, "2024-01-01 00:00:04", 100.0)], "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_rate(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(rate) from rates").first()[0] == 25


@pytest.mark.parametrize("sent_bytes", [1_000_000, 0])
def test_containment(spark, sent_bytes):
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(80)] + ["", None, "aaaaaaaaaaaa", "aaaaaaaaaaaa"]
    labels = words[:30] + [" ".join(r.choice(words) for _ in range(2)) for _ in range(30)] + ["", None, "a", "aa", "aaa", "a" * 30]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    got = containment.holding(frame(names), frame(labels), sent_bytes).collect()
    full = [x for x in dict.fromkeys(names) if x], [x for x in dict.fromkeys(labels) if x]
    assert sorted(map(tuple, got)) == sorted((n, p) for n in full[0] for p in full[1] if p in n)
    both = containment.either(frame(names), frame(labels), sent_bytes).collect()
    assert sorted(map(tuple, both)) == sorted((n, p) for n in full[0] for p in full[1] if p in n or n in p)


def test_nearest(spark):
    import random

    r = random.Random(8)
    refs = [(k, r.randint(0, 60)) for k in "ab" for _ in range(12)] + [("d", 5)]
    places = [(k, at) for k in "abc" for at in range(0, 70, 3)] + [("a", 6)]
    got = verify.nearest(spark.createDataFrame(places, "bill_dir string, at long"), spark.createDataFrame(refs, "bill_dir string, position long")).collect()
    want = {(k, at): min((abs(p - at), p) for x, p in refs if x == k)[1] for k, at in places if k in "ab"}
    assert {(g.bill_dir, g.at): g.position for g in got} == want and len(got) == len(want)


def test_subcommittee_without_metadata(spark):
    bills = spark.createDataFrame([("a", "H.R. 1", "x"), ("b", "H.R. 2", None)], "bill_dir string, identifier string, meta string")
    view = spark.createDataFrame([("a", "B"), ("b", "B")], "bill_dir string, division string")
    parts = spark.createDataFrame([("a", "b", "defense")], "bill_dir string, division string, jurisdiction string")
    with pytest.raises(ValueError, match="H.R. 2: --subcommittee requires bill metadata"):
        search.of_subcommittee(view, bills, parts, "defense")
    assert [r.bill_dir for r in search.of_subcommittee(view, bills.where("meta is not null"), parts, "defense").collect()] == ["a"]


@pytest.mark.parametrize("block_bytes", [32_000_000, 300])
def test_similar_many(spark, block_bytes):
    import random

    r = random.Random(2)
    rows = [("b%d" % (k % 3), k, [float(r.randint(-2, 2)) for _ in range(4)]) for k in range(90)] + [("b0", 500, None), ("b0", 501, [1.0])]
    df = spark.createDataFrame(rows, "bill_dir string, provision_index long, vec array<double>")
    asked = df.where("provision_index % 7 = 0 or provision_index = 500").withColumnsRenamed({"bill_dir": "source_dir", "provision_index": "source_index"})
    got = [tuple(x) for x in search.similar_many(df, asked, 5, block_bytes).collect()]
    want = []
    for d, k, v in rows[:90]:
        if k % 7 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), e, j) for e, j, w in rows[:90] if (e, j) != (d, k))[:5]
            want += [(d, k, n, e, j, -s) for n, (s, e, j) in enumerate(near, 1)]
    assert sorted(got) == sorted(want)
    assert search.similar_many(df, asked.limit(0), 5).count() == 0
