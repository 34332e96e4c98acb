"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from . import bridge


def _on_bridge(sql: str, more: str = "") -> str:
    return f"WITH {bridge.SQL}{more} {sql}"


_CHECKED = """, checked AS (
  SELECT *, CASE amount_status WHEN 'verified' THEN 'found' WHEN 'ambiguous' THEN 'found_multiple' ELSE amount_status END AS st,
    CASE WHEN amount_status = 'verified' AND tier = 'exact' THEN 'strong' WHEN amount_status = 'verified' AND tier IS NOT NULL THEN 'moderate'
         WHEN amount_status = 'ambiguous' AND tier IN ('exact', 'normalized') THEN 'moderate' WHEN amount_status = 'ambiguous' AND tier IS NOT NULL THEN 'weak'
         WHEN amount_status = 'not_found' THEN 'weak' ELSE 'n/a' END AS quality FROM provisions)"""


def _compare(ruled: bool = False) -> str:
    """CTEs ``cmp`` (without rescue) and ``resc`` (with it)."""
    agency = "CASE WHEN a0 IN ('nation_1', 'nation_2') THEN 'nation_1' WHEN a0 IN ('nation_3', 'nation_4') THEN CASE WHEN a0 = 'nation_4' THEN 'nation_3' ELSE a0 END ELSE a0 END" if ruled else "a0"
    flag = "a0 IN ('nation_1', 'nation_2', 'nation_4')" if ruled else "false"
    account = "CASE WHEN c0 IN ('blue bolt', 'hot gear') THEN 'red widget' ELSE c0 END" if ruled else "c0"
    return f""", keyed0 AS (
  SELECT *, trim(lower(CASE WHEN agency = '' THEN '(unknown)' ELSE agency END)) AS a0, trim(regexp_extract(lower(account_name), '[^—–]*$')) AS c0 FROM provisions WHERE fy IN (1997, 1998)
), keyed AS (SELECT *, {agency} AS k_agency, {account} AS k_account, {flag} AS ruled FROM keyed0),
tot AS (
  SELECT fy, k_agency, k_account, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS d, arg_min(ruled, (identifier, bill_dir, provision_index)) AS ruled
  FROM keyed WHERE provision_type = 'appropriation' AND semantics = 'new_budget_authority' GROUP BY ALL
), wide AS (SELECT fy, k_agency, k_account, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS d FROM keyed WHERE provision_type IN ('appropriation', 'limitation') GROUP BY ALL),
cmp AS (
  SELECT *, current_dollars - base_dollars AS delta, CASE WHEN base_dollars = 0 THEN 'only in current' WHEN current_dollars = 0 THEN 'only in base' WHEN base_dollars = current_dollars THEN 'unchanged' ELSE 'changed' END AS status,
         CASE WHEN base_dollars <> 0 THEN (current_dollars - base_dollars) / base_dollars * 100 END AS pct
  FROM (SELECT coalesce(b.k_agency, c.k_agency) AS k_agency, coalesce(b.k_account, c.k_account) AS k_account, coalesce(b.d, 0) AS base_dollars, coalesce(c.d, 0) AS current_dollars, coalesce(b.ruled, false) OR coalesce(c.ruled, false) AS normalized
        FROM (SELECT * FROM tot WHERE fy = 1997) b FULL JOIN (SELECT * FROM tot WHERE fy = 1998) c ON b.k_agency = c.k_agency AND b.k_account = c.k_account)
  WHERE base_dollars <> 0 OR current_dollars <> 0
), resc AS (
  SELECT k_agency, k_account, base_dollars, current_dollars, status, current_dollars - base_dollars AS delta, CASE WHEN base_dollars <> 0 THEN (current_dollars - base_dollars) / base_dollars * 100 END AS pct FROM (
    SELECT cmp.k_agency, cmp.k_account, CASE WHEN status = 'only in current' AND b.d IS NOT NULL THEN b.d ELSE base_dollars END AS base_dollars,
           CASE WHEN status = 'only in base' AND c.d IS NOT NULL THEN c.d ELSE current_dollars END AS current_dollars,
           CASE WHEN (status = 'only in base' AND c.d IS NOT NULL) OR (status = 'only in current' AND b.d IS NOT NULL) THEN 'reclassified' ELSE status END AS status
    FROM cmp LEFT JOIN wide b ON b.fy = 1997 AND b.k_agency = cmp.k_agency AND b.k_account = cmp.k_account LEFT JOIN wide c ON c.fy = 1998 AND c.k_agency = cmp.k_agency AND c.k_account = cmp.k_account)
)"""


_FLAG = "CASE WHEN pct IS NULL OR (abs(pct) < 0.001 AND false) THEN 'unchanged' WHEN ((1 + pct / 100) / 1.03 - 1) * 100 > 0.05 THEN 'real_increase' WHEN ((1 + pct / 100) / 1.03 - 1) * 100 < -0.05 THEN CASE WHEN pct < -0.05 THEN 'real_cut' ELSE 'inflation_erosion' END ELSE 'unchanged' END"
_YEARS = ", years AS (SELECT fas_code, fy, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS total_dollars, count(DISTINCT identifier) AS bills, count(DISTINCT account_name) AS names FROM mapped WHERE fas_code IS NOT NULL GROUP BY ALL)"
_VEC = """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, 'n' || (vec_id % 50) AS name, 'a' || (vec_id % 3) AS agency, label % 4 AS fy,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id * 100 END AS dollars, CASE vec_id % 5 WHEN 0 THEN 'advance' WHEN 1 THEN 'supplemental' ELSE 'current_year' END AS timing FROM embeddings),
me AS (SELECT * FROM e WHERE vec_id = 7)"""
_RELATED = """, sc AS (SELECT e.*, list_dot_product(e.v, me.v) AS s, e.name = me.name AS sn, e.agency = me.agency AS sa FROM e, me WHERE e.label <> me.label),
tiers AS (SELECT *, CASE WHEN sn THEN 'verified' WHEN s >= 0.2 AND sa THEN 'high' WHEN s >= 0.15 THEN 'uncertain' END AS confidence FROM sc WHERE s >= 0.1),
ranked AS (SELECT *, CASE WHEN confidence = 'uncertain' THEN 'related' ELSE 'same_account' END AS tier, row_number() OVER (PARTITION BY confidence = 'uncertain' ORDER BY s DESC, CAST(label AS VARCHAR), vec_id) AS rank FROM tiers WHERE confidence IS NOT NULL)"""
_LINKS = """, cand AS (
  SELECT CAST(a.label AS VARCHAR) AS source_dir, a.vec_id AS source_index, CAST(b.label AS VARCHAR) AS target_dir, b.vec_id AS target_index, list_dot_product(a.v, b.v) AS s, a.name = b.name AS sn, a.agency = b.agency AS sa
  FROM e a JOIN e b ON a.label < b.label WHERE list_dot_product(a.v, b.v) >= 0.30
), link AS (
  SELECT *, CASE WHEN sn THEN 'verified' WHEN s >= 0.40 AND sa THEN 'high' WHEN s >= 0.35 THEN 'uncertain' END AS confidence,
         substr(sha256(source_dir || ':' || source_index || '→' || target_dir || ':' || target_index || ':m'), 1, 8) AS hash FROM cand)"""
_CLAIMS = r"""WITH docs AS (SELECT doc_id AS bill_dir, text AS source FROM documents),
dealt AS (SELECT bill_dir, 0 AS provision_index, trim(substr(source, 11, 70), ' ') AS t FROM docs
  UNION ALL SELECT bill_dir, 1, text FROM docs JOIN benchmark ON bill_dir % (SELECT count(*) FROM benchmark) = item_id),
claims AS (SELECT bill_dir, provision_index, CASE bill_dir % 4 WHEN 0 THEN t WHEN 1 THEN replace(t, ' ', chr(10)) WHEN 2 THEN replace(t, ' ', '') ELSE 'zz ' || t END AS raw_text, regexp_extract(t, '^[A-Za-z]+') AS taw FROM dealt),
norm AS (SELECT *, trim(regexp_replace(translate(raw_text, '‘’“”—–‒', '''''""---'), '[\s\x{00A0}]+', ' ', 'g'), ' ') AS n FROM claims),
srcn AS (SELECT *, trim(regexp_replace(translate(source, '‘’“”—–‒', '''''""---'), '[\s\x{00A0}]+', ' ', 'g'), ' ') AS ns FROM docs),
words AS (SELECT bill_dir, unnest(regexp_extract_all(' ' || replace(source, ' ', '  ') || ' ', '[ \n]([A-Z][a-z]+)[ \n]', 1)) AS amount FROM (SELECT bill_dir, replace(source, chr(10), chr(10) || chr(10)) AS source FROM docs)),
refs AS (SELECT bill_dir, amount, count(*) AS n FROM words GROUP BY ALL),
chk AS (SELECT c.bill_dir, c.provision_index, taw, coalesce(n, 0) AS m, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 OR contains(source, taw) THEN 'verified' ELSE 'not_found' END AS status
  FROM claims c JOIN docs d ON c.bill_dir = d.bill_dir LEFT JOIN refs r ON r.bill_dir = c.bill_dir AND r.amount = taw),
tokens AS (SELECT bill_dir, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT bill_dir, string_split_regex(source, '[ \n]') AS w FROM docs)),
places AS (SELECT bill_dir, token, position FROM (SELECT *, CAST(sum(strlen(token) + 1) OVER (PARTITION BY bill_dir ORDER BY i) - strlen(token) - 1 AS BIGINT) AS position FROM tokens) WHERE regexp_full_match(token, '[A-Z][a-z]+')),
plain AS (SELECT DISTINCT c.bill_dir, taw, strlen(substr(source, 1, greatest(instr(source, taw) - 1, 0))) AS spot FROM chk c JOIN docs d ON c.bill_dir = d.bill_dir WHERE m = 0 AND status = 'verified'),
hits AS (SELECT bill_dir, position FROM places WHERE (bill_dir, token) IN (SELECT bill_dir, taw FROM chk WHERE m > 0)
  UNION SELECT p.bill_dir, arg_min(q.position, (abs(q.position - spot), q.position)) FROM plain p JOIN places q ON p.bill_dir = q.bill_dir GROUP BY p.bill_dir, taw),
cov AS (SELECT bill_dir, count(DISTINCT position) AS total, count(DISTINCT CASE WHEN (bill_dir, position) IN (SELECT bill_dir, position FROM hits) THEN position END) AS acc FROM places GROUP BY 1)
"""

_RULES = [("department of defense", "defense"), ("energy and water", "energy_water"), ("science, and related agencies", "cjs"), ("homeland security", "homeland_security"), ("continuing appropriations", "continuing_resolution"), ("further continuing", "continuing_resolution"), ("other matters", "other")]
_TITLES = "['Energy and Water Development', 'Department of Defense', 'Health', 'Other Matters', 'Further Continuing Appropriations', 'Science, and Related Agencies', 'Homeland Security']"


def _case(column: str, pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{a}') THEN '{b}'" for a, b in pairs) + f" ELSE {other} END"


EMBEDDED = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END" for label, c in (("Account", "account_name"), ("Agency", "agency"), ("Description", "description"), ("Text", "raw_text"))) + ")"
SQL: dict[str, str] = {
    "summary_by_bill": _on_bridge("""SELECT bill_dir, identifier, count(*) AS provisions, ba AS budget_authority, resc AS rescissions, ba - resc AS net_ba FROM (
      SELECT *, CAST(sum(CASE WHEN provision_type = 'appropriation' AND semantics = 'new_budget_authority' AND detail_level NOT IN ('sub_allocation', 'proviso_amount') THEN coalesce(dollars, 0) ELSE 0 END) OVER (PARTITION BY bill_dir) AS BIGINT) AS ba,
             CAST(sum(CASE WHEN provision_type = 'rescission' THEN abs(dollars) ELSE 0 END) OVER (PARTITION BY bill_dir) AS BIGINT) AS resc FROM provisions) GROUP BY ALL"""),
    "advance_split": _on_bridge("SELECT bill_dir, identifier, CAST(sum(CASE WHEN timing <> 'advance' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS current_year_ba, CAST(sum(CASE WHEN timing = 'advance' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS advance_ba FROM ba GROUP BY ALL"),
    "advance_breakdown": _on_bridge("SELECT bill_dir, c AS current_year, a AS advance, s AS supplemental, t - c - a - s AS other, CASE WHEN t <> 0 THEN round(a / t * 100, 6) ELSE 0.0 END AS advance_pct FROM (SELECT bill_dir, CAST(coalesce(sum(coalesce(dollars, 0)) FILTER (timing = 'current_year'), 0) AS BIGINT) AS c, CAST(coalesce(sum(coalesce(dollars, 0)) FILTER (timing = 'advance'), 0) AS BIGINT) AS a, CAST(coalesce(sum(coalesce(dollars, 0)) FILTER (timing = 'supplemental'), 0) AS BIGINT) AS s, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS t FROM ba GROUP BY 1)"),
    "rollup_department": _on_bridge("""SELECT CASE WHEN contains(agency, ',') THEN CASE WHEN lower(trim(split_part(agency, ',', 1))) = 'office of inspector general' THEN trim(split_part(agency, ',', 2)) ELSE trim(split_part(agency, ',', 1)) END ELSE agency END AS department,
      CAST(sum(CASE WHEN semantics = 'new_budget_authority' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS budget_authority, CAST(sum(CASE WHEN provision_type = 'rescission' THEN abs(dollars) ELSE 0 END) AS BIGINT) AS rescissions, count(*) AS provision_count FROM provisions WHERE agency <> '' GROUP BY 1"""),
    "audit": _on_bridge("""SELECT bill_dir, identifier, count(*) AS total_provisions, count(*) FILTER (amount_status = 'verified') AS amounts_verified, count(*) FILTER (amount_status = 'not_found') AS amounts_not_found, count(*) FILTER (amount_status = 'ambiguous') AS amounts_ambiguous,
      count(*) FILTER (tier = 'exact') AS raw_text_exact, count(*) FILTER (tier = 'normalized') AS raw_text_normalized, count(*) FILTER (tier = 'spaceless') AS raw_text_spaceless, count(*) FILTER (tier = 'no_match') AS raw_text_no_match, round(count(*) FILTER (amount_status = 'verified') / count(*) * 100, 6) AS completeness_pct FROM provisions GROUP BY ALL"""),
    "verification_heatmap": _on_bridge("SELECT bill_dir, " + ", ".join(f"round(count(*) FILTER ({c} = '{v}') / count(*) * 100, 6) AS {p}_{v}_pct" for c, p, vs in (("amount_status", "amounts", ("verified", "ambiguous", "not_found")), ("tier", "raw_text", ("exact", "normalized", "spaceless", "no_match"))) for v in vs) + " FROM provisions GROUP BY 1"),
    "totals_rollup": _on_bridge("""SELECT coalesce(bill_dir, 'TOTAL') AS bill_dir, count(*) AS provisions, CAST(sum(x) AS BIGINT) AS budget_authority, CAST(sum(y) AS BIGINT) AS rescissions, CAST(sum(x - y) AS BIGINT) AS net_ba FROM (
      SELECT bill_dir, CASE WHEN provision_type = 'appropriation' AND semantics = 'new_budget_authority' AND detail_level NOT IN ('sub_allocation', 'proviso_amount') THEN coalesce(dollars, 0) ELSE 0 END AS x, CASE WHEN provision_type = 'rescission' THEN abs(dollars) ELSE 0 END AS y FROM provisions) GROUP BY ROLLUP (bill_dir)"""),
    "export_semantics": _on_bridge("SELECT semantics, count(*) AS provisions, CAST(sum(CASE WHEN semantics = 'new_budget_authority' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS budget_authority FROM provisions GROUP BY 1"),
    "search_filters": _on_bridge("SELECT bill_dir, provision_index, account_name, dollars, st AS amount_status, tier AS match_tier, quality FROM checked WHERE provision_type = 'appropriation' AND agency ILIKE '%inspector general%' AND account_name ILIKE '%red%' AND raw_text ILIKE '%for %' AND identifier ILIKE '%urgent%' AND division = 'B'", _CHECKED),
    "search_dollar_range": _on_bridge("SELECT bill_dir, provision_index, account_name, dollars, st AS amount_status, tier AS match_tier, quality FROM checked WHERE provision_type = 'rescission' AND abs(dollars) BETWEEN 9000000 AND 9500000 AND fy = 1998", _CHECKED),
    "search_quality": _on_bridge("SELECT quality, provision_type, count(*) AS provisions FROM checked GROUP BY ALL", _CHECKED),
    "search_subcommittee": _on_bridge("SELECT bill_dir, provision_index, division, dollars FROM provisions WHERE division = 'B' AND fy = 1998 AND abs(dollars) >= 9900000"),
    "compare_accounts": _on_bridge("SELECT k_agency, k_account, base_dollars, current_dollars, delta, status, round(pct, 6) AS delta_pct FROM cmp", _compare()),
    "compare_rescue": _on_bridge("SELECT k_agency, k_account, base_dollars, current_dollars, delta, status, round(pct, 6) AS delta_pct FROM resc", _compare()),
    "compare_groups": _on_bridge("SELECT k_agency, k_account, base_dollars, current_dollars, delta, status, normalized FROM cmp", _compare(True)),
    "compare_real": _on_bridge(f"SELECT k_agency, k_account, round(((1 + pct / 100) / 1.03 - 1) * 100, 1) + 0.0 AS real_delta_pct, {_FLAG} AS inflation_flag FROM cmp", _compare()),
    "compare_inflation_counts": _on_bridge(f"SELECT count(*) FILTER (f = 'real_increase') AS beat_inflation, count(*) FILTER (f IN ('real_cut', 'inflation_erosion')) AS fell_behind FROM (SELECT {_FLAG} AS f FROM cmp)", _compare()),
    "compare_status_counts": _on_bridge("SELECT status, count(*) AS accounts FROM resc GROUP BY 1", _compare()),
    "compare_movements": _on_bridge("SELECT count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down, count(*) FILTER (delta = 0) AS unchanged, CAST(coalesce(sum(delta) FILTER (delta > 0), 0) AS BIGINT) AS increases, CAST(coalesce(sum(delta) FILTER (delta < 0), 0) AS BIGINT) AS decreases, round(CAST(sum(delta) AS BIGINT) / CAST(sum(base_dollars) AS BIGINT) * 100, 6) AS net_pct FROM cmp", _compare()),
    "compare_top_changes": _on_bridge("(SELECT k_agency, k_account, delta FROM cmp WHERE delta > 0 ORDER BY delta DESC, k_agency, k_account LIMIT 5) UNION ALL (SELECT k_agency, k_account, delta FROM cmp WHERE delta < 0 ORDER BY delta, k_agency, k_account LIMIT 5)", _compare()),
    "tas_rescue": _on_bridge("""SELECT k_agency, k_account, base_dollars, current_dollars, current_dollars - base_dollars AS delta, status FROM (
      SELECT k_agency, k_account, CASE WHEN status = 'only in current' AND y.b IS NOT NULL THEN y.b ELSE base_dollars END AS base_dollars, CASE WHEN status = 'only in base' AND x.c IS NOT NULL THEN x.c ELSE current_dollars END AS current_dollars,
             CASE WHEN (status = 'only in base' AND x.c IS NOT NULL) OR (status = 'only in current' AND y.b IS NOT NULL) THEN 'matched (TAS)' ELSE status END AS status
      FROM cmp LEFT JOIN (SELECT b, arg_min(c, fas_code) AS c FROM codes GROUP BY b) x ON base_dollars = x.b LEFT JOIN (SELECT c, arg_min(b, fas_code) AS b FROM codes GROUP BY c) y ON current_dollars = y.c)""", _compare() + ", codes AS (SELECT fas_code, CAST(sum(coalesce(dollars, 0)) FILTER (fy = 1997) AS BIGINT) AS b, CAST(sum(coalesce(dollars, 0)) FILTER (fy = 1998) AS BIGINT) AS c FROM mapped WHERE fas_code IS NOT NULL AND fy IN (1997, 1998) GROUP BY 1 HAVING count(DISTINCT fy) = 2)"),
    "link_relabel": _on_bridge("""SELECT cmp.k_agency, cmp.k_account, CASE WHEN status IN ('only in base', 'only in current') AND EXISTS (SELECT 1 FROM labels WHERE contains(l, lower(coalesce(b.nm, c.nm))) OR contains(lower(coalesce(b.nm, c.nm)), l)) THEN 'linked' ELSE status END AS status
      FROM cmp LEFT JOIN disp b ON b.fy = 1997 AND b.k_agency = cmp.k_agency AND b.k_account = cmp.k_account LEFT JOIN disp c ON c.fy = 1998 AND c.k_agency = cmp.k_agency AND c.k_account = cmp.k_account""",
      _compare() + ", labels AS (SELECT DISTINCT 'the ' || p_name AS l FROM part), disp AS (SELECT fy, k_agency, k_account, arg_min(account_name, (identifier, bill_dir, provision_index)) AS nm FROM keyed WHERE provision_type = 'appropriation' AND semantics = 'new_budget_authority' GROUP BY ALL)"),
    "jurisdiction": f"""SELECT {_case('t', _RULES, "CASE WHEN t = 'health' OR starts_with(t, 'health ') THEN 'labor_hhs' ELSE 'other' END")} AS jurisdiction, {_case('t', [(a, a) for a, _ in _RULES], "CASE WHEN t = 'health' OR starts_with(t, 'health ') THEN 'health' ELSE 'default_rule' END")} AS pattern, count(*) AS n
      FROM (SELECT lower(p_name || ' ' || {_TITLES}[p_partkey % 7 + 1]) AS t FROM part) GROUP BY ALL""",
    "timing": _on_bridge("""SELECT CASE WHEN availability <> '' THEN CASE WHEN year(l_shipdate) + 1 > fy THEN 'advance' ELSE 'current_year' END WHEN line = 2 THEN 'supplemental' ELSE 'current_year' END AS timing,
      CASE WHEN availability <> '' THEN year(l_shipdate) + 1 END AS available_fy, CASE WHEN availability <> '' THEN 'fiscal_year_comparison' WHEN line = 2 THEN 'note_text' ELSE 'default_rule' END AS source, count(*) AS n FROM provisions WHERE provision_type = 'appropriation' AND semantics = 'new_budget_authority' GROUP BY ALL"""),
    "timing_confusion": _on_bridge("""SELECT timing AS expected, CASE WHEN availability <> '' THEN CASE WHEN year(l_shipdate) + 1 > fy THEN 'advance' ELSE 'current_year' END WHEN line = 2 THEN 'supplemental' ELSE 'current_year' END AS actual, count(*) AS n FROM provisions WHERE provision_type = 'appropriation' AND semantics = 'new_budget_authority' GROUP BY ALL"""),
    "availability": _on_bridge("SELECT year(l_shipdate) + 1 AS fy, count(*) AS n FROM provisions WHERE availability <> '' GROUP BY 1"),
    "bill_nature": _on_bridge("SELECT bill_dir, CASE WHEN r >= 5 THEN 'omnibus' WHEN r >= 2 THEN 'minibus' ELSE c END AS bill_nature FROM (SELECT bill_dir, min(classification) AS c, (SELECT count(*) FROM jur WHERE jur.bill_dir = p.bill_dir AND jurisdiction NOT IN ('extenders', 'other')) AS r FROM provisions p GROUP BY bill_dir)"),
    "tas_resolve": _on_bridge("SELECT bill_dir, provision_index, fas_code, method, confidence FROM mapped"),
    "tas_summary": _on_bridge("SELECT count(*) AS total_provisions, count(fas_code) AS deterministic_matched, CAST(0 AS BIGINT) AS llm_matched, count(*) - count(fas_code) AS unmatched, count(DISTINCT fas_code) AS unique_fas_codes, round(count(fas_code) / count(*) * 100, 6) AS match_rate_pct FROM mapped"),
    "tas_by_bill": _on_bridge("SELECT coalesce(bill_dir, 'TOTAL') AS bill_dir, count(*) AS provisions, count(fas_code) AS matched, round(count(fas_code) / count(*) * 100, 6) AS match_pct FROM mapped GROUP BY ROLLUP (bill_dir)"),
    "agency_codes": """SELECT agency, CASE WHEN agency = '' THEN NULL WHEN contains(lower(agency), 'defense') OR lower(agency) = 'dod' THEN CASE k WHEN 0 THEN '021' WHEN 1 THEN '017' ELSE '097' END WHEN agency = 'Department of Energy' THEN '089' WHEN agency = 'Forest Service, USDA' THEN '012' WHEN agency = 'the Coast Guard' THEN '070' WHEN agency = 'national park' THEN '014' END AS code, count(*) AS n
      FROM (SELECT ['Department of Defense', 'Forest Service, USDA', 'DoD', 'the Coast Guard', 'Department of Energy', 'national park', ''][p_partkey % 7 + 1] AS agency, p_partkey % 3 AS k FROM part) GROUP BY ALL""",
    "code_quality": _on_bridge("SELECT confidence, count(*) AS provisions, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct FROM mapped GROUP BY 1"),
    "authorities": _on_bridge("SELECT m.fas_code, any_value(f.title) AS fas_title, any_value(f.agency_name) AS agency_name, count(*) AS provision_count, count(DISTINCT bill_dir) AS bill_count, count(DISTINCT account_name) AS name_count, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS total_dollars FROM mapped m JOIN fas f ON m.fas_code = f.fas_code GROUP BY 1"),
    "variants": _on_bridge("""SELECT fas_code, name, bills, CASE WHEN name = top THEN 'canonical' WHEN renamed THEN 'name_change' WHEN norm = topnorm THEN CASE WHEN lower(name) = lower(top) THEN 'case_variant' ELSE 'prefix_variant' END ELSE 'inconsistent_extraction' END AS classification FROM (
      SELECT v.*, first_value(name) OVER w AS top, first_value(norm) OVER w AS topnorm, r.renamed FROM v JOIN (SELECT fas_code, count(*) = 2 AND max(lo) > min(hi) AND arg_max(lo, (lo, hi, norm)) > arg_min(hi, (lo, hi, norm)) AS renamed FROM (SELECT fas_code, norm, min(lo) AS lo, max(hi) AS hi FROM v GROUP BY ALL) GROUP BY 1) r ON v.fas_code = r.fas_code
      WINDOW w AS (PARTITION BY v.fas_code ORDER BY bills DESC, name DESC))""", ", v AS (SELECT fas_code, account_name AS name, trim(regexp_extract(lower(account_name), '[^—–]*$')) AS norm, count(DISTINCT bill_dir) AS bills, min(fy) AS lo, max(fy) AS hi FROM mapped WHERE fas_code IS NOT NULL GROUP BY ALL)"),
    "rename_events": _on_bridge("""SELECT fas_code, 'rename' AS event_type, b.lo AS fiscal_year, a.nm AS "from", b.nm AS "to" FROM (
      SELECT fas_code, count(*) AS k, arg_min({'lo': lo, 'hi': hi, 'nm': nm}, (lo, hi, norm)) AS a, arg_max({'lo': lo, 'hi': hi, 'nm': nm}, (lo, hi, norm)) AS b FROM (SELECT fas_code, norm, min(fy) AS lo, max(fy) AS hi, min(name) AS nm FROM v GROUP BY ALL) GROUP BY 1) WHERE k = 2 AND a.hi < b.lo""",
      ", v0 AS (SELECT fas_code, fy, CASE WHEN fy < 1998 THEN CASE WHEN contains(account_name, '—') THEN split_part(account_name, '—', 1) || '—Old ' || split_part(account_name, '—', 2) ELSE 'Old ' || account_name END ELSE account_name END AS name FROM mapped WHERE fas_code IS NOT NULL), v AS (SELECT *, trim(regexp_extract(lower(name), '[^—–]*$')) AS norm FROM v0)"),
    "authority_timeline": _on_bridge("SELECT * FROM years", _YEARS),
    "authority_search": _on_bridge("SELECT fas_code, title AS fas_title FROM (SELECT m.fas_code, any_value(f.title) AS title, lower(any_value(f.title) || ' ' || any_value(f.agency_name) || ' ' || m.fas_code || ' ' || string_agg(DISTINCT account_name, ' ')) AS t FROM mapped m JOIN fas f ON m.fas_code = f.fas_code GROUP BY 1) WHERE contains(t, 'economy') AND contains(t, 'nation_1')"),
    "biggest_changes": _on_bridge("SELECT fas_code, b AS base_dollars, c AS current_dollars, c - b AS delta, round((c - b) / b * 100, 6) AS delta_pct FROM (SELECT fas_code, CAST(coalesce(sum(total_dollars) FILTER (fy = 1997), 0) AS BIGINT) AS b, CAST(coalesce(sum(total_dollars) FILTER (fy = 1998), 0) AS BIGINT) AS c FROM years GROUP BY 1) WHERE b > 0 AND c > 0", _YEARS),
    "set_overlap": _on_bridge("SELECT fas_code, CASE count(DISTINCT fy) WHEN 2 THEN 'shared' ELSE CASE min(fy) WHEN 1997 THEN 'only_base' ELSE 'only_current' END END AS side FROM mapped WHERE fas_code IS NOT NULL AND fy IN (1997, 1998) GROUP BY 1"),
    "top_trends": _on_bridge("SELECT fas_code, fy, total_dollars FROM years WHERE fas_code IN (SELECT fas_code FROM years GROUP BY 1 ORDER BY sum(total_dollars) DESC, fas_code LIMIT 6) AND fy BETWEEN 1995 AND 2002 AND total_dollars > 0", _YEARS),
    "first_to_last": _on_bridge("SELECT *, round((last_dollars - first_dollars) / abs(first_dollars) * 100, 6) AS change_pct FROM (SELECT fas_code, arg_min(total_dollars, fy) AS first_dollars, arg_max(total_dollars, fy) AS last_dollars, min(fy) AS first_fy, max(fy) AS last_fy FROM years WHERE total_dollars <> 0 GROUP BY 1)", _YEARS),
    "similar_topn": _VEC + " SELECT CAST(e.label AS VARCHAR) AS bill_dir, e.vec_id AS provision_index, round(list_dot_product(e.v, me.v), 3) AS similarity FROM e, me WHERE e.vec_id <> 7 ORDER BY list_dot_product(e.v, me.v) DESC, 1, 2 LIMIT 20",
    "similar_many": _VEC + """ SELECT source_dir, source_index, CAST(rank AS INTEGER) AS rank, bill_dir, provision_index, round(s, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY source_index ORDER BY s DESC, bill_dir, provision_index) AS rank FROM (
      SELECT CAST(q.label AS VARCHAR) AS source_dir, q.vec_id AS source_index, CAST(e.label AS VARCHAR) AS bill_dir, e.vec_id AS provision_index, round(list_dot_product(e.v, q.v), 9) AS s FROM e, e q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 20""",
    "relate_tiers": _VEC + _RELATED + " SELECT tier, CAST(rank AS INTEGER) AS rank, CAST(label AS VARCHAR) AS bill_dir, vec_id AS provision_index, confidence, round(s, 6) AS similarity FROM ranked WHERE rank <= 10",
    "relate_timeline": _VEC + _RELATED + """ SELECT fy, CAST(sum(CASE WHEN timing = 'current_year' THEN dollars ELSE 0 END) AS BIGINT) AS current_year_ba, CAST(sum(CASE WHEN timing = 'advance' THEN dollars ELSE 0 END) AS BIGINT) AS advance_ba, CAST(sum(CASE WHEN timing = 'supplemental' THEN dollars ELSE 0 END) AS BIGINT) AS supplemental_ba, CAST(count(DISTINCT label) AS INTEGER) AS bills
      FROM (SELECT fy, timing, dollars, label FROM ranked WHERE tier = 'same_account' AND rank <= 10 UNION ALL SELECT fy, timing, dollars, label FROM me) WHERE dollars IS NOT NULL GROUP BY 1""",
    "link_suggest": _VEC + _LINKS + " SELECT source_dir, source_index, target_dir, target_index, confidence, hash, round(s, 6) AS similarity FROM link WHERE confidence IS NOT NULL",
    "link_accept": _VEC + _LINKS + " SELECT hash, 'same_account' AS relationship, CASE confidence WHEN 'verified' THEN 'name_match' ELSE 'high_similarity' END AS evidence FROM link WHERE confidence IN ('verified', 'high')",
    "link_hashes": "SELECT n_nationkey, substr(sha256(n_name || ':' || n_nationkey || '→t:' || n_regionkey || ':m'), 1, 8) AS hash FROM nation",
    "embedding_text": _on_bridge(f"SELECT bill_dir, provision_index, {EMBEDDED} AS embedding_text FROM provisions"),
    "verify_text_tiers": _CLAIMS + "SELECT CASE WHEN contains(source, raw_text) THEN 'exact' WHEN strlen(n) > 10 AND contains(ns, n) THEN 'normalized' WHEN strlen(replace(n, ' ', '')) > 10 AND contains(replace(ns, ' ', ''), replace(n, ' ', '')) THEN 'spaceless' ELSE 'no_match' END AS match_tier, count(*) AS n FROM norm JOIN srcn ON norm.bill_dir = srcn.bill_dir WHERE raw_text <> '' GROUP BY 1",
    "verify_amounts": _CLAIMS + "SELECT status, count(*) AS n FROM chk GROUP BY 1",
    "completeness": _CLAIMS + "SELECT docs.bill_dir, coalesce(total, 0) AS total_amounts, coalesce(acc, 0) AS accounted_for, CASE WHEN total > 0 THEN round(acc / total * 100, 6) ELSE 100.0 END AS completeness_pct FROM docs LEFT JOIN cov ON docs.bill_dir = cov.bill_dir",
    "unaccounted": _CLAIMS + "SELECT bill_dir, total - acc AS n FROM cov WHERE total > acc",
    "text_index": r"""SELECT doc_id, count(*) AS n, CAST(sum(CAST(d AS BIGINT)) AS VARCHAR) AS total FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9.,]*[0-9.,]')), '[^0-9]', '', 'g') AS d, 1 FROM (SELECT doc_id, regexp_replace(text, '(^|[^0-9.,])[.,]+[0-9.,]*', '\1', 'g') AS text FROM documents)) WHERE d <> '' GROUP BY 1""",
    "xml_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<!--.*?-->', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INTEGER) AS paragraphs FROM pages""",
    "suggest_text_match": _on_bridge("""SELECT canonical, member, 'orphan_pair' AS evidence, count(*) AS orphan_pairs_resolved, substr(sha256(lower(canonical) || ':' || lower(member)), 1, 8) AS hash FROM (
      SELECT account, 'Bureau of Nation ' || nation AS canonical, 'Nation ' || nation AS member FROM (SELECT lower(account_name || ' ' || nation) AS account, nation, fy < 1998 AS early FROM ba) GROUP BY ALL HAVING count(DISTINCT early) = 2) GROUP BY ALL"""),
    "regex_variants": "SELECT 'Office for ' || lower(n_name) AS a, 'Office of ' || lower(n_name) AS b, 'preposition_variant' AS pattern FROM nation UNION ALL SELECT 'U.S. ' || lower(n_name), 'United States ' || lower(n_name), 'us_abbreviation' FROM nation UNION ALL SELECT lower(n_name) || '—army', lower(n_name) || '—department of the army', 'prefix_expansion' FROM nation",
    "by_agency_share": _on_bridge("SELECT CASE WHEN agency = '' THEN 'Unknown' ELSE agency END AS agency, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS budget_authority, round(CAST(sum(coalesce(dollars, 0)) AS BIGINT) / CAST(sum(sum(coalesce(dollars, 0))) OVER () AS BIGINT) * 100, 6) AS share_pct FROM ba GROUP BY 1"),
    "scorecard": _on_bridge("SELECT jurisdiction, " + ", ".join(f"CAST(coalesce(sum(dollars) FILTER (fy = {y}), 0) AS BIGINT) AS fy{y}" for y in (1996, 1997, 1998, 1999)) + " FROM ba JOIN jur ON ba.bill_dir = jur.bill_dir AND ba.division = jur.division GROUP BY 1"),
    "defense_trend": _on_bridge("SELECT fy, d AS defense, n AS non_defense, CASE WHEN d + n <> 0 THEN round(d / (d + n) * 100, 6) ELSE 0.0 END AS defense_pct FROM (SELECT fy, CAST(sum(CASE WHEN division = 'A' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN division = 'A' THEN 0 ELSE coalesce(dollars, 0) END) AS BIGINT) AS n FROM ba GROUP BY 1)"),
    "cr_impact": _on_bridge("SELECT bill_dir, count(*) AS substitutions, CAST(sum(least(dollars - 5000000, 0)) AS BIGINT) AS cuts, CAST(sum(greatest(dollars - 5000000, 0)) AS BIGINT) AS increases, CAST(sum(dollars - 5000000) AS BIGINT) AS net FROM provisions WHERE provision_type = 'limitation' GROUP BY 1"),
    "type_histogram": _on_bridge("SELECT provision_type, count(*) AS provisions FROM provisions GROUP BY 1"),
    "detail_levels": _on_bridge("SELECT CASE WHEN provision_type <> 'appropriation' THEN 'n/a' WHEN detail_level = '' THEN 'unspecified' ELSE detail_level END AS detail_level, count(*) AS provisions FROM provisions GROUP BY 1"),
    "type_division_counts": _on_bridge("SELECT bill_dir, provision_type, division, count(*) AS provisions FROM provisions GROUP BY ALL"),
    "treemap": _on_bridge("SELECT 'Division ' || division AS jurisdiction, left(agency, 50) AS agency, left(account_name, 60) AS account, CAST(sum(dollars) AS BIGINT) AS budget_authority FROM ba WHERE dollars > 0 GROUP BY ALL"),
    "biggest_rescissions": _on_bridge("SELECT account_name, abs(dollars) AS dollars, bill_dir, provision_index FROM provisions WHERE provision_type = 'rescission' ORDER BY abs(dollars) DESC, bill_dir, provision_index LIMIT 5"),
    "big_ticket": _on_bridge("SELECT bill_dir, provision_index, dollars FROM provisions WHERE abs(dollars) >= 10400000"),
    "earmarks": _on_bridge("SELECT recipient, count(*) AS n, CAST(sum(dollars) AS BIGINT) AS dollars FROM (SELECT CASE WHEN line = 3 THEN part_type ELSE '' END AS recipient, dollars FROM provisions WHERE provision_type = 'limitation' UNION ALL SELECT part_type, dollars FROM provisions WHERE line = 3) GROUP BY 1"),
    "summary_card": _on_bridge("SELECT count(DISTINCT bill_dir) AS bills, count(*) AS provisions, (SELECT CAST(sum(coalesce(dollars, 0)) AS BIGINT) FROM ba) AS budget_authority, CAST(sum(abs(dollars)) FILTER (provision_type = 'rescission') AS BIGINT) AS rescissions, count(DISTINCT agency) FILTER (agency <> '') AS agencies, count(DISTINCT account_name) FILTER (account_name <> '') AS accounts FROM provisions"),
    "chunk_ranges": _on_bridge("SELECT bill_dir, line AS ord, CAST(sum(n) OVER w - n AS BIGINT) AS first_index, CAST(sum(n) OVER w AS BIGINT) AS end_index FROM (SELECT bill_dir, line, count(*) AS n FROM provisions GROUP BY ALL) WINDOW w AS (PARTITION BY bill_dir ORDER BY line)"),
    "available_years": _on_bridge("SELECT DISTINCT fy FROM provisions"),
    "fiscal_year_cpi": "SELECT fy, round(avg(v), 4) AS cpi, CAST(count(*) AS INTEGER) AS months FROM (SELECT CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / count(*) AS v FROM orders GROUP BY 1, year(o_orderdate), month(o_orderdate)) GROUP BY 1 HAVING count(*) >= 3",
    "inflation_context": "WITH y AS (SELECT fy, avg(v) AS c, CAST(count(*) AS INTEGER) AS m FROM (SELECT year(o_orderdate + INTERVAL 3 MONTH) AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / count(*) AS v FROM orders GROUP BY 1, year(o_orderdate), month(o_orderdate)) GROUP BY 1) SELECT b.m AS base_months, c.m AS current_months, round(c.c / b.c - 1, 8) AS rate FROM y b, y c WHERE b.fy = 1997 AND c.fy = 1998",
    "token_rate": """WITH e AS (SELECT user_id, ts, value, epoch_us(ts) AS t FROM events), w AS (SELECT *, count(*) OVER q AS n, t - min(t) OVER q AS span, arg_min(value, (t, value)) OVER q AS v0, arg_max(value, (t, value)) OVER q AS v1 FROM e WINDOW q AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW))
      SELECT user_id, ts, CASE WHEN n >= 2 AND span >= 1000000 THEN CAST(floor(greatest(v1 - v0, 0.0) / (span / 1e6)) AS BIGINT) END AS rate FROM w""",
    "dollars_shown": _on_bridge("SELECT format('{:,}', dollars) AS shown, count(*) AS n FROM ba WHERE dollars IS NOT NULL GROUP BY 1"),
    "quality_grades": _on_bridge("SELECT quality, coalesce(st, '-') AS status, coalesce(tier, '-') AS tier, count(*) AS n FROM checked GROUP BY ALL", _CHECKED),
    "attribution_gap": _on_bridge("SELECT bill_dir, " + ", ".join(f"count(*) FILTER (amount_status = '{s}') AS {s}, CAST(sum(CASE WHEN amount_status = '{s}' THEN abs(coalesce(dollars, 0)) ELSE 0 END) AS BIGINT) AS {s}_dollars" for s in ("verified", "ambiguous", "not_found")) + ", count(*) FILTER (amount_status IS NULL) AS no_amount FROM provisions GROUP BY 1"),
}
