"""DuckDB SQL for the queries over artifacts, from the tables and not from any file."""

from __future__ import annotations

from .oracle import _CHECKED, _CLAIMS, _LINKS, _VEC, EMBEDDED, SQL, _compare, _on_bridge

_DIR = "replace(bill_dir, ' ', '_')"
_EXACT = "CASE WHEN contains(source, raw_text) THEN 'exact' WHEN strlen(n) > 10 AND contains(ns, n) THEN 'normalized' WHEN strlen(replace(n, ' ', '')) > 10 AND contains(replace(ns, ' ', ''), replace(n, ' ', '')) THEN 'spaceless' ELSE 'no_match' END"
_SIZES = f""", sizes AS (SELECT {_DIR} AS bill_dir, division, min(identifier) AS identifier, count(*) AS n FROM provisions GROUP BY ALL),
lines AS (SELECT bill_dir, division, n, 'SEC. ' || n || '. For part ' || division || ', ' AS before, '$' || format('{{:,}}', n * 1000) AS money, ': Provided, That it lasts.' || chr(10) AS after FROM sizes),
placed AS (SELECT *, coalesce(sum(strlen(before || money || after)) OVER (PARTITION BY bill_dir ORDER BY division ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, sum(strlen(before || money || after)) OVER (PARTITION BY bill_dir ORDER BY division)::BIGINT AS stop, division = max(division) OVER (PARTITION BY bill_dir) AS last FROM lines)"""
_MARKED = _SIZES + """, pieces AS (SELECT bill_dir, '' AS division, -1 AS p, '' AS title, max(identifier) || chr(10) || 'Act of Tests' || chr(10) || chr(10) || 'SEC. 1. What is before.' || chr(10) AS text, max(identifier) AS identifier FROM sizes GROUP BY 1
  UNION ALL SELECT bill_dir, division, p, CASE p WHEN 3 THEN 'I' WHEN 4 THEN 'II' WHEN 5 THEN 'II' ELSE '' END, CASE p WHEN 1 THEN division || '.' WHEN 2 THEN 'Part ' || division WHEN 3 THEN 'I' || chr(10) || 'Money' || chr(10) || 'Pay' || chr(10) || 'SEC. ' || n || '. For ''''pay'''' and rent.'
      WHEN 4 THEN 'II' || chr(10) || 'Rules' || chr(10) || 'SEC. 1. Rule one is long enough.' || chr(10) || 'SEC. 2. Rule two.' WHEN 5 THEN 'SEC. 3. Rule three.' WHEN 6 THEN 'SEC. 9. After ' || division || '.' ELSE 'Z' || division || chr(10) || 'Short' END || chr(10), NULL FROM sizes, range(1, 8) t(p)
  UNION ALL SELECT DISTINCT bill_dir, 'zz', 9, '', 'SEC. 99. At last.' || chr(10), NULL FROM sizes),
marked AS (SELECT *, CAST(sum(strlen(text)) OVER (PARTITION BY bill_dir ORDER BY division, p) AS BIGINT) AS stop FROM pieces)"""
_KIND = "CASE WHEN provision_type = 'limitation' AND provision_index % 2 = 0 THEN 'cr_substitution' ELSE provision_type END"
_ANSWERS = """WITH items AS (SELECT l_orderkey AS id, l_linenumber AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord, ['appropriation', 'rescission', 'earmark_list', 'rider'][l_partkey % 4 + 1] AS kind, l_suppkey, CAST(trunc(l_extendedprice) AS BIGINT) AS price FROM lineitem)"""
_TYPED = """WITH lines AS (SELECT l_orderkey AS id, l_linenumber AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord, l_suppkey, CAST(trunc(l_extendedprice) AS BIGINT) AS price, l_linenumber = 7 AND l_suppkey % 2 = 0 AS failed,
    ['appropriation', 'rescission', 'transfer_authority', 'limitation', 'directed_spending', 'cr_substitution', 'mandatory_spending_extension', 'directive', 'rider', 'continuing_resolution_baseline', 'other'][l_partkey % 11 + 1] AS kind, l_linenumber IN (1, 2, 3, 6) AS money FROM lineitem),
  bad AS (SELECT DISTINCT id, ['Answer is not JSON', 'Expected root object', 'Missing ''bill''', 'bill not an object', 'Missing ''summary''', 'summary not an object', 'Missing ''provisions'' array'][id % 13 + 1] AS error FROM lines WHERE id % 13 < 7),
  good AS (SELECT *, CASE WHEN NOT failed THEN kind END AS t FROM lines WHERE id % 13 >= 7),
  typed AS (SELECT *, CASE t WHEN 'appropriation' THEN (k % 3 = 0)::INT WHEN 'rescission' THEN (k % 3 = 0)::INT WHEN 'transfer_authority' THEN 1 WHEN 'cr_substitution' THEN 1 WHEN 'mandatory_spending_extension' THEN 1 WHEN 'limitation' THEN (k = 2)::INT WHEN 'directive' THEN (k = 2)::INT WHEN 'rider' THEN (k = 2)::INT WHEN 'other' THEN (k = 2)::INT ELSE 0 END AS nulls,
    CASE WHEN t IS NULL THEN 0 ELSE (k IN (2, 4))::INT + CASE WHEN t IN ('appropriation', 'rescission', 'limitation', 'directed_spending', 'mandatory_spending_extension', 'other') THEN (k = 2)::INT WHEN t = 'cr_substitution' THEN (k % 2 = 0)::INT ELSE 0 END
      + CASE WHEN t IN ('appropriation', 'rescission') THEN (k % 3 = 2)::INT WHEN t IN ('limitation', 'directive', 'rider', 'other') THEN (k = 3)::INT WHEN t = 'continuing_resolution_baseline' THEN 1 ELSE 0 END END AS bent,
    CASE WHEN failed THEN 'Provision ' || ord || ': provision not an object' WHEN t IN ('appropriation', 'rescission') AND NOT money THEN 'SEC S' || k || ': missing amount on ' || t END AS warning FROM good)"""
_SUGGESTED = ", named0 AS (SELECT *, account_name || ' ' || nation AS acc, CASE WHEN fy < 1998 THEN 'Bureau of Nation ' ELSE 'Nation ' END || nation AS ag FROM provisions), pairs AS (SELECT nation, count(*) AS n FROM (SELECT lower(account_name || ' ' || nation) AS account, nation FROM ba GROUP BY ALL HAVING count(DISTINCT fy < 1998) = 2) GROUP BY 1)"
_TIMING = "CASE WHEN availability <> '' THEN CASE WHEN year(l_shipdate) + 1 > fy THEN 'advance' ELSE 'current_year' END WHEN line = 2 THEN 'supplemental' ELSE 'current_year' END"

SQL |= {
    "artifact_bills": _on_bridge(f"""SELECT {_DIR} AS bill_dir, identifier, c AS congress, identifier || ' (' || c || 'th)' AS label, CASE WHEN fy % 2 = 0 THEN 'omnibus' END AS nature, CAST(n AS INTEGER) AS provisions, round(v * 100 / n, 6) AS completeness_pct FROM (
      SELECT bill_dir, identifier, fy, CASE WHEN fy % 2 = 0 AND identifier < '3' THEN 118 ELSE fy END AS c, count(*) AS n, count(*) FILTER (amount_status = 'verified') AS v FROM provisions GROUP BY ALL)"""),
    "artifact_provisions": _on_bridge(f"""SELECT {_DIR} AS bill_dir, provision_index, identifier, fy, k AS provision_type, division, account_name, CASE WHEN k IN ('appropriation', 'rescission') THEN agency ELSE '' END AS agency, raw_text, dollars, semantics,
      CASE WHEN dollars IS NULL THEN 'such_sums' ELSE 'specific' END AS amount_kind, '$' || format('{{:,}}', dollars) AS text_as_written, CASE WHEN k = 'appropriation' THEN fy END AS fiscal_year, CASE WHEN k = 'appropriation' THEN detail_level ELSE '' END AS detail_level,
      CASE k WHEN 'limitation' THEN description WHEN 'cr_substitution' THEN 'Act ' || line WHEN 'appropriation' THEN part_type ELSE '' END AS description, CASE WHEN k = 'cr_substitution' THEN provision_index END AS old_dollars, CASE WHEN k = 'appropriation' THEN availability ELSE '' END AS availability FROM (SELECT *, {_KIND} AS k FROM provisions)"""),
    "artifact_sidecars": _on_bridge(f"""SELECT {_DIR} AS bill_dir, kind, value, count(*) AS n, CAST(sum(i) AS BIGINT) AS indices FROM (
      SELECT bill_dir, 'amount' AS kind, amount_status AS value, provision_index AS i FROM provisions WHERE amount_status IS NOT NULL UNION ALL SELECT bill_dir, 'text', tier, provision_index FROM provisions WHERE tier IS NOT NULL
      UNION ALL SELECT bill_dir, 'timing', timing, provision_index FROM provisions WHERE fy % 2 = 0 AND provision_type = 'appropriation' AND semantics = 'new_budget_authority'
      UNION ALL SELECT * FROM (SELECT DISTINCT bill_dir, 'division', 'j' || division, 0 FROM provisions WHERE fy % 2 = 0)) GROUP BY ALL"""),
    "artifact_summary": _on_bridge(f"""SELECT {_DIR} AS bill_dir, classification, provisions, budget_authority, rescissions, CASE WHEN even THEN now END AS current_year_ba, CASE WHEN even THEN later END AS advance_ba FROM (
      SELECT bill_dir, CASE WHEN fy % 2 = 0 THEN 'omnibus' ELSE classification END AS classification, fy % 2 = 0 AS even, count(*) AS provisions, CAST(sum(CASE WHEN top THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS budget_authority, CAST(sum(CASE WHEN provision_type = 'rescission' THEN abs(dollars) ELSE 0 END) AS BIGINT) AS rescissions,
             CAST(sum(CASE WHEN top AND timing <> 'advance' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS now, CAST(sum(CASE WHEN top AND timing = 'advance' THEN coalesce(dollars, 0) ELSE 0 END) AS BIGINT) AS later
      FROM (SELECT *, provision_type = 'appropriation' AND semantics = 'new_budget_authority' AND detail_level NOT IN ('sub_allocation', 'proviso_amount') AS top FROM provisions) GROUP BY ALL)"""),
    "incomplete_bills": _on_bridge(f"SELECT {_DIR} AS bill_dir FROM provisions GROUP BY bill_dir HAVING count(*) FILTER (amount_status = 'verified') * 100 / count(*) < 60"),
    "artifact_sources": _on_bridge(f"SELECT DISTINCT {_DIR} AS bill_dir, 'BILLS-118hr1enr' AS stem, 'xml' AS kind, 118 AS congress FROM provisions"),
    "artifact_text": _on_bridge("SELECT bill_dir, sha256(string_agg(before || money || after, '' ORDER BY division) || chr(10)) AS extracted_text_sha256, 'm' AS model, '1' AS extraction_version FROM lines GROUP BY 1", _SIZES),
    "text_positions": _on_bridge("""SELECT bill_dir, 'amount' AS kind, money AS label, pos + strlen(before) AS position, n * 1000 AS "to" FROM placed UNION ALL SELECT bill_dir, 'early', money, pos + strlen(before), n * 1000 FROM placed WHERE pos + strlen(before) < 60
      UNION ALL SELECT bill_dir, 'section', 'SEC. ' || n, pos, CASE WHEN last THEN stop + 1 ELSE stop END FROM placed UNION ALL SELECT bill_dir, 'proviso', '', pos + strlen(before || money) + 2, 0 FROM placed""", _SIZES),
    "xml_bills": _on_bridge("""SELECT bill_dir, CASE WHEN good THEN identifier END AS identifier, CASE WHEN good THEN 'Act of Tests' END AS short_title, CASE WHEN good THEN 'SEC. 1. What is before.' END AS preamble, CASE WHEN good THEN full_text END AS full_text, CASE WHEN good THEN accounts END AS accounts,
      CASE WHEN good THEN 5 * accounts END AS chunks, CASE WHEN good THEN divisions END AS divisions, NOT good AS failed FROM (
      SELECT bill_dir, bill_dir NOT LIKE '1996%' AS good, max(identifier) AS identifier, string_agg(text, '' ORDER BY division, p) AS full_text, count(*) FILTER (p = 3) AS accounts, string_agg(CASE p WHEN 1 THEN division || '=Part ' || division WHEN 7 THEN 'Z' || division || '=Short' END, ';' ORDER BY division, p) AS divisions FROM marked GROUP BY 1)""", _MARKED),
    "xml_chunks": _on_bridge("""SELECT bill_dir, CAST(row_number() OVER (PARTITION BY bill_dir ORDER BY division, p) AS INTEGER) AS chunk, CASE p WHEN 7 THEN 'Z' || division WHEN 6 THEN division || '.' ELSE division || '.-' || title || CASE p WHEN 4 THEN 'a' WHEN 5 THEN 'b' ELSE '' END END AS label,
      CASE p WHEN 7 THEN 'Z' || division ELSE division || '.' END AS division, title, stop - strlen(text) AS start, stop AS "end", strlen(text) // 4 AS estimated_tokens, text FROM marked WHERE p BETWEEN 3 AND 7 AND bill_dir NOT LIKE '1996%'""", _MARKED),
    "xml_accounts": _on_bridge("SELECT bill_dir, division || '.' AS division, 1 AS accounts FROM sizes WHERE bill_dir NOT LIKE '1996%' UNION ALL SELECT bill_dir, 'Z' || division, 0 FROM sizes WHERE bill_dir NOT LIKE '1996%'", _SIZES),
    "xml_contexts": _on_bridge("SELECT bill_dir, CASE WHEN bill_dir NOT LIKE '1996%' THEN arg_min(n, division) || '. For pay and rent.' END AS context FROM sizes GROUP BY 1", _SIZES),
    "vector_files": "SELECT CAST(label AS VARCHAR) AS bill_dir, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS provision_index, 'm' AS model, CAST(len(embedding) AS INTEGER) AS dimensions, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, round(CASE WHEN list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 4) AS unit_length FROM embeddings",
    "account_reference": """WITH f AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS agency_code, n_nationkey * 400 AS m, n_name, n_nationkey AS k FROM nation)
      SELECT agency_code || '-' || lpad(CAST(m AS VARCHAR), 4, '0') AS fas_code, n_name AS fas_title, agency_code, CASE WHEN k % 5 < 4 THEN 'active' ELSE 'discontinued' END AS status, agency_code = '001' AS mine, agency_code = '001' AND k % 3 <> 0 AND m < 4000 AS general FROM f""",
    "spreadsheet_accounts": """WITH t AS (SELECT lpad(CAST(p_partkey % 7 AS VARCHAR), 3, '0') || '-' || lpad(CAST(p_partkey % 20 AS VARCHAR), 4, '0') AS fas_code, p_name AS title, lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS u, p_partkey AS k FROM part),
      a AS (SELECT fas_code, arg_max(title, (length(title), -k)) AS title, 'active' AS status, max(u) AS last_updated, bool_or(k % 2 = 0) AS has_no_year_variant, bool_or(k % 2 = 1) AS has_annual_variant, count(*) AS tas_variants FROM t WHERE k % 20 < 15 GROUP BY 1),
      b AS (SELECT fas_code, min(title) AS title, 'discontinued' AS status, NULL, NULL, NULL, NULL FROM t WHERE k % 20 >= 10 AND fas_code NOT IN (SELECT fas_code FROM a) GROUP BY 1)
      SELECT *, split_part(fas_code, '-', 1) AS agency_code, split_part(fas_code, '-', 2) AS main_account, ['general', 'trust', 'special', 'deposit', 'own'][length(title) % 5 + 1] AS fund FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "registry_file": _on_bridge("SELECT fas_code, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS total_dollars, string_agg(DISTINCT CAST(fy AS VARCHAR), ',' ORDER BY CAST(fy AS VARCHAR)) AS years FROM mapped WHERE fas_code IS NOT NULL GROUP BY 1"),
    "tas_file": _on_bridge(f"SELECT {_DIR} AS bill_dir, CASE WHEN fas_code IS NULL THEN 'unmatched' ELSE 'verified' END AS confidence, count(*) AS n, CAST(sum(provision_index) AS BIGINT) AS indices, count(DISTINCT fas_code) AS codes, CAST(coalesce(sum(dollars), 0) AS BIGINT) AS dollars FROM mapped WHERE bill_dir NOT LIKE '1995%' GROUP BY ALL"),
    "missing_metadata": _on_bridge(f"SELECT {_DIR} AS bill_dir, identifier || ': --subcommittee requires bill metadata; enrich the folder first' AS error FROM provisions WHERE fy % 2 <> 0 GROUP BY ALL"),
    "subcommittee_files": _on_bridge(f"SELECT {_DIR} AS bill_dir, division, count(*) AS n, CAST(sum(provision_index) AS BIGINT) AS indices FROM provisions WHERE fy % 2 = 0 AND division = 'B' GROUP BY ALL"),
    "rules_file": """SELECT CAST(n_regionkey AS INTEGER) AS ord, 'R' || n_regionkey AS canonical, n_name AS name, 'group' AS kind FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'R' || n_regionkey, 'R' || n_regionkey, 'group' FROM nation
      UNION ALL SELECT n_regionkey, 'R' || n_regionkey, n_name, 'alias' FROM nation""",
    "links_file": _VEC + _LINKS + """, chosen AS (SELECT * FROM link WHERE confidence = 'verified'), f AS (
        SELECT link.confidence, link.hash IN (SELECT hash FROM chosen) AS already_accepted, link.hash IN (SELECT hash FROM chosen WHERE hash <> (SELECT min(hash) FROM chosen) AND (contains(source_dir, '3') OR contains(target_dir, '3'))) AS kept FROM link WHERE confidence IS NOT NULL)
      SELECT already_accepted, kept, count(*) AS n FROM f GROUP BY ALL""",
    "cpi_file": """SELECT '2024-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS ym, n_regionkey + 0.5::DOUBLE AS value, 0 AS months FROM nation WHERE n_nationkey < 12
      UNION ALL SELECT CAST(n_nationkey + 2000 AS VARCHAR), n_regionkey + 0.5::DOUBLE, CASE WHEN n_nationkey = 1 THEN 3 ELSE 12 END FROM nation WHERE n_nationkey < 12""",
    "lenient_provisions": _ANSWERS + """ SELECT id, CAST(ord AS INTEGER) AS ord, k = 7 AS failed, CASE WHEN k <> 7 THEN CASE WHEN kind = 'earmark_list' THEN 'other' ELSE kind END END AS provision_type, CASE WHEN k <> 7 AND kind = 'earmark_list' THEN kind END AS llm_classification,
      CASE WHEN k <> 7 AND kind IN ('appropriation', 'rescission') THEN 'a' || l_suppkey END AS account_name, CASE WHEN k <> 7 AND kind = 'appropriation' THEN 2024 END AS fiscal_year, CASE WHEN k <> 7 THEN 0.5::FLOAT END AS confidence, CASE WHEN k <> 7 AND kind <> 'rider' THEN price END AS dollars,
      CASE WHEN k <> 7 AND kind <> 'rider' AND k % 3 = 0 THEN 1 ELSE 0 END AS type_coercions, CASE WHEN k = 7 OR kind <> 'appropriation' THEN NULL WHEN k % 2 = 0 THEN 'until spent' WHEN k = 5 THEN '{"period":"one-year"}' END AS availability FROM items""",
    "lenient_report": _ANSWERS + """ SELECT count(*) FILTER (k <> 7) AS provisions_parsed, count(*) FILTER (k = 7) AS provisions_failed, count(*) FILTER (k <> 7 AND kind = 'earmark_list') AS unknown_provision_types, count(*) FILTER (k % 3 = 0 AND kind <> 'rider') AS type_coercions,
      count(*) FILTER (k <> 7 AND kind IN ('appropriation', 'earmark_list', 'rider')) AS null_to_default, 0 AS errors, count(*) FILTER (k = 7) AS warnings FROM items""",
    "lenient_union": _TYPED + """ SELECT id, CAST(ord AS INTEGER) AS ord, failed, CASE WHEN failed THEN 'provision not an object' END AS error, t AS provision_type, CASE WHEN t = 'other' THEN 'novelty' END AS llm_classification, CASE WHEN NOT failed THEN 'S' || k END AS section, CASE WHEN NOT failed THEN 'A' END AS division, CASE WHEN NOT failed THEN [0.5, 0.25, 0, 0, 1, 0, 0.75][k]::FLOAT END AS confidence, CASE WHEN NOT failed THEN 'n+m' END AS notes, CASE WHEN failed THEN NULL ELSE 1 END AS refs,
      CASE WHEN t IN ('appropriation', 'rescission') THEN CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || l_suppkey ELSE '12' END WHEN t IN ('limitation', 'directed_spending', 'cr_substitution') AND k % 3 = 1 THEN 'a' || l_suppkey END AS account_name, CASE WHEN t IN ('appropriation', 'rescission') THEN ['g', NULL, 'h', NULL, 'g', 'g', 'g'][k] END AS agency,
      CASE WHEN t IN ('limitation', 'directive', 'rider', 'other') THEN ['de', '', '[1]', 'de', 'de', 'de', 'de'][k] END AS description, CASE WHEN t IN ('appropriation', 'directed_spending') THEN 'line_item' END AS detail_level, CASE WHEN t = 'transfer_authority' THEN 'from' END AS from_scope, CASE WHEN t = 'transfer_authority' THEN '' END AS to_scope,
      CASE WHEN t = 'cr_substitution' THEN 'act' END AS reference_act, CASE WHEN t = 'cr_substitution' THEN '' END AS reference_section, CASE WHEN t = 'mandatory_spending_extension' THEN 'pn' END AS program_name, CASE WHEN t = 'mandatory_spending_extension' THEN 'pe' END AS period, CASE WHEN t = 'rider' THEN 'pol' END AS policy_area, CASE WHEN t = 'continuing_resolution_baseline' THEN '0.5' END AS rate,
      CASE WHEN t = 'transfer_authority' THEN 'c' END AS conditions, CASE WHEN t = 'directive' THEN 'dl' END AS deadlines, CASE WHEN t IN ('appropriation', 'rescission', 'limitation', 'directed_spending', 'mandatory_spending_extension') THEN
        CASE WHEN money THEN [format('specific/{}/rescission/$x', price), 'specific/1234/other/', 'such_sums/other/', '', '', 'specific/0/other/', ''][k] WHEN t IN ('limitation', 'mandatory_spending_extension') THEN '' WHEN t = 'rescission' THEN 'specific/0/rescission/' ELSE 'specific/0/indefinite/' END ELSE '' END AS amount,
      CASE WHEN t = 'cr_substitution' THEN format('specific/{}/other/', price) ELSE '' END AS new_amount, CASE WHEN t <> 'cr_substitution' OR failed THEN '' WHEN k % 2 = 0 THEN format('specific/{}/other/', price) ELSE 'specific/0/reference_amount/' END AS old_amount, CASE WHEN t = 'other' THEN CASE WHEN money THEN 1 ELSE 0 END END AS amounts,
      CASE WHEN t = 'other' AND money THEN [price, 1234, NULL, NULL, NULL, 0, NULL][k] END AS other_dollars, CASE WHEN t = 'appropriation' THEN [2024, 2025, NULL, NULL, NULL, NULL, 2030][k] END AS fiscal_year, CASE WHEN t = 'continuing_resolution_baseline' THEN [2020, 2021, 0, 2020, 2020, 2020, 2020][k] END AS reference_year,
      CASE WHEN t = 'appropriation' THEN ['no_year', 'other/until spent', 'no_year', 'one_year/2026', 'multi_year/2027', 'other/{"x":1}', 'other/9'][k] ELSE '' END AS availability, CASE WHEN t = 'transfer_authority' THEN ['percentage/5.5', 'fixed_amount/7', 'other/unlimited', 'other/unknown', 'other/unknown', 'fixed_amount/8', 'other/{"fixed_amount":7}'][k] ELSE '' END AS "limit",
      CASE WHEN t = 'appropriation' THEN 1 END AS provisos, CASE WHEN t = 'appropriation' THEN 3 END AS proviso_dollars, CASE WHEN t = 'appropriation' THEN 1 END AS earmarks, CASE WHEN t = 'directed_spending' THEN 'rr' END AS recipient, CASE WHEN t = 'other' THEN 21 END AS leftover, CASE WHEN t = 'other' THEN '{"bar":[1,"z"]}' END AS foo,
      CAST(nulls AS INTEGER) AS null_to_default, CAST(bent AS INTEGER) AS type_coercions, warning FROM typed UNION ALL SELECT id, NULL, true, error, """ + ", ".join(["NULL"] * 5) + ", NULL, NULL, " + ", ".join(["NULL"] * 14) + ", '', '', '', NULL, NULL, NULL, NULL, '', '', NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, NULL FROM bad",
    "lenient_answers": _TYPED + """ SELECT id, NULL AS error, count(*) FILTER (NOT failed) AS provisions_parsed, count(*) FILTER (failed) AS provisions_failed, CAST(sum(nulls) AS BIGINT) AS null_to_default, CAST(sum(bent) AS BIGINT) AS type_coercions, count(*) FILTER (t = 'other') AS unknown_provision_types, CAST(count(warning) AS INTEGER) AS warnings,
      'H.R. 1' AS identifier, '2024,2025' AS years, 'A' AS divisions, id AS told, 2 AS riders, 0 AS told_authority, 'i' AS issues FROM typed GROUP BY id UNION ALL SELECT id, error, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bad""",
    "upgraded_files": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS kept, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey END AS v FROM orders)
      SELECT '1.0' AS schema_version, CASE WHEN NOT kept AND v = 0 AND k % 5 <> 0 THEN 'such_sums' ELSE 'specific' END AS kind, CASE WHEN k % 3 <> 0 THEN 'limitation' WHEN kept THEN 'missing' ELSE 'indefinite' END AS semantics, count(*) AS n, CAST(sum(CASE WHEN NOT kept AND v = 0 AND k % 5 <> 0 THEN NULL ELSE v END) AS BIGINT) AS dollars FROM o GROUP BY ALL""",
    "export_csv": _on_bridge("""SELECT identifier AS bill, CAST(provision_index AS VARCHAR) AS provision_index, account_name, agency, CAST(dollars AS VARCHAR) AS dollars, '' AS old_dollars, coalesce(st, 'n/a') AS amount_status, quality, '1.00' AS confidence, raw_text FROM checked WHERE provision_type = 'rescission' AND fy = 1998""", _CHECKED),
    "export_jsonl": _on_bridge("SELECT bill_dir, provision_index, dollars, account_name, true AS nulls_kept FROM provisions WHERE provision_type = 'rescission' AND fy = 1998"),
    "shown_texts": """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) * [1, 1000, 1000000][o_orderkey % 3 + 1] AS c, CAST(floor(o_totalprice * 10) AS BIGINT) AS b, o_orderpriority AS p FROM orders)
      SELECT o_orderkey, CASE WHEN c >= 1000000000000 THEN '$' || printf('%.1f', c / 1e12) || 'T' WHEN c >= 1000000000 THEN '$' || printf('%.1f', c / 1e9) || 'B' WHEN c >= 1000000 THEN '$' || printf('%.1f', c / 1e6) || 'M' ELSE '$' || format('{:,}', c) END AS short,
      CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', b / 1048576.0::DOUBLE) || ' MB' END AS size, 'Éé' || left(p, 5) || '…' AS cut_bytes, left('Éé' || p || '—ü' || chr(10) || 'end', 9) || '…' AS cut_chars, CASE WHEN strlen(p) > 10 THEN p ELSE p || '—ü end' END AS around,
      CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS fy, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-01') > 60 AS stale FROM o""",
    "bill_filters": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Became Public Law No: 1' ELSE 'BECAME LAW' END AS latest_action, count(*) AS n FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 GROUP BY 1",
    "applied_answers": _on_bridge("""SELECT CASE WHEN fas_code IS NULL AND provision_index % 3 = 0 THEN 'high' WHEN fas_code IS NULL AND provision_index % 3 = 1 THEN 'inferred' ELSE confidence END AS confidence, CASE WHEN fas_code IS NULL AND provision_index % 3 < 2 THEN 'llm_resolved' ELSE method END AS method, count(*) AS n FROM mapped GROUP BY ALL"""),
    "labelled_years": _on_bridge("SELECT fas_code, fy, string_agg(DISTINCT identifier || CASE WHEN identifier < '2' THEN ' (CR)' WHEN identifier < '3' THEN ' (supplemental)' ELSE '' END, ';' ORDER BY identifier || CASE WHEN identifier < '2' THEN ' (CR)' WHEN identifier < '3' THEN ' (supplemental)' ELSE '' END) AS bills FROM mapped WHERE fas_code IS NOT NULL GROUP BY ALL"),
    "traced": f"WITH found AS ({SQL['authority_search']}), m AS (" + _on_bridge("SELECT * FROM mapped") + ") SELECT m.fas_code, CAST(sum(coalesce(dollars, 0)) AS BIGINT) AS total_dollars, count(DISTINCT fy) AS timeline, count(DISTINCT account_name) AS variants FROM m WHERE fas_code IN (SELECT fas_code FROM found) GROUP BY 1",
    "suggestions_left": _on_bridge("SELECT 'Bureau of Nation ' || nation AS canonical, 'Nation ' || nation AS member, n AS orphan_pairs_resolved FROM pairs WHERE n >= 2 AND 'Nation ' || nation >= 'Nation 2'", _SUGGESTED),
    "suggestion_clusters": _on_bridge("SELECT string_agg(DISTINCT ag, ';' ORDER BY ag) AS agencies, count(*) AS provisions FROM named0 JOIN pairs USING (nation) WHERE contains(lower(acc), 'red ') GROUP BY nation HAVING count(*) >= 2", _SUGGESTED),
    "audit_verbose": _CLAIMS + f"SELECT 'amount' AS kind, count(*) AS n, CAST(sum(provision_index) AS BIGINT) AS indices FROM chk WHERE status = 'not_found' HAVING count(*) > 0 UNION ALL SELECT 'raw_text', count(*), CAST(sum(provision_index) AS BIGINT) FROM (SELECT provision_index, {_EXACT} AS tier FROM norm JOIN srcn ON norm.bill_dir = srcn.bill_dir WHERE raw_text <> '') WHERE tier = 'no_match' HAVING count(*) > 0",
    "text_tiers_by_bill": _CLAIMS + f"SELECT norm.bill_dir, CASE WHEN coalesce(raw_text, '') = '' THEN 'empty' ELSE {_EXACT} END AS match_tier, count(*) AS n FROM norm JOIN srcn ON norm.bill_dir = srcn.bill_dir GROUP BY ALL",
    "lost_contexts": _CLAIMS + f"""SELECT bill_dir, provision_index, CASE WHEN p > 0 THEN substr(source, greatest(p - 5, 1), p + 20 - greatest(p - 5, 1)) END AS context FROM (
      SELECT norm.bill_dir, provision_index, source, instr(source, substr(source, 31, 12)) AS p, {_EXACT} AS tier FROM norm JOIN srcn ON norm.bill_dir = srcn.bill_dir WHERE raw_text <> '') WHERE tier = 'no_match'""",
    "amount_misses": _CLAIMS + "SELECT c.bill_dir, provision_index, taw AS text_as_written FROM claims c JOIN srcn ON c.bill_dir = srcn.bill_dir WHERE taw <> '' AND NOT contains(source, taw) AND NOT contains(ns, taw)",
    "stale_stages": """SELECT stale, count(*) AS n FROM (SELECT 'extraction' AS stale FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'bill_meta' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'embeddings' FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY 1""",
    "enrichment": _on_bridge(f"""SELECT bill_dir, kind, value, count(*) AS n FROM (
      SELECT DISTINCT bill_dir, 'subcommittee' AS kind, ['defense', 'homeland_security', 'other', 'energy_water', 'continuing_resolution'][ascii(division) - 64] AS value FROM provisions WHERE fy % 2 = 1
      UNION ALL SELECT bill_dir, 'timing', {_TIMING} FROM provisions WHERE fy % 2 = 1 AND provision_type = 'appropriation' AND semantics = 'new_budget_authority'
      UNION ALL SELECT bill_dir, 'account', '' FROM provisions WHERE fy % 2 = 1 AND account_name <> '' UNION ALL SELECT DISTINCT bill_dir, 'nature', 'minibus' FROM provisions WHERE fy % 2 = 1) GROUP BY ALL"""),
    "compare_described": _on_bridge("""SELECT 'base' AS name, '5 bills (1-URGENT, 2-HIGH, ...)' AS value UNION ALL SELECT 'current', '5 bills (1-URGENT, 2-HIGH, ...)' UNION ALL SELECT 'warned', 'true'
      UNION ALL SELECT 'change ' || (row_number() OVER (ORDER BY abs(delta) DESC, k_agency, k_account) - 1), k_account || ': ' || delta FROM cmp QUALIFY row_number() OVER (ORDER BY abs(delta) DESC, k_agency, k_account) <= 3""", _compare()),
    "centroid_labels": """WITH e AS (SELECT vec_id, label, vec_id % 2 AS half, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ok AS (SELECT label FROM e GROUP BY 1 HAVING count(DISTINCT half) = 2),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS total FROM e WHERE half = 0 AND label IN (SELECT label FROM ok)),
      chosen AS (SELECT * FROM ranked WHERE i % greatest(total // least(total, 10), 1) = 0 AND i // greatest(total // least(total, 10), 1) < 10),
      parts AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM chosen), means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL),
      centres AS (SELECT label, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS l FROM means GROUP BY 1),
      near AS (SELECT t.label, arg_max(centres.label, (list_dot_product(t.v, c) / l, CAST(centres.label AS VARCHAR))) AS nearest FROM e t, centres WHERE t.half = 1 AND t.label IN (SELECT label FROM ok) GROUP BY t.vec_id, t.label)
      SELECT CAST(label AS VARCHAR) AS label, count(*) AS tested, count(*) FILTER (nearest = label) AS "right" FROM near GROUP BY 1""",
    "embedded_texts": _on_bridge(f"SELECT bill_dir, count(*) AS n, CAST(sum(length({EMBEDDED})) AS BIGINT) AS letters FROM provisions WHERE bill_dir >= '1996' GROUP BY 1"),
    "extracted_chunks": "SELECT n_name AS bill_dir, CASE WHEN length(n_name) % 2 = 0 THEN CAST(length(n_name) AS VARCHAR) END AS answer, CASE WHEN length(n_name) % 2 = 1 THEN 'odd' END AS error FROM nation",
    "repaired_spans": "SELECT ['exact', 'repaired_prefix', 'unverified'][doc_id % 3 + 1] AS match_tier, CASE WHEN doc_id % 3 < 2 THEN true END AS holds, count(*) AS n FROM documents WHERE length(text) >= 400 GROUP BY ALL",
    "nearest_amounts": _on_bridge("SELECT bill_dir, pos + strlen(before) AS position FROM placed WHERE division = 'B'", _SIZES),
    "token_rate_stream": f"SELECT * FROM ({SQL['token_rate']}) WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000",
    "repaired_tiers": """WITH numbered AS (SELECT l_orderkey AS bill_dir, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n, * FROM lineitem),
      rows_ AS (SELECT bill_dir, n, (bill_dir + n) % 5 AS k, 'SEC. ' || n || '. For part ' || l_partkey || ' of ' || l_suppkey || ', $' || CAST(round(l_extendedprice * 100) AS BIGINT) || ', available until spent.' AS s FROM numbered),
      docs AS (SELECT bill_dir, string_agg(s, chr(10) ORDER BY n) AS source FROM rows_ GROUP BY 1),
      claimed AS (SELECT *, sum(strlen(s) + 1) OVER (PARTITION BY bill_dir ORDER BY n) - strlen(s) - 1 AS pos, CASE k WHEN 0 THEN s WHEN 1 THEN s || ' (as amended)' WHEN 2 THEN 'zzzzzzzzzz' || s WHEN 3 THEN replace(s, ' ', '  ') ELSE reverse(s) END AS raw FROM rows_ JOIN docs USING (bill_dir)),
      spans AS (SELECT *, CAST(CASE WHEN k < 4 THEN greatest(pos - CASE WHEN k = 2 THEN 10 ELSE 0 END, 0) END AS BIGINT) AS a FROM claimed),
      ends AS (SELECT *, CASE WHEN k = 0 THEN a + strlen(raw) WHEN k < 4 THEN least(strlen(source), a + greatest(strlen(raw), 150)) END AS b FROM spans)
      SELECT bill_dir, n AS provision_index, ['exact', 'repaired_prefix', 'repaired_substring', 'repaired_normalized', 'unverified'][k + 1] AS match_tier, a AS "start", b AS "end", CASE WHEN k < 4 THEN substring(source, a + 1, b - a) ELSE raw END AS text, CASE WHEN k < 4 THEN true END AS holds FROM ends""",
    "repaired_report": """WITH d AS (SELECT doc_id, doc_id % 3 AS k FROM documents WHERE length(text) >= 400)
      SELECT coalesce(CAST(doc_id AS VARCHAR), 'TOTAL') AS bill_dir, count(*) AS total, count(*) FILTER (k = 0) AS exact, count(*) FILTER (k = 1) AS repaired_prefix, count(*) FILTER (k = 2) AS unverified, round(count(*) FILTER (k < 2) / count(*) * 100, 6) AS traceable_pct FROM d GROUP BY ROLLUP (doc_id)""",
    "bill_chunks": _on_bridge("""SELECT bill_dir, label, division, title, start, stop AS "end", (stop - start) // 4 AS estimated_tokens FROM (
      SELECT bill_dir, division AS label, division, '' AS title, pos AS start, pos + 16 AS stop FROM bodies UNION ALL SELECT bill_dir, division || ' I', division, 'I', pos + 16, pos + 67 + m FROM bodies
      UNION ALL SELECT bill_dir, division || ' II part 1', division, 'II', pos + 67 + m, pos + 180 + m FROM bodies UNION ALL SELECT bill_dir, division || ' II part 2', division, 'II', pos + 180 + m, pos + 281 + m FROM bodies)""",
      f""", parts AS (SELECT {_DIR} AS bill_dir, division, count(*) % 50 AS m FROM provisions GROUP BY ALL),
      bodies AS (SELECT *, 2621 + CAST(coalesce(sum(281 + m) OVER (PARTITION BY bill_dir ORDER BY division ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM parts)"""),
}
