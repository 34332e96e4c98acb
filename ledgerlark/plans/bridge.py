"""Canonical views derived from the driver's star-schema tables, so that every operator runs on them.

A bill is a fiscal year and an order priority; its provisions are line items. ``SQL`` derives the same in DuckDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared

ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
#: Up to so many suppliers' places are broadcast, about 50 bytes each.
BROADCAST_SEATS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _between(key: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds up to a key, by halving."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(key < bounds[m], _between(key, bounds[:m], first)).otherwise(_between(key, bounds[m + 1 :], first + m + 1))


def _kept(rows: DataFrame, root: str) -> DataFrame:
    rows.write.parquet(root)
    return rows.sparkSession.read.schema(rows.schema).parquet(root)


def _coded(*parts: tuple[Column, int]) -> Column:
    """Small numbers, each from 0 and below its bound (the first has none), as one long."""
    code = parts[0][0].cast("long")
    for c, bound in parts[1:]:
        code = code * bound + F.coalesce(c.cast("long"), F.lit(0))
    return code


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables joined, with each row's ``position`` in its bill.

    A bill's rows go by order, so a row stands behind the rows of the bill's earlier orders: orders are counted first, summed
    up in ranges of their keys and over the ranges, and within an order rows are ranked where the join has brought them. So no
    task holds a bill. Lines are shuffled twice, by order and then by part, as numbers alone: places and bills are numbered,
    what the view tells apart of a line is in ``marks``, and names come last. The part's names come by a shuffle at any size, so
    what is shuffled grows as the lines do. A line counts if its part is there, which is asked of the distinct keys; where
    keys of parts repeat, or very many lack their part, lines meet their parts before they are counted.
    """
    root = f"{shared.folder(spark)}/ledgerlark-view/{uuid.uuid4().hex}"
    t = lambda n: table(spark, sf_dir, n)
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_regionkey", "r_name")  # 25 nations
    named = named.withColumn("place", F.row_number().over(Window.orderBy(*named.columns)))
    seats = t("supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "place")
    seats = F.broadcast(seats) if seats.count() <= BROADCAST_SEATS else seats
    parts = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").hint("shuffle_hash")
    at_part = F.col("l_partkey") == F.col("p_partkey")

    tax, discount = F.round(F.col("l_tax") * 100), F.round(F.col("l_discount") * 100)
    status = F.when(tax == 0, 0).when((F.col("l_linestatus") == "O") & (tax < 3), 1).when(tax > 7, 2).otherwise(3)
    tier = F.when(discount <= 5, 1).when(discount <= 7, 2).when(discount == 8, 3).when(discount == 9, 4)
    marks = _coded((F.col("place"), 0), (status, 4), (tier, 5), (F.col("l_returnflag") == "R", 2), (F.col("l_quantity") == 50, 2))
    lines = t("lineitem").where("l_partkey is not null").join(seats, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", *ROW_ORDER[1:], marks.alias("marks"))
    held = t("part").groupBy("p_partkey").agg(F.count("*").alias("n"))
    odd = _kept(lines.select("l_partkey").distinct().join(held, at_part, "left").where("n is null or n > 1").select("l_partkey", "n"), f"{root}/odd")
    few = odd.count()
    early = few > BROADCAST_SEATS or not odd.where("n > 1").isEmpty()
    if early:
        lines = lines.join(parts, at_part)
    elif few:
        lines = lines.join(F.broadcast(odd.select("l_partkey")), "l_partkey", "left_anti")

    orders = t("orders").select("o_orderkey", "o_orderpriority", F.year(F.add_months("o_orderdate", 3)).alias("fy"))
    bounds = sorted({b for b in orders.agg(F.percentile_approx("o_orderkey", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []})
    counted = orders.join(lines.groupBy("l_orderkey").agg(F.count("*").alias("n")), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    held = _kept(counted.withColumn("part", _between(F.col("o_orderkey"), bounds)), f"{root}/orders")
    bill = ["fy", "o_orderpriority"]
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.groupBy(*bill, "part").agg(F.sum("n").alias("n")).withColumn("start", before(bill, "part"))  # at most 64 rows a bill
    starts = _kept(starts.withColumn("bill", F.dense_rank().over(Window.orderBy(*bill))), f"{root}/starts")
    ranges = F.broadcast(starts.select(F.struct(*bill, "part").alias("at"), "bill", "start"))
    placed = held.join(ranges, F.struct(*bill, "part").eqNullSafe(F.col("at"))).select("o_orderkey", "bill", "part", "n", "start")
    placed = placed.select("o_orderkey", "bill", (F.col("start") + before(["bill", "part"], "o_orderkey")).alias("first"))
    whole = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "bill").orderBy(*ROW_ORDER)) - 1
    tenth = F.col("l_suppkey") % 10
    shown = _coded((F.col("marks"), 0), (F.when(tenth == 0, 1).when(tenth == 1, 2), 3))
    years = [F.year("l_shipdate").alias("ship_year"), F.year(F.add_months("l_shipdate", 3)).alias("ship_fy")]
    numbered = whole.select("bill", (F.col("first") + rank).alias("position"), "l_linenumber", "l_extendedprice", *years, shown.alias("marks"), *(parts.columns if early else ["l_partkey"]))
    numbered = numbered if early else numbered.join(parts, at_part).drop("l_partkey")
    bills = F.broadcast(starts.select("bill", *bill).distinct())
    complete = numbered.withColumn("place", F.expr(f"cast(marks div {_MARKS} as int)")).join(F.broadcast(named), "place").join(bills, "bill")
    return _kept(complete.drop("place", "bill", "p_partkey"), f"{root}/rows")


#: Of ``marks``: what the bounds after the place come to. A mark is read by those after its own: ``marks div below % bound``.
_MARKS = 4 * 5 * 2 * 2 * 3
_VIEWS: dict[tuple[str, str], DataFrame] = {}


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provisions view, with ``timing``, ``amount_status`` and ``tier`` beside it for the side tables. The joined rows
    are kept as Parquet for the session, as most queries read the view several times."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _VIEWS:
        _VIEWS[known] = _numbered(spark, sf_dir)
    rows, position = _VIEWS[known], F.col("position")
    bill = F.concat(F.col("fy").cast("string"), F.lit("-"), F.col("o_orderpriority"))
    mark = lambda below, bound: F.expr(f"marks div {below} % {bound}")
    kind = F.when(mark(6, 2) == 1, "rescission").when(F.col("l_linenumber") == 7, "limitation").otherwise("appropriation")
    money = kind == "appropriation"
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    value = F.when((kind == "rescission") & (F.col("l_linenumber") % 2 == 1), -cents).when(money & (mark(3, 2) == 1), None).otherwise(cents)
    account = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(", "), "p_brand")).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("—"), "p_name")).otherwise(F.upper("p_name"))
    agency = F.when(mark(1, 3) == 1, F.concat(F.lit("Office of Inspector General, "), "n_name")).when(mark(1, 3) == 2, F.concat("n_name", F.lit(", "), "r_name")).otherwise(F.col("n_name"))
    detail = F.when(F.col("l_linenumber").isin(1, 2), "top_level").when(F.col("l_linenumber") == 3, "line_item").when(F.col("l_linenumber") == 4, "sub_allocation").when(F.col("l_linenumber") == 5, "proviso_amount").otherwise("")
    later = F.col("ship_fy") > F.col("fy")
    status, tier = mark(60, 4), mark(12, 5)
    return rows.select(
        bill.alias("bill_dir"),
        F.col("o_orderpriority").alias("identifier"),
        F.lit(None).cast("int").alias("congress"),
        F.when(F.col("o_orderpriority") < "3", "omnibus").otherwise("regular").alias("classification"),
        F.array("fy").alias("fiscal_years"),
        "fy",
        position.cast("long").alias("provision_index"),
        kind.alias("provision_type"),
        F.lit("").alias("section"),
        F.chr(F.col("r_regionkey") + 65).alias("division"),
        F.lit("").alias("title"),
        F.lit(1.0).cast("float").alias("confidence"),
        F.concat(F.lit("For "), account, F.lit(" of "), "n_name").alias("raw_text"),
        F.when(F.col("l_linenumber") == 2, F.array(F.lit("Supplemental funds"))).otherwise(F.array().cast("array<string>")).alias("notes"),
        account.alias("account_name"),
        F.when(kind == "limitation", "").otherwise(agency).alias("agency"),
        value.alias("dollars"),
        F.when(money, F.when(F.col("l_linenumber") == 6, "transfer_ceiling").otherwise("new_budget_authority")).otherwise(kind).alias("semantics"),
        F.when(value.isNull(), "such_sums").otherwise("specific").alias("amount_kind"),
        F.when(money, detail).otherwise("").alias("detail_level"),
        F.col("p_brand").alias("description"),
        F.when(money & (F.col("l_linenumber") == 1), F.concat(F.lit("to become available on October 1, "), F.col("ship_year").cast("string"))).otherwise("").alias("availability"),
        F.when(later, "advance").when(F.col("l_linenumber") == 2, "supplemental").otherwise("current_year").alias("timing"),
        F.when(status == 1, "ambiguous").when(status == 2, "not_found").when(status == 3, "verified").alias("amount_status"),
        F.when(tier == 1, "exact").when(tier == 2, "normalized").when(tier == 3, "spaceless").when(tier == 4, "no_match").alias("tier"),
        F.col("n_nationkey").alias("nation"),
        F.col("p_type").alias("part_type"),
        F.col("l_linenumber").alias("line"),
    )


def timings(view: DataFrame) -> DataFrame:
    return view.where("provision_type = 'appropriation' and semantics = 'new_budget_authority'").select("bill_dir", "provision_index", "timing")


def checks(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = ["bill_dir", "provision_index", F.lit(0).alias("ordinal")]
    return view.where("amount_status is not null").select(*key, F.col("amount_status").alias("status")), view.where("tier is not null").select(*key, F.col("tier").alias("match_tier"))


def jurisdictions(view: DataFrame) -> DataFrame:
    """A division's jurisdiction is the region's: A and B are subcommittees, the rest not."""
    name = F.when(F.col("division") == "A", "defense").when(F.col("division") == "B", "milcon_va").when(F.col("division") == "C", "energy_water").when(F.col("division") == "D", "extenders").otherwise("other")
    return view.select("bill_dir", "division").distinct().select("bill_dir", "division", name.alias("jurisdiction"), F.concat(F.lit("Division "), "division").alias("division_title"))


def agency_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "NATION_1", "Nation_2"), (0, "NATION_1", "NATION_1"), (1, "NATION_3", "NATION_4"), (1, "NATION_3", "NATION_2")], "ord int, canonical string, member string")


def account_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "X—Red Widget", "Blue Bolt"), (0, "X—Red Widget", "hot gear")], "ord int, canonical string, alias string")


def fas_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by nation and part type (ambiguous unless the agency is known), and of some parts by name."""
    t = lambda n: table(spark, sf_dir, n)
    kinds = t("part").groupBy("p_type").agg(F.min("p_partkey").alias("k"))
    shared = t("supplier").select("s_nationkey").distinct().join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(kinds), F.lit(True))
    code = lambda a, b: F.concat(a, F.lit("-"), b)
    three = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    a = shared.select(code(three, F.lpad(F.col("k").cast("string"), 6, "0")).alias("fas_code"), three.alias("agency_code"), F.concat("p_type", F.lit(", "), "n_name").alias("title"), F.col("n_name").alias("agency_name"), F.when(F.col("k") % 7 == 0, "discontinued").otherwise("active").alias("status"))
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).where("k % 2 = 0")
    b = names.select(code(F.lit("900"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("fas_code"), F.lit("900").alias("agency_code"), F.col("p_name").alias("title"), F.lit("PARTS").alias("agency_name"), F.lit("active").alias("status"))
    return a.unionByName(b)


def agency_codes(view: DataFrame) -> DataFrame:
    return view.where("agency <> ''").select("agency", F.lpad(F.col("nation").cast("string"), 3, "0").alias("code")).distinct()


#: The same views for DuckDB.
SQL = """
src AS (
  SELECT *, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS fy,
         CASE WHEN l_returnflag = 'R' THEN 'rescission' WHEN l_linenumber = 7 THEN 'limitation' ELSE 'appropriation' END AS provision_type,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(round(l_discount * 100) AS INTEGER) AS disc,
         CASE WHEN p_size % 3 = 0 THEN p_type || ', ' || p_brand WHEN p_size % 3 = 1 THEN p_type || '—' || p_name ELSE upper(p_name) END AS account_name,
         CASE WHEN s_suppkey % 10 = 0 THEN 'Office of Inspector General, ' || n_name WHEN s_suppkey % 10 = 1 THEN n_name || ', ' || r_name ELSE n_name END AS agency0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), provisions AS (
  SELECT fy || '-' || o_orderpriority AS bill_dir, o_orderpriority AS identifier, fy,
         CASE WHEN o_orderpriority < '3' THEN 'omnibus' ELSE 'regular' END AS classification,
         row_number() OVER (PARTITION BY fy, o_orderpriority ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS provision_index,
         provision_type, chr(65 + r_regionkey) AS division, 'For ' || account_name || ' of ' || n_name AS raw_text, account_name,
         CASE WHEN provision_type = 'limitation' THEN '' ELSE agency0 END AS agency,
         CASE WHEN provision_type = 'rescission' AND l_linenumber % 2 = 1 THEN -cents WHEN provision_type = 'appropriation' AND l_quantity = 50 THEN NULL ELSE cents END AS dollars,
         CASE WHEN provision_type <> 'appropriation' THEN provision_type WHEN l_linenumber = 6 THEN 'transfer_ceiling' ELSE 'new_budget_authority' END AS semantics,
         CASE WHEN provision_type <> 'appropriation' THEN '' WHEN l_linenumber IN (1, 2) THEN 'top_level' WHEN l_linenumber = 3 THEN 'line_item' WHEN l_linenumber = 4 THEN 'sub_allocation' WHEN l_linenumber = 5 THEN 'proviso_amount' ELSE '' END AS detail_level,
         p_brand AS description,
         CASE WHEN provision_type = 'appropriation' AND l_linenumber = 1 THEN 'to become available on October 1, ' || year(l_shipdate) ELSE '' END AS availability,
         CASE WHEN year(l_shipdate + INTERVAL 3 MONTH) > fy THEN 'advance' WHEN l_linenumber = 2 THEN 'supplemental' ELSE 'current_year' END AS timing,
         CASE WHEN tax = 0 THEN NULL WHEN l_linestatus = 'O' AND tax < 3 THEN 'ambiguous' WHEN tax > 7 THEN 'not_found' ELSE 'verified' END AS amount_status,
         CASE WHEN disc <= 5 THEN 'exact' WHEN disc <= 7 THEN 'normalized' WHEN disc = 8 THEN 'spaceless' WHEN disc = 9 THEN 'no_match' END AS tier,
         n_nationkey AS nation, p_type AS part_type, l_linenumber AS line, l_shipdate
  FROM src
), ba AS (
  SELECT * FROM provisions WHERE provision_type = 'appropriation' AND semantics = 'new_budget_authority' AND detail_level NOT IN ('sub_allocation', 'proviso_amount')
), jur AS (
  SELECT DISTINCT bill_dir, division, CASE division WHEN 'A' THEN 'defense' WHEN 'B' THEN 'milcon_va' WHEN 'C' THEN 'energy_water' WHEN 'D' THEN 'extenders' ELSE 'other' END AS jurisdiction FROM provisions
), fas AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(k AS VARCHAR), 6, '0') AS fas_code, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS agency_code,
         p_type || ', ' || n_name AS title, n_name AS agency_name, CASE WHEN k % 7 = 0 THEN 'discontinued' ELSE 'active' END AS status
  FROM (SELECT DISTINCT n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) CROSS JOIN (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY 1)
  UNION ALL SELECT '900-' || lpad(CAST(k AS VARCHAR), 6, '0'), '900', p_name, 'PARTS', 'active' FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1) WHERE k % 2 = 0
), cand AS (
  SELECT lower(trim(split_part(title, ',', 1))) AS key, fas_code, title, agency_code, count(*) OVER (PARTITION BY lower(trim(split_part(title, ',', 1)))) AS n,
         count(*) OVER (PARTITION BY lower(trim(split_part(title, ',', 1))), agency_code) AS na
  FROM fas WHERE strlen(lower(trim(split_part(title, ',', 1)))) >= 4
), named AS (
  SELECT DISTINCT agency, account_name, lpad(CAST(nation AS VARCHAR), 3, '0') AS code, lower(trim(account_name)) AS k1, lower(trim(split_part(account_name, ',', 1))) AS k2,
         CASE WHEN regexp_matches(account_name, '[—–]') THEN trim(split_part(trim(regexp_extract(lower(account_name), '[^—–]*$')), ',', 1)) END AS k3
  FROM ba WHERE account_name <> ''
), tried AS (
  SELECT agency, account_name, 1 AS pri, fas_code, CASE WHEN n = 1 THEN 'direct_match' ELSE 'agency_disambiguated' END AS method FROM named JOIN cand ON k1 = key AND (n = 1 OR (na = 1 AND agency_code = code))
  UNION ALL SELECT agency, account_name, 2, fas_code, CASE WHEN n = 1 THEN 'direct_match' ELSE 'agency_disambiguated' END FROM named JOIN cand ON k2 = key AND (n = 1 OR (na = 1 AND agency_code = code))
  UNION ALL SELECT agency, account_name, 3, fas_code, 'suffix_match' FROM named JOIN cand ON k3 = key AND (n = 1 OR (na = 1 AND agency_code = code))
), picked AS (
  SELECT agency, account_name, arg_min(fas_code, pri) AS fas_code, arg_min(method, pri) AS method FROM tried GROUP BY 1, 2
), mapped AS (
  SELECT ba.*, picked.fas_code, coalesce(picked.method, 'none') AS method, CASE WHEN picked.fas_code IS NULL THEN 'unmatched' ELSE 'verified' END AS confidence
  FROM ba LEFT JOIN picked ON ba.agency = picked.agency AND ba.account_name = picked.account_name WHERE ba.account_name <> ''
)"""
