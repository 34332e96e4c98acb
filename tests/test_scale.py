"""What showed only on larger tables: overflows, shared hashes, bills in several files, positions without one sort per bill."""

from pyspark.sql import functions as F

from ledgerlark.plans import artifacts, bridge, queries


def test_sums_and_digits_beyond_64_bits(spark, tmp_path):
    big = 2**63 - 1
    rows = [(1, f"{big} and {big}, 007"), (2, "9" * 5000 + " 5"), (3, "none"), (4, "0" * 5000 + "8")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n, r.total) for r in queries.QUERIES["text_index"](spark, str(tmp_path)).collect()}
    assert found == {1: (3, str(2 * big + 7)), 2: (1, "5"), 4: (1, "8")}


def test_links_that_share_a_hash(spark, tmp_path, monkeypatch):
    rows = [("3", 1, "4", 2, 0.5, "verified", "bb"), ("3", 5, "6", 7, 0.5, "verified", "bb"), ("1", 1, "2", 2, 0.5, "verified", "aa"), ("3", 8, "9", 9, 0.4, "high", "cc")]
    found = spark.createDataFrame(rows, "source_dir string, source_index long, target_dir string, target_index long, similarity double, confidence string, hash string")
    monkeypatch.setattr(artifacts, "_candidates", lambda *_: found)
    assert {(r.already_accepted, r.kept): r.n for r in queries.QUERIES["links_file"](spark, str(tmp_path)).collect()} == {(True, True): 2, (True, False): 1, (False, False): 1}


def test_bills_in_several_files(spark, monkeypatch):
    """A bill of more provisions than a file takes has the same artifacts as one of a single file."""
    d = "/root/testdata/sf0.001"
    names = ["artifact_bills", "artifact_provisions", "artifact_sidecars", "artifact_summary", "subcommittee_files"]
    rows = lambda: [sorted(map(str, queries.QUERIES[n](spark, d).collect())) for n in names]
    monkeypatch.setattr(artifacts, "_ROOTS", {})
    whole = rows()
    monkeypatch.setattr(artifacts, "_ROOTS", {})
    monkeypatch.setattr(artifacts, "PART", 50)
    assert rows() == whole
    root = artifacts._written(spark, d, "extraction.json")
    parts = artifacts.sources.extractions(spark, root).select("bill_dir", F.size("provisions").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 50 and parts.count() > parts.select("bill_dir").distinct().count()


def test_heads_of_bills_are_made_without_sorting_what_they_list(spark, tmp_path):
    """A part is parsed once, and only its head is shuffled and sorted; lists are put together as texts."""
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1" / "extraction.json").write_text('{"bill":{"identifier":"H.R. 1"},"provisions":[]}')
    lines = artifacts.sources.heads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [k for k, x in enumerate(lines) if "FileScan text" in x]
    for k in scans:
        steps = [x.split("(")[0] for x in lines[max(i for i in range(k) if "Exchange hashpartitioning(bill_dir" in lines[i]) : k]]
        assert len(steps) > 2 and not any("Sort" in x for x in steps)
    assert len(scans) == 3 and sum(x.count("from_json(") for x in lines) == 3
    view = queries._view(spark, "/root/testdata/sf0.001").withColumn("part", F.lit(0))
    for made in (artifacts._extractions, artifacts._checked, artifacts._meta):
        plan = made(view, view)._jdf.queryExecution().optimizedPlan().toString()
        assert all("StructsToJson" in x[:250] for x in plan.split("collect_list(")[1:])


def test_artifacts_in_a_shared_folder_are_written_without_a_process_a_file(spark, tmp_path):
    """Hadoop would leave a checksum beside each file that it writes, and runs chmod for it; folders are called as by Spark."""
    rows = spark.createDataFrame([("a/b", 0, "x é"), ("a/b", 1, "y"), (None, 0, None), ("c", 0, "z")], "bill_dir string, part int, value string")
    artifacts.sinks.write_artifact(rows, f"file://{tmp_path}", "n.json.gz")
    artifacts.sinks.write_artifact(rows.where("part = 0").drop("part"), f"file://{tmp_path}", "n.txt")
    names = ["__HIVE_DEFAULT_PARTITION__/n.json.gz", "__HIVE_DEFAULT_PARTITION__/n.txt", "a%2Fb/n.json.gz", "a%2Fb/n.part-000001.json.gz", "a%2Fb/n.txt", "c/n.json.gz", "c/n.txt"]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == names
    assert (tmp_path / "a%2Fb" / "n.txt").read_bytes() == "x é\n".encode()
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").text(str(tmp_path), wholetext=True)
    assert sorted(r.value for r in read.collect()) == ["x é\n", "y\n", "z\n"]
    artifacts.sinks.write_artifact(rows, str(tmp_path / "other"), "n.json.gz")
    assert sorted(str(p.relative_to(tmp_path / "other")) for p in (tmp_path / "other").rglob("*.gz")) == [n for n in names if n.endswith(".gz")]


def test_a_bill_that_lacks_a_part_is_absent(spark, tmp_path):
    for folder, held in (("b1", [0, 1]), ("b2", [0])):
        (tmp_path / folder).mkdir()
        for k in held:
            (tmp_path / folder / artifacts.sinks.part_name("extraction.json", k)).write_text('{"bill":{"identifier":"H.R. 1"},"parts":2,"first_index":%d,"provisions":[{"provision_type":"rider"}]}' % k)
    found = artifacts.sources.heads(spark, str(tmp_path))
    assert [(r.bill_dir, r.n_provisions) for r in found.collect()] == [("b1", 2)]
    listed = artifacts.model.provisions(artifacts.sources.listed(spark, str(tmp_path), found)).select("bill_dir", "provision_index").collect()
    assert sorted(map(tuple, listed)) == [("b1", 0), ("b1", 1)]


def test_positions_follow_orders_over_ranges(spark, tmp_path):
    """The same numbers as one window a bill gives, with orders that share a key, lines without a part and many ranges."""
    from datetime import datetime

    t = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t([(0, "R")], "r_regionkey int, r_name string", "region")
    t([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    t([(1, "s", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "supplier")
    t([(1, "p", "b", "t", 1, 0.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    orders = [(k, datetime(1996 + k % 2, 1, 1), f"{k % 3}-P") for k in range(300)] + [(5, datetime(1997, 1, 1), "2-P")]
    t(orders, "o_orderkey long, o_orderdate timestamp, o_orderpriority string", "orders")
    lines = [(k, 1 if (k + n) % 5 else 9, 1, n, 1.0, float(n), 0.0, 0.0, "N", "O", datetime(1996, 1, 1)) for k in range(300) for n in range(1, 1 + k % 4)]
    t(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp", "lineitem")
    got = sorted((r.bill_dir, r.provision_index, r.line) for r in queries._view(spark, str(tmp_path)).collect())
    bills: dict = {}
    for k, day, priority in orders:
        bills.setdefault(f"{day.year}-{priority}", []).extend((x[0], x[3]) for x in lines if x[0] == k and x[1] == 1)
    assert got == sorted((b, i, n) for b, rows in bills.items() for i, (_, n) in enumerate(sorted(rows)))


def test_the_view_shuffles_lines_twice_and_no_names(spark, monkeypatch):
    """By part and by order; places come by broadcast, or by a shuffle of numbers where suppliers are many, with equal rows."""
    d, plans = "/root/testdata/sf0.001", []
    keep = bridge._kept
    monkeypatch.setattr(bridge, "_kept", lambda rows, root: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(rows, root))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = sorted(map(str, bridge._numbered(spark, d).collect()))
        moved = [x for x in plans[-1].splitlines() if "Exchange hashpartitioning(" in x]
        assert sum("l_partkey" in x or "l_suppkey" in x or "l_orderkey" in x for x in moved) == 2 and not any("n_name" in x for x in moved)
        monkeypatch.setattr(bridge, "BROADCAST_SEATS", 0)
        assert sorted(map(str, bridge._numbered(spark, d).collect())) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_view_shuffles_no_text_of_lines_and_counts_parts(spark, tmp_path, monkeypatch):
    """What is shuffled of a line is numbers; keys of parts that repeat or lack give the rows that the plain joins give."""
    d, plans = "/root/testdata/sf0.001", []
    part = spark.read.parquet(f"{d}/part.parquet")
    for name in ("region", "nation", "supplier", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{d}/{name}.parquet")
    keep = bridge._kept
    monkeypatch.setattr(bridge, "_kept", lambda rows, root: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(rows, root))
    bridge._numbered(spark, d)
    lines = plans[-1].splitlines()
    for k, x in enumerate(lines):
        if "Exchange hashpartitioning(l_orderkey" in x or "Exchange hashpartitioning(l_partkey" in x:
            assert "marks" in lines[k + 1] and "p_name" not in lines[k + 1] and "o_orderpriority" not in lines[k + 1]
    t = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    for odd in (part.where("p_partkey % 3 <> 1"), part.where("p_partkey % 3 <> 1").unionByName(part.where("p_partkey % 50 = 3").withColumn("p_size", F.lit(7)))):
        odd.write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(odd, F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        key = ["o_orderpriority", "l_linenumber", "p_size"]
        wanted = sorted(map(tuple, rows.groupBy(*key).agg(F.count("*").alias("n")).collect()))
        got = bridge._numbered(spark, str(tmp_path))
        assert sorted(map(tuple, got.groupBy(*key).agg(F.count("*").alias("n")).collect())) == wanted
        assert got.groupBy("fy", "o_orderpriority").agg(F.count_distinct("position").alias("n"), F.max("position").alias("m"), F.count("*").alias("c")).where("n <> c or m <> c - 1").isEmpty()


def test_support_is_brought_together_for_found_bills_alone(spark):
    """With the same rows; checks are joined with their bills before they are shuffled."""
    from ledgerlark.operators import search

    view = queries._view(spark, "/root/testdata/sf0.001")
    checks = spark.createDataFrame([("b", 1, 0, "verified"), ("b", 1, 1, "x"), ("b", 2, 0, None), ("c", 4, 0, "ambiguous")], "bill_dir string, provision_index long, ordinal int, status string")
    tiers = spark.createDataFrame([("b", 1, 0, "exact"), ("b", 1, 1, None), ("b", 3, 0, "exact")], "bill_dir string, provision_index long, ordinal int, match_tier string")
    assert sorted(map(tuple, search.evidence(checks, tiers).collect()), key=str) == [("b", 1, "found", None), ("b", 3, None, "exact"), ("c", 4, "found_multiple", None)]
    found = search.search(view, search.Criteria(provision_type="rescission", fiscal_year=1998), search.evidence(*bridge.checks(view)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and plan.index("max_by") < plan.index("Union") < plan.index("Join LeftSemi")
    mine = view.where("provision_type = 'rescission' and fy = 1998")
    assert found.count() == mine.count() and found.where("match_tier is not null").count() == mine.where("tier is not null").count()


def test_texts_of_bills_are_made_without_sorting_provisions(spark):
    _, marked = artifacts._bill_texts(queries._view(spark, "/root/testdata/sf0.001"))
    steps = [x for x in marked._jdf.queryExecution().executedPlan().toString().splitlines() if x.strip()]
    assert "FileScan parquet" in steps[-1] and not any("Sort" in x for x in steps[-4:])  # up to the first shuffle


def test_suggestions_read_the_view_once(spark):
    """Accounts and agencies are kept, and neither suggestions nor their clusters read the view again."""
    from ledgerlark.operators import entities

    view = spark.range(8).selectExpr("'appropriation' as provision_type", "'new_budget_authority' as semantics", "'' as detail_level", "'fund ' || (id % 2) as account_name", "'Agency ' || (id div 4) as agency", "array(cast(2000 + id div 4 as int)) as fiscal_years", "id as dollars").hint("rebalance")
    found = entities.suggest(view)
    done = entities.clusters(view, found)
    for rows in (found, done):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan and "Relation" in plan
    assert [(r.canonical, r.member, r.orphan_pairs_resolved) for r in found.collect()] == [("Agency 0", "Agency 1", 2)]
    assert [(r.provisions, r.agencies) for r in done.collect()] == [(8, ["Agency 0", "Agency 1"])]


def test_short_sources_are_searched_without_an_index(spark, monkeypatch):
    """With the same results as by the index; bills share a task's calls instead of each being a group."""
    from ledgerlark.operators import repair

    text = "SEC. 1. For pay — “and” rent,  available until spent.\nSEC. 2. For ünïts  of 12,345 and more, until the end of the year.\n" * 2
    raws = [text[a : a + n] for a in range(0, 90, 7) for n in (3, 14, 15, 40, 120)]
    raws += [r + " zz" for r in raws] + ["zzzz" + r for r in raws] + [r.replace(" ", "  ") for r in raws] + [r[::-1] for r in raws]
    short = [repair.locate(r.encode(), repair.Source(text.encode())) for r in raws]
    monkeypatch.setattr(repair, "SHORT", 0)
    assert short == [repair.locate(r.encode(), repair.Source(text.encode())) for r in raws] and len({t for t, *_ in short}) == 5
    claims = spark.createDataFrame([("a", 1, text[:50]), ("b", 2, None), (None, 3, text[:50])], "bill_dir string, provision_index long, raw_text string")
    done = repair.repaired(claims, spark.createDataFrame([("a", text), (None, text)], "bill_dir string, source string"))
    assert sorted((r.provision_index, r.match_tier, r.start) for r in done.collect()) == [(1, "exact", 0), (2, "exact", None), (3, "exact", 0)]
    assert "CoGroup" not in done._jdf.queryExecution().toString()


def test_answers_are_read_by_places_and_only_for_their_type(spark):
    """Texts are told from other values without inferring the schema of either; amounts that a type lacks aren't read."""
    from ledgerlark.operators import lenient

    one = '{"provision_type":"%s","account_name":%s,"confidence":"0.5","amount":{"dollars":"$1,2"},"old_amount":{"dollars":"7"}}'
    told = [one % x for x in (("appropriation", "1000.0"), ("appropriation", "null"), ("cr_substitution", "{}"), ("x", "true"))]
    rows = lenient.provisions(spark.createDataFrame([("k", '{"provisions":[%s,3]}' % ",".join(told))], "id string, answer string"), "id", "answer", chunks=True)
    plan = rows.select("id", "account_name", "type_coercions", "null_to_default")._jdf.queryExecution().optimizedPlan().toString()
    assert "map<string,struct" not in plan and plan.lower().count("schema_of_variant") + plan.count("schemaOfVariant") < 6
    found = [(r.account_name, r.type_coercions, r.null_to_default, r.failed) for r in rows.orderBy("ord").collect()]
    assert found == [("1000", 3, 1, False), ("", 2, 2, False), (None, 2, 2, False), (None, 2, 1, False), (None, 0, 0, True)]


def test_parts_are_parsed_once_for_bills_and_provisions(spark, tmp_path, monkeypatch):
    """What is kept is small columns; neither bills nor provisions read the JSON of extractions again, and no row carries its part's list."""
    from ledgerlark.sources import shared

    d, plans = "/root/testdata/sf0.001", []
    keep = shared.kept
    monkeypatch.setattr(shared, "kept", lambda rows, name: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or keep(rows, name))
    for name in ("artifact_provisions", "artifact_summary", "subcommittee_files"):
        for held in ("_ROOTS", "_READ", "_HEADS"):
            monkeypatch.setattr(artifacts, held, {})
        plans.clear()
        plans.append(queries.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString())
        assert sum(p.count("raw_text,StringType") > 0 for p in plans) == 1, name  # the schema of extractions
    read = artifacts.sources.extracted(spark, artifacts._written(spark, d, "extraction.json"))
    listing = next(x for x in read._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode(provisions" in x)
    assert ", [], true, [pos" not in listing  # the list is dropped where rows are made of it
    (tmp_path / "b1").mkdir()
    for k, listed in ((0, "[]"), (1, '[{"provision_type":"rider"},null]')):
        (tmp_path / "b1" / artifacts.sinks.part_name("extraction.json", k)).write_text('{"bill":{"identifier":"H.R. 1"},"parts":2,"first_index":%d,"provisions":%s}' % (4 * k, listed))
    rows = keep(artifacts.sources.extracted(spark, str(tmp_path)).select("bill_dir", "head", *artifacts.model.fields()), "x")
    bills = artifacts.sources.heads(spark, str(tmp_path), rows)
    plain = artifacts.sources.heads(spark, str(tmp_path))
    assert [r.n_provisions for r in bills.collect()] == [2] and sorted(map(str, bills.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    whole = artifacts.model.provisions(artifacts.sources.listed(spark, str(tmp_path), plain))
    assert sorted(map(str, artifacts.sources.of_bills(rows, bills).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_answers_are_parsed_once_and_told_apart_without_copies(spark):
    """Also for what an answer says of its bill; objects, lists and texts are told as the shape of all that is inside would tell them."""
    from ledgerlark.operators import lenient

    plan = queries.QUERIES["lenient_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan and "map<string,variant>" not in plan
    told = ["{}", '{"__":1,"a":[1]}', "[]", '["a",null,1,{"b":2},["c"],"é",""]', '"t"', "1", "1.5", "true", "null"]
    rows = spark.createDataFrame([(t,) for t in told], "t string").select(F.try_parse_json("t").alias("v"))
    shape = F.schema_of_variant("v")
    found = rows.select(lenient._object(F.col("v")) == shape.startswith("OBJECT"), lenient._array(F.col("v")) == shape.startswith("ARRAY"), lenient.strings(F.col("v"))).collect()
    assert all(a and b for a, b, _ in found) and [x for *_, x in found] == [[], [], [], ["a", "é", ""], [], [], [], [], []]


def test_repaired_tiers_shuffle_lines_once(spark, monkeypatch):
    """And as numbers; claims aren't shuffled to be dealt, nor what was repaired to get its holds, which are those of ``span_holds``."""
    from ledgerlark.operators import repair

    plans, keep = [], bridge._kept
    monkeypatch.setattr(bridge, "_kept", lambda rows, root: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(rows, root))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.append(queries.QUERIES["repaired_tiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [p.count("Exchange hashpartitioning(") for p in plans] == [1, 7] and "Window" not in "".join(plans)
    many = spark.createDataFrame([(b, i, "é two"[: 2 + i % 4]) for b in ("a", None) for i in range(20)], "bill_dir string, provision_index long, raw_text string")
    held = spark.createDataFrame([("a", "one é two" * 3), (None, "é tw")], "bill_dir string, source string")
    assert sorted(map(str, repair.repaired(many, held, claims_per_task=3).collect())) == sorted(map(str, repair.repaired(many, held).collect()))
    docs = spark.createDataFrame([("a", "one é two"), ("b", None), (None, "x")], "bill_dir string, source string")
    rows = spark.createDataFrame([("a", 1, 4, 6, "é"), ("a", 2, 4, 6, "e"), ("a", 3, None, None, "z"), ("b", 4, 0, 1, "x"), (None, 5, 0, 1, "x"), ("c", 6, 0, 1, "x")], "bill_dir string, provision_index long, start long, end long, text string")
    plain = rows.join(repair.span_holds(rows, docs), ["bill_dir", "provision_index"], "left")
    assert sorted(map(str, repair.with_holds(rows, docs).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
