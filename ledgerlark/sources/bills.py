"""Readers of bill directories: one DataFrame per artifact, keyed by ``bill_dir`` (OP-SRC-01 to 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def directory(path: Column | None = None) -> Column:
    """The name of the folder that a file lies in."""
    return F.element_at(F.split(path if path is not None else F.col("_metadata.file_path"), "/"), -2)


def artifact(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """OP-SRC-02/07/08: all files of a name below ``root``, packed ones and further parts (``sinks.write_artifact``) too;
    files that don't parse are left out, as if absent."""
    stem, _, suffix = name.partition(".")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{stem}{{,.part-*}}.{suffix}{{,.gz}}").text(root, wholetext=True)
    # parsed by an expression, as the JSON source can't tell broken files where few columns are read; a list of one is
    # exploded, as a filter on a plain column would parse each file once more
    parsed = files.select(directory().alias("bill_dir"), F.explode(F.array(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))).alias("j"))
    return parsed.where("j is not null and j._corrupt is null").select("j.*", "bill_dir").drop("_corrupt")


def _parts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of ``artifact`` a file. Each part repeats the bill's heads, holds a stretch of its lists, and says how many ``parts`` there are."""
    return artifact(spark, root, name, f"{schema}, parts int").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _head(parts: DataFrame, *columns: Column) -> DataFrame:
    """A row per bill of which all parts were read: what every part repeats. Only what is in ``parts`` is shuffled and then
    sorted by bill; without that shuffle, tasks would sort whole parts with all they list."""
    return parts.repartition("bill_dir").groupBy("bill_dir").agg(*columns, F.count("*").alias("__n"), F.max("parts").alias("__parts")).where("__n = __parts").drop("__n", "__parts")


def extractions(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-01: one row per ``extraction.json``, or per part of one, whose provisions count from ``first_index``."""
    found = _parts(spark, root, "extraction.json", f"{schemas.EXTRACTION}, first_index bigint").where("bill is not null and provisions is not null")
    return found.withColumn("first_index", F.coalesce("first_index", F.lit(0)))


def verifications(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-07: (bill_dir, verification), a row a file: what ``model.checks`` reads."""
    return _parts(spark, root, "verification.json", schemas.VERIFICATION).select("bill_dir", "parts", F.struct("amount_checks", "raw_text_checks", "completeness", F.col("summary").alias("counts")).alias("verification"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-07: (bill_dir, meta), a row a file: what ``model.timings`` and ``model.jurisdictions`` read."""
    return _parts(spark, root, "bill_meta.json", schemas.BILL_META).select("bill_dir", "parts", F.struct("congress", "bill_nature", "subcommittees", "provision_timing", "canonical_accounts", "extraction_sha256", F.col("fiscal_years").alias("meta_fiscal_years")).alias("meta"))


def _joined(found: DataFrame, meta: DataFrame, checks: DataFrame) -> DataFrame:
    joined = found.join(meta, "bill_dir", "left").join(checks, "bill_dir", "left")
    congress = F.coalesce("meta.congress", F.split("bill_dir", "-").getItem(0).try_cast("int"))  # OP-PRJ-12
    return joined.withColumn("congress", congress).orderBy("identifier", "bill_dir")


def extracted(spark: SparkSession, root: str) -> DataFrame:
    """A row a provision (``provision_index``, ``p``) of all ``extractions``, to be kept where both bills and provisions are asked
    for, as a part is then parsed once. A part's ``head`` stands on its first row; a part that lists none is a row without an index."""
    head = F.struct("parts", "schema_version", "bill", "summary")  # not of the list, which each row would carry
    rows = extractions(spark, root).select("bill_dir", head.alias("head"), "first_index", F.posexplode_outer("provisions").alias("pos", "p"))
    return rows.select("bill_dir", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("head")).alias("head"), (F.col("first_index") + F.col("pos")).alias("provision_index"), "p")


def heads(spark: SparkSession, root: str, rows: DataFrame | None = None) -> DataFrame:
    """OP-SRC-01/SORT-01: bills with the heads of their optional sidecars, by identifier. What a bill lists (its provisions,
    checks and timings) is only counted here and never in one row; ``listed``, ``verifications`` and ``metadata`` read it by parts.
    ``rows``: what ``extracted`` read, if it was kept."""
    columns = [F.first(c).alias(c) for c in ("schema_version", "bill", "summary")]
    if rows is None:
        parts = extractions(spark, root).select("bill_dir", "parts", "schema_version", "bill", F.size("provisions").alias("n"), "summary")
        found = _head(parts, *columns, F.sum("n").cast("int").alias("n_provisions"))
    else:
        counted = rows.groupBy("bill_dir").agg(F.count("provision_index").cast("int").alias("n_provisions"))
        found = _head(rows.where("head is not null").select("bill_dir", "head.*"), *columns).join(counted, "bill_dir")
    about = F.struct("meta.congress", "meta.bill_nature", "meta.extraction_sha256", "meta.meta_fiscal_years").alias("meta")
    meta = _head(metadata(spark, root).select("bill_dir", "parts", about), F.first("meta").alias("meta"))
    counts = F.struct("verification.completeness", "verification.counts").alias("verification")
    checks = _head(verifications(spark, root).select("bill_dir", "parts", counts), F.first("verification").alias("verification"))
    return _joined(found.select("bill_dir", "schema_version", "bill.*", "n_provisions", "summary"), meta, checks)


def bills(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-01/SORT-01: bills that fit a row, with all they list and their optional sidecars, by identifier. For bills in
    several parts see ``heads``."""
    alone = lambda rows: rows.where("parts = 1").drop("parts")
    found = alone(extractions(spark, root)).select("bill_dir", "schema_version", "bill.*", "provisions", "summary", "chunk_map")
    return _joined(found, alone(metadata(spark, root)), alone(verifications(spark, root)))


def listed(spark: SparkSession, root: str, of: DataFrame) -> DataFrame:
    """What ``model.provisions`` reads: (identifier, classification, fiscal_years, provisions, first_index) a file, with the
    congress, of the bills in ``of``. A bill is one short row, so ``of`` is broadcast rather than files shuffled."""
    found = extractions(spark, root).select("bill_dir", "bill.identifier", "bill.classification", "bill.fiscal_years", "provisions", "first_index")
    return found.join(F.broadcast(of.select("bill_dir", "congress")), "bill_dir")


def of_bills(rows: DataFrame, of: DataFrame) -> DataFrame:
    """As ``model.provisions`` of ``listed``, from rows of ``extracted`` with the accessor columns."""
    about = of.select("bill_dir", "identifier", "congress", "classification", "fiscal_years")
    return rows.where("provision_index is not null").drop("head").join(F.broadcast(about), "bill_dir")


def sources(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-03/04/05: bill texts to read: XML before plain text of the same stem; with an enrolled version only that."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "BILLS-*.{xml,txt}").load(root).select("path", "length")
    named = files.select("path", directory(F.col("path")).alias("bill_dir"), F.regexp_extract("path", r"([^/]+)\.(?:xml|txt)$", 1).alias("stem"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"))
    best = named.groupBy("bill_dir", "stem").agg(F.max_by("path", F.struct((F.col("kind") == "xml").alias("x"), "path")).alias("path"), F.max("kind").alias("kind"))
    enrolled = F.endswith("stem", F.lit("enr"))
    per = best.groupBy("bill_dir").agg(F.bool_or(enrolled).alias("any_enrolled"))
    return best.join(per, "bill_dir").where(~F.col("any_enrolled") | enrolled).drop("any_enrolled")


def source_text(spark: SparkSession, root: str) -> DataFrame:
    """OP-TXT-10: the first ``BILLS-*.txt`` of each directory as one text."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "BILLS-*.txt").text(root, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), directory().alias("bill_dir"))
    return texts.groupBy("bill_dir").agg(F.min_by("value", "file").alias("source"), F.min("file").alias("file"))


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-06: little-endian float files with their JSON heads: (bill_dir, provision_index, vec, model).

    Directories whose file length isn't count * dimensions * 4 are left out.
    """
    heads = artifact(spark, root, "embeddings.json", schemas.EMBEDDINGS)
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "vectors.bin").load(root).select(directory(F.col("path")).alias("bill_dir"), "content", "length")
    both = heads.join(blobs, "bill_dir").where("length = count * dimensions * 4").select("bill_dir", "model", "dimensions", "content")

    def cut(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                rows = np.frombuffer(r["content"], "<f4").reshape(-1, r["dimensions"])
                yield pa.RecordBatch.from_arrays([pa.array([r["bill_dir"]] * len(rows)), pa.array([r["model"]] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(list(rows), pa.list_(pa.float32()))], names=["bill_dir", "model", "provision_index", "vec"])

    return both.mapInArrow(cut, "bill_dir string, model string, provision_index long, vec array<float>")




def _one(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tas_mappings(spark: SparkSession, root: str) -> DataFrame:
    """OP-SRC-08: the account codes of provisions from the bills' ``tas_mapping.json``, where there is one; the folder names the bill."""
    return artifact(spark, root, "tas_mapping.json", schemas.TAS_MAPPING.removeprefix("bill_dir string, ")).select("bill_dir", "bill_identifier", F.inline("mappings"))


def fas_reference(spark: SparkSession, path: str) -> DataFrame:
    """OP-SRC-09: accounts, active ones first, with their ``status``."""
    file = _one(spark, path, schemas.FAS_REFERENCE)
    side = lambda c, s: file.select(F.inline(c)).withColumn("status", F.lit(s))
    return side("accounts", "active").unionByName(side("discontinued", "discontinued"))


def authorities(spark: SparkSession, path: str) -> DataFrame:
    """OP-SRC-10."""
    return _one(spark, path, schemas.AUTHORITIES).select(F.inline("authorities"))


def rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OP-SRC-11: agency members and account aliases with their canonical names and the order of their groups."""
    file = _one(spark, path, schemas.DATASET)
    groups = file.select(F.posexplode("entities.agency_groups").alias("ord", "g")).select("ord", "g.canonical", F.explode(F.array_union(F.array("g.canonical"), F.coalesce("g.members", F.array().cast("array<string>")))).alias("member"))
    aliases = file.select(F.posexplode("entities.account_aliases").alias("ord", "g")).select("ord", "g.canonical", F.explode("g.aliases").alias("alias"))
    return groups, aliases


def links(spark: SparkSession, path: str) -> DataFrame:
    """OP-SRC-12: accepted links."""
    return _one(spark, path, schemas.LINKS).select(F.posexplode("accepted").alias("ord", "l")).select("ord", "l.*")


def cpi(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OP-SRC-13: (ym, value) by month, and (fy, value, months) annual averages for years without enough months."""
    file = _one(spark, path, schemas.CPI)
    monthly = file.select(F.explode("monthly").alias("ym", "value"))
    annual = file.select(F.explode("annual_averages").alias("y", "value"), "partial_years").select(F.col("y").cast("int").alias("fy"), "value", F.coalesce(F.element_at("partial_years", F.col("y"))["months"], F.lit(12)).alias("months"))
    return monthly, annual
