"""Links between provisions of different bills by vector similarity (OP-LNK-*, OP-JOIN-09 to 11, OP-REL-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import link_hash
from ..functions.vectors import dot

VERIFIED_FLOOR, HIGH, UNCERTAIN = 0.50, 0.65, 0.55


def confidence(similarity: Column, same_name: Column, same_agency: Column, high: float = HIGH, uncertain: float = UNCERTAIN) -> Column:
    """OP-LNK-01: verified, high, uncertain, or null below the last; a like name needs no more than the caller's floor (T-14)."""
    return F.when(same_name, "verified").when((similarity >= high) & same_agency, "high").when(similarity >= uncertain, "uncertain")


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Rows in blocks of about ``block`` vectors, for all-pairs products block by block."""
    n = max(1, -(-rows.count() // block))
    return rows.withColumn("blk", F.pmod(F.xxhash64("bill_dir", "provision_index"), F.lit(n)).cast("int")), n


def similar_pairs(vectors: DataFrame, floor: float, *, block: int = 2048) -> DataFrame:
    """OP-JOIN-09: pairs of different bills with a dot product of ``floor`` or more: (a_dir, a_index, b_dir, b_index, similarity).

    Exact: every pair of blocks is one matrix product in a task, so tasks stay of one size and their number grows with
    the square of the blocks; single precision proposes with a margin and double precision decides.
    """
    rows, n = _blocks(vectors.select("bill_dir", "provision_index", "vec"), block)
    whole = rows.groupBy("blk").agg(F.collect_list(F.struct("bill_dir", "provision_index", "vec")).alias("rows"))
    pairs = whole.sparkSession.range(n * n, numPartitions=max(1, min(n * (n + 1) // 2, 2000))).select(F.floor(F.col("id") / n).cast("int").alias("x"), (F.col("id") % n).cast("int").alias("y")).where("x <= y")
    both = pairs.join(whole.select(F.col("blk").alias("x"), F.col("rows").alias("a")), "x").join(whole.select(F.col("blk").alias("y"), F.col("rows").alias("b")), "y")

    def product(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                x, y = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                sides = []
                for c in (2, 3):
                    flat = part.column(c).flatten()
                    vecs = flat.field("vec")
                    m = np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(vecs), -1)
                    sides.append((np.array(flat.field("bill_dir").to_pylist(), dtype=object), np.asarray(flat.field("provision_index")), m))
                (ad, ai, am), (bd, bi, bm) = sides
                i, j = np.nonzero(am.astype(np.float32) @ bm.astype(np.float32).T >= floor - 1e-4)
                keep = ad[i] != bd[j]
                if x == y:
                    keep &= i < j
                i, j = i[keep], j[keep]
                s = np.einsum("ij,ij->i", am[i], bm[j])
                i, j, s = i[s >= floor], j[s >= floor], s[s >= floor]
                yield pa.RecordBatch.from_arrays([pa.array(ad[i], pa.string()), pa.array(ai[i], pa.int64()), pa.array(bd[j], pa.string()), pa.array(bi[j], pa.int64()), pa.array(s, pa.float64())], names=["a_dir", "a_index", "b_dir", "b_index", "similarity"])

    return both.select("x", "y", "a", "b").mapInArrow(product, "a_dir string, a_index long, b_dir string, b_index long, similarity double")


def suggest(pairs: DataFrame, about: DataFrame, model: str, *, scope: str = "all", high: float = HIGH, uncertain: float = UNCERTAIN) -> DataFrame:
    """OP-LNK-01/SORT-06: candidates with hash and confidence from ``similar_pairs``.

    ``about``: (bill_dir, provision_index, ord, canonical_name, norm_agency, fiscal_years). The source is the end whose
    bill comes first by ``ord`` (T-13). Scope *intra* wants shared fiscal years, *cross* none (OP-JOIN-10).
    """
    side = lambda s: about.select(F.col("bill_dir").alias(f"{s}_dir"), F.col("provision_index").alias(f"{s}_index"), F.struct("ord", "canonical_name", "norm_agency", "fiscal_years").alias(s))
    rows = pairs.join(side("a"), ["a_dir", "a_index"]).join(side("b"), ["b_dir", "b_index"])
    shared = F.arrays_overlap("a.fiscal_years", "b.fiscal_years")
    rows = rows if scope == "all" else rows.where(shared if scope == "intra" else ~shared)
    first = F.struct("a.ord", "a_dir", "a_index") < F.struct("b.ord", "b_dir", "b_index")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    same_name = (F.col("a.canonical_name") != "") & (F.col("a.canonical_name") == F.col("b.canonical_name"))
    tier = confidence(F.col("similarity"), same_name, F.col("a.norm_agency") == F.col("b.norm_agency"), high, uncertain)
    out = rows.select(pick("a_dir", "b_dir").alias("source_dir"), pick("a_index", "b_index").alias("source_index"), pick("b_dir", "a_dir").alias("target_dir"), pick("b_index", "a_index").alias("target_index"), "similarity", tier.alias("confidence")).where("confidence is not null")
    return out.withColumn("hash", link_hash(F.col("source_dir"), F.col("source_index"), F.col("target_dir"), F.col("target_index"), model))


def with_accepted(candidates: DataFrame, accepted: DataFrame, flag: str = "already_accepted") -> DataFrame:
    """OP-JOIN-15: a flag per candidate. Hashes are short, so links may share one; each candidate stays one row."""
    return candidates.join(accepted.select("hash").distinct().withColumn(flag, F.lit(True)), "hash", "left").fillna(False, [flag])


def accept(accepted: DataFrame, candidates: DataFrame, hashes: list[str] | None = None, *, auto: bool = False, note: str | None = None) -> DataFrame:
    """OP-LNK-02: accepted links and the new ones: those named, or with ``auto`` all verified and high ones."""
    chosen = F.lit(False)
    if hashes:
        chosen = chosen | F.col("hash").isin(*hashes)
    if auto:
        chosen = chosen | F.col("confidence").isin("verified", "high")
    new = candidates.where(chosen).join(accepted.select("hash"), "hash", "left_anti")
    evidence = F.when(F.col("confidence") == "verified", "name_match").when(F.col("confidence") == "high", "high_similarity").otherwise("manual")
    relation = F.when(F.col("confidence").isin("verified", "high"), "same_account").otherwise("related")
    made = new.select("hash", "source_dir", "source_index", "target_dir", "target_index", F.col("similarity").cast("float").alias("similarity"), relation.alias("relationship"), evidence.alias("evidence"), F.lit(note).cast("string").alias("note"))
    return accepted.select(*made.columns).unionByName(made)


def removed(accepted: DataFrame, hashes: list[str]) -> DataFrame:
    """OP-LNK-03."""
    return accepted.where(~F.col("hash").isin(*hashes))


def of_bill(accepted: DataFrame, bill: str) -> DataFrame:
    """OP-FLT-15: links with an end in a directory whose name contains ``bill``."""
    return accepted.where(F.contains("source_dir", F.lit(bill)) | F.contains("target_dir", F.lit(bill)))


def related(vectors: DataFrame, about: DataFrame, source_dir: str, source_index: int, *, top: int = 10, floor: float = VERIFIED_FLOOR, high: float = HIGH, uncertain: float = UNCERTAIN) -> DataFrame:
    """OP-REL-01/JOIN-11/WIN-01: per tier (same_account, related) the ``top`` provisions of other bills like the source.

    ``about`` as for ``suggest``. Errors: an unknown source has no vector.
    """
    me = vectors.join(about, ["bill_dir", "provision_index"]).where((F.col("bill_dir") == source_dir) & (F.col("provision_index") == source_index)).first()
    if me is None:
        raise ValueError(f"no provision {source_dir}:{source_index} with a vector")
    scored = vectors.where(F.col("bill_dir") != source_dir).select("bill_dir", "provision_index", dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in me.vec])).alias("similarity")).where(F.col("similarity") >= floor)
    rows = scored.join(about, ["bill_dir", "provision_index"])
    same_name = F.lit(me.canonical_name != "") & (F.col("canonical_name") == me.canonical_name)
    rows = rows.withColumn("confidence", confidence(F.col("similarity"), same_name, F.col("norm_agency") == me.norm_agency, high, uncertain)).where("confidence is not null")
    rows = rows.withColumn("tier", F.when(F.col("confidence") == "uncertain", "related").otherwise("same_account"))
    order = Window.partitionBy("tier").orderBy(F.desc("similarity"), "bill_dir", "provision_index")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def timeline(rows: DataFrame) -> DataFrame:
    """OP-AGG-13: from (fiscal_years, dollars, timing, identifier) of the source and its same-account matches, per year."""
    years = rows.where("dollars is not null").select(F.explode("fiscal_years").alias("fy"), "dollars", F.coalesce("timing", F.lit("current_year")).alias("timing"), "identifier")
    part = lambda c: F.sum(F.when(c, F.col("dollars")).otherwise(0))
    return years.groupBy("fy").agg(part(~F.col("timing").isin("advance", "supplemental")).alias("current_year_ba"), part(F.col("timing") == "advance").alias("advance_ba"), part(F.col("timing") == "supplemental").alias("supplemental_ba"), F.array_sort(F.collect_set("identifier")).alias("source_bills"))


def exemplars(labelled: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """OP-RES-05: from (bill_dir, provision_index, label) per label at most ``most`` provisions of its first bill, evenly
    spaced by index, and all provisions of its second bill to test them on. Labels of one bill are left out."""
    bills = labelled.select("label", "bill_dir").distinct()
    nth = bills.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("bill_dir"))).where("nth <= 2")
    both = nth.groupBy("label").agg(F.max("nth").alias("n")).where("n = 2").select("label")
    rows = labelled.join(nth.join(both, "label"), ["label", "bill_dir"])
    first = rows.where("nth = 1").withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("provision_index")) - 1).withColumn("all", F.count("*").over(Window.partitionBy("label")))
    step = F.greatest(F.floor(F.col("all") / F.least("all", F.lit(most))), F.lit(1))
    chosen = first.where((F.col("i") % step == 0) & (F.col("i") / step < most))
    return chosen.select("bill_dir", "provision_index", "label"), rows.where("nth = 2").select("bill_dir", "provision_index", "label")


def centroids(vectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """OP-VEC-04/RES-05: per label the mean of its exemplars' vectors, scaled to length one. ``labelled``: (bill_dir, provision_index, label)."""
    parts = vectors.join(labelled, ["bill_dir", "provision_index"]).select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    from ..functions.vectors import unit

    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m")).select("label", unit(F.col("m")).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """OP-RES-05: each vector's best label; centroids are one per class and stay few."""
    rows = vectors.join(F.broadcast(centres), F.lit(True))
    return rows.groupBy("bill_dir", "provision_index").agg(F.max_by("label", F.struct(dot(F.col("vec"), F.col("centroid")), F.col("label"))).alias("label"))
