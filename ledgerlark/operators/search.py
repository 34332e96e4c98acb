"""Search over provisions, with how well each is supported by its source."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quality
from ..functions.vectors import dot


@dataclass(frozen=True)
class Criteria:
    """OP-FLT-01 to 07: all that are given must hold; none keeps every row."""

    provision_type: str | None = None
    agency: str | None = None
    account: str | None = None
    keyword: str | None = None
    bill: str | None = None
    division: str | None = None
    min_dollars: int | None = None
    max_dollars: int | None = None
    fiscal_year: int | None = None

    def apply(self, view: DataFrame) -> DataFrame:
        if self.provision_type is not None:
            view = view.where(F.col("provision_type") == self.provision_type)
        for column, wanted in (("agency", self.agency), ("account_name", self.account), ("raw_text", self.keyword), ("identifier", self.bill)):
            if wanted is not None:
                view = view.where(F.contains(F.lower(column), F.lit(wanted.lower())))
        if self.division is not None:
            view = view.where(F.upper("division") == self.division.upper())
        if self.min_dollars is not None:
            view = view.where(F.abs("dollars") >= self.min_dollars)
        if self.max_dollars is not None:
            view = view.where(F.abs("dollars") <= self.max_dollars)
        if self.fiscal_year is not None:
            view = view.where(F.array_contains("fiscal_years", self.fiscal_year))
        return view


def evidence(amount_checks: DataFrame, text_checks: DataFrame) -> DataFrame:
    """OP-JOIN-01: amount_status and match_tier of each checked provision; of several checks the last holds."""
    found = F.when(F.col("status") == "verified", "found").when(F.col("status") == "ambiguous", "found_multiple").when(F.col("status") == "not_found", "not_found")
    key, none = ["bill_dir", "provision_index"], F.lit(None)
    amounts = amount_checks.select(*key, found.alias("s"), F.col("ordinal").alias("a"), none.cast("string").alias("match_tier"), none.cast("int").alias("t")).where("s is not null")
    texts = text_checks.select(*key, none.cast("string").alias("s"), none.cast("int").alias("a"), "match_tier", F.col("ordinal").alias("t"))
    return amounts.unionByName(texts).groupBy(*key).agg(F.max_by("s", "a").alias("amount_status"), F.max_by("match_tier", "t").alias("match_tier"))


def search(view: DataFrame, criteria: Criteria, supported: DataFrame) -> DataFrame:
    """OP-SRCH-01: matching provisions with amount_status, match_tier and quality. Where the criteria choose bills, the support
    of no other bill is brought together."""
    rows = criteria.apply(view).drop("amount_status", "match_tier")
    if criteria.bill is not None or criteria.fiscal_year is not None:
        supported = supported.join(F.broadcast(rows.select("bill_dir").distinct()), "bill_dir", "left_semi")
    joined = rows.join(supported, ["bill_dir", "provision_index"], "left")
    return joined.withColumn("quality", quality(F.col("amount_status"), F.col("match_tier")))


def in_subcommittee(view: DataFrame, jurisdictions: DataFrame, slug: str) -> DataFrame:
    """OP-FLT-08/09: provisions of divisions of a jurisdiction (kebab or snake case); indices stay as they are."""
    wanted = jurisdictions.where(F.col("jurisdiction") == jurisdiction_of(slug)).select("bill_dir", F.upper("division").alias("__d")).distinct()
    return view.join(F.broadcast(wanted), (view.bill_dir == wanted.bill_dir) & (F.upper(view.division) == F.col("__d")), "left_semi")


def without_metadata(bills: DataFrame) -> DataFrame:
    """OP-FLT-08: bills that a subcommittee can't be looked up in, with the reason."""
    reason = F.concat("identifier", F.lit(": --subcommittee requires bill metadata; enrich the folder first"))
    return bills.where("meta is null").select("bill_dir", "identifier", reason.alias("error"))


def of_subcommittee(view: DataFrame, bills: DataFrame, jurisdictions: DataFrame, slug: str) -> DataFrame:
    """OP-FLT-08, as summaries and comparisons want it: an error names a bill without metadata."""
    lacking = without_metadata(bills).orderBy("bill_dir").first()
    if lacking is not None:
        raise ValueError(lacking.error)
    return in_subcommittee(view, jurisdictions, slug)


def jurisdiction_of(slug: str) -> str:
    """OP-CLS-05: a slug's stored name."""
    name = slug.lower().replace("-", "_")
    return "milcon_va" if name == "milconva" else name


def similar(vectors: DataFrame, query: list[float], view: DataFrame, top: int, criteria: Criteria | None = None, exclude: tuple[str, int] | None = None) -> DataFrame:
    """OP-SRCH-02/SORT-04/05: the ``top`` provisions by similarity to a vector, filtered first, rounded to 3 places."""
    rows = criteria.apply(view) if criteria else view
    if exclude:
        rows = rows.where(~((F.col("bill_dir") == exclude[0]) & (F.col("provision_index") == exclude[1])))
    scored = rows.join(vectors, ["bill_dir", "provision_index"]).withColumn("__s", dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])))
    best = scored.orderBy(F.desc("__s"), "bill_dir", "provision_index").limit(top)
    return best.withColumn("similarity", F.round("__s", 3)).drop("__s", "vec")


def similar_many(vectors: DataFrame, searches: DataFrame, top: int, block_bytes: int = 32_000_000) -> DataFrame:
    """OP-SORT-04/05 for many vectors at once: source_dir, source_index, rank, bill_dir, provision_index, similarity.

    ``searches`` (source_dir, source_index, vec) go to the tasks in blocks of at most ``block_bytes``; a task multiplies
    its rows of ``vectors`` (bill_dir, provision_index, vec) by a block and keeps the ``top`` of each search, which a window
    then merges. A vector doesn't find itself. Similarities count to 9 places, equal ones by key; null vectors and those of
    another length than the block's first find nothing and aren't found.
    """
    known = searches.where("vec is not null").select("source_dir", "source_index", F.col("vec").cast("array<double>").alias("vec"))
    held = known.agg(F.sum(F.size("vec") * 8 + 64)).first()[0] or 0
    blocks = max(1, math.ceil(held / block_bytes))
    parts = [_nearest(vectors, known.where(F.pmod(F.xxhash64("source_dir", "source_index"), F.lit(blocks)) == k).collect(), top) for k in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("source_dir", "source_index").orderBy(F.desc("similarity"), "bill_dir", "provision_index")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("source_dir", "source_index", "rank", "bill_dir", "provision_index", "similarity")


def _nearest(vectors: DataFrame, block: list, top: int) -> DataFrame:
    """The best of each partition for a block of searches."""
    dims = len(block[0].vec) if block else 0
    block = [r for r in block if len(r.vec) == dims]
    sent = vectors.sparkSession.sparkContext.broadcast(([(r.source_dir, r.source_index) for r in block], np.array([r.vec for r in block]).reshape(len(block), dims)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, x = sent.value
        best: list[list[tuple]] = [[] for _ in sources]  # (-similarity, bill_dir, provision_index), in order
        least = np.full(len(sources), -np.inf)
        step = max(1, 8_000_000 // max(len(sources), 1))  # scores at a time
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                scores = np.round(x @ np.array(part.column(2).to_pylist()).reshape(len(keys), dims).T, 9)
                for i in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                    new = [(-scores[i, j], *keys[j]) for j in np.flatnonzero(scores[i] >= least[i]) if keys[j] != sources[i]]
                    best[i] = sorted(best[i] + new)[:top]
                    if len(best[i]) == top:
                        least[i] = -best[i][-1][0]
        rows = [(*source, d, n, -s) for source, found in zip(sources, best, strict=True) for s, d, n in found]
        names = ["source_dir", "source_index", "bill_dir", "provision_index", "similarity"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    fit = vectors.where(F.col("vec").isNotNull() & (F.size("vec") == dims)).select("bill_dir", F.col("provision_index").cast("long").alias("provision_index"), F.col("vec").cast("array<double>").alias("vec"))
    return fit.mapInArrow(scan, "source_dir string, source_index long, bill_dir string, provision_index long, similarity double")
