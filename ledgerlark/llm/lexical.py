"""Ranked lexical search as a blocked sparse matrix product.

Documents become blocks of a sparse term-document matrix (terms of the items only, with their occurrences), stored once.
Items are the rows of a sparse item-term matrix, whose entries are multiplicity times the term's weight; they go to the
tasks in blocks of a bounded size. A task multiplies row by row after Gustavson: the term rows that an item names are
merged, scaled, into one row of int64 scores over the block's documents. The best of each block are merged with the best
so far, so a task ends with at most ``top`` rows an item, and a window takes the best of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored
from .decontaminate import _KEEP, words
from .wordblocks import coded, mapped

#: The last of ids: documents without one stand behind equal scores.
_LAST = np.iinfo(np.int64).max
_MATRIX = "docs long, terms long, ids array<long>, sizes binary, ends binary, term binary, tf binary"


class Items:
    """A block of items as a sparse matrix: ``ends`` of rows, ``term`` and ``times`` of entries."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.names = sorted(texts)
        vocabulary: dict[bytes, int] = {}
        rows = [Counter(w for t in texts[name] for w in words(t)) for name in self.names]
        entries = [[(vocabulary.setdefault(w, len(vocabulary)), n) for w, n in row.items()] for row in rows]
        self.vocabulary = pa.array([w.decode() for w in vocabulary], pa.large_string())
        self.ends = np.cumsum([len(e) for e in entries], dtype=np.int64)
        self.term = np.array([t for e in entries for t, _ in e], dtype=np.int64)
        self.times = np.array([n for e in entries for _, n in e], dtype=np.int64)


def _matrix(source: DataFrame, items: Items) -> DataFrame:
    """The documents' blocks: ids, sizes in terms, and of each document its terms (places in the vocabulary) with counts."""
    sent = source.sparkSession.sparkContext.broadcast(items.vocabulary)

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        codes, distinct, bounds = coded(mapped(b.column(1), _KEEP))
        sizes = np.diff(bounds)
        place = pc.fill_null(pc.index_in(distinct, value_set=sent.value), -1).to_numpy().astype(np.int64)[codes]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        known = place >= 0
        entry, tf = np.unique(doc[known] * np.int64(max(len(sent.value), 1)) + place[known], return_counts=True)
        doc, term = np.divmod(entry, max(len(sent.value), 1))
        ends = np.searchsorted(doc, np.arange(len(sizes)), "right")
        blobs = [sizes.astype("<i8"), ends.astype("<i4"), term.astype("<i4"), tf.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["docs", "terms", "ids", "sizes", "ends", "term", "tf"])

    out = stored(map_batches(source, block, _MATRIX), "term-documents")
    sent.destroy()
    return out


def _weights(matrix: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and each vocabulary term's weight; a row a term at most reaches the driver."""
    n, total = matrix.agg(F.sum("docs"), F.sum("terms")).first()

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        term, df = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in b.column(0).to_pylist()]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    df = np.zeros(terms, dtype=np.int64)
    for r in map_batches(matrix.select("term"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return n or 0, total or 0, np.array([math.floor(1000 * math.log((2 * (n or 0) + 2) / (2 * int(f) + 1))) for f in df], dtype=np.int64)


def _best(score: np.ndarray, id_: np.ndarray, none: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(score) > top:
        at = np.flatnonzero(score >= np.partition(score, -top)[-top])  # ties included
        at = at[np.lexsort((none[at], id_[at], -score[at]))[:top]]
        return score[at], id_[at], none[at]
    return score, id_, none


def _products(matrix: DataFrame, items: Items, n: int, total: int, weights: np.ndarray, top: int) -> DataFrame:
    sent = matrix.sparkSession.sparkContext.broadcast((items, items.times * weights[items.term] if len(items.term) else items.times))

    def merge(batches):
        items, scale = sent.value
        held = [(np.empty(0, np.int64),) * 2 + (np.empty(0, bool),) for _ in items.names]
        starts = items.ends - np.diff(items.ends, prepend=0)
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            sizes, ends, term, tf = (np.frombuffer(row[c], d).astype(np.int64) for c, d in (("sizes", "<i8"), ("ends", "<i4"), ("term", "<i4"), ("tf", "<i4")))
            none = np.array([x is None for x in row["ids"]], dtype=bool)
            ids = np.array([_LAST if x is None else x for x in row["ids"]], dtype=np.int64)
            doc = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            norm = 100 - 25 + (25 * sizes * n) // max(total, 1)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc])
            by_term = np.argsort(term, kind="stable")
            doc, impact = doc[by_term], impact[by_term]
            first = np.searchsorted(term[by_term], np.arange(len(items.vocabulary) + 1))
            for k, (lo, hi) in enumerate(zip(starts, items.ends, strict=True)):
                terms = items.term[lo:hi]
                many = first[terms + 1] - first[terms]
                at = np.arange(many.sum()) + np.repeat(first[terms] - np.cumsum(many) + many, many)
                scores = np.zeros(len(ids), dtype=np.int64)
                np.add.at(scores, doc[at], impact[at] * np.repeat(scale[lo:hi], many))
                least = held[k][0].min() if len(held[k][0]) == top else 1
                hits = np.flatnonzero(scores >= max(least, 1))
                if len(hits):
                    held[k] = _best(*(np.concatenate([old, new[hits]]) for old, new in zip(held[k], (scores, ids, none), strict=True)), top)
        for k, (score, id_, none) in enumerate(held):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([items.names[k]] * len(score)), pa.array(id_, mask=none), pa.array(score)], names=["item", "doc_id", "score"])

    return matrix.select("ids", "sizes", "ends", "term", "tf").mapInArrow(merge, "item string, doc_id long, score long")


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list:
    """Functions that load about ``block_bytes`` of items each; all rows of an id come together."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("i"), F.lit(n)))
    if n > 1:  # sorted, so that each block reads its own part of the file
        rows = stored(rows.sort("k"), "items")

    def load(k: int) -> Items:
        texts: dict[str, list[bytes]] = {}
        for r in rows.where(F.col("k") == k).collect():
            texts.setdefault(r.i, []).append(r.t.encode())
        return Items(texts)

    return [lambda k=k: load(k) for k in range(n)]


def rank(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 20, block_bytes: int = 8_000_000) -> DataFrame:
    """Each item's ``top`` documents of a score above 0: item_id, rank (from 1), doc_id, score; equal scores by doc_id.

    Null and empty texts have no terms. Documents without id are counted and ranked behind equal scores; repeated rows are
    ranked each for itself. Rows of one item id are one item with the terms of its different texts; items without id or
    text are ignored. Without documents or items there are no rows. Other columns are not read. ``block_bytes`` bounds
    what is sent to the executors at a time; every block of items reads the documents twice, once as text.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for load in _blocks(items, item_id, item_text, block_bytes):
        block = load()
        matrix = _matrix(source, block)
        part = _products(matrix, block, *_weights(matrix, len(block.vocabulary)), top)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select(F.col("item").cast(items.schema[item_id].dataType).alias("item_id"), "rank", "doc_id", "score")
