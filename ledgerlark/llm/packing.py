"""Packing of documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt at random (by a hash of where
they stand in the stored table of pieces) into groups of about ``group_pieces``; each group packs alone, so groups run
in parallel and none grows with the input. Within a group pieces go by falling length into the first sequence with
room, which a tournament tree of the sequences' free places finds in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, stored

#: Texts tokenised at a time: their ids are held beside the encoder's memory of words.
TEXTS = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
#: Words whose ids a worker remembers, some 70 MB.
WORDS = 300_000


class Tournament:
    """Bins of equal capacity; each inner node holds the largest free place below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Put a piece into the first bin with room; the bin and the free place it had."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; equal lengths go in their order."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        bins[i], had = tree.put(size)
        offsets[i] = capacity - had
    return bins, offsets


def pieces(docs: DataFrame, path: str, *, sequence: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents, in order, without their places yet; with ``keep_ids`` also their ids (unsigned 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = tokens.memory(path, True, WORDS), 0
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        for b in slices(batches, TEXTS):
            rows, kept, at = [], [], 0
            ids, counts = encoder.encode(b.column(1), end)
            data = ids.tobytes()
            for doc, total in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
                for s in range(0, total, sequence):
                    length = min(sequence, total - s)
                    part = data[4 * (at + s) : 4 * (at + s + length)]
                    rows.append((doc, s, length, zlib.crc32(part), total, n))
                    n += 1
                    if keep_ids:
                        kept.append(part)
                at += total
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if keep_ids else []), names=names + (["ids"] if keep_ids else []))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, *, path: str | None = None, sequence: int = 2048, end: int = 1, group_pieces: int = 8192, **options: object) -> DataFrame:
    """Every piece with its sequence_id and offset there.

    Null and empty texts are one end id; repeated rows are documents of their own; documents with a null doc_id are
    packed too; an empty table gives no pieces; other columns are not read. Sequence ids are unique over all groups.
    """
    cut = stored(pieces(docs, path or tokens.vocabulary("byte_bpe_50k.json"), sequence=sequence, end=end, **options).withColumn("deal", F.xxhash64(F.col("deal"), F.spark_partition_id())), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", "doc_id", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence)
        return pdf.drop(columns=["deal", "group"]).assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "deal") + ", sequence_id long, offset long"
    return cut.withColumn("group", F.pmod("deal", F.lit(groups))).groupBy("group").applyInPandas(place, schema)
