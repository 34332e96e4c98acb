"""Whole texts as token ids in files of ``idfile`` blocks, in ascending doc_id order, and back.

A part is a range of doc_ids; its rows hold blocks and the documents whose ids they carry. Parts are stored by Spark's
committed Parquet writes as binary values; ``export`` puts each part out as one plain file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idfile, tokens
from .common import map_batches, slices, stored

FILES = "part int, seq int, first long, doc_ids array<bigint>, doc_tokens array<bigint>, blocks array<binary>"
VOCABULARY = 49_408
_FLUSH = 2 * idfile.BLOCK


def write(docs: DataFrame, path: str, *, end: int = 1, vocabulary: int = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and store all texts; ``first`` counts the ids before a row in its part.

    Null texts are empty (one end id); null doc_ids come first; rows of one doc_id are ordered by a hash of the text and
    each keeps its own ids; an empty table gives no files; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, first = tokens.memory(path, False), TaskContext.get().partitionId(), 0, 0
        held, docs_held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            names, counts = pa.concat_arrays([d for d, _ in docs_held]), np.concatenate([c for _, c in docs_held])
            listed = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), listed(names), listed(pa.array(counts, pa.int64())), pa.array([idfile.encode_blocks(np.concatenate(held), first, vocabulary)], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "first", "doc_ids", "doc_tokens", "blocks"])

        for b in slices(batches, tokens.TEXTS):
            ids, counts = encoder.encode(b.column(1), end)
            held.append(ids)
            docs_held.append((b.column(0), counts))
            size += len(ids)
            if size >= _FLUSH:
                yield flush()
                first, seq, held, docs_held, size = first + size, seq + 1, [], [], 0
        if docs_held:
            yield flush()

    return stored(ordered.mapInArrow(encode, FILES), "ids", rows=tokens.TEXTS)


def read(files: DataFrame) -> DataFrame:
    """Per document, from the decoded ids: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()  # a row for each part
    base, bases = 0, []
    for r in totals:
        bases.append((r.part, base))
        base += r.n
    known = files.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")

    def decode(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in b.to_pylist():
            ids = np.concatenate(idfile.decode_blocks(r["blocks"])).astype("<u4").tobytes()
            ends = np.cumsum(r["doc_tokens"])
            starts = ends - np.array(r["doc_tokens"])
            crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (r["doc_ids"], starts + r["base"] + r["first"], r["doc_tokens"], crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]))
        return out

    return map_batches(known.select("base", "first", "doc_ids", "doc_tokens", "blocks"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> list[str]:
    """Write each part's blocks as one file to a local folder, a row in memory at a time."""
    names = []
    for r in files.orderBy("part", "seq").toLocalIterator():
        at = Path(folder, f"part-{r['part']:05d}.llid")
        with at.open("ab" if r["seq"] else "wb") as f:
            f.write(b"".join(r["blocks"]))
        if not r["seq"]:
            names.append(str(at))
    return names
