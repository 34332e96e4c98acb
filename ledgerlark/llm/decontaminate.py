"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (an item of fewer words is one window). Seen as a set of
shingles (``shingle`` words, fewer in shorter windows), a window occurs in a document only if all its shingles do, so
one shingle is a sufficient prefix. The rarest is taken: shingles are ordered by their document frequency, counted
over all documents. Documents are probed with the prefix shingles; length and position bound the candidate's place and
the window is then compared word by word.

The benchmark side goes to the executors in blocks of a bounded size; each block meets all documents.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, map_batches, row_key, small_batches, stored, utf8, without

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], dtype=np.uint64)

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
_PART = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased first."""
    return text.translate(_KEEP).split() if text else []


class WindowIndex:
    """The windows of one benchmark block: words, distinct windows, the items of each, and their shingles."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int, shingle: int) -> None:
        self.vocab: dict[bytes, int] = {}
        self.shingle = min(shingle, len(_MULT))
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            for i in range(max(len(ids) - width, 0) + 1 if ids else 0):
                owners[tuple(ids[i : i + width])].add(item)
        self.windows = list(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        flat = [(self._hash(np.array(w[i : i + self.k(len(w))], dtype=np.uint64)[None, :])[0], j, i) for j, w in enumerate(self.windows) for i in range(len(w) - self.k(len(w)) + 1)]
        self.hashes = np.array([f[0] for f in flat], dtype=np.uint64)
        self.of_window = np.array([f[1] for f in flat], dtype=np.int64)
        self.offset = np.array([f[2] for f in flat], dtype=np.int64)
        self.distinct = np.unique(self.hashes)
        self.sizes = sorted({self.k(int(n)) for n in self.lengths})
        self.padded = np.full((len(self.windows), width), -1, dtype=np.int64)
        for j, w in enumerate(self.windows):
            self.padded[j, : len(w)] = w

    def k(self, n: int) -> int:
        return min(self.shingle, n)

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        """Of rows of word ids, all of one length, which enters the hash."""
        h = np.full(len(rows), rows.shape[1], dtype=np.uint64) * _MULT[-1]
        for j in range(rows.shape[1]):
            h = (h ^ (rows[:, j] + np.uint64(1))) * _MULT[j]
            h ^= h >> np.uint64(29)
        return h

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all texts (-1: not in the block; a gap of one after each text), first positions, word counts."""
        get, parts, counts = self.vocab.get, [], np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            ws = words(text)
            counts[i] = len(ws)
            parts.append(np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws)))
            parts.append(_GAP)
        starts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]).astype(np.int64)
        return np.concatenate(parts), starts, counts

    def shingles(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all shingles of known words."""
        known, at, hs = ids >= 0, [], []
        for k in self.sizes:
            n = len(ids) - k + 1
            if n > 0:
                ok = known[:n].copy()
                for j in range(1, k):
                    ok &= known[j : j + n]
                p = np.flatnonzero(ok)
                at.append(p)
                hs.append(self._hash(ids[p[:, None] + np.arange(k)].astype(np.uint64)))
        return (np.concatenate(at), np.concatenate(hs)) if at else (np.empty(0, np.int64), np.empty(0, np.uint64))

    def order(self, frequency: dict[int, int]) -> None:
        """Keep of each window the rarest shingle; a window with one that no document holds occurs nowhere."""
        df = np.array([frequency.get(i, 0) for i in range(len(self.distinct))], dtype=np.int64)
        mine = df[np.searchsorted(self.distinct, self.hashes)] if len(self.hashes) else np.empty(0, np.int64)
        best = np.lexsort((self.offset, self.hashes, mine, self.of_window))
        first = np.concatenate([[True], np.diff(self.of_window[best]) > 0]) if len(best) else np.empty(0, bool)
        pick = best[first]
        pick = pick[mine[pick] > 0]
        pick = pick[np.argsort(self.hashes[pick], kind="stable")]
        self.hashes, self.of_window, self.offset = self.hashes[pick], self.of_window[pick], self.offset[pick]

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and windows of all occurrences."""
        at, hs = self.shingles(ids)
        lo, hi = np.searchsorted(self.hashes, hs, "left"), np.searchsorted(self.hashes, hs, "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        window, start = self.of_window[entry], np.repeat(at, n) - self.offset[entry]
        fits = (start >= 0) & (start + self.lengths[window] <= len(ids))
        window, start = window[fits], start[fits]
        good = np.zeros(len(window), dtype=bool)
        for length in np.unique(self.lengths[window]):
            p = np.flatnonzero(self.lengths[window] == length)
            good[p] = (ids[start[p, None] + np.arange(length)] == self.padded[window[p], :length]).all(axis=1)
        return start[good], window[good]


_GAP = np.array([-1], dtype=np.int64)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _judged(n_words: int, n_hit: int, items: set[str], share: int) -> tuple:
    return n_words, n_hit, len(items), _digest(items), n_hit > 0 and share * n_hit >= n_words


def _blocks(benchmark: DataFrame, width: int, shingle: int, block_bytes: int, item: str, text: str) -> list:
    """Functions that load one block each; a block has about ``block_bytes`` of text, dealt by a hash of the item id."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))

    def load(k: int) -> WindowIndex:
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        return WindowIndex([(r.i, r.t.encode()) for r in sorted(part)], width, shingle)

    return [lambda k=k: load(k) for k in range(n)]


def _ordered(docs: DataFrame, index: WindowIndex) -> WindowIndex:
    """Count over all documents in how many each shingle of the block occurs, and order by that."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        ix = sent.value
        ids, starts, _ = ix.read(utf8(b.column(0)))
        at, hs = ix.shingles(ids)
        key = np.searchsorted(ix.distinct, hs)
        ok = key < len(ix.distinct)
        ok[ok] = ix.distinct[key[ok]] == hs[ok]
        pair = np.unique((np.searchsorted(starts, at[ok], "right") - 1) * np.int64(len(ix.distinct)) + key[ok])
        k, n = np.unique(pair % max(len(ix.distinct), 1), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    with small_batches(docs.sparkSession, BATCH_ROWS):
        got = map_batches(docs, count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most the block's shingles
    index.order({r.k: r.n for r in got})
    sent.destroy()
    return index


def judge(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, shingle: int = 5, share: int = 20, block_bytes: int = 8_000_000) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    Contaminated: some words are hit, and at least one of ``share``. Null and empty texts have no words and are clean;
    repeated rows get a row each; items without id or words are ignored, repeated items count once; an empty benchmark
    finds nothing. Other columns are not read. ``block_bytes`` bounds what is sent to the executors at a time.
    """
    blocks = _blocks(benchmark, width, shingle, block_bytes, item_id, item_text)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if len(blocks) == 1:
        return _probe(source, _ordered(source.select("text"), blocks[0]()), share, whole=True)[0]
    merged = None
    for k, load in enumerate(blocks):
        part, sent = _probe(source, _ordered(source.select("text"), load()), share, whole=False)
        # every row once, from the first block; later ones add what they hit
        part = part.withColumn("copies", F.lit(1)) if k == 0 else part.where(F.size("spans") > 0).withColumn("copies", F.lit(0))
        part = stored(part, "windows")
        sent.destroy()  # so the driver holds one block at a time
        merged = part if merged is None else merged.unionByName(part)
    merged = merged.groupBy("doc_id", "text_hash").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.sum("copies").alias("copies"))

    def merge(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in b.to_pylist():
            marks, hit, end = sorted(zip(r["spans"][::2], r["spans"][1::2], strict=True)), 0, 0
            for lo, hi in marks:
                hit += max(0, hi - max(lo, end))
                end = max(end, hi)
            rows += [(r["doc_id"], *_judged(r["n_words"], hit, set(r["items"]), share))] * r["copies"]
        return _batch(rows)

    return map_batches(merged, merge, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=RESULT.names)


def _probe(source: DataFrame, index: WindowIndex, share: int, whole: bool) -> tuple:
    """The documents judged by one block (with ``whole``), or what it hits in them; and the block's broadcast."""
    sent = source.sparkSession.sparkContext.broadcast(index)

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        ix, ids_of = sent.value, b.column(0).to_pylist()
        ids, starts, counts = ix.read(utf8(b.column(1)))
        start, window = ix.occurrences(ids)
        doc = np.searchsorted(starts, start, "right") - 1
        mark = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + ix.lengths[window], -1)
        hit = np.add.reduceat((np.cumsum(mark[:-1]) > 0).astype(np.int64), starts)
        items: dict[int, set[str]] = defaultdict(set)
        for d, w in np.unique(np.stack([doc, window], axis=1), axis=0):
            items[int(d)].update(ix.items[w])
        if whole:
            return _batch([(ids_of[i], *_judged(int(counts[i]), int(hit[i]), items.get(i, set()), share)) for i in range(len(ids_of))])
        spans: dict[int, list[int]] = defaultdict(list)
        for d, s, n in zip(doc.tolist(), start.tolist(), ix.lengths[window].tolist(), strict=True):
            spans[d] += [s - int(starts[d]), s - int(starts[d]) + n]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts), pa.array([spans.get(i, []) for i in range(len(ids_of))], pa.list_(pa.int64())), pa.array([sorted(items.get(i, ())) for i in range(len(ids_of))], pa.list_(pa.string()))], names=_PART.names)

    if whole:
        return map_batches(source, find, RESULT), sent
    return map_batches(source.withColumn("text_hash", F.xxhash64("text")), find, _PART), sent


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents that ``judge`` doesn't find contaminated, with all their columns; each row by its own text, with or without an id."""
    key = row_key(options.pop("doc_id", "doc_id"), options.get("text", "text"))
    judged = judge(docs.select(key.alias("__row"), options.get("text", "text")), benchmark, doc_id="__row", **options)
    return without(docs, key, judged.where("contaminated").select("doc_id").distinct())
