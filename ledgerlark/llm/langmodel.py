"""Language-model scoring by a weighted backoff automaton over word trigrams.

States are contexts: two words, one word (or the start of a text), and the root, which has none. A state's arcs are the
n-grams seen after it, weighted by their smoothed probability (c(hw) + m p(w | shorter h)) / (c(h) + m), where m is
``mass`` of its order; its failure arc leads to the state without its first word and weighs m / (c(h) + m). At the root
every token has an arc, of p(w) = (c(w) + 1) / (N + V + 1). A text is scored in one left-to-right traversal: each token
takes the state's arc, or failure arcs down to a state that has one, and leads on to the state of the last two tokens.
All texts of a block are traversed together, as arrays of states and arcs.

The model of the whole corpus is never in one place. Documents are dealt into blocks of bounded size. A block sends each
n-gram it holds once, with its count in the block's training texts, to the n-gram's bucket; the bucket adds the counts
of all blocks and answers every block with the totals of its own n-grams; and the block builds from them the part of the
automaton that its texts can visit. What is moved grows with the corpus: a row for each bucket that a block has n-grams
of, so never more rows than n-grams, and no key gathers more than a row per block.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, space_words, stored, utf8

MASS, BLOCK_BYTES = (1000.0, 4.0), 8_000_000  # masses of contexts of one and of two words, by held-out likelihood on sf0.1
_PLACE = 44  # bits of a hash that are sent beside its bucket
_CELL = struct.Struct("<BI")
_MARKS = [b" end", b" start"]  # beside the words, which hold no blanks
_START, _END = np.uint64(0x5BD1E995C3A5C85C), np.uint64(0x9AE16A3B2F90404F)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


class BlockGrams:
    """The words, bigrams and trigrams of some texts, with each token's place among them; words and longer n-grams also
    ordered by bucket, in an order that depends on the texts' content only."""

    def __init__(self, texts: list[bytes | None], training: np.ndarray, buckets: int, word_bits: int = 64) -> None:
        known: dict[bytes, int] = {}
        put = known.setdefault
        ids = [[put(w, len(known)) for w in space_words(t)] for t in texts]
        self.end, self.start = len(known), len(known) + 1
        self.width = len(known) + 2
        self.sizes = np.fromiter((len(x) + 1 for x in ids), dtype=np.int64, count=len(texts))
        flat = np.fromiter((i for x in ids for i in (self.start, *x, self.end)), dtype=np.int64, count=int(self.sizes.sum()) + len(texts))
        hashes = np.concatenate([np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), dtype=np.uint64, count=len(known)) >> np.uint64(64 - word_bits), [_END, _START]])
        at = np.flatnonzero(flat != self.start)
        self.tokens, counted = flat[at], np.repeat(training, self.sizes)
        counts = np.bincount(self.tokens[counted], minlength=self.width)
        self.pairs, self.pair_at = np.unique(flat[at - 1] * self.width + self.tokens, return_inverse=True)
        self.later = np.flatnonzero(flat[at - 1] != self.start)  # tokens with two before them, or one and the start
        self.triples, self.triple_at = np.unique(self.pair_at[self.later - 1] * self.width + self.tokens[self.later], return_inverse=True)
        first, second = np.divmod(self.pairs, self.width)
        bigram = mix64(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes[second]))
        head, last = np.divmod(self.triples, self.width)
        trigram = mix64(bigram[head] * np.uint64(0xC2B2AE3D27D4EB4F) + mix64(hashes[last] + np.uint64(1)))
        gram_counts = np.concatenate([np.bincount(self.pair_at[counted], minlength=len(self.pairs)), np.bincount(self.triple_at[counted[self.later]], minlength=len(self.triples))])
        names = [*known, *_MARKS]
        self.words = self._ordered(hashes, counts.astype(np.uint32), buckets, names)
        self.names = [names[i] for i in self.words[0].tolist()]
        self.grams = self._ordered(np.concatenate([bigram, trigram]), gram_counts.astype(np.uint32), buckets)

    @staticmethod
    def _ordered(hashes: np.ndarray, counts: np.ndarray, buckets: int, names: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order, bucket bounds, and places in the bucket and counts in that order; buckets are ranges of mixed hashes.
        Equal hashes of one block are in the order of ``names``, or without them all get the same total."""
        mixed = mix64(hashes)
        order = np.argsort(mixed)
        if names is not None and (np.diff(mixed[order]) == 0).any():
            order = np.array(sorted(order.tolist(), key=lambda i: (mixed[i], names[i])))
        bucket, place = _placed(mixed[order], buckets)
        return order, np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)), place, counts[order]


def _placed(mixed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of mixed hashes and place in it (``_PLACE`` bits), both rising with the hash: the parts of hash * buckets / 2**64."""
    n, half = np.uint64(buckets), np.uint64(32)
    bucket = (mixed >> half) * n + ((mixed & np.uint64(0xFFFFFFFF)) * n >> half) >> half
    return bucket, mixed * n >> np.uint64(64 - _PLACE)


def _packed(places: np.ndarray) -> bytes:
    """Rising places as differences, byte by byte in planes; the two highest planes are compressed."""
    gaps = np.diff(places, prepend=np.uint64(0)).astype("<u8")
    width = max(2, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _CELL.pack(width, len(gaps)) + planes[:-2].tobytes() + zlib.compress(planes[-2:].tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    width, n = _CELL.unpack_from(data)
    plain = _CELL.size + (width - 2) * n
    planes = np.frombuffer(data[_CELL.size : plain] + zlib.decompress(data[plain:]), dtype=np.uint8).reshape(width, n)
    gaps = np.zeros((n, 8), dtype=np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.view("<u8").reshape(-1), dtype=np.uint64)


class Automaton:
    """The states and arcs that a block's texts can visit; log10 weights."""

    def __init__(self, grams: BlockGrams, word_counts: np.ndarray, gram_counts: np.ndarray, tokens: int, types: int, mass: tuple[float, float]) -> None:
        self.grams = grams
        counts, gram_counts = word_counts.astype(np.float64), gram_counts.astype(np.float64)
        context = counts.copy()
        context[grams.start] = counts[grams.end]  # as many starts as ends
        p = (counts + 1) / (tokens + types + 1)
        first, second = np.divmod(grams.pairs, grams.width)
        self.pair_counts, self.triple_counts = gram_counts[: len(first)], gram_counts[len(first) :]
        p2 = (self.pair_counts + mass[0] * p[second]) / (context[first] + mass[0])
        head, _ = np.divmod(grams.triples, grams.width)
        tail = np.empty(len(head), dtype=np.int64)  # the state without its first word, with the same token: a bigram
        tail[grams.triple_at] = grams.pair_at[grams.later]
        p3 = (self.triple_counts + mass[1] * p2[tail]) / (self.pair_counts[head] + mass[1])
        self.root, self.arc2, self.arc3 = np.log10(p), np.log10(p2), np.log10(p3)
        self.failure1, self.failure2 = np.log10(mass[0] / (context + mass[0])), np.log10(mass[1] / (self.pair_counts + mass[1]))

    def traversed(self) -> np.ndarray:
        """Each token's weight on its text's path: its arc, or the failure arcs before it and the arc they lead to."""
        g = self.grams
        first, second = np.divmod(g.pairs, g.width)
        short = np.where(self.pair_counts > 0, self.arc2, self.failure1[first] + self.root[second])[g.pair_at]
        out = short.copy()
        state = g.pair_at[g.later - 1]  # the last two tokens before
        out[g.later] = np.where(self.triple_counts[g.triple_at] > 0, self.arc3[g.triple_at], self.failure2[state] + short[g.later])
        return out


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mass: tuple[float, float] = MASS, block_bytes: int = BLOCK_BYTES, word_bits: int = 64) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Learns from all documents that aren't held out. Null and empty texts are one end token; repeated rows get a row each
    and count as often as they occur; a null doc_id isn't held out; an empty table gives no rows, and without training
    texts every token has probability 1. Other columns are not read. Words are sent and counted as they are, so n_known,
    train_tokens and base_score are exact. Bigrams and trigrams are told apart by their bucket and 44 bits of a hash, which
    reaches ``score`` alone: as buckets grow in number with the corpus, about one in ten million shares its count with
    another. ``word_bits`` shortens the words' hashes, to test that.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg((F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) + 64 * F.count("*")).alias("n")).first().n or 1
    blocks = max(1, math.ceil(size / block_bytes))
    buckets = blocks
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def count(t: pa.Table) -> pa.Table:
        grams = BlockGrams(utf8(t.column("text").combine_chunks()), ~t.column("held_out").to_numpy().astype(bool), buckets, word_bits)
        some = np.flatnonzero(np.diff(grams.words[1]) + np.diff(grams.grams[1]))  # a row only for buckets that get something
        kinds = []
        for _, bounds, places, counts in (grams.words, grams.grams):
            cut = list(zip(bounds[some].tolist(), bounds[some + 1].tolist(), strict=True))
            sent = [zlib.compress(b"\n".join(grams.names[a:b]), 1) if counts is grams.words[3] else _packed(places[a:b]) for a, b in cut]
            kinds += [pa.array(sent, pa.binary()), pa.array([zlib.compress(counts[a:b].tobytes(), 1) for a, b in cut], pa.binary())]
        return pa.table([pa.array(np.full(len(some), t.column("block")[0].as_py()), pa.int32()), pa.array(some, pa.int32()), *kinds], names=["block", "bucket", "words", "word_counts", "grams", "gram_counts"])

    def total(t: pa.Table) -> pa.Table:
        answers = {}
        for kind in ("word", "gram"):
            sent = t.column(kind + "s").to_pylist()
            counts = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint32) for b in t.column(kind + "_counts").to_pylist()])
            if kind == "word":
                each = [names.split(b"\n") if names else [] for names in map(zlib.decompress, sent)]
                coded = pa.array([w for names in each for w in names], pa.binary()).dictionary_encode()
                distinct, at = coded.dictionary, coded.indices.to_numpy()
            else:
                each = [_unpacked(b) for b in sent]
                distinct, at = np.unique(np.concatenate(each), return_inverse=True)
            sums = np.bincount(at, counts, minlength=len(distinct)).astype(np.uint64)
            if kind == "word":
                words = pc.not_equal(distinct, pa.scalar(_MARKS[1], pa.binary())).to_numpy(zero_copy_only=False)
                stats = int(sums[words].sum()), int((sums[words] > 0).sum())
            ends = np.cumsum([len(h) for h in each])
            mine = sums[at]
            narrow = mine.astype(np.uint32) if len(mine) == 0 or mine.max() < 2**32 else mine
            answers[kind] = [zlib.compress(narrow[a:b].tobytes(), 1) for a, b in zip(ends - [len(h) for h in each], ends, strict=True)]
            answers[kind + "_bytes"] = narrow.dtype.itemsize
        n = t.num_rows
        ints = lambda x, k: pa.array([*x, None if k is None else k], pa.int64())
        return pa.table([pa.array([*t.column("block").to_pylist(), -1], pa.int32()), pa.array([*t.column("bucket").to_pylist(), -1], pa.int32()), pa.array([*answers["word"], None], pa.binary()), pa.array([*answers["gram"], None], pa.binary()), ints([answers["word_bytes"]] * n, stats[0]), ints([answers["gram_bytes"]] * n, stats[1])], names=["block", "bucket", "word_totals", "gram_totals", "a", "b"])

    sent = dealt.groupBy("block").applyInArrow(count, "block int, bucket int, words binary, word_counts binary, grams binary, gram_counts binary")
    answered = stored(sent.groupBy("bucket").applyInArrow(total, "block int, bucket int, word_totals binary, gram_totals binary, a long, b long"), "ngram-totals")
    stats = answered.where("block = -1").agg(F.sum("a").alias("tokens"), F.sum("b").alias("types")).first()
    tokens, types = int(stats.tokens or 0), int(stats.types or 0)

    def judge(t: pa.Table, found: pa.Table) -> pa.Table:
        out = t.column("held_out")
        grams = BlockGrams(utf8(t.column("text").combine_chunks()), ~out.to_numpy().astype(bool), buckets, word_bits)
        rows = sorted(found.to_pylist(), key=lambda r: r["bucket"])
        totals = []
        for name, wide, (order, *_) in (("word_totals", "a", grams.words), ("gram_totals", "b", grams.grams)):
            got = np.concatenate([np.frombuffer(zlib.decompress(r[name]), np.uint32 if r[wide] == 4 else np.uint64) for r in rows])
            back = np.empty(len(order), dtype=np.int64)
            back[order] = got
            totals.append(back)
        words, longer = totals
        weights = Automaton(grams, words, longer, tokens, types, mass).traversed()
        base, known = np.log10((words + 1) / (tokens + types + 1)), words > 0
        starts = np.cumsum(grams.sizes) - grams.sizes
        per = lambda x: np.add.reduceat(x, starts)
        columns = [grams.sizes, per(known[grams.tokens].astype(np.int64)), np.full(len(out), tokens), per(base[grams.tokens]), per(weights)]
        return pa.table([t.column("doc_id"), out, *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("block").cogroup(answered.where("block >= 0").groupBy("block")).applyInArrow(judge, RESULT)
