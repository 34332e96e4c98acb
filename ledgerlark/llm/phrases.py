"""Collocations by pivot partitioning, as in MG-FSM.

Only words that occur often enough can stand in a candidate. They are numbered from the most to the least frequent, so a
phrase's rarest word, its pivot, is its largest number. For each occurrence of a word as pivot a fragment of the text is
sent to that word: up to four words on each side, ending before a rarer word, a word too rare to count, a piece's end, and
on the left before an earlier occurrence of the pivot. Each occurrence of a phrase therefore lies in exactly one fragment,
and what is mined there are the phrases that the pivot owns: those through the fragment's pivot place.

Equal fragments of a batch are sent once, with their number. A very frequent pivot is dealt over several shares by a hash
of the fragment; its phrases are then counted in two steps. A task holds some pivots' fragments at a time as a matrix and
grows phrases word by word, and for whole pivots only those that are frequent.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, map_batches, mix64, stored
from .wordblocks import coded, mapped

#: Longest phrase; a fragment has so many words less one on each side of its pivot.
LONGEST = 5
_SIDE = LONGEST - 1
_WIDTH = 2 * _SIDE + 1
#: A-Z to a-z, what ends a piece to a full stop, and tabs to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
_WORDS = [f"w{i}" for i in range(LONGEST)]
#: What a task mines at a time, in fragments.
CHUNK = 400_000


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts' words as ``coded`` gives them, with a word ``.`` where a piece ends (no word holds one)."""
    return coded(pc.replace_substring(mapped(texts, _TABLE), ".", " . "))


def _by_lang(b: pa.RecordBatch):
    """Language and texts of each language in the batch; columns: lang, text."""
    named = b.column(0).dictionary_encode()
    for k, lang in enumerate(named.dictionary.to_pylist()):
        yield lang, b.column(1).filter(pc.equal(named.indices, k))


def _counted(source: DataFrame) -> DataFrame:
    """lang, word, n: every word's occurrences."""

    def count(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for lang, texts in _by_lang(b):
            codes, words, _ = _cut(texts)
            n = np.bincount(codes, minlength=len(words))
            there = np.flatnonzero((n > 0) & pc.not_equal(words, ".").to_numpy(zero_copy_only=False))
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), words.take(pa.array(there)).cast(pa.string()), pa.array(n[there])], names=["lang", "word", "n"]))
        return out

    return stored(map_batches(source, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def _numbered(words: DataFrame, least: int) -> DataFrame:
    """id, lang, word, f of words with at least ``least`` occurrences: ids from 0, the most frequent first."""
    ordered = stored(words.where(F.col("n") >= least).orderBy(F.desc("n"), "lang", "word").withColumn("at", F.monotonically_increasing_id()), "ordered-words")
    part = F.shiftright("at", 33)
    sizes, first, offsets = ordered.groupBy(part.alias("p")).count().orderBy("p").collect(), 0, []  # a row a partition
    for r in sizes:
        offsets.append((r.p, first))
        first += r["count"]
    starts = ordered.sparkSession.createDataFrame(offsets, "p long, first long")
    row = F.col("at") - F.shiftleft(part, 33)
    return ordered.join(F.broadcast(starts), part == F.col("p")).select((F.col("first") + row).alias("id"), "lang", "word", F.col("n").alias("f"))


def _encoded(source: DataFrame, numbered: DataFrame, send: int, deal) -> DataFrame:
    """Fragments of all texts. The words go to the tasks if they take at most ``send`` bytes, else they are joined by shuffle."""
    held = numbered.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 16)).first()[0] or 0
    schema = "key long, fragments binary"
    if held > send:
        return map_batches(_joined(source, numbered), lambda b: deal(np.concatenate([[-1], *(x for r in b.column(0).to_pylist() for x in (np.array(r, np.int64), [-1]))])), schema)
    by_lang: dict[str, tuple[list, list]] = {}
    for r in numbered.select("id", "lang", "word").toLocalIterator():
        ids, words = by_lang.setdefault(r.lang, ([], []))
        ids.append(r.id)
        words.append(r.word)
    sent = source.sparkSession.sparkContext.broadcast({lang: (np.array(ids, np.int64), pa.array(words, pa.large_string())) for lang, (ids, words) in by_lang.items()})

    def encode(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for lang, texts in _by_lang(b):
            if lang in sent.value:
                ids, words = sent.value[lang]
                codes, distinct, bounds = _cut(texts)
                place = pc.fill_null(pc.index_in(distinct, value_set=words), -1).to_numpy()
                out.append(deal(np.insert(np.where(place < 0, -1, ids[place])[codes], bounds, -1)))
        return out

    return map_batches(source, encode, schema)


def _joined(source: DataFrame, numbered: DataFrame) -> DataFrame:
    """Each text as one array of ids (-1: a break or a word too rare), by a shuffle of its words."""

    def explode(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        codes, words, bounds = _cut(b.column(2))
        text = np.repeat(np.arange(b.num_rows), np.diff(bounds))
        return [pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(np.arange(len(codes)) - bounds[text]), b.column(1).take(pa.array(text)), words.take(pa.array(codes)).cast(pa.string())], names=["row", "at", "lang", "word"])]

    # rows are told apart by their place in the input, which is the same whenever a part of it is read again
    placed = stored(source, "texts").select(F.monotonically_increasing_id().alias("row"), "lang", "text")
    said = map_batches(placed, explode, "row long, at long, lang string, word string")
    known = said.join(numbered.select("lang", "word", "id"), ["lang", "word"], "left").select("row", F.struct("at", F.coalesce("id", F.lit(-1)).alias("id")).alias("w"))
    return known.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["id"]).alias("ids")).select("ids")


def _fragments(ids: np.ndarray) -> np.ndarray:
    """A row for each number of ``ids`` with a neighbour in its fragment: the words around it, -1 outside. ``ids`` ends and begins with -1."""
    n = len(ids)
    wide = np.full(n + 2 * _SIDE, -1, dtype=np.int32)
    wide[_SIDE : _SIDE + n] = ids
    out = np.full((n, _WIDTH), -1, dtype=np.int32)
    pivot = wide[_SIDE : _SIDE + n]
    out[:, _SIDE] = pivot
    for step, ends in ((-1, np.less), (1, np.less_equal)):
        open_ = pivot >= 0
        for k in range(1, _SIDE + 1):
            word = wide[_SIDE + step * k : _SIDE + step * k + n]
            open_ = open_ & (word >= 0) & ends(word, pivot)
            out[:, _SIDE + step * k] = np.where(open_, word, -1)
    return out[(pivot >= 0) & ((out[:, _SIDE - 1] >= 0) | (out[:, _SIDE + 1] >= 0))]


def _dealer(split: int, numbered: DataFrame):
    """A function from ids to rows (key, fragments): key is the pivot and, of a pivot with more than ``split`` occurrences, a share.

    The pivots with several shares are the first ids, as those are the most frequent; how many shares each has is sent.
    There are fewer of them than occurrences of words divided by ``split``.
    """
    hot = numbered.where(F.col("f") > split).orderBy("id").select("f").collect()
    shares = np.array([1 + r.f // split for r in hot], dtype=np.int64)

    def deal(ids: np.ndarray) -> pa.RecordBatch:
        rows = _fragments(ids)
        h = np.zeros(len(rows), dtype=np.uint64)
        for c in range(_WIDTH):
            h = mix64((h + rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        h >>= np.uint64(33)
        pivot = rows[:, _SIDE].astype(np.int64)
        share = np.zeros(len(rows), dtype=np.int64)
        shared = pivot < len(shares)
        share[shared] = h[shared].astype(np.int64) % shares[pivot[shared]]
        order = np.argsort(pivot.astype(np.uint64) << np.uint64(32) | h)
        rows, key = rows[order], (share << 32 | pivot)[order]
        first = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.empty(0, bool)
        at = np.flatnonzero(first)
        rows, key, times = rows[at], key[at], np.diff(at, append=len(first)).astype(np.int32)
        order = np.argsort(key, kind="stable")
        rows, key, times = rows[order], key[order], times[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        blob = np.column_stack([times, np.delete(rows, _SIDE, axis=1)]).astype("<i4")
        ends = np.append(cuts[1:], len(key))
        return pa.RecordBatch.from_arrays([pa.array(key[cuts]), pa.array([blob[a:e].tobytes() for a, e in zip(cuts, ends, strict=True)], pa.binary())], names=["key", "fragments"])

    return deal, len(shares)


def mine(rows: np.ndarray, times: np.ndarray, whole: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases through the pivot place with their counts; of ``whole`` pivots those counted ``least`` times.

    A phrase whose pivot first stands at place o grows from the phrase without its last word, or if the pivot is last from
    the one without its first: both are owned by the same pivot, and at least as frequent.
    """
    found, counts = [np.empty((0, LONGEST), np.int32)], [np.empty(0, np.int64)]
    level = {0: (np.arange(len(rows)), rows[:, _SIDE].astype(np.int64))}
    for m in range(2, LONGEST + 1):
        grown = {}
        for o in range(m):
            alive, code = level[min(o, m - 2)]
            word = rows[alive, _SIDE + m - 1 - o] if o < m - 1 else rows[alive, _SIDE - o]
            there = word >= 0
            alive, key = alive[there], code[there] << 32 | word[there]
            order = np.argsort(key)
            alive, key = alive[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            n = np.add.reduceat(times[alive], first) if len(key) else np.empty(0, np.int64)
            kept = (n >= least) | ~whole[alive[first]]
            phrase = np.full((int(kept.sum()), LONGEST), -1, dtype=np.int32)
            phrase[:, :m] = rows[alive[first[kept]], _SIDE - o : _SIDE - o + m]
            found.append(phrase)
            counts.append(n[kept])
            group = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
            goes_on = kept[group] if len(group) else np.empty(0, bool)
            grown[o] = alive[goes_on], group[goes_on].astype(np.int64)
        level = grown
    return np.concatenate(found), np.concatenate(counts)


def _mined(fragments: DataFrame, least: int, n_shared: int) -> DataFrame:
    """w0 to w4 (-1 behind the phrase), n: all candidates. Each key's rows come together, sorted."""

    def run(batches):
        held, size, last = [], 0, None

        def out():
            raw = np.concatenate([r for _, r in held])
            pivot = np.repeat(np.array([k for k, _ in held], dtype=np.int64) & 0xFFFFFFFF, [len(r) for _, r in held])
            rows = np.insert(raw[:, 1:], _SIDE, pivot, axis=1)
            found, n = mine(rows, raw[:, 0].astype(np.int64), pivot >= n_shared, least)
            return pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(LONGEST)), pa.array(n)], names=[*_WORDS, "n"])

        for b in batches:
            for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != last and size >= CHUNK:
                    yield out()
                    held, size = [], 0
                held.append((key, np.frombuffer(blob, "<i4").reshape(-1, _WIDTH)))
                size, last = size + len(held[-1][1]), key
        if held:
            yield out()

    counted = fragments.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{w} int" for w in _WORDS) + ", n long")
    return counted.groupBy(*_WORDS).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _part(words: list[Column], start: int, end: int) -> Column:
    """The words from ``start`` to ``end`` as a phrase's columns in a struct."""
    return F.struct(*((words[start + i] if start + i < end else F.lit(-1)).alias(f"w{i}") for i in range(LONGEST)))


def _all(structs: list[tuple[Column, Column]]) -> Column:
    """An array of those whose condition holds."""
    return F.filter(F.array(*(F.when(ok, s) for ok, s in structs)), lambda s: s.isNotNull())


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = 100, top: int = 2000, split: int = 1_000_000, send: int = 16_000_000) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    A phrase of 2 to 5 words with at least ``least`` occurrences scores floor(1000*a*n/(l*r)), taken at its lowest-scoring
    cut into parts that occur l and r times. Phrases inside a longer one that occurs as often are dropped. Arithmetic is
    exact (38 digits). Null and empty texts have no words; a null language is ``und``; repeated rows count each for itself;
    an empty table gives no rows. Other columns are not read. ``split``: occurrences of a pivot that one task mines;
    ``send``: bytes of frequent words that are broadcast, beyond which they are joined by shuffle.
    """
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    words = _counted(source)
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_IDS else totals
    numbered = stored(_numbered(words, least), "numbered-words")
    deal, n_shared = _dealer(split, numbered)
    phrases = stored(_mined(_encoded(source, numbered, send, deal), least, n_shared), "phrases")
    w = [F.col(c) for c in _WORDS]
    length = reduce(lambda x, y: x + y, ((c >= 0).cast("int") for c in w))

    parts = phrases.select(F.struct(*w).alias("part"), "a").unionByName(numbered.select(_part([F.col("id").cast("int")], 0, 1).alias("part"), F.col("f").alias("a")))
    cut = _all([(length > k, F.struct(F.lit(k).alias("k"), _part(w, 0, k).alias("left"), _part(w, k, LONGEST).alias("right"))) for k in range(1, LONGEST)])
    cut = phrases.select(F.struct(*w).alias("p"), "a", F.explode(cut).alias("c")).select("p", "a", "c.k", "c.left", "c.right")
    cut = cut.join(parts.select(F.col("part").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("a").alias("r")), "right")
    # the phrase's language is its words', so that of its first
    cut = cut.join(numbered.select(F.col("id").alias("first"), "lang"), F.col("p.w0") == F.col("first")).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"_top": (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)"), "_base": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = cut.groupBy("p", "a", "lang", "n").agg(F.min(F.struct(F.expr("_top div _base").alias("score"), "k", "l", "r")).alias("s"))

    inner = _all([(length >= e, _part(w, s, e)) for s in range(LONGEST) for e in range(s + 2, LONGEST + 1)])
    inside = phrases.select(F.col("a").alias("as_often"), F.struct(*w).alias("whole"), F.explode(inner).alias("inner")).where("inner != whole").select("inner", "as_often").distinct()
    alone = scored.join(inside, (F.col("p") == F.col("inner")) & (F.col("as_often") == F.col("a")), "left_anti")

    best = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"))
    near = alone.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)  # all ties of the last place too
    named = near.select("lang", "n", "a", "s", "p", F.posexplode(F.array(*(F.col(f"p.{c}") for c in _WORDS))).alias("i", "id")).where("id >= 0").join(numbered.select("id", "word"), "id")
    named = named.groupBy("lang", "n", "a", "s", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda e: e["word"]), " ").alias("phrase"))
    exact = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(exact).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
