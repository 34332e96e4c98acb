"""Raw-text repair: replace an excerpt by the verbatim source text it came from, with its byte span (OP-REP-*).

Bytes throughout, so that the invariant ``source[start:end] == text`` holds for any script (T-21, T-23).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest target, shortest piece, longest prefix, last substring offset, longest substring, and the length
#: that is good enough.
LEAST_TARGET, GRAM, PREFIX, OFFSETS, SUBSTRING, ENOUGH = 150, 15, 80, 40, 60, 40
FEW = 64  # more places than these are searched by bytes
SHORT = 4096  # a source of fewer bytes is searched as it is, which takes less than its index
_PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "—": "-", "–": "-", "‒": "-"}
_BLANK = np.array([chr(c).isspace() for c in range(128)])


def position_map(source: bytes) -> tuple[bytes, np.ndarray]:
    """OP-REP-02: the normalised text, and for each of its bytes the byte of the source where its character begins."""
    if source.isascii():
        data = np.frombuffer(source, dtype=np.uint8)
        blank = _BLANK[data]
        more = np.zeros(len(data), dtype=bool)
        more[1:] = blank[1:] & blank[:-1]
        kept = np.flatnonzero(~more)
        return np.where(blank, np.uint8(32), data)[kept].tobytes(), np.append(kept, len(data))
    out, at, pos, blank = bytearray(), [], 0, False
    for c in source.decode("utf-8", "surrogateescape"):
        size = len(c.encode("utf-8", "surrogateescape"))
        if c.isspace():
            new = b"" if blank else b" "
            blank = True
        else:
            new, blank = _PLAIN.get(c, c).encode("utf-8", "surrogateescape"), False
        out += new
        at += [pos] * len(new)
        pos += size
    return bytes(out), np.array([*at, pos], dtype=np.int64)


def _boundary(text: bytes, at: int) -> bool:
    return at >= len(text) or text[at] & 0xC0 != 0x80


def _span(source: bytes, start: int, length: int) -> tuple[int, int]:
    """A span of at most ``length`` that begins and ends between characters."""
    while not _boundary(source, start):
        start -= 1
    end = min(len(source), start + length)
    while end > start and not _boundary(source, end):
        end -= 1
    return start, end


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    n = max(len(data) - GRAM + 1, 0)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    eight = np.zeros(n + GRAM - 8, dtype=np.uint64)
    for k in range(8):
        eight |= data[k : k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[GRAM - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F)


class Source:
    """A source and, unless it is short, an index of it: the places of its runs of ``GRAM`` bytes in order of their hash, so that an excerpt
    meets only places that share a run with it. Takes about 16 bytes a byte of the source. The index, the normalised
    text and that text's index are built when a claim first needs them."""

    def __init__(self, source: bytes) -> None:
        self.bytes, self.data = source, np.frombuffer(source, dtype=np.uint8)

    @cached_property
    def _index(self) -> tuple[np.ndarray, np.ndarray]:
        grams = _grams(self.data)
        order = np.argsort(grams, kind="stable")
        return grams[order], order

    @cached_property
    def normalised(self) -> tuple[Source, np.ndarray]:
        plain, places = position_map(self.bytes)
        return Source(plain), places

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        """Of each hash the places where it begins, rising."""
        keys, order = self._index
        return [order[a:b] for a, b in zip(np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right"), strict=True)]

    def first(self, raw: bytes) -> int:
        """The first place of ``raw``, or -1."""
        if len(raw) < GRAM or len(self.bytes) < SHORT:
            return self.bytes.find(raw)
        at = self.places(_grams(np.frombuffer(raw[:GRAM], dtype=np.uint8)))[0]
        if len(at) > FEW:
            return self.bytes.find(raw, int(at[0]))
        return next((int(p) for p in at if self.bytes.startswith(raw, int(p))), -1)

    def starts(self, raw: bytes) -> Iterator[tuple[int, np.ndarray | None]]:
        """The offsets up to ``OFFSETS`` at which ``raw`` has a run of the source, with its places where there is an index."""
        head = raw[: OFFSETS + GRAM]
        if len(self.bytes) < SHORT:
            yield from ((k, None) for k in range(len(head) - GRAM + 1) if head[k : k + GRAM] in self.bytes)
        else:
            yield from ((k, found) for k, found in enumerate(self.places(_grams(np.frombuffer(head, dtype=np.uint8)))) if len(found))

    def _longest(self, raw: bytes, offset: int, most: int) -> tuple[int, int]:
        """``longest`` by halving: what holds a piece holds all that the piece begins with."""
        length, most = GRAM, min(most, len(raw) - offset)
        while length < most:
            half = (length + most + 1) // 2
            length, most = (half, most) if raw[offset : offset + half] in self.bytes else (length, half - 1)
        while length > GRAM and not _boundary(raw, offset + length):
            length -= 1
        return (length, self.bytes.find(raw[offset : offset + length])) if _boundary(raw, offset + length) else (0, -1)

    def longest(self, raw: bytes, offset: int, places: np.ndarray | None, most: int) -> tuple[int, int]:
        """Length and first place of the longest piece of ``raw`` from ``offset`` that the source holds, ``GRAM`` bytes at
        least and up to ``most``, ended between characters; ``places`` are those of its first ``GRAM`` bytes, by ``starts``."""
        if places is None:
            return self._longest(raw, offset, most)
        firsts = []
        for k, byte in enumerate(raw[offset : offset + most]):
            places = places[places + k < len(self.data)]
            places = places[self.data[places + k] == byte]
            if not len(places):
                break
            firsts.append(int(places[0]))
        length = len(firsts)
        while length > GRAM and not _boundary(raw, offset + length):
            length -= 1
        return (length, firsts[length - 1]) if length >= GRAM and _boundary(raw, offset + length) else (0, -1)


def locate(raw: bytes, source: Source) -> tuple[str, int, int]:
    """OP-REP-01: tier, start, end: exact, repaired_prefix, repaired_substring, repaired_normalized, else unverified."""
    at = source.first(raw)
    if at >= 0:
        return "exact", at, at + len(raw)
    target = max(len(raw), LEAST_TARGET)  # so it may be longer than the excerpt (T-22)
    best = (0, -1, 0)
    for offset, places in source.starts(raw):
        if not _boundary(raw, offset):
            continue
        if offset == 0:
            length, at = source.longest(raw, 0, places, PREFIX)
            if length:
                return "repaired_prefix", *_span(source.bytes, at, target)
        length, at = source.longest(raw, offset, places, SUBSTRING)
        if length > best[0]:
            best = (length, at, offset)
        if best[0] >= ENOUGH:
            break
    if best[0]:
        return "repaired_substring", *_span(source.bytes, max(best[1] - best[2], 0), target)
    plain, places = source.normalised
    wanted = position_map(raw)[0].strip()
    at = plain.first(wanted) if wanted else -1
    if at >= 0:
        start, end = int(places[at]), int(places[at + len(wanted)])
        return "repaired_normalized", *_span(source.bytes, start, max(target, end - start))
    return "unverified", -1, -1


def repaired(claims: DataFrame, sources: DataFrame, key: str = "bill_dir", claims_per_task: int = 4096) -> DataFrame:
    """OP-REP-01/03: per provision tier, start, end and text (the source's own, the excerpt where nothing was found).

    Empty excerpts are exact without a span; claims without a source are unverified. A bill's claims are dealt into parts
    of about ``claims_per_task``; a row holds a part's claims and the source, and many rows go to Python at once, so short
    bills cost no group each.
    """
    kind = claims.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed, sources_ = b.column("claims"), b.column("source").cast(pa.large_binary())
            flat, ends = listed.flatten(), np.cumsum(listed.value_lengths().to_numpy()).tolist()
            raws, rows, at = flat.field("raw_text").cast(pa.large_binary()).to_pylist(), [], 0
            for i, end in enumerate(ends):
                source = Source(sources_[i].as_py() or b"")
                for raw in raws[at:end]:
                    raw = raw or b""
                    tier, start, stop = locate(raw, source) if raw.strip() else ("exact", -1, -1)
                    rows.append((i, tier, start, stop, source.bytes[start:stop] if start >= 0 else raw))
                at = end
            owner, tiers, starts, stops, texts = zip(*rows, strict=True) if rows else [()] * 5
            cols = [b.column("__key").take(pa.array(owner, pa.int64())), flat.field("provision_index"), pa.array(tiers, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "provision_index", "match_tier", "start", "end", "text"])

    # only bills of several parts are told, of which there are no more than parts; so claims aren't shuffled to be dealt
    parts = claims.groupBy(F.col(key).alias("__bill")).agg(F.ceil(F.count("*") / claims_per_task).cast("int").alias("__parts")).where("__parts > 1")
    same = F.col("__bill").eqNullSafe(F.col("__key"))
    left = claims.select(F.col(key).alias("__key"), F.col("provision_index").cast("long").alias("provision_index"), "raw_text").join(F.broadcast(parts), same, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    dealt = left.groupBy("__key", F.pmod(F.xxhash64("provision_index", "raw_text"), F.col("__parts")).alias("__part")).agg(F.collect_list(F.struct("provision_index", "raw_text")).alias("claims"))
    whole = sources.groupBy(F.col(key).alias("__bill")).agg(F.first("source").alias("source"))
    out = dealt.join(whole, same, "left").select("__key", "claims", "source").mapInArrow(find, f"{key} {kind}, provision_index long, match_tier string, start long, end long, text string")
    return out.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("start", "end")})


def report(rows: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-AGG-28: counts of tiers per bill and over all (``TOTAL``), and the share that is traceable."""
    tiers = ("exact", "repaired_prefix", "repaired_substring", "repaired_normalized", "unverified")
    rolled = rows.rollup(key).agg(F.grouping(key).alias("g"), F.count("*").alias("total"), *[F.count_if(F.col("match_tier") == t).alias(t) for t in tiers])
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(key).cast("string")).alias(key), "total", *tiers, ((F.col("total") - F.col("unverified")) / F.col("total") * 100).alias("traceable_pct"))


def with_holds(rows: DataFrame, sources: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-REP-04: the rows with ``holds``, whether the source's bytes of the span are the text; null without a span or a source."""
    cut = F.substring(F.encode("source", "UTF-8"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    both = rows.join(sources.select(key, "source"), key, "left")
    return both.withColumn("holds", F.when(F.col("start").isNotNull(), cut == F.encode("text", "UTF-8"))).drop("source")


def span_holds(rows: DataFrame, sources: DataFrame, key: str = "bill_dir") -> DataFrame:
    """OP-REP-04: whether the source's bytes of each span are the text."""
    both = rows.where("start is not null").join(sources, key)
    cut = F.substring(F.encode("source", "UTF-8"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return both.select(key, "provision_index", (cut == F.encode("text", "UTF-8")).alias("holds"))


def verify_text(claims: DataFrame, sources: DataFrame, *, write: bool = False, bill: str | None = None, key: str = "bill_dir") -> tuple[DataFrame, DataFrame]:
    """OP-VTX-01: the report, and the claims: with ``write`` their texts replaced and spans added, else as they were."""
    rows = claims if bill is None else claims.where(F.col(key) == bill)
    done = repaired(rows, sources, key)
    if not write:
        return report(done, key), rows
    new = done.select(key, "provision_index", F.col("text").alias("raw_text"), F.struct("start", "end", (F.col("match_tier") != "unverified").alias("verified"), "match_tier").alias("source_span"))
    return report(done, key), rows.drop("raw_text", "source_span").join(new, [key, "provision_index"], "left")
