"""Secrets in texts: three fixed patterns, and strings in sensitive places that a primed compressor finds new.

A candidate is a run of key characters that holds a letter and a digit, close behind or before a sensitive word. Its
marginal size is measured with zstandard: the bytes of its surroundings with the candidate behind them, less the bytes of
the surroundings alone, both compressed from a dictionary of identifiers. What is made of names, words, paths or repeats
costs little; a key costs about a byte a character and is reported as ``novel``.

The dictionary holds fixed code words and the corpus's most frequent identifiers, counted over all documents. Only words
of letters that are shorter than any candidate enter it, so nothing of a secret does, however often it is copied.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .wordblocks import coded, mapped

#: The kinds in their order, and the patterns of the first three (the group's or match's least length follows).
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN, _ASSIGN_LEAST = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 8
_ACCESS, _ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 16
_HEX = re.compile(r"[0-9a-f]{32,}")  # a greedy run of 32 or more is the whole run
#: Words that make a place sensitive.
_SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature|session[_-]?id", re.ASCII | re.IGNORECASE)
#: Runs of at least 16 key characters with a letter and a digit.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}", re.ASCII)
#: Texts without any of these have no span; RE2 looks for them in whole columns.
_ANY = r"(?i:passw|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature|session[_-]?id)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
_CODE = b"import from return class public private static void const function def self async await try except catch throw new null true false string number boolean config settings environment client server request response header content type json http https www com org net user username name email host port path file value default timeout version authorization bearer basic credential password passwd secret token access_key api_key private_key session signature id key = : "

#: Characters of candidates and letters; what else there is separates words.
_JOINED = bytes(c if chr(c).isalnum() or c in b"_+/-" or c >= 128 else 32 for c in range(256))
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("n_novel", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= _ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def identifiers(docs: DataFrame, text: str, bytes_: int) -> list[str]:
    """The most frequent words of letters, 4 to 15 bytes long, over all documents, as many as ``bytes_`` hold."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch | None:
        codes, words, _ = coded(mapped(b.column(0), _JOINED))
        named = pc.value_counts(pa.array(codes))
        words, n = words.take(named.field(0)), named.field(1)
        size = pc.binary_length(words)
        fits = pc.and_not(pc.and_(pc.greater_equal(size, 4), pc.less(size, 16)), pc.match_substring_regex(words, "[0-9+/-]"))
        return pa.RecordBatch.from_arrays([words.filter(fits).cast(pa.string()), n.filter(fits)], names=["word", "n"])

    counted = map_batches(docs.select(F.col(text).cast("string").alias("t")).where("t is not null"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out, room = [], bytes_
    for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(bytes_ // 5).collect():  # a word and a space: at least 5 bytes
        room -= len(r.word.encode()) + 1
        if room < 0:
            break
        out.append(r.word)
    return out


class Novelty:
    """Marginal sizes against a dictionary, the most frequent words nearest to the text."""

    def __init__(self, words: list[str], level: int) -> None:
        primed = zstandard.ZstdCompressionDict(" ".join(reversed(words)).encode() + b" " + _CODE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level)
        self.size = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_dict_id=False).compress

    def share(self, candidate: str, around: str) -> float:
        """New bytes a byte of the candidate; copies of it in the surroundings don't count as known."""
        known, mine = around.replace(candidate, " ").encode(), candidate.encode()
        return (len(self.size(known + mine)) - len(self.size(known))) / len(mine)


def novel_spans(text: str, base: list[Span], novelty: Novelty, share: float, reach: int) -> list[Span]:
    """Candidates within ``reach`` code points of a sensitive word, outside base spans, that the dictionary doesn't explain."""
    places, out, at, inside = [(m.start(), m.end()) for m in _SENSITIVE.finditer(text)], [], 0, 0
    if not places:
        return out
    covers, upto = [], -1
    for s, _, e in base:  # base spans joined, in order
        if s <= upto:
            covers[-1] = (covers[-1][0], upto := max(upto, e))
        else:
            covers.append((s, upto := e))
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(places) and places[at][1] < s - reach:
            at += 1
        if at == len(places):
            break
        while inside < len(covers) and covers[inside][1] < e:
            inside += 1
        if places[at][0] > e + reach or inside < len(covers) and covers[inside][0] <= s:
            continue
        if novelty.share(m[0], text[max(0, s - 2 * reach) : s] + "\n" + text[e : e + reach]) >= share:
            out.append((s, 3, e))
    return out


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_NONE = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = 0.8, reach: int = 80, level: int = 9, dictionary_bytes: int = 32_768) -> DataFrame:
    """Per row: counts by kind, ``base_sha256`` and ``spans`` (``kind:start:end`` in code points, by start, then kind).

    ``share``: new bytes a character from which a candidate is reported. Null and empty texts have no spans; repeated rows
    get a row each; an empty table gives none. Whole texts are read, however long. Ids that aren't numbers fail the cast
    to long (or become null without ANSI). Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(identifiers(docs, text, dictionary_bytes))  # at most dictionary_bytes
    made: list[Novelty] = []

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Novelty(sent.value, level))
        texts, n = b.column(1), b.num_rows
        some = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
        counts, digests, shown = [[0] * n for _ in KINDS], [_NONE] * n, [""] * n
        for i in (i for i in range(n) if some[i]):
            t = texts[i].as_py()
            base = base_spans(t)
            spans = base + novel_spans(t, base, made[0], share, reach)
            for _, k, _ in spans:
                counts[k][i] += 1
            digests[i], shown[i] = hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(shown)], names=RESULT.names)

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), find, RESULT)
