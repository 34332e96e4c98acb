"""Positions in bill texts (OP-TXT-*): amounts, sections, clauses, divisions, titles, chunks. All positions are in bytes.

Each scan is one vectorised pass over whole texts in Arrow batches; a text stays in one task, many texts spread out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AMOUNT = re.compile(rb"\$([0-9,.]*)")
_SECTION = re.compile(rb"^SEC\. *(\S+?)\.?(?=\s|$)", re.M)
_DIVISION = re.compile(rb"^DIVISION ([A-Z])(?![a-z])[^\n]*", re.M)
_TITLE = re.compile(rb"^TITLE ([IVXLC]+)\b[^\n]*", re.M)
CONTENTS_BYTES = 2500  # divisions named before are the table of contents (T-20)


def amounts(text: bytes, pattern: re.Pattern[bytes] = AMOUNT) -> list[tuple[int, str, int]]:
    """OP-TXT-02: (position, text, value): trailing marks go, a digit is needed, and the value is all digits in a row (T-19)."""
    out = []
    for m in pattern.finditer(text):
        shown = m.group().rstrip(b",.:;")
        digits = re.sub(rb"\D", b"", shown)
        value = digits.lstrip(b"0") or b"0"
        if digits and len(value) <= 19 and int(value) < 2**63:  # Python refuses to read thousands of digits
            out.append((m.start(), shown.decode(), int(value)))
    return out


def sections(text: bytes) -> list[tuple[str, int, int]]:
    """OP-TXT-03/WIN-04: (label, start, end): headers at a line's start; each ends where the next begins."""
    found = [(f"SEC. {m.group(1).decode()}", m.start()) for m in _SECTION.finditer(text)]
    return [(label, at, found[i + 1][1] if i + 1 < len(found) else len(text)) for i, (label, at) in enumerate(found)]


def clauses(text: bytes, phrase: bytes = b"Provided, That") -> list[int]:
    """OP-TXT-04."""
    return [m.start() for m in re.finditer(re.escape(phrase), text)]


def divisions(text: bytes, skip: int = CONTENTS_BYTES) -> list[tuple[str, str, int, int]]:
    """OP-TXT-05: (letter, heading, start, end)."""
    found = [(m.group(1).decode(), m.group().decode().strip(), m.start()) for m in _DIVISION.finditer(text) if m.start() >= skip]
    return [(a, h, at, found[i + 1][2] if i + 1 < len(found) else len(text)) for i, (a, h, at) in enumerate(found)]


def titles(text: bytes) -> list[tuple[str, int, int]]:
    """OP-TXT-06: (roman numeral, start, end)."""
    found = [(m.group(1).decode(), m.start()) for m in _TITLE.finditer(text)]
    return [(n, at, found[i + 1][1] if i + 1 < len(found) else len(text)) for i, (n, at) in enumerate(found)]


def paragraphs(text: bytes, most_tokens: int) -> list[tuple[int, int]]:
    """OP-TXT-08: spans of at most ``most_tokens`` (of four bytes): cut after the last blank line, else the last line
    break, if more than a quarter of the span lies before it; else at the limit, but within no character."""
    most, at, out = most_tokens * 4, 0, []
    while len(text) - at > most:
        window = text[at : at + most]
        cut = next((i + len(b) for b in (b"\n\n", b"\n") if (i := window.rfind(b)) > most // 4), None)
        if cut is None:
            cut = most
            while cut > 1 and text[at + cut] & 0xC0 == 0x80:
                cut -= 1
        out.append((at, at + cut))
        at += cut
    if at < len(text) or not out:
        out.append((at, len(text)))
    return out


def chunks(text: bytes, most_tokens: int) -> list[tuple[str, str, str, int, int]]:
    """OP-TXT-07: (label, division, title, start, end): divisions, within them titles, within them paragraphs."""
    out: list[tuple[str, str, str, int, int]] = []

    def split(division: str, title: str, lo: int, hi: int) -> None:
        if hi <= lo:
            return
        spans = paragraphs(text[lo:hi], most_tokens)
        for k, (a, b) in enumerate(spans):
            label = " ".join(x for x in (division, title) if x) or "full"
            out.append((label if len(spans) == 1 else f"{label} part {k + 1}", division, title, lo + a, lo + b))

    parts = divisions(text)
    if not parts:
        split("", "", 0, len(text))
    for letter, _, lo, hi in parts:
        if hi - lo <= most_tokens * 4:
            split(letter, "", lo, hi)
            continue
        inner = titles(text[lo:hi])
        split(letter, "", lo, lo + inner[0][1] if inner else hi)
        for name, a, b in inner:
            split(letter, name, lo + a, lo + b)
    return out


def scanned(texts: DataFrame, key: str, text: str, schema: str, scan: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Apply a scan to every text: the key and the fields of ``schema`` for each hit, in order, with its ordinal ``ord``."""
    kind = texts.schema[key].dataType.simpleString()
    names, types = zip(*(p.split() for p in schema.split(", ")), strict=True)
    kinds = [pa.int64(), *[pa.int64() if t == "long" else pa.string() for t in types]]  # declared, not guessed: a batch may hold no hit

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            keys, rows = [], []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                hits = scan((t.as_py() or "").encode())
                keys += [k] * len(hits)
                rows += [(i, *h) for i, h in enumerate(hits)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], b.column(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[key, "ord", *names])

    return texts.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, ord long, {schema}")


def amount_refs(texts: DataFrame, key: str, text: str, pattern: str = r"\$([0-9,.]*)") -> DataFrame:
    """OP-TXT-02 over a table of texts: (key, ord, position, text, value)."""
    compiled = re.compile(pattern.encode())
    return scanned(texts, key, text, "position long, amount string, value long", lambda t: amounts(t, compiled))


def index(texts: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """OP-TXT-01: amounts, sections and provisos of each text."""
    return {
        "dollar_amounts": amount_refs(texts, key, text),
        "section_headers": scanned(texts, key, text, "label string, start long, end long", sections),
        "proviso_clauses": scanned(texts, key, text, "position long", lambda t: [(p,) for p in clauses(t)]),
    }


def in_range(refs: DataFrame, start: int, end: int) -> DataFrame:
    """OP-FLT-17: half open."""
    return refs.where((F.col("position") >= start) & (F.col("position") < end))


def chunk_table(texts: DataFrame, key: str, text: str, most_tokens: int) -> DataFrame:
    """OP-TXT-07 over a table of texts, with estimated tokens."""
    return scanned(texts, key, text, "label string, division string, title string, start long, end long", lambda t: chunks(t, most_tokens)).withColumn("estimated_tokens", F.expr("(end - start) div 4"))


def find_amounts(refs: DataFrame, written: str, first: bool = False) -> DataFrame:
    """OP-TXT-12: references with that very text; with ``first`` the first of each text."""
    rows = refs.where(F.col("amount") == written)
    keys = [c for c in refs.columns if c not in ("ord", "position", "amount", "value")]
    return rows.groupBy(*keys).agg(F.min("position").alias("position")) if first else rows
