"""Bill XML to text, divisions, chunks and counts (OP-SRC-14 to 16, OP-TXT-09/11), read as a stream.

A table function feeds each document to the standard parser piece by piece and yields its parts as they end: what comes
before the first division, divisions, their titles (cut at sections where too long), what comes after them, and last a row
on the bill. It holds the text of one division at a time and never a tree. Offsets, the full text and chunks are then
running sums and lists over the parts.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_LINE = {"appropriations-major", "appropriations-intermediate", "appropriations-small"}
_NEW_LINE = {"division", "title", "section"}
_PIECE = 1 << 20
PART = "ord long, kind string, label string, division string, title string, text string, accounts long, identifier string, short_title string, divisions array<struct<letter:string,title:string>>, error string"


def cleaned(text: str) -> str:
    """OP-STR-14: single spaces, at most one blank line, trimmed."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text))).strip()


def _tokens(text: str) -> int:
    return len(text.encode()) // 4


class _Text:
    """OP-TXT-09: text as it comes, with quotes marked, headers and accounts on lines of their own, and sections numbered."""

    def __init__(self) -> None:
        self.out: list[str] = []

    def put(self, s: str) -> None:
        if s:
            self.out.append(s)

    def fresh(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def before(self, tag: str, parent: str) -> None:
        if tag == "quote":
            self.put("''")
        elif tag == "enum" and parent == "section":
            self.fresh()
            self.put("SEC. ")
        elif tag == "header" or tag in _OWN_LINE or tag in _NEW_LINE:
            self.fresh()

    def after(self, tag: str) -> None:
        if tag == "quote":
            self.put("''")
        elif tag == "enum":
            self.put(" ")
        elif tag == "header":
            self.put("\n")
        elif tag in _OWN_LINE:
            self.fresh()

    def since(self, start: int, end: int | None = None) -> str:
        return cleaned("".join(self.out[start:end]))


class _Reader:
    """Target of the parser. ``parts`` holds what has ended: (kind, label, division, title, text, accounts)."""

    def __init__(self, most_tokens: int) -> None:
        self.most, self.parts, self.stack = most_tokens, [], []
        self.body, self.bodies, self.text, self.marks = 0, 0, _Text(), []
        self.accounts, self.all_accounts, self.numeral, self.after_division = 0, 0, None, False
        self.found: dict[str, str] = {}
        self.listed, self.contents, self.inner = [], [], []  # divisions by element, by table of contents, and open ones

    # what the parser calls

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        parent, depth = self.stack[-1][0] if self.stack else "", len(self.stack) + 1
        named = tag in ("legis-num", "short-title") and tag not in self.found or tag == "toc-entry" and attributes.get("level") == "division"
        first = tag in ("enum", "header") and parent == "division" and tag not in self.inner[-1]
        self.stack.append((tag, [] if named or first else None))
        if tag == "division":
            self.inner.append({})
        if tag == "legis-body":
            self.bodies += 1
            if self.bodies == 1:
                self.body = depth
        elif self.body:
            self._opened(tag, parent, depth - self.body)

    def data(self, text: str) -> None:
        for _, kept in self.stack:
            if kept is not None:
                kept.append(text)
        if self.body:
            self.text.put(text)

    def end(self, tag: str) -> None:
        _, kept = self.stack.pop()
        depth = len(self.stack) + 1
        if kept is not None:
            said = "".join(kept)
            if tag == "toc-entry":
                self.contents.append(" ".join(said.split()))
            elif tag in ("enum", "header"):
                self.inner[-1][tag] = " ".join(said.split())
            else:
                self.found.setdefault(tag, said.strip())
        if tag == "division":
            self.listed.append(self.inner.pop())
        if tag == "legis-body" and depth == self.body:
            self._ended()
            self.body = 0
        elif self.body:
            self._closed(tag, depth - self.body)

    # the body's own children are at depth 1, a division's at 2, a title's at 3

    def _opened(self, tag: str, parent: str, depth: int) -> None:
        if depth == 1 and tag == "division":
            if not self.after_division:
                self._preamble()
            self.after_division = True
        if depth == 1 and self.after_division:
            self.text, self.marks, self.accounts = _Text(), [], 0
        else:
            self.text.before(tag, parent)
        if tag == "appropriations-small":
            self.accounts += 1
            self.all_accounts += 1
        if depth == (2 if self.after_division else 1):
            self.marks.append([tag, len(self.text.out), None, None])
        elif depth == 3 and self.after_division and tag == "enum" and parent == "title" and self.marks[-1][3] is None:
            self.numeral = len(self.text.out)

    def _closed(self, tag: str, depth: int) -> None:
        if depth == (2 if self.after_division else 1):
            self.marks[-1][2] = len(self.text.out)
        elif depth == 3 and self.numeral is not None and tag == "enum":
            self.marks[-1][3], self.numeral = self.text.since(self.numeral), None
        if depth == 1 and self.after_division:
            if tag == "division":
                self._division()
            elif rest := self.text.since(0):
                self.parts.append(("rest", None, "", "", rest + "\n", self.accounts))
            return
        self.text.after(tag)

    def _preamble(self) -> None:
        joined = cleaned("".join(f"{x}\n" for _, a, b, _ in self.marks if (x := self.text.since(a, b))))
        if joined:
            self.parts.append(("preamble", None, "", "", joined + "\n", self.accounts))

    def _division(self) -> None:
        letter = next((self.text.since(a, b) for tag, a, b, _ in self.marks if tag == "enum"), "")
        whole = self.text.since(0)
        if _tokens(whole) <= self.most or all(tag != "title" for tag, *_ in self.marks):
            self.parts.append(("division", letter, letter, "", whole + "\n", self.accounts))
            return
        count = self.accounts
        for tag, a, b, numeral in self.marks:
            own, numeral = self.text.since(a, b), numeral or ""
            if tag == "title":
                label = f"{letter}-{numeral}"
                cuts = [(label, own + "\n")] if _tokens(own) <= self.most else at_sections(own, label, self.most)
                self.parts += [("title", name, letter, numeral, text, 0) for name, text in cuts]
            elif own and tag in ("enum", "header"):
                self.parts.append(("heading", None, letter, "", own + "\n", 0))
            elif own:
                self.parts.append(("section", letter, letter, "", own + "\n", 0))
        kind, label, division, title, text, _ = self.parts[-1]
        self.parts[-1] = (kind, label, division, title, text, count)  # the division's accounts, with its last part

    def _ended(self) -> None:
        if not self.after_division:
            self.parts.append(("full", "full", "", "", self.text.since(0), self.accounts))

    def close(self) -> None:
        pass

    def divisions(self) -> list[dict[str, str]]:
        """OP-SRC-15: letter and title of divisions, else of the table of contents."""
        named = [{"letter": d["enum"].rstrip("."), "title": d.get("header", "")} for d in self.listed if d.get("enum")]
        entries = (re.match(r"Division\s+([A-Z])\s*[—–-]+\s*(.+)", e) for e in self.contents)
        return named or [{"letter": m[1], "title": m[2].strip()} for m in entries if m]


def at_sections(text: str, label: str, most_tokens: int) -> list[tuple[str, str]]:
    """A long title in pieces that end before a section, once they are over the limit; labels get a letter each."""
    starts, at, out = [m.start() + 1 for m in re.finditer("\nSEC\\. ", text)], 0, []
    for s in starts:
        if len(text[at:s].encode()) > most_tokens * 4:
            out.append(text[at:s])
            at = s
    out.append(text[at:] + "\n")
    return [(label if len(out) == 1 else label + chr(ord("a") + k), x) for k, x in enumerate(out)]


def parts(raw: str, most_tokens: int = 3000) -> Iterator[tuple]:
    """A bill's parts as rows of ``PART``: in order from 1 as they end, then the row on the bill, whose text stands first (0)."""
    reader, n = _Reader(most_tokens), 0
    parser = ET.XMLParser(target=reader)
    raw = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?\s*>", "", raw)  # its entities aren't loaded
    for at in range(0, len(raw), _PIECE):
        parser.feed(raw[at : at + _PIECE])
        for kind, label, division, title, text, accounts in reader.parts:
            n += 1
            yield (n, kind, label, division, title, text, accounts, None, None, None, None)
        reader.parts.clear()
    parser.close()
    if not reader.bodies:
        raise ValueError("no legis-body in the bill")
    name, title = reader.found.get("legis-num") or "", reader.found.get("short-title") or None
    head = "".join(f"{x}\n" for x in (name, title) if x)
    yield (0, "bill", None, "", "", head + "\n" if head else "", reader.all_accounts, name, title, [(d["letter"], d["title"]) for d in reader.divisions()], None)


class _BillParts:
    """The table function: rows of ``parts``, and a row of kind ``error`` where a document can't be read."""

    def eval(self, content: bytes, most_tokens: int):  # noqa: ANN201
        try:
            yield from parts(content.decode(), most_tokens)
        except (ET.ParseError, ValueError) as e:  # undecodable bytes too
            yield (-1, "error", None, None, None, None, None, None, None, None, str(e))


def bill_parts(spark: SparkSession, root: str, most_tokens: int = 3000) -> DataFrame:
    """All ``BILLS-*.xml`` below ``root`` in parts: path, bill_dir and ``PART``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "BILLS-*.xml").load(root)
    table = F.udtf(_BillParts, returnType=PART)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("bill_dir"), "content").lateralJoin(table(F.col("content").outer(), F.lit(most_tokens))).drop("content")


def _spans(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = F.octet_length("text").cast("long")
    at = F.coalesce(F.sum(own).over(before), F.lit(0))
    return rows.withColumns({"start": F.when(F.col("kind") == "full", 0).otherwise(at), "end": at + own})


def placed(rows: DataFrame) -> DataFrame:
    """Parts with the bytes of the full text that each takes: start, end, estimated_tokens. A bill without divisions is one
    chunk from its first byte on."""
    return _spans(rows.where("kind != 'error'")).withColumn("estimated_tokens", F.expr("(end - start) div 4"))


def chunks(rows: DataFrame) -> DataFrame:
    """What is extracted on its own: a row a labelled part, with ``chunk`` from 1."""
    order = Window.partitionBy("path").orderBy("ord")
    named = placed(rows).where(F.col("label").isNotNull())
    return named.select("path", "bill_dir", F.row_number().over(order).alias("chunk"), "label", "division", "title", "start", "end", "estimated_tokens", "text")


def bills(spark: SparkSession, root: str, most_tokens: int = 3000) -> DataFrame:
    """OP-SRC-14/15: a row for each document, with its full text; documents that can't be read come with their error alone."""
    own = F.when(F.col("kind") == "bill", F.struct("identifier", "short_title", "accounts", "divisions"))
    chunk = F.when(F.col("label").isNotNull(), F.struct("ord", F.struct("label", "division", "title", "start", "end").alias("chunk")))
    whole = _spans(bill_parts(spark, root, most_tokens)).groupBy("path", "bill_dir").agg(
        F.max("error").alias("error"),
        F.first(own, ignorenulls=True).alias("b"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("full_text"),
        F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["chunk"]).alias("chunks"),
        F.rtrim(F.coalesce(F.max(F.when(F.col("kind") == "preamble", F.col("text"))), F.lit("")), F.lit("\n")).alias("preamble"),
    )
    good = {"identifier": "b.identifier", "short_title": "b.short_title", "full_text": "full_text", "preamble": "preamble", "accounts": "b.accounts", "divisions": "b.divisions", "chunks": "chunks"}
    return whole.select("bill_dir", *(F.when(F.col("error").isNull(), F.col(c)).alias(name) for name, c in good.items()), "error")


def accounts_by_division(rows: DataFrame) -> DataFrame:
    """How many accounts each division's markup has, in order of the divisions."""
    return rows.where(F.col("kind").isin("division", "title", "heading", "section")).groupBy("path", "bill_dir", "division").agg(F.min("ord").alias("ord"), F.sum("accounts").alias("accounts"))


def page_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Text and paragraph count of pages by expressions alone: markup, scripts and styles removed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select(key, F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"), F.regexp_count(F.col(html), F.lit(r"(?i)<p[ >]")).alias("paragraphs"))
