"""Which texts hold which patterns (OP-JOIN-08, OP-JOIN-22): no pair is looked at unless the pattern may occur.

A small list of patterns becomes an automaton, a trie with failure arcs, that is sent to the tasks; every text then streams
past it once and meets all its patterns together. A long list is cut by prefixes instead: a pattern's first characters are
its key, the pieces of that length of each text are its keys, and both meet by a shuffle before they are compared.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns whose automaton is sent; its nodes take about a hundred times that in a worker.
SENT_BYTES = 1_000_000
#: Characters of a pattern's key; shorter patterns are their own.
PREFIX = 6


class Automaton:
    """Finds all patterns of a list in one pass over a text, after Aho and Corasick."""

    def __init__(self, patterns: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.ends, self.shorter = [0], [-1], [-1]  # shorter: the nearest state on the failure path that ends a pattern
        self.patterns = patterns
        for k, pattern in enumerate(patterns):
            at = 0
            for c in pattern:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append(-1)
                    self.shorter.append(-1)
                at = self.next[at][c]
            self.ends[at] = k
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for c, to in self.next[at].items():
                back = self._step(self.fail[at], c)
                self.fail[to] = back
                self.shorter[to] = back if self.ends[back] >= 0 else self.shorter[back]
                waiting.append(to)

    def _step(self, at: int, c: str) -> int:
        while at and c not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(c, 0)

    def found(self, text: str) -> set[str]:
        seen: set[int] = set()
        at = 0
        for c in text:
            at = self._step(at, c)
            end = at if self.ends[at] >= 0 else self.shorter[at]
            while end > 0 and self.ends[end] not in seen:  # what is seen has its shorter ones seen too
                seen.add(self.ends[end])
                end = self.shorter[end]
        return {self.patterns[k] for k in seen}


def holding(texts: DataFrame, patterns: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Rows (text, pattern) for each of the distinct texts (one column) and patterns (one column) that it holds. Empty and
    null ones are in no row."""
    texts = texts.toDF("text").where("text <> ''").distinct()
    patterns = patterns.toDF("pattern").where("pattern <> ''").distinct()
    size = patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    if size > sent_bytes:
        return _by_prefix(texts, patterns)
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r.pattern for r in patterns.collect()))  # at most sent_bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value)
        for b in batches:
            pairs = [(t, p) for t in b.column(0).to_pylist() for p in automaton.found(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], names=["text", "pattern"])

    return texts.mapInArrow(scan, "text string, pattern string")


def _by_prefix(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    keyed = patterns.withColumn("key", F.left("pattern", F.lit(PREFIX)))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.transform(F.sequence(F.lit(1), F.char_length("text")), lambda i: F.substring(F.col("text"), i, n))))
    keys = texts.select("text", F.explode(F.array_distinct(pieces)).alias("key"))
    # a pattern shorter than a key is a piece itself; the pieces of full length stand for longer patterns
    return keys.join(keyed, "key").where(F.contains("text", "pattern")).select("text", "pattern").distinct()


def either(names: DataFrame, labels: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Rows (name, label) where one holds the other."""
    inside = holding(names, labels, sent_bytes).toDF("name", "label")
    around = holding(labels, names, sent_bytes).select(F.col("pattern").alias("name"), F.col("text").alias("label"))
    return inside.unionByName(around).distinct()
