"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is good or bad. Its features are counts of character kinds and words, the lines and words it repeats, and the same of the
lines before and after it; transitions weigh neighbours' labels. Marginals of the forward-backward recursion, weighted
by line length, aggregate into the share of good text; a two-parameter logistic curve, fitted on the same labelled
documents, turns that into the document's score.

The field is fitted on at most ``SAMPLE_DOCS`` labelled documents, drawn by a hash of their ids from all allowed ones.
Only documents have labels; their lines' labels are latent, and the likelihood goes through the same aggregate that
scores. Only line features of the sample reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, map_batches, small_batches, utf8

SAMPLE_DOCS, ROUNDS, RIDGE = 4000, 80, 1e-3
_KINDS = 8  # lower, upper, digit, space, .,;:'"-()?!  |/\\_  other marks, non-ASCII
_KIND = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\r\x0b\x0c" else 4 if c in b".,;:'\"-()?!" else 5 if c in b"|/\\_<>[]{}" else 7 if c >= 128 else 6 for c in range(256)], dtype=np.uint8)
OWN = _KINDS + 9
WIDTH = 3 * OWN + 1


def lines_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all non-blank lines: own features (lines by OWN), lengths in bytes, the index of their text."""
    pieces, owner, again, before, stutter = [], [], [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        seen: set[bytes] = set()
        last = None
        for line in t.split(b"\n"):
            if line.strip():
                pieces.append(line)
                owner.append(i)
                again.append(line in seen)
                before.append(line == last)
                said = line.split()
                stutter.append(sum(map(eq, said, said[1:])) / len(said))
                seen.add(line)
                last = line
    n = len(pieces)
    if not n:
        return np.empty((0, OWN), np.float32), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b"\n".join(pieces) + b"\n", dtype=np.uint8)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    kind = _KIND[data]
    line_no = np.repeat(np.arange(n, dtype=np.int64), length + 1)
    counts = np.bincount(line_no * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    counts[np.arange(n), 6] -= 1  # the line break that was put at each end
    space = (kind == 3) | (data == 10)
    word_end = space[1:] & ~space[:-1]
    words = np.maximum(np.bincount(line_no[:-1][word_end], minlength=n), 1)
    twice = np.bincount(line_no[1:][(data[1:] == data[:-1]) & (kind[1:] >= 4) & (kind[1:] <= 6)], minlength=n)
    after_mark = np.bincount(line_no[1:][(kind[1:] == 3) & (kind[:-1] >= 5) & (kind[:-1] <= 6)], minlength=n)
    own = np.empty((n, OWN), dtype=np.float32)
    own[:, :_KINDS] = counts / np.maximum(length, 1)[:, None]
    own[:, 8] = np.log1p(words)
    own[:, 9] = np.minimum(length / words, 30) / 10
    own[:, 10] = np.minimum(twice / words, 2)
    own[:, 11] = np.minimum(after_mark / words, 2)
    own[:, 12] = again
    own[:, 13] = before
    own[:, 14] = np.isin(data[start + length - 1], np.frombuffer(b".!?", dtype=np.uint8))
    own[:, 15] = words <= 3
    own[:, 16] = stutter
    return own, length, np.array(owner, dtype=np.int64)


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Features of each line, its predecessor and its successor in the document (zeros at the ends), and a constant."""
    x = np.zeros((len(own), WIDTH), dtype=np.float64)
    x[:, :OWN] = own
    same = owner[1:] == owner[:-1]
    x[1:, OWN : 2 * OWN][same] = own[:-1][same]
    x[:-1, 2 * OWN : 3 * OWN][same] = own[1:][same]
    x[:, -1] = 1
    return x


def marginals(emit: np.ndarray, trans: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all documents side by side, in log space.

    ``emit``: log-potential of *good* over *bad* per line; ``trans``: 2 by 2 log-potentials. Gives P(good) per line,
    the expected counts of transitions and the sum of log-partitions.
    """
    docs, first, length = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), "left")  # documents longer than t
    unary = np.stack([np.zeros_like(emit), emit], axis=1)
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    for t in range(steps):
        at = first[: live[t]] + t
        alpha[at] = unary[at] if t == 0 else unary[at] + np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1])
    expected = np.zeros((2, 2))
    end = first + length - 1
    log_z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    for t in range(steps - 2, -1, -1):
        at = first[: live[t + 1]] + t
        nxt = unary[at + 1] + beta[at + 1]
        pair = alpha[at][:, :, None] + trans[None] + nxt[:, None, :]
        expected += np.exp(pair - log_z[: live[t + 1], None, None]).sum(axis=0)
        both = trans[None] + nxt[:, None, :]
        beta[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
    total = alpha + beta
    return np.exp(total[:, 1] - np.logaddexp(total[:, 0], total[:, 1])), expected, float(log_z.sum())


@dataclass
class Field:
    """Fitted weights; ``centre`` and ``scale`` standardise the features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]  # intercept and slope over the log-odds of the good share

    def good_share(self, own: np.ndarray, length: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Length-weighted mean marginal per text; NaN for texts without lines."""
        share = np.full(texts, np.nan)
        if len(own):
            p, _, _ = marginals((with_neighbours(own, owner) - self.centre) / self.scale @ self.weights, self.trans, owner)
            size = np.bincount(owner, length, texts)
            some = size > 0
            share[some] = (np.bincount(owner, length * p, texts)[some]) / size[some]
        return share

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        share = np.clip(self.good_share(*lines_of(texts), len(texts)), 1e-6, 1 - 1e-6)
        scores = 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log(share / (1 - share)))))
        return np.where(np.isnan(scores), 0.5, scores)


def fit(own: np.ndarray, length: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> Field:
    """Penalised maximum likelihood of the documents' labels (of each text) by Adam, through the aggregate: the lines'
    labels are latent, and a document's probability is its length-weighted share of good text. Documents weigh alike."""
    blank = Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), (0.0, 0.0))
    if not len(own):
        return blank
    x = with_neighbours(own, owner)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    centre[-1], scale[scale < 1e-9] = 0, 1
    x = (x - centre) / scale
    docs, weight = len(labels), length / np.maximum(np.bincount(owner, length, len(labels)), 1)[owner]
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, ROUNDS + 1):
        emit = x @ w
        p, _, _ = marginals(emit, trans, owner)
        share = np.clip(np.bincount(owner, weight * p, docs), 1e-3, 1 - 1e-3)
        # how the log-likelihood of its document's label changes with each line's marginal
        pull = ((labels - share) / (share * (1 - share)))[owner] * weight
        # its gradient is a covariance under the field: the slope of the marginals as potentials are tilted by ``pull``
        tilt = 1e-3 / max(float(np.abs(pull).max()), 1e-9)
        (up, up_pairs, _), (down, down_pairs, _) = (marginals(emit + e * pull, trans, owner) for e in (tilt, -tilt))
        slope, pairs = (up - down) / (2 * tilt), (up_pairs - down_pairs) / (2 * tilt)
        grad = np.concatenate([x.T @ slope, pairs.ravel()]) / docs - RIDGE * np.concatenate([w, 10 * trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:WIDTH], trans + move[WIDTH:].reshape(2, 2)
    field = Field(centre, scale, w, trans, (0.0, 1.0))
    has = np.unique(owner)
    share = np.clip(field.good_share(own, length, owner, len(labels))[has], 1e-6, 1 - 1e-6)
    z, target = np.log(share / (1 - share)), labels[has].astype(np.float64)
    a, b = 0.0, 0.5
    for _ in range(50):  # Newton steps, lightly penalised
        q = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        g = np.array([(target - q).sum() - a * 1e-2, ((target - q) * z).sum() - b * 1e-2])
        r = q * (1 - q)
        h = np.array([[r.sum() + 1e-2, (r * z).sum()], [(r * z).sum(), (r * z * z).sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -5, 5)), b + float(np.clip(db, -5, 5))
    field.curve = (a, b)
    return field


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit on at most ``sample_docs`` labelled rows that aren't held out. Conflicting labels of a document: the lower."""
    marked = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    drawn = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "quality")

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        own, length, owner = lines_of(utf8(b.column(0)))
        at = np.searchsorted(owner, np.arange(b.num_rows + 1))
        cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([cut(own), cut(length), b.column(1)], names=["own", "length", "quality"])

    with small_batches(docs.sparkSession, BATCH_ROWS):
        got = map_batches(rows, features, "own binary, length binary, quality int").collect()
    got.sort()
    parts = [np.frombuffer(r.own, np.float32).reshape(-1, OWN) for r in got]
    own = np.concatenate(parts) if parts else np.empty((0, OWN), np.float32)
    length = np.frombuffer(b"".join(r.length for r in got), np.int64)
    return fit(own, length, np.repeat(np.arange(len(got)), [len(p) for p in parts]), np.array([r.quality for r in got]))


def scored(docs: DataFrame, field: Field, *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column of scores; all other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(utf8(b.column(at))), pa.float64())], names=[*b.schema.names, score])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted.

    Null, empty and blank texts score 0.5; without labels every text does. Repeated rows get a row each; a null doc_id
    is not held out; an empty table gives no rows. Labels and other columns are no inputs of a score.
    """
    field = learn(docs, labels, doc_id=doc_id, text=text, **options)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return scored(rows, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The documents that aren't rejected (score of 0.5 or more), with the columns they came with.

    Null, empty and blank texts score 0.5 and stay.
    """
    field = learn(docs, labels, **options)
    name = "score" if "score" not in docs.columns else "__score"
    return scored(docs, field, text=options.get("text", "text"), score=name).where(F.col(name) >= 0.5).drop(name)
