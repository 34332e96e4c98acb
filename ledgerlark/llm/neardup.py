"""MinHash near-duplicate detection with circulant permutations, banding and exact verification.

A signature's coordinates come from two permutations of 32-bit words, sigma and pi: coordinate k is the minimum over a
document's shingles x of pi(sigma(x) + k), that is, pi circularly shifted by k. Bands of coordinates are bucket keys.

Documents of one shingle set form a class, found by a fingerprint of 128 bits. Classes that share a bucket are
candidates; a link is confirmed on the full sets. First each class is held against the smallest of its bucket, which
joins most groups of copies with one comparison per member and bucket. Only buckets that still hold several components
are looked at again: there the members outside the bucket's largest component are compared with all members of other
components, in tiles of bounded size, until links have joined them or none is left; a pair is passed over only if its
sizes, or the counts of its shingles in 256 parts, rule the similarity out for certain. Only confirmed links come out,
so no bucket is expanded into its pairs, and none that could join two components is passed over.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, map_batches, mix64, row_key, space_words, stored, utf8, without
from .components import components

BANDS, ROWS = 30, 6
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_SKETCH = "doc_id long, row long, n_shingles long, node long, second long, bands array<bigint>"
#: Members of a bucket in one tile; buckets of more are dealt.
CHUNK = 1000


def _permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit words."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted: distinct ``width``-word shingles, or all its words if there are fewer."""
    known: dict[bytes, int] = {}
    parts = [[known.setdefault(w, len(known)) for w in space_words(t)] for t in texts]
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))
    out = []
    for ids in parts:
        h = of_word[ids] if ids else of_word[:0]
        if not len(h):
            out.append(h)
            continue
        k = min(width, len(h))
        n = len(h) - k + 1
        acc = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            acc = (acc ^ h[j : j + n]) * _M[j % 5]
            acc ^= acc >> np.uint64(31)
        out.append(np.unique(mix64(acc)))
    return out


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash signature of a set."""
    base = _permute32(shingles.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty(coordinates, dtype=np.uint32)
    step = max(1, 60_000 // max(len(base), 1))
    for k in range(0, coordinates, step):
        shifts = np.arange(k, min(k + step, coordinates), dtype=np.uint32)
        out[k : k + step] = _permute32(base[None, :] + shifts[:, None], 0x21F0AAAD, 0x735A2D97).min(axis=1)
    return out


def _node(shingles: np.ndarray, salt: int) -> tuple[int, int]:
    """A set's fingerprint in two halves; the first names its class."""
    return struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest())


def sketches(docs: DataFrame, *, width: int = 5, bands: int = BANDS, rows: int = ROWS, salt: int = 0) -> DataFrame:
    """From (doc_id, text, row): set size, class (node, and the fingerprint's second half) and bucket keys."""

    def sketch(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes, seconds, keys = [], [], [], []
        band = np.arange(bands, dtype=np.uint64)
        for s in shingle_sets(utf8(b.column(1)), width):
            node, second = _node(s, salt) if len(s) else (None, None)
            sizes.append(len(s))
            nodes.append(node)
            seconds.append(second)
            if not len(s):
                keys.append(None)
                continue
            sig = signature(s, bands * rows)
            key = band
            for j in range(rows):
                key = mix64(key * _M[0] ^ sig[j::rows].astype(np.uint64))
            keys.append(key.view(np.int64))
        cols = [b.column(0), b.column(2), *[pa.array(x, pa.int64()) for x in (sizes, nodes, seconds)], pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_shingles", "node", "second", "bands"])

    return map_batches(docs, sketch, _SKETCH)


def _sets(nodes: DataFrame, docs: DataFrame, reps: DataFrame, width: int, salt: int) -> DataFrame:
    """(node, items): the shingle sets of some classes, from the text of one row of each, fetched by its key, which is
    never null; copies of a row have one key and are taken once a batch."""
    wanted = stored(nodes.distinct().join(reps, "node").select("row").distinct(), "wanted")
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "row", "left_semi").select("text")

    def build(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [s for s in shingle_sets(list(dict.fromkeys(utf8(b.column(0)))), width) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([_node(s, salt)[0] for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "items"])

    return map_batches(texts, build, "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int, salt: int) -> DataFrame:
    """Of pairs of nodes (a, b) those whose full sets are similar enough."""
    sets = stored(_sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")), docs, reps, width, salt), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("sb")), "b").select("a", "b", "sa", "sb")

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = _common(x, y)
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, verify, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _tile_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a tile's members, each confirmed on the full sets.

    Strays (members outside the bucket's largest component, ``left``) are compared with all members. A pair is looked at
    in the first band that both share, if the similarity isn't ruled out by an upper bound of its intersection (the sum
    over 256 parts of the hash space of the lesser count), and not once a link has joined its components.
    """
    rows.sort(key=lambda r: (r["n_shingles"], r["node"]))
    size = np.array([r["n_shingles"] for r in rows])
    node = np.array([r["node"] for r in rows])
    left = np.array([r["left"] for r in rows])
    stray = np.array([r["stray"] for r in rows])
    keys = np.array([r["bands"] for r in rows], dtype=np.int64)
    comp = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
    sets = [np.frombuffer(r["items"], dtype=np.uint64) for r in rows]
    parts = np.stack([np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) for x in sets])
    band = int(np.flatnonzero(keys[0] == rows[0]["key"])[0])
    found = []
    for i in np.flatnonzero(left).tolist():
        lo, hi = np.searchsorted(size, -(-size[i] * percent // 100), "left"), np.searchsorted(size, size[i] * 100 // percent, "right")
        near = lo + np.flatnonzero((comp[lo:hi] != comp[i]) & ~left[lo:hi] & (~stray[lo:hi] | (node[lo:hi] > node[i])))
        most = np.minimum(parts[near], parts[i]).sum(axis=1)
        near = near[100 * most >= percent * (size[near] + size[i] - most)]
        near = near[~(keys[near, :band] == keys[i, :band]).any(axis=1)]
        for j in near.tolist():
            if comp[j] != comp[i]:
                common = _common(sets[i], sets[j])
                if 100 * common >= percent * int(size[i] + size[j] - common):
                    found.append((rows[i]["node"], rows[j]["node"]))
                    comp[comp == comp[j]] = comp[i]
    return found


def _settled(mixed: DataFrame, about: DataFrame, percent: int, chunk_rows: int = CHUNK) -> DataFrame:
    """Links between different components inside buckets: (a, b), a spanning part of them.

    ``mixed``: (key, size, strays, main, node, comp) of buckets with several components, ``main`` being the largest;
    ``about``: (node, n_shingles, bands, items). Members and strays are dealt into chunks of ``chunk_rows``; each pair of
    a chunk of strays and one of members is a tile of its own, so no bucket meets in one task, and a large component is
    moved once per chunk of strays. Tiles stream through tasks one after the other; only confirmed links come out, fewer
    than a tile's members.
    """
    count = lambda n: F.ceil(F.col(n) / chunk_rows).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("node"), count(n)).cast("int")
    rows = mixed.withColumn("stray", F.col("comp") != F.col("main"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    one = rows.where("stray").select("key", deal("strays").alias("lo"), upto("size").alias("hi"), F.lit(True).alias("left"), "stray", "node", "comp")
    other = rows.select("key", upto("strays").alias("lo"), deal("size").alias("hi"), F.lit(False).alias("left"), "stray", "node", "comp")
    placed = one.unionByName(other).join(about, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    placed = placed.select("key", "lo", "hi", "left", "stray", "node", "comp", "n_shingles", "bands", "items")

    def run(batches):  # noqa: ANN001, ANN202
        held: list[dict] = []
        at = None

        def links() -> list[pa.RecordBatch]:
            out = _tile_links(held, percent) if len(held) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])] if out else []

        for b in batches:
            for r in b.to_pylist():
                here = (r["key"], r["lo"], r["hi"])
                if here != at:
                    yield from links()
                    held, at = [], here
                held.append(r)
        yield from links()

    return placed.mapInArrow(run, "a long, b long")


def label(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is that one).

    Linked: 100 * intersection >= ``percent`` * union of the shingle sets. Texts without words have no links and stay;
    repeated rows are copies of each other, each with its own row (and all kept if their id is the smallest); with a
    null doc_id a row is never the smallest, and a component of null ids has a null id and is kept. An empty table
    gives no rows; other columns are not read. A pair at the threshold shares no bucket with probability
    (1 - 0.85**6)**30, about 7e-7.
    """
    sketched, by_class = _grouped(docs, doc_id, text, width, percent, bands, rows)
    lowest = by_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = by_class.join(lowest, "comp").select("node", "component_id")
    out = sketched.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _members(keyed: DataFrame) -> DataFrame:
    """Of (node, key) the members of keys that several classes share, with the key's smallest (key, node, low).

    Keys of large groups are few (one for each ``CHUNK`` rows at most) and are broadcast where that many are few enough,
    so that no such group meets in one task; the rest is joined by shuffle.
    """
    shared = stored(keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1"), "shared")
    large = shared.where(F.col("n") > CHUNK).select("key", "low")
    rest = lambda rows, keys: rows.join(keys, "key").select("key", "node", "low")
    if not 0 < large.count() <= BROADCAST_IDS:
        return rest(keyed, shared)
    return rest(keyed, F.broadcast(large)).unionByName(rest(keyed.join(F.broadcast(large), "key", "left_anti"), shared))


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, bands: int, rows: int, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sketches, and of each class its smallest id, first row (the smallest id's, null last) and component (node, rep, head, comp)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row_key(doc_id, text).alias("row"))
    sketched = stored(sketches(source, width=width, bands=bands, rows=rows, salt=salt), "sketches")
    classes = sketched.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), (F.min("second") != F.max("second")).alias("clash"))
    classes = stored(classes, "classes")
    if not classes.where("clash").isEmpty():  # two sets of one 64-bit name: other names for all
        return _grouped(docs, doc_id, text, width, percent, bands, rows, salt + 1)
    reps = classes.select("node", "rep", "row")
    members = stored(_members(classes.select("node", F.explode("bands").alias("key"))), "members")
    pairs = stored(members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(_confirmed(pairs, source, reps, width, percent, salt), "links")
    comps = stored(components(links), "components")
    placed = members.join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("size"), F.max("count").alias("most"), F.count("*").alias("comps"))
    open_ = sizes.where("comps > 1").select("key", "main", "size", (F.col("size") - F.col("most")).alias("strays"))
    left = stored(placed.join(open_, "key").select("key", "size", "strays", "main", "node", "comp"), "mixed")
    if not left.isEmpty():
        about = classes.select("node", "n_shingles", "bands").join(_sets(left.select("node"), source, reps, width, salt), "node")
        more = stored(_settled(left, about, percent), "links")
        if not more.isEmpty():
            comps = stored(components(links.unionAll(more)), "components")
    by_class = classes.select("node", "rep", "head").join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return sketched, by_class


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null last, then of the smallest hash; any
    one of identical rows. A row goes by its own id and text, whatever other rows share the id; texts without words stay."""
    sketched, by_class = _grouped(docs, doc_id, text, width, percent, bands, rows)
    heads = by_class.groupBy("comp").agg(F.min("head").alias("first"))
    named = by_class.join(heads, "comp").select("node", F.col("first.row").alias("first"))
    judged = sketched.select("row", "node").join(named, "node").select("row", "first")
    key = row_key(doc_id, text)
    out = without(docs, key, judged.where("row <> first").select("row").distinct())
    again = stored(judged.where("row = first").groupBy("row").count().where("count > 1").select(F.col("row").alias("__row")), "again")
    if again.isEmpty():
        return out
    repeated = out.withColumn("__row", key).join(again, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
    return without(out, key, again).unionByName(repeated)
