"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so links are pairs within epsilon. Vectors are projected on their
leading principal directions (which never lengthens a distance) and ordered by their cells of an epsilon-wide grid
there, first direction first. The order is cut into leaves of consecutive vectors. Sequence intervals are joined
recursively: a pair of intervals whose bounding boxes are more than epsilon apart is skipped as a whole, else both
are halved. The driver recurses over at most ``SPANS`` intervals, executors go on within each pair of those down to
leaves, and within a pair of leaves down to small blocks, which are compared by matrix products: in single precision
with a margin, and whatever comes near the threshold again in double precision.

Equal vectors are one class with a weight, and a leaf pair gives back counts and a spanning forest of its links, so a
large group of copies costs rows in proportion to its size. The principal directions come from a bounded sample, and
Spark's range partitioning finds the cuts; they steer the work and never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_batches, stored
from .components import components

#: Bytes of a leaf's vectors, intervals that the driver looks at, vectors that the directions are found from,
#: directions of the order and of the boxes, vectors of a block.
LEAF_BYTES, SPANS, SAMPLE, ORDER, DIRECTIONS, BLOCK = 2 << 20, 1024, 4096, 8, 32, 256


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def grid_keys(projected: np.ndarray, eps: float) -> np.ndarray:
    """Sort keys of the epsilon grid order: the cells, then the place on the first direction."""
    return np.concatenate([np.floor(projected / eps), projected[:, :1]], axis=1)


def _apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Squared distance of bounding boxes (broadcast over leading axes)."""
    gap = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0)
    return (gap * gap).sum(axis=-1)


def joined_intervals(lo: np.ndarray, hi: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs (a <= b) of sequence members whose boxes come within eps, found by recursive halving of intervals."""
    found: list[tuple[int, int]] = []
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in boxes:
            boxes[a, b] = (lo[a:b].min(axis=0), hi[a:b].max(axis=0))
        return boxes[a, b]

    stack = [((0, len(lo)), (0, len(lo)))] if len(lo) else []
    while stack:
        p, q = stack.pop()
        if p != q and _apart(*box(*p), *box(*q)) > eps * eps:
            continue
        if p[1] - p[0] == 1 and q[1] - q[0] == 1:
            found.append((p[0], q[0]))
            continue
        halves = lambda r: [r] if r[1] - r[0] == 1 else [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])]
        stack += [(x, y) for x in halves(p) for y in halves(q) if x[0] <= y[0]]
    return found


def _linked(xa: np.ndarray, xb: np.ndarray, basis: np.ndarray, eps: float, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of links between two leaves; within one leaf i < j."""
    cut = lambda x: [slice(i, min(i + BLOCK, len(x))) for i in range(0, len(x), BLOCK)]
    pa_, pb = xa @ basis, xb @ basis
    sa, sb = cut(xa), cut(xb)
    la, ha = (np.array([f(pa_[s], axis=0) for s in sa]) for f in (np.min, np.max))
    lb, hb = (np.array([f(pb[s], axis=0) for s in sb]) for f in (np.min, np.max))
    near = _apart(la[:, None], ha[:, None], lb[None], hb[None]) <= eps * eps
    fa, fb = xa.astype(np.float32), xb.astype(np.float32)
    left, right = [], []
    for u, v in zip(*np.nonzero(near), strict=True):
        if same and u > v:
            continue
        i, j = np.nonzero(fa[sa[u]] @ fb[sb[v]].T >= np.float32(cosine - 1e-4))
        i, j = i + sa[u].start, j + sb[v].start
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 100_000):
            ii, jj = i[c : c + 100_000], j[c : c + 100_000]
            ok = np.einsum("ij,ij->i", xa[ii], xb[jj]) >= cosine
            left.append(ii[ok])
            right.append(jj[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    lab = np.arange(n)
    while True:
        old = lab.copy()
        np.minimum.at(lab, i, old[j])
        np.minimum.at(lab, j, lab[i])
        lab = lab[lab]
        if (lab == old).all():
            return lab


def _name(vector: Column, salt: int) -> Column:
    """A 64-bit hash of a vector; the classes of equal names are checked by a second one."""
    return F.xxhash64(vector) if salt == 0 else F.xxhash64(F.lit(salt), vector)


def label(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, salt: int = 0) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id (smallest reachable vec_id), kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept. Shorter
    vectors count as filled up with zeros. Equal vectors link with each other, repeated rows too. A component without
    any vec_id has a null one and is kept. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    fit = F.col("e").isNotNull() & F.exists("e", lambda x: x != 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("node", F.when(F.coalesce(fit, F.lit(False)), _name(F.col("e"), salt)))
    second = _name(F.col("e"), ~salt)
    classes = stored(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("e").alias("e"), (F.min(second) != F.max(second)).alias("clash")), "vectors")
    about = classes.agg(F.count("*").alias("rows"), F.max(F.size("e")).alias("dims"), F.bool_or("clash").alias("clash")).first()
    if about.clash:  # two vectors of one name: other names for all
        drop_stored(classes)
        return label(vectors, vec_id=vec_id, embedding=embedding, cosine=cosine, salt=salt + 1)
    if about.rows:
        counts, links = _join(classes, about.rows, about.dims, cosine)
        comps = components(links)
    else:
        counts = spark.createDataFrame([], "node long, linked long")
        comps = spark.createDataFrame([], "id long, comp long")
    named = classes.select("node", "rep", "n").join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    per = named.join(lowest, "comp").join(counts, "node", "left").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(per, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _join(classes: DataFrame, count: int, dims: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Weighted link counts by node, and links that connect the same nodes as all links do."""
    spark = classes.sparkSession
    eps = (2 - 2 * cosine) ** 0.5 + 1e-9
    leaf_rows = max(1, LEAF_BYTES // (4 * dims))
    filled = lambda lists: np.array([x if len(x) == dims else [*x, *[0.0] * (dims - len(x))] for x in lists]).reshape(-1, dims)
    sample = units(filled([r.e for r in classes.orderBy("node").limit(SAMPLE).select("e").collect()]))  # nodes are hashes, so these are drawn at random
    centred = sample - sample.mean(axis=0)
    basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :DIRECTIONS].copy()
    order = [f"k{i}" for i in range(min(ORDER, basis.shape[1]) + 1)]

    def project(b: pa.RecordBatch) -> pa.RecordBatch:
        x = filled(b.column(2).to_pylist())
        keys = grid_keys(units(x) @ basis[:, :ORDER], eps)
        return pa.RecordBatch.from_arrays([*[pa.array(k) for k in keys.T], b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=[*order, "node", "n", "x"])

    def build(batches):  # noqa: ANN001, ANN202
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        part, seq, size = TaskContext.get().partitionId(), 0, 0

        def leaf() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), dtype=np.float64).reshape(-1, dims)
            p = units(x) @ basis
            blob = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
            box = lambda a: pa.array([a.tolist()], pa.list_(pa.float64()))
            single = x.astype(np.float32)
            x = single if (single.astype(np.float64) == x).all() else x
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), box(p.min(axis=0)), box(p.max(axis=0)), blob(t.column("node").to_numpy()), blob(t.column("n").to_numpy()), blob(x)], names=["leaf", "lo", "hi", "nodes", "weights", "xs"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, leaf_rows - size))
                size, at = size + held[-1].num_rows, at + held[-1].num_rows
                if size == leaf_rows:
                    yield leaf()
                    held, seq, size = [], seq + 1, 0
        if held:
            yield leaf()

    keyed = map_batches(classes.select("node", "n", "e"), project, ", ".join(f"{k} double" for k in order) + ", node long, n long, x binary")
    ordered = keyed.repartitionByRange(max(1, -(-count // (4 * leaf_rows))), *order, "node").sortWithinPartitions(*order, "node").select("node", "n", "x")
    table = stored(ordered.mapInArrow(build, "leaf long, lo array<double>, hi array<double>, nodes binary, weights binary, xs binary"), "leaves")
    pairs = stored(_leaf_pairs(table.select("leaf", "lo", "hi"), eps), "leaf-pairs")
    side = lambda s: table.select(F.col("leaf").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "xs")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").repartition(F.col("a"), F.col("b"))

    def compare(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in b.to_pylist():
            read = lambda s: (np.frombuffer(r[f"nodes_{s}"], np.int64), np.frombuffer(r[f"weights_{s}"], np.int64), _vectors(r[f"xs_{s}"], len(r[f"nodes_{s}"]) // 8, dims))
            same = r["a"] == r["b"]
            na, wa, xa = read("a")
            nb, wb, xb = (na, wa, xa) if same else read("b")
            i, j = _linked(xa, xb, basis, eps, cosine, same)
            nodes = na if same else np.concatenate([na, nb])
            j2 = j if same else j + len(na)
            linked = np.bincount(i, wb[j], len(nodes)) + np.bincount(j2, wa[i], len(nodes)) if len(i) else np.zeros(len(nodes))
            lab = _labels(len(nodes), i, j2)
            at = np.flatnonzero(linked)
            out.append(pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(linked[at].astype(np.int64)), pa.array(nodes[lab[at]])], names=["node", "linked", "root"]))
        return out

    schema = "node long, linked long, root long"

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield from compare(b)

    found = stored(both.select("a", "b", "nodes_a", "weights_a", "xs_a", "nodes_b", "weights_b", "xs_b").mapInArrow(run, schema), "vector-links")
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    return counts, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def _leaf_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of leaves whose boxes come within eps: first by spans of consecutive leaves, then within pairs of spans."""
    spark = boxes.sparkSession
    per = boxes.groupBy(F.shiftright("leaf", 32).alias("part")).count().orderBy("part").collect()  # a row for each range partition
    spans, total = [], sum(r["count"] for r in per)
    upto, step = 0, -(-total // SPANS)
    for r in per:
        spans.append((r.part, upto))
        upto += r["count"]
    numbered = boxes.join(F.broadcast(spark.createDataFrame(spans, "part long, before long")), F.shiftright("leaf", 32) == F.col("part"))
    numbered = numbered.select(F.floor((F.col("before") + F.col("leaf").bitwiseAND(0xFFFFFFFF)) / step).alias("span"), "leaf", "lo", "hi")
    grouped = stored(numbered.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("leaf", "lo", "hi"))).alias("leaves")), "spans")  # ``step`` leaves each
    ends = lambda f, c: F.aggregate(F.slice("leaves", 2, F.size("leaves")), F.col("leaves")[0][c], lambda acc, e: F.zip_with(acc, e[c], lambda x, y: f(x, y)))
    wide = grouped.select("span", ends(F.least, "lo").alias("lo"), ends(F.greatest, "hi").alias("hi")).orderBy("span").collect()  # at most SPANS rows
    near = joined_intervals(np.array([r.lo for r in wide]), np.array([r.hi for r in wide]), eps)
    near = spark.createDataFrame([(wide[a].span, wide[b].span) for a, b in near], "x long, y long")
    side = lambda s: grouped.select(F.col("span").alias(s), F.col("leaves").alias(f"leaves_{s}"))
    both = near.join(side("x"), "x").join(side("y"), "y")

    def meet(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in b.to_pylist():
            same = r["x"] == r["y"]
            leaves = r["leaves_x"] if same else r["leaves_x"] + r["leaves_y"]
            n = len(r["leaves_x"])
            found = joined_intervals(np.array([e["lo"] for e in leaves]), np.array([e["hi"] for e in leaves]), eps)
            found = [(leaves[a]["leaf"], leaves[c]["leaf"]) for a, c in found if same or a < n <= c]
            if found:
                out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"]))
        return out

    return map_batches(both.select("x", "y", "leaves_x", "leaves_y"), meet, "a long, b long")


def _vectors(blob: bytes, n: int, dims: int) -> np.ndarray:
    return units(np.frombuffer(blob, np.float32 if len(blob) == 4 * n * dims else np.float64).reshape(n, dims))
