"""Epsilon grid order join of embeddings by cosine.

Unit vectors with cosine c or more lie within eps = sqrt(2 - 2c). Vectors are projected on leading
principal axes, cut into cells of width eps, and sorted by cell; the sorted sequence is dealt to
blocks that fit a task. Intervals of blocks are joined recursively as tables: a pair of intervals
goes on only if the boxes of both, on the principal axes and the length of what the axes leave, are within eps. At the bottom are pairs of blocks; a task
goes on with halves of their sequences in the same way, down to intervals of LEAF vectors. There the product on the axes plus the product of the
lengths left bounds the cosine, and what it lets pass is compared in double precision. Equal vectors are one vector with a weight, so copies cost nothing.

How much is skipped depends on the vectors: with clusters, most pairs of blocks; with directions spread evenly over many dimensions
no box is far from another, and all pairs of blocks are visited, of which the bound then drops most."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.session import plain, prepare, table
from evidara.llm.words import give_back
from evidara.operators.components import connected_components
from evidara.plans.storage import staged

MIN_COSINE, DIMENSIONS = 0.95, 16
#: Vectors of a block, about: what a task holds twice. Vectors of the smallest interval in a task. Intervals that one interval is cut into, among tables.
BLOCK, LEAF, FAN = 16_384, 64, 8
#: Rows used to find the principal axes; they only steer the order, never the result.
AXES_SAMPLE = 20_000
#: Allowed for rounding in bounds; decisions are made without it.
SLACK = 1e-9


def _unit(batches):
    """Rows whose vector is usable, as bytes of float64 unit components; ``key`` groups equal vectors."""
    for b in batches:
        vecs = b.column("embedding").to_pylist()
        keep, raw, units = [], [], []
        for i, v in enumerate(vecs):
            if not v or any(x is None for x in v):
                continue
            a = np.array(v, dtype=np.float64)
            most = np.abs(a).max()
            if not np.isfinite(most) or most == 0:
                continue
            unit = a / most
            keep.append(i)
            raw.append((a + 0.0).tobytes())  # no negative zeros
            units.append((unit / np.sqrt(unit @ unit)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "key", "unit"])


def _axes(sample: list[bytes], dims: int) -> np.ndarray:
    """Leading principal axes by the most common width of the sample, as a matrix of columns."""
    width = max({len(x) for x in sample}, key=[len(x) for x in sample].count)
    x = np.stack([np.frombuffer(s) for s in sample if len(s) == width])
    _, vectors = np.linalg.eigh(np.cov(x.T) if x.shape[0] > 1 and x.shape[1] > 1 else np.eye(x.shape[1]))
    return vectors[:, ::-1][:, :dims]


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and last the length of what they leave. The axes are of another width: no coordinates."""
    if x.shape[1] != len(axes):
        return np.concatenate([np.zeros((len(x), axes.shape[1])), np.ones((len(x), 1))], axis=1)
    y = x @ axes
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)


def _project(axes: np.ndarray, eps: float):
    """Width, coordinates and cells of each vector."""

    def run(batches):
        for b in batches:
            units = [np.frombuffer(u)[None] for u in b.column("unit").to_pylist()]
            y = np.concatenate([np.zeros((0, axes.shape[1] + 1)), *(coordinates(u, axes) for u in units)])
            cells = np.floor(y[:, :-1] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("weight"), b.column("unit"), pa.array([u.shape[1] for u in units], pa.int32()), pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(y), pa.list_(pa.float64()))],
                names=["vec_id", "weight", "unit", "width", "cells", "y"],
            )

    return run


class Sequence:
    """Vectors of one width in grid order, with the boxes of its intervals: level 0 has those of LEAF vectors, each next one those of two."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, axes: np.ndarray, eps: float):
        y = coordinates(x, axes)
        order = np.lexsort((ids, *np.floor(y[:, -2::-1] / eps).T))
        self.ids, self.weight, self.x, self.y = ids[order], weight[order], x[order], y[order]
        starts = np.arange(0, len(ids), LEAF)
        self.boxes = [(np.minimum.reduceat(self.y, starts), np.maximum.reduceat(self.y, starts))]
        while len(self.boxes[-1][0]) > 1:
            lo, hi = self.boxes[-1]
            two = np.arange(0, len(lo), 2)
            self.boxes.append((np.minimum.reduceat(lo, two), np.maximum.reduceat(hi, two)))

    def box(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self.boxes[min(level, len(self.boxes) - 1)]


def near_leaves(p: Sequence, q: Sequence, same: bool, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of smallest intervals that may hold a link: from both whole sequences down, intervals are halved and distant pairs are left."""
    a = b = np.zeros(1, dtype=np.int64)
    for level in range(max(len(p.boxes), len(q.boxes)) - 1, -1, -1):
        if level < max(len(p.boxes), len(q.boxes)) - 1:
            da, db = level < len(p.boxes) - 1, level < len(q.boxes) - 1
            a, b = (np.concatenate([(1 + da) * a + i for i in range(1 + da) for _ in range(1 + db)]), np.concatenate([(1 + db) * b + j for _ in range(1 + da) for j in range(1 + db)]))
        (alo, ahi), (blo, bhi) = p.box(level), q.box(level)
        inside = (a < len(alo)) & (b < len(blo))
        if same:
            inside &= a <= b
        a, b = a[inside], b[inside]
        total = np.zeros(len(a))
        for d in range(alo.shape[1]):
            gap = np.maximum(0, np.maximum(alo[a, d] - bhi[b, d], blo[b, d] - ahi[a, d]))
            total += gap * gap
        near = total <= (eps + SLACK) ** 2
        a, b = a[near], b[near]
    return a, b


def linked(p: Sequence, q: Sequence, same: bool, eps: float, min_cosine: float):
    """(rows of p, rows of q) that link, an interval of p at a time."""
    a, b = near_leaves(p, q, same, eps)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    cut = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)] if len(a) else []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        rows = np.arange(a[lo] * LEAF, min((a[lo] + 1) * LEAF, len(p.ids)))
        others = (b[lo:hi, None] * LEAF + np.arange(LEAF)).ravel()
        others = others[others < len(q.ids)]
        may = p.y[rows] @ q.y[others].T >= min_cosine - SLACK
        if same:
            may &= rows[:, None] < others[None]
        i, j = np.nonzero(may)
        if 8 * len(i) > may.size:
            i, j = np.nonzero(may & (p.x[rows] @ q.x[others].T >= min_cosine))
        elif len(i):
            ok = np.concatenate([np.einsum("ij,ij->i", p.x[rows[i[k : k + 8192]]], q.x[others[j[k : k + 8192]]]) >= min_cosine for k in range(0, len(i), 8192)])
            i, j = i[ok], j[ok]
        if len(i):
            yield rows[i], others[j]


class Forest:
    """Which vectors are joined so far, and the links that joined them."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links (i, j), sorted by i."""
        new = self.label[i] != self.label[j]
        i, j = i[new], j[new]
        for k in np.unique(i).tolist():
            mine = j[np.searchsorted(i, k) : np.searchsorted(i, k, side="right")]
            found, at = np.unique(self.label[mine], return_index=True)
            other = found != self.label[k]
            if other.any():
                self.edges += [(k, int(x)) for x in mine[at[other]].tolist()]
                self.label[np.isin(self.label, found[other])] = self.label[k]


def _sequences(t: pa.Table, side: int, axes: np.ndarray, eps: float) -> dict[int, Sequence]:
    t = t.filter(pa.compute.equal(t["side"], side))
    if not t.num_rows:
        return {}
    ids, weight = t["vec_id"].to_numpy(), t["weight"].to_numpy()
    raw = t["unit"].combine_chunks()
    width = pa.compute.binary_length(raw).to_numpy()
    return {int(w): Sequence(ids[width == w], weight[width == w], np.frombuffer(b"".join(raw.filter(pa.array(width == w)).to_pylist())).reshape(-1, int(w) // 8), axes, eps) for w in np.unique(width)}


def _compare(min_cosine: float, eps: float, shared):
    """Links of one vector with the other block (both with itself), summed, and a spanning forest of the links found."""

    def run(t: pa.Table) -> pa.Table:
        axes = shared.value
        a, b = _sequences(t, 0, axes, eps), _sequences(t, 1, axes, eps)
        same = not b
        ids, count, us, vs = [], [], [], []
        for w, p in a.items():
            q = p if same else b.get(w)
            if q is None:
                continue
            shift = 0 if same else len(p.ids)
            n = np.zeros(len(p.ids) + (0 if same else len(q.ids)))
            forest = Forest(len(n))
            for i, j in linked(p, q, same, eps, min_cosine):
                n += np.bincount(i, weights=q.weight[j], minlength=len(n)) + np.bincount(j + shift, weights=p.weight[i], minlength=len(n))
                forest.join(i, j + shift)
            every = p.ids if same else np.concatenate([p.ids, q.ids])
            some = np.flatnonzero(n)
            ids, count = [*ids, every[some]], [*count, n[some]]
            e = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
            us, vs = [*us, every[e[:, 0]]], [*vs, every[e[:, 1]]]
        flat = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts]).astype(np.int64)
        ids, count, us, vs = flat(ids), flat(count), flat(us), flat(vs)
        other = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(vs)])
        give_back()
        return pa.table({"vec_id": pa.array(np.concatenate([ids, us])), "n": pa.array(np.concatenate([count, np.zeros(len(us), dtype=np.int64)])), "other": other})

    return run


def block_pairs(boxes: DataFrame, count: int, eps: float, dims: int) -> DataFrame:
    """(a, b) with a <= b of the blocks that may hold a link: from the whole sequence down, each interval is cut into FAN parts."""
    top = 0
    while FAN**top < count:
        top += 1

    def sided(k: int, s: str) -> DataFrame:
        lo = F.array(*[F.min(F.col("lo")[i]) for i in range(dims)]).alias(f"{s}_lo")
        hi = F.array(*[F.max(F.col("hi")[i]) for i in range(dims)]).alias(f"{s}_hi")
        node = F.floor(F.col("block") / FAN**k).cast("long").alias(s)
        return boxes.groupBy(node).agg(lo, hi, F.min("w_lo").alias(f"{s}_wlo"), F.max("w_hi").alias(f"{s}_whi"))

    total = F.lit(0.0)
    for i in range(dims):
        gap = F.greatest(F.lit(0.0), F.col("a_lo")[i] - F.col("b_hi")[i], F.col("b_lo")[i] - F.col("a_hi")[i])
        total = total + gap * gap
    near = (total <= (eps + SLACK) ** 2) & (F.col("a_wlo") <= F.col("b_whi")) & (F.col("b_wlo") <= F.col("a_whi"))
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    part = lambda s: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: FAN * F.col(s) + i)).alias(s)
    for k in range(top - 1, -1, -1):
        down = pairs.select(part("a"), "b").select("a", part("b")).where("a <= b")
        pairs = staged(down.join(sided(k, "a"), "a").join(sided(k, "b"), "b").where(near).select("a", "b"), "pairs")
    return pairs


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK, dims: int = DIMENSIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different widths. Rows with equal vectors link with each other. Rows that repeat a vec_id count as vectors each. A null
    vec_id is left out, as it cannot be named. An empty table gives an empty table; other
    columns are ignored."""
    prepare(vectors.sparkSession, 4096)
    v = plain(vectors, "vec_id", "embedding").where("vec_id is not null")
    eps = math.sqrt(2 - 2 * min_cosine)
    usable = staged(v.mapInArrow(_unit, "vec_id long, key binary, unit binary"), "unit")
    every = v.select("vec_id")
    one = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("unit").alias("unit"))
    one = one.select(F.col("rep").alias("vec_id"), "weight", "unit", "key")
    n = one.count()
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = [bytes(r[0]) for r in one.select("unit").orderBy(F.xxhash64("vec_id")).limit(AXES_SAMPLE).collect()]
    axes = _axes(sample, dims)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    pieces = max(1, math.ceil(n / block))
    spread = one.select("vec_id", "weight", "unit").mapInArrow(_project(axes, eps), "vec_id long, weight long, unit binary, width int, cells array<int>, y array<double>")
    # Partitions by range follow the grid order, so their numbers are places in the sequence; neighbours among them make a block.
    dealt = spread.repartitionByRange(pieces, "width", "cells", "vec_id").select("vec_id", "weight", "unit", "width", "y", F.spark_partition_id().alias("part"))
    dealt = staged(dealt, "dealt")
    parts = dealt.agg(F.max("part")).first()[0] + 1
    held = dealt.withColumn("block", F.floor(F.col("part") * pieces / parts).cast("long"))
    dims = axes.shape[1] + 1
    boxes = held.groupBy("block").agg(
        F.array(*[F.min(F.col("y")[i]) for i in range(dims)]).alias("lo"), F.array(*[F.max(F.col("y")[i]) for i in range(dims)]).alias("hi"), F.min("width").alias("w_lo"), F.max("width").alias("w_hi")
    )
    pairs = block_pairs(staged(boxes, "boxes"), pieces, eps, dims)
    held = held.select("block", "vec_id", "weight", "unit")
    left = pairs.join(held, F.col("a") == F.col("block")).select("a", "b", F.lit(0).alias("side"), "vec_id", "weight", "unit")
    right = pairs.where("a < b").join(held, F.col("b") == F.col("block")).select("a", "b", F.lit(1).alias("side"), "vec_id", "weight", "unit")
    found = staged(left.unionByName(right).groupBy("a", "b").applyInArrow(_compare(min_cosine, eps, shared), "vec_id long, n long, other long"), "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other is not null"), "vec_id", "other").select(F.col("node").alias("rep"), "component")
    reps = one.select(F.col("vec_id").alias("rep"), "weight", "key").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(parts, "rep", "left")
    reps = reps.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    mine = usable.select("vec_id", "key").join(reps, "key").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(mine, "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def op10_embedding_join(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
