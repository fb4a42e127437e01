"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.plans.storage import staged


def find_root(parent: dict, x):
    """Root of ``x`` with path halving; unknown nodes are their own root."""
    while (p := parent.get(x, x)) != x:
        parent[x] = x = parent.get(p, p)
    return x


def _contract(batches):
    """Replace each batch of edges by the star forest of its own components."""
    for b in batches:
        u, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        parent: dict = {}
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            x, y = find_root(parent, x), find_root(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows = [(x, find_root(parent, x)) for x in list(parent)]
        out = np.array([r for r in rows if r[0] != r[1]], dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])


#: So few edges left are settled by one task, at about 100 bytes each, instead of further rounds.
FEW = 100_000


def _settled(batches):
    """(node, component) of all edges at once."""
    parent: dict = {}
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find_root(parent, x), find_root(parent, y)
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find_root(parent, x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest reachable node.

    Null ends and self-loops are ignored, repeated edges count once, an empty table gives
    an empty table. Every round keeps at most as many edges as it got. Minima per node are pre-aggregated; the joins after them have one row of the
    minimum for each node, so where a node has very many neighbours Spark can split its rows (skew join). Each round is
    written to the shared folder, which cuts the lineage. What a round leaves is settled by one task where it is FEW edges or fewer. Rounds that have not settled after ``max_rounds``
    raise an error, as their components would be wrong."""
    e = (
        edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .mapInArrow(_contract, "u long, v long")
        .distinct()
    )
    e = staged(e, "edges")
    seen = None
    for _ in range(max_rounds):
        if seen and seen[0] <= FEW:
            return e.coalesce(1).mapInArrow(_settled, "node long, component long")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        e = staged(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
