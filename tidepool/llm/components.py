"""Connected components of a link table, as repeated large-star / small-star joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import drop_stored, stored


#: links one task joins (about 200 bytes each while it does)
TASK_LINKS = 500_000


def _forest(batches):
    """Links of a partition to a spanning forest: each vertex to the least one it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(v, root(v)) for v in parent]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    for at in range(0, len(pairs), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at:at + 50_000, 0]), pa.array(pairs[at:at + 50_000, 1])], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each vertex on the least of them; ``large`` moves the greater
    neighbours, otherwise the lesser ones and the vertex itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for every vertex with a link to another: component is the least id reachable.

    Null ends and self links are passed over; repeated links count once; no link gives no row.
    Tasks of at most ``TASK_LINKS`` links each replace theirs by a spanning forest; where that takes
    more than one task, rounds of two grouped minima with joins follow, each round's result stored
    in the shared folder.  No vertex's neighbours are ever gathered in one place: hubs shrink to one
    row a task by partial minima, and a hub's join side may be split by AQE.
    """
    edges = stored(links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where(
        "u IS NOT NULL AND v IS NOT NULL AND u <> v"), "links")
    tasks = -(-edges.count() // TASK_LINKS)
    # bounded tasks take the links to spanning forests; if there is one task, its trees are whole
    forest = edges.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long")
    if tasks > 1:
        edges = stored(forest.distinct(), "links")
        state = _state(edges)
        while True:
            after = stored(_star(_star(edges, True), False), "links")
            now = _state(after)
            drop_stored(edges)
            edges = after
            if now == state:
                break
            state = now
        forest = edges
    stars = stored(forest.select(F.col("u").alias("id"), F.col("v").alias("component")), "stars")
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
