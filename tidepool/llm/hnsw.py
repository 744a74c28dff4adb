"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Vectors are comparable within a label (and dimension).  A label's vectors are dealt into shards of
bounded size by hash; each shard builds its graph in one task and audits it: planted queries, near
its own vectors at just above the threshold, must find what brute force over the shard finds, query
by query and in small groups as in large ones, or the beam is widened and the audit repeated; a shard
that fails with its widest beam is searched by brute force.  Then every vector queries every shard of its label in
blocks; what the beams find is verified by cosine in double precision, counted, and joined into
components.  A block reports a spanning forest of its links, never the pairs.

Equal vectors of a label are one class: its least vec_id is indexed and queries for all of them, and
counts for as many, so a vector that very many rows hold costs one search a shard.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import batch_rows, own_columns, settled, stored
from tidepool.llm.components import connected_components

#: vectors of a graph, and queries that one copy of it serves: no fewer, so that copies are no more than what is asked
SHARD, BLOCK = 8192, 8192
M, EF_BUILD, EF_START = 12, 40, 32
AUDIT, AUDIT_RECALL = 96, 0.99
SLACK = 8
MIN_INTO = 4
WALK = 0.05


def unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    # a power of two takes each row near 1 first, so that no square overflows or vanishes
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Layered neighbour lists over unit vectors; level 0 is an array, upper levels are dicts."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.near = np.zeros((n, 2 * M + SLACK), np.int32)
        self.count = np.zeros(n, np.int32)
        self.upper: list[dict[int, list[int]]] = []
        self.entry = 0
        self.ef = EF_START
        self.exact = False

    def build(self, ids: list[int]) -> Graph:
        for k, i in enumerate(ids):
            draw = (xxhash.xxh64_intdigest(str(i).encode()) + 1) / 2.0 ** 64
            self._insert(k, int(-np.log(draw) / np.log(M)))
        self._repair()
        return self

    def _repair(self) -> None:
        """Nodes that pruning left with hardly a link to them get links back from their neighbours."""
        rows = np.arange(self.near.shape[1])[None, :] < self.count[:, None]
        into = np.bincount(self.near[rows], minlength=len(self.x))
        for node in np.flatnonzero(into < MIN_INTO).tolist():
            for k in self.near[node, :self.count[node]].tolist():
                n = self.count[k]
                if into[node] >= MIN_INTO:
                    break
                if n < self.near.shape[1] and node not in self.near[k, :n]:
                    self.near[k, n] = node
                    self.count[k] = n + 1
                    into[node] += 1

    def _links(self, node: int, level: int):
        return self.near[node, :self.count[node]] if level == 0 else np.array(self.upper[level - 1].get(node, ()), np.int64)

    def _beam(self, q: np.ndarray, start: list[int], ef: int, level: int, floor: float = 2.0) -> list[tuple[float, int]]:
        """The ef nearest found, and whatever else was found at ``floor`` or nearer; such finds are
        followed without regard to the beam, so that a large group is walked whole."""
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        sims = (self.x[start] @ q).tolist()
        ahead = [(-s, k) for s, k in zip(sims, start, strict=True)]
        heapq.heapify(ahead)
        best = sorted(zip(sims, start, strict=True))
        heapq.heapify(best)
        kept: list[tuple[float, int]] = []
        while ahead:
            s, node = heapq.heappop(ahead)
            if -s < floor and len(best) >= ef and -s < best[0][0]:
                break
            near = self._links(node, level)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for t, k in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < ef or t > best[0][0] or t >= floor:
                    heapq.heappush(ahead, (-t, k))
                    if len(best) < ef:
                        heapq.heappush(best, (t, k))
                    else:
                        out = heapq.heappushpop(best, (t, k))
                        if out[0] >= floor:
                            kept.append(out)
        return best + kept

    def _choose(self, node: int, found: np.ndarray, most: int) -> np.ndarray:
        """Of ``found``, nearest first, those nearer to the node than to any chosen before."""
        x = self.x[found]
        to = x @ self.x[node]
        order = np.argsort(-to, kind="stable")
        between = x @ x.T
        chosen: list[int] = []
        for i in order:
            if len(chosen) >= most:
                break
            if not chosen or between[i, chosen].max() < to[i]:
                chosen.append(int(i))
        for i in order:  # fill up with the nearest of the rest
            if len(chosen) >= most:
                break
            if int(i) not in chosen:
                chosen.append(int(i))
        return found[chosen]

    def _insert(self, node: int, level: int) -> None:
        top = len(self.upper)
        if node:
            q, start = self.x[node], [self.entry]
            for lv in range(top, level, -1):
                start = [max(self._beam(q, start, 1, lv))[1]]
            for lv in range(min(top, level), -1, -1):
                found = self._beam(q, start, EF_BUILD, lv)
                start = [k for _, k in found]
                self._connect(node, self._choose(node, np.array(start, np.int64), M), lv)
        if level > top or not node:
            self.upper += [{} for _ in range(level - top)]
            self.entry = node

    def _connect(self, node: int, chosen: np.ndarray, level: int) -> None:
        if level:
            links = self.upper[level - 1]
            links[node] = chosen.tolist()
            for k in chosen.tolist():
                own = [*links.get(k, ()), node]
                links[k] = self._choose(k, np.array(own, np.int64), M).tolist() if len(own) > M + SLACK else own
            return
        self.near[node, :len(chosen)] = chosen
        self.count[node] = len(chosen)
        for k in chosen.tolist():
            n = self.count[k]
            if n == self.near.shape[1]:
                own = self._choose(k, np.append(self.near[k], node).astype(np.int64), 2 * M)
                self.near[k, :len(own)] = own
                self.count[k] = len(own)
            else:
                self.near[k, n] = node
                self.count[k] = n + 1

    def search(self, q: np.ndarray, least: float, own: int | None = None) -> np.ndarray:
        """Nodes found at cosine ``least`` or nearer, and some a little farther: the walk goes on
        through nodes within ``WALK`` of the threshold, as links often lie behind such."""
        q = q.astype(np.float32)
        if self.exact:
            return np.flatnonzero(self.x @ q >= least - WALK)
        start = [self.entry]
        for lv in range(len(self.upper), 0, -1):
            start = [max(self._beam(q, start, 1, lv))[1]]
        if own is not None and own not in start:
            start.append(own)
        floor = least - WALK
        return np.array([k for s, k in self._beam(q, start, self.ef, 0, floor) if s >= floor], np.int64)

    def audit(self, least: float) -> float:
        """Widen the beam until planted queries recall what brute force finds, on average over those
        of few true links and over those of many; the lower of the last recalls.  If the widest beam
        fails, the graph is given up for brute force."""
        n, dim = self.x.shape
        rng = np.random.default_rng(n)
        base = self.x[rng.permutation(n)[:AUDIT]].astype(np.float64)
        noise = rng.standard_normal(base.shape)
        noise -= (noise * base).sum(axis=1, keepdims=True) * base
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        noise = np.divide(noise, norm, out=np.zeros_like(noise), where=norm > 1e-12)
        cos = least + (1 - least) * rng.uniform(0.05, 0.5, (len(base), 1))
        queries = base * cos + noise * np.sqrt(1 - cos * cos)
        truth = [np.flatnonzero(self.x @ q.astype(np.float32) >= least + 1e-4) for q in queries]
        sizes = np.array([len(t) for t in truth])
        # over queries, not links, so that a large group does not outweigh the others
        strata = [own for own in (np.flatnonzero((sizes > 0) & (sizes <= M)), np.flatnonzero(sizes > M)) if len(own)]
        while True:
            hits = np.array([len(np.intersect1d(t, self.search(q, least), assume_unique=True)) for t, q in zip(truth, queries, strict=True)])
            recall = min([float((hits[own] / sizes[own]).mean()) for own in strata], default=1.0)
            if recall >= AUDIT_RECALL or self.ef >= n:
                self.exact = recall < AUDIT_RECALL
                return recall
            self.ef *= 2

    def dump(self) -> bytes:
        out = io.BytesIO()
        flat = [(lv, a, b) for lv, links in enumerate(self.upper) for a, own in links.items() for b in own]
        np.savez(out, near=self.near, count=self.count, flat=np.array(flat, np.int32).reshape(-1, 3),
                 head=np.array([len(self.upper), self.entry, self.ef, self.exact], np.int64))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, x: np.ndarray) -> Graph:
        parts = np.load(io.BytesIO(raw))
        own = cls(x)
        own.near, own.count = parts["near"], parts["count"]
        levels, own.entry, own.ef, own.exact = (int(v) for v in parts["head"])
        own.upper = [{} for _ in range(levels)]
        for lv, a, b in parts["flat"].tolist():
            own.upper[lv].setdefault(a, []).append(b)
        return own


def _groups(batches, *key: str):
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        at = [names.index(k) for k in key]
        for row in batch_rows(batch, *names):
            k = tuple(row[i] for i in at)
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append(row)
    if rows:
        yield now, rows


def _build(least: float):
    def work(batches):
        for (label, dim, shard), rows in _groups(batches, "label", "dim", "shard"):
            ids = [r[3] for r in rows]
            copies = np.array([r[5] for r in rows], "<i8")
            x = unit([r[4] for r in rows])
            graph = Graph(x).build(ids)
            recall = graph.audit(least)
            recall = 1.0 if graph.exact else recall  # a graph that failed is not used
            yield pa.RecordBatch.from_arrays(
                [pa.array([label], pa.string()), pa.array([dim], pa.int32()), pa.array([shard], pa.int64()),
                 pa.array([np.array(ids, "<i8").tobytes()]), pa.array([copies.tobytes()]), pa.array([x.astype("<f8").tobytes()]), pa.array([graph.dump()]),
                 pa.array([graph.ef], pa.int64()), pa.array([recall])],
                ["label", "dim", "shard", "ids", "copies", "x", "graph", "ef", "recall"])
    return work


def _query(least: float):
    """Link counts of a block's queries in one shard, and a spanning forest of their links.  A block's first row holds
    the shard's graph, which its queries stream past."""
    def work(batches):
        now, ids, copies, x, graph, place = None, None, None, None, None, {}
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        def forest():
            out = [(v, r, 0) for v in parent if (r := root(v)) != v]
            parent.clear()
            return out

        for batch in batches:
            out = []
            for label, dim, shard, block, kind, vec, q, own_ids, own_copies, own_x, own_graph in batch_rows(
                    batch, "label", "dim", "shard", "block", "kind", "vec_id", "embedding", "ids", "copies", "x", "graph"):
                if (label, dim, shard, block) != now:
                    out += forest()
                    now, graph = (label, dim, shard, block), None
                if kind == 0:
                    ids, copies = np.frombuffer(own_ids, "<i8"), np.frombuffer(own_copies, "<i8")
                    x = np.frombuffer(own_x, "<f8").reshape(-1, dim)
                    graph = Graph.load(own_graph, x)
                    place = {int(v): k for k, v in enumerate(ids)}
                    continue
                q = unit([q])[0]
                found = graph.search(q, least, place.get(vec))
                found = found[x[found] @ q >= least]
                found = found[ids[found] != vec]
                if len(found):
                    out.append((vec, None, int(copies[found].sum())))
                for v in ids[found].tolist():
                    a, b = root(vec), root(v)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            yield _found_rows(out)
        yield _found_rows(forest())
    return work


def _found_rows(out):
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "n"])


def shard_graphs(vectors: DataFrame, least: float, shard: int) -> tuple[DataFrame, DataFrame]:
    """(vectors with their label's number of shards and own shard, one audited graph per shard), of
    (label, dim, vec_id, embedding, copies)."""
    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("n"))
    dealt = vectors.join(sizes, ["label", "dim"]).withColumn("shards", F.ceil(F.col("n") / shard).cast("long")).withColumn(
        "shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    dealt = stored(dealt.select("label", "dim", "shard", "vec_id", "embedding", "copies", "shards", "n"), "vectors")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("label", "dim", "shard", "vec_id", "embedding", "copies").repartition(n, "label", "dim", "shard")
    graphs = rows.sortWithinPartitions("label", "dim", "shard", "vec_id").mapInArrow(
        _build(least), "label string, dim int, shard long, ids binary, copies binary, x binary, graph binary, ef long, recall double")
    return dealt, stored(graphs, "graphs")


def near_vectors(embeddings: DataFrame, least: float = 0.93, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, recall.

    Vectors of the same non-null label and dimension are linked when their cosine, in double
    precision, is at least ``least``.  A vector that is null, empty, zero, or holds a null or
    non-finite component is linked with nothing, and so is one without a label.  n_links counts the
    other vectors linked directly, component_id is the least vec_id reachable.  Rows that repeat a
    vec_id count as one vector (the least by value) and are returned each; a null vec_id has no
    links, a null component, and is not kept.  No vector gives no row.  Other columns are ignored.

    Every vector is indexed and queries every shard of its label, which is ``n / shard`` searches
    each: the method's own growth; of each graph goes one copy to ``block`` queries.  Links may be missed by the
    graphs within the audited recall, none is made up; recall is the least audited one among the shards that the
    vector was searched in, 1 where all were searched by brute force, null where none was.
    """
    return settled(lambda: _near_vectors(embeddings, least, shard, block), "near-vectors")


def _near_vectors(embeddings: DataFrame, least: float, shard: int, block: int) -> DataFrame:
    rows = own_columns(embeddings, "vec_id", "embedding", "label").withColumn("vec_id", F.col("vec_id").cast("long"))
    vector = F.transform("embedding", lambda v: v.cast("double"))
    usable = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(usable).select(
        "vec_id", F.col("label").cast("string").alias("label"), vector.alias("embedding")).groupBy("vec_id").agg(
        F.min(F.struct("label", "embedding")).alias("r")).select(
        "vec_id", "r.label", F.size("r.embedding").alias("dim"), "r.embedding",
        F.sha2(F.col("r.embedding").cast("string").cast("binary"), 256).alias("print"))
    good = stored(good, "good")
    classes = stored(good.groupBy("label", "print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    firsts = good.join(classes.select("vec_id", "copies"), "vec_id").select("label", "dim", "vec_id", "embedding", "copies")
    dealt, graphs = shard_graphs(firsts, least, shard)

    blocks = F.ceil(F.col("n") / block).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    asked = dealt.select(
        "label", "dim", F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding",
        none("binary").alias("ids"), none("binary").alias("copies"), none("binary").alias("x"), none("binary").alias("graph"))
    wide = dealt.groupBy("label", "dim").agg(F.max(blocks).alias("blocks"))
    sent = graphs.join(wide, ["label", "dim"]).select(
        "label", "dim", "shard", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"),
        none("bigint").alias("vec_id"), none("array<double>").alias("embedding"), "ids", "copies", "x", "graph")
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "dim", "shard", "block"]
    found = stored(asked.union(sent).repartition(n, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(
        _query(least), "u long, v long, n long"), "found")
    links = found.where("n > 0").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    groups = connected_components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("id", "vec_id")
    # every member of a class has its first one's links and component, and links with the other members
    found = classes.join(links, "vec_id", "left").join(groups, "vec_id", "left").select(
        "label", "print", (F.coalesce("n_links", zero) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component"))
    audited = graphs.groupBy("label", "dim").agg(F.min("recall").alias("recall"))
    own = good.select("vec_id", "label", "dim", "print").join(found, ["label", "print"]).join(audited, ["label", "dim"]).select(
        "vec_id", "n_links", "component", "recall")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(own, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "recall")
