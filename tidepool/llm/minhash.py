"""MinHash near-dedup by an LSH forest, with links confirmed on full shingle sets.

Every distinct shingle set gets ``TREES`` keys of ``KEY`` min-hash values.  Per tree the keys are
put in one sorted order; neighbours whose longest common prefix has at least ``DEPTH`` values are
candidates, and chains of them make regions.  The depth adapts: a region that fits one block is
settled whole at the least depth; in a larger one each document first meets the neighbours it
shares the longest prefixes with, and what those links leave unjoined is compared with the rest of
the region: block by block, or, where that would grow with the square of the region, only with those
that share one of the shingles a linked pair must share (its rarest ones), so that no link is lost.

Copies (equal sets) are one class from the start.  Pairs are never emitted: a block reports only
the links that join something not joined before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import MULT, batch_rows, in_chunks, mix, own_columns, settled, stored, window_hashes, word_hashes
from tidepool.llm.components import connected_components

SHINGLE = 5
TREES, KEY, DEPTH = 24, 8, 4
#: hash functions: tree t reads 8 of them from 4 * t on, so that the first 4 are its own
PERMS = TREES * DEPTH
_SEEDS = mix(np.arange(1, PERMS + 1, dtype=np.uint64) * MULT) | np.uint64(1)
_OWN = (np.arange(TREES)[:, None] * DEPTH + np.arange(KEY)[None, :]) % PERMS
#: shingles a block may hold (8 bytes each)
BLOCK = 250_000
#: copies of a class table that rows with one print are dealt to
SALTS = 32


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of a shorter text its whole sequence."""
    h = word_hashes((text or b"").lower().split())
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return window_hashes(h, len(h)) + np.uint64(len(h))
    return np.unique(window_hashes(h, SHINGLE))


def forest_keys(s: np.ndarray) -> bytes:
    """TREES keys, one after another: KEY two-byte values each, to be compared as bytes."""
    low = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(low, (s[at:at + 4096, None] * _SEEDS[None, :]).min(axis=0), out=low)
    return mix(low).astype(np.uint16)[_OWN].astype(">u2").tobytes()


def _sketch(batch):
    ids, ns, prints, keys = [], [], [], []
    for doc_id, text in batch_rows(batch, "doc_id", "text"):
        s = shingles(text)
        ids.append(doc_id)
        ns.append(len(s))
        prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        keys.append(forest_keys(s) if len(s) else None)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(prints, pa.binary()),
                                       pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "print", "keys"])


def _unfold(batch):
    """A row per tree: its number and key as one sortable binary."""
    keys, ids = [], []
    size = 2 * KEY
    for doc_id, own in batch_rows(batch, "doc_id", "keys"):
        keys += [bytes([t]) + own[t * size:(t + 1) * size] for t in range(TREES)]
        ids += [doc_id] * TREES
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])


def _common(a: bytes, b: bytes) -> int:
    n = 0
    if a[0] == b[0]:
        while n < KEY and a[1 + 2 * n:3 + 2 * n] == b[1 + 2 * n:3 + 2 * n]:
            n += 1
    return n


def _neighbours(batches):
    """Candidates (u, v, depth) among consecutive rows of one sorted partition, and its ends, with
    null v, to be matched across partitions."""
    last, first = None, None
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not keys:
            continue
        if first is None:
            first = (ids[0], keys[0])
        if last is not None:
            keys, ids = [last[1], *keys], [last[0], *ids]
        last = (ids[-1], keys[-1])
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 1 + 2 * KEY)
        tree = raw[1:, 0] == raw[:-1, 0]
        own = np.ascontiguousarray(raw[:, 1:]).view(np.uint16)
        depth = np.cumprod(own[1:] == own[:-1], axis=1).sum(axis=1) * tree
        at = np.flatnonzero(depth >= DEPTH)
        ids = np.array(ids, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[at + 1]), pa.array(depth[at].astype(np.int32)),
                                          pa.nulls(len(at), pa.binary())], ["u", "v", "depth", "key"])
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([first[0], last[0]]), pa.array([None, None], pa.int64()), pa.array([0, 1], pa.int32()),
             pa.array([first[1], last[1]], pa.binary())], ["u", "v", "depth", "key"])


def _borders(batches):
    """Candidates across partitions: the end of each with the beginning of the next."""
    ends = sorted((k, u, d) for b in batches for u, d, k in batch_rows(b, "u", "depth", "key"))
    out = []
    for (k0, u0, d0), (k1, u1, d1) in zip(ends, ends[1:], strict=False):
        if d0 == 1 and d1 == 0 and u0 != u1 and (n := _common(k0, k1)) >= DEPTH:
            out.append((u0, u1, n))
    cols = list(zip(*out, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                                     ["u", "v", "depth"])


def forest_neighbours(keyed: DataFrame) -> DataFrame:
    """(u, v, depth): candidates of (doc_id, keys), once each, with their prefix lengths added up
    over the trees.  The sorted order is cut into ranges of (tree, key, doc_id), so a key that very
    many documents share is cut as well."""
    rows = keyed.mapInArrow(lambda b: in_chunks(b, _unfold), "key binary, doc_id long")
    found = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(
        _neighbours, "u long, v long, depth int, key binary")
    found = stored(found, "neighbours")
    # two rows a partition at most
    ends = found.where("key IS NOT NULL").select("u", "depth", "key").coalesce(1).mapInArrow(_borders, "u long, v long, depth int")
    pairs = found.where("key IS NULL").select("u", "v", "depth").union(ends)
    return pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("depth").alias("depth"))


def _runs(batches, *key: str) -> Iterator[tuple]:
    """(key, rows) of consecutive rows with equal keys, over batch borders."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for row in batch_rows(batch, *names):
            at = dict(zip(names, row, strict=True))
            k = tuple(at[n] for n in key)
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append(at)
    if rows:
        yield now, rows


def _similar(n_a: int, n_b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n_a + n_b - both)


def _join_blocks(percent: int):
    """Links of open documents with targets of one block pair, as far as they join anything."""
    def work(batches):
        out: list[tuple[int, int]] = []
        for _, rows in _runs(batches, "region", "i", "j"):
            targets = [r for r in rows if r["target"]]
            if not targets:
                continue
            sets = [np.frombuffer(r["shingles"], "<u8") for r in targets]
            size = np.array([len(s) for s in sets], np.int64)
            vals, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(vals, kind="stable")
            vals, owner = vals[order], owner[order]
            parent: dict[int, int] = {}

            def root(x: int, parent=parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for r in rows:
                if not r["open"]:
                    continue
                own = np.frombuffer(r["shingles"], "<u8")
                lo, hi = np.searchsorted(vals, own, "left"), np.searchsorted(vals, own, "right")
                n = hi - lo
                ends = np.cumsum(n)
                hits = owner[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])] if len(n) and ends[-1] else owner[:0]
                both = np.bincount(hits, minlength=len(sets))
                for k in np.flatnonzero(_similar(len(own), size, both, percent)):
                    t = targets[int(k)]
                    a, b = root(r["component"]), root(t["component"])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((r["doc_id"], t["doc_id"]))
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)
    return work


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])


def _sets(batch):
    names = [n for n in batch.schema.names if n != "text"]
    text = batch.column(batch.schema.get_field_index("text")).to_pylist()
    return pa.RecordBatch.from_arrays(
        [*[batch.column(batch.schema.get_field_index(n)) for n in names],
         pa.array([shingles(t).astype("<u8").tobytes() for t in text], pa.binary())], [*names, "shingles"])


def _confirm(percent: int):
    def work(batch):
        out = []
        for u, v, a, b in batch_rows(batch, "u", "v", "a", "b"):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            if _similar(len(a), len(b), both, percent):
                out.append((u, v))
        return _links(out)
    return lambda batches: in_chunks(batches, work)


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Exact links between the open members of each region and all its members.

    ``members``: (region, doc_id, component, open, shingles, ni, nj).  A region is cut by hash into
    ``nj`` blocks, its open members into ``ni``; a pair of blocks is one task's work.
    """
    zero = F.lit(0).cast("long")
    own_i, own_j = F.pmod(F.xxhash64("doc_id"), F.col("ni")), F.pmod(F.xxhash64("doc_id"), F.col("nj"))
    both = members.where("nj = 1").select("region", "doc_id", "component", "open", F.lit(True).alias("target"), "shingles",
                                          zero.alias("i"), zero.alias("j"))
    cut = members.where("nj > 1")
    targets = cut.select("region", "doc_id", "component", F.lit(False).alias("open"), F.lit(True).alias("target"), "shingles",
                         F.explode(F.sequence(zero, F.col("ni") - 1)).alias("i"), own_j.alias("j"))
    opened = cut.where("open").select("region", "doc_id", "component", "open", F.lit(False).alias("target"), "shingles",
                                      own_i.alias("i"), F.explode(F.sequence(zero, F.col("nj") - 1)).alias("j"))
    dealt = both.union(targets).union(opened)
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(
        _join_blocks(percent), "u long, v long")


def _explode_shingles(batch):
    """A row per shingle."""
    sets = [np.frombuffer(x, "<i8") for x in batch.column(batch.schema.get_field_index("shingles")).to_pylist()]
    times = [len(x) for x in sets]
    again = lambda name: pa.array(np.repeat(batch.column(batch.schema.get_field_index(name)).to_numpy(), times))
    return pa.RecordBatch.from_arrays([again("region"), again("doc_id"), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))],
                                      ["region", "doc_id", "shingle"])


def _sharing(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Regions cut by shared rare shingles: rows like ``members``, a region being one shingle's documents.

    In the order rare first, two linked sets share one of their first n - ceil(percent * n / 100) + 1
    shingles, n being the set's own size; so documents without such a shingle in common need not
    meet.  Shingles of the same documents count once, and those without an open document or with
    documents of one component are left out.
    """
    light = members.select("region", "doc_id", "component", "open", "n_shingles")
    every = members.select("region", "doc_id", "shingles").mapInArrow(
        lambda b: in_chunks(b, _explode_shingles), "region long, doc_id long, shingle long")
    every = stored(every, "shingles")
    often = every.groupBy("region", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    shared = every.join(often, ["region", "shingle"])
    # the shingles that one document alone has come first, so only the others need an order
    n_shared = F.count("*").over(Window.partitionBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("times", "shingle"))
    first = shared.withColumn("k", place).withColumn("shared", n_shared).join(light, ["region", "doc_id"]).where(
        F.expr(f"n_shingles - shared + k <= n_shingles - ({percent} * n_shingles + 99) div 100 + 1"))
    first = stored(first.select("region", "shingle", "doc_id", "component", "open", "n_shingles"), "rare")
    groups = first.groupBy("region", "shingle").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.max("open").alias("o"), F.count("*").alias("k"),
        F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("same"),
        F.sum("n_shingles").alias("n"), F.sum(F.when(F.col("open"), F.col("n_shingles")).otherwise(0)).alias("n_open")).where("a < b AND o")
    groups = groups.groupBy("region", "k", "same").agg(F.min(F.struct("shingle", "n", "n_open")).alias("g")).select(
        "region", "g.shingle", F.ceil(F.col("g.n") / block).cast("long").alias("nj"), F.ceil(F.col("g.n_open") / block).cast("long").alias("ni"))
    return first.join(groups, ["region", "shingle"]).select(
        "region", F.xxhash64("region", "shingle").alias("group"), "doc_id", "n_shingles", "ni", "nj")


def _unjoined_pairs(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Exact links between the open members of each region and all its members, as far as they join anything."""
    many = members.where("ni > 1")
    if many.isEmpty():
        return _block_pairs(members, percent)
    groups = stored(_sharing(many, percent, block), "groups")
    # what is sent either way, in shingles
    size = F.col("n_shingles")
    whole = many.groupBy("region").agg(F.sum(size * F.col("ni") + F.when(F.col("open"), size * F.col("nj")).otherwise(0)).alias("whole"))
    parts = groups.groupBy("region").agg(F.sum(size * F.col("ni")).alias("parts"))
    cut = stored(whole.join(parts, "region", "left").where("coalesce(parts, 0) < whole").select("region"), "cut")
    sent = groups.join(cut, "region", "left_semi").select("group", "doc_id", "ni", "nj").join(
        many.select("doc_id", "component", "open", "shingles"), "doc_id").withColumnRenamed("group", "region")
    rest = members.join(cut, "region", "left_anti")
    cols = ["region", "doc_id", "component", "open", "shingles", "ni", "nj"]
    return _block_pairs(rest.select(*cols).union(sent.select(*cols)), percent)


def near_duplicates(documents: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= ``percent`` * |A or B| for their sets of 5-word
    shingles (words as ``bytes.split`` finds them, A-Z lower-cased; a text of fewer words is one
    shingle).  component_id is the least doc_id reachable over links, itself included.  A null,
    empty or blank text has no shingle and is linked with nothing.  Rows that repeat a doc_id are
    returned each; their ids must carry equal texts to mean anything.  A null doc_id keeps a null
    component and is not kept.  No document gives no row.  Other columns are ignored.

    Candidates come from min-hashes: at the threshold a pair alone in its region is met with
    probability 1 - (1 - 0.75^4)^24 = 0.9999, more similar ones nearly always; within a region all
    comparisons are exact.
    """
    docs = own_columns(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return settled(lambda: _components(docs, percent, block), "near")


def _components(docs: DataFrame, percent: int, block: int) -> DataFrame:
    sketch = stored(docs.mapInArrow(lambda b: in_chunks(b, _sketch), "doc_id long, n_shingles long, print binary, keys binary"), "sketch")
    known = sketch.where("doc_id IS NOT NULL AND print IS NOT NULL")
    classes = known.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("r"), F.count("*").alias("times"))
    reps = classes.select("print", "r.doc_id", "r.n_shingles", "r.keys")
    pairs = stored(forest_neighbours(reps.select("doc_id", "keys")), "candidates")
    regions = stored(connected_components(pairs).select(F.col("id").alias("doc_id"), F.col("component").alias("region")), "regions")

    # sets of the documents that are in a region, one row each
    seen = regions.join(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id")
    sets = stored(seen.mapInArrow(lambda b: in_chunks(b, _sets), "doc_id long, region long, shingles binary").withColumn(
        "n_shingles", (F.length("shingles") / 8).cast("long")), "sets")
    wide = sets.groupBy("region").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > block).select("region")

    # large regions: each document meets the two neighbours it shares the longest prefixes with
    rank = F.row_number().over(_by_depth())
    ends = pairs.select("u", "v", "depth").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "depth"))
    large = regions.join(wide, "region", "left_semi").select(F.col("doc_id").alias("u"))
    first = ends.join(large, "u", "left_semi").withColumn("k", rank).where("k <= 2").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    links = stored(first.join(a, "u").join(b, "v").mapInArrow(_confirm(percent), "u long, v long"), "links")
    joined = stored(connected_components(links), "joined")

    # what these links leave open is compared with its whole region; small regions are all open
    members = stored(sets.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")), "members")
    parts = members.groupBy("region", "component").agg(F.sum("n_shingles").alias("n"))
    blocks = lambda n: F.ceil(n / block).cast("long")
    most = parts.groupBy("region").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("k"))
    plan = stored(most.where("k > 1").select("region", F.col("m.component").alias("main"), blocks(F.col("n")).alias("nj"),
                                             blocks(F.col("n") - F.col("m.n")).alias("ni")), "blocks")
    members = members.join(plan, "region").withColumn("open", F.col("component") != F.col("main"))
    more = _unjoined_pairs(members, percent, block)
    groups = stored(connected_components(links.union(more)), "groups")

    # rows of one print are dealt to SALTS copies of their class; a document alone in its class is found by its id
    copies = classes.where("times > 1").select("print", F.col("r.doc_id").alias("rep")).join(
        groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "print", F.coalesce("component", "rep").alias("joint"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = sketch.select("doc_id", "n_shingles", "print", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = out.join(copies, ["print", "salt"], "left").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("joint", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _by_depth():
    return Window.partitionBy("u").orderBy(F.desc("depth"), "v")
