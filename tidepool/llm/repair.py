r"""Conversation structure repair: the cheapest edits that make a dialogue alternate, with their audit.

A dynamic program runs over a conversation's turns; its states are what was kept last (nothing, a
system turn, a user turn, an assistant turn).  A state's edits so far are a node that points to the node
before: paths share their prefixes.  Every node has its ancestors at distances 1, 2, 4, ... and a
rolling hash of all letters up to it, so of two paths of one cost the smaller is found by searching
their longest common prefix; prefixes that the hashes call equal are compared letter by letter (and
remembered as equal), so a collision decides nothing.

Long conversations are not kept together: rows get a place in one global order, and each run of
``SEGMENT_ROWS`` places is solved by itself, for every state a conversation can enter it with.  What the
segments found for a conversation is joined by the same program over costs and ranks alone, a few
numbers per segment.  The repaired turns are then written out segment by segment.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import batch_rows, own_columns, stored
from tidepool.llm.hilbert import placed

SEGMENT_ROWS = 4096
BLANK_CHARS = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: where a turn of this initial may be kept: states before it, state after it
_FITS = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
_AFTER = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E688


class Trails:
    """Sequences of letters that share their prefixes; node 0 is the empty one."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up, self.same = [""], [0], [0], [()], [0]

    def add(self, node: int, letter) -> int:
        new, ups, k = len(self.letter), [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + (letter if isinstance(letter, int) else ord(letter)) + 1) % _MOD)
        self.up.append(ups)
        self.same.append(new)
        return new

    def lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def root(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = self.same[self.same[node]]
            node = self.same[node]
        return node

    def unlike(self, a: int, b: int) -> tuple[int, int] | None:
        """The first place where two sequences of one length differ, letter by letter; None: they are
        equal, which is remembered."""
        found, x, y = None, a, b
        while self.root(x) != self.root(y):
            if self.letter[x] != self.letter[y]:
                found = x, y
            x, y = self.up[x][0], self.up[y][0]
        if found is None:
            self.same[self.root(b)] = self.root(a)
        return found

    def order(self, a: int, b: int) -> int:
        """-1, 0 or 1: the sequence at ``a`` is less than, equal to or greater than that at ``b``; a prefix is less."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, self.depth[a] - short), self.lifted(b, self.depth[b] - short)
        longer = (self.depth[a] > self.depth[b]) - (self.depth[a] < self.depth[b])
        if self.hash[x] == self.hash[y]:
            at = self.unlike(x, y)
            if at is None:
                return longer
            x, y = at
        else:
            k = len(self.up[x])
            while k:
                k -= 1
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            x, y = self.unlike(self.up[x][0], self.up[y][0]) or (x, y)
        return -1 if self.letter[x] < self.letter[y] else 1

    def text(self, node: int) -> list:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return out[::-1]


class Front:
    """The cheapest way to each state, ties by least audit."""

    def __init__(self, trails: Trails, begin: int):
        self.trails, self.best = trails, {begin: (0, 0)}

    def least(self, ways: list[tuple]) -> tuple:
        """Of (cost, node, letter or None) the best as (cost, node)."""
        cost = min(w[0] for w in ways)
        nodes = [n if letter is None else self.trails.add(n, letter) for c, n, letter in ways if c == cost]
        best = nodes[0]
        for n in nodes[1:]:
            if self.trails.order(n, best) < 0:
                best = n
        return cost, best

    def insert(self) -> None:
        """Turns put in here: one, or a user and an assistant turn."""
        for to, before in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            ways = [(self.best[q][0] + INSERT, self.best[q][1], "I") for q in before if q in self.best]
            if to in self.best:
                ways.append((*self.best[to], None))
            if ways:
                self.best[to] = self.least(ways)

    def turn(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.insert()
        ways: dict[int, list] = {}
        extra = TRUNCATED if truncated else 0
        for q, (cost, node) in self.best.items():
            ways.setdefault(q, []).append((cost + DELETE, node, "D"))
            if not must_go:
                before, to = _FITS.get(initial, ((), None))
                if q in before:
                    ways.setdefault(to, []).append((cost + KEEP + extra, node, "K"))
                ways.setdefault(_AFTER[q], []).append((cost + REROLE + extra, node, "R"))
        self.best = {q: self.least(w) for q, w in ways.items()}


# --- segments -----------------------------------------------------------------------------------

_PATHS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())]))
PIECES = ("conv_id long, segment long, first long, illegal long, head string, tail string, "
          "paths array<struct<begin: int, end: int, cost: long, rank: int, audit: string>>")


class _Piece:
    """A conversation's turns within one segment; ``whole``: they begin there, so they are met with nothing kept."""

    def __init__(self, conv, segment, first, inside):
        self.conv, self.segment, self.first, self.illegal, self.head, self.tail = conv, segment, first, 0, None, None
        self.trails = Trails()
        self.fronts = {b: Front(self.trails, b) for b in ((NOTHING,) if inside else range(4))}

    def take(self, initial, must_go, truncated):
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.tail = initial
        for front in self.fronts.values():
            front.turn(initial, must_go, truncated)

    def row(self):
        ends = [(b, e, cost, "".join(self.trails.text(node))) for b, f in self.fronts.items() for e, (cost, node) in f.best.items()]
        rank = {a: k for k, a in enumerate(sorted({x[3] for x in ends}))}
        return (self.conv, self.segment, self.first, self.illegal, self.head, self.tail,
                [{"begin": b, "end": e, "cost": c, "rank": rank[a], "audit": a} for b, e, c, a in ends])


def _solve(batches):
    """Rows come by segment and place."""
    def given(out):
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _PATHS]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                          ["conv_id", "segment", "first", "illegal", "head", "tail", "paths"])
    piece, out = None, []
    for batch in batches:
        for conv, segment, place, initial, must_go, truncated in batch_rows(
                batch, "conv_id", "segment", "place", "initial", "must_go", "truncated"):
            if piece is None or (conv, segment) != (piece.conv, piece.segment):
                if piece:
                    out.append(piece.row())
                piece = _Piece(conv, segment, place, piece is not None and piece.segment == segment)
            piece.take(initial, must_go, truncated)
            if len(out) >= 1000:
                yield given(out)
                out = []
    if piece:
        out.append(piece.row())
    yield given(out)


def _join_pieces(pieces):
    """(cost, illegal, [(segment, path number)], inserts at the end) over a conversation's pieces in order: the same program,
    a letter being the rank of a piece's audit among its piece's."""
    trails = Trails()
    # no piece's audit is the beginning of another one of its piece: both end with a turn's letter
    best, illegal, last = {NOTHING: (0, 0, ())}, 0, None
    for p in pieces:
        illegal += p["illegal"] + (last is not None and last + p["head"] not in ("su", "ua", "au"))
        last = p["tail"]
        ways: dict[int, list] = {}
        for k, path in enumerate(p["paths"]):
            if path["begin"] in best:
                cost, node, way = best[path["begin"]]
                ways.setdefault(path["end"], []).append((cost + path["cost"], node, path["rank"], (way, k)))
        best = {}
        for end, found in ways.items():
            least = min(w[0] for w in found)
            top = None
            for cost, node, rank, way in found:
                if cost == least:
                    new = trails.add(node, rank)
                    if top is None or trails.order(new, top[1]) < 0:
                        top = cost, new, way
            best[end] = top
    # the inserts that end it: none, or up to an assistant turn
    ends = []
    for q, more in ((NOTHING, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)):
        if q in best:
            ends.append((best[q][0] + INSERT * more, best[q], more))
    least = min(e[0] for e in ends)
    top = None
    for cost, (_, node, way), more in ends:
        if cost == least:
            for _ in range(more):
                node = trails.add(node, 1 << 30)  # all paths have as many pieces: an insert only follows them
            if top is None or trails.order(node, top[0]) < 0:
                top = node, way, more
    way, chosen = top[1], []
    while way:
        way, k = way
        chosen.append(k)
    return least, illegal, chosen[::-1], top[2]


def _choose(batches):
    for batch in batches:
        out = []
        for conv, pieces in batch_rows(batch, "conv_id", "pieces"):
            cost, illegal, chosen, more = _join_pieces(pieces)
            out.append((conv, cost, illegal, [{"segment": p["segment"], "path": k, "more": 0} for p, k in zip(pieces, chosen, strict=True)]))
            out[-1][3][-1]["more"] = more
        cols = list(zip(*out, strict=True)) or [[]] * 4
        ways = pa.list_(pa.struct([("segment", pa.int64()), ("path", pa.int32()), ("more", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), ways], strict=True)],
                                         ["conv_id", "cost", "illegal", "chosen"])


def _write_out(batches):
    """Rows come by segment, place and kind: a piece's audit (kind 0), then its turns (kind 1)."""
    conv, audit, at, state = None, "", 0, NOTHING
    for batch in batches:
        out = []

        def put_in(conv, place, k):
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                state = _AFTER[state]
                out.append((conv, place, k, "I", "user" if state == USER else "assistant", ""))
                at, k = at + 1, k + 1
            return k

        for kind, conv, place, role, text, sent, begin in batch_rows(batch, "kind", "conv_id", "place", "role", "text", "audit", "begin"):
            if kind == 0:
                audit, at, state = sent, 0, begin
                continue
            k = put_in(conv, place, 0)
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _FITS[role[0]][1]
                out.append((conv, place, k, edit, role, text))
            elif edit == "R":
                state = _AFTER[state]
                out.append((conv, place, k, edit, "user" if state == USER else "assistant", text))
            if not audit[at:].strip("I"):
                put_in(conv, place, k + 1)
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                         ["conv_id", "place", "k", "edit", "role", "text"])


def _digests(batches):
    now, digest, n = None, None, 0
    first = True
    for batch in batches:
        out = []
        for conv, role, text in batch_rows(batch, "conv_id", "role", "text"):
            if first or conv != now:
                if not first:
                    out.append((now, digest.hexdigest()))
                now, digest, n, first = conv, hashlib.sha256(), 0, False
            digest.update((b"\n" if n else b"") + f"{role}:{text}".encode())
            n += 1
        yield _digest_rows(out)
    if not first:
        yield _digest_rows([(now, digest.hexdigest())])


def _digest_rows(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())],
                                      ["conv_id", "repaired_sha256"])


# --- operator -----------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` mod 20: 0 loses the row, 1 its
    text, 2 its text's ``.!?``; 3 doubles it, 4 makes it a user's.  Nulls are one blank, in the key too; a null turn stays null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = own_columns(conversations, "conv_id", "turn", "role", "text").withColumn(
        "_h", F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).where("_h <> 0")
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_h") == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text")).alias("text"))


def judged(conversations: DataFrame) -> DataFrame:
    """(place, conv_id, turn, role, text, blank, duplicate, truncated): the turns in their order, each with its first fault, stored.

    Order: conv_id, then turn (nulls first), role, text's digest, order of reading; nulls of role and text are one blank."""
    own = own_columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    own = stored(own.withColumn("mark", F.md5(F.col("text").cast("binary"))).withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = placed(own, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("row")])
    seen = rows.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("seen"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("mark").alias("_m"), "seen")
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("mark") == F.col("_m")), "left")
    bare = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    blank = bare == ""
    duplicate = ~blank & F.coalesce(F.col("place") > F.col("seen"), F.lit(False))
    truncated = ~blank & ~duplicate & ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    return stored(rows.select("place", "conv_id", "turn", "role", "text", blank.alias("blank"), duplicate.alias("duplicate"),
                              truncated.alias("truncated")), "judged")


def audits(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of rows made by :func:`judged`: (conv_id, cost, illegal) per conversation, and (conv_id, segment, first, begin,
    audit) per conversation and segment that holds turns of it, both stored."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segment = F.expr(f"place div {int(segment_rows)}")
    narrow = rows.select("conv_id", segment.alias("segment"), "place", F.substring("role", 1, 1).alias("initial"),
                         (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    pieces = stored(narrow.repartition(n, "segment").sortWithinPartitions("segment", "place").mapInArrow(_solve, PIECES), "pieces")
    light = F.transform("paths", lambda p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), p["cost"].alias("cost"), p["rank"].alias("rank")))
    met = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "illegal", "head", "tail", light.alias("paths")))).alias("pieces"))
    chosen = stored(met.mapInArrow(
        _choose, "conv_id long, cost long, illegal long, chosen array<struct<segment: long, path: int, more: int>>"), "chosen")
    ways = chosen.select(F.col("conv_id").alias("_c"), F.explode("chosen").alias("w")).select("_c", F.col("w.segment").alias("_s"), "w.path", "w.more")
    own = F.element_at("paths", F.col("path") + 1)
    parts = pieces.join(ways, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s"))).select(
        "conv_id", "segment", "first", own["begin"].alias("begin"), F.concat(own["audit"], F.expr("repeat('I', more)")).alias("audit"))
    return chosen.select("conv_id", "cost", "illegal"), stored(parts, "audits")


def repaired_turns(rows: DataFrame, parts: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, place, k, edit, role, text): the turns after repair; (place, k) is their order, edit K, R or I."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = rows.select(F.expr(f"place div {int(segment_rows)}").alias("segment"), "place", F.lit(1).alias("kind"), "conv_id", "role", "text",
                        F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("begin"))
    heads = parts.select("segment", F.col("first").alias("place"), F.lit(0).alias("kind"), "conv_id", F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), "audit", "begin")
    return turns.unionByName(heads).repartition(n, "segment").sortWithinPartitions("segment", "place", "kind").mapInArrow(
        _write_out, "conv_id long, place long, k int, edit string, role string, text string")


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(report, turns): per conversation conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; and the repaired
    turns (:func:`repaired_turns`).

    The roles after repair, by initials, are nothing or ``s?(ua)+``.  Keeping a turn costs 0, a new role
    (user or assistant) 2, deleting it 3, an inserted empty turn 2, a kept turn without an end mark 1
    more; blank turns and those whose role and text were seen before must be deleted.  The audit is the edits'
    initials, the least of the cheapest.

    A null role or text is one blank, so such a turn is blank or has no fitting role; null turn numbers
    come first, equal ones by role and text; repeated rows are duplicates; a null conv_id is a conversation
    of its own.  No rows give no rows.  Other columns are ignored.
    """
    rows = judged(conversations)
    known, parts = audits(rows, segment_rows)
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    by_turn = rows.groupBy("conv_id", "turn").agg(one("blank"), one("duplicate"), one("truncated"))
    found = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    # one row per conversation, so the audit of a conversation is one value
    whole = parts.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    report = _joined(_joined(found, known), whole).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, repaired_turns(rows, parts, segment_rows)


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On conv_id, nulls equal."""
    right = right.withColumnRenamed("conv_id", "_conv")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")), how).drop("_conv")


def digest(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the turns as ``role:text``, joined by newlines; a conversation's are read
    in order by one task, a turn at a time, as the hash needs them."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place", "k").select(
        "conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the report of its repair after :func:`damage`, and the repaired turns' digest."""
    report, turns = repair(damage(conversations))
    every = own_columns(conversations, "conv_id").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = _joined(_joined(every, report, "left"), digest(turns), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _with_edits(sql: str) -> str:
    """``add(way, cost, letter)`` written out: a way with one more edit; a missing way stays missing."""
    def out(m):
        way, cost, letter = m.groups()
        return f"(lpad(CAST(CAST(left({way}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}')"
    return re.sub(r"add\(([\w.]+), ([\w +]+), (\w)\)", out, sql)


ORACLE = _with_edits(r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
keys AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT k.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                              lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM keys k, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM harmed),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faulty AS (
  SELECT conv_id, turn, role, text, i, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
         bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS c,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM counted),
sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- a way is its cost in 9 digits and its audit; n, s, u, a: the best way by what was kept last
steps AS (
  SELECT conv_id, 0 AS i, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS a FROM sums
  UNION ALL
  SELECT conv_id, i, n, s, u, least(a, add(u, 2, I)) AS a
  FROM (
    SELECT conv_id, i, n, s, least(u, add(n, 2, I), add(s, 2, I), add(a, 2, I)) AS u, a
    FROM (
      SELECT f.conv_id, f.i, add(p.n, 3, D) AS n,
             least(add(p.s, 3, D), CASE WHEN ok AND c = 's' THEN add(p.n, more, K) END) AS s,
             least(add(p.u, 3, D), CASE WHEN ok AND c = 'u' THEN least(add(p.n, more, K), add(p.s, more, K), add(p.a, more, K)) END,
                   CASE WHEN ok THEN least(add(p.n, 2 + more, R), add(p.s, 2 + more, R), add(p.a, 2 + more, R)) END) AS u,
             least(add(p.a, 3, D), CASE WHEN ok AND c = 'a' THEN add(p.u, more, K) END,
                   CASE WHEN ok THEN add(p.u, 2 + more, R) END) AS a
      FROM steps p JOIN (SELECT *, NOT (blank OR duplicate) AS ok, CASE WHEN truncated THEN 1 ELSE 0 END AS more FROM faulty) f
        ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))),
done AS (
  SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(left(least(t.n, t.a), 9) AS BIGINT) AS cost, substr(least(t.n, t.a), 10) AS audit
  FROM sums s JOIN steps t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.n),
edits AS (
  SELECT conv_id, pos, edit, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM done WHERE audit <> '')),
left_over AS (
  SELECT e.conv_id, e.pos, edit, f.role, f.text, edit = 'K' AND f.c = 's' AS sys, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.pos) AS k
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE edit <> 'D'),
turned AS (
  SELECT conv_id, pos, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
         CASE WHEN edit = 'K' THEN role WHEN (k - max(CASE WHEN sys THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role
  FROM left_over),
digests AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY pos)) AS h FROM turned GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN digests g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
""")
