r"""Sharding along a Hilbert curve: rows close in several metadata dimensions lie in the same files.

Each dimension's values are ranked and the ranks quantised to ``bits`` bits; a row's cell on the grid
gives its index on the Hilbert curve; the rows, sorted by that index, are cut into runs, the shards.
All of it is DataFrame expressions.

The order is made by range partitioning on keys that end in a number of each row's own, so no
value, cell or group of copies has to fit in a task; the place of a row is its place in its partition
plus the rows of the partitions before, and only one count per partition meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import drop_stored, own_columns, stored

SHARDS, BITS, SALTS = 24, 4, 32


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with ``place``, from 0 without gaps along ``order``, which should tell all rows apart;
    stored, so a place never changes however often it is read."""
    mark = F.monotonically_increasing_id()
    sorted_in = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", mark), "placed")
    part, own = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_in.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: as many as the plan has tasks
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return sorted_in.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "place", F.col("_start") + own).drop("_at", "_part", "_start")


def quantised(rows: DataFrame, dim: str, bits: int) -> DataFrame:
    """(value, cell): the distinct values of ``dim``, nulls first, by rank in 2^bits equal steps."""
    values = placed(rows.select(F.col(dim).alias("value")).distinct(), [F.col("value").asc_nulls_first()])
    n = values.count()
    return values.select("value", F.expr(f"cast(place * {1 << bits} div {max(n, 1)} as int)").alias("cell"))


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve through the grid of 2^bits cells a side.

    Level by level, from the highest bit: the cell's corner is taken to the frame of the sub-cube
    (entry corner, direction), its rank along the Gray code is the next digit, and the frame turns to
    that of the corner entered.
    """
    n = len(cells)
    every = range(1 << n)
    gray = [k ^ (k >> 1) for k in every]
    rank = [gray.index(k) for k in every]
    trail = lambda k: (~k & (k + 1)).bit_length() - 1  # noqa: E731  low ones of k
    entry = [0 if k == 0 else gray[2 * ((k - 1) // 2)] for k in every]
    turn = [0 if k == 0 else trail(k - 1) % n if k % 2 == 0 else trail(k) % n for k in every]
    look = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    mask = (1 << n) - 1

    def rotated(value: Column, by: Column) -> Column:
        """``value`` of n bits rolled to the left."""
        twice = value.bitwiseOR(F.call_function("shiftleft", value, F.lit(n)))
        return F.call_function("shiftright", twice, F.lit(n) - by).bitwiseAND(F.lit(mask))

    def level(state: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for d, cell in enumerate(cells):
            one = F.call_function("shiftright", cell, bit).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.call_function("shiftleft", one, F.lit(d)))
        by = (state["turn"] + 1) % n
        own = rotated(corner.bitwiseXOR(state["entry"]), (F.lit(n) - by) % n)
        digit = look(rank, own)
        return F.struct(
            (state["h"] * (1 << n) + digit).alias("h"),
            state["entry"].bitwiseXOR(rotated(look(entry, digit), by)).alias("entry"),
            ((state["turn"] + look(turn, digit) + 1) % n).alias("turn"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, level, lambda s: s["h"])


def size_class(size: Column) -> Column:
    """A size's octave and quarter of it: four classes for each doubling."""
    octave = F.length(F.bin(size)) - 1
    return (octave * 4 + F.expr("shiftright(size * 4, length(bin(size)) - 1)").cast("int") % 4).cast("int")


def shard(documents: DataFrame, dims: Sequence[str] = ("lang", "source", "size_class"), shards: int = SHARDS,
          bits: int = BITS, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), curve, ``dims``
    and the columns ``carry``.

    Shards are equal runs (row counts at most one apart) along the Hilbert curve through the quantised
    ``dims``: columns of ``documents`` or ``size_class``.  Equal texts lie side by side, at the least curve
    index of the group, and within a group by their own index; so at most ``shards`` - 1 groups are
    cut, and a group of more than a shard is still cut along the curve.

    size is the text's UTF-8 bytes and 8; a null text has none, and counts as equal to an empty one.
    Null metadata come before all values.  Rows that repeat a doc_id, wholly or not, are placed each;
    their order is that of reading.  Fewer rows than shards leave shards empty; no document gives no
    row.  Other columns are ignored.
    """
    wanted = list(dict.fromkeys(["doc_id", "text", *[d for d in dims if d != "size_class"], *carry]))
    text = F.coalesce(F.col("_text"), F.lit("")).cast("binary")
    rows = own_columns(documents, *wanted).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *[c for c in wanted if c not in ("doc_id", "text")],
        *[F.col("text") for c in wanted if c == "text" and "text" in carry])
    rows = rows.withColumn("size", F.length(text).cast("long") + 8).withColumn("size_class", size_class(F.col("size")))
    rows = rows.withColumn("text_crc32", F.crc32(text)).withColumn("_group", F.md5(text)).withColumn(
        "_row", F.monotonically_increasing_id()).drop("_text")
    narrow = rows = stored(rows, "sizes")

    for k, dim in enumerate(dims):
        steps = quantised(narrow, dim, bits)
        rows = rows.join(steps.withColumnRenamed("value", f"_v{k}"), F.col(dim).eqNullSafe(F.col(f"_v{k}"))).withColumnRenamed(
            "cell", f"_c{k}").drop(f"_v{k}")
    rows = rows.withColumn("curve", curve_index([F.col(f"_c{k}") for k in range(len(dims))], bits)).drop(
        *[f"_c{k}" for k in range(len(dims))])
    rows = stored(rows, "curve")
    # the rows of one group are dealt to SALTS copies of its row
    groups = rows.groupBy("_group").agg(F.min("curve").alias("_first"), F.max("curve").alias("_last")).where("_first < _last").select(
        "_group", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = rows.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(groups, ["_group", "_salt"], "left").withColumn(
        "_first", F.coalesce("_first", "curve")).drop("_salt")
    out = placed(rows, [F.col(c) for c in ("_first", "_group", "curve", "doc_id", "_row")])
    n = max(narrow.count(), 1)
    drop_stored(narrow)
    at = F.expr(f"place * {shards} div {n}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")  # the first place of a shard
    return out.withColumn("shard", at.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", *dims, *[c for c in carry if c not in (*dims, "doc_id")])


def write_shards(sharded: DataFrame, path: str, dims: Sequence[str] = ("lang", "source", "size_class")) -> DataFrame:
    """Write ``sharded`` as one folder per shard, rows in slot order over as many files as tasks hold them, and the
    manifest beside it: per shard and dimension the least and greatest value, and whether nulls occur.  Returns the manifest."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/data")
    ranges = [F.struct(F.min(d).cast("string").alias("low"), F.max(d).cast("string").alias("high"),
                       F.max(F.col(d).isNull()).alias("nulls")).alias(d) for d in dims]
    sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges).write.parquet(f"{path}/manifest")
    return sharded.sparkSession.read.parquet(f"{path}/manifest")


def read_shards(spark, path: str, **wanted: str) -> DataFrame:
    """The written rows where each named string dimension equals the value given; only the shards whose
    manifest ranges hold all values are read."""
    manifest = spark.read.parquet(f"{path}/manifest")
    for dim, value in wanted.items():
        manifest = manifest.where((F.col(f"{dim}.low") <= value) & (F.col(f"{dim}.high") >= value))
    shards = [r.shard for r in manifest.select("shard").collect()]  # one row per shard
    rows = spark.read.parquet(f"{path}/data").where(F.col("shard").isin(shards) if shards else F.lit(False))
    for dim, value in wanted.items():
        rows = rows.where(F.col(dim) == value)
    return rows


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size FROM documents),
classed AS (
  SELECT *, CAST((length(bin(size)) - 1) * 4 + (size * 4 // CAST(2 ** (length(bin(size)) - 1) AS BIGINT)) % 4 AS INTEGER) AS size_class,
         md5(text) AS grp, row_number() OVER () AS rn FROM docs),
steps AS (
  SELECT d, value, CAST((row_number() OVER (PARTITION BY d ORDER BY value NULLS FIRST) - 1) * 16 // count(*) OVER (PARTITION BY d) AS INTEGER) AS cell
  FROM (SELECT DISTINCT 0 AS d, lang AS value FROM classed UNION ALL SELECT DISTINCT 1, source FROM classed
        UNION ALL SELECT DISTINCT 2, lpad(CAST(size_class AS VARCHAR), 9, '0') FROM classed)),
gridded AS (
  SELECT c.*, x.cell AS x, y.cell AS y, z.cell AS z FROM classed c
  JOIN steps x ON x.d = 0 AND x.value IS NOT DISTINCT FROM c.lang
  JOIN steps y ON y.d = 1 AND y.value IS NOT DISTINCT FROM c.source
  JOIN steps z ON z.d = 2 AND z.value = lpad(CAST(c.size_class AS VARCHAR), 9, '0')),
-- per corner of a cube: its rank along the Gray code; per rank: the corner entered and the turn of the frame
levels AS (
  SELECT x, y, z, 4 AS bit, 0::BIGINT AS h, 0 AS e, 0 AS d FROM (SELECT DISTINCT x, y, z FROM gridded)
  UNION ALL
  SELECT x, y, z, bit, h * 8 + w, xor(e, ((enter << roll) | (enter >> (3 - roll))) & 7),
         (d + list_extract([0, 1, 1, 2, 2, 1, 1, 0], w + 1) + 1) % 3
  FROM (SELECT *, list_extract([0, 0, 0, 3, 3, 6, 6, 5], w + 1) AS enter FROM (
    SELECT *, list_extract([0, 1, 3, 2, 7, 6, 4, 5], (((own >> roll) | (own << (3 - roll))) & 7) + 1) AS w
    FROM (SELECT x, y, z, bit - 1 AS bit, h, e, d, (d + 1) % 3 AS roll,
                 xor(((x >> (bit - 1)) & 1) | (((y >> (bit - 1)) & 1) << 1) | (((z >> (bit - 1)) & 1) << 2), e) AS own
          FROM levels WHERE bit > 0)))),
curved AS (
  SELECT g.*, l.h AS curve, min(l.h) OVER (PARTITION BY grp) AS first
  FROM gridded g JOIN levels l ON l.bit = 0 AND l.x = g.x AND l.y = g.y AND l.z = g.z),
placed AS (SELECT *, row_number() OVER (ORDER BY first, grp, curve, doc_id, rn) - 1 AS place, count(*) OVER () AS n FROM curved),
-- the CRC goes over the text's bytes, as two hexadecimal digits each
summed AS (
  SELECT doc_id, rn, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(text), '..'), lambda b: CAST('0x' || b AS BIGINT)),
                                     lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM classed, crc)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * 24 // n AS INTEGER) AS shard,
       CAST(place - ((place * 24 // n) * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard,
       curve, lang, source, size_class
FROM placed p JOIN summed s ON s.rn = p.rn
"""
