r"""Line dedup: lines that many documents share are kept in one of them only.

Lines are split at \n; a line's key is the line without blanks (space, \t to \r) at both ends and
with A-Z lower-cased.  Keys travel as 128-bit hashes, one row per (key, document), so neither texts
nor lines are shuffled to find the repeated ones; partial minima, maxima and counts keep a key that
every document holds from becoming one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.llm.common import BLANKS, batch_rows, in_chunks, own_columns, settled, stored


SALTS = 16


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() touches A-Z only


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _long_keys(text: bytes | None, least: int):
    """(place, key hash) of the lines whose key has at least ``least`` code points."""
    for at, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= least:
            key = line_key(line)
            if len(key) >= least and _code_points(key) >= least:
                yield at, xxhash.xxh3_128_digest(key)


def _key_rows(least: int):
    def work(batch):
        keys, ids = [], []
        for doc_id, text in batch_rows(batch, "doc_id", "text"):
            own = {h for _, h in _long_keys(text, least)}
            keys += own
            ids += [doc_id] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])
    return lambda batches: in_chunks(batches, work)


def repeated_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(key, keeper): hashes of keys of at least ``min_chars`` code points that at least
    ``min_docs`` different documents hold, and the largest doc_id that holds each."""
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return _repeated(_keys(docs, min_chars), min_docs)


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(
        _key_rows(min_chars), "key binary, doc_id long").distinct()


def _repeated(keys: DataFrame, min_docs: int) -> DataFrame:
    # rows are distinct by now: a count is the number of documents, and needs no set per key
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(
        F.col("n") >= min_docs).select("key", "keeper")


def _rebuild(least: int, with_text: bool, carry: Sequence[str]):
    def work(batch):
        out = []
        for text, drop in batch_rows(batch, "text", "dropped"):
            lines = (text or b"").split(b"\n")
            n = len(lines)
            if drop:
                gone = set(drop)
                at_gone = {at for at, h in _long_keys(text, least) if h in gone}
                lines = [x for at, x in enumerate(lines) if at not in at_gone]
            kept = b"\n".join(lines)
            out.append((n, n - len(lines), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        through = ["doc_id", *carry]
        return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in through],
                                           *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                                          [*through, "n_lines", "n_dropped", "kept_sha256", "kept"])
    return lambda batches: in_chunks(batches, work)


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, with_text: bool = True,
                carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, the columns ``carry``, n_lines, n_dropped, kept_sha256 and, with ``with_text``, kept_text.

    A null or empty text is one empty line, which is never dropped; a document whose lines all go
    keeps an empty text.  Repeated lines in the keeping document all stay.  A null doc_id holds no
    line for others and loses none.  Rows that repeat a doc_id count as one document, and each is
    returned.  No document gives no row.  Other columns are ignored.
    """
    docs = own_columns(documents, "doc_id", "text", *carry).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carry)

    def make():
        keys = stored(_keys(docs, min_chars), "lines")
        # the documents of one line are dealt to SALTS copies of its row
        found = _repeated(keys, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        return own.join(found, ["key", "salt"]).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))

    # what is dropped grows with the corpus: never broadcast, however small it is here
    rows = docs.join(settled(make, "dropped").hint("merge"), "doc_id", "left")
    schema = StructType([rows.schema[c] for c in ("doc_id", *carry)]).add("n_lines", "long").add("n_dropped", "long").add(
        "kept_sha256", "string").add("kept", "binary")
    out = rows.mapInArrow(_rebuild(min_chars, with_text, carry), schema)
    cols = ["doc_id", *carry, "n_lines", "n_dropped", "kept_sha256"]
    return out.select(*cols, F.col("kept").cast("string").alias("kept_text")) if with_text else out.select(*cols)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.keeper IS NOT NULL AND h.keeper <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
