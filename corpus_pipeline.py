"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a frame that
is written as Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars).

Every row is a document of its own, whatever its doc_id: rows without a doc_id stay, and rows that share
one are judged each by its own text.  Rows that repeat both doc_id and text are one document from line
dedup on.  A stage's decisions are small tables by row, stored before it returns; whatever else was
stored on the way is gone by then, and the texts are joined with the decisions once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontam, langid, lines, minhash, packing
from tidepool.llm.common import own_columns, settled, stored, table
from tidepool.llm.hilbert import placed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: least share of a text that its main language must have
MIN_SHARE = 0.4


def _identified(docs: DataFrame, others_after: bool) -> DataFrame:
    """The documents with ``row``, a number of each one's own: its doc_id.  Of rows that share a doc_id, the first by
    text digest has it; the others and rows without a doc_id get numbers after all doc_ids, or
    before them.  Of rows that repeat doc_id and text one stays."""
    rows = own_columns(docs, *COLUMNS)
    shared = settled(lambda: rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "shared")
    if shared.isEmpty():
        return rows.withColumn("row", F.col("doc_id"))

    twins = shared.withColumnRenamed("doc_id", "_d")
    mark = F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).otherwise("")
    odd = rows.join(twins, F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d").withColumn("mark", mark)
    edge = rows.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1 if others_after else F.coalesce(F.min("doc_id"), F.lit(0)) - 1).first()[0]

    def numbered():
        keys = odd.select("doc_id", "mark").distinct()
        first = keys.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("mark").alias("mark"))
        rest = keys.exceptAll(first)
        order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
        step = F.col("place") if others_after else -F.col("place")
        return first.withColumn("row", F.col("doc_id")).union(placed(rest, order).select("doc_id", "mark", F.lit(edge) + step))

    numbers = settled(numbered, "numbers").toDF("_d", "_m", "row")
    own = odd.join(numbers, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))).dropDuplicates(["row"])
    plain = rows.where("doc_id IS NOT NULL").join(shared.where("doc_id IS NOT NULL"), "doc_id", "left_anti")
    return plain.withColumn("row", F.col("doc_id")).unionByName(own.select(*COLUMNS, "row"))


def _by_row(rows: DataFrame, *carry: str) -> DataFrame:
    """What an operator gets: the row's number is its doc_id."""
    return rows.select(F.col("row").alias("doc_id"), "text", *carry)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a main language (one of ``MIN_SHARE`` of the text); ``lang``
    becomes the language found.  Where no row tells a language to learn, only documents without a
    letter go, and ``lang`` stays."""
    model = langid.train(docs)
    rows = own_columns(docs, *COLUMNS)
    if not model.langs:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    # the operator hands its doc_id through, so the other columns ride on it and nothing is joined
    rides = rows.select(F.struct("doc_id", "source", "n_chars").alias("doc_id"), "text")
    found = langid.predict(rides, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return found.select("doc_id.doc_id", "text", F.col("lang_pred").alias("lang"), "doc_id.source", "doc_id.n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, that of the greatest doc_id (one without a
    doc_id of its own comes last); a document left without any text goes.  Of rows that repeat doc_id and text
    one stays."""
    rows = _identified(docs, others_after=False).withColumn("ride", F.struct("doc_id", "lang", "source"))
    out = lines.dedup_lines(_by_row(rows, "ride"), carry=("ride",)).withColumn("text", F.col("kept_text"))
    return out.where(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0).select(
        "ride.doc_id", "text", "ride.lang", "ride.source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id (one without a
    doc_id of its own comes last); so of repeated rows one stays."""
    rows = _identified(docs, others_after=True)
    gone = settled(lambda: minhash.near_duplicates(_by_row(rows)).where("NOT kept").select(F.col("doc_id").alias("row")), "copies")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; each row is judged by its own text.  A null or empty text is
    clean; an empty benchmark leaves every document; of rows that repeat doc_id and text one stays."""
    rows = _identified(docs, others_after=True)
    leaks = decontam.leaks(_by_row(rows), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("row")), "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their sequences; a null or empty text is its end token alone, rows that
    share a doc_id are packed each, no document gives no row."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: language ID, near-dedup and packing have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
