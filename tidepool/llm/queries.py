"""One query per operator, with production parameters, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import chat, decontam, hilbert, hnsw, langid, lines, minhash, packing, phrases, repair, substrings, toxicity, urls
from tidepool.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate_perspectives(table(spark, sf_dir, "conversations")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.RULES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": (op1_minhash_near_dedup, None),
    "op2_line_dedup": (op2_line_dedup, lines.ORACLE),
    "op3_embedding_near_dedup": (op3_embedding_near_dedup, None),
    "op4_chat_formatting": (op4_chat_formatting, chat.ORACLE),
    "op5_url_filters": (op5_url_filters, urls.ORACLE),
    "op6_substring_dedup": (op6_substring_dedup, None),
    "op7_benchmark_decontamination": (op7_benchmark_decontamination, decontam.ORACLE),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_language_id": (op9_language_id, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_phrase_collocations": (op11_phrase_collocations, phrases.ORACLE),
    "op12_conversation_repair": (op12_conversation_repair, repair.ORACLE),
    "op13_hilbert_sharding": (op13_hilbert_sharding, hilbert.ORACLE),
}
