"""The queries of the corpus operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import best_fit, chat_format, conversation_repair, cutting_stock, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, nearest, personal_data, rolling_median, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_sequences(_table(spark, sf_dir, "documents"), tokenizer())


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", "repeats")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan(_table(spark, sf_dir, "documents"), with_text=False).drop("redacted")


def op7_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(_table(spark, sf_dir, "documents"), tokenizer(), control_ids=True)


#: Schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "top_k": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = chat_format.format_chats(_table(spark, sf_dir, "conversations"), TOOLS)
    return told.withColumn("message_sha256", F.sha2("message", 256)).select("conv_id", "turn", "place", "role", "message", "message_sha256", "n_calls", "n_linked", "status")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_table(spark, sf_dir, "documents"))


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median.rolling(_table(spark, sf_dir, "clicks"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_collision_counting": op2_collision_counting,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_language_id": op4_language_id,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_personal_data": op6_personal_data,
        "op7_cutting_stock_packing": op7_cutting_stock_packing,
        "op8_chat_format": op8_chat_format,
        "op9_source_mixing": op9_source_mixing,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_rolling_median": op11_rolling_median,
        "op12_line_dedup": op12_line_dedup,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": mixing.ORACLE, "op11_rolling_median": rolling_median.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
