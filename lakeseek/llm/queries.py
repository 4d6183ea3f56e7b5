"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeseek.llm import centroids, chat_format, decontaminate, divergence, embedding_neardup, html_text, language_id, line_dedup, mixing, ngram_join, substring_dedup, token_counts, warc
from lakeseek.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts_out=False).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring_dedup": op1_substring_dedup}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES |= {"op2_token_counts": op2_token_counts, "op3_language_id": op3_language_id}


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES |= {"op7_line_dedup": op7_line_dedup, "op8_decontaminate": op8_decontaminate}


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "source")


QUERIES |= {"op10_mix_sources": op10_mix_sources}


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 that quotes another template's control strings."""
    turns = table(spark, sf_dir, "conversations")
    quote = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", quote), (-1, 1, "assistant", quote)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(turns.select(*more.columns).unionByName(more))


QUERIES |= {"op5_chat_format": op5_chat_format}


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_all(index, folder, payloads=False).drop("payload", "target_uri")


QUERIES |= {"op6_warc_index": op6_warc_index}


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES |= {"op9_ngram_join": op9_ngram_join}


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op4_embedding_neardup": op4_embedding_neardup}


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES |= {"op11_source_divergence": op11_source_divergence, "op12_centroids": op12_centroids, "op13_html_text": op13_html_text}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES |= {"pipeline": pipeline}
