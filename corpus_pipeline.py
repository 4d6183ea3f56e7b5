"""A corpus pipeline: five stages over documents, each one operator.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its
predecessor kept; run() writes each result as Parquet in the shared folder and
reads it again.  All stages but the last return the columns of documents.

Defined results: rows that a stage can't judge (null texts in line de-duplication,
rows without a doc_id in the join and the decontamination) stay; language
identification drops null texts, texts without letters, and texts whose two nearest
languages are about equally near (``language_id.MARGIN``). Extra columns pass up to the
last stage, whatever their names. Of empty tables nothing comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeseek.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from lakeseek.llm.common import scratch, stash, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang stays as it was."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more hold. n_chars follows the text."""
    from pyspark.sql import functions as F

    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    return ngram_join.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document that is taken, with its number of copies."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Language identification and the join can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Every table made on the way is deleted at the end, but for the last stage's.
    with scratch() as keep:
        for name, stage in STAGES:
            written = keep if name == STAGES[-1][0] else stash
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
