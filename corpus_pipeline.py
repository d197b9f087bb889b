"""A training corpus in five stages. Counted as part of farwheel.llm.

Every stage takes null and repeated rows, empty and very long texts, an empty table and columns beyond those of documents,
and says below what it does with them; all but the last keep the columns that they are given, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farwheel.llm import contamination, jaccard, langid, lines, packing
from farwheel.llm.shared import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects go. Learned as in op4, from the labelled rows outside the held-out fold.

    Null texts and texts without a letter go; a null doc_id is a row like others; repeated rows stay or go together; of two
    languages of one size the first by name counts, with a margin of 0 and so a rejection; without labelled rows all go."""
    model = langid.learn(docs.where(~langid.held_out()).select("text", "lang"))
    return langid.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup; n_chars follows the text. Documents of which no line is left go.

    A null text becomes an empty one; a null doc_id keeps its text; rows of one doc_id lose the same lines."""
    kept = lines.dedup_lines(docs, names=("__lines", "__gone")).where(F.col("__gone") < F.col("__lines"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five words at 0.8; one document of each group stays, that of the smallest doc_id.

    Empty texts link with nothing and stay; so do rows of a null doc_id; rows of one doc_id stay or go together."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts, and all if the benchmark is empty, stay."""
    return contamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048. A null or empty text is the one end id; every row is packed for itself."""
    packed = packing.pack(docs, capacity=2048, carry={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]
#: SQL can't express the compression classifier, SimHash and tokenisation; tests/llm compares stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = written(docs, name)
    return docs
