"""From raw documents to packed sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from siteferry.llm.line_dedup import drop_duplicate_lines
from siteferry.llm.mixing import mixed_stream
from siteferry.llm.near_dedup import drop_near_duplicates
from siteferry.llm.packing import pack
from siteferry.llm.queries import word_tokenizer
from siteferry.llm.toxicity import drop_toxic, toxicity_model
from siteferry.session import staging_path

# Packing comes last, in executors whose heaps the stages before have grown to their limit, so its workers cache little.
PACK_CACHE_BYTES = 32 << 20


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from labelled rows of the input."""
    return drop_toxic(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has, alike or nearly; one that loses all of them goes."""
    return drop_duplicate_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources take turns by their target weights."""
    return mixed_stream(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs, word_tokenizer(), cache_bytes=PACK_CACHE_BYTES)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# Scores of a trained model and token ids are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`, each written and read again in the shared folder."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        path = staging_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
