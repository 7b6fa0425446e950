"""A training corpus from raw documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgrain.llm import contamination, langid, mixing, sharding, simhash
from docgrain.session import work_path


MIN_SCORE = 0.5  # posterior of the best language


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that language identification rejects go.

    Rejected are null texts, texts without a letter, and texts whose best language is less likely than all others together.
    """
    return langid.keep_identified(docs, min_score=MIN_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, see :func:`simhash.keep_one_of_each`."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return contamination.decontaminate(docs, bench)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: read in the order of files and rows, every stretch
    holds the sources by their weights, until one runs out."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; shards are contiguous in the order of the mix."""
    return sharding.balanced_shards(docs, order=_read_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", shard),
]

# A learned language model, connected components and suffix arrays have no SQL form here; the
# stages are tested against brute force.
ORACLE_SQL = None


def _read_order(docs: DataFrame) -> list | None:
    """File and row number of rows read from files, None for others."""
    try:
        name, row = docs["_metadata.file_path"], docs["_metadata.row_index"]
    except Exception:
        return None
    return [name, row]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; results between them lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
