"""A training corpus from raw documents: STAGES in order, each on all that the one before it kept.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out, contaminated documents
go, and what is left is packed into token sequences. A stage's rows are written as Parquet in the shared folder and read
again by the next, so a lost executor never costs more than the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tandemlake.llm import decontaminate, near_copies, packing, suffix_dedup, toxicity
from tandemlake.llm.common import drop_all_but, write_stored, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES[:-1]:
        path = write_stored(stage(spark, docs, sf_dir), f"corpus-{name}")
        drop_all_but(spark, before, {path})  # the stage before and what this one wrote on its way
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
