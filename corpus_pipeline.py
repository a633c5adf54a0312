"""Training corpus from raw documents, in five stages over the operators of weftgraph.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read back before the next one. All but the last return the columns of `documents`; the last returns
what the written token records say of each document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import saved
from weftgraph.llm.decontaminate import keep_clean
from weftgraph.llm.mixing import mix_sources, with_blocks
from weftgraph.llm.near_dup import keep_representatives
from weftgraph.llm.quality import keep_good
from weftgraph.llm.token_records import read_token_records, write_token_records

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: MinHash components and BM25 retrieval have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as its source's weight asks for."""
    return mix_sources(docs).drop("mix_block", "mix_key")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Records stand in the order of the mixture's blocks, so a document's copies lie a whole block apart."""
    ordered = with_blocks(docs.select("doc_id", "source", "text"))
    return read_token_records(write_token_records(ordered, TOKENIZER, order=[F.col("mix_block"), F.col("mix_key")]))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
