"""From raw documents to token ids: five stages, each an operator of timetide.llm over all that the stage before kept.

Each stage takes (spark, docs, sf_dir); the driver of a run writes what it returns as Parquet and reads it again for
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetide.llm import bpe, jaccard, mixing, substrings, toxicity
from timetide.llm.registry import VOCABULARY
from timetide.operators import lineage

#: A document of this score or more goes.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model is fitted on a bounded sample of the labelled documents in docs."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, carry=True).filter(F.col("__toxicity") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a document that loses none keeps its text as it is, the others one space a gap."""
    rows = substrings.dedup_substrings(docs)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    chars = F.when(F.col("__n_removed") > 0, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (little-endian uint32), their number, and digests of the ids and of the decoded text."""
    return bpe.bpe_encode(docs, VOCABULARY, with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Neither the network of the first stage nor the merges of the last can be written in SQL; tests/llm holds brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again; what the next stage has read goes."""
    lineage.ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
