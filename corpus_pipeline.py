"""A corpus pipeline of the operators in hapdiff.llm: rules, lines, near copies, benchmark leaks, ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapdiff.llm import decontam, line_dedup, near_dedup, quality_rules, sentencepiece_codec
from hapdiff.llm.common import checkpoint_dir, read_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
POLICY = quality_rules.POLICIES["v1"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_rules.judge(quality_rules.ledger(docs), POLICY).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more hold; n_chars follows the text."""
    out = line_dedup.drop_common_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs, shingle=5, similarity=0.8)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and their count."""
    model = sentencepiece_codec.read_model(spark, VOCABULARY)
    return sentencepiece_codec.encode(docs, model).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", leaks),
    ("sentencepiece", ids),
]
#: The last stage has no SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the shared folder and read again, and goes when the next is written.

    What the last stage reads stays: the result is computed from it when it is asked for.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if before:
                _remove(spark, before)
            before = f"{base}/{name}"
    return docs
