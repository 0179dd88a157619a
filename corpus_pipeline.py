"""A corpus pipeline of five text operators: documents in, token digests of what is kept out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. Nulls, empty texts, repeated rows, ties and empty tables are dealt with as the operators say: a row
with a null id or text is scored like any other, and goes if its score is low; a null text has no lines, no words and
no overlap; of a class of near-duplicates, repeated rows and rows without an id included, one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraframe.llm import _common as C
from spectraframe.llm import byte_bpe, fuzzy_lines, gam_quality, icws_minhash, spaced_seeds


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    model = gam_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam_quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; n_chars follows the text."""
    out = fuzzy_lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return icws_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the benchmark."""
    return spaced_seeds.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_stretch=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents' ids and decoded bytes."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: Trained models, signatures and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
