"""A corpus pipeline over `documents`: drop toxic documents, then near-copies, then benchmark leaks, redact secrets,
and encode what is left.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the last
return the columns of `documents`. `run` writes each stage's result as Parquet to the folder the cluster shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontam, secrets, simhash, toxicity
from skein.llm.common import checkpoint_dir
from skein.llm.queries import held_out, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by the network trained on the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    texts, y, share = toxicity.training_rows(docs, labels)
    return docs.where(toxicity.score(F.col("text"), toxicity.train(texts, y, share)) < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones. Two link if their SimHash fingerprints do, by op5's
    rule (three-word shingles, at most 2 differing bits), or if their sets of five-word shingles have similarity 0.8 or more."""
    return simhash.distinct_documents(docs, shingle=5, min_similarity=0.8, print_shingle=3).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is similar to a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars is that of the new text."""
    return docs.withColumn("text", secrets.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether decoding these gives the text back."""
    found = bpe.encode(docs.select(*COLUMNS), tokenizer_path(), decoded="decoded")
    return found.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", redact_secrets),
    ("bpe", encode),
]
#: Learned scores and byte-pair merges are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read back from the Parquet files it wrote."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
