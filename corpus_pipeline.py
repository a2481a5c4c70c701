"""From raw documents to token ids: five stages over whole texts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's documents.
All but the last keep the columns of the documents table.

Stages reject rows, not ids: rows without an id are judged as all others, and a
rejected row leaves other texts of its id alone.

Counted as part of the training-data subpackage, with which it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join, toxicity
from orbweave.llm.queries import read, vocabulary_path
from orbweave.llm.rows import KEY, keyed, without
from orbweave.llm.scratch import materialize

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents with a score of at least 0.5 go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~language_id.held_out(F.col("doc_id"), 5, 0))
    docs = keyed(docs)
    found = toxicity.score(docs.withColumn("doc_id", F.col(KEY)), model)
    return without(docs, found.where("score >= 0.5").select(F.col("doc_id").alias(KEY)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the row with the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of an item go."""
    docs = keyed(docs)
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"), id_col=KEY)
    return without(docs, found.where(F.size("items") > 0).select(F.col("doc_id").alias(KEY)))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: number and hash of the token ids, hash of the decoded text."""
    return bpe.encode_decode(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe", to_tokens),
]

#: Tree ensembles and BPE are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
