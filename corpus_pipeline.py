"""The corpus pipeline: from raw documents to token ids, in five stages of the corpus operators.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all that the one before kept, and
all but the last return the columns of documents.  run() writes every stage's result as Parquet to
the shared scratch folder and reads it again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import bpe, decontaminate, linededup, quality, sigtree
from basalt.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.5)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, score="__score", predicted="__predicted")
    return scored.where("__predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of three lines or more, n_chars (if there is one) to match; a text of nothing else goes."""
    kept = linededup.dedup_lines(docs).where("n_removed = 0 OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that five-word shingles of Jaccard 0.75 or more link."""
    return sigtree.keep_one(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_leaking(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with token_ids (little-endian unsigned 32-bit integers) and n_tokens."""
    coded = bpe.encode_documents(docs)
    return coded.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: The classifier, the near-copy search, edit distances and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
