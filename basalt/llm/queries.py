"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linededup import SQL as LINE_DEDUP_SQL


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with held_out, score and predicted; the model is fitted on labels that are not held out."""
    from .quality import held_out, score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity and P(toxic); labels mark 0 or 1, so grades above 1 are by cue words."""
    from .toxicity import held_out, score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "severity", "p_toxic", "toxic_predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a document lies in a directory of its source, by its id's thousands and hundreds."""
    from .common import Scratch
    from .licenses import inherit, scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), (F.col("doc_id") / 1000).cast("long"), (F.col("doc_id") / 100).cast("long"), "doc_id")
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return inherit(Scratch(spark).put(scan(files))).withColumnRenamed("file_id", "doc_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, edits, similarity, end_word) for every benchmark item that a document leaks."""
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines of repeated three-line windows, and how many went."""
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and the smallest doc_id that links reach."""
    from .sigtree import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it is kept."""
    from .itq import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text and that text's length in code points."""
    from .sitetree import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of the probe, read back from the formatted texts."""
    from .chat import format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra)))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    from .bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_decontamination, op3_line_dedup, op4_ngram_jaccard, op5_embedding_dedup, op6_html_extraction, op7_toxicity, op8_chat_formatting, op9_license_scan, op10_bpe_encoding)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL}
