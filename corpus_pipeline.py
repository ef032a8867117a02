"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage takes the documents that its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.decontam import without_leaks
from sievemark.llm.langid import with_language
from sievemark.llm.line_templates import with_fresh_lines
from sievemark.llm.ngram_join import without_near_copies
from sievemark.llm.packing import packed_documents
from sievemark.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, those without a letter, and those of which the network gives no window a language, go. Ties between
    languages don't matter, repeated rows stay or go together, and without a labelled row all texts with a letter stay."""
    return with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the document's with the smallest doc_id (null first; ties by a hash of the
    row); documents of which nothing stays go. Repeated rows stay or go together."""
    return with_fresh_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last; ties by a hash of the row) of each group stays, repeated rows once;
    null, empty and wordless texts stay."""
    return without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null and empty texts stay, repeated rows stay or go together."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences; a null or empty text is one piece of the end id, repeated rows are
    pieces of their own, and ties between lengths are settled by order."""
    return packed_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

#: SQL can't express the trained network, the alignment or the tokenizer; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
