"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the rows that stay, with the columns of documents; the last one returns
the pieces of the packed sequences. Between stages the rows are written and read
again.

Defined results: rows are told apart by their place in their file, so null and
repeated doc_ids do no harm; of rows that repeat doc_id and text one stays; null
and empty texts and those without a letter go at the first stage; a very long text
is a text like any other; ties go to the rows that the stages name; columns that
documents does not have are kept up to the last stage, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontamination, exact_dedup, language_id, ngram_join, packing
from quadrille.llm.queries import pack_query, table, tokenizer
from quadrille.llm.workspace import Workspace, free_name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or without text) go; a row without a lang gets the language that is found, if any was learned."""
    lang, score = free_name(docs, "lang_found"), free_name(docs, "lang_score")
    model = language_id.learn(docs)
    found = language_id.with_language(docs, model, lang, score)
    # a text with a letter has a score above 0; without a model none has
    stay = found.where(F.col(score) > 0) if model.languages else found.where(F.col("text").rlike(r"\p{L}"))
    named = F.coalesce(F.col("lang"), F.col(lang) if model.languages else F.lit(None)).alias("lang")
    return stay.select(*[named if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, of several with that doc_id one."""
    return exact_dedup.without_copies(docs, Workspace(spark, "exact-copies"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that similarity links connect the one with the smallest doc_id stays (null is smaller than any), of several with that doc_id one."""
    return ngram_join.without_near_copies(docs, Workspace(spark, "near-copies"))


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_query(packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=1))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_texts),
    ("packing", packed),
]

#: SQL expresses neither the language model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            work.drop(f"stage-{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
