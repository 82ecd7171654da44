"""A training corpus in five stages: toxic documents go, repeated lines go, near copies go, sources are mixed, and what
is taken is packed into sequences. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from territoria.llm import line_dedup, mixing, ngram_join, packing, toxicity
from territoria.llm.common import cut, dropped, tidy
from territoria.llm.queries import table, tokenizer


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. The classifier learns from the labelled rows of the given documents that aren't held
    out; a document's own label is no input of its score. Rows stay as they are, repeated ones and empty ones too."""
    return toxicity.clean_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, nearly, an earlier line; those that lose all their lines go. Null, empty and
    blank texts stay; a similarity of 0.8 counts; an empty table gives no rows."""
    return line_dedup.without_repeated_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of word n-grams join, the one with the smallest doc_id. Null and wordless
    texts have no links and stay; a similarity of 0.8 counts; of repeated rows one stays; an empty table gives no rows.
    The line stage before has taken whole copies already, so what comes here are texts that differ in every line."""
    return ngram_join.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row for each time, by quality labels where there are any. Null texts and
    those without words come as often as whole epochs of their source do; a null source is one of its own; ties of keys
    go by doc_id and size; rows that repeat share what is taken; an empty table gives no rows."""
    return mixing.repeated(docs, table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, a row for each: doc_id, start, length, ids_crc32, doc_tokens,
    loss_tokens, sequence_id, offset. A null or empty text is a piece of the end id alone; ties go to the smaller doc_id
    and start; rows that repeat are documents of their own; an empty table gives no rows."""
    return packing.packed_documents(docs, tokenizer())


STAGES = [("toxicity", clean), ("line_dedup", without_repeated_lines), ("ngram_join", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: MinHash, learned scores and packing aren't SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that come of `documents`; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, tidy(lambda docs, stage=stage: cut(stage(spark, docs, sf_dir)))(docs)
        dropped(before)  # the stage's result is written
    return STAGES[-1][1](spark, docs, sf_dir)
