"""A corpus pipeline over documents: quality, near duplicates, repeated passages, the mix of sources, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns a DataFrame, which is
written as Parquet and read again as docs of the next. All but the last return the columns of documents. Nulls, empty
texts, repeated rows and extra columns are treated as in the operators' modules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.bpe import token_digests
from threadloom.llm.chosen_path import keep_one
from threadloom.llm.common import stage, table
from threadloom.llm.mixing import repeat_copies
from threadloom.llm.quality import keep_quality
from threadloom.llm.queries import VOCABULARY
from threadloom.llm.substring import dedup_substrings
from threadloom.plans.staging import drop, temporary_tables


#: Chunks that a worker of the last stage remembers: fewer than in op5_bpe, as the JVM still holds the heap of earlier stages.
TOKENS_REMEMBER = 120_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of passages that an earlier document has; what is left is joined by one space. Other texts stay as they are."""
    names = docs.columns
    done = dedup_substrings(docs)
    changed = F.col("dedup_removed") > 0
    done = done.withColumn("text", F.when(changed, F.col("dedup_text")).otherwise(F.col("text")))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return repeat_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    return token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, remember=TOKENS_REMEMBER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("tokens", tokens)]

#: Trained trees and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way goes when its result is written, and that when the next is."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, step) in enumerate(STAGES):
        with temporary_tables(spark) as keep:
            done = keep(stage(step(spark, docs, sf_dir), f"pipeline-{name}"))
        if at:
            drop(docs)
        docs = done
    return docs
