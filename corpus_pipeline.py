"""A pipeline for training text: language ID, near duplicates, benchmark decontamination, secrets, byte-level BPE.

STAGES are (name, function); a function takes (spark, docs, sf_dir), reads all rows its predecessor kept and returns a DataFrame that is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.bpe import bpe_encode
from tesela.llm.byte_cnn import JUNK, UNKNOWN, predict, train
from tesela.llm.common import fold, saved, table
from tesela.llm.ngram_join import jaccard_groups
from tesela.llm.secret_scan import mask_secrets
from tesela.llm.spaced_seed import without_leaks

#: Shorter texts are too little to tell noise by.
LEAST_BYTES = 192
_ROW = "__row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts of LEAST_BYTES or more that are more like noise than like any learned language.

    The network learns from the documents table's training rows, and from made-up noise a class of its own; so a text that mixes learned languages
    stays, however many there are. Null and empty texts go. Repeated rows each count, null keys stay, an empty table gives none.
    """
    network = train(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1, junk=True)
    noise = (F.col("__lang") == JUNK) & (F.octet_length("text") >= LEAST_BYTES)
    return predict(docs, network, names=("__lang", "__score")).filter((F.col("__lang") != UNKNOWN) & ~noise).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (five-word shingles, Jaccard 0.8): that with the smallest doc_id, nulls last; of several texts with that doc_id one.

    Rows are told apart by doc_id and text, so a row stays or goes by its own text, whatever other rows have its doc_id. Rows that repeat both are one
    group and leave one, whichever it is if other columns differ. Texts without a word are in no group and all stay, as do null ones.
    """
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.withColumn(_ROW, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")))
    some = marked.filter(worded)
    rows = jaccard_groups(some, key=_ROW, k=5, num=80, den=100).groupBy(_ROW, "component_id").agg(F.count("*").alias("n"))
    rows = saved(rows.select(_ROW, (F.col(_ROW) == F.col("component_id")).alias("first"), "n"), "rows")
    several = rows.filter("first and n > 1").select(_ROW)
    alone = some.join(rows.filter("not first or n > 1").select(_ROW), _ROW, "left_anti")
    return alone.unionByName(some.join(several, _ROW, "left_semi").dropDuplicates([_ROW])).unionByName(marked.filter(~worded)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage. Null and empty texts stay; repeated rows stay or go alike, null keys stay, an empty table gives none."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets masked and n_chars put right. Null and empty texts, repeated rows and null keys stay; an empty table gives none."""
    return mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, one row for each of docs: what a training run reads. Null and empty texts have no token; an empty table gives none."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("secret_scan", secrets), ("byte_level_bpe", tokens)]

#: Learned models and links over unbounded groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
