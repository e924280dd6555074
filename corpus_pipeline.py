"""A training corpus from raw documents: each stage is read from the Parquet that the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnfold.llm import common as C
from turnfold.llm.line_dedup import line_deduplicated
from turnfold.llm.mixing import mixed
from turnfold.llm.near_dedup import near_deduplicated
from turnfold.llm.quality_pu import accepted
from turnfold.llm.queries import tokenizer_file
from turnfold.llm.sentencepiece_viterbi import sentencepiece_encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs, C.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that had words and loses all of them goes."""
    counts = C.free_name(docs, "n_lines"), C.free_name(docs, "n_dropped")
    out = line_deduplicated(docs, counts)
    return out.filter((F.col(counts[1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words."""
    return near_deduplicated(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, shuffled."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return sentencepiece_encode(docs, tokenizer_file("piece_bpe_32k.model"), docs.columns)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", tokens)]

#: The classifier, line dedup and piece encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again."""
    docs = C.table(spark, sf_dir, "documents")
    at = f"{C.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
