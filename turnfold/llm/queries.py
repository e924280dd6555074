"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .imatch import fingerprints
from .line_dedup import line_deduplicated
from .mixing import POWER, mixed
from .near_dedup import near_components
from .pii import personal_data
from .quality_pu import quality_scores
from .quality_rules import quality_rules
from .sentencepiece_viterbi import sentencepiece_encode
from .substring_dedup import substring_deduplicated
from .token_files import token_files

MIX_SEED = 20


def tokenizer_file(name: str) -> str:
    """Where the public vocabularies lie; TURNFOLD_TOKENIZERS names another folder."""
    if folder := os.environ.get("TURNFOLD_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_deduplicated(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_deduplicated(_documents(spark, sf_dir), counts=("n_lines", "n_dropped"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_documents(spark, sf_dir), width=2, percent=80)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_documents(spark, sf_dir), power=POWER, seed=MIX_SEED, copy_col="copy").withColumn("copy", F.col("copy").cast("long"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_pii, op4_substring_dedup, op5_quality_rules, op6_line_dedup, op7_token_files, op8_fingerprints, op9_near_dedup, op10_mixing)}
