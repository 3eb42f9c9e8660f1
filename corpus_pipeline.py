"""The corpus pipeline: language ID, line dedup, near-duplicate join, mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollguard.llm import jaccard, language, linededup, mixing, tokens
from tollguard.llm.base import free_name
from tollguard.session import scratch_path, scratch_scope

#: The least cosine of texts too short to be told from random letters.
LEAST_SCORE = 0.03
BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; the others go.

    A document goes if its text is NULL, has no letter, or is as far from every learned language as
    random letters a to z of its length, whose scores are measured against the same prototypes.
    Short documents in a language stay, whatever their label says; below 15 letters words and
    random letters score alike, and only ``LEAST_SCORE`` is asked for. Where nothing can be learned
    (no labels), all texts with a letter stay.
    """
    prototypes = language.learn(docs)
    pred, score = free_name("_lang_pred", docs), free_name("_score", docs)
    found = language.identify(docs, prototypes, lang_pred=pred, score=score)
    if not prototypes:
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    noise = language.noise(prototypes)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    least = F.lit(LEAST_SCORE)
    for n, top in noise:
        least = F.when(letters >= n, F.lit(max(top, LEAST_SCORE))).otherwise(least)
    # letters are counted only where they can matter
    like = F.when(found[score] >= max(top for _, top in noise), True).otherwise(found[score] >= least)
    kept = found.filter((found[pred] != language.UNDETERMINED) & like)
    return kept.drop(pred, score)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; n_chars follows the text."""
    left = linededup.dedupe_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents but for the text, with its ids and the digests of ids and of
    the decoded bytes."""
    return tokens.encode_documents(docs, *BPE).drop("text")


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedupe_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express the language profiles, so run() is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
