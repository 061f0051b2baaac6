"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's docs.

Each stage gets the session, all documents that its predecessor kept and the folder of the tables; all but the last return the
columns of documents. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import bpe, common, langid, lines, simhash, winnowing

MIN_SCORE = 0.4
#: The bound that lines.py meets without comparing the lines of a key in pairs, whatever the groups' sizes.
LINE_EDITS = 1
#: Words of a shingle; bits by which one fingerprint of two near-duplicates differs at most, and both of them together. Unrelated
#: texts differ in 32 of 64 bits, those of similarity 0.8 in some 10: the bound on both tells a chance partner of one.
SHINGLE, RADIUS, TOTAL = 5, 6, 24
#: Keys of 16 bytes that are broadcast at most, counted before.
MOST_BROADCAST = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts whose best language gets less than MIN_SCORE, go; what stays keeps its columns.

    The network learns from the labelled documents that aren't held out; a row's own lang is no input of its prediction."""
    return langid.keep(docs, langid.fit(docs.where(~langid.is_held_out())), min_score=MIN_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or are within LINE_EDITS of one, go; no document does."""
    cleaned = lines.clean(docs, edits=LINE_EDITS)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs, size=SHINGLE, radius=RADIUS, total=TOTAL)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of a benchmark item go."""
    hit = winnowing.occurrences(docs, common.load(spark, sf_dir, "benchmark")).select(F.col("k").alias("__hit_k"), F.col("t").alias("__hit_t")).distinct()
    hit = common.written(hit, "contaminated")
    hit = F.broadcast(hit) if hit.count() <= MOST_BROADCAST else hit
    keyed = docs.withColumns({"__hit_k": common.doc_key(), "__hit_t": F.xxhash64("text")})
    return keyed.join(hit, ["__hit_k", "__hit_t"], "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of every document that is left."""
    import public_tokenizers

    found = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decode=False)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]
#: The network and the tokenizer aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has read is deleted once its own table is written."""
    docs, before = common.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, read = common.written(stage(spark, docs, sf_dir), name), before
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
        if read:
            common.remove(read)
    return docs
