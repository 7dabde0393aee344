"""A corpus from documents to packed sequences: each stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, neardup, packing, pii, toxicity
from pulsegrid.llm.common import cut, drop, table, unused

#: A document is rejected at this score or more.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below `TOXIC`. The classifier learns from the labels of the documents given.

    Null and empty texts score as texts without evidence and stay; long texts are scored whole; repeated rows fare
    alike; without labels of both classes every score is the share of label 1; an empty table stays empty; columns of
    any name are kept.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = unused("toxic_score", docs.columns)
    return toxicity.with_score(docs, model.scorer, score).filter(F.col(score) < TOXIC).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; two words in a shingle, similarity 0.8.

    A changed word changes two shingles, so texts with one word in twenty changed still count as copies, as in
    `op10_setsketch_dedup`. With five words in a shingle it was one in forty-five, and little but exact copies went.

    Null and empty texts are linked with nothing and stay; long texts are compared whole; of rows that repeat an id and
    its text one stays, an id's other texts are judged on their own; rows without an id go where a row with one stays,
    and count as repeats of one another only with equal texts; an empty table stays empty; columns of any name are kept.
    """
    found = neardup.near_duplicates(docs, neardup.Settings(words=2, percent=80))
    h = unused("text_hash", docs.columns)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(f"{h}_id"), F.col("h").alias(f"{h}_of")).distinct()
    mine = F.col("doc_id").eqNullSafe(F.col(f"{h}_id")) & (F.col(h) == F.col(f"{h}_of"))
    kept = docs.withColumn(h, F.xxhash64("text")).join(gone, mine, "left_anti")
    return kept.dropDuplicates(["doc_id", h]).drop(h)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced.

    Null texts stay null; long texts are searched whole; of spans that overlap the first counts; repeated rows are
    changed alike and count as documents of their own; an empty table stays empty; columns of any name are kept.
    """
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last copy of a few in part.

    Null and empty texts have no words: they come as often as their rate and a hash of their id say; long texts count
    with all their words; a null source is a source; repeated rows are mixed each; equal ids and sizes turn in any
    order; an empty table stays empty; columns of any name are kept.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")  # no column's name can clash
    mixed = mixing.expand(mixing.mix(docs.select("doc_id", "text", "source", row)), ["text", "row"])
    return mixed.select(*(F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    Null and empty texts hold the end id alone; long texts are cut into as many pieces as it takes; equal demands go by
    order; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Limits())
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", one_of_each_group),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifier, likelihoods and tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared checkpoint folder and read again.

    What a stage has read goes once it is written; the last one's input goes with the application.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
