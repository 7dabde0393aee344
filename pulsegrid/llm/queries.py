"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, neardup, pii, quality, spelling, topk, toxicity, urlfilter, whitening
from .common import held_out, table
from .media import store_texts
from .mixing import mix
from .oracles import OP3_SQL, OP5_SQL, OP10_SQL
from .packing import Limits, pack
from .tokencount import count_tokens


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Limits())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations for training on answers: what is no assistant's bears no loss. All three limits bind here."""
    turns = table(spark, sf_dir, "conversations")
    answers = F.coalesce(F.col("role") == "assistant", F.lit(False))
    place = F.xxhash64("conv_id", "turn")  # a name for the turn, as the packer wants one number
    rows = turns.select(place.alias("doc_id"), F.when(answers, F.col("text")).alias("text"), F.when(~answers, F.col("text")).alias("asked"))
    packed = pack(rows, public_tokenizers.path("word_bpe_49k.json"), Limits(tokens=2048, segments=24, loss_tokens=1536), prompt="asked")
    return packed.select(F.col("doc_id").alias("turn_key"), "start", "length", "loss_tokens", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "segment", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = (pii.counted(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.PATTERNS))
    base = pii.written(F.col("base"))
    every = pii.written(pii.together(F.col("base"), F.col("added")))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), whole_rows=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "extra_words", "rate")


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), topk.Settings(k=20))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature tells the number of frames and where each clip ends."""
    stored = store_texts(table(spark, sf_dir, "documents"))
    ends = F.array_join(F.transform("clips", lambda c: c["end_frame"].cast("string")), ",")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";ends="), ends).alias("feature"),
    )


def op10_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Settings(words=2, percent=80))
    return found.drop("h").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op11_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), urlfilter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_pii, op4_mixing, op5_language_fusion, op6_kdtree_topk, op7_quality, op8_token_counts, op9_media_columns, op10_setsketch_dedup, op11_url_verdicts, op12_spelling_variants, op13_whitening, conversation_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_pii": OP3_SQL, "op5_language_fusion": OP5_SQL, "op6_kdtree_topk": OP6_SQL, "op10_setsketch_dedup": OP10_SQL, "op11_url_verdicts": urlfilter.OP11_SQL, "op12_spelling_variants": spelling.OP12_SQL}
