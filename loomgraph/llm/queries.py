"""The queries of this folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, lines, mixing, packing, quality, rules, simhash, warc
from .common import read


def fold(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(4) != 2, tokenizer("piece_bpe_32k.model"))
    held_out = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, model, "doc_id").select("doc_id", held_out, "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels, fold(3) != 1)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those not held out."""
    docs = read(spark, sf_dir, "documents")
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return quality.score(docs, model, "doc_id").select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and the length and hash of what it keeps."""
    done = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"),
        F.array_sort("removed_lines").alias("removed_lines"),
        F.length("text").cast("bigint").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says what the template must escape."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    kind = {f.name: f.dataType for f in rows.schema}
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    return rows.unionByName(more)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted string."""
    return chat.conversation_digests(_conversations(spark, sf_dir))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same digests, of the same conversations in one table of four layouts."""
    return chat.layout_digests(chat.in_many_layouts(_conversations(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document, and whether it is kept."""
    docs = read(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, read(spark, sf_dir, "labels")), "doc_id")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive record gives it back."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"chat_layouts": chat_layouts}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have any. op7's search is exact up to three blocks, so its SQL holds for tables of as many vectors."""
    return {"op7_nearest_neighbours": ann.SQL, "op8_chat_formatting": chat.SQL, "chat_layouts": chat.SQL, "op10_warc_round_trip": warc.SQL}
