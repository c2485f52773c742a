"""The queries of the corpus operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fmindex, langid, lexical, mixing, ogg, pieces, quality, resampling, sharding, simhash, suffixes, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slots(table(spark, sf_dir, "documents"), 40)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(table(spark, sf_dir, "pages"))


def op7_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, number -7, whose turns hold another template's control strings."""
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], real.schema)
    return chat.digests(chat.format_windows(real.unionByName(extra)))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.with_media(table(spark, sf_dir, "documents")))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.weighed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_mixing, op3_suffixes, op4_langid, op5_sharding, op6_warc, op7_fmindex, op8_simhash, op9_chat, op10_ogg, op11_lexical, op12_resampling, op13_pieces)}

ORACLE_SQL: dict[str, str] = {"op3_suffixes": suffixes.REMOVALS_SQL, "op6_warc": warc.READ_BACK_SQL, "op7_fmindex": fmindex.HITS_SQL, "op11_lexical": lexical.RANKED_SQL}
