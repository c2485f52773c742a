"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of documents. A document goes if its language can't be told (no text, no
letter, or two languages nearly as likely), if it is a near duplicate of a kept one, or if it holds a passage of the
benchmark; then sources are mixed to their weights, which repeats documents, and every copy gets its shard and slot.

In every stage null texts count as texts without words, repeated rows are rows of their own unless a stage is there to
remove them, ids may repeat or be null, further columns pass through whatever their names, and no row gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import fmindex, langid, mixing, nearcopies, sharding
from pairloom.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told, by dictionaries learned from ``docs``.

    Null, empty and letterless texts go, and so does a text that two languages shorten nearly as well, a tie included. The
    longest texts are encoded whole. Without any training row every document goes.
    """
    found = langid.identify(docs, langid.fit(docs))
    return found.filter(~F.col(found.columns[-1])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word similarities of at least 0.8 connect: SimHash, made whole.

    That of the smallest (id, text hash) stays, null ids last. Texts without a word, null ones too, are one group.
    """
    return nearcopies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a passage of the benchmark, texts unchanged; without words there is none."""
    found = fmindex.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size(found.columns[-2]) == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its source's target asks; some come not at all, which is what weights are for.

    A document without words takes no part in a source's size and comes as often as the whole part of its share.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy with its columns, its shard and its slot; rows of one id, null ones too, share a shard."""
    return sharding.sharded(docs, 40)


STAGES = [("language id", language), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: None: identification by compressed sizes and dependent rounding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
