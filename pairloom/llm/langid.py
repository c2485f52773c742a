"""Language identification by compression: the language whose text helps zstandard most to shorten a document.

Each language has a raw-content dictionary made of training texts. A document is encoded once per language, in blocks,
so that its own history doesn't outgrow the dictionary; the smallest sum of sizes wins. Where the runner-up is nearly as
small, the document is rejected.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bound_batches, free_name, held_out, small_side, staged

LETTER = regex.compile(r"\p{L}")
NONE = "und"

#: Bytes of a text that are encoded together.
BLOCK = 4096

#: A document is rejected if the runner-up needs less than this share of bytes more.
NARROW = 0.01


def fit(docs: DataFrame, texts: int = 160, blocks: int = 80, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content of each language: a bounded sample of its training rows.

    Of a language's different texts the ``texts`` of the smallest hash are cut into blocks of 4096 characters, whole texts
    with no part left out, and the ``blocks`` blocks of the smallest hash make the dictionary. So a language with much text
    has about 320 KB, one with less has all it has, and none is cut to the size of another. Training rows have a language,
    a letter, and crc32(id) mod 5 other than 0. No training row gives no dictionary.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    train = rows.filter(F.col("lang").isNotNull() & ~F.col("held") & F.col("text").rlike(r"\p{L}")).withColumn("mark", F.xxhash64("text", F.lit(42)))
    marks = train.select("lang", "mark").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).filter(F.col("r") <= texts)
    chosen = staged(marks.select(F.col("lang").alias("l"), F.col("mark").alias("m")), "language-texts")
    found = train.join(small_side(chosen), (F.col("mark") == F.col("m")) & (F.col("lang") == F.col("l"))).select("lang", "mark", "text").dropDuplicates(["lang", "mark"])
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int")))
    cut = found.withColumn("at", at).select("lang", F.substring(F.col("text"), F.col("at") * BLOCK + 1, F.lit(BLOCK)).alias("block"), F.xxhash64("mark", "at").alias("order"))
    best = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("r") <= blocks)
    pieces: dict[str, list[tuple]] = {}
    for row in best.select("lang", "order", "block").collect():  # bounded by the number of languages
        pieces.setdefault(row["lang"], []).append((row["order"], row["block"]))
    return {k: "\n".join(b for _, b in sorted(v)).lower().encode() for k, v in sorted(pieces.items())}


class Coder:
    """Encoders of all languages; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.encoders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # The matches that tell short words and endings apart have four bytes; a lazy search finds most of them.
            params = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=19, hash_log=17, chain_log=17, search_log=3, target_length=16,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            self.encoders.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). Null texts and texts without a letter are ``und``, 0 and rejected."""
        if text is None or not self.langs or not LETTER.search(text):
            return NONE, 0.0, True
        sizes = self.sizes(text.lower().encode())
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        runner = min(s for k, s in enumerate(sizes) if k != best)
        spread = max(1.0, 0.02 * sizes[best])
        score = 1.0 / sum(math.exp(-(s - sizes[best]) / spread) for s in sizes)
        return self.langs[best], score, (runner - sizes[best]) / runner < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred``, ``score``, ``lang_rejected``; whole texts, no shuffle.

    Names that are taken get underscores. The dictionaries are bounded by ``fit`` and broadcast. Null texts and texts
    without a letter are rejected as ``und`` with the score 0; of equally small sizes the first language by name wins and
    the document is rejected; rows with equal texts get the same; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    names = [free_name(docs.select(*keep), x) for x in ("lang_pred", "score", "lang_rejected")]
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    width = len(keep)

    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            rows = [coder.identify(x.as_py()) for x in b.column(width)]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *cols], names=[f"c{i}" for i in range(width + 3)])

    positional = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    out = docs.select(*keep, F.col(text_col).alias(free_name(docs, "text_to_identify"))).mapInArrow(run, positional)
    return out.toDF(*schema.names)


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document, by dictionaries learned from ``docs``."""
    out = identify(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.col("lang_rejected").alias("rejected"))
