"""SentencePiece encoding by a table of prefixes, and decoding.

Merging the best pair again and again gives a text one encoding, and cutting it between two of its pieces leaves the
encodings of both sides as they are. So every prefix of a text has exactly one last piece: the piece that ends there,
that merges to itself, and that stays apart from the last piece of what is before it. An automaton finds the pieces that
end at each place, the test of a pair merges the two alone, and the ids are read backwards from the table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, free_name

#: What a vocabulary writes for a blank. Fixed value.
BLANK = "▁"

NONE = float("-inf")


class Pieces:
    """A merge-type vocabulary: pieces with scores, the better merged first, at equal scores the leftmost.

    ``special`` are ids of control, unknown and byte pieces, which no merge makes. Characters without a piece become
    bytes if ``byte_ids`` is given, else ``unknown``.
    """

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], unknown: int, byte_ids: list[int] | None, remembered: int = 300_000):
        import ahocorasick

        self.unknown, self.byte_ids, self.remembered = unknown, byte_ids, remembered
        self.base = len(pieces)
        self.score = {p: scores[i] for i, p in enumerate(pieces) if i not in special}
        self.id = {p: i for i, p in enumerate(pieces) if i not in special}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.ends: dict[int, list[tuple[float, str]]] = {}
        self.begins: dict[int, list[tuple[float, str]]] = {}
        for p, i in self.id.items():
            made = self._history(p)
            if made[-1] == [p]:  # other pieces are never a result
                self.automaton.add_word(p, (i, len(p)))
                values = [*map(self._best, made)]
                self.ends[i] = [(v, parts[-1]) for v, parts in zip(values, made)]
                self.begins[i] = [(v, parts[0]) for v, parts in zip(values, made)]
        self.size = {i: len(p) for p, i in self.id.items()}
        self.automaton.make_automaton()
        self.cut = self._cuts()

    def _best(self, parts: list[str]) -> float:
        return max((self.score.get(a + b, NONE) for a, b in zip(parts, parts[1:])), default=NONE)

    def _history(self, text: str) -> list[list[str]]:
        """Plain merging, step by step: the best neighbouring pair, the leftmost of equals, becomes one."""
        steps = [list(text)]
        while (best := self._best(parts := steps[-1])) > NONE:
            i = next(i for i, (a, b) in enumerate(zip(parts, parts[1:])) if self.score.get(a + b) == best)
            steps.append([*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]])
        return steps

    def _cuts(self) -> re.Pattern:
        """Parts that no piece spans: characters that are in no longer piece are alone, and a blank begins a part after
        anything but a blank, unless some piece has one inside. If no piece has a letter beside another character, such as a
        point, a part ends between them, so that a word is the same part before any."""
        joined = {c for p in self.id if len(p) > 1 for c in p}
        inside = "".join(map(re.escape, sorted(joined - {BLANK})))
        if BLANK not in joined:
            return re.compile(f"[{inside}]+|[^{inside}]" if inside else ".", re.S)
        if any(BLANK in p.lstrip(BLANK) for p in self.id) or not inside:
            return re.compile(f"[{BLANK}{inside}]+|[^{BLANK}{inside}]", re.S)
        letters, others = ("".join(map(re.escape, sorted(c for c in joined - {BLANK} if c.isalpha() == e))) for e in (True, False))
        if not letters or not others or any(a.isalpha() != b.isalpha() for p in self.id for a, b in zip(p, p[1:]) if a != BLANK):
            return re.compile(f"{BLANK}+[{inside}]*|[{inside}]+|[^{BLANK}{inside}]", re.S)
        return re.compile(f"{BLANK}+(?:[{letters}]+|[{others}]*)|[{letters}]+|[{others}]+|[^{BLANK}{inside}]", re.S)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging both pieces' texts side by side never joins them: their own merges go on in turn, the better
        first, the left one of equals, and a pair across the border must not come before both."""
        get, left, right, i, j = self.score.get, self.ends[a], self.begins[b], 0, 0
        while True:
            (s, x), (r, y) = left[i], right[j]
            across = get(x + y)
            if across is not None and across > s and across >= r:
                return False
            if s >= r:
                if s == NONE:
                    return True
                i += 1
            else:
                j += 1

    def last_pieces(self, text: str) -> list[int]:
        """For every prefix the number of its last piece; -1 for the empty one and where no piece covers the character."""
        last, done, apart, base = [-1] * (len(text) + 1), 0, self.apart, self.base
        for at, (piece, size) in self.automaton.iter(text):  # by end
            if at < done:  # the prefix that ends here has its piece
                continue
            before = last[at + 1 - size]
            if before >= 0:  # else nothing is there that could join
                pair = before * base + piece
                fits = apart.get(pair)
                if fits is None:
                    if len(apart) >= 2 * self.remembered:
                        apart.clear()
                    fits = apart[pair] = self.stay_apart(before, piece)
                if not fits:
                    continue
            done = at + 1
            last[done] = piece
        return last

    def _part(self, text: str) -> bytes:
        last, sizes, end, out = self.last_pieces(text), self.size, len(text), []
        while end:
            piece = last[end]
            if piece >= 0:
                out.append(piece)
                end -= sizes[piece]
                continue
            end -= 1
            if self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[end].encode()))
            else:
                out.append(self.unknown)
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, normal: str) -> bytes:
        """The ids of a normalised text as 32-bit numbers. Parts that were met before are remembered, up to a bound; those of the
        bound before it are kept as well, so that frequent ones stay."""
        words, parts = self.words, self.cut.findall(normal)
        out = list(map(words.get, parts))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            part = parts[at]
            ids = words.get(part)  # it may have been met earlier in this text
            if ids is None:
                ids = self.older.get(part) or self._part(part)
                if len(part) <= 64:
                    if len(words) >= self.remembered:
                        self.older, self.words = words, (words := {})
                    words[part] = ids
            out[at] = ids
        return b"".join(out)


_loaded: dict[int, tuple] = {}


def library(model: bytes):
    """The library's processor for normalising and decoding, and the vocabulary, made once a worker process."""
    import sentencepiece

    key = hash(model)
    if key not in _loaded:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else None
        _loaded[key] = sp, Pieces(names, [sp.get_score(i) for i in range(n)], special, sp.unk_id(), byte_ids)
    return _loaded[key]


def model_bytes(path: str | None = None) -> bytes:
    """A vocabulary file's content; it is read by the driver, and sent along with tasks (half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        sp, vocabulary = library(shared.value)
        end = array("i", [sp.eos_id()]).tobytes()
        for b in batches:
            raw, sizes, decoded = [], [0], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                ids = (vocabulary.encode(sp.normalize(text)) if text else b"") + end
                raw.append(ids)
                sizes.append(sizes[-1] + len(ids) // 4)
                decoded.append(sp.decode(memoryview(ids).cast("i").tolist()))
            values = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(raw))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values), pa.array(decoded, pa.string())], names=[*b.schema.names[:-1], "ids", "decoded"])

    return run


def with_pieces(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: bytes | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids`` (pieces, then the end id) and ``decoded``, the text these ids give.

    No shuffle; rows are worked on alone. Null and empty texts have the end id only and decode to the empty text; repeated
    rows are coded alike; an empty table gives no rows. Names that are taken get underscores.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[docs[c] for c in keep])
    names = [free_name(kept, x) for x in ("ids", "decoded")]
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields)] + ["ids array<int>", "decoded string"])
    shared = spark.sparkContext.broadcast(model_bytes() if model is None else model)
    coded = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].alias("t")).mapInArrow(_coded(shared), schema)
    return coded.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(x).alias(y) for x, y in zip(("ids", "decoded"), names)])


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return with_pieces(docs, keep=["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
