"""Chat formatting in budgeted windows.

A conversation longer than the budget is cut between turns: prefix sums of the turns' tokens choose the longest span of
new turns that fits beside the system turn, which every window keeps, and a limited repeated history. Loss covers each
assistant turn once, in the window where it is new; repeated turns are masked.

Tokens are counted before conversations are brought together, by all tasks alike. Conversations are sorted on disk by
Spark and streamed through: a task holds one window's turns, however long the conversation, and only adds up. Null texts and roles count as empty, a null id is a conversation of its own, equal turn numbers are
ordered by role and text, and an empty table gives no windows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

START, END = "<|im_start|>", "<|im_end|>\n"

#: Strings that some chat template reads as control. Fixed values.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: The published word pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_PLAIN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)

WINDOW = "conv_id {id}, window int, n_repeated int, tokens long, over_budget boolean, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """Doubles backslashes and puts one inside every control string, so that none is left."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def counter(vocabulary: bytes):
    """Counts the tokens of a text by a public byte-level vocabulary in tiktoken's format."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def framed(role: str, text: str) -> tuple[str, str]:
    """Head and body of a turn."""
    return f"{START}{quote(role, safe='')}\n", escape(text)


def windows(turns: Iterable[tuple[str, str, int]], budget: int, history: int) -> Iterator[dict]:
    """Windows of one conversation of (role, text, tokens) turns, holding no more than a window's turns at a time."""
    system: list[tuple] = []
    past: list[tuple] = []  # the last turns of earlier windows
    fresh: list[tuple] = []
    sums = [0]
    number = 0

    def window(new: list[tuple]) -> dict:
        nonlocal number
        room = budget - sum(t[3] for t in system) - sum(t[3] for t in new)
        repeated: list[tuple] = []
        for t in reversed(past[-history:] if history else []):
            if t[3] > room:
                break
            repeated.insert(0, t)
            room -= t[3]
        old = (system if number else []) + repeated
        text, at, loss = [], 0, []
        for k, (head, body, role, _) in enumerate((system if not number else []) + new if not old else old + new):
            if k >= len(old) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            text.append(head + body + END)
            at += len(text[-1])
        number += 1
        past.extend(new)
        del past[: max(0, len(past) - history)]
        return {"window": number - 1, "n_repeated": len(old), "tokens": budget - room, "over_budget": room < 0, "text": "".join(text), "loss": loss}

    reserve = lambda: sum(t[3] for t in system) + min(sum(t[3] for t in past[-history:]) if history else 0, budget // 4)
    first = True
    for role, text, tokens in turns:
        turn = (*framed(role, text), role, tokens)
        if first and role == "system":
            system.append(turn)
            first = False
            continue
        first = False
        fresh.append(turn)
        sums.append(sums[-1] + turn[3])
        while sums[-1] + reserve() > budget and len(fresh) > 1:
            cut = max(1, min(len(fresh) - 1, bisect_right(sums, budget - reserve()) - 1))
            yield window(fresh[:cut])
            fresh = fresh[cut:]
            sums = [s - sums[cut] for s in sums[cut:]]
    if fresh or system and not number:
        yield window(fresh)


def with_tokens(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, role, text`` with ``tokens``: what each turn takes in a window, its frame included; no shuffle.

    ``tokenizer`` is a file on the driver; its content goes to the tasks.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = turns.sparkSession.sparkContext.broadcast(f.read())
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields)

    def run(batches):
        count = counter(vocabulary.value)
        for b in batches:
            frames = (framed(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([count(h + x + END) for h, x in frames], pa.int64())], names=[*b.schema.names, "tokens"])

    return turns.mapInArrow(run, f"{types}, tokens long")


def format_windows(conversations: DataFrame, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", budget: int = 1024, history: int = 2) -> DataFrame:
    """Windows of all conversations (``conv_id, turn, role, text``); other columns are left out.

    A window has its number, how many of its turns are repeated, its tokens, whether a single turn exceeds the budget,
    the text, and the spans of the text (in code points) that loss covers.
    """
    bound_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = with_tokens(conversations.select("conv_id", "turn", blank("role"), blank("text")), tokenizer)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "tokens")
    loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        id_type = None

        def turns():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[dict] = []
        for conv, w in _grouped(turns(), lambda t: windows(t, budget, history)):
            out.append({"conv_id": conv, **w})
            if len(out) >= 500:
                yield _batch(out, id_type, loss)
                out = []
        if out:
            yield _batch(out, id_type, loss)

    return rows.mapInArrow(run, WINDOW.format(id=kind))


def _grouped(rows: Iterator[tuple], make) -> Iterator[tuple]:
    """(key, result) for the results that ``make`` gives for each run of rows with one key; streams."""
    from itertools import groupby

    for key, group in groupby(rows, key=lambda r: r[0]):
        for result in make((r[1:]) for r in group):
            yield key, result


def _batch(rows: list[dict], id_type, loss) -> pa.RecordBatch:
    kinds = {"conv_id": id_type, "window": pa.int32(), "n_repeated": pa.int32(), "tokens": pa.int64(), "over_budget": pa.bool_(), "text": pa.string(), "loss": loss}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window's text; ValueError if anything is left over."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        found.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("a turn has no end")
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the windows back: per conversation its turns, what loss covers, and the characters formatted.

    Windows may come in any order, as from a table read again: they are brought together by conversation and number. Null
    ids are one conversation, a repeated turn is a turn, an empty table gives no rows.
    """
    bound_batches(formatted.sparkSession)
    sorted_ = formatted.select("conv_id", "window", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        id_type = None

        def rows():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def digest(group):
            n = chars = formatted_chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for repeated, text, spans in group:
                formatted_chars += len(text)
                for role, said in parse(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    chars += len(said)
                    loss.update(said.encode())
            yield n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars

        out: list[tuple] = []
        for conv, d in _grouped(rows(), digest):
            out.append((conv, *d))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [id_type, *kinds])], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [id_type, *kinds])], names=names)

    return sorted_.select("conv_id", "n_repeated", "text", "loss").mapInArrow(run, schema)
