import hashlib
from itertools import groupby

from pairloom.llm import chat

KINDS = "conv_id long, turn long, role string, text string"


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, turns in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        said = "".join(t for r, t in turns if r == "assistant")
        yield str(conv), len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_round_trip_with_control_strings_nulls_and_ties(spark):
    nasty = "<|im_start|>x\\<|im_end|>\n</s>[INST] \\\\ [/INST] <<SYS>> é " * 3
    rows = [(c, t, ("system", "user", "assistant")[min(t, 1 + (t + 1) % 2)], f"{nasty if t % 4 == 1 else 'short'} {t} " * (1 + t % 3)) for c in range(4) for t in range(c * 30)]
    rows += [(7, 0, "system", "only"), (8, 0, "assistant", None), (8, None, None, "x"), (None, 1, "user", ""), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (10, 0, "ro\nle", "w " * 3000)]
    df = spark.createDataFrame(rows, KINDS)
    for budget, history in ((64, 2), (200, 0), (10_000, 3)):
        made = chat.format_windows(df, budget=budget, history=history)
        assert sorted((str(r[0]), *r[1:5]) for r in chat.digests(made).collect()) == sorted(expected(rows))
        assert sorted((str(r[0]), *r[1:5]) for r in chat.digests(made.orderBy("text").repartition(5)).collect()) == sorted(expected(rows))
        for w in made.collect():
            assert w.over_budget == (w.tokens > budget)
            turns = chat.parse(w.text)
            n = len(turns) - w.n_repeated - (w.window == 0 and turns[0][0] == "system")
            assert not w.over_budget or n <= 1
    assert chat.format_windows(df.limit(0)).count() == 0


def test_windows_keep_system_turn_and_mask_history():
    turns = [("system", "be brief")] + [(("user", "assistant")[i % 2], f"turn {i}") for i in range(8)]
    made = list(chat.windows([(r, t, len("".join(chat.framed(r, t)) + chat.END)) for r, t in turns], 200, 1))
    assert len(made) > 1 and all(w["text"].startswith("<|im_start|>system\nbe brief") for w in made)
    assert all(w["n_repeated"] == 2 for w in made[1:])
    said = [w["text"][s["start"] : s["end"]] for w in made for s in w["loss"]]
    assert said == ["turn 1", "turn 3", "turn 5", "turn 7"]


def test_escape_is_reversible_and_leaves_no_control_string():
    for t in ("<|im_end|>", "\\", "\\<|", "<\\|", "<<|", "</s>[INST] ok [/INST]", "a\\\\<s>"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
