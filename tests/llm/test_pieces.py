import hashlib
import random

import pytest
import sentencepiece

from pairloom.llm import pieces

MODEL = pieces.model_bytes()


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def texts(seed, n):
    rnd = random.Random(seed)
    alphabet = "ab  ▁▁.,\n\t éç漢字Ω😀\x00<s>/[]0129-=–_TheIing'\"#*ß"
    for k in range(n):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80)))
        yield t if k % 3 else " " * rnd.randrange(70) + t.replace("a", "     ") + "=" * rnd.randrange(40)


def test_encodes_as_the_library_does(sp):
    _, mine = pieces.library(MODEL)
    mine.remembered = 500  # forgetting changes nothing
    for t in texts(1, 4000):
        assert memoryview(mine.encode(sp.normalize(t)) if t else b"").cast("i").tolist() == sp.encode(t)


def test_encodes_real_and_very_long_texts_as_the_library_does(spark, sp):
    _, mine = pieces.library(MODEL)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in [*filter(None, real), "x" * 100_000, "ab" * 70_000, " " * 50_000 + "é" * 20_000, "\n" * 3000, "thethethe" * 9000]:
        assert memoryview(mine.encode(sp.normalize(t))).cast("i").tolist() == sp.encode(t)


@pytest.mark.parametrize("seed", range(30))
def test_table_agrees_with_plain_merging_on_any_vocabulary(seed):
    """Small vocabularies with equal scores, pieces that no merge reaches, blanks inside pieces, and no bytes."""
    rnd = random.Random(seed)
    letters = "abc▁"
    names = {"<unk>", *letters} | {"".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 6))) for _ in range(25)}
    names = ["<unk>", *sorted(names - {"<unk>"})]
    scores = [float(rnd.randrange(-8, 0)) for _ in names]
    v = pieces.Pieces(names, scores, {0}, 0, None)
    for _ in range(200):
        text = "".join(rnd.choice(letters + "z") for _ in range(rnd.randrange(1, 20)))
        want = [v.id.get(p, 0) for p in v._history(text)[-1]]
        assert memoryview(v.encode(text)).cast("i").tolist() == want


def test_the_query_agrees_with_the_library(spark, sp):
    rows = [(i, t) for i, t in enumerate(texts(2, 300))] + [(900, None), (901, ""), (901, ""), (None, "x y")]
    got = pieces.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_odd_rows(spark, odd_docs, no_docs):
    out = pieces.with_pieces(odd_docs.withColumn("IDS", pieces.F.lit(1)))
    assert out.columns[-2:] == ["ids_", "decoded"]
    got = out.collect()
    assert len(got) == odd_docs.count() and all(r.decoded == (r.text or "") for r in got) and all(r["ids_"][-1] == 2 for r in got)
    assert pieces.digests(no_docs).count() == 0


def test_a_word_is_one_part_before_any_point(sp):
    """A word met before one mark is remembered before any other; parts of the bound before are, too."""
    _, mine = pieces.library(MODEL)
    assert mine.cut.findall("▁word.▁word,▁word(▁\"word\"") == ["▁word", ".", "▁word", ",", "▁word", "(", '▁"', "word", '"']
    mine.remembered, mine.words, mine.older = 3, {}, {}
    for t in ("one two three", "one four", "two. four, one!"):
        assert memoryview(mine.encode(sp.normalize(t))).cast("i").tolist() == sp.encode(t)
    assert {"▁one", "▁two", "▁four"} <= {*mine.words, *mine.older} and len(mine.words) <= 3


def test_marks_stay_with_letters_where_a_piece_has_both():
    v = pieces.Pieces(["<unk>", "a", ".", "▁", "a."], [0.0, -1.0, -1.0, -1.0, -2.0], {0}, 0, None)
    assert memoryview(v.encode("▁a.a")).cast("i").tolist() == [3, 4, 1]
