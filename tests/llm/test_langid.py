import math
import random

import zstandard

from pairloom.llm import langid


def test_learns_and_predicts_every_row(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    stems = {"aa": ["kalu", "meri", "tovan", "silu"], "bb": ["schra", "gelt", "unwer", "brich"], "cc": ["oixe", "quaé", "ñolta", "ziou"]}
    rows = [(1000 + i, " ".join(rnd.choice(s) + rnd.choice(s) for _ in range(rnd.randrange(20, 90))), k) for i, (k, s) in enumerate(list(stems.items()) * 120)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = odd_docs.withColumn("lang", odd_docs["lang"].substr(1, 0)).filter("false").unionByName(more, allowMissingColumns=True)
    out = langid.predictions(docs.unionByName(odd_docs.selectExpr("doc_id", "text"), allowMissingColumns=True)).collect()
    assert len(out) == 360 + odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 4, 8)} == {"und"}
    real = [r for r in out if (r.doc_id or 0) >= 1000]
    assert sum(r.lang_pred == list(stems)[(r.doc_id - 1000) % 3] for r in real) > 0.97 * len(real)
    assert langid.predictions(no_docs).count() == 0


def test_columns_with_clashing_names_stay(odd_docs):
    out = langid.identify(odd_docs, {"x": b"the cat sat " * 50, "y": b"qqq www eee " * 50})
    assert out.columns == [*odd_docs.columns, "lang_pred", "score_", "lang_rejected"] and out.count() == odd_docs.count()


def test_no_language_is_cut_to_the_size_of_another(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(3000)), k) for k in ("aa", "bb") for i in range(100 * ord(k[0]), 100 * ord(k[0]) + 40)]
    rows += [(9000 + i, "petit texte", "cc") for i in range(10)] + [(9100, None, "cc"), (9101, "12", "dd"), (9102, "x", None)]
    made = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=20, blocks=15)
    assert set(made) == {"aa", "bb", "cc"} and made["cc"] == b"petit texte"
    texts = {k: [t for _, t, lang in rows if lang == k] for k in ("aa", "bb")}
    for k in ("aa", "bb"):
        blocks = made[k].decode().split("\n")
        assert len(blocks) == 15 and sum(map(len, blocks)) > 12 * 4096
        assert all(any(b in t for t in texts[k]) for b in blocks)
        assert any(not any(t.startswith(b) for t in texts[k]) for b in blocks)  # not only beginnings


def test_choice_and_rejection_by_plain_loops(spark):
    made = {"x": b"the cat sat on the mat " * 50, "y": b"der hund lag vor der tuer " * 50, "z": b"el gato duerme en la casa " * 50}
    texts = [None, "", "123", "the cat sat", "der hund lag", "el gato en la casa", "qwrtz " * 20, "the cat sat der hund lag " * 300, "the mat " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.lang_rejected) for r in langid.identify(docs, made).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0, True)] * 3
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=19, hash_log=17, chain_log=17, search_log=3, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)
    for i, text in enumerate(texts[3:], 3):
        raw, size = text.encode(), {}
        for k, d in made.items():
            coder = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            size[k] = sum(len(coder.compress(raw[a : a + 4096])) for a in range(0, len(raw), 4096))
        best, second = sorted(size, key=lambda k: (size[k], k))[:2]
        share = 1 / sum(math.exp((size[best] - s) / max(1.0, 0.02 * size[best])) for s in size.values())
        assert got[i][0] == best and abs(got[i][1] - share) < 1e-9 and got[i][2] == ((size[second] - size[best]) / size[second] < 0.01)
    assert not got[8][2] and got[3][0] == "x"
