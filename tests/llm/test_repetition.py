import math
import random

import pytest

from mnemoweft.llm.repetition import WORD, fertility, repeated_words, repetition, repetitive

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def brute(text, n=5):
    w = WORD.findall(text.lower()) if text else []
    seen, hit = set(), set()
    for k in range(len(w) - n + 1):
        g = tuple(w[k : k + n])
        if g in seen:
            hit.update(range(k, k + n))
        seen.add(g)
    return len(w), len(hit)


def test_brute_force():
    r = random.Random(1)
    for _ in range(400):
        text = " ".join(r.choice(["a", "b", "Über", "d7", "E"]) for _ in range(r.randrange(60)))
        assert repeated_words(text, 5) == brute(text)
        assert repeated_words(text, 2) == brute(text, 2)


def test_table(spark):
    phrase = "one two three four five six "
    rows = [(1, phrase * 4), (2, None), (3, ""), (4, "--- !"), (None, "a b"), (6, "ONE, two; three\nfour-five. one two three four five"), (1, phrase * 4), (7, phrase * 100_000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_words int")
    got = sorted([tuple(r) for r in repetition(df).collect()], key=str)
    assert got == sorted([(i, *(b := brute(t)), b[1] / b[0] if b[0] else 0.0) for i, t in rows], key=str)
    assert repetition(df.limit(0)).count() == 0


def test_the_band_of_the_entropy_loses_nothing(spark):
    r = random.Random(2)
    words = ["the", "über", "straße", "x1", "internationalisation", "ไทย", "a", "house", "нет", "q"] + [f"w{k}" for k in range(60)]
    data = []
    for k in range(400):
        base = [r.choice(words) for _ in range(r.randrange(1, 60))]
        data.append((k, " ".join(base + base[: r.randrange(len(base) + 1)] * r.randrange(3))))
    data += [(900, None), (901, ""), (902, " . "), (903, "one two three four five " * 20_000), (None, "a b c d e " * 9)]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, types int")
    for share, least in ((0.3, 20), (0.05, 1), (0.9, 1)):
        want = sorted(str(i) for i, t in data if (b := brute(t))[0] >= least and b[1] >= share * b[0])
        got = repetitive(df, VOCABULARY, share=share, least=least).collect()
        assert sorted(str(x.doc_id) for x in got) == want
        assert all(x.type_entropy <= math.log2(x.n_words) + math.log2(x.tokens_per_word - share) + 1e-6 for x in got)
    assert repetitive(df.limit(0), VOCABULARY).count() == 0


def test_fertility(spark):
    rows = [(k, f"An ordinary sentence about item {k} in the garden of the house.", "en") for k in range(40)]
    rows += [(100, "\ud55c\u0e01\u0e02\U0001f9ff" * 40, "EN "), (101, None, "en"), (102, "", None), (103, "spam " * 500, "en"), (104, "\u043d\u0435\u0442 \u0434\u0430", "und")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    all_rows = fertility(df, [VOCABULARY, "/opt/tokenizers/piece_bpe_32k.model"]).collect()
    assert len(all_rows) == 90 and {r.vocabulary for r in all_rows} == {"byte_bpe_50k", "piece_bpe_32k"}
    for name in ("byte_bpe_50k", "piece_bpe_32k"):
        got = {r.doc_id: r for r in all_rows if r.vocabulary == name}
        assert got[102].band == "script none" and got[104].band == "script Cyrillic" and got[101].chars_per_token is None and not got[101].in_band
        assert got[5].in_band and not got[100].in_band and not got[103].in_band
        assert got[100].byte_share > 0.3 and got[5].byte_share == 0 and got[103].token_entropy < 1.2
        assert got[5].chars_per_token == pytest.approx(len(rows[5][1]) / got[5].n_tokens)
