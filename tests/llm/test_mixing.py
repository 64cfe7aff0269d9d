from collections import defaultdict

import pytest

from mnemoweft.functions.tokens import load_encoding, pieces
from mnemoweft.llm.mixing import mix_sources, token_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def docs(spark):
    rows = [(k, f"word number {k} " * (k % 7 + 1), ["A ", "a", "b", "c", "other", None][k % 6], 1) for k in range(300)]
    rows += [(1000, None, "a", 1), (1001, "", "b", 1), (1002, "   ", "b", 1), (None, "an unnamed text", "a", 1), (5, "twice the id", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_budgets_and_copies(spark):
    t = [("a", 0.2, 1), (" B", 0.5, 6), ("c", 0.3, 1), ("void", 0.0, 3)]
    mixed = mix_sources(docs(spark), targets(spark, t), VOCABULARY)
    report = {r.source: r for r in mixed.report.collect()}
    chosen = mixed.selection.collect()
    own, taken, copies = defaultdict(int), defaultdict(int), defaultdict(set)
    encoding = load_encoding(VOCABULARY)
    longest = 0
    for r in docs(spark).collect():
        s = r.source.strip().lower() if r.source else None
        n = len(encoding.encode_ordinary(r.text)) if r.text else 0
        own[s] += n
        longest = max(longest, n)
    for r in chosen:
        taken[r.source] += r.copies * r.n_tokens
        copies[r.source].add(r.copies)
    size = own["a"] + own["b"] + own["c"]
    for s, share, most in (("a", 0.2, 1), ("b", 0.5, 6), ("c", 0.3, 1)):
        r = report[s]
        assert (r.own_tokens, r.taken_tokens) == (own[s], taken[s])
        assert r.target_tokens == pytest.approx(share * size)
        assert r.met == (most * own[s] >= share * size)
        budget = min(share * size, most * own[s])
        assert budget - longest - 1 < taken[s] <= budget
        assert len(copies[s]) <= 2 and max(copies[s]) - min(copies[s]) <= 1 and max(copies[s]) <= most
    assert report["void"].met and report["void"].own_tokens == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert sorted(map(str, mix_sources(docs(spark).repartition(7), targets(spark, t), VOCABULARY).selection.collect())) == sorted(map(str, chosen))


def test_dirty_targets_and_empty_tables(spark):
    t = [("a", 0.5, 1), ("a", 0.9, 2), (None, 0.5, 1), ("b", None, None), ("absent", 0.1, 5)]
    report = {r.source: r for r in mix_sources(docs(spark), targets(spark, t), VOCABULARY).report.collect()}
    assert set(report) == {"a", "b", "absent"} and report["a"].target_share == 0.9
    assert report["b"].taken_tokens == 0 and report["b"].met and not report["absent"].met
    none = mix_sources(docs(spark).limit(0), targets(spark, t), VOCABULARY)
    assert none.selection.count() == 0 and {r.met for r in none.report.collect() if r.target_share > 0} == {False}
    assert mix_sources(docs(spark), targets(spark, []), VOCABULARY).report.count() == 0


@pytest.mark.parametrize("text", ["lorem ipsum\n" * 5_000, "it's  a   test's!?  \n\n 12 34é " * 3_000, " " * 30_000 + "x", "ab" * 15_000 + " end", "", "x"])
def test_long_texts_are_cut_where_tokens_end(text):
    encoding = load_encoding(VOCABULARY)
    parts = list(pieces(text))
    assert "".join(parts) == text
    assert [x for p in parts for x in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_long_texts_are_counted_whole(spark):
    text = "lorem ipsum\n" * 20_000
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    n = {r.id: r.n_tokens for r in token_counts(df, "text", VOCABULARY).collect()}
    assert n == {1: len(load_encoding(VOCABULARY).encode_ordinary(text)), 2: 0}
