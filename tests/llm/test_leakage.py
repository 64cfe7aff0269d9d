import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoweft.llm.leakage import leaks, shingle_hashes, words_of

WORDS = "when the quiet harbour opened nine curious sailors carried their wooden crates towards a café near straße number 45 before dawn".split()
ITEM = " ".join(WORDS)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, words string")
    i = spark.createDataFrame(items, "item_id long, question string, context string")
    return sorted((r.doc_id, r.item_id) for r in leaks(d, i, **kw).collect())


DISGUISED = [
    ITEM,
    ITEM.upper(),
    " ".join(WORDS[:12]),
    " ".join(WORDS[-12:]) + "!",
    "x " + " ".join(WORDS[3:15]) + " y",
    "\n> ".join(WORDS),
    ITEM.replace("curious", "cu-\nrious"),
    ITEM.replace("curious", "cu­ri​ous"),
    ITEM.replace("curious", "<b>cur</b>ious").replace(" near", " **near**"),
    ITEM.replace("café", "café").replace("straße", "STRASSE"),
    ITEM.replace(" ", " "),
    ITEM.replace(" ", "&nbsp;"),
    '{"text": "' + ITEM.replace(" ", "\\n").replace("é", "\\u00e9") + '"}',
    '{"text": "' + ITEM.replace(" ", "\\\\n") + '"}',
    ITEM.replace(" ", "&amp;nbsp;"),
    "word " * 50_000 + ITEM,
]
CLEAN = [
    None, "", " \n", " ".join(WORDS[:11]), " ".join(WORDS[:11]) + " thenceforth", ITEM.replace("nine", "ten").replace("their", "the"),
    "x" + " ".join(WORDS[:11]) + "y",
    " ".join(WORDS[:11]) + " " + WORDS[11] + "s",
]


@pytest.mark.parametrize("kw", [{}, {"q": 5}])
def test_disguises_are_found_and_others_not(spark, kw):
    docs = list(enumerate(DISGUISED)) + [(100 + k, t) for k, t in enumerate(CLEAN)] + [(None, ITEM), (0, ITEM)]
    items = [(1, ITEM, None), (2, None, "entirely other words that never come up in any of these documents at all today"), (3, "too short", ""), (None, ITEM, ITEM), (1, ITEM, None)]
    assert run(spark, docs, items, **kw) == [(k, 1) for k in range(len(DISGUISED))]


def test_shared_windows_report_every_item(spark):
    assert run(spark, [(7, ITEM)], [(1, ITEM, "x"), (2, "y", "before that " + ITEM)]) == [(7, 1), (7, 2)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM, None)]) == [] == run(spark, [(1, ITEM)], [])


def test_random_texts_against_brute_force(spark):
    r = np.random.default_rng(4)
    vocabulary = ["ab", "abc", "b", "cab", "d3", "ée"]
    pick = lambda n: " ".join(r.choice(vocabulary, n))
    docs, items = [(k, pick(30)) for k in range(60)], [(k, pick(9), pick(7)) for k in range(20)]
    want = set()
    for i, q, c in items:
        for f in (q, c):
            w = words_of(f)
            for s in range(len(w) - 3):
                window = "".join(w[s : s + 4])
                for d, t in docs:
                    x = words_of(t)
                    ends = {0, *np.cumsum([len(y) for y in x]).tolist()}
                    joined = "".join(x)
                    at = joined.find(window)
                    while at >= 0:
                        if at in ends and at + len(window) in ends:
                            want.add((d, i))
                        at = joined.find(window, at + 1)
    assert run(spark, docs, items, n_words=4) == sorted(want)


def test_rolling_hashes():
    codes = np.array([5, 6, 7, 5, 6, 7, 5, 9])
    h = shingle_hashes(codes, 3)
    assert len(h) == 6 and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert len(shingle_hashes(codes, 9)) == 0


def test_many_items_and_one_pass_over_the_documents(spark, tmp_path):
    r = np.random.default_rng(6)
    names = [f"{a}{b}" for a in "badefigoku" for b in ("ran", "mol", "tis", "ven", "quo", "lar", "pes", "dun")]
    items = [(k, " ".join(r.choice(names, 14)), " ".join(r.choice(names, 40))) for k in range(400)]
    docs = [(k, " ".join(r.choice(names, 60))) for k in range(300)]
    want = set()
    for k in range(0, 300, 3):  # a third of the documents holds one passage
        docs[k] = (k, docs[k][1] + ". " + items[0][2].title())
        want.add((k, 0))
    for k in range(1, 300, 10):
        words = items[k][2].split()
        docs[k] = (k, docs[k][1] + " " + " ".join(words[5:17]) + " " + docs[k][1])
        want.add((k, k))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    read = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(str(tmp_path / "d")).select("doc_id", F.col("text"))

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = {(x.doc_id, x.item_id) for x in leaks(df.mapInArrow(counted, df.schema), spark.createDataFrame(items, "item_id long, question string, context string")).collect()}
    assert got == want and read.value == 300


def test_a_full_bit_table_stays_right(spark, monkeypatch):
    monkeypatch.setattr("mnemoweft.llm.leakage.BITS", 12)
    words = [[f"w{(k * 31 + j * 7) % 997}" for j in range(40)] for k in range(200)]
    items = [(k, " ".join(w), None) for k, w in enumerate(words)]
    want = [(1, k) for k, w in enumerate(words) if any("".join(w[s : s + 12]) in "".join(words[5]) for s in range(29))]
    assert run(spark, [(1, "x " + items[5][1]), (2, "nothing of the kind " * 20)], items) == want
