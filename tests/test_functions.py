"""Closed forms and brute force for column functions."""

import math

import pytest
from pyspark.sql import functions as F

from mnemoweft.functions import info, loose_json, scores, sets, text, vector


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    null = F.lit(None).cast("array<double>")
    assert one(spark, vector.dot(vec(1, 2), vec(3, 4)), vector.norm(vec(3, 4)), vector.cosine(vec(1, 0), vec(2, 2)), vector.cosine(vec(0, 0), vec(1, 1)), vector.dot(null, vec(1))) == pytest.approx((11, 5, math.sqrt(0.5), 0, None))
    assert one(spark, vector.normalise(vec(3, 4)), vector.normalise(vec(0, 0))) == ([0.6, 0.8], [0, 0])


def test_information(spark):
    n = F.lit
    assert one(spark, info.npmi(n(5), n(5), n(5), n(10)), info.npmi(n(10), n(10), n(10), n(10)), info.npmi(n(25), n(50), n(50), n(100)), info.npmi(n(0), n(1), n(1), n(10)), info.npmi(n(1), n(0), n(1), n(10))) == pytest.approx((1, 0, 0, 0, 0))
    p, q = F.create_map(n("a"), n(1.0)), F.create_map(n("b"), n(2.0))
    ab, ba, aa = one(spark, info.jsd(p, q), info.jsd(q, p), info.jsd(p, p))
    assert ab == pytest.approx(ba) and ab == pytest.approx(math.log(2), abs=1e-6) and aa == pytest.approx(0)
    t = lambda s: n(s).cast("timestamp_ntz")
    assert one(spark, info.half_life(t("2024-01-01"), t("2024-01-31"), 30.0))[0] == pytest.approx(0.5)
    assert one(spark, info.log_likelihood_ratio(n(25), n(50), n(50), n(100)))[0] == pytest.approx(0)
    assert one(spark, info.poincare_distance(vec(0, 0), vec(0.5, 0)))[0] == pytest.approx(math.log(3))
    assert one(spark, info.clamp(n(-1.0)), info.clamp(n(2.0))) == (0, 1)


def test_sets_and_text(spark):
    n = F.lit
    a, b, none = F.array(n("x"), n("y")), F.array(n("y"), n("z")), F.lit(None).cast("array<string>")
    assert one(spark, sets.jaccard(a, b), sets.jaccard(none, none), text.containment(n("Big Red dog"), n("red")), text.containment(n(""), n("x"))) == pytest.approx((1 / 3, 0, 1, 0))
    assert one(spark, sets.evidence_recall(F.array(n("x"), n("x"), n("q")), a), sets.evidence_recall(none, a)) == pytest.approx((2 / 3, 1))
    assert one(spark, text.keyword_ratio(F.array(n("Art"), n("zoo")), n("a PARTY")), text.keyword_ratio(none, n("x"))) == (0.5, 0)
    assert one(spark, text.has_transition(n("He said SO, then")), text.has_transition(n("sofa")), text.has_transition(F.lit(None).cast("string"))) == (True, False, False)
    assert one(spark, text.has_any(n("listen"), text.ENUMERATIONS), text.has_any(n("no"), text.REASONS)) == (True, False)
    assert one(spark, text.normalised_answer(n("The cat, and a Dog!")), text.namespace(n("__a b/c__")), text.memory_line(n("t"), n("m")), text.memory_line(n(""), n("m"))) == ("cat dog", "a_b_c", "t: m", "m")
    assert one(spark, text.history_line(n("t"), n("s"), n("x")))[0] == "t | s: x\n"


def test_scores(spark):
    n = F.lit
    assert one(spark, scores.bag_f1(n("a cat cat"), n("cat dog")), scores.bag_f1(n(""), n("")), scores.bag_f1(n("x"), n("")), scores.set_f1(n("cat cat"), n("cat dog")), scores.set_f1(n(""), n(""))) == pytest.approx((0.5, 1, 0, 2 / 3, 0))
    assert one(spark, scores.multi_hop_f1(n("red, blue"), n("blue,green")))[0] == pytest.approx(0.5)
    assert one(spark, scores.exact_match(n(" A b"), n("a B ")), scores.exact_match(F.lit(None).cast("string"), n("x"))) == (1, 0)
    c = lambda k, p, g: scores.category_score(n(k), n(p), n(g))
    assert one(spark, c(5, "It is not mentioned.", ""), c(5, "x", ""), c(3, "sun", "sun; moon"), c(2, "sun", "sun"), c(9, "a", "a")) == pytest.approx((1, 0, 1, 1, 0))
    same = "the quick brown fox jumps"
    assert one(spark, *[scores.bleu(n(same), n(same), k) for k in (1, 2, 4)], scores.bleu(n("zzz"), n(same), 1), scores.bleu(n(""), n(same), 1)) == pytest.approx((1, 1, 1, 0, 0))
    assert one(spark, scores.bleu(n("the fox"), n("the quick fox"), 2))[0] == pytest.approx(math.exp(1 - 3 / 2) * math.sqrt(1 * 0.1))
    assert one(spark, scores.rouge_n(n("a b c"), n("a b d"), 2), scores.rouge_l(n("a x b c"), n("a b d c")), scores.rouge_l(n(""), n("a"))) == pytest.approx((0.5, 0.75, 0))


@pytest.mark.parametrize(
    ("reply", "labels"),
    [
        ('[{"label": "A", "keywords": ["k"]}]', [("A", ["k"])]),
        ('```json\n[{"label": "A"}, "B", 7, ["x"], {"label": ""}]\n```', [("A", []), ("B", [])]),
        ('<think>[1]</think> Sure: {"label": "A"} done', [("A", [])]),
        ('["one", "two"]', [("one", []), ("two", [])]),
        ("no json at all", [("Unknown Topic", [])]),
        (None, [("Unknown Topic", [])]),
        ("[]", [("Unknown Topic", [])]),
    ],
)
def test_labels_of_replies(spark, reply, labels):
    got = one(spark, loose_json.labels_of(loose_json.json_text(F.lit(reply).cast("string"))))[0]
    assert [(x.label, x.keywords) for x in got] == labels


def test_numbers_and_braces(spark):
    n = F.lit
    assert one(spark, loose_json.number_or(n("0.7")), loose_json.number_or(n("high")), loose_json.number_or(F.lit(None).cast("string"))) == (0.7, 0.5, 0.5)
    assert one(spark, loose_json.braces(n('x {"label": "WRONG"} y')), loose_json.braces(n("none")))[0] == '{"label": "WRONG"}'
