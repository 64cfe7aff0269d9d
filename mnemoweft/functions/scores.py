"""Scores of a predicted against a reference text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoweft.functions.text import answer_tokens, simple_tokens


def _shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def bag_f1_tokens(p: Column, g: Column) -> Column:
    n, shared = F.size(p) + F.size(g), _shared(p, g)
    return (
        F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0))
        .when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0))
        .otherwise(2.0 * shared / n)
    )


def bag_f1(prediction: Column, gold: Column) -> Column:
    """F1 of normalised answers as bags of tokens."""
    return bag_f1_tokens(answer_tokens(prediction), answer_tokens(gold))


def multi_hop_f1(prediction: Column, gold: Column) -> Column:
    """Both split at commas: mean over the gold parts of the best part of the prediction."""
    ps, gs = F.split(prediction, ","), F.split(gold, ",")
    best = lambda g: F.array_max(F.transform(ps, lambda p: bag_f1(p, g)))
    return F.aggregate(F.transform(gs, best), F.lit(0.0), lambda s, x: s + x) / F.size(gs)


def category_score(category: Column, prediction: Column, gold: Column) -> Column:
    refused = F.contains(F.lower(prediction), F.lit("no information available")) | F.contains(F.lower(prediction), F.lit("not mentioned"))
    return (
        F.when(category.isin(2, 4), bag_f1(prediction, gold))
        .when(category == 3, bag_f1(prediction, F.split(gold, ";")[0]))
        .when(category == 1, multi_hop_f1(prediction, gold))
        .when(category == 5, refused.cast("double"))
        .otherwise(F.lit(0.0))
    )


def exact_match(prediction: Column, gold: Column) -> Column:
    return F.coalesce((F.lower(F.trim(prediction)) == F.lower(F.trim(gold))).cast("int"), F.lit(0))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def set_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the token sets; 0 if one is empty."""
    p, g = F.array_distinct(simple_tokens(prediction)), F.array_distinct(simple_tokens(gold))
    shared = F.size(F.array_intersect(p, g))
    return F.when(_blank(prediction) | _blank(gold) | (shared == 0), F.lit(0.0)).otherwise(2.0 * shared / (F.size(p) + F.size(g)))


def _grams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last > 0, grams).otherwise(F.array().cast("array<string>"))


def bleu(prediction: Column, gold: Column, order: int) -> Column:
    """Sentence BLEU of that order with equal weights; an n-gram count of 0 becomes 0.1."""
    p, g = simple_tokens(prediction), simple_tokens(gold)
    weight = 0.33 if order == 3 else 1.0 / order
    total = F.lit(0.0)
    for n in range(1, order + 1):
        a, b = _grams(p, n), _grams(g, n)
        shared = _shared(a, b).cast("double")
        total = total + weight * F.ln(F.when(shared > 0, shared).otherwise(F.lit(0.1)) / F.greatest(F.size(a), F.lit(1)))
    brevity = F.when(F.size(p) > F.size(g), F.lit(1.0)).otherwise(F.exp(1 - F.size(g) / F.size(p)))
    none = _blank(prediction) | _blank(gold) | (F.size(p) == 0) | (_shared(p, g) == 0)
    return F.when(none, F.lit(0.0)).otherwise(brevity * F.exp(total))


def rouge_n(prediction: Column, gold: Column, n: int) -> Column:
    """F1 of the n-gram bags; 0 without any."""
    a, b = _grams(simple_tokens(prediction), n), _grams(simple_tokens(gold), n)
    shared, total = _shared(a, b), F.size(a) + F.size(b)
    return F.when(shared > 0, 2.0 * shared / total).otherwise(F.lit(0.0))


def rouge_l(prediction: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of tokens, by rows of the usual table."""
    p, g = simple_tokens(prediction), simple_tokens(gold)
    width = F.size(g)
    zero = F.transform(F.array_repeat(F.lit(0), width + 1), lambda x: x)

    def row(above, token):
        def cell(left, i):
            value = F.when(g[i - 1] == token, above[i - 1] + 1).otherwise(F.greatest(above[i], F.element_at(left, -1)))
            return F.concat(left, F.array(value))

        return F.when(width > 0, F.aggregate(F.sequence(F.lit(1), width), F.array(F.lit(0)), cell)).otherwise(above)

    length = F.element_at(F.aggregate(p, zero, row), -1)
    return F.when((F.size(p) > 0) & (width > 0), 2.0 * length / (F.size(p) + width)).otherwise(F.lit(0.0))
