"""Embedders and text models as plug-ins, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoweft.functions.scores import exact_match

_TOKEN = re.compile(r"[a-z0-9]+")


class Embedder(Protocol):
    dim: int

    def encode(self, text: Column) -> Column:
        """Unit vectors (array of double) of a text column; the zero vector of a null or empty text."""
        ...


def _bucket(token: str, dim: int) -> tuple[int, int]:
    h = int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:4], 16)
    return h % dim, 1 - 2 * ((h // dim) % 2)


def hash_vectors(texts: list[str | None], dim: int, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """A row per text; known keeps the buckets of tokens between calls and is emptied when it gets large."""
    if len(known) > 200_000:
        known.clear()
    lists = [_TOKEN.findall((t or "").lower()) for t in texts]
    for token in {x for v in lists for x in v} - known.keys():
        known[token] = _bucket(token, dim)
    flat = np.array([known[x] for v in lists for x in v], np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    v = np.bincount(row * dim + flat[:, 0], weights=flat[:, 1], minlength=len(lists) * dim).reshape(len(lists), dim)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=v, where=n > 0)


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing of the ASCII words of a text, by the first 16 bits of their MD5."""

    dim: int = 64

    def encode(self, text: Column) -> Column:
        dim = self.dim
        known: dict[str, tuple[int, int]] = {}  # lives as long as the task

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(list(hash_vectors(texts.tolist(), dim, known)), dtype=object)

        return embed(text)


class TextModel(Protocol):
    """Replies of a language model as JSON or text columns."""

    def labels(self, text: Column) -> Column: ...
    def memories(self, text: Column, labels: Column) -> Column: ...
    def summary(self, label: Column, memories: Column) -> Column: ...
    def cluster_name(self, labels: Column) -> Column: ...
    def is_parent(self, parent: Column, child: Column) -> Column: ...
    def association(self, a: Column, b: Column) -> Column: ...
    def answer(self, question: Column, memories: Column) -> Column: ...
    def judge(self, question: Column, gold: Column, answer: Column) -> Column: ...


NO_ANSWER = "no information available"


class FallbackModel:
    """What the dataflows use where a model gives no reply."""

    # The replies.

    def labels(self, text: Column) -> Column:
        return F.lit('[{"label": "Unknown Topic", "keywords": []}]')

    def memories(self, text: Column, labels: Column) -> Column:
        return F.lit("[]")

    def summary(self, label: Column, memories: Column) -> Column:
        return label

    def cluster_name(self, labels: Column) -> Column:
        return F.array_join(F.slice(labels, 1, 2), " & ")

    def is_parent(self, parent: Column, child: Column) -> Column:
        return F.lit(False)

    def association(self, a: Column, b: Column) -> Column:
        return F.lit(None).cast("string")

    def answer(self, question: Column, memories: Column) -> Column:
        return F.lit(NO_ANSWER)

    def judge(self, question: Column, gold: Column, answer: Column) -> Column:
        """Without a model: CORRECT if gold and answer are the same but for case and blanks."""
        return F.when(exact_match(answer, gold) == 1, "CORRECT").otherwise("WRONG")


class EchoModel(FallbackModel):
    """Fixed labels, and one memory per segment of the text's first 100 characters: for tests."""

    def labels(self, text: Column) -> Column:
        return F.lit('[{"label": "test_topic", "keywords": ["test"]}]')

    def memories(self, text: Column, labels: Column) -> Column:
        one = F.struct(F.substring(text, 1, 100).alias("content"), labels.alias("topics"), F.array(F.lit("test")).alias("keywords"), F.lit(0.5).alias("importance"))
        return F.to_json(F.array(one))

    def answer(self, question: Column, memories: Column) -> Column:
        """The best memory."""
        return F.coalesce(F.get(memories, F.lit(0)), F.lit(NO_ANSWER))


class KeywordModel(EchoModel):
    """Labels of a text by the keywords it holds, one memory per segment: rules instead of a model.

    rules maps each label to its keywords (lower case); a label is given, in their order, to a text that
    holds one of them.
    """

    def __init__(self, rules: dict[str, list[str]]):
        self.rules = rules

    def labels(self, text: Column) -> Column:
        low = F.lower(text)
        found = F.array(*[
            F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("keywords")))
            for label, words in self.rules.items()
        ])
        return F.to_json(F.filter(found, lambda x: x.isNotNull()))


def model_column(reply: Callable[..., str | None], *inputs: Column, tries: int = 1) -> Column:
    """A callable on strings as a column, batched by Arrow; Catalyst must not move or repeat it.

    A call that raises is made again, at most `tries` times in all; then the reply is null.
    """

    def once(row) -> str | None:
        for _ in range(tries):
            try:
                return reply(*row)
            except Exception:  # noqa: BLE001, PERF203
                continue
        return None

    @F.pandas_udf("string")
    def ask(*series: pd.Series) -> pd.Series:
        return pd.Series([once(row) for row in zip(*series)])

    return ask.asNondeterministic()(*inputs)
