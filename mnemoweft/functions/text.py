"""Strings: tokens, triggers, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that announce a change of subject.
TRANSITIONS = [
    "By the way", "Speaking of", "On another note",
    "Also", "However", "Anyway", "Actually",
    "So", "Well", "Oh", "Let me change the subject",
]
# Substrings of questions that ask for reasons.
REASONS = ["why", "reason", "cause", "how come", "what caused", "what led to", "because", "explain", "how did"]
# Substrings of questions that ask for enumerations.
ENUMERATIONS = [
    "what has", "what have", "what did", "how many", "how much", "list", "all the", "all of",
    "every", "each time", "what are", "what were", "which", "name all",
]


def words(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def simple_tokens(c: Column) -> Column:
    """Lower-case tokens; full stops, commas, exclamation and question marks separate."""
    return F.filter(F.split(F.translate(F.lower(c), ".,!?", "    "), r"\s+"), lambda x: x != "")


def normalised_answer(c: Column) -> Column:
    """Without commas, case, ASCII punctuation and the words a, an, the, and."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, ",", "")), r"[!-/:-@\[-`{-~]", "")
    kept = F.filter(F.split(bare, r"\s+"), lambda x: (x != "") & ~x.isin("a", "an", "the", "and"))
    return F.array_join(kept, " ")


def answer_tokens(c: Column) -> Column:
    return F.filter(F.split(normalised_answer(c), " "), lambda x: x != "")


def containment(a: Column, b: Column) -> Column:
    """Shared words over the fewer words of either; 0 without words."""
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def keyword_ratio(keywords: Column, query: Column) -> Column:
    """Share of the keywords that occur anywhere in the query; 0 without keywords."""
    q = F.lower(query)
    hits = F.size(F.filter(keywords, lambda k: F.contains(q, F.lower(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(F.lit(0.0))


def has_transition(c: Column, phrases: list[str] = TRANSITIONS) -> Column:
    return F.coalesce(c.rlike(r"(?i)\b(" + "|".join(phrases) + r")\b"), F.lit(False))


def has_any(c: Column, parts: list[str]) -> Column:
    """Whether one of the parts occurs anywhere, also inside words."""
    low, hit = F.lower(c), F.lit(False)
    for p in parts:
        hit = hit | F.contains(low, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def dialogue_text(turns: Column, users: list[str] = ("user",)) -> Column:
    """Lines of an ordered array of struct(role, content)."""
    line = lambda t: F.concat(F.when(t["role"].isin(*users), "User: ").otherwise("Assistant: "), F.coalesce(t["content"], F.lit("")))
    return F.array_join(F.transform(turns, line), "\n")


def history_line(ts: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.coalesce(ts, F.lit("")), F.lit(" | "), F.coalesce(speaker, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")), F.lit("\n"))


def memory_line(ts: Column, memory: Column) -> Column:
    return F.when(F.coalesce(ts, F.lit("")) != "", F.concat(ts, F.lit(": "), memory)).otherwise(memory)


def namespace(c: Column) -> Column:
    """Other characters than letters, digits, _ and - become _; at most 48; no _ at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), 1, 48), "^_+|_+$", "")
