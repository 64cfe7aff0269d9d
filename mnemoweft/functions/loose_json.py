"""JSON as models write it: fenced, with remarks around it, or of another shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = "array<struct<label string, keywords array<string>>>"


def without_thoughts(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def json_text(c: Column) -> Column:
    """The JSON of a reply: the fenced block, else all of it if it parses, else from the first bracket to the last that fits; null if none parses."""
    bare = without_thoughts(c)
    fenced = F.trim(F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1))
    body = F.when(fenced != "", fenced).otherwise(bare)
    whole = F.when(F.try_parse_json(body).isNotNull() & body.rlike(r"^\s*[\[{]"), body)
    found = [F.regexp_extract(body, p, 0) for p in (r"(?s)\[\s*\{.*\}\s*\]", r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(whole, *[F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in found])


def braces(c: Column) -> Column:
    """From the first { to the last }."""
    x = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when((x != "") & F.try_parse_json(x).isNotNull(), x)


def labels_of(json: Column) -> Column:
    """Topic labels of a JSON list of strings or of objects; others are dropped; none is one "Unknown Topic"."""
    listed = F.from_json(F.when(json.rlike(r"^\s*\{"), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json), "array<string>")
    none = F.array().cast("array<string>")

    def label(x):
        o = F.from_json(x, "struct<label string, keywords array<string>>")
        plain = F.struct(x.alias("label"), none.alias("keywords"))
        made = F.struct(o["label"].alias("label"), F.coalesce(o["keywords"], none).alias("keywords"))
        return F.when(x.rlike(r"^\s*\{"), made).when(~x.rlike(r"^\s*(\[|-?[0-9.]+$|true$|false$|null$)"), plain)

    good = F.filter(F.transform(listed, label), lambda x: x.isNotNull() & F.coalesce(x["label"] != "", F.lit(False)))
    unknown = F.array(F.struct(F.lit("Unknown Topic").alias("label"), none.alias("keywords")))
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(unknown)


def number_or(c: Column, default: float = 0.5) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))
