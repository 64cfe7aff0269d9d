"""Conversation corpora in JSON, where sessions are counted in the names of keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the default time of session n is this and n days.
BASE = "2023-05-01"
#: The time formats of session headers.
FORMATS = ["h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' MMMM d, yyyy", "H:mm 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy"]
QA = "array<struct<question string, answer string, evidence array<string>, category int, adversarial_answer string>>"
TURN = "array<struct<speaker string, dia_id string, text string, blip_caption string>>"


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank holds a whole JSON object."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("v")).first()
    if first is None or not first["v"].startswith("{"):
        return False
    try:
        json.loads(first["v"])
    except ValueError:
        return False
    return True


def read_samples(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """sample_id, conversation (map of JSON texts), qa of files with one JSON array each, or of one sample per line.

    Unless lines says so, the first line tells which.  Only files with a sample per line are split.
    """
    schema = "sample_id string, conversation string, qa string"
    by_lines = _by_lines(spark, path) if lines is None else lines
    read = spark.read.schema(schema).option("multiLine", not by_lines).json(path)
    return read.select("sample_id", F.from_json("conversation", "map<string,string>").alias("conversation"), F.from_json("qa", QA).alias("qa"))


def sample(samples: DataFrame, sample_id: str) -> DataFrame:
    """The one sample of that id; an empty frame without it, one row also where it is repeated."""
    return samples.filter(F.col("sample_id") == sample_id).limit(1)


def parse_time(text: Column, default: Column) -> Column:
    """A session's time in one of the known formats, else the default."""
    clean = F.regexp_replace(F.trim(text), r"(?i)\b([ap])\.?m\.?\b", "$1m")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in FORMATS], default)


def with_caption(text: Column, caption: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit(" [shares image: "), caption, F.lit("]"))).otherwise(F.lit("")))


def sessions(samples: DataFrame, max_sessions: int | None = None, stop_at_gap: bool = True) -> DataFrame:
    """sample_id, n, started, turns of the sessions of each sample; without turns a session is dropped.

    With stop_at_gap numbers are read from 1 until one is missing; else all, in numeric order.
    """
    rows = samples.select("sample_id", "conversation", F.explode("conversation").alias("k", "v")).filter(F.col("k").rlike(r"^session_\d+$"))
    n = F.regexp_extract("k", r"session_(\d+)$", 1).cast("int")
    header = F.try_element_at("conversation", F.concat("k", F.lit("_date_time")))
    header = F.regexp_replace(header, '^"|"$', "")
    listed = rows.select("sample_id", n.alias("n"), header.alias("header"), F.from_json("v", TURN).alias("turns"))
    if stop_at_gap:
        listed = until_gap(listed, ["sample_id"], "n")
    if max_sessions is not None:
        listed = listed.filter(F.col("n") <= max_sessions)
    default = F.timestamp_add("DAY", F.col("n"), F.lit(BASE).cast("timestamp"))
    return listed.filter(F.size("turns") > 0).select("sample_id", "n", parse_time(F.col("header"), default).alias("started"), "turns")


def until_gap(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows whose number belongs to the run 1, 2, 3, ... of their key."""
    w = W.partitionBy(*keys).orderBy(number)
    return rows.withColumn("__r", F.dense_rank().over(w)).filter(F.col("__r") == F.col(number)).drop("__r")


def flatten(found: DataFrame) -> DataFrame:
    """sample_id, session_id, turn_idx, dia_id, role, content, ts: the canonical turns."""
    t = found.select("sample_id", F.concat(F.lit("session_"), "n").alias("session_id"), "started", F.posexplode("turns").alias("turn_idx", "t"))
    return t.select("sample_id", "session_id", "turn_idx", "t.dia_id", F.col("t.speaker").alias("role"), with_caption(F.col("t.text"), F.col("t.blip_caption")).alias("content"), F.col("started").alias("ts"))


def gold_answer(category: Column, answer: Column, adversarial: Column) -> Column:
    return F.when(category == 5, F.coalesce(adversarial, F.lit("no information available"))).otherwise(F.coalesce(answer, F.lit("")))


def within_sessions(evidence: Column, most: int) -> Column:
    """Whether no evidence of the form D<session>:<turn> is of a later session; other forms do not count."""
    return F.coalesce(F.forall(evidence, lambda e: F.coalesce(F.regexp_extract(e, r"^D(\d+):", 1).try_cast("int") <= most, F.lit(True))), F.lit(True))


def questions(samples: DataFrame, categories: list[int] | None = None, max_sessions: int | None = None) -> DataFrame:
    q = samples.select("sample_id", F.explode("qa").alias("q")).select("sample_id", "q.question", gold_answer(F.col("q.category"), F.col("q.answer"), F.col("q.adversarial_answer")).alias("answer"), "q.evidence", "q.category")
    if categories is not None:
        q = q.filter(F.col("category").isin(categories))
    return q if max_sessions is None else q.filter(within_sessions(F.col("evidence"), max_sessions))


def seen_by(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """turns from the side of each of their speakers: the own ones are the user's; content names the speaker."""
    rows = turns.join(speakers, "sample_id")
    role = F.when(F.col("speaker") == F.col("perspective"), "user").otherwise("assistant")
    return rows.withColumn("role", role).withColumn("content", F.concat("speaker", F.lit(": "), F.coalesce("content", F.lit(""))))
