"""Quizzes: whether answers are right, and what an attempt scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip


def answer_key(t: Column) -> Column:
    """An answer as compared: trimmed, in lower case; null is empty."""
    return F.lower(strip(F.coalesce(t, F.lit(""))))


def sequence_correct(given: Column, expected: Column) -> Column:
    """Whether two arrays hold the same answers in the same order; a missing one is wrong."""
    same = F.transform(given, answer_key) == F.transform(expected, answer_key)
    return F.coalesce((F.size(given) == F.size(expected)) & same, F.lit(False))


def relation_correct(given: Column, expected: Column) -> Column:
    """Whether two maps pair the same answers; of keys that agree once trimmed and lowered the last counts."""

    def pairs(m: Column) -> Column:
        entries = F.transform(F.map_entries(m), lambda e, i: F.struct(answer_key(e["key"]).alias("k"), answer_key(e["value"]).alias("v"), i.alias("i")))
        last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
        return F.array_sort(F.transform(last, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))

    return F.coalesce((F.size(given) == F.size(expected)) & (pairs(given) == pairs(expected)), F.lit(False))


def choice_correct(given: Column, expected: Column) -> Column:
    """Whether a plain answer agrees and is not empty."""
    return (answer_key(given) != "") & (answer_key(given) == answer_key(expected))


def score(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, correct, score) of answers with a boolean column correct: percent to two digits, ties to even; 0 without questions."""
    counts = answers.groupBy(*keys).agg(F.count("correct").alias("total"), F.count_if("correct").alias("correct"))
    return counts.withColumn("score", F.when(F.col("total") > 0, F.bround(100.0 * F.col("correct") / F.col("total"), 2)).otherwise(0.0))
