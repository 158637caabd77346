"""Quality rules with adaptive thresholds.

Each document's measures go into mergeable quantile sketches, one for each language and source: histograms over
integer buckets with five significant bits, so a sketch is a bounded map of counts and two sketches merge by adding.
Sketches of a language, and of everything, are sums of the finer ones and stand in for groups with few documents.
A document is kept if every measure lies within the fences that its group's quartiles set.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import let, materialise, words

#: Measure -> (is a low value suspect too, least spread in its integer unit). Units: thousandths of a word, hundredths of a letter.
MEASURES = {
    "symbol_rate": (False, 40),
    "dup_line_rate": (False, 15),
    "repeat_rate": (False, 100),
    "mean_word": (True, 60),
}
#: Spreads beyond a quartile at which a measure is out of range.
FENCE = 3
#: Documents that a group's own sketch needs; smaller groups use their language's, then the whole corpus's.
MIN_GROUP = 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text, in time n log n.

    Hashes that share their sort position's bits find the windows that may repeat; their words decide.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))

    def marked(h: Column) -> Column:
        def high(x: Column) -> Column:
            return F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)

        def near(p: Column, same: Callable[[Column, Column], Column]) -> Column:
            return F.filter(p, lambda x, j: F.coalesce(same(x, F.get(p, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, j + 1)), F.lit(False)))

        def window(x: Column) -> Column:
            i = (x - high(x)).cast("int")
            return F.struct(*[F.get(w, i + k).alias(f"w{k}") for k in range(3)], i.cast("long").alias("at"))

        def repeated(p: Column) -> Column:
            return near(p, lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]))

        def covered(q: Column) -> Column:
            return F.aggregate(F.transform(q, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(q, j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)

        packed = F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("long"))))
        maybe = let(packed, lambda p: near(p, lambda x, y: high(x) == high(y)))
        at = let(F.sort_array(F.transform(maybe, window)), lambda p: F.sort_array(F.transform(repeated(p), lambda x: x["at"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(at, covered))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(windows, marked))


def base_features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = F.when(F.contains(t, F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0))
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def bucket(v: Column) -> Column:
    """The lower end of an integer's sketch bucket: exact below 32, then five significant bits."""
    drop = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, lo_<measure>, hi_<measure>) from sketches of the rows, which have lang, source and the measures."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b")) for m in MEASURES])
    fine = materialise(measured.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "measure", "b").agg(F.count("*").alias("n")), "sketches")
    levels = [["lang", "source"], ["lang"], []]
    quartiles = []
    for keys in levels:
        merged = fine.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure")
        ranked = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("b")))
        quartiles.append(
            ranked.groupBy(*keys, "measure").agg(
                F.max("total").alias("total"),
                F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("b"))).alias("q1"),
                F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("b"))).alias("q3"),
            )
        )
    own, of_lang, of_all = quartiles
    joined = (
        own.alias("o")
        .join(of_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
        .join(of_all.alias("a"), F.col("o.measure") == F.col("a.measure"))
    )
    pick = lambda q: F.when(F.col("o.total") >= min_group, F.col(f"o.{q}")).when(F.col("l.total") >= min_group, F.col(f"l.{q}")).otherwise(F.col(f"a.{q}"))
    table = joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.measure").alias("measure"), pick("q1").alias("q1"), pick("q3").alias("q3"))
    ends = []
    for m, (low, least) in MEASURES.items():
        spread = F.lit(FENCE) * F.greatest(F.col("q3") - F.col("q1"), F.lit(least).cast("long"))
        ends.append(F.max(F.when(F.col("measure") == m, F.col("q3") + spread)).alias(f"hi_{m}"))
        if low:
            ends.append(F.max(F.when(F.col("measure") == m, F.col("q1") - spread)).alias(f"lo_{m}"))
    return table.groupBy("lang", "source").agg(*ends)


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept, the measures.

    Null text counts as empty (all counts 0, base_failed). Null lang or source is a group of its own. Rows that
    repeat are judged alike; other columns are ignored. An empty table gives no rows.
    """
    base = docs.select("doc_id", "lang", "source", base_features(F.col("text")).alias("f"))
    base = materialise(base, "quality").select("doc_id", "lang", "source", "f.*")
    n = F.greatest(F.col("n_words"), F.lit(1).cast("long"))
    rate = lambda c, unit: F.floor(F.col(c) * unit / n).cast("long")
    base = base.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_rate": rate("n_symbols", 1000),
            "dup_line_rate": rate("n_dup_lines", 1000),
            "repeat_rate": rate("n_repeat_words", 1000),
            "mean_word": rate("word_chars", 100),
        }
    )
    limits = thresholds(base.filter(~F.col("base_failed")), min_group)
    joined = base.alias("b").join(limits.alias("t"), F.col("b.lang").eqNullSafe(F.col("t.lang")) & F.col("b.source").eqNullSafe(F.col("t.source")), "left")
    within = reduce(lambda a, b: a & b, [F.col(m) <= F.col(f"hi_{m}") for m in MEASURES] + [F.col(m) >= F.col(f"lo_{m}") for m, (low, _) in MEASURES.items() if low])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"), *MEASURES,
    )
