"""Annotations: span checks and overlaps, listings in reading order, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims
from lectern.functions import text as T


#: Code points of a stretch of text in which spans meet.
STRETCH = 256


def overlaps(spans: DataFrame) -> DataFrame:
    """Pairs (a, b) of one reader's spans on one passage that overlap; spans that only touch do not.

    Each span goes to the stretches of STRETCH code points that it covers, and meets others there: reader, passage and
    stretch are the join's keys, so spans far apart in a much-marked text never meet. A pair that shares several
    stretches is kept in the one where the later span starts.
    """
    stretches = F.sequence(F.floor(F.col("start_at") / STRETCH), F.floor((F.greatest("end_at", F.col("start_at") + 1) - 1) / STRETCH))
    placed = spans.select("highlight_id", "user_id", "session_id", "start_at", "end_at", F.explode(stretches).alias("stretch"))
    a, b = placed.alias("a"), placed.alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.stretch") == F.col("b.stretch")) & (F.col("a.highlight_id") < F.col("b.highlight_id"))
    meet = (F.col("a.start_at") < F.col("b.end_at")) & (F.col("b.start_at") < F.col("a.end_at")) & (F.floor(F.greatest("a.start_at", "b.start_at") / STRETCH) == F.col("a.stretch"))
    return a.join(b, same & meet).select(F.col("a.highlight_id").alias("a"), F.col("b.highlight_id").alias("b"))


def accepted(spans: DataFrame) -> DataFrame:
    """(highlight_id, accepted): spans taken in the order of their ids, each unless it overlaps one taken before.

    The check that a lock guards where writers race, as a fold over each reader's spans on one passage; touching is fine.
    """
    items = F.array_sort(F.collect_list(F.struct("highlight_id", "start_at", "end_at")))
    none = F.expr("cast(array() as array<struct<id:bigint,s:int,e:int,ok:boolean>>)")

    def step(taken: Column, x: Column) -> Column:
        ok = ~F.exists(taken, lambda t: t["ok"] & (t["s"] < x["end_at"]) & (x["start_at"] < t["e"]))
        return F.concat(taken, F.array(F.struct(x["highlight_id"].cast("long").alias("id"), x["start_at"].cast("int").alias("s"), x["end_at"].cast("int").alias("e"), ok.alias("ok"))))

    folded = spans.groupBy("user_id", "session_id").agg(F.aggregate(items, none, step).alias("t"))
    return folded.select(F.explode("t").alias("t")).select(F.col("t.id").alias("highlight_id"), F.col("t.ok").alias("accepted"))


def created_shelves(wanted: DataFrame, cap: int = dims.SHELF_CAP, existing: DataFrame | None = None) -> DataFrame:
    """(user_id, n, status, position): shelves (user_id, n, name) asked for in the order of n.

    One is full with ``cap`` shelves, taken if the reader has one of that name in any case, else created at the position
    after the last. ``existing`` holds user_id, name_key and position. The fold's state is at most ``cap`` names.
    """
    asks = wanted.select("user_id", F.lit(1).alias("turn"), F.col("n").cast("long").alias("n"), F.lower("name").alias("key"), F.lit(None).cast("int").alias("position"))
    if existing is not None:
        asks = asks.unionByName(existing.select("user_id", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("n"), F.col("name_key").alias("key"), F.col("position").cast("int").alias("position")))
    items = F.array_sort(F.collect_list(F.struct("turn", "n", "key", "position")))
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("keys"), F.lit(-1).alias("last"), F.expr("cast(array() as array<struct<n:bigint,status:string,position:int>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        own, at = x["turn"] == 0, s["last"] + 1
        status = F.when(F.size(s["keys"]) >= cap, "full").when(F.array_contains(s["keys"], x["key"]), "taken").otherwise("created")
        made = own | (status == "created")
        last = F.when(own, F.greatest(s["last"], x["position"])).when(made, at).otherwise(s["last"])
        told = F.array(F.struct(x["n"].alias("n"), status.alias("status"), F.when(status == "created", at).alias("position")))
        return F.struct(F.when(made, F.concat(s["keys"], F.array(x["key"]))).otherwise(s["keys"]).alias("keys"), last.cast("int").alias("last"), F.when(own, s["out"]).otherwise(F.concat(s["out"], told)).alias("out"))

    folded = asks.groupBy("user_id").agg(F.aggregate(items, zero, step)["out"].alias("out"))
    return folded.select("user_id", F.inline("out"))


def quoted(spans: DataFrame) -> DataFrame:
    """Spans (start_at, end_at in code points of text) with quote, what stands around it, and an error code."""
    n = F.length("text")
    error = F.when((F.col("start_at") < 0) | (F.col("end_at") <= F.col("start_at")), "bad_range").when(F.col("end_at") > n, "out_of_range").when(F.col("end_at") - F.col("start_at") > dims.MAX_SPAN, "too_long")
    quote = F.substr(F.col("text"), F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))
    begin = F.greatest(F.col("start_at") - dims.CONTEXT_CHARS, F.lit(0))
    rows = spans.withColumn("error", error).withColumn("quote", F.when(F.col("error").isNull(), quote))
    rows = rows.withColumn("error", F.when(F.col("error").isNull() & (T.strip(F.col("quote")) == ""), "blank").otherwise(F.col("error")))
    fine = F.col("error").isNull()
    return rows.withColumns(
        {
            "context_before": F.when(fine, F.substr(F.col("text"), begin + 1, F.col("start_at") - begin)),
            "context_after": F.when(fine, F.substr(F.col("text"), F.col("end_at") + 1, F.lit(dims.CONTEXT_CHARS))),
            "quote": F.when(fine, F.col("quote")),
        }
    )


def markdown(notes: DataFrame) -> DataFrame:
    """(book_id, body): notes in reading order, a heading where the chapter changes, each quote as a block."""
    w = Window.partitionBy("book_id").orderBy("chapter_index", "session_index", "start_at", "highlight_id")
    changed = ~F.coalesce(F.lag("chapter_index").over(w) == F.col("chapter_index"), F.lit(False))
    block = F.concat(F.when(changed, F.concat(F.lit("## "), F.col("chapter_label"), F.lit("\n\n"))).otherwise(""), F.lit("> "), F.regexp_replace("quote", "\n", "\n> "))
    rows = notes.withColumns({"block": block, "n": F.row_number().over(w)})
    return rows.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("body"))


def reordered(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(shelf, item, position): listed items first in the order given, the rest in theirs, numbered from 0."""
    j = rows.join(listed, ["shelf", "item"], "left")
    w = Window.partitionBy("shelf").orderBy(F.col("wanted").asc_nulls_last(), "position", "item")
    return j.select("shelf", "item", (F.row_number().over(w) - 1).alias("position"))
