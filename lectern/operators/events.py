"""Event analytics: pace, streaks, nudges, the break clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims


def sample_wpm(words: Column, active_ms: Column) -> Column:
    """Words a minute of one session, null if it is not plausible."""
    wpm = words / (active_ms / F.lit(60000.0))
    usable = (active_ms >= dims.PACE_MIN_MS) & (active_ms <= dims.PACE_MAX_MS) & (words >= dims.PACE_MIN_WORDS)
    return F.when(usable, F.when(wpm <= dims.PACE_MAX_WPM, wpm))


def pace(reads: DataFrame) -> DataFrame:
    """(user_id, n_samples, wpm_recent, wpm_rolling, trend, is_estimate): newest PACE_FETCH by id first, then the plausible ones of these.

    The trend compares the means as shown, to one digit; without samples it is steady and the pace an estimate.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    fetched = reads.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= dims.PACE_FETCH)
    valid = fetched.withColumn("wpm", sample_wpm(F.col("words"), F.col("active_ms"))).filter("wpm is not null")
    ranked = valid.withColumn("vn", F.row_number().over(newest)).filter(F.col("vn") <= dims.PACE_ROLLING)
    mean = lambda n: F.round(F.avg(F.when(F.col("vn") <= n, F.col("wpm").cast("decimal(18,6)"))).cast("decimal(18,6)"), 1)
    means = ranked.groupBy("user_id").agg(F.count("*").alias("n_samples"), mean(dims.PACE_RECENT).alias("recent"), mean(dims.PACE_ROLLING).alias("rolling"))
    band = F.lit(dims.PACE_BAND).cast("decimal(4,2)")
    trend = F.when(F.col("recent") > F.col("rolling") * (1 + band), "faster").when(F.col("recent") < F.col("rolling") * (1 - band), "slower").otherwise("steady")
    users = reads.select("user_id").distinct().join(means, "user_id", "left")
    return users.select("user_id", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.col("recent").cast("double").alias("wpm_recent"), F.col("rolling").cast("double").alias("wpm_rolling"), trend.alias("trend"), F.col("recent").isNull().alias("is_estimate"))


def streaks(days: DataFrame) -> DataFrame:
    """(user_id, current, longest, last_day) from distinct days read: runs of days share day minus rank."""
    w = Window.partitionBy("user_id").orderBy("day")
    island = days.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    runs = island.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))
    return runs.groupBy("user_id").agg(F.max_by("n", "last_day").alias("current_streak"), F.max("n").alias("longest_streak"), F.max("last_day").alias("last_day"))


def streak_states(days: DataFrame) -> DataFrame:
    """(user_id, current, longest, last_day) after each reader's days (user_id, day) in order, as a state that every
    completed session updates: the same day keeps it, the next day adds one, a gap starts anew.
    """
    items = F.array_sort(F.collect_list("day"))
    zero = F.struct(F.lit(0).alias("current"), F.lit(0).alias("longest"), F.lit(None).cast("date").alias("last_day"))

    def step(s: Column, day: Column) -> Column:
        gap = F.datediff(day, s["last_day"])
        current = F.when(gap == 0, s["current"]).when(gap == 1, s["current"] + 1).otherwise(1)
        return F.struct(current.alias("current"), F.greatest(s["longest"], current).alias("longest"), day.alias("last_day"))

    return days.groupBy("user_id").agg(F.aggregate(items, zero, step).alias("s")).select("user_id", "s.current", "s.longest", "s.last_day")


def active_ms(started: Column, ended: Column, hidden: Column) -> Column:
    """Milliseconds that a session was in view: from start to end without the array of hidden spans (from, to).

    A span that is still open (``to`` is null) ends with the session; the result is never negative.
    """
    away = F.aggregate(F.coalesce(hidden, F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")), F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["to"], ended) - s["from"])
    return F.greatest(F.lit(0).cast("long"), ended - started - away)


def live_streak(current: Column, last_day: Column, today: Column) -> Column:
    """The streak as shown on a day: only today's and yesterday's reading keep it."""
    return F.when(F.datediff(today, last_day).isin(0, 1), current).otherwise(0)


def nudge(last_day: Column, live: Column, today: Column) -> Column:
    days = F.datediff(today, last_day)
    return F.when(days <= 0, None).when(days >= dims.NUDGE_AWAY_DAYS, "away").when(live > 0, "streak_at_risk")


def break_offers(reads: DataFrame) -> DataFrame:
    """(user_id, n_offers, active_ms): the clock over each reader's sessions in time order.

    Active time adds up (one session adds two hours at most), starts anew after a pause of five minutes between one
    session's end and the next one's start, and a full clock offers a break, at most three a day, which empties it.
    The fold's state is a few numbers, so a reader's array is walked once.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    end_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    items = F.sort_array(F.collect_list(F.struct(end_ms.alias("end"), F.col("event_id").alias("id"), F.col("active_ms").cast("long").alias("ms"), day.alias("day"))))
    zero = F.struct(F.lit(0).cast("long").alias("active"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("today"), F.lit("").alias("day"), F.lit(0).alias("offers"))

    def step(s: Column, x: Column) -> Column:
        kept = F.when(s["last"].isNotNull() & (x["end"] - x["ms"] - s["last"] >= dims.BREAK_AWAY_MS), 0).otherwise(s["active"])
        active = kept + F.least(F.greatest(x["ms"], F.lit(0)), F.lit(dims.BREAK_MAX_ADD_MS))
        today = F.when(s["day"] == x["day"], s["today"]).otherwise(0)
        due = (active >= dims.BREAK_AFTER_MS) & (today < dims.BREAK_MAX_OFFERS)
        return F.struct(
            F.when(due, 0).otherwise(active).cast("long").alias("active"), x["end"].alias("last"), (today + due.cast("int")).alias("today"),
            F.when(due, x["day"]).otherwise(s["day"]).alias("day"), (s["offers"] + due.cast("int")).alias("offers"),
        )

    folded = reads.groupBy("user_id").agg(F.aggregate(items, zero, step).alias("s"))
    return folded.select("user_id", F.col("s.offers").alias("n_offers"), F.col("s.active").alias("active_ms"))
