"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import events
from lectern.plans.registry import query
from lectern.sources.adapters import adapt, table


@query("select event_id, case when active_ms between 5000 and 7200000 and words >= 50 and words / (active_ms / 60000.0) <= 2000 then cast(cast(words / (active_ms / 60000.0) as decimal(18,4)) as double) end wpm from reads", "reads")
def mth_01_sample_wpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "reads").select("event_id", events.sample_wpm(F.col("words"), F.col("active_ms")).cast("decimal(18,4)").cast("double").alias("wpm"))


@query(
    """with f as (select *, row_number() over (partition by user_id order by event_id desc) rn from reads), v as (select *, cast(words / (active_ms / 60000.0) as decimal(18,6)) wpm, row_number() over (partition by user_id order by event_id desc) vn from f
      where rn <= 40 and active_ms between 5000 and 7200000 and words >= 50 and words / (active_ms / 60000.0) <= 2000),
    m as (select user_id, count(*) n, round(cast(cast(sum(wpm) filter (where vn <= 3) as decimal(18,6)) / count(*) filter (where vn <= 3) as decimal(18,6)), 1) recent, round(cast(cast(sum(wpm) as decimal(18,6)) / count(*) as decimal(18,6)), 1) rolling from v where vn <= 20 group by 1)
    select u.user_id, coalesce(n, 0) n_samples, cast(recent as double) wpm_recent, cast(rolling as double) wpm_rolling, case when recent > rolling * 1.05 then 'faster' when recent < rolling * 0.95 then 'slower' else 'steady' end trend, recent is null is_estimate
    from (select distinct user_id from reads) u left join m using (user_id)""",
    "reads",
)
def agg_11_win_09_mth_02_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.pace(adapt(spark, sf_dir, "reads"))


@query(
    """with s as (select event_id, epoch_ms(ts) started, epoch_ms(ts) + active_ms ended, event_id % 4 shape, k from reads)
    select event_id, cast(greatest(0, ended - started - case shape when 0 then 0 when 1 then 1000 + k * 10 when 2 then 1000 + (ended - (started + 1500)) else 10 * (ended - started) end) as bigint) active from s""",
    "reads",
)
def dt_06_active_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions never hidden, hidden once, hidden twice and still so at the end, and hidden for longer than they last."""
    span = lambda a, b: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"))
    rows = adapt(spark, sf_dir, "reads").select("event_id", "k", F.unix_millis(F.col("ts").cast("timestamp")).alias("started"), F.col("active_ms").cast("long").alias("ms"), (F.col("event_id") % 4).alias("shape")).withColumn("ended", F.col("started") + F.col("ms"))
    start = F.col("started")
    once, open_ = F.array(span(start, start + 1000 + F.col("k") * 10)), F.array(span(start, start + 1000), span(start + 1500, F.lit(None)))
    hidden = F.when(F.col("shape") == 1, once).when(F.col("shape") == 2, open_).when(F.col("shape") == 3, F.array(span(start, start + 10 * F.col("ms"))))
    return rows.select("event_id", events.active_ms(start, F.col("ended"), hidden).alias("active"))


_STREAKS = """i as (select user_id, day, day - cast(row_number() over (partition by user_id order by day) as int) g from days), r as (select user_id, g, count(*) n, max(day) last_day from i group by 1, 2),
    s as (select user_id, max_by(n, last_day) current_streak, max(n) longest_streak, max(last_day) last_day from r group by 1)"""


@query(f"with {_STREAKS} select * from s", "days")
def win_10_dt_01_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.streaks(adapt(spark, sf_dir, "days"))


@query(
    f"""with {_STREAKS}, l as (select *, case when date '2024-01-31' - last_day in (0, 1) then current_streak else 0 end live from s) select user_id, live live_streak, date '2024-01-31' - last_day days_away,
    case when date '2024-01-31' - last_day <= 0 then null when date '2024-01-31' - last_day >= 3 then 'away' when live > 0 then 'streak_at_risk' end kind,
    case when date '2024-01-31' - last_day <= 0 then null when date '2024-01-31' - last_day >= 3 then 'It has been ' || (date '2024-01-31' - last_day) || ' days.' when live > 0 then 'Your ' || live || '-day streak is still alive.' end message from l""",
    "days",
)
def win_11_dt_02_str_37_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("2024-01-31").cast("date")
    rows = events.streaks(adapt(spark, sf_dir, "days")).withColumn("live_streak", events.live_streak(F.col("current_streak"), F.col("last_day"), today)).withColumn("days_away", F.datediff(today, "last_day"))
    kind = events.nudge(F.col("last_day"), F.col("live_streak"), today)
    message = F.when(F.col("kind") == "away", F.format_string("It has been %d days.", "days_away")).when(F.col("kind") == "streak_at_risk", F.format_string("Your %d-day streak is still alive.", "live_streak"))
    return rows.withColumn("kind", kind).select("user_id", "live_streak", "days_away", "kind", message.alias("message"))


@query(f"with {_STREAKS} select user_id, longest_streak in (3, 7, 14) celebrates from s", "days")
def mth_07_celebration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.streaks(adapt(spark, sf_dir, "days")).select("user_id", F.col("longest_streak").isin(3, 7, 14).alias("celebrates"))


@query(
    """with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) rn, epoch_ms(ts) fin, cast(active_ms as bigint) ms, strftime(ts, '%Y-%m-%d') d from (select event_id, user_id, ts, (cast(json_extract_string(props, '$.k') as int) + 1) * 3000 as active_ms from events)),
    f as (select user_id, cast(0 as bigint) rn, cast(0 as bigint) active, cast(null as bigint) last, 0 today, '' d, 0 offers from (select distinct user_id from e) union all
      select user_id, rn, case when due then 0 else a end, fin, t + cast(due as int), case when due then dd else d end, offers + cast(due as int) from (select *, a >= 600000 and t < 3 due from (
        select f.user_id, e.rn, e.fin, f.d, e.d dd, f.offers, case when f.last is not null and e.fin - e.ms - f.last >= 300000 then 0 else f.active end + least(greatest(e.ms, 0), 7200000) a, case when f.d = e.d then f.today else 0 end t from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)))
    select user_id, max_by(offers, rn) n_offers, max_by(active, rn) active_ms from f group by 1"""
)
def stm_04_break_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.break_offers(adapt(spark, sf_dir, "reads"))


@query("select e.event_id, e.event_type, b.book_id from reads e left join books b on b.book_id = e.book_id and b.source_type <> 'research' where not exists (select 1 from books r where r.book_id = e.book_id and r.source_type = 'research')", "reads", "books")
def flt_08_jn_06_stm_01_event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that aim at research books are dropped."""
    books = adapt(spark, sf_dir, "books")
    kept = adapt(spark, sf_dir, "reads").join(books.filter("source_type = 'research'").select("book_id"), "book_id", "left_anti")
    return kept.join(books.filter("source_type <> 'research'").select(F.col("book_id").alias("b")), F.col("book_id") == F.col("b"), "left").select("event_id", "event_type", F.col("b").alias("book_id"))


@query(
    """select e.event_id id, e.user_id, coalesce(c.c_name, '') user_email, coalesce(cast(b.book_id as varchar), '') book_id, coalesce(b.source_type, '') source_type, e.event_type, '{"k": ' || e.k || ', "words": ' || e.words || '}' metadata, strftime(e.ts, '%Y-%m-%dT%H:%M:%S') created_at
    from reads e left join customer c on c.c_custkey = e.user_id left join books b on b.book_id = e.book_id where b.source_type is null or b.source_type <> 'research'""",
    "reads", "books",
)
def snk_01_jn_04_jsn_09_events_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the events export: lookups default to blanks, research rows are left out."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    books = adapt(spark, sf_dir, "books").select("book_id", "source_type")
    rows = adapt(spark, sf_dir, "reads").join(users, "user_id", "left").join(books.withColumnRenamed("book_id", "b"), F.col("book_id") == F.col("b"), "left")
    blank = lambda c, name: F.coalesce(c.cast("string"), F.lit("")).alias(name)
    return rows.filter("source_type is null or source_type <> 'research'").select(
        F.col("event_id").alias("id"), "user_id", blank(F.col("c_name"), "user_email"), blank(F.col("b"), "book_id"), blank(F.col("source_type"), "source_type"), "event_type",
        F.format_string('{"k": %d, "words": %d}', "k", "words").alias("metadata"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


@query("select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, count(distinct user_id) users from reads group by 1, 2", "reads")
def stm_12_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt(spark, sf_dir, "reads").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "users")


@query("select time_bucket(interval '30 minutes', ts) - interval '30 minutes' * s.i window_start, count(*) n from reads, (select unnest([0, 1]) i) s group by 1", "reads")
def stm_12_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt(spark, sf_dir, "reads").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    """with g as (select *, case when prev is null or epoch_us(ts) - epoch_us(prev) >= cast(7200000000 as bigint) then 1 else 0 end fresh from (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) prev from reads)),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) sid from g) select user_id, min(ts) started, count(*) n from s group by user_id, sid""",
    "reads",
)
def stm_07_12_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt(spark, sf_dir, "reads").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id desc) rn, cast(k as bigint) k, try_cast(json_extract_string(props, '$.missing') as int) missing from (select *, cast(json_extract_string(props, '$.k') as int) k from events) qualify rn <= 40")
def srt_04_jsn_01_newest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 40")
    return rows.select("user_id", "event_id", "rn", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.expr("try_cast(get_json_object(props, '$.missing') as int)").alias("missing"))


@query("select event_id, case when k < 50 then k || 'm' else (k // 60) || 'h ' || (k % 60) || 'm' end shown, 60000.0 / greatest(words, 1) delay_ms, strftime(ts, '%Y-%m-%d') day_key from reads", "reads")
def str_38_mth_10_dt_05_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("k") < 50, F.format_string("%dm", "k")).otherwise(F.format_string("%dh %dm", F.floor(F.col("k") / 60), F.col("k") % 60))
    return adapt(spark, sf_dir, "reads").select("event_id", shown.alias("shown"), (F.lit(60000.0) / F.greatest("words", F.lit(1))).alias("delay_ms"), F.date_format("ts", "yyyy-MM-dd").alias("day_key"))


@query(f"with {_STREAKS} select user_id, cast(current_streak as int) as current, cast(longest_streak as int) longest, last_day from s", "days")
def stm_03_streak_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after every session of a reader, several a day: as the streaming state keeps it."""
    return events.streak_states(adapt(spark, sf_dir, "reads").select("user_id", F.col("ts").cast("date").alias("day")))
