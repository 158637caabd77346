"""Queries over reading order and reader state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import reader
from lectern.plans.registry import query
from lectern.sources.adapters import adapt, table

_NUMBERED = """n as (select *, row_number() over w as session_no, coalesce(sum(word_count) over (partition by book_id order by chapter_index, session_index rows between unbounded preceding and 1 preceding), 0) as words_before,
    sum(word_count) over (partition by book_id) as total_words from sessions where section_kind = 'story' window w as (partition by book_id order by chapter_index, session_index))"""


@query(f"with {_NUMBERED} select book_id, session_id, session_no, cast(words_before as bigint) words_before, case when total_words > 0 then cast(round(cast(100.0 * words_before / total_words as decimal(20,6)), 2) as double) else 0.0 end progress_pct from n", "sessions")
def win_01_02_session_number_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.numbered(adapt(spark, sf_dir, "sessions")).select("book_id", "session_id", "session_no", "words_before", "progress_pct")


@query(f"with {_NUMBERED} select book_id, session_id, cast(greatest(0, total_words - words_before) as bigint) words_left, cast(round(cast(greatest(0, total_words - words_before) / 200.0 as decimal(20,6)), 1) as double) minutes_left from n", "sessions")
def win_03_words_minutes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.greatest(F.lit(0).cast("long"), F.col("total_words") - F.col("words_before"))
    rows = reader.numbered(adapt(spark, sf_dir, "sessions"))
    return rows.select("book_id", "session_id", left.alias("words_left"), F.round((left / F.lit(200.0)).cast("decimal(20,6)"), 1).cast("double").alias("minutes_left"))


@query(
    f"""with {_NUMBERED}, a as (select *, lead(chapter_index) over w c1, lead(chapter_index, 2) over w c2, lead(is_cliffhanger) over w k1, lead(is_cliffhanger, 2) over w k2, lead(word_count) over w w1, lead(word_count, 2) over w w2,
    lead(has_prompt) over w p1, lead(has_prompt, 2) over w p2, lead(session_id) over w s1, lead(session_id, 2) over w s2, lead(session_id, 3) over w s3 from n window w as (partition by book_id order by session_no)),
    m as (select *, 1 + case when not is_cliffhanger and c1 = chapter_index then 1 + case when not k1 and c2 = chapter_index then 1 else 0 end else 0 end n_merged from a)
    select book_id, session_id, session_no, n_merged, word_count + case when n_merged >= 2 then w1 else 0 end + case when n_merged >= 3 then w2 else 0 end block_words,
    has_prompt or (n_merged >= 2 and p1) or (n_merged >= 3 and p2) has_prompt, case n_merged when 1 then is_cliffhanger when 2 then k1 else k2 end is_cliffhanger, case n_merged when 1 then s1 when 2 then s2 else s3 end next_session from m""",
    "sessions",
)
def win_04_agg_04_block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.blocks(adapt(spark, sf_dir, "sessions"), 3)


_DONE = "done as (select user_id, book_id, max_by(event_id, event_id) last_id, count(*) n from reads where event_type = 'purchase' group by user_id, book_id)"


@query(
    f"""with {_NUMBERED}, st as (select user_id, book_id, 1 + cast(max(event_id) % 50 as int) cur from reads group by user_id, book_id), dn as (select distinct user_id, book_id, 1 + cast(event_id % 60 as int) no from reads where event_type = 'purchase')
    select st.user_id, st.book_id, count(*) n_sessions, count(*) filter (where n.session_no < st.cur or dn.no is not null) n_completed from st join n on n.book_id = st.book_id left join dn on dn.user_id = st.user_id and dn.book_id = st.book_id and dn.no = n.session_no group by 1, 2""",
    "sessions", "reads",
)
def win_05_agg_02_completed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages completed by position or by record, counted for each reader and book."""
    done = F.collect_set(F.when(F.col("event_type") == "purchase", (1 + F.col("event_id") % 60).cast("int")))
    state = adapt(spark, sf_dir, "reads").groupBy("user_id", "book_id").agg((1 + (F.max("event_id") % 50)).cast("int").alias("cur"), done.alias("done"))
    return reader.completed(adapt(spark, sf_dir, "sessions"), state)


@query(
    f"""with {_NUMBERED}, a as (select *, lead(chapter_index) over w c1, lead(chapter_index, 2) over w c2, lead(is_cliffhanger) over w k1 from n window w as (partition by book_id order by session_no)),
    m as (select book_id, session_no, words_before, words_before + word_count upto, 1 + case when not is_cliffhanger and c1 = chapter_index then 1 + case when not k1 and c2 = chapter_index then 1 else 0 end else 0 end merges, count(*) over (partition by book_id) last_no from a),
    c as (select user_id, book_id, 1 + cast(event_id % 300 as int) start_no, case when event_type = 'signup' then 0 else words end words_read from reads where event_type in ('purchase', 'signup')),
    r as (select user_id, book_id, case when user_id % 3 > 0 then 1 + cast(max(event_id) % 500 as int) end cur, case when count(*) filter (where event_type in ('purchase', 'signup')) >= 15 then 3 when count(*) filter (where event_type in ('purchase', 'signup')) >= 5 then 2 else 1 end size from reads group by 1, 2),
    ends as (select r.user_id, r.book_id, m.session_no + least(merges, size) - 1 e from r join m on m.book_id = r.book_id and m.session_no = case when cur <= last_no then cur else 1 end
      union all select c.user_id, c.book_id, m.session_no + least(merges, size) - 1 from c join m on m.book_id = c.book_id and m.session_no = c.start_no join r on r.user_id = c.user_id and r.book_id = c.book_id where c.words_read <= 0
      union all select c.user_id, c.book_id, coalesce(min(x.session_no), any_value(m.last_no)) from (select *, row_number() over () id from c where words_read > 0) c join m on m.book_id = c.book_id and m.session_no = c.start_no left join m x on x.book_id = c.book_id and x.session_no >= c.start_no and x.upto >= m.words_before + c.words_read group by c.id, c.user_id, c.book_id)
    select user_id, book_id, cast(max(e) as int) reached_no from ends group by 1, 2""",
    "sessions", "reads",
)
def win_06_jn_09_reached_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader of every book: some have not started, some have no completion or none that says how far it went."""
    reads = adapt(spark, sf_dir, "reads")
    ended = F.col("event_type").isin("purchase", "signup")
    done = reads.filter(ended).select("user_id", "book_id", (1 + F.col("event_id") % 300).cast("int").alias("start_no"), F.when(F.col("event_type") == "signup", 0).otherwise(F.col("words")).alias("words_read"))
    state = reads.groupBy("user_id", "book_id").agg(F.when(F.col("user_id") % 3 > 0, (1 + F.max("event_id") % 500).cast("int")).alias("current_no"), reader.size_level(F.count_if(ended)).alias("size"))
    return reader.reached(adapt(spark, sf_dir, "sessions"), state, done)


@query(f"with {_NUMBERED} select book_id, chapter_index, min(session_no) - 1 start_pos, max(session_no) - 1 end_pos from n group by 1, 2", "sessions")
def win_07_chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.contiguous_ranges(reader.numbered(adapt(spark, sf_dir, "sessions")))


@query("select book_id, chapter_id, lag(chapter_id) over (partition by book_id order by chapter_index) prev_id, lead(chapter_id) over (partition by book_id order by chapter_index) next_id from chapters where section_kind = 'story'", "chapters")
def win_08_flt_06_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.neighbours(adapt(spark, sf_dir, "chapters")).select("book_id", "chapter_id", "prev_id", "next_id")


@query(
    """with r as (select *, case when chapter_id % 4 = 0 then '' else concat('Recap ', chapter_id) end recap from chapters), l as (select *, list(nullif(recap, '')) over (partition by book_id order by chapter_index rows between unbounded preceding and 1 preceding) a from r)
    select book_id, chapter_id, coalesce(array_to_string(list_slice(list_filter(a, lambda x: x is not null), -3, -1), chr(10) || chr(10)), '') recaps from l""",
    "chapters",
)
def win_12_recap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = adapt(spark, sf_dir, "chapters").withColumn("recap", F.when(F.col("chapter_id") % 4 == 0, "").otherwise(F.concat(F.lit("Recap "), F.col("chapter_id"))))
    return reader.recap(chapters).select("book_id", "chapter_id", "recaps")


@query(
    """with r as (select user_id, book_id, event_id, ts, lag(ts) over (partition by user_id, book_id order by ts, event_id) prev from reads)
    select user_id, book_id, event_id, case when prev is null then 'none' when epoch(ts) - epoch(prev) >= 168 * 3600 then 'story_so_far' when epoch(ts) - epoch(prev) >= 24 * 3600 then 'last_chapters' else 'none' end recap_kind from r""",
    "reads",
)
def win_12b_13_dt_03_recap_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a returning reader gets, from the hours since the last read."""
    w = Window.partitionBy("user_id", "book_id").orderBy("ts", "event_id")
    utc = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = (utc(F.col("ts")) - utc(F.lag("ts").over(w))) / F.lit(3.6e9)
    kind = F.when(hours >= 168, "story_so_far").when(hours >= 24, "last_chapters").otherwise("none")
    return adapt(spark, sf_dir, "reads").select("user_id", "book_id", "event_id", kind.alias("recap_kind"))


@query(
    """with n as (select book_id, session_id, row_number() over (partition by book_id order by chapter_index, session_index) no, word_count, chapter_index, session_index from sessions where section_kind = 'story'), cur as (select book_id, chapter_index c, session_index s from n where no = 40)
    select n.book_id, cast(sum(word_count) as bigint) words_before from n join cur on cur.book_id = n.book_id where n.chapter_index < cur.c or (n.chapter_index = cur.c and n.session_index < cur.s) group by 1""",
    "sessions",
)
def jn_10_agg_03_lexicographic_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader.numbered(adapt(spark, sf_dir, "sessions"))
    cur = rows.filter("session_no = 40").select("book_id", F.struct("chapter_index", "session_index").alias("cur"))
    return rows.join(cur, "book_id").filter(F.struct("chapter_index", "session_index") < F.col("cur")).groupBy("book_id").agg(F.sum("word_count").alias("words_before"))


@query("select user_id, count(*) filter (where event_type = 'purchase') completed, case when count(*) filter (where event_type = 'purchase') >= 15 then 3 when count(*) filter (where event_type = 'purchase') >= 5 then 2 else 1 end size_level from reads group by 1", "reads")
def agg_01_mth_03_size_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adapt(spark, sf_dir, "reads").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("completed"))
    return done.withColumn("size_level", reader.size_level(F.col("completed")))


@query("select user_id, max_by(book_id, (ts, event_id)) book_id, max(ts) last_read_at from reads group by user_id", "reads")
def srt_05_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "reads").groupBy("user_id").agg(F.max_by("book_id", F.struct("ts", "event_id")).alias("book_id"), F.max("ts").alias("last_read_at"))


@query("select book_id, title, source_type from books where (owner_user_id is null or owner_user_id = 7) and source_type <> 'research' order by title", "books")
def flt_01_visible_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.col("owner_user_id").isNull() | (F.col("owner_user_id") == 7)
    return adapt(spark, sf_dir, "books").filter(mine & (F.col("source_type") != "research")).select("book_id", "title", "source_type").orderBy("title")


@query("select book_id, title from books where source_type = 'research' and (owner_user_id = 19 or owner_user_id is null)", "books")
def flt_02_research_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "books").filter("source_type = 'research' and (owner_user_id = 19 or owner_user_id is null)").select("book_id", "title").orderBy(F.desc("book_id"))


@query("select book_id, title from books where (owner_user_id is null and source_type <> 'research') or owner_user_id = 3", "books")
def flt_03_annotation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "books").filter("(owner_user_id is null and source_type <> 'research') or owner_user_id = 3").select("book_id", "title")


@query("select book_id, title, gutenberg_id from books where owner_user_id is null and gutenberg_id is not null and source_type = 'seeded'", "books")
def flt_09_10_shared_ready_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "books").filter(F.col("owner_user_id").isNull() & F.col("gutenberg_id").isNotNull() & (F.col("source_type") == "seeded")).select("book_id", "title", "gutenberg_id")


@query("select o_custkey owner_id, count(*) n_active, count(*) >= 5 over_quota from orders where o_orderstatus <> 'F' group by 1")
def flt_11_quota_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return live.groupBy(F.col("o_custkey").alias("owner_id")).agg(F.count("*").alias("n_active")).withColumn("over_quota", F.col("n_active") >= 5)


@query("with c as (select book_id, count(*) n_chapters from chapters group by 1), s as (select book_id, count(*) n_sessions, cast(sum(word_count) as bigint) n_words from sessions group by 1) select b.book_id, b.title, c.n_chapters, coalesce(s.n_sessions, 0) n_sessions, coalesce(s.n_words, 0) n_words from books b join c using (book_id) left join s using (book_id)", "books", "chapters", "sessions")
def prj_01_book_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = adapt(spark, sf_dir, "chapters").groupBy("book_id").agg(F.count("*").alias("n_chapters"))
    sessions = adapt(spark, sf_dir, "sessions").groupBy("book_id").agg(F.count("*").alias("n_sessions"), F.sum("word_count").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return adapt(spark, sf_dir, "books").join(chapters, "book_id").join(sessions, "book_id", "left").select("book_id", "title", "n_chapters", zero("n_sessions"), zero("n_words"))


@query("select session_id, array_to_string(list_slice(list_filter(string_split(text, ' '), lambda x: x <> ''), 1, 4), ' ') first_words, substring(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' '), 1, 160) preview from sessions", "sessions")
def prj_02_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_remove(F.split("text", "(?U)\\s+"), "")
    return adapt(spark, sf_dir, "sessions").select("session_id", F.array_join(F.slice(tokens, 1, 4), " ").alias("first_words"), F.substring(F.array_join(tokens, " "), 1, 160).alias("preview"))


@query(
    """with due as (select c.book_id, c.chapter_id, c.chapter_index from chapters c where c.chapter_index > 0 and (c.chapter_index + 1) % 3 = 0), att as (select distinct book_id, cast(event_id % 40 as int) chapter_index from reads where event_type = 'signup')
    select due.* from due where not exists (select 1 from att where att.book_id = due.book_id and att.chapter_index = due.chapter_index)""",
    "chapters", "reads",
)
def jn_13_mth_04_checkpoint_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = adapt(spark, sf_dir, "chapters").filter((F.col("chapter_index") > 0) & (F.pmod(F.col("chapter_index") + 1, F.lit(3)) == 0)).select("book_id", "chapter_id", "chapter_index")
    tried = adapt(spark, sf_dir, "reads").filter("event_type = 'signup'").select("book_id", (F.col("event_id") % 40).cast("int").alias("chapter_index"))
    return due.join(tried, ["book_id", "chapter_index"], "left_anti").select("book_id", "chapter_id", "chapter_index")
