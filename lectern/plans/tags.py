"""Queries over tags, raters and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims
from lectern.operators import reader, tags
from lectern.plans.registry import query
from lectern.sources.adapters import adapt, table

_ORD = "(values " + ", ".join(f"('{t}', {i})" for i, t in enumerate(dims.THEMES)) + ") d(theme, ordinal)"


@query(f"select book_id, theme, ordinal, count(distinct session_id) n from tags join {_ORD} using (theme) where score >= 3 group by 1, 2, 3", "tags")
def agg_05_srt_02_flt_05_theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.shown(adapt(spark, sf_dir, "tags")).groupBy("book_id", "theme", "ordinal").agg(F.countDistinct("session_id").alias("n")).orderBy("book_id", F.desc("n"), "ordinal")


@query("select o_custkey, count(*) filter (where o_orderstatus = 'O') queued, count(*) filter (where o_orderstatus = 'P') running, count(*) filter (where o_orderstatus = 'F') done from orders group by 1")
def agg_06_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("O", "queued"), of("P", "running"), of("F", "done"))


@query("select book_id, theme, count(*) \"count\", to_json(list({'pos': n - 1, 'session_id': session_id, 'score': score} order by n)) cells from tags where score >= 3 group by 1, 2", "tags")
def agg_07_theme_map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.theme_map(adapt(spark, sf_dir, "tags"), reader.numbered(adapt(spark, sf_dir, "sessions"))).withColumn("cells", F.to_json("cells"))


@query(
    """with o as (select *, row_number() over w as session_no, lead(chapter_index) over w c1, lead(chapter_index, 2) over w c2, lead(is_cliffhanger) over w k1 from sessions where section_kind = 'story' window w as (partition by book_id order by chapter_index, session_index)),
    m as (select book_id, session_no, session_id, 1 + case when not is_cliffhanger and c1 = chapter_index then 1 + case when not k1 and c2 = chapter_index then 1 else 0 end else 0 end merges from o)
    select m.book_id, m.session_no, t.theme, max(t.score) score from m join m x on x.book_id = m.book_id and x.session_no >= m.session_no and x.session_no < m.session_no + m.merges join tags t on t.session_id = x.session_id where t.score >= 3 group by 1, 2, 3""",
    "sessions", "tags",
)
def agg_08_block_theme_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of the block of up to three passages that starts at each passage."""
    sessions = adapt(spark, sf_dir, "sessions")
    return tags.block_themes(adapt(spark, sf_dir, "tags"), reader.numbered(sessions), reader.block_ends(sessions), 3)


@query("select book_id, theme, chapter_index, max(score) score, count(*) \"count\", max_by(n - 1, (score, -n)) pos, max_by(session_id, (score, -n)) session_id from tags where score >= 3 group by 1, 2, 3", "tags")
def agg_09_strongest_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.strongest_by_chapter(adapt(spark, sf_dir, "tags"), reader.numbered(adapt(spark, sf_dir, "sessions")))


_TWO = f"two as (select session_id, book_id, theme, score from tags union all select session_id, book_id, ([{', '.join(repr(t) for t in dims.THEMES)}])[cast((n * 3 + 1) % 14 + 1 as int)], base from tags where (n * 3 + 1) % 14 <> (n * 7) % 14)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with a second theme for most passages."""
    rows = adapt(spark, sf_dir, "tags")
    other = F.element_at(F.array(*[F.lit(t) for t in dims.THEMES]), ((F.col("n") * 3 + 1) % 14 + 1).cast("int"))
    more = rows.filter("(n * 3 + 1) % 14 <> (n * 7) % 14").select("session_id", "book_id", other.alias("theme"), F.col("base").alias("score"))
    return rows.select("session_id", "book_id", "theme", "score").unionByName(more)


@query(f"with {_TWO} select session_id, array_to_string(list(theme order by score desc, ordinal), ';') themes from two join {_ORD} using (theme) where score >= 3 group by 1", "tags")
def agg_10_themes_of_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal", "theme")))
    return tags.shown(_two(spark, sf_dir)).groupBy("session_id").agg(F.array_join(F.transform(best, lambda x: x["theme"]), ";").alias("themes"))


@query(
    "with r as (select d.lang, l.quality = 1 a, l.toxic = 0 b from labels l join documents d using (doc_id)), c as (select lang, count(*) n, count(*) filter (where a = b) same, count(*) filter (where a) pa, count(*) filter (where b) pb from r group by 1) "
    "select lang, n, same, pa, pb, case when not ((pa = n and pb = n) or (pa = 0 and pb = 0)) then (same / n::double - (pa * pb + (n - pa) * (n - pb)) / (n * n)::double) / (1 - (pa * pb + (n - pa) * (n - pb)) / (n * n)::double) end kappa from c"
)
def agg_16_jn_12_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return tags.kappa(rows, ["lang"], F.col("quality") == 1, F.col("toxic") == 0)


@query(
    f"""with {_TWO}, ids as (select distinct session_id from tags), x as (select distinct session_id, theme from two where score >= 3), y as (select distinct session_id, theme from tags where base >= 3),
    g as (select i.theme, x.theme is not null a, y.theme is not null b from (select session_id, d.theme from ids, {_ORD}) i left join x on x.session_id = i.session_id and x.theme = i.theme left join y on y.session_id = i.session_id and y.theme = i.theme),
    c as (select theme, count(*) n, count(*) filter (where a = b) same, count(*) filter (where a) pa, count(*) filter (where b) pb from g group by 1)
    select theme, n, same, pa, pb, case when not ((pa = n and pb = n) or (pa = 0 and pb = 0)) then (same / n::double - (pa * pb + (n - pa) * (n - pb)) / (n * n)::double) / (1 - (pa * pb + (n - pa) * (n - pb)) / (n * n)::double) end kappa from c""",
    "tags",
)
def agg_17_pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of each theme of the closed list over all passages: ids times the fourteen themes."""
    rows = adapt(spark, sf_dir, "tags")
    ids = rows.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(t) for t in dims.THEMES])).alias("theme"))
    x = _two(spark, sf_dir).filter("score >= 3").select("session_id", "theme").distinct().withColumn("a", F.lit(True))
    y = rows.filter("base >= 3").select("session_id", "theme").distinct().withColumn("b", F.lit(True))
    both = ids.join(x, ["session_id", "theme"], "left").join(y, ["session_id", "theme"], "left").select("theme", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return tags.kappa(both, ["theme"], F.col("a"), F.col("b"))


@query(
    f"""with {_TWO}, a as (select session_id, list(distinct theme) s, max_by(theme, (score, -ordinal)) top from two join {_ORD} using (theme) where score >= 3 group by 1), b as (select session_id, list(distinct theme) s, max(theme) top from tags where base >= 3 group by 1),
    j as (select t.book_id, coalesce(a.s, []) x, coalesce(b.s, []) y, a.top ta, b.top tb from tags t left join a using (session_id) left join b using (session_id))
    select book_id, count(*) n, cast(avg(case when ta is not null and ta = tb then 1.0 else 0.0 end) as double) top_match, cast(cast(cast(sum(cast(case when len(x) + len(y) = 0 then 1.0::double else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double end as decimal(18,9))) as double) / count(*) as decimal(12,6)) as double) mean_overlap,
    cast(avg(case when ta is null then null when list_contains(y, ta) then 1.0 else 0.0 end) as double) top_in_other from j group by 1""",
    "tags",
)
def agg_18_19_set_05_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = adapt(spark, sf_dir, "tags")
    a = tags.shown(_two(spark, sf_dir)).groupBy("session_id").agg(F.collect_set("theme").alias("x"), F.max_by("theme", F.struct("score", -F.col("ordinal"))).alias("ta"))
    b = base.filter("base >= 3").groupBy("session_id").agg(F.collect_set("theme").alias("y"), F.max("theme").alias("tb"))
    none = F.expr("cast(array() as array<string>)")
    j = base.select("book_id", "session_id").join(a, "session_id", "left").join(b, "session_id", "left").withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    union, hit = F.size(F.array_union("x", "y")), F.coalesce(F.col("ta") == F.col("tb"), F.lit(False))
    overlap = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / F.greatest(union, F.lit(1)))
    inside = F.when(F.col("ta").isNotNull(), F.array_contains("y", F.col("ta")).cast("double"))
    return j.groupBy("book_id").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("top_match"), (F.sum(overlap.cast("decimal(18,9)")).cast("double") / F.count("*")).cast("decimal(12,6)").cast("double").alias("mean_overlap"), F.avg(inside).alias("top_in_other"))


@query(
    """with q as (select *, row_number() over (partition by book_id order by md5('7-' || session_id), session_id) rn from sessions), b as (select book_id, row_number() over (order by book_id) b, count(*) over () k from (select distinct book_id from sessions))
    select q.session_id, q.book_id from q join b using (book_id) where rn <= 130 // k + case when b.b <= 130 % k then 1 else 0 end""",
    "sessions",
)
def srt_08_snk_06_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.stratified(adapt(spark, sf_dir, "sessions").select("session_id", "book_id"), 130, 7)


@query("select session_id, theme, score, n from (select session_id, theme, score, n, row_number() over (partition by book_id, theme, chapter_index order by n desc) rn from tags) where rn = 1", "tags")
def set_04_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book_id", "theme", "chapter_index").orderBy(F.desc("n"))
    return adapt(spark, sf_dir, "tags").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("session_id", "theme", "score", "n")


@query("select session_id from tags where score >= 3 intersect select session_id from tags where base >= 2", "tags")
def set_01_jn_05_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt(spark, sf_dir, "tags")
    return rows.filter("score >= 3").select("session_id").intersect(rows.filter("base >= 2").select("session_id"))


@query("select session_id from sessions where section_kind = 'story' except select session_id from tags where score >= 3", "sessions", "tags")
def set_02_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    story = reader.story(adapt(spark, sf_dir, "sessions")).select("session_id")
    return story.join(adapt(spark, sf_dir, "tags").filter("score >= 3"), "session_id", "left_anti").distinct()


@query("select line from (select book_id, chapter_id, text as line, row_number() over (partition by chapter_id order by session_index) a, row_number() over (partition by chapter_id order by session_index desc) z from sessions) where a = 1 union select line from (select chapter_id, text as line, row_number() over (partition by chapter_id order by session_index desc) z from sessions) where z = 1", "sessions")
def set_03_first_last_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt(spark, sf_dir, "sessions").groupBy("chapter_id").agg(F.min_by("text", "session_index").alias("first"), F.max_by("text", "session_index").alias("last"))
    return rows.select(F.explode(F.array("first", "last")).alias("line")).distinct()


@query("select t.book_id, b.title book_title, t.chapter_index, t.session_id, t.theme, t.score from tags t join books b using (book_id) join chapters c using (chapter_id) where t.score >= 3 and b.owner_user_id is null", "tags", "books", "chapters")
def snk_02_jn_01_themes_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = adapt(spark, sf_dir, "books").filter("owner_user_id is null").select("book_id", F.col("title").alias("book_title"))
    chapters = adapt(spark, sf_dir, "chapters").select("chapter_id")
    rows = adapt(spark, sf_dir, "tags").filter("score >= 3").join(books, "book_id").join(chapters, "chapter_id")
    return rows.select("book_id", "book_title", "chapter_index", "session_id", "theme", "score")


@query(
    "select c.book_id, c.chapter_id, c.chapter_index section_index, (select count(*) from sessions s where s.chapter_id = c.chapter_id) chunks, coalesce((select array_to_string(list_sort(list(distinct theme)), ' ') from tags t where t.chapter_id = c.chapter_id), '') tags, (select count(*) from highlights h where h.session_id = c.chapter_id) highlights from chapters c",
    "chapters", "sessions", "tags", "highlights",
)
def snk_03_agg_21_sections_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = adapt(spark, sf_dir, "sessions").groupBy("chapter_id").agg(F.count("*").alias("chunks"))
    labels = adapt(spark, sf_dir, "tags").groupBy("chapter_id").agg(F.array_join(F.array_sort(F.collect_set("theme")), " ").alias("tags"))
    marks = adapt(spark, sf_dir, "highlights").groupBy(F.col("session_id").alias("chapter_id")).agg(F.count("*").alias("highlights"))
    rows = adapt(spark, sf_dir, "chapters").join(chunks, "chapter_id", "left").join(labels, "chapter_id", "left").join(marks, "chapter_id", "left")
    return rows.select("book_id", "chapter_id", F.col("chapter_index").alias("section_index"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("highlights", F.lit(0)).alias("highlights"))


@query("select chapter_index, session_index, session_id, substring(sha256(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ')), 1, 16) hash from sessions", "sessions")
def str_26_jn_07_chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "sessions").select("chapter_index", "session_index", "session_id", tags.chunk_hash(F.col("text")).alias("hash"))


_ENTRIES = """e as (select case when book_id % 6 = 5 then 9000 + book_id when book_id % 4 = 3 then 8000 + book_id else 1000 + book_id end gutenberg_id, case when session_id % 13 = 0 then chapter_index + 5000 else chapter_index end chapter, session_index as session,
    substring(sha256(array_to_string(list_filter(string_split(case when session_id % 7 = 0 then text || ' x' else text end, ' '), lambda x: x <> ''), ' ')), 1, 16) hash, cast(session_id % 8 as int) score, session_id, session_id % 17 = 0 unknown from sessions)"""


@query(
    f"""with {_ENTRIES}, b as (select e.*, k.book_id from e left join books k on k.gutenberg_id = e.gutenberg_id and k.owner_user_id is null),
    s as (select book_id, chapter_index, session_index, session_id own, substring(sha256(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ')), 1, 16) own_hash from sessions),
    j as (select b.gutenberg_id, case when b.book_id is null then 'missing_books' when s.own is null or b.hash <> s.own_hash then 'mismatched' when s.own % 5 = 0 then 'skipped_existing' when b.unknown or b.score not between 1 and 5 then 'invalid' else 'imported' end outcome
      from b left join s on s.book_id = b.book_id and s.chapter_index = b.chapter and s.session_index = b.session)
    select outcome, case when outcome = 'missing_books' then count(distinct gutenberg_id) else count(*) end n from j group by 1""",
    "books", "sessions",
)
def agg_22_src_11_import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag file of every passage: some books are not shared, some places and texts changed, some are tagged, some themes wrong."""
    sessions = adapt(spark, sf_dir, "sessions")
    book, i = F.col("book_id"), F.col("session_id")
    theme = F.struct(F.when(i % 17 == 0, "cooking").otherwise("romance").alias("theme"), (i % 8).cast("int").alias("score"))
    entries = sessions.select(
        F.when(book % 6 == 5, 9000 + book).when(book % 4 == 3, 8000 + book).otherwise(1000 + book).alias("gutenberg_id"), F.when(i % 13 == 0, F.col("chapter_index") + 5000).otherwise(F.col("chapter_index")).alias("chapter"),
        F.col("session_index").alias("session"), tags.chunk_hash(F.when(i % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))).alias("hash"), F.array(theme).alias("themes"),
    )
    books = adapt(spark, sf_dir, "books").filter("owner_user_id is null")
    return tags.import_outcomes(tags.judged_entries(entries, books, sessions, sessions.filter(i % 5 == 0)))


@query(
    """select event_id, case event_id % 9 when 0 then 'romance:' || (1 + event_id % 5) when 1 then 'romance:5;war_conflict:2' end parsed from events""",
)
def jsn_02_05_reply_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in nine forms; only the first two are valid."""
    e = table(spark, sf_dir, "events")
    s = (1 + F.col("event_id") % 5).cast("string")
    one = lambda score: F.concat(F.lit('{"themes":[{"theme":"romance","score":'), score, F.lit("}]}"))
    forms = [
        F.concat(F.lit("```json\n"), one(s), F.lit("\n```")), F.lit('{"themes":[{"theme":"war_conflict","score":2},{"theme":"romance","score":5}]}'), one(F.lit("true")), one(F.lit("3.0")), one(F.lit('"3"')),
        one(F.lit("6")), F.lit('{"themes":[{"theme":"cooking","score":3}]}'), F.lit('{"themes":[{"theme":"romance","score":3},{"theme":"romance","score":2}]}'), F.lit("no json"),
    ]
    reply = F.element_at(F.array(*forms), (F.col("event_id") % 9 + 1).cast("int"))
    parsed = F.array_join(F.transform(tags.parse_reply(F.col("reply")), lambda x: F.concat_ws(":", x["theme"], x["score"].cast("string"))), ";")
    return e.select("event_id", reply.alias("reply")).select("event_id", parsed.alias("parsed"))


@query(
    """with recursive n as (select book_id, chapter_index, row_number() over (partition by book_id order by chapter_index, session_index) - 1 pos, count(*) over (partition by book_id) total from sessions where section_kind = 'story'),
    c as (select book_id, chapter_index, min(pos) s, max(pos) e, any_value(total) total from n group by 1, 2), k as (select *, greatest(1, case when book_id % 3 = 0 or 40 * book_id = 0 then total else least(40 * book_id, total) end) cols from c),
    d as (select book_id, chapter_index, s, least(e, cols - 1) e, cols, row_number() over (partition by book_id order by s) rn from k where s < cols),
    w as (select book_id, rn, chapter_index, s as last, true as taken, e, cols from d where rn = 1 union all
      select d.book_id, d.rn, d.chapter_index, case when d.s - w.last >= 12 then d.s else w.last end, d.s - w.last >= 12, d.e, d.cols from w join d on d.book_id = w.book_id and d.rn = w.rn + 1)
    select book_id, chapter_index, cast(e as int) end_pos, cast(cols as int) columns, taken as labelled from w""",
    "sessions",
)
def win_14_mth_05_label_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter that a map draws: its end in the drawn columns, and whether it carries a label, at a gap of 12."""
    numbered = reader.numbered(adapt(spark, sf_dir, "sessions"))
    totals = numbered.groupBy("book_id").agg(F.count("*").alias("total"))
    ranges = reader.contiguous_ranges(numbered).join(totals, "book_id").select("book_id", "chapter_index", *[F.col(c).cast("int").alias(c) for c in ("start_pos", "end_pos")], tags.column_count(F.col("total"), 40 * F.col("book_id"), F.col("book_id") % 3 == 0).alias("columns"))
    drawn = tags.in_range(ranges, F.col("columns"))
    return drawn.join(tags.thinned(drawn, 12), "book_id").select("book_id", "chapter_index", "end_pos", "columns", F.array_contains("labelled", F.col("chapter_index")).alias("labelled"))
