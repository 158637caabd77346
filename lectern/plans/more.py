"""Queries over the functions that work on whole texts: cleaning steps, titles, offsets, answers, research chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import layout, quiz, segment
from lectern.plans.registry import query
from lectern.sources import files
from lectern.sources.adapters import adapt, table


def _md5(parts: Column) -> Column:
    return F.md5(F.array_join(parts, "\n--\n"))


@query(
    r"""select doc_id, md5(regexp_replace(regexp_replace(text, '(^|\n)[ \t]*(produced by|prepared by|transcribed by)\b[^\n]*', '\1', 'gi'), '^\s+|\s+$', '', 'g')) body_md5 from documents"""
)
def str_02_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts put between licence marks, with a credit line of several kinds; what comes back is the text."""
    credit = F.element_at(F.array(*[F.lit(x) for x in ("Produced by Jane Doe", "  E-text prepared by someone", "Transcribed by hand")]), (F.col("doc_id") % 3 + 1).cast("int"))
    wrapped = F.concat(F.lit("The eBook\n*** START OF THE PROJECT GUTENBERG EBOOK A TITLE ***\n"), credit, F.lit("\n\n"), F.col("text"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK A TITLE ***\nlicence text"))
    t = F.when(F.col("doc_id") % 4 == 3, F.col("text")).otherwise(wrapped)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_boilerplate(t)).alias("body_md5"))


@query(
    r"""with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l from (select doc_id, regexp_replace(text, '([.!?])\n', '\1' || chr(10) || ' ' || chr(10), 'g') as text from documents))
    select doc_id, len(l) n, md5(array_to_string(l, chr(10) || '--' || chr(10))) parts_md5 from p"""
)
def str_11_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a blank line put after each line that ends a sentence."""
    ps = T.paragraphs(F.regexp_replace("text", r"([.!?])\n", "$1\n \n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ps).alias("n"), _md5(ps).alias("parts_md5"))


@query(
    r"""with l as (select doc_id, i, case when i % 3 = 0 then x else '    ' || x end as line, i % 3 = 0 flush, regexp_matches(x, '^(chapter|part)\s+[ivxlcdm0-9]+[.\s]*$', 'i') alone from (select doc_id, unnest(range(len(ls))) i, unnest(ls) x from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ls from documents))),
    m as (select *, count(*) over (partition by doc_id) n from l) select doc_id, case when max(n) = 1 then 1 else count(*) filter (where flush) end n_groups from m group by 1"""
)
def str_07_08_indented_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole texts, two of three indented: each flush line starts a paragraph."""
    ls = F.transform(T.lines(F.col("text")), lambda x, i: F.when(i % 3 == 0, x).otherwise(F.concat(F.lit("    "), x)))
    rows = table(spark, sf_dir, "documents").filter(F.size(T.lines(F.col("text"))) > 0)
    return rows.select("doc_id", F.size(T.split_groups(ls)).cast("long").alias("n_groups"))


@query(
    r"""with w as (select doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') l from documents), f as (select doc_id, unnest(range(1, len(l) + 1)) i, unnest(l) w from w),
    s as (select doc_id, i, upper(w[1:1]) || ' ' || w[2:] t, w[1:1] a, w[2:] r from f where regexp_matches(w, '^[A-Za-z][a-z]{2,}$'))
    select doc_id, count(*) n, count(*) filter (where (upper(a) not in ('A', 'I')) or regexp_matches(r, '^[b-df-hj-np-tv-xz]{2}')) repaired from s group by 1"""
)
def str_20_split_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of whole texts with its first letter set apart: A and I stay apart before what can be said."""
    words = F.filter(T.tokens(F.col("text")), lambda w: w.rlike("^[A-Za-z][a-z]{2,}$"))
    apart = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit(" "), F.substr(w, F.lit(2))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(apart).alias("t"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.contains(T.repair_split_capitals(F.col("t")), F.lit(" "))).alias("repaired"))


@query(
    r"""with s as (select doc_id, text t, cast(doc_id % 500 as int) cp, cast(doc_id % 700 as int) u from (select doc_id, replace(text, 'e', chr(128512)) as text from documents)),
    c as (select doc_id, u, unnest(range(length(t))) i, unnest(string_split(t, '')) ch from s), b as (select doc_id, u, i, sum(case when ch = chr(128512) then 2 else 1 end) over (partition by doc_id order by i) - case when ch = chr(128512) then 2 else 1 end before from c where i < u)
    select s.doc_id, cast(least(cp, length(t)) + length(substring(t, 1, cp)) - length(replace(substring(t, 1, cp), chr(128512), '')) as int) units, cast(coalesce((select count(*) from b where b.doc_id = s.doc_id and before < b.u), 0) as int) points from s"""
)
def str_29_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in texts whose every e is a character of two UTF-16 units, there and back."""
    t = F.replace(F.col("text"), F.lit("e"), F.lit("\U0001f600"))
    at = lambda n: (F.col("doc_id") % n).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.utf16_offset(t, at(500)).alias("units"), T.code_point_offset(t, at(700)).alias("points"))


@query(
    r"""with c as (select doc_id, substring(split_part(text, chr(10), 1), 1, cast(doc_id % 450 as int)) || case doc_id % 6 when 0 then '.pdf' when 1 then ' Untitled' when 2 then '.docx ' else '' end t, case doc_id % 4 when 0 then ' Microsoft  WORD ' when 1 then source when 2 then 'pdfTeX' else 'Writer' end a from documents), b as (select *, regexp_replace(t, '^\s+|\s+$', '', 'g') v from c)
    select doc_id, length(v) between 8 and 400 and not regexp_matches(lower(v), 'untitled|unknown|microsoft word|document|pdf') and not regexp_matches(lower(v), '\.(pdf|docx?|tex|indd)$') plausible, doc_id % 2 = 0 software from b"""
)
def str_25_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines cut to many lengths as titles, some of them placeholders or file names; programs and names as authors."""
    end = F.when(F.col("doc_id") % 6 == 0, ".pdf").when(F.col("doc_id") % 6 == 1, " Untitled").when(F.col("doc_id") % 6 == 2, ".docx ").otherwise("")
    title = F.concat(F.left(F.split("text", "\n")[0], (F.col("doc_id") % 450).cast("int")), end)
    author = F.when(F.col("doc_id") % 4 == 0, " Microsoft  WORD ").when(F.col("doc_id") % 4 == 1, F.col("source")).when(F.col("doc_id") % 4 == 2, "pdfTeX").otherwise("Writer")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_plausible_title(title).alias("plausible"), T.is_software_name(author).alias("software"))


_FRONT = "case doc_id % 7 when 0 then '© 1999-2003 the authors' when 1 then 'Proceedings of the 3rd Conference, 1987' when 2 then 'Vol. 4, no. 2, 1971 and 1972' when 3 then 'Received 2011' when 4 then 'See doi:10.1234/ab.' || doc_id || '.' else '' end"


@query(
    rf"""with d as (select doc_id, {_FRONT} || chr(10) || text as front, case when doc_id % 3 = 0 then ['Head 1960', 'Foot 1965 to 1966'] end edges, case when doc_id % 2 = 0 then 2020 end created from documents),
    v as (select *, list_filter(string_split(front, chr(10)), lambda x: regexp_matches(x, '\b(proceedings|proc\.|conference|conf\.|journal|transactions|trans\.|symposium|workshop|ieee|acm|springer|elsevier|arxiv|preprint|vol\.|volume\s+\d|no\.\s*\d|pp\.\s*\d)\b', 'i') and length(trim(x)) between 10 and 220)[1] line,
      try_cast(nullif(regexp_extract(front, '(?i)(?:©|\(c\)|copyright)\s*(?:\d{{4}}\s*[-–]\s*)?(\d{{4}})', 1), '') as int) c, list_distinct(regexp_extract_all(substring(front, 1, 1200), '\b(19[5-9]\d|20[0-4]\d)\b', 1)) y from d),
    w as (select *, coalesce(trim(line), '') ven, list_distinct(regexp_extract_all(coalesce(line, ''), '\b(19[5-9]\d|20[0-4]\d)\b', 1)) vy from v),
    r as (select *, coalesce(c, case when len(vy) = 1 then vy[1]::int end, case when edges is not null then 1960 end, case when len(y) = 1 then y[1]::int end) printed from w)
    select doc_id, nullif(regexp_replace(regexp_extract(front, '\b10\.\d{{4,9}}/[^\s"<>,;]+'), '\.+$', ''), '') doi, ven venue, coalesce(printed, created) as "year", printed is null and created is not null unverified from r"""
)
def str_24_document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier, venue and year of whole texts under a first line of several kinds."""
    k = F.col("doc_id") % 7
    first = F.when(k == 0, "© 1999-2003 the authors").when(k == 1, "Proceedings of the 3rd Conference, 1987").when(k == 2, "Vol. 4, no. 2, 1971 and 1972").when(k == 3, "Received 2011").when(k == 4, F.concat(F.lit("See doi:10.1234/ab."), F.col("doc_id"), F.lit("."))).otherwise("")
    edges = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Head 1960"), F.lit("Foot 1965 to 1966")))
    found = layout.metadata(F.concat(first, F.lit("\n"), F.col("text")), edges, F.when(F.col("doc_id") % 2 == 0, 2020))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("m")).select("doc_id", "m.*")


_ANSWERS = """select event_id, user_id, event_id % 3 kind, event_type || '|x |' || {k} expected, case event_id % 7 when 0 then event_type || '|x |' || {k} when 1 then ' ' || upper(event_type) || '|X|' || {k} || ' ' when 2 then 'x|' || event_type || '|' || {k} when 3 then event_type || '|x' when 5 then event_type when 6 then '' end given from (select *, cast(json_extract_string(props, '$.k') as int) k from events)""".replace("{k}", "k")


_JUDGED = f"""a as ({_ANSWERS}), j as (select *, list_transform(string_split(expected, '|'), lambda x: lower(trim(x))) e, list_transform(string_split(given, '|'), lambda x: lower(trim(x))) g from a),
    q as (select *, coalesce(case kind when 0 then e = g when 1 then len(g) = 3 and list_sort(e) = list_sort(g) else g[1] <> '' and lower(trim(string_split(expected, '|')[1])) = lower(trim(given)) end, false) correct from j)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions of the three kinds: right, mis-cased, in another order, short, missing or blank."""
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").withColumn("expected", F.concat_ws("|", "event_type", F.lit("x "), k))
    v = F.col("event_id") % 7
    given = F.when(v == 0, F.col("expected")).when(v == 1, F.concat(F.lit(" "), F.upper("event_type"), F.lit("|X|"), k, F.lit(" "))).when(v == 2, F.concat_ws("|", F.lit("x"), "event_type", k)).when(v == 3, F.concat_ws("|", "event_type", F.lit("x"))).when(v == 5, F.col("event_type")).when(v == 6, "")
    rows = e.withColumn("given", given)
    parts = lambda c: F.split(c, r"\|")
    paired = lambda c: F.map_from_arrays(parts(c), parts(c))  # noqa: E731  each answer under its own name
    correct = F.when(F.col("event_id") % 3 == 0, quiz.sequence_correct(parts("given"), parts("expected"))).when(F.col("event_id") % 3 == 1, quiz.relation_correct(paired("given"), paired("expected"))).otherwise(quiz.choice_correct(F.col("given"), parts("expected")[0]))
    return rows.select("event_id", "user_id", correct.alias("correct"))


@query(f"with {_JUDGED} select event_id, correct from q")
def jsn_04_str_39_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("event_id", "correct")


@query(f"with {_JUDGED} select user_id, count(*) total, count(*) filter (where correct) correct, cast(round_even(100.0::double * count(*) filter (where correct) / count(*), 2) as double) score from q group by 1")
def agg_20_quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.score(_answers(spark, sf_dir), "user_id")


_SENTENCES = r"""q as (select doc_id, unnest(range(len(l))) place, unnest(l) line from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10) || chr(10), 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l from documents)),
    t as (select *, list_filter(string_split_regex(line, '\s+'), lambda y: y <> '') ws from q),
    c as (select doc_id, place, unnest(case when len(ws) <= 480 then [0] else range(0, len(ws), 320) end) j, line, ws from t),
    p as (select doc_id, row_number() over (partition by doc_id order by place, j) - 1 i, case when len(ws) <= 480 then line else array_to_string(ws[j + 1:j + 320], ' ') end line, case when len(ws) <= 480 then len(ws) else least(320, len(ws) - j) end w from c)"""


@query(
    f"""with recursive {_SENTENCES}, f as (select doc_id, cast(-1 as bigint) i, 0::bigint as words, 0 as chunk, false as closed from (select distinct doc_id from p) union all
      select doc_id, i, case when ov then w else words + w end, chunk, case when ov then w else words + w end >= 480 from (
        select f.doc_id, p.i, p.w, case when f.closed then 0 else f.words end words, case when f.closed then 0 else f.words end + p.w > 320 and case when f.closed then 0 else f.words end >= 180 ov,
        f.chunk + cast(f.closed as int) + cast(case when f.closed then 0 else f.words end + p.w > 320 and case when f.closed then 0 else f.words end >= 180 as int) chunk from f join p on p.doc_id = f.doc_id and p.i = f.i + 1))
    select doc_id, cast(chunk as int) "index", cast(sum(w) as int) word_count, false is_cliffhanger, false has_prompt, md5(string_agg(line, chr(10) || chr(10) order by i)) text_md5 from f join p using (doc_id, i) group by doc_id, chunk"""
)
def seg_10_research_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 180 to 320 words from whole texts whose sentences are the paragraphs."""
    text = F.regexp_replace("text", r"([.!?])\s+", "$1\n\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(segment.chunk_section(text)))
    return rows.select("doc_id", "index", "word_count", "is_cliffhanger", "has_prompt", F.md5("text").alias("text_md5"))


_NAMES = ("text/chapter-", "Text/cover-", "nav.xhtml#", "navel-", "toc_", "Contents-", "half/halftitle", "LICENSE-", "licencing-", "back-matter", "backmatter", "colophon", "story-")
_KINDS = ("bodymatter chapter", "frontmatter", "dedication", "", "landmarks toc", "bodymatter", "acknowledgements")


@query(
    f"""select doc_id, coalesce(regexp_matches(h, '(cover|nav\\b|toc|contents|titlepage|title-page|halftitle|copyright|colophon|imprint|licen[cs]e|uncopyright|dedication|frontmatter|back-?matter)', 'i'), false)
      or list_has_any(string_split(k, ' '), ['cover', 'toc', 'titlepage', 'copyright-page', 'colophon', 'imprint', 'dedication', 'acknowledgements', 'frontmatter', 'backmatter', 'landmarks']) skipped
    from (select doc_id, ({list(_NAMES)})[cast(doc_id % {len(_NAMES)} + 1 as int)] || source h, ({list(_KINDS)})[cast(doc_id % {len(_KINDS)} + 1 as int)] k from documents)"""
)
def str_18_epub_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items named and typed in many ways, all combinations of both."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", files.skipped_item(F.concat(pick(_NAMES), "source"), F.split(pick(_KINDS), " ")).alias("skipped"))


_q = lambda t: t.replace("'", "''")
_LINE_FORMS = """case cast(session_id % 9 as int) when 0 then 'Ann ' || initcap_ || ', B. van Doe and Carl Poe' when 1 then initcap_ || ' Lee; Eve Moe · J. K. Rey' when 2 then initcap_ || ' & the data' when 3 then initcap_ || ' Roe, University of X' when 4 then initcap_ || ' A B C D'
      when 5 then initcap_ when 6 then initcap_ || ' Roe,' else text end"""


@query(
    f"""with n as (select session_id, text, upper(substring(w, 1, 1)) || substring(w, 2) initcap_ from (select session_id, text, string_split(trim(text), ' ')[1] w from sessions)), l as (select session_id, {_LINE_FORMS} t from n),
    b as (select session_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) b from l), p as (select session_id, b, list_filter(list_transform(string_split_regex(b, '(?i),|;|\\sand\\s|\\s&\\s|·|\\|'), lambda x: trim(x)), lambda x: x <> '') names from b)
    select session_id, b <> '' and length(b) <= 120 and not regexp_matches(b, '{_q(T.NO_NAME)}') and not regexp_matches(b, '[A-Za-z]{{2,}}\\.(\\s|$)') and not regexp_matches(b, '[,;:]$') and len(names) between 1 and 12
      and len(list_filter(names, lambda x: len(string_split(x, ' ')) > 4 or len(list_filter(string_split(x, ' '), lambda y: not (regexp_matches(y, '^[A-Z]\\.?$') or (not list_contains({list(T.PROSE_WORDS)}, lower(trim(y, '.'))) and regexp_matches(y, '{_q(T.NAME_TOKEN)}'))))) > 0)) = 0
      and (len(names) > 1 or len(string_split(names[1], ' ')) > 1) byline from p""",
    "sessions",
)
def str_21_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, some made into lists of names, with places, prose or signs that no name has."""
    text, word = F.col("text"), F.split(F.trim("text"), " ")[0]
    first = F.left(word, F.lit(1))
    capital = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(F.translate(first, "ß", "ẞ"))  # one letter for one, as in SQL, where Spark makes SS of ß
    w = F.concat(capital, F.substr(word, F.lit(2)))
    ends = [F.concat(F.lit("Ann "), w, F.lit(", B. van Doe and Carl Poe")), *[F.concat(w, F.lit(x)) for x in (" Lee; Eve Moe · J. K. Rey", " & the data", " Roe, University of X", " A B C D", "", " Roe,")], text, text]
    line = F.element_at(F.array(*ends), (F.col("session_id") % 9 + 1).cast("int"))
    return adapt(spark, sf_dir, "sessions").select("session_id", T.is_byline(line).alias("byline"))


_SPLIT = r"""g as (select doc_id, t, string_split_regex(t, '\n{2,}') l, regexp_extract_all(t, '\n{2,}') gaps from (select doc_id, regexp_replace(text, '([.!?])\n', '\1' || chr(10) || chr(10) || chr(10), 'g') t from documents)),
    s as (select doc_id, t, unnest(l) p, unnest(list_transform(range(1, len(l) + 1), lambda i: cast(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda x: length(x))), 0) as int))) a from g)"""


@query(
    f"""with {_SPLIT}, h as (select s.*, cast(doc_id % 97 as int) x, cast(doc_id % 97 + 1 + doc_id % 300 as int) y, doc_id % 5 = 0 or doc_id % 97 + 1 + doc_id % 300 > length(t) stale from s),
    c as (select *, not stale and greatest(x, a) < least(y, a + length(p)) drawn, greatest(x, a) u, least(y, a + length(p)) v from h)
    select doc_id, a as start, case when not drawn then 1 else 1 + cast(u > a as int) + cast(v < a + length(p) as int) end pieces, case when drawn then substring(p, u - a + 1, v - u) end marked, md5(p) joined_md5 from c"""
)
def str_30_paragraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of whole texts, cut by a span that may cover several, or be stale; its pieces together are the paragraph."""
    at = F.col("doc_id") % 97
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"([.!?])\n", "$1\n\n\n").alias("t"), at.cast("int").alias("x"), (at + 1 + F.col("doc_id") % 300).cast("int").alias("y"))
    own = F.substr(F.col("t"), F.col("x") + 1, F.col("y") - F.col("x"))
    quote = F.when(F.col("doc_id") % 5 == 0, F.concat(own, F.lit("!"))).when(F.col("y") > F.length("t"), F.lit("past the end")).otherwise(own)
    spans = F.array(F.struct(F.col("doc_id").alias("id"), F.col("x").alias("start"), F.col("y").alias("end"), quote.alias("quote")))
    cut = rows.select("doc_id", "t", spans.alias("spans"), F.inline(T.paragraph_starts(F.col("t")))).select("doc_id", "start", T.segments(F.col("t"), F.col("start"), F.col("text"), F.col("spans")).alias("s"), "text")
    pieces = F.when(F.col("text") == "", 1).otherwise(F.size("s"))
    return cut.select("doc_id", "start", pieces.alias("pieces"), F.get(F.filter("s", lambda x: x["id"].isNotNull()), F.lit(0))["text"].alias("marked"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("joined_md5"))


@query(
    r"""with l as (select session_id, chapter_id, session_index, case cast(session_id % 11 as int) when 0 then 'Abstract' when 1 then '7. References' when 2 then 'B. Appendix' when 3 then '3.1 Acknowledgments to all' when 4 then 'IV. ' || text when 5 then 'WORKS CITED:' when 6 then 'Referencesx' else text end t from sessions),
    k as (select *, lower(trim(regexp_replace(t, '^\s*(?:(?:[IVXLCDM]{1,6}|\d{1,2}(?:\.\d{1,2}){0,3}|[A-H])\s*[.)]\s+|(?:\d{1,2}(?:\.\d{1,2}){1,3})\s+)', ''))) b from l),
    n as (select *, case when regexp_matches(b, '^(abstract|summary)\b') then 'abstract' when regexp_matches(b, '^(references|bibliography|works cited|literature cited)\b') then 'references' when regexp_matches(b, '^(appendi(x|ces)|supplementary|acknowledge?ments?)\b') then 'appendix' else 'body' end own from k)
    select session_id, case when own = 'body' and coalesce(bool_or(own = 'references') over (partition by chapter_id order by session_index rows between unbounded preceding and 1 preceding), false) then 'references' else own end kind from n""",
    "sessions",
)
def str_23_section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a title, some of them named and numbered sections; after the references, others are references too."""
    text = F.col("text")
    forms = [F.lit("Abstract"), F.lit("7. References"), F.lit("B. Appendix"), F.lit("3.1 Acknowledgments to all"), F.concat(F.lit("IV. "), text), F.lit("WORKS CITED:"), F.lit("Referencesx"), text, text, text, text]
    rows = adapt(spark, sf_dir, "sessions").select("session_id", "chapter_id", "session_index", F.element_at(F.array(*forms), (F.col("session_id") % 11 + 1).cast("int")).alias("title"))
    return layout.kinds_in_order(rows, F.col("title"), ["chapter_id"], "session_index").select("session_id", "kind")


def _printed(text: Column) -> Column:
    """A PDF file of a text's lines, sixty to a page, each at its own place, in Latin-1."""
    ls = F.transform(T.lines(text), lambda x: F.regexp_replace(x, r"([\\()])", r"\\$1"))

    def file(ls: Column) -> Column:
        n = F.greatest(F.ceil(F.size(ls) / 60), F.lit(1)).cast("int")
        pages = F.sequence(F.lit(0), n - 1)
        line = lambda x, i: F.concat(F.lit("BT /F1 10 Tf 1 0 0 1 54 "), (780 - 12 * i).cast("string"), F.lit(" Tm ("), x, F.lit(") Tj ET"))
        body = lambda p: F.array_join(F.transform(F.slice(ls, p * 60 + 1, 60), line), "\n")
        made = F.transform(pages, lambda p: F.concat((10 + 2 * p).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Contents "), (11 + 2 * p).cast("string"), F.lit(" 0 R >>\nendobj\n"), (11 + 2 * p).cast("string"), F.lit(" 0 obj\n<< >>\nstream\n"), body(p), F.lit("\nendstream\nendobj\n")))
        kids = F.array_join(F.transform(pages, lambda p: F.concat((10 + 2 * p).cast("string"), F.lit(" 0 R"))), " ")
        head = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>\nendobj\n2 0 obj\n<< /Type /Pages /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Kids ["
        return F.concat(F.lit(head), kids, F.lit("] >>\nendobj\n"), F.array_join(made, ""), F.lit("trailer << /Root 1 0 R >>\n"))

    return F.encode(F.element_at(F.transform(F.array(ls), file), 1), "ISO-8859-1")


@query(
    r"""select doc_id, cast(greatest(ceil(len(l) / 60.0), 1) as int) pages, len(l) n_lines, md5(array_to_string(l, chr(10))) lines_md5 from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents) where len(l) > 0"""
)
def src_04_07_pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts printed as PDF files and read back line by line."""
    from lectern.sources import pdf

    made = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), _printed(F.col("text")).alias("content"))
    lines = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    read = pdf.positioned_lines(made, chars=False).groupBy("name").agg(F.max("page").alias("pages"), F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).alias("lines_md5"))
    return read.select(F.col("name").cast("long").alias("doc_id"), "pages", "n_lines", "lines_md5")
