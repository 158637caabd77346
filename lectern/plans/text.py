"""Queries over text: cleaning, folds, passages, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import segment
from lectern.plans.registry import query
from lectern.sources.adapters import adapt, table

_W = "len(list_filter(string_split(line, ' '), lambda x: x <> ''))"
_PARAS = f"p as (select chapter_id, idx i, line, {_W} w, count(*) over (partition by chapter_id) n from (select doc_id chapter_id, text from documents) d cross join lateral (select unnest(range(len(l))) as idx, unnest(l) as line from (select list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l)))"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as paragraphs."""
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("ps"))


@query(
    f"""with recursive {_PARAS}, f as (select chapter_id, cast(-1 as bigint) i, 0 as words, 0 as chunk, false as closed from (select distinct chapter_id from p) union all
      select chapter_id, i, case when ov then w else words + w end, chunk, case when ov then w else words + w end >= 90 from (
        select f.chapter_id, p.i, p.w, case when f.closed then 0 else f.words end words, case when f.closed then 0 else f.words end + p.w > 60 and case when f.closed then 0 else f.words end >= 40 ov,
        f.chunk + cast(f.closed as int) + cast(case when f.closed then 0 else f.words end + p.w > 60 and case when f.closed then 0 else f.words end >= 40 as int) chunk from f join p on p.chapter_id = f.chapter_id and p.i = f.i + 1))
    select chapter_id doc_id, cast(chunk as int) "index", cast(sum(w) as int) word_count, chunk = max(max(chunk)) over (partition by chapter_id) is_cliffhanger, chunk > 0 and chunk % 3 = 0 or chunk = max(max(chunk)) over (partition by chapter_id) has_prompt,
    md5(string_agg(line, chr(10) || chr(10) order by i)) text_md5 from f join p using (chapter_id, i) group by 1, 2, chapter_id, chunk"""
)
def seg_05_06_07_micro_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 40 to 60 words from every document's lines."""
    packed = segment.with_prompts(segment.pack(F.col("ps"), 40, 60))
    rows = _paragraphs(spark, sf_dir).select("doc_id", F.inline(packed))
    return rows.select("doc_id", "index", "word_count", "is_cliffhanger", "has_prompt", F.md5("text").alias("text_md5"))


@query(
    f"""with recursive {_PARAS}, f as (select chapter_id, cast(-1 as bigint) i, 0 as words, 0 as n, 0 as chunk from (select distinct chapter_id from p) union all
      select f.chapter_id, p.i, case when f.n > 0 and f.words + p.w > 100 then p.w else f.words + p.w end, case when f.n > 0 and f.words + p.w > 100 then 1 else f.n + 1 end, f.chunk + cast(f.n > 0 and f.words + p.w > 100 as int) from f join p on p.chapter_id = f.chapter_id and p.i = f.i + 1)
    select chapter_id doc_id, cast(sum(w) as int) word_count, md5(string_agg(line, chr(10) || chr(10) order by i)) text_md5 from f join p using (chapter_id, i) group by chapter_id, chunk"""
)
def seg_03_08_fixed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).select("doc_id", F.inline(segment.fixed_sections(F.col("ps"), 100)))
    return rows.select("doc_id", "word_count", F.md5("text").alias("text_md5"))


@query("select session_id, word_count n_words, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: true)) n_sentences from sessions", "sessions")
def str_01_12_words_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, "sessions").select("session_id", T.word_count(F.col("text")).alias("n_words"), F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query(
    """with recursive b as (select doc_id, regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g') body from documents), s as (select doc_id, body, string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) l from b),
    f as (select doc_id, body, l, 1 i, '' o, false fin from s union all select doc_id, body, l, i + 1, case when not fin and length(c) <= 240 then c else o end, fin or length(c) > 240 from (select *, case when o = '' then l[i] else o || ' ' || l[i] end c from f where i <= len(l) and not fin))
    select doc_id, case when max_by(o, i) = '' then substring(any_value(body), 1, 240) else max_by(o, i) end summary from f group by 1"""
)
def str_13_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("select event_id, case when event_id % 11 <> 10 then cast(event_id % 3999 + 1 as int) end n from events")
def str_14_roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of all numbers to 3,999 as the events count, in capitals or not, and some texts that are none."""
    n = F.col("event_id") % 3999 + 1
    digits = lambda one, five, ten: ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)
    place = lambda power, *letters: F.element_at(F.array(*[F.lit(x) for x in digits(*letters)]), (F.floor(n / power) % 10 + 1).cast("int"))
    numeral = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X"))
    text = F.when(F.col("event_id") % 11 == 10, F.concat(numeral, F.lit("q"))).when(F.col("event_id") % 2 == 0, F.lower(numeral)).otherwise(numeral)
    return table(spark, sf_dir, "events").select("event_id", T.roman(text).alias("n"))


@query("select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\s+([,.;:!?%)\\]}»”’])', '\\1', 'g'), '([(\\[{«“])\\s+', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) clean_md5 from (select doc_id, regexp_replace(replace(text, chr(9), ' '), ' +(\\n|$)', '\\1', 'g') as text from documents)")
def str_03_04_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tidy_spacing(T.clean(F.col("text")))).alias("clean_md5"))


@query("select doc_id, len(l) n_lines, len(l) >= 8 and list_sum(list_transform(l, lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> '')))) < len(l) * 5 listing, len(l) >= 4 and list_max(list_transform(l, lambda x: length(x))) <= 50 and list_sum(list_transform(l, lambda x: length(x))) <= 45 * len(l) short_lines from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents)")
def str_05_16_listing_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = T.lines(F.col("text"))
    marked = F.exists(ls, lambda x: x.rlike(T.LIST_MARKER))
    verse = F.when(marked, (F.size(ls) >= 4) & (F.array_max(F.transform(ls, F.length)) <= 50) & (F.aggregate(F.transform(ls, F.length), F.lit(0), lambda a, b: a + b) <= 45 * F.size(ls))).otherwise(T.is_verse_or_list(ls))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ls).alias("n_lines"), T.is_listing(F.col("text")).alias("listing"), F.coalesce(verse, F.lit(False)).alias("short_lines"))


_NAMED = "case page_id % 4 when 0 then url when 1 then replace(url, '/', chr(92)) || '.t<x>t' when 2 then url || '?a=' || repeat('long ', 40) else url || '/' end"


@query(
    f"""with n as (select page_id, {_NAMED} as name from pages) select page_id, coalesce(nullif(substring(trim(regexp_replace(regexp_extract(replace(coalesce(name, ''), chr(92), '/'), '([^/]*)$', 1), '[^A-Za-z0-9 ._-]', '', 'g')), 1, 120), ''), 'upload') safe from n"""
)
def src_13_safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as file names: with either slash, signs, spaces at the cut, or nothing after the last slash."""
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit(".t<x>t"))).when(k == 2, F.concat("url", F.lit("?a="), F.repeat(F.lit("long "), F.lit(40)))).otherwise(F.concat("url", F.lit("/")))
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(name).alias("safe"))


_ENDS = (".txt", ".TXT", ".pdf", ".epub", ".doc", "", ".Pdf")


@query(
    f"""with f as (select doc_id, lower(regexp_extract(source || ({list(_ENDS)})[cast(doc_id % 7 + 1 as int)], '\\.([^.]*)$', 1)) ext, case doc_id % 5 when 0 then 'pdf' when 1 then 'epub' else 'txt' end actual from documents),
    e as (select *, case when ext not in ('txt', 'epub', 'pdf') then 'unsupported_extension' when ext <> actual then 'extension_mismatch' end error from f) select doc_id, case when error is null then actual end format, error from e"""
)
def src_02_format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, bare or after the first bytes of other formats, under all endings."""
    end = F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("doc_id") % 7 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("%PDF-1.7\n")).when(F.col("doc_id") % 5 == 1, F.lit("PK\u0003\u0004")).otherwise("")
    sniffed = T.sniff(F.concat("source", end), F.encode(F.concat(head, F.col("text")), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", sniffed.alias("s")).select("doc_id", "s.format", "s.error")


@query(
    r"""select doc_id, case when doc_id % 5 <> 4 then md5(case doc_id % 5 when 1 then regexp_replace(t, '[^\x00-\x{FF}]', '?', 'g') when 2 then chr(65279) || t else t end) end decoded_md5 from (select doc_id, case when doc_id % 5 < 4 and doc_id % 5 > 0 then 'déjà vu ' || text else text end t from documents)"""
)
def src_03_text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in UTF-8, in Latin-1, with a byte order mark, with carriage returns, and garbled by control characters."""
    k = F.col("doc_id") % 5
    t = F.when((k > 0) & (k < 4), F.concat(F.lit("déjà vu "), F.col("text"))).otherwise(F.col("text"))
    utf8 = lambda c: F.encode(c, "UTF-8")
    raw = F.when(k == 1, F.encode(t, "ISO-8859-1")).when(k == 2, utf8(F.concat(F.lit("﻿"), t))).when(k == 3, utf8(F.replace(t, F.lit("\n"), F.lit("\r\n")))).when(k == 4, utf8(F.concat(F.repeat(F.lit("\u0001"), F.lit(20_000)), t))).otherwise(utf8(t))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.decode_text(raw)).alias("decoded_md5"))


@query(
    r"""select page_id, len(x) n_blocks, md5(array_to_string(list_transform(x, lambda t: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\s' || chr(160) || ']+', ' ', 'g'), '\s+([,.;:!?%)\]}»”’])', '\1', 'g'), '([(\[{«“])\s+', '\1', 'g'))), chr(10))) body_md5
    from (select page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<(?:p|blockquote|li)\b[^>]*>(.*?)</(?:p|blockquote|li)\s*>', 1, 'is') x from pages)"""
)
def src_05_str_18_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = T.html_blocks(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(blocks).alias("n_blocks"), F.md5(F.array_join(blocks, "\n")).alias("body_md5"))


@query(
    """select doc_id, cast(i // 4 as int) chapter_index, 'CHAPTER ' || (i // 4 + 1) title, md5(regexp_replace(string_agg(line, chr(10) order by i), '^\\s+|\\s+$', '', 'g')) text_md5
    from (select doc_id, unnest(l) line, unnest(range(len(l))) i from (select doc_id, string_split(text, chr(10)) l from documents)) group by doc_id, i // 4"""
)
def seg_01_02_09_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of documents whose every fourth line is made a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("CHAPTER "), (i / 4 + 1).cast("int").cast("string"), F.lit("\n"), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return segment.chapters(docs).select("doc_id", "chapter_index", "title", F.md5("text").alias("text_md5"))


_HAS = "len(list_filter([{}], lambda k: contains(t, k))) > 0"
_KEYS = {name: _HAS.format(", ".join("'" + k.replace("'", "''") + "'" for k in keys)) for name, keys in (("front", segment.FRONT), ("back", segment.BACK))}


@query(
    f"""with a as (select book_id doc_id, chapter_index i, text, case when chapter_index = 0 then 'Contents' when chapter_index % 7 = 3 then 'Chapter ' || chapter_index else '' end title, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from chapters),
    b as (select *, lower(coalesce(nullif(title, ''), case when length(l[1]) <= 80 then l[1] end, '')) t, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) w from a),
    c as (select *, min(case when regexp_matches(t, '^\\s*(chapter|part|book|canto|stave|act)\\b\\s*[ivxlcdm0-9]') then i end) over (partition by doc_id) f, max(case when regexp_matches(t, '^\\s*(chapter|part|book|canto|stave|act)\\b\\s*[ivxlcdm0-9]') then i end) over (partition by doc_id) z, {_KEYS["front"]} front, {_KEYS["back"]} back from b),
    d as (select doc_id, i, case when i < f then 'front_matter' when front and (f is null or i <= f) then 'front_matter' when i > z and back then 'back_matter' when back and w < 150 then 'back_matter' when front and w < 150 then 'front_matter'
      when len(l) >= 6 and w < 6 * len(l) and w < 600 then case when z is null or i < z then 'front_matter' else 'back_matter' end else 'story' end kind from c)
    select doc_id, section_kind, count(*) n from (select doc_id, case when bool_or(kind = 'story') over (partition by doc_id) then kind else 'story' end section_kind from d) group by 1, 2""",
    "chapters",
)
def str_17_section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = adapt(spark, sf_dir, "chapters").select(F.col("book_id").alias("doc_id"), "chapter_index", F.when(F.col("chapter_index") == 0, "Contents").when(F.col("chapter_index") % 7 == 3, F.concat(F.lit("Chapter "), F.col("chapter_index"))).otherwise("").alias("title"), "text")
    return segment.classify(chapters).groupBy("doc_id", "section_kind").agg(F.count("*").alias("n"))
