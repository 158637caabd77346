"""Queries over the remaining operators: checks, key points, segments, games, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims
from lectern.functions import text as T
from lectern.operators import breaks, segment, tags
from lectern.plans.registry import query
from lectern.sources.adapters import adapt, table
from lectern.sources.workers import let_import


@query(
    """select event_id, case when k < 10 then 'bad_range' when k > 90 then 'too_long' when event_id % 13 = 0 then 'bad_color' end error_code, nullif(trim(case when event_id % 4 = 0 then '  ' else 'note ' || k end), '') "comment" from reads""",
    "reads",
)
def flt_12_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, lengths, colours and blank comments of highlights as typed."""
    rows = adapt(spark, sf_dir, "reads").withColumns({"start_at": F.lit(10), "end_at": F.when(F.col("k") > 90, 10 + dims.MAX_SPAN + 1).otherwise(F.col("k") + 1), "color": F.when(F.col("event_id") % 13 == 0, "mauve").otherwise("yellow")})
    code = F.when(F.col("end_at") <= F.col("start_at"), "bad_range").when(F.col("end_at") - F.col("start_at") > dims.MAX_SPAN, "too_long").when(~F.col("color").isin("yellow", "green", "blue", "pink"), "bad_color")
    comment = F.nullif(F.trim(F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit("note "), "k"))), F.lit(""))
    return rows.select("event_id", code.alias("error_code"), comment.alias("comment"))


@query("select session_id, theme from tags where session_id in (select session_id from sessions where word_count >= 8 and section_kind in ('story', 'body'))", "sessions", "tags")
def flt_04_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = adapt(spark, sf_dir, "sessions").filter((F.col("word_count") >= 8) & F.col("section_kind").isin("story", "body")).select("session_id")
    return adapt(spark, sf_dir, "tags").join(ids, "session_id", "left_semi").select("session_id", "theme")


@query(
    """with w as (select doc_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') l from documents), n as (select doc_id, l, len(l) n from w), s as (select doc_id, l, n, unnest(case when n <= 300 then [0] else range(0, n, 200) end) i from n)
    select doc_id, i // 200 piece, case when n <= 300 then n else least(200, n - i) end words from s"""
)
def seg_04_hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without sentence ends, cut every 200 words if they have more than 300."""
    plain = F.regexp_replace(T.collapse(F.col("text")), "[.!?]", "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.split_oversized(F.when(plain == "", F.lit(" ")).otherwise(F.regexp_replace(T.collapse(F.col("text")), "[.!?]", ",")), 200)).alias("piece", "text"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), F.greatest(T.word_count(F.col("text")), F.lit(0)).cast("long").alias("words"))


@query(
    r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents), p as (select doc_id, cast(least(doc_id % 8, len(l)) as int) n, l from l)
    select doc_id, case when doc_id % 10 in (7, 8) then null when doc_id % 10 = 9 and n between 0 and 4 then null else md5(array_to_string(list_filter(list_transform(l[1:least(n, 5)], lambda x: trim(substring(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 240))), lambda x: x <> ''), chr(10))) end points_md5 from p"""
)
def jsn_03_key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of up to seven lines of a text as points; some have no list, are no JSON, or end with a number."""
    rows = table(spark, sf_dir, "documents").withColumn("l", T.lines(F.col("text")))
    n, k = F.least(F.col("doc_id") % 8, F.size("l")).cast("int"), F.col("doc_id") % 10
    listed = F.transform(F.slice("l", 1, n), lambda x: F.concat(F.lit("  "), F.replace(x, F.lit(" "), F.lit("   "))))
    quoted = F.array_join(F.transform(listed, lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)), ",")
    whole = F.concat(F.lit('```json\n{"points": ['), quoted, F.lit("]}\n```"))
    numbered = F.concat(F.lit('{"points": ['), quoted, F.when(n > 0, ", 7").otherwise("7"), F.lit("]}"))
    reply = F.when(k == 7, F.concat(F.lit('{"points": '), F.lit('"x"}'))).when(k == 8, F.col("text")).when(k == 9, numbered).otherwise(whole)
    return rows.select("doc_id", F.md5(F.array_join(tags.parse_key_points(reply), "\n")).alias("points_md5"))


@query("select event_id, coalesce(k % 2 = 0, false) no_date, case when k % 3 = 0 then 2 else 0 end n_captions from reads", "reads")
def jsn_06_notes_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research notes with defaults for what is missing."""
    k = F.col("k")
    raw = F.when(k % 6 == 0, '{"captions": ["a", "b"], "no_date": true}').when(k % 6 == 3, '{"captions": ["a", "b"]}').when(k % 2 == 0, '{"no_date": true}')
    parsed = F.from_json(raw, "captions array<string>, warnings array<string>, unverified array<string>, no_date boolean")
    none = F.expr("cast(array() as array<string>)")
    return adapt(spark, sf_dir, "reads").select("event_id", F.coalesce(parsed["no_date"], F.lit(False)).alias("no_date"), F.size(F.coalesce(parsed["captions"], none)).alias("n_captions"))


@query("select event_id, array_to_string(list_filter([case when k % 2 = 0 then 'romance' end, case when k % 3 = 0 then 'war_conflict' end], lambda x: x is not null), ',') labels from reads", "reads")
def jsn_07_src_10_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.when(F.col("k") % 2 == 0, " romance ").otherwise(""), F.when(F.col("k") % 3 == 0, "war_conflict"), F.when(F.col("k") % 2 == 0, "romance")]
    return adapt(spark, sf_dir, "reads").select("event_id", F.array_join(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in cols]))), ",").alias("labels"))


_ACTIONS, _ENDS = ("MARK_DUE", "SHOW_OFFER", "ACCEPT", "FINISH", "DONE", "DECLINE", "CANCEL_DUE"), ("solved", "bogus", "skipped", "time_cap")
_MOVES = " ".join(f"when '{p}:{a}' then '{n}'" for (p, a), n in breaks.PHASES.items() if a != "FINISH")


@query(
    f"""with a as (select user_id, event_id, list_extract({list(_ACTIONS)}, cast((event_id * 3 + k) % 7 + 1 as int)) act, list_extract({list(_ENDS)}, cast(event_id % 4 + 1 as int)) fin from reads),
    l as (select user_id, list_prepend('idle', list(case when act = 'FINISH' then case when fin = 'bogus' then 'none' else fin end else act end order by event_id)) l from a group by 1)
    select user_id, split_part(s, '/', 1) phase, nullif(split_part(s, '/', 2), '') outcome from (select user_id, list_reduce(l, lambda s, x: case when s = 'playing' and x in {breaks.OUTCOMES} then 'ended/' || x
      else case split_part(s, '/', 1) || ':' || x {_MOVES} else s end end) s from l)""",
    "reads",
)
def stm_05_break_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase machine over all of each reader's events in order, some of them not valid where they come."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    act = F.struct("event_id", pick(_ACTIONS, (F.col("event_id") * 3 + F.col("k")) % 7).alias("type"), pick(_ENDS, F.col("event_id") % 4).alias("outcome"))
    rows = adapt(spark, sf_dir, "reads").groupBy("user_id").agg(F.array_sort(F.collect_list(act)).alias("actions"))
    return rows.select("user_id", breaks.phase(F.col("actions")).alias("s")).select("user_id", "s.phase", "s.outcome")


@query("select lang, count(*) chunks, count(*) * 1400 tokens from documents group by 1")
def mth_06_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("chunks")).withColumn("tokens", F.col("chunks") * dims.TOKENS_PER_CHUNK)


_LINEAR = "list_transform([('0x' || substring({0}, {1}, 2))::int / 255.0::double], lambda c: case when c <= 0.03928 then c / 12.92 else pow((c + 0.055) / 1.055, 2.4) end)[1]"


def _luma(colour: str) -> str:
    return f"(0.2126::double * {_LINEAR.format(colour, 2)} + 0.7152::double * {_LINEAR.format(colour, 4)} + 0.0722::double * {_LINEAR.format(colour, 6)})"


_MIXED = " || ".join(f"printf('%02x', cast(floor(('0x' || substring(t, {i}, 2))::int + (255 - ('0x' || substring(t, {i}, 2))::int) * (event_id % 11 / 10.0::double) + 0.5) as int))" for i in (2, 4, 6))


@query(
    f"""with c as (select event_id, case when event_id % 9 = 0 then '#' || repeat(printf('%x', event_id % 16), 6) else '#' || printf('%06x', event_id * 7919 % 16777216) end t from events), g as (select *, '#' || {_MIXED} g from c),
    l as (select *, {_luma("t")} lt, {_luma("g")} lg from g), r as (select *, (greatest(lt, lg) + 0.05::double) / (least(lt, lg) + 0.05::double) c from l)
    select event_id, g ground, case when c >= 4.5 then 'ok' when c >= 3 then 'warn' else 'refuse' end verdict, cast(round(c, 6) as double) contrast, case when 1.05::double / (lg + 0.05::double) >= (lg + 0.05::double) / 0.05::double then '#ffffff' else '#000000' end readable from r"""
)
def mth_08_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours all over the cube, some written in three digits or capitals, on grounds between them and white."""
    e = F.col("event_id")
    typed = F.when(e % 9 == 0, F.concat(F.lit("#"), F.repeat(F.hex(e % 16), F.lit(3)))).otherwise(F.concat(F.lit(" #"), F.lpad(F.hex(e * 7919 % 16777216), 6, "0")))
    rows = table(spark, sf_dir, "events").select("event_id", breaks.parse_hex(typed).alias("t"))
    rows = rows.withColumn("ground", breaks.blend(F.col("t"), F.lit("#ffffff"), e % 11 / 10))
    return rows.select("event_id", "ground", breaks.palette_check(F.col("t"), F.col("ground")).alias("verdict"), F.round(breaks.contrast(F.col("t"), F.col("ground")), 6).alias("contrast"), breaks.readable_on(F.col("ground")).alias("readable"))


@query(
    """with b as (select event_id, event_id % 3 > 0 multi, (event_id * 2654435761 + 4294967290) % 4294967296 seed from events), r as (select event_id, seed, unnest(range(case when multi then 3 + (seed // 2) % 2 else 1 end)) number from b)
    select event_id, cast(number as int) number, cast((seed + number) % 4294967296 as bigint) round_seed from r"""
)
def mth_09_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every round of the breaks that the events' seeds give, with its seed."""
    seed = (F.col("event_id") * F.lit(2654435761).cast("long") + F.lit(4294967290).cast("long")) % F.lit(4294967296).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", seed.alias("seed"), (F.col("event_id") % 3 > 0).alias("multi"))
    rounds = rows.select("event_id", "seed", F.explode(F.sequence(F.lit(0), breaks.round_count(F.col("multi"), F.col("seed")) - 1)).alias("number"))
    return rounds.select("event_id", "number", breaks.round_seed(F.col("seed"), F.col("number")).alias("round_seed"))


@query("with w as (select distinct lower(word) word from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) word from documents)) select count(*) pairs from w a join w b on length(a.word) = length(b.word) and a.word < b.word and hamming(a.word, b.word) = 1")
def str_40_one_letter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    return breaks.one_letter_pairs(words.select(F.lower("w").alias("word")).distinct()).agg(F.count("*").alias("pairs"))


@query(
    """with h as (select doc_id, line_no, (doc_id + line_no) % 9 number from (select doc_id, unnest(range(12)) line_no from documents)), n as (select doc_id, line_no, number, lead(number) over (partition by doc_id order by line_no) nxt, row_number() over (partition by doc_id order by line_no) rn from h)
    select doc_id from n group by 1 having count(*) >= 3 and max(number) filter (where rn = 1) = 1 and count(*) filter (where nxt = number + 1) >= count(*) * 0.6"""
)
def win_17_18_plausible_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("line_no"))
    return segment.plausible(rows.withColumn("number", ((F.col("doc_id") + F.col("line_no")) % 9).cast("int")))


@query("with l as (select chapter_id, text, lead(text) over (partition by chapter_id order by session_index) nxt from sessions) select chapter_id, avg(case when not regexp_matches(text, '[.!?]$') and regexp_matches(nxt, '^[A-Z0-9]') then 1.0::double else 0.0::double end) ratio from l where nxt is not null group by 1", "sessions")
def agg_23_stitched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("chapter_id").orderBy("session_index")
    rows = adapt(spark, sf_dir, "sessions").withColumn("nxt", F.lead("text").over(w)).filter("nxt is not null")
    stitched = ~F.col("text").rlike("[.!?]$") & F.col("nxt").rlike("^[A-Z0-9]")
    return rows.groupBy("chapter_id").agg(F.avg(stitched.cast("double")).alias("ratio"))


@query("select doc_id, len(l) n_pieces from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents) where false union all select doc_id, 1 + coalesce(list_sum(list_transform(range(1, len(l)), lambda i: case when not regexp_matches(l[i], '[.!?…:][\"''”’)\\]]*$') and regexp_matches(l[i + 1], '^[a-z,;:!?.)\\]…\"''”’]') then 0 else 1 end)), 0) n_pieces from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents) where len(l) > 0")
def str_09_merge_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.size(T.lines(F.col("text"))) > 0)
    return rows.select("doc_id", F.size(T.merge_continuations(T.lines(F.col("text")))).cast("long").alias("n_pieces"))


@query("select doc_id, md5(replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ')) joined_md5 from documents")
def str_06_join_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.join_wrapped(F.split("text", "\n"))).alias("joined_md5"))


@query("select r_name, n_name, s_name, o_orderkey from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey where l_quantity > 49 and o_orderpriority is not null")
def src_01_jn_03_scan_and_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with pushed filters and pruned columns, dimensions joined by what Spark measures them to be."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority is not null").select("o_orderkey")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("r_name", "n_name", "s_name", "o_orderkey")


_MASK = 4294967296
_DRAWS = ", ".join(f"cast((seed + {n * 1831565813}) % {_MASK} as bigint) a{n}" for n in (1, 2, 3))


def _draw(a: str) -> str:
    first = f"cast((cast(xor({a}, {a} >> 15) as hugeint) * ({a} | 1)) % {_MASK} as bigint)"
    second = "xor(t, cast((t + cast((cast(xor(t, t >> 7) as hugeint) * (t | 61)) % 4294967296 as bigint)) % 4294967296 as bigint))"
    return f"list_transform(list_transform([{first}], lambda t: {second}), lambda t: xor(t, t >> 14) / 4294967296.0::double)[1]"


_SWAP = "list_transform(range(1, 5), lambda p: case when p = {i} then {l}[{j}] when p = {j} then {l}[{i}] else {l}[p] end)"


@query(
    f"""with s as (select event_id, {_DRAWS} from (select event_id, (event_id * 2654435761) % {_MASK} seed from events)), d as (select event_id, cast(floor({_draw("a1")} * 4) as int) + 1 j1, cast(floor({_draw("a2")} * 3) as int) + 1 j2, cast(floor({_draw("a3")} * 2) as int) + 1 j3 from s),
    x as (select *, {_SWAP.format(i=4, j="j1", l="['a', 'b', 'c', 'd']")} l1 from d), y as (select *, {_SWAP.format(i=3, j="j2", l="l1")} l2 from x) select event_id, array_to_string({_SWAP.format(i=2, j="j3", l="l2")}, '') bag from y"""
)
def srt_10_stm_06_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bag of four games that each event's seed shuffles."""
    let_import(spark)
    bag = F.pandas_udf(lambda seeds: seeds.map(lambda s: "".join(breaks.shuffled(list("abcd"), int(s)))), "string")
    return table(spark, sf_dir, "events").select("event_id", bag((F.col("event_id") * F.lit(2654435761).cast("long")) % F.lit(4294967296).cast("long")).alias("bag"))
