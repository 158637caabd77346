"""Small cases with known results: scoring, phases, rounds, reached passages, imports, offsets, layout of maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import breaks, events, layout, notes, quiz, reader, segment, tags
from lectern.sources import files


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_answers(spark):
    pairs = lambda *xs: F.create_map(*[F.lit(x) for x in xs])
    got = one(
        spark, quiz.sequence_correct(strings(" A", "b"), strings("a", "B ")), quiz.sequence_correct(strings("b", "a"), strings("a", "b")), quiz.sequence_correct(strings("a"), strings("a", "b")),
        quiz.sequence_correct(F.lit(None).cast("array<string>"), strings("a")), quiz.relation_correct(pairs("y", "2", "X ", "1"), pairs("x", "1", "Y", "2")), quiz.relation_correct(pairs("x", "1"), pairs("x", "1", "y", "2")),
        quiz.choice_correct(F.lit(" Paris "), F.lit("paris")), quiz.choice_correct(F.lit(" "), F.lit("")), quiz.choice_correct(F.lit(None).cast("string"), F.lit("x")),
    )
    assert tuple(got) == (True, False, False, False, True, False, True, False, False)


def test_scores(spark):
    rows = [(1, True), (1, False), (1, True), (2, False)] + [(3, i == 0) for i in range(32)] + [(4, None)]
    got = {r.a: (r.total, r.correct, r.score) for r in quiz.score(spark.createDataFrame(rows, "a int, correct boolean"), "a").collect()}
    assert got == {1: (3, 2, 66.67), 2: (1, 0, 0.0), 3: (32, 1, 3.12), 4: (0, 0, 0.0)}


def test_phases(spark):
    def run(*actions):
        pairs = [F.struct(F.lit(a.partition(" ")[0]).alias("type"), F.lit(a.partition(" ")[2] or None).cast("string").alias("outcome")) for a in actions]
        return tuple(one(spark, breaks.phase(F.array(*pairs)))[0])

    through = ["MARK_DUE", "SHOW_OFFER", "ACCEPT"]
    assert run("SHOW_OFFER", "DONE") == ("idle", None)
    assert run(*through) == ("playing", None)
    assert run(*through, "FINISH cheated") == ("playing", None)
    assert run(*through, "FINISH solved", "FINISH skipped") == ("ended", "solved")
    assert run(*through, "FINISH time_cap", "DONE") == ("idle", None)
    assert run("MARK_DUE", "CANCEL_DUE") == run("MARK_DUE", "SHOW_OFFER", "DECLINE") == ("idle", None)


def test_rounds(spark):
    got = one(spark, *[breaks.round_count(F.lit(True), F.lit(s)) for s in (0, 1, 2, 3, 4)], breaks.round_count(F.lit(False), F.lit(2)), breaks.round_seed(F.lit(4294967295), F.lit(1)))
    assert tuple(got) == (3, 3, 4, 4, 3, 1, 0)


def passages(spark, words, cliffs=()):
    rows = [(1, 1, 0, i, "story", w, i in cliffs, False, 100 + i) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "book_id int, chapter_id int, chapter_index int, session_index int, section_kind string, word_count int, is_cliffhanger boolean, has_prompt boolean, session_id int")


def test_reached(spark):
    book = passages(spark, [100, 100, 100, 100, 100, 100], cliffs=(3,))

    def at(current, size, *done):
        readers = spark.createDataFrame([(7, 1, current, size)], "user_id int, book_id int, current_no int, size int")
        completions = spark.createDataFrame([(7, 1, a, b) for a, b in done], "user_id int, book_id int, start_no int, words_read int")
        return [r.reached_no for r in reader.reached(book, readers, completions).collect()]

    assert at(None, 1) == [1] and at(None, 3) == [3]  # only the opening block
    assert at(3, 3) == [4]  # the block ends at a cliffhanger
    assert at(99, 1) == [1]  # a place that is gone counts as not started
    assert at(None, 1, (1, 250)) == [3] and at(None, 1, (1, 300)) == [3] and at(None, 1, (1, 301)) == [4]
    assert at(2, 1, (5, 9999)) == [6]
    assert at(None, 2, (4, 0)) == [4] and at(None, 2, (5, None)) == [6]
    assert at(6, 1, (1, 100)) == [6]


def test_epub_items(spark):
    hrefs = ["text/cover.xhtml", "nav.xhtml", "navel.xhtml", "halftitle.xhtml", "LICENSE.html", "licence.html", "dedication.xhtml", "back-matter.xhtml", "chapter-1.xhtml", None]
    rows = spark.createDataFrame([(i, h, "") for i, h in enumerate(hrefs)] + [(20, "a", "frontmatter"), (21, "a", "bodymatter chapter"), (22, "a", "x acknowledgements")], "i int, h string, k string")
    got = {r.i: r.s for r in rows.select("i", files.skipped_item(F.col("h"), F.split("k", " ")).alias("s")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True, 8: False, 9: False, 20: True, 21: False, 22: True}


def test_offsets(spark):
    t = F.lit("a\U0001f600b\U0001f600")
    assert tuple(one(spark, *[T.utf16_offset(t, F.lit(i)) for i in range(6)])) == (0, 1, 3, 4, 6, 6)
    assert tuple(one(spark, *[T.code_point_offset(t, F.lit(i)) for i in range(8)])) == (0, 1, 2, 2, 3, 4, 4, 4)


def test_active_time(spark):
    span = lambda a, b: F.struct(F.lit(a).cast("long").alias("from"), F.lit(b).cast("long").alias("to"))
    n = lambda x: F.lit(x).cast("long")
    got = one(spark, events.active_ms(n(100), n(1100), F.lit(None)), events.active_ms(n(100), n(1100), F.array(span(200, 300))), events.active_ms(n(100), n(1100), F.array(span(200, 300), span(1000, None))), events.active_ms(n(100), n(200), F.array(span(0, 900))))
    assert tuple(got) == (1000, 900, 800, 0)


def test_key_points(spark):
    replies = ['{"points": [" a  b ", "", "c"]}', '```json\n{"points": []}\n```', '{"points": ["1","2","3","4","5","6"]}', '{"points": ["a", 3]}', '{"points": "a"}', "no", '["a"]', '{"points": ["' + "x " * 300 + '"]}', '{"points": ["1","2","3","4","5",6]}']
    got = [r.p for r in spark.createDataFrame(list(enumerate(replies)), "i int, r string").orderBy("i").select(tags.parse_key_points(F.col("r")).alias("p")).collect()]
    assert got[:7] == [["a b", "c"], [], ["1", "2", "3", "4", "5"], None, None, None, None] and len(got[7][0]) == 239 and got[8] == ["1", "2", "3", "4", "5"]


def test_import_outcomes(spark):
    books = spark.createDataFrame([(1, 1342)], "book_id int, gutenberg_id int")
    sessions = spark.createDataFrame([(1, 0, i, 10 + i, f"text  {i}") for i in range(5)], "book_id int, chapter_index int, session_index int, session_id int, text string")
    good, bad = [("romance", 3)], [("romance", 6)]
    file = [(1342, 0, 0, "text 0", good), (1342, 0, 1, "other", good), (1342, 9, 1, "text 1", good), (1342, 0, 2, "text 2", bad), (1342, 0, 3, "text 3", bad), (1342, 0, 4, "text 4", [("cooking", 3)]), (84, 0, 0, "x", good), (84, 0, 1, "y", good)]
    entries = spark.createDataFrame(file, "gutenberg_id int, chapter int, session int, t string, themes array<struct<theme:string,score:int>>").withColumn("hash", tags.chunk_hash(F.col("t"))).drop("t")
    judged = tags.judged_entries(entries, books, sessions, spark.createDataFrame([(13,)], "session_id int"))
    assert {r.outcome: r.n for r in tags.import_outcomes(judged).collect()} == {"imported": 1, "mismatched": 2, "skipped_existing": 1, "invalid": 2, "missing_books": 1}


def test_map_columns_and_labels(spark):
    n = F.lit
    got = one(spark, tags.column_count(n(500), n(20), n(False)), tags.column_count(n(500), n(20), n(True)), tags.column_count(n(500), n(None).cast("int"), n(False)), tags.column_count(n(0), n(0), n(False)), tags.column_count(n(5), n(9), n(False)), tags.column_count(n(0), n(4), n(False)))
    assert tuple(got) == (20, 500, 500, 1, 5, 4)
    chapters = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 3, 5, 6, 11, 40])], "book_id int, chapter_index int, start_pos int")
    assert tags.thinned(chapters).first().labelled == [0, 2, 4, 5]


def test_colours(spark):
    c = F.lit
    got = one(spark, breaks.parse_hex(c(" #FfF ")), breaks.parse_hex(c("#12345")), breaks.blend(c("#000000"), c("#ffffff"), c(0.5)), breaks.blend(c("#102030"), c("#ffffff"), c(2.0)), breaks.readable_on(c("#ffff00")), breaks.readable_on(c("#000080")), F.round(breaks.contrast(c("#000000"), c("#ffffff")), 6))
    assert tuple(got) == ("#ffffff", None, "#808080", "#ffffff", "#000000", "#ffffff", 21.0)


def test_metadata_trust(spark):
    def found(front, edges=None, created=None):
        return tuple(one(spark, layout.metadata(F.lit(front), strings(*edges) if edges else None, F.lit(created) if created else None))[0])

    assert found("(c) 1998-2001 A\nJournal of 1990") == (None, "Journal of 1990", 2001, False)
    assert found("Conference X, 1987\nsee 10.1000/ab.c. and 1990") == ("10.1000/ab.c", "Conference X, 1987", 1987, False)
    assert found("in 1990 or 1991", ["Foot 1970", "A 1960 1961"]) == (None, "", 1970, False)
    assert found("in 1990 or 1991") == (None, "", None, False)
    assert found("in 1990 and 1990") == (None, "", 1990, False)
    assert found("none", None, 2020) == (None, "", 2020, True)
    assert found("J acm") == (None, "", None, False)


def test_titles_and_programs(spark):
    got = one(spark, *[T.is_plausible_title(F.lit(x)) for x in ("A Study of Things", "short", "My Untitled work", "thesis final.docx", "x" * 401, None)], *[T.is_software_name(F.lit(x)) for x in ("Microsoft  Word", "Writer", "pdfTeX", None)])
    assert tuple(got) == (True, False, False, False, False, False, True, False, True, False)


def test_research_chunks(spark):
    paragraphs = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(100)) for i in range(8)) + "\n\n* * *\n\n" + " ".join(["one two."] * 400)
    got = one(spark, segment.chunk_section(F.lit(paragraphs)))[0]
    assert all(c.word_count <= 480 and not c.is_cliffhanger and not c.has_prompt for c in got) and all(c.word_count >= 180 for c in got[:-1]) and sum(c.word_count for c in got) == 800 + 3 + 800


def test_spans_that_overlap_are_refused(spark):
    rows = [(1, 7, 1, 0, 10), (2, 7, 1, 5, 12), (3, 7, 1, 10, 12), (4, 7, 1, 11, 20), (5, 7, 2, 0, 10), (6, 8, 1, 0, 10), (7, 7, 1, 12, 13)]
    got = {r.highlight_id: r.accepted for r in notes.accepted(spark.createDataFrame(rows, "highlight_id long, user_id long, session_id long, start_at int, end_at int")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True}


def test_shelves_beside_those_there(spark):
    have = spark.createDataFrame([(1, "novels", 4), (1, "poems", 2)], "user_id int, name_key string, position int")
    wanted = spark.createDataFrame([(1, 1, "Novels"), (1, 2, "Plays"), (1, 3, "plays"), (1, 4, "Essays"), (2, 1, "Novels")], "user_id int, n int, name string")
    got = {(r.user_id, r.n): (r.status, r.position) for r in notes.created_shelves(wanted, 3, have).collect()}
    assert got == {(1, 1): ("taken", None), (1, 2): ("created", 5), (1, 3): ("full", None), (1, 4): ("full", None), (2, 1): ("created", 0)}
