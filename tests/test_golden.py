"""Known cases of single operators."""

from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import citations as C
from lectern.functions import text as T
from lectern.operators import events, layout, models, notes, reader, segment, tags
from lectern.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_kappa(spark):
    def kappa(a, b):
        rows = spark.createDataFrame([(0, x, y) for x, y in zip(a, b, strict=True)], "k int, a boolean, b boolean")
        found = tags.kappa(rows, ["k"], F.col("a"), F.col("b")).collect()
        return found[0].kappa if found else None

    assert kappa([True, False, True, False], [True, False, True, False]) == 1.0
    assert kappa([True, True, False, False], [False, False, True, True]) == -1.0
    assert kappa([False, False], [False, False]) is None
    assert kappa([True, True], [False, False]) == 0.0
    assert kappa([], []) is None


@pytest.mark.parametrize(("words", "ms", "wpm"), [(400, 120_000, 200.0), (400, 1000, None), (400, 10_800_000, None), (10, 60_000, None), (5000, 60_000, None)])
def test_wpm(spark, words, ms, wpm):
    assert one(spark, events.sample_wpm(F.lit(words), F.lit(ms))) == wpm


def test_pace_trend(spark):
    rows = [(100 - i, 1, 600 if i < 3 else 300, 120_000) for i in range(13)]
    got = events.pace(spark.createDataFrame(rows, "event_id long, user_id long, words int, active_ms int")).first()
    assert (got.wpm_recent, got.trend, got.n_samples) == (300.0, "faster", 13)


def test_pace_limits_before_it_filters(spark):
    rows = [(1000 + i, 1, 1, 1) for i in range(40)] + [(i, 1, 400, 120_000) for i in range(10)]
    got = events.pace(spark.createDataFrame(rows, "event_id long, user_id long, words int, active_ms int")).first()
    assert (got.n_samples, got.trend, got.is_estimate) == (0, "steady", True)


@pytest.mark.parametrize(("n", "level"), [(0, 1), (4, 1), (5, 2), (14, 2), (15, 3)])
def test_size_level(spark, n, level):
    assert one(spark, reader.size_level(F.lit(n))) == level


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 25), min_size=1, max_size=20, unique=True))
def test_streaks(spark, days):
    import datetime as dt

    base = dt.date(2024, 1, 1)
    got = events.streaks(spark.createDataFrame([(1, base + dt.timedelta(d)) for d in days], "user_id long, day date")).first()
    current = longest = 0
    last = None
    for d in sorted(days):
        current = current + 1 if last is not None and d == last + 1 else 1
        longest, last = max(longest, current), d
    assert (got.current_streak, got.longest_streak, got.last_day) == (current, longest, base + dt.timedelta(last))


def pack(paragraphs: list[str], least: int, most: int) -> list[tuple[str, int, bool]]:
    """The packing rule, one paragraph at a time."""
    out: list[list] = []
    current: list[str] = []

    def close(cliff: bool) -> None:
        if current:
            out.append(["\n\n".join(current), sum(len(p.split()) for p in current), cliff])
            current.clear()

    for i, p in enumerate(paragraphs):
        words = sum(len(x.split()) for x in current)
        if words >= least and words + len(p.split()) > most:
            close(False)
        current.append(p)
        words = sum(len(x.split()) for x in current)
        shift = p in ("***", "---")
        if words >= least and (shift or i == len(paragraphs) - 1):
            close(True)
        elif words >= 1.5 * most:
            close(False)
    close(True)
    if out:
        out[-1][2] = True
    return [tuple(x) for x in out]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.just("***"), st.integers(1, 60).map(lambda n: " ".join(f"w{i}" for i in range(n)))), max_size=25))
def test_packing(spark, paragraphs):
    ps = spark.createDataFrame([(paragraphs,)], "ps array<string>")
    got = [(p.text, p.word_count, p.is_cliffhanger) for p in ps.select(segment.pack(F.col("ps"), 40, 60).alias("x")).first().x]
    assert got == pack(paragraphs, 40, 60)


def test_chunking(spark):
    text = "\n\n".join(" ".join(f"w{j}" for j in range(150)) for _ in range(8))
    got = one(spark, segment.micro_sessions(F.lit(text)))
    assert all(400 <= p.word_count <= 750 for p in got[:-1]) and got[-1].is_cliffhanger
    assert "\n\n".join(p.text for p in got) == text and [p["index"] for p in got] == list(range(len(got)))


def test_scene_shift(spark):
    part = " ".join(["word"] * 450)
    got = one(spark, segment.micro_sessions(F.lit(f"{part}\n\n***\n\n{part}")))
    assert len(got) == 2 and got[0].is_cliffhanger and got[0].has_prompt


def test_oversized_paragraphs(spark):
    text = " ".join(f"Sentence {i} has five words." for i in range(40))
    got = one(spark, segment.split_oversized(F.lit(text), 60))
    assert " ".join(got) == text and all(len(x.split()) <= 60 for x in got)
    plain = " ".join(["w"] * 200)
    assert [len(x.split()) for x in one(spark, segment.split_oversized(F.lit(plain), 60))] == [60, 60, 60, 20]


def test_chapters(spark):
    body = " ".join(["prose"] * 400)
    book = "Title page\n" + "\n".join(f"CHAPTER {r}. Name {i}" for i, r in enumerate(("I", "II", "III"), 1)) + "\n" + "\n".join(f"CHAPTER {r}\n{body}" for r in ("I", "II", "III"))
    parts = f"LETTER 1\n{body}\nLETTER 2\n{body}"
    plain = "Just one text\nwithout headings"
    got = segment.chapters(spark.createDataFrame([(1, book), (2, parts), (3, plain)], "doc_id long, text string")).collect()
    rows = {i: [(r.title, len(r.text.split())) for r in sorted(got, key=lambda r: r.chapter_index) if r.doc_id == i] for i in (1, 2, 3)}
    assert rows[1] == [("Name 1", 400), ("Name 2", 400), ("Name 3", 400)]
    assert rows[2] == [("LETTER 1", 400), ("LETTER 2", 400)]
    assert rows[3] == [("", 5)]


def test_section_kinds(spark):
    long = " ".join(["prose"] * 300)
    titles = ["Preface", "Chapter 1", "Storms", "Appendix", ""]
    rows = [(1, i, t, long) for i, t in enumerate(titles)] + [(2, 0, "Contents", "short"), (3, 0, "", "\n".join(["a b"] * 10)), (3, 1, "", long)]
    got = {(r.doc_id, r.chapter_index): r.section_kind for r in segment.classify(spark.createDataFrame(rows, "doc_id long, chapter_index int, title string, text string")).collect()}
    assert [got[(1, i)] for i in range(5)] == ["front_matter", "story", "story", "back_matter", "story"]
    assert got[(2, 0)] == "story" and got[(3, 0)] == "front_matter" and got[(3, 1)] == "story"


def test_highlights_overlap(spark):
    rows = [(1, 1, 1, 0, 10), (2, 1, 1, 9, 20), (3, 1, 1, 20, 30), (4, 2, 1, 0, 10)]
    got = notes.overlaps(spark.createDataFrame(rows, "highlight_id long, user_id long, session_id long, start_at int, end_at int")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_quotes_count_code_points(spark):
    rows = spark.createDataFrame([(1, "\U0001f600 hello world", 2, 7), (2, "abc", 1, 9), (3, "a   b", 1, 3)], "highlight_id long, text string, start_at int, end_at int")
    got = {r.highlight_id: r for r in notes.quoted(rows).collect()}
    assert got[1].quote == "hello" and got[1].context_before == "\U0001f600 " and got[1].context_after == " world"
    assert got[2].error == "out_of_range" and got[3].error == "blank"


def test_replies(spark):
    bad = ["", "no", "[]", '{"themes": {}}', '{"themes": [{"theme": "romance", "score": true}]}', '{"themes": [{"theme": "romance", "score": 3.0}]}', '{"themes": [{"theme": "romance", "score": "3"}]}', '{"themes": [{"theme": "romance", "score": 0}]}', '{"themes": [{"theme": "x", "score": 3}]}', '{"themes": [{"theme": "romance", "score": 3}, {"theme": "romance", "score": 3}]}', '{"themes": [3]}']
    good = '```json\n{"themes": [{"theme": "romance", "score": 2}, {"theme": "war_conflict", "score": 5}, {"theme": "class_money", "score": 2}, {"theme": "nature_place", "score": 1}]}\n```'
    rows = spark.createDataFrame([(i, r) for i, r in enumerate([*bad, good, '{"themes": []}'])], "i int, r string")
    got = {r.i: r.x for r in rows.select("i", tags.parse_reply(F.col("r")).alias("x")).collect()}
    assert all(got[i] is None for i in range(len(bad))), got
    assert [(x.theme, x.score) for x in got[len(bad)]] == [("war_conflict", 5), ("romance", 2), ("class_money", 2)]
    assert got[len(bad) + 1] == []


@pytest.mark.parametrize(("token", "value"), [("IV", 4), ("xii", 12), ("MCMXLIV", 1944), ("IIX", 8), ("A", None), ("", None)])
def test_roman(spark, token, value):
    assert one(spark, T.roman(F.lit(token))) == value


def test_cleaning(spark):
    assert one(spark, T.clean(F.lit("a b\r\nc​\td  \n\n\n\ne"))) == "a b\nc d\n\ne"
    assert one(spark, T.tidy_spacing(F.lit("capable of that ? ( yes )"))) == "capable of that? (yes)"
    lines = F.array(*[F.lit(x) for x in ("a won-", "derful self-", "Evident day")])
    assert one(spark, T.join_wrapped(lines)) == "a wonderful self- Evident day"
    ps = F.array(*[F.lit(x) for x in ("Am I capable of", "that", "? Is", "that", "serious?", "New one.", "chapter 1", "then")])
    assert one(spark, T.merge_continuations(ps)) == ["Am I capable of that ? Is that serious?", "New one.", "chapter 1", "then"]
    marked = "x\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\nProduced by Me\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK A ***\ny"
    assert one(spark, T.strip_boilerplate(F.lit(marked))) == "body"
    assert one(spark, T.strip_boilerplate(F.lit("plain"))) == "plain"


def test_summary(spark):
    text = "First one. " + "Second is here! " * 3 + "x" * 300 + "."
    assert one(spark, T.summary(F.lit(text))) == "First one. Second is here! Second is here! Second is here!"
    assert one(spark, T.summary(F.lit("y" * 500))) == "y" * 240


def test_citations(spark):
    args = [F.lit("Twain, Mark (Samuel Clemens)"), F.lit("Tom Sawyer"), F.lit(1876), F.lit(74), F.lit(False), F.lit("CHAPTER IV"), F.lit(3)]
    assert one(spark, C.plain(C.book_citation("apa", *args)["reference"])) == "Twain, M. (1876). Tom Sawyer. Project Gutenberg. https://www.gutenberg.org/ebooks/74"
    assert one(spark, C.plain(C.book_citation("mla", *args)["in_text"])) == "(Twain, ch. 4)"
    assert one(spark, C.html(C.book_citation("chicago", *args)["in_text"])) == "Mark Twain, <i>Tom Sawyer</i> (1876; Project Gutenberg), chap. 4."
    unknown = [F.lit(None).cast("string"), F.lit("Odd: A Tale"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(True), F.lit(""), F.lit(0)]
    assert one(spark, C.plain(C.book_citation("apa", *unknown)["reference"])) == "Odd: A Tale. (n.d.). [Uploaded file]."
    assert one(spark, C.plain(C.book_citation("apa", *unknown)["in_text"])) == "(“Odd”, n.d., Opening section)"


def test_columns_and_order(spark):
    rows = [(1, 1, 0, "Title", 60.0, 540.0, 40.0, 50.0)]
    rows += [(1, 1, 1 + i, f"L{i}", 60.0 + i % 2, 290.0, 100.0 + 12 * i, 110.0 + 12 * i) for i in range(6)] + [(1, 1, 20 + i, f"R{i}", 320.0, 545.0, 100.0 + 12 * i, 110.0 + 12 * i) for i in range(6)]
    lines = spark.createDataFrame([(*r, 595.0, 842.0) for r in rows], "doc_id long, page int, line_no int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double")
    got = layout.reading_order(lines, layout.columns(lines)).orderBy("place").collect()
    assert [r.text for r in got] == ["Title", *[f"L{i}" for i in range(6)], *[f"R{i}" for i in range(6)]]


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<rootfile full-path="OEBPS/content.opf"/>')
        z.writestr("OEBPS/content.opf", '<item id="a" href="one.xhtml"/><item id="n" href="nav.xhtml"/><item id="b" href="two.xhtml"/><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/>')
        for name, word in (("one", "uno"), ("two", "dos"), ("nav", "nav")):
            z.writestr(f"OEBPS/{name}.xhtml", f"<html><script>x</script><h1>The <i>{word}</i></h1><p>{(word + ' ') * 40}</p><p>that <i>?</i></p></html>")
    (tmp_path / "book.epub").write_bytes(data.getvalue())
    (tmp_path / "fake.pdf").write_bytes(b"plain text")
    (tmp_path / "notes.txt").write_bytes("café text".encode("latin-1"))
    up = files.uploads(spark, str(tmp_path))
    assert {r.name: (r.format, r.error) for r in up.collect()} == {"book.epub": ("epub", None), "fake.pdf": (None, "extension_mismatch"), "notes.txt": ("txt", None)}
    got = files.epub_chapters(up).orderBy("place").collect()
    assert [(r.title, r.text.split()[0], r.text.endswith("that?")) for r in got] == [("The dos", "dos", True), ("The uno", "uno", True)]
    assert files.text_documents(up).first().text == "café text"
    assert {r.error for r in files.uploads(spark, str(tmp_path), cap=3).collect()} == {"too_large"}


def test_labels_and_tag_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("micro_session_id,book,text,theme_1,theme_2,theme_3\n1,b,t,romance, war_conflict,\n2,b,t,,,\n")
    assert {r.micro_session_id: r.themes for r in files.coder_labels(spark, str(tmp_path / "c.csv")).collect()} == {1: ["romance", "war_conflict"], 2: []}
    (tmp_path / "d.csv").write_text("micro_session_id,book,text,theme_1,theme_2,theme_3\n1,b,t,cooking,,\n")
    with pytest.raises(Exception, match="unknown theme"):
        files.coder_labels(spark, str(tmp_path / "d.csv")).collect()
    rows = spark.sql("select 7 gutenberg_id, 'T' title, 0 chapter, 1 session, 'ab' hash, 'm' model, '1' prompt_version, '1' theme_list_version, array(named_struct('theme','romance','score',4)) themes")
    (tmp_path / "tags.json").write_text(files.tag_file(rows).first().value)
    assert files.read_tag_file(spark, str(tmp_path / "tags.json")).collect() == rows.collect()


def test_models_retry(spark):
    def provider(text: str) -> str:
        if "bad" in text:
            raise TimeoutError("secret")
        return '{"themes": [{"theme": "romance", "score": 4}]}' if "love" in text else "?"

    rows = spark.createDataFrame([(1, "love"), (2, "bad"), (3, "other")], "id long, text string")
    got = {r.id: r.status for r in models.tag(rows, provider, lambda s: None).collect()}
    assert got == {1: "done", 2: "failed", 3: "failed"}
    assert {r.error for r in models.ask(rows, provider, lambda s: None).collect()} == {None, "TimeoutError"}


def test_normalising(spark):
    wrapped = "It was a long\nline that wraps won-\nderfully.\n\nCHAPTER 1\nThe next one\nbegins here.\n\n    An indented first line that is long enough to be prose\nand goes on at the margin.\n    Another paragraph that starts with an indent like this\nand goes on.\n\n- item one\n- item two\n- item three\n- item four"
    got = one(spark, T.normalize_paragraphs(F.lit(wrapped)))
    assert got.split("\n\n") == ["It was a long line that wraps wonderfully.", "CHAPTER 1", "The next one begins here.", "An indented first line that is long enough to be prose and goes on at the margin.", "Another paragraph that starts with an indent like this and goes on.", "- item one\n- item two\n- item three\n- item four"]
    assert one(spark, T.normalize_uploaded(F.lit("a  b , c"), "epub")) == "a b, c"


@pytest.mark.parametrize(("text", "want"), [("T HE Internet", "THE Internet"), ("T his paper", "This paper"), ("A MITRE map", "A MITRE map"), ("I NTRODUCTION", "INTRODUCTION"), ("T Hello", "T Hello"), ("vitamin C and", "vitamin C and"), ("A cat", "A cat")])
def test_split_capitals(spark, text, want):
    assert one(spark, T.repair_split_capitals(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("Jane Doe, Richard M. Roe and Ana de la Cruz", True), ("J. Smith", True), ("Methods", False), ("University of Somewhere", False), ("We propose a method for data", False), ("Honeypot and labeled according to Tactics.", False), ("", False)])
def test_bylines(spark, text, want):
    assert one(spark, T.is_byline(F.lit(text))) is want


@pytest.mark.parametrize(("text", "size", "want"), [("1. Introduction", 10.0, True), ("evaluation", 10.0, False), ("Evaluation", 10.0, True), ("2.1 Our way of doing it", 10.0, True), ("1. We then ran the test.", 10.0, False), ("A big title", 12.0, True), ("plain prose goes on", 10.0, False), ("RESULTS AND MORE", 10.0, True), ("12", 10.0, False), ("Figure 1. A plot", 14.0, False)])
def test_headings(spark, text, size, want):
    assert one(spark, layout.is_heading(F.lit(text), F.lit(size), F.lit(10.0))) is want


def test_research_sections(spark):
    rows = [
        (1, 1, 1, "text", True, 1, "A. Reader"), (1, 2, 1, "text", False, 1, "Some venue"), (1, 3, 1, "text", True, 1, "Abstract"), (1, 4, 1, "text", False, 1, "We looked at"), (1, 5, 1, "caption", False, 1, "Figure 1. X"),
        (1, 6, 1, "text", False, 1, "things."), (1, 7, 2, "text", True, 1, "1. Method"), (1, 8, 2, "equation", False, 1, "x=1"), (1, 9, 2, "equation", False, 1, "y=2"), (1, 10, 2, "text", False, 1, "Done."),
        (1, 11, 3, "text", True, 1, "References"), (1, 12, 3, "text", False, 1, "[1] A."), (1, 13, 3, "text", True, 1, "2. More"), (1, 14, 3, "text", False, 1, "tail"),
        (2, 1, 1, "text", False, 1, "only text"),
    ]
    got = layout.sections(spark.createDataFrame(rows, "doc_id long, block_no int, page int, kind string, heading boolean, n_lines int, text string")).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.title, r.kind, r.text) for r in got] == [(1, "Abstract", "abstract", "We looked at things."), (1, "1. Method", "body", "[equation omitted]\n\nDone."), (1, "References", "references", "[1] A."), (1, "2. More", "references", "tail"), (2, "", "body", "only text")]
    assert got[0].captions == ["Figure 1. X"]


def test_merged_lines_are_cut_at_a_blank_gutter(spark):
    def chars(text, x):
        return [(x + 5.0 * i, x + 5.0 * i + 5.0, c) for i, c in enumerate(text)]

    rows = [(1, 1, 0, "left right", 60.0, 345.0, 10.0, chars("left", 60.0) + chars("right", 320.0)), (1, 1, 1, "one whole line of text over all", 200.0, 360.0, 10.0, chars("one whole line of text over all", 200.0))]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, x0 double, x1 double, size double, chars array<struct<x0:double,x1:double,ch:string>>")
    cols = spark.createDataFrame([(1, 1, [(60.0, 320.0), (320.0, 550.0)])], "doc_id long, page int, cols array<struct<x0:double,x1:double>>")
    got = layout.split_merged(lines, cols).orderBy("line_no", "x0").collect()
    assert [(r.line_no, r.text) for r in got] == [(0, "left"), (0, "right"), (1, "one whole line of text over all")]


def test_segments(spark):
    full = "ab\U0001f600d efg\n\nsecond part"
    ps = one(spark, T.paragraph_starts(F.lit(full)))
    assert [(p.text, p.start) for p in ps] == [("ab\U0001f600d efg", 0), ("second part", 10)]
    spans = F.expr("array(named_struct('id', 1L, 'start', 2, 'end', 4, 'quote', '\U0001f600d'), named_struct('id', 2L, 'start', 3, 'end', 6, 'quote', 'd e'), named_struct('id', 3L, 'start', 0, 'end', 1, 'quote', 'x'), named_struct('id', 4L, 'start', 6, 'end', 13, 'quote', 'fg\n\nsec'))")
    first = one(spark, T.segments(F.lit(full), F.lit(0), F.lit(ps[0].text), spans))
    assert [(s.text, s.id) for s in first] == [("ab", None), ("\U0001f600d", 1), (" e", None), ("fg", 4)]
    second = one(spark, T.segments(F.lit(full), F.lit(10), F.lit(ps[1].text), spans))
    assert [(s.text, s.id) for s in second] == [("sec", 4), ("ond part", None)]


def test_seeded_games():
    from lectern.operators import breaks

    draw = breaks.mulberry32(42)
    assert [round(draw(), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]
    bag = breaks.rotation(["a", "b", "c", "d"], 12, 5)
    assert all(sorted(bag[i : i + 4]) == ["a", "b", "c", "d"] for i in (0, 4, 8)) and all(x != y for x, y in zip(bag, bag[1:], strict=False))


def test_word_ladder(spark):
    from lectern.operators import breaks

    words = spark.createDataFrame([(w,) for w in ("cat", "cot", "cog", "dog", "dot", "bird")], "word string")
    got = {r.word: r.steps for r in breaks.ladder(breaks.one_letter_pairs(words), "cat", 4).collect()}
    assert got == {"cat": 0, "cot": 1, "cog": 2, "dot": 2, "dog": 3}
