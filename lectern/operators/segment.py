"""Segmentation: paragraphs to passages, texts to sections and chapters. Folds carry index ranges, texts are cut once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T

#: Scene shifts, and ends that hold tension.
SCENE_SHIFT = r"\n\s*(\*\s*\*\s*\*|-{3,}|_{3,})\s*\n"
TENSION_END = r"""[?!]["'”’)\]]*\s*$|(—|--|\.\.\.|…)["”]?\s*$"""
#: Words that name front and back matter.
FRONT = (
    "contents", "table of contents", "preface", "introduction", "foreword", "dedication", "copyright", "license", "licence", "transcriber", "illustrations",
    "list of illustrations", "title page", "titlepage", "half-title", "frontispiece", "acknowledg", "editor's note", "editors note", "translator", "a note on", "note on the text", "imprint", "cover",
)
BACK = ("appendix", "appendices", "colophon", "uncopyright", "index", "glossary", "bibliography", "afterword", "about the author", "endnotes", "footnotes", "notes", "errata", "advertisement", "transcriber")
REAL_CHAPTER = r"(?i)^\s*(chapter|part|book|canto|stave|act)\b\s*[ivxlcdm\d]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def pack(paragraphs: Column, least: int, most: int) -> Column:
    """array<struct<text, word_count, is_cliffhanger, index>>: paragraphs packed greedily into passages.

    A passage ends before a paragraph that would take it over ``most`` words if it has ``least``; after a scene shift
    or the last paragraph if it has ``least``; and at one and a half times ``most`` in any case. Passages that end at a
    scene shift, and the last one, are cliffhangers.
    """
    items = F.transform(paragraphs, lambda p, i: F.struct(T.word_count(p).alias("w"), F.concat(F.lit("\n"), p, F.lit("\n")).rlike(SCENE_SHIFT).alias("shift"), i.alias("i")))
    none = F.expr("cast(array() as array<struct<upto:int,words:int,cliff:boolean>>)")
    zero = F.struct(F.lit(0).alias("words"), none.alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        over = (s["words"] + x["w"] > most) & (s["words"] >= least)
        cuts = F.when(over, F.concat(s["cuts"], F.array(F.struct(x["i"].alias("upto"), s["words"].alias("words"), F.lit(False).alias("cliff"))))).otherwise(s["cuts"])
        words = F.when(over, x["w"]).otherwise(s["words"] + x["w"])
        return F.struct(words.alias("words"), cuts.alias("cuts"), x.alias("x"))

    def closed(s: Column) -> Column:
        shift = s["x"]["shift"] & (s["words"] >= least)
        ends = shift | (s["words"] >= F.lit(most * 1.5))
        cut = F.array(F.struct((s["x"]["i"] + 1).alias("upto"), s["words"].alias("words"), shift.alias("cliff")))
        return F.struct(F.when(ends, 0).otherwise(s["words"]).alias("words"), F.when(ends, F.concat(s["cuts"], cut)).otherwise(s["cuts"]).alias("cuts"))

    folded = F.aggregate(items, zero, lambda s, x: _let(step(s, x), closed))
    whole = lambda s: F.when(s["words"] > 0, F.concat(s["cuts"], F.array(F.struct(F.size(paragraphs).alias("upto"), s["words"].alias("words"), F.lit(True).alias("cliff"))))).otherwise(s["cuts"])

    def pieces(cuts: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(cuts, i - 1)["upto"], F.lit(0))
        return F.transform(
            cuts,
            lambda c, i: F.struct(
                F.array_join(F.slice(paragraphs, begin(i) + 1, c["upto"] - begin(i)), "\n\n").alias("text"), c["words"].alias("word_count"), (c["cliff"] | (i == F.size(cuts) - 1)).alias("is_cliffhanger"), i.alias("index")
            ),
        )

    return _let(_let(folded, whole), pieces)


def with_prompts(passages: Column, every: int = 3, skip_edges: bool = False) -> Column:
    """Passages with has_prompt: at cliffhangers and every ``every``-th, or with ``skip_edges`` only every n-th inside."""
    last = F.size(passages) - 1
    inside = lambda i: (i > 0) & (i < last) & (i % every == 0)
    flag = lambda p, i: inside(i) if skip_edges else p["is_cliffhanger"] | ((i > 0) & (i % every == 0))
    return F.transform(passages, lambda p, i: p.withField("has_prompt", flag(p, i)))


def conservative(passages: Column) -> Column:
    """Cliffhangers only where the text itself ends on a hook, and at the end."""
    return F.transform(passages, lambda p, i: p.withField("is_cliffhanger", (i == F.size(passages) - 1) | p["text"].rlike(TENSION_END)))


def fixed_sections(paragraphs: Column, limit: int) -> Column:
    """array<struct<text, word_count>>: a section ends before the paragraph that would take it over the limit."""
    items = F.transform(paragraphs, lambda p, i: F.struct(T.word_count(p).alias("w"), i.alias("i")))
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<upto:int,words:int>>)").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        over = (s["n"] > 0) & (s["words"] + x["w"] > limit)
        cut = F.array(F.struct(x["i"].alias("upto"), s["words"].alias("words")))
        return F.struct(F.when(over, x["w"]).otherwise(s["words"] + x["w"]).alias("words"), F.when(over, 1).otherwise(s["n"] + 1).alias("n"), F.when(over, F.concat(s["cuts"], cut)).otherwise(s["cuts"]).alias("cuts"))

    done = lambda s: F.when(s["n"] > 0, F.concat(s["cuts"], F.array(F.struct(F.size(paragraphs).alias("upto"), s["words"].alias("words"))))).otherwise(s["cuts"])

    def pieces(cuts: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(cuts, i - 1)["upto"], F.lit(0))
        return F.transform(cuts, lambda c, i: F.struct(F.array_join(F.slice(paragraphs, begin(i) + 1, c["upto"] - begin(i)), "\n\n").alias("text"), c["words"].alias("word_count")))

    return _let(_let(F.aggregate(items, zero, step), done), pieces)


def split_oversized(paragraph: Column, most: int) -> Column:
    """array<string>: a paragraph over one and a half times ``most`` words, cut at sentences, or else every ``most`` words."""
    packed = F.transform(fixed_sections(T.sentences(paragraph), most), lambda s: F.replace(s["text"], F.lit("\n\n"), F.lit(" ")))

    def hard(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(w, i * most + 1, most), " "))

    cut = _let(packed, lambda p: F.when((F.size(p) == 1) & (T.word_count(p[0]) > F.lit(most * 1.5)), hard(T.tokens(p[0]))).otherwise(p))
    return F.when(T.word_count(paragraph) <= F.lit(most * 1.5), F.array(paragraph)).otherwise(cut)


def micro_sessions(chapter_text: Column, least: int = 400, most: int = 600) -> Column:
    """Passages of a chapter: paragraphs, oversized ones split, packed, with prompts."""
    ps = F.flatten(F.transform(T.paragraphs(chapter_text), lambda p: split_oversized(p, most)))
    return _let(_let(ps, lambda p: pack(p, least, most)), lambda p: with_prompts(p))


def chunk_section(section_text: Column, least: int = 180, most: int = 320) -> Column:
    """Chunks of a research section: passages of its paragraphs without cliffhangers or prompts."""
    plain = F.transform(T.paragraphs(section_text), lambda p: split_oversized(p, most))
    packed = _let(F.flatten(plain), lambda p: pack(p, least, most))
    return F.transform(packed, lambda p: p.withField("is_cliffhanger", F.lit(False)).withField("has_prompt", F.lit(False)))


def headings(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line, …) that are headings, once for each style they fit, with style, number and title."""
    fits = [
        F.when(F.col("line").rlike(pattern), F.struct(F.lit(i).alias("style"), T.heading_number(F.regexp_extract("line", pattern, number)).alias("number"), T.strip(F.regexp_extract("line", pattern, title)).alias("title")))
        for i, (pattern, number, title, _) in enumerate(T.HEADINGS)
    ]
    return lines.select("*", F.inline(F.array_compact(F.array(*fits))))


def plausible(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys whose heading numbers start at 1 and mostly go up by one, at least three of them."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    steps = found.filter("number is not null").withColumns({"next": F.lead("number").over(w), "rn": F.row_number().over(w)})
    good = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("next") == F.col("number") + 1).alias("up"), F.max(F.when(F.col("rn") == 1, F.col("number"))).alias("first"))
    return good.filter("n >= 3 and first = 1 and up >= n * 0.6").select(*keys)


def real_start(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), gap_words: int = 300) -> DataFrame:
    """``found`` with start_line: the last heading numbered 1 whose predecessors stand dense, as a table of contents does.

    ``found`` has words_before and words_upto, the running words of the document around the heading's line.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    gaps = found.withColumns({"gap": F.col("words_before") - F.lag("words_upto").over(w), "rn": F.row_number().over(w) - 1})
    dense = gaps.withColumn("widest", F.max("gap").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    restart = (F.col("rn") == 0) | ((F.col("number") == 1) & ((F.col("rn") < 2) | (F.col("widest") < gap_words)))
    return dense.withColumn("start_line", F.max(F.when(restart, F.col("line_no"))).over(Window.partitionBy(*keys))).drop("gap", "rn", "widest")


def chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, chapter_index, title, text): the first heading style that yields more than one chapter, else one heading of a short text, else whole.

    One pass over the lines finds headings of every style, with the running words around them; which style holds is
    judged from the headings alone; a second pass puts lines under the last heading before them. Long texts without
    headings are cut at 3,000 words. A lead-in of over 50 words becomes an untitled first chapter.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    counted = lines.withColumn("w", T.word_count(F.col("line"))).withColumns({"words_upto": F.sum("w").over(w), "total": F.sum("w").over(Window.partitionBy("doc_id"))})
    found = headings(counted.withColumn("words_before", F.col("words_upto") - F.col("w")))
    loose = F.col("style").isin(*[i for i, h in enumerate(T.HEADINGS) if h[3]])
    keys = ("doc_id", "style")
    trusted = found.filter(~loose).unionByName(found.filter(loose).join(plausible(found.filter(loose), keys), list(keys), "left_semi"))
    kept = real_start(trusted, keys).withColumn("toc", F.col("line_no") < F.col("start_line"))
    sized = kept.groupBy(*keys).agg(F.count_if(~F.col("toc")).alias("n"), F.max("total").alias("total"))
    best = sized.filter((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("total") < 15_000))).groupBy("doc_id").agg(F.min("style").alias("style"))
    marks = kept.join(best, list(keys)).select("doc_id", "line_no", "line", "number", "title", "toc")
    listed = marks.filter("toc and title <> '' and number is not null").groupBy("doc_id", "number").agg(F.max_by("title", "line_no").alias("listed"))
    own = marks.join(listed, ["doc_id", "number"], "left").withColumn("head", F.when(~F.col("toc"), F.coalesce(F.nullif("title", F.lit("")), "listed", T.strip(F.col("line")))))
    #: for each document: its chapters' first lines and titles, and where the first mark stands
    plan = own.groupBy("doc_id").agg(F.min("line_no").alias("first_mark"), F.sort_array(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("line_no", "head")))).alias("starts"))
    cut = docs.select("doc_id", F.split("text", "\n").alias("ls")).join(plan, "doc_id", "left")
    piece = lambda a, b: T.strip(F.array_join(F.slice("ls", a + 1, F.greatest(b - a, F.lit(0))), "\n"))
    upto = lambda i: F.coalesce(F.get("starts", i + 1)["line_no"], F.size("ls"))
    bodies = F.transform("starts", lambda s, i: F.struct(s["head"].alias("title"), piece(s["line_no"] + 1, upto(i)).alias("text")))
    lead_in = F.struct(F.lit("").alias("title"), piece(F.lit(0), F.col("first_mark")).alias("text"))
    whole = T.strip(F.array_join("ls", "\n"))
    fixed = F.when(T.word_count(whole) >= 15_000, F.transform(fixed_sections(T.paragraphs(whole), 3000), lambda s: F.struct(F.lit("").alias("title"), s["text"].alias("text")))).otherwise(F.array(F.struct(F.lit("").alias("title"), whole.alias("text"))))
    made = F.when(F.col("starts").isNull(), fixed).when(T.word_count(lead_in["text"]) > 50, F.concat(F.array(lead_in), bodies)).otherwise(bodies)
    return cut.select("doc_id", F.posexplode(made).alias("chapter_index", "c")).select("doc_id", "chapter_index", "c.title", "c.text")


def classify(sections: DataFrame) -> DataFrame:
    """(…, section_kind): story, front_matter or back_matter of sections (doc_id, chapter_index, title, text).

    Position against the real chapters comes before keywords; a document is never all front and back matter.
    """
    first_line = F.get(T.lines(F.coalesce("text", F.lit(""))), F.lit(0))
    title = F.coalesce(F.nullif(T.strip(F.coalesce("title", F.lit(""))), F.lit("")), F.when(F.length(first_line) <= 80, first_line), F.lit(""))
    doc = Window.partitionBy("doc_id")
    rows = sections.withColumn("_t", F.lower(title)).withColumn("_real", F.when(title.rlike(REAL_CHAPTER), F.col("chapter_index")))
    rows = rows.withColumns({"_first": F.min("_real").over(doc), "_last": F.max("_real").over(doc), "_w": T.word_count(F.coalesce("text", F.lit("")))})
    has = lambda words: F.exists(F.array(*[F.lit(k) for k in words]), lambda k: F.contains(F.col("_t"), k))
    i, front, back, short = F.col("chapter_index"), has(FRONT), has(BACK), F.col("_w") < 150
    kind = (
        F.when(F.col("_first").isNotNull() & (i < F.col("_first")), "front_matter")
        .when(front & (F.col("_first").isNull() | (i <= F.col("_first"))), "front_matter")
        .when(F.col("_last").isNotNull() & (i > F.col("_last")) & back, "back_matter")
        .when(back & short, "back_matter")
        .when(front & short, "front_matter")
        .when(T.is_listing(F.coalesce("text", F.lit("")), 6, 6.0) & (F.col("_w") < 600), F.when(F.col("_last").isNull() | (i < F.col("_last")), "front_matter").otherwise("back_matter"))
        .otherwise("story")
    )
    judged = rows.withColumn("_kind", kind).withColumn("_any", F.bool_or(F.col("_kind") == "story").over(doc))
    return judged.select(*sections.columns, F.when(F.col("_any"), F.col("_kind")).otherwise("story").alias("section_kind"))


def book_content(books: DataFrame, least: int = 400, most: int = 600, every: int = 3) -> tuple[DataFrame, DataFrame]:
    """What is stored of books (doc_id, text): chapters, and the passages of story chapters.

    Chapters: doc_id, chapter_index, title (500 characters), text, word_count, summary (of story chapters), section_kind.
    Passages: doc_id, chapter_index, index, text, word_count, is_cliffhanger (only at a hook or the end), has_prompt (every
    n-th inside a chapter). Front and back matter is kept and has no passages.
    """
    kinds = classify(chapters(books))
    story = F.col("section_kind") == "story"
    kept = kinds.select("doc_id", "chapter_index", F.substring(F.coalesce("title", F.lit("")), 1, 500).alias("title"), "text", T.word_count(F.col("text")).alias("word_count"), F.when(story, T.summary(F.col("text"))).otherwise("").alias("summary"), "section_kind")
    ps = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: split_oversized(p, most)))
    packed = _let(ps, lambda p: with_prompts(conservative(pack(p, least, most)), every, skip_edges=True))
    passages = kept.filter(story).select("doc_id", "chapter_index", F.inline(packed))
    return kept, passages.select("doc_id", "chapter_index", "index", "text", "word_count", "is_cliffhanger", "has_prompt")


def reconverted(books: DataFrame, stored: dict[str, DataFrame], least_words: int = 50) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Books (doc_id, text) normalised and cut anew: (doc_id, status) and the tables that hold their rows afterwards.

    ``stored`` has chapters and passages, and any other tables with doc_id (events, sessions, progress), whose rows of
    these books go because they point at old passages. Books without text, or with under ``least_words`` words once
    normalised, are skipped and keep their rows.
    """
    fresh = books.select("doc_id", T.normalize_uploaded(F.coalesce("text", F.lit(""))).alias("text"), (T.strip(F.coalesce("text", F.lit(""))) == "").alias("none"))
    judged = fresh.withColumn("status", F.when(F.col("none"), "skipped_no_text").when(T.word_count(F.col("text")) < least_words, "skipped_too_short").otherwise("ready"))
    ready = judged.filter("status = 'ready'").select("doc_id", "text")
    new = dict(zip(("chapters", "passages"), book_content(ready), strict=True))
    after = {name: rows.join(ready.select("doc_id"), "doc_id", "left_anti") for name, rows in stored.items()}
    for name, rows in new.items():
        after[name] = after[name].unionByName(rows, allowMissingColumns=True) if name in after else rows
    return judged.select("doc_id", "status"), after
