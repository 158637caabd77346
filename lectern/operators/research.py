"""Research documents from positioned lines: metadata in order of trust, sections, warnings, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import layout, segment

#: Entries that make an outline worth following; where the title block ends on a page without an abstract.
MIN_ENTRIES, TITLE_BLOCK = 3, 0.45
FIELDS = ("title", "authors", "year", "venue", "doi")


def title_block(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, largest, byline, front): from each first page, the largest type in its top half, the line of names
    between title and abstract, and all its lines from the top.

    ``titles`` (doc_id, embedded) holds a title from elsewhere, or null: lines that share a longer word with the title
    are no byline.
    """
    first = lines.filter("page = 1")
    doc = Window.partitionBy("doc_id")
    half = (F.col("top") < F.col("page_height") * 0.5) & (F.col("size") > 0) & F.col("text").rlike("[A-Za-z]{2,}")
    sized = first.withColumn("biggest", F.max(F.when(half, F.col("size"))).over(doc))
    item = F.struct("top", "x0", "line_no", "text")
    big = F.array_sort(F.collect_list(F.when(half & (F.col("size") >= F.col("biggest") - 0.3), item)))
    ends = F.min(F.when(F.col("text").rlike(r"(?i)^\s*(abstract|keywords?|index terms)\b"), F.col("top")))
    pages = sized.groupBy("doc_id").agg(big.alias("big"), F.array_sort(F.collect_list(item)).alias("all"), F.coalesce(ends, F.max("page_height") * TITLE_BLOCK).alias("ends"))
    joined = T.strip(T.join_wrapped(F.transform("big", lambda x: x["text"])))
    known = pages.join(titles, "doc_id", "left").withColumn("largest", F.when(T.is_plausible_title(joined), joined).otherwise(""))
    title = F.coalesce(F.nullif("embedded", F.lit("")), F.col("largest"))
    own = F.filter(T.tokens(F.lower(title)), lambda w: F.length(w) > 3)
    bare = F.transform(F.filter("all", lambda x: x["top"] < F.col("ends")), lambda x: T.repair_split_capitals(T.strip(x["text"])))
    names = F.filter(bare, lambda x: (x != "") & ~F.arrays_overlap(T.tokens(F.lower(x)), own) & T.is_byline(x))
    return known.select("doc_id", "largest", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("byline"), F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("front"))


def described(lines: DataFrame, information: DataFrame) -> DataFrame:
    """(doc_id, title, authors, year, venue, doi, unverified) of documents; empty or null is not found, never a guess.

    ``information`` (doc_id, title, author, created_year) is what the files say of themselves.
    """
    said = information.select("doc_id", F.when(T.is_plausible_title(F.col("title")), F.col("title")).alias("embedded"), F.when(T.is_byline(F.col("author")) & ~T.is_software_name(F.col("author")), T.strip(F.col("author"))).alias("signed"), "created_year")
    met = title_block(lines, said.select("doc_id", "embedded")).join(said, "doc_id", "left")
    found = met.withColumn("m", layout.metadata(F.col("front"), created=F.col("created_year")))
    return found.select("doc_id", F.coalesce("embedded", "largest").alias("title"), F.coalesce("signed", "byline").alias("authors"), "m.year", "m.venue", F.coalesce("m.doi", F.lit("")).alias("doi"), "m.unverified")


def outline_sections(blocks: DataFrame, outlines: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, text, kind) cut at the pages that an outline of MIN_ENTRIES or more points to."""
    w = Window.partitionBy("doc_id").orderBy("start_page", "title")
    numbered = outlines.withColumns({"section_no": F.row_number().over(w), "entries": F.count("*").over(Window.partitionBy("doc_id"))}).filter(F.col("entries") >= MIN_ENTRIES)
    ends = numbered.withColumn("end_page", F.lead("start_page").over(w))
    b, o = blocks.alias("b"), ends.alias("o")
    inside = (F.col("b.doc_id") == F.col("o.doc_id")) & (F.col("b.page") >= F.col("o.start_page")) & (F.col("o.end_page").isNull() | (F.col("b.page") < F.col("o.end_page")))
    own = b.join(o, inside).filter((F.col("b.kind") == "text") & ~(F.col("b.heading") & (T.strip(F.col("b.text")) == F.col("o.title"))))
    texts = own.groupBy("o.doc_id", "o.section_no", "o.title").agg(F.transform(F.array_sort(F.collect_list(F.struct("b.block_no", "b.text"))), lambda x: x["text"]).alias("ps"))
    made = texts.select("doc_id", "section_no", "title", F.array_join(T.merge_continuations(F.col("ps")), "\n\n").alias("text")).filter(T.strip(F.col("text")) != "")
    return layout.kinds_in_order(made, F.col("title"), ["doc_id"], "section_no")


def documents(lines: DataFrame, information: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, doc_kind, pages, metadata, warnings) and their sections (doc_id, section_no, title, kind, text).

    A document with an outline of MIN_ENTRIES or more is a textbook, cut by it; others are papers, cut at headings.
    Warnings say what was left out or not found. Tables are as of the PDF source: positioned lines by doc_id.
    """
    cols = layout.columns(lines)
    blocks = layout.blocks(layout.reading_order(layout.without_furniture(lines), cols))
    by_heading = layout.sections(blocks)
    entries = outlines.groupBy("doc_id").agg(F.count("*").alias("entries"))
    by_outline = outline_sections(blocks, outlines)
    followed = by_outline.select("doc_id").distinct().withColumn("followed", F.lit(True))
    keep = ["doc_id", "section_no", "title", "kind", "text"]
    sections = by_heading.join(followed, "doc_id", "left_anti").select(*keep).unionByName(by_outline.select(*keep))
    of = lambda kind: F.sum(F.when((F.col("kind") == kind) & ~F.col("heading"), F.col("n_lines")).otherwise(0))
    counts = blocks.groupBy("doc_id").agg(of("equation").alias("equations"), of("table_row").alias("rows"), F.count_if((F.col("kind") == "caption") & ~F.col("heading")).alias("captions"))
    pages = cols.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.size("cols") > 1).alias("multi"))
    listed = sections.groupBy("doc_id").agg(F.bool_or(F.col("kind") == "references").alias("listed"))
    rows = pages.join(counts, "doc_id", "left").join(entries, "doc_id", "left").join(followed, "doc_id", "left").join(listed, "doc_id", "left").join(described(lines, information), "doc_id", "left")
    if_any = lambda n, *parts: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.concat(*[F.lit(p) if not isinstance(p, tuple) else F.col(p[0]).cast("string") for p in parts]))
    blank = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) == "" for f in FIELDS}
    warnings = [
        if_any("multi", ("multi",), " of ", ("pages",), " pages are multi-column; columns were read down, not across."),
        if_any("equations", ("equations",), " equation-like lines were marked [equation omitted] rather than read as prose."),
        if_any("rows", ("rows",), " table rows were marked [table omitted]; tables are not reconstructed."),
        if_any("captions", ("captions",), " figure or table captions were kept aside."),
        F.when(F.col("followed"), F.concat(F.lit("Chapters came from the PDF outline ("), F.col("entries").cast("string"), F.lit(" bookmarks)."))),
        F.when(~F.coalesce("listed", F.lit(False)), F.lit("No reference list was found, so none could be set aside.")),
        *[F.when(empty, F.lit(f"Metadata field '{f}' could not be read; left blank.")) for f, empty in blank.items()],
    ]
    kind = F.when(F.coalesce("entries", F.lit(0)) >= MIN_ENTRIES, "textbook").otherwise("paper")
    return rows.select("doc_id", kind.alias("doc_kind"), "pages", *FIELDS, "unverified", F.array_compact(F.array(*warnings)).alias("warnings")), sections


def chunks(sections: DataFrame) -> DataFrame:
    """(doc_id, section_no, index, word_count, text): the chunks of the sections that are read."""
    read = sections.filter(F.col("kind").isin(*layout.READABLE))
    return read.select("doc_id", "section_no", F.inline(segment.chunk_section(F.col("text")))).select("doc_id", "section_no", "index", "word_count", "text")
