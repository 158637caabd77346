"""File sources and sinks: uploads, EPUB spines, coder labels, tag files, quoted CSV."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import dims
from lectern.functions import text as T

TAG_SCHEMA = (
    "format int, books array<struct<gutenberg_id:int,title:string,chunks:array<struct<chapter:int,session:int,hash:string,model:string,prompt_version:string,"
    "theme_list_version:string,themes:array<struct<theme:string,score:int>>>>>>"
)
#: Kinds and names of EPUB items that are not text.
SKIPPED_TYPES = ("cover", "toc", "titlepage", "copyright-page", "colophon", "imprint", "dedication", "acknowledgements", "frontmatter", "backmatter", "landmarks")
SKIPPED_HREF = r"(?i)(cover|nav\b|toc|contents|titlepage|title-page|halftitle|copyright|colophon|imprint|licen[cs]e|uncopyright|dedication|frontmatter|back-?matter)"


def skipped_item(href: Column, types: Column) -> Column:
    """Whether an EPUB item is navigation or about the book, by its kinds or its name; null is neither."""
    kinds = F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in SKIPPED_TYPES])), F.lit(False))
    return kinds | F.coalesce(href, F.lit("")).rlike(SKIPPED_HREF)


def uploads(spark: SparkSession, path: str, cap: int = 10 << 20) -> DataFrame:
    """(name, length, content, format, error): files over the cap lose their content before it is read on."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    small = F.col("length") <= cap
    rows = rows.select(T.safe_filename(name).alias("name"), name.alias("raw"), "length", F.when(small, F.col("content")).alias("content"))
    sniffed = rows.withColumn("s", T.sniff(F.col("raw"), F.col("content")))
    return sniffed.select("name", "length", "content", F.when(F.col("content").isNull(), None).otherwise(F.col("s.format")).alias("format"), F.when(F.col("content").isNull(), "too_large").otherwise(F.col("s.error")).alias("error"))


def text_documents(files: DataFrame) -> DataFrame:
    """(name, text, error) of text files: decoded, boilerplate off; what does not look like text is an error."""
    rows = files.filter("format = 'txt'").withColumn("decoded", T.decode_text(F.col("content")))
    return rows.select("name", T.strip_boilerplate(T.clean(F.col("decoded"))).alias("text"), F.when(F.col("decoded").isNull(), "garbled_text").alias("error"))


def epub_items(files: DataFrame) -> DataFrame:
    """(name, place, href, html): the spine's documents of EPUB files in order; navigation and covers left out.

    Only the archive is opened in Python; blocks and titles follow from ``html`` as columns.
    """

    def spine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        root = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode("utf-8", "replace"))[1]
                        package = z.read(root).decode("utf-8", "replace")
                        base = root.rpartition("/")[0]
                        items = {m["id"]: m["href"] for m in ({k: v for k, v in re.findall(r'(\w[\w-]*)="([^"]*)"', tag)} for tag in re.findall(r"<item\b[^>]*>", package)) if "id" in m and "href" in m}
                        for place, ref in enumerate(re.findall(r'<itemref\b[^>]*idref="([^"]+)"', package)):
                            href = items.get(ref, "")
                            rows.append((name, place, href, z.read(f"{base}/{href}" if base else href).decode("utf-8", "replace")))
                except (zipfile.BadZipFile, KeyError, TypeError):
                    rows.append((name, -1, "", None))
            yield pd.DataFrame(rows, columns=["name", "place", "href", "html"])

    items = files.filter("format = 'epub'").select("name", "content").mapInPandas(spine, "name string, place int, href string, html string")
    types = F.split(F.lower(F.array_join(F.regexp_extract_all("html", F.lit(r'epub:type="([^"]*)"'), 1), " ")), " ")
    return items.filter(F.col("html").isNull() | ~skipped_item(F.col("href"), types))


def epub_chapters(files: DataFrame, least_words: int = 30) -> DataFrame:
    """(name, place, title, text) of EPUB files: first heading, then the texts of paragraphs, quotes and items."""
    title = T.strip(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?is)<h[123]\b[^>]*>(.*?)</h[123]\s*>", 1), r"(?s)<[^>]*>", " "), r"\s+", " "))
    rows = epub_items(files).filter("html is not null").select("name", "place", F.substring(title, 1, 300).alias("title"), F.array_join(T.html_blocks(F.col("html")), "\n\n").alias("text"))
    return rows.filter(T.word_count(F.col("text")) >= least_words)


def coder_labels(spark: SparkSession, path: str) -> DataFrame:
    """(micro_session_id, themes) of a coder's CSV; an unknown theme or a repeated id stops the query."""
    rows = spark.read.option("header", True).schema("micro_session_id long, book string, text string, theme_1 string, theme_2 string, theme_3 string").csv(path)
    named = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(f"theme_{i}"), F.lit("")) for i in (1, 2, 3)])))
    known = F.forall(named, lambda t: t.isin(*dims.THEMES))
    sets = rows.select("micro_session_id", named.alias("themes"), F.assert_true(known, "unknown theme").alias("_ok"))
    once = sets.groupBy("micro_session_id").agg(F.first("themes").alias("themes"), F.count("*").alias("n"), F.first("_ok").alias("_ok"))
    checked = F.assert_true(F.col("n") == 1, "a passage is labelled twice")
    return once.select("micro_session_id", F.when(checked.isNull() & F.col("_ok").isNull(), F.col("themes")).alias("themes"))


def tag_file(tags: DataFrame) -> DataFrame:
    """One row (value): the tag file's JSON of rows (gutenberg_id, title, chapter, session, hash, model, versions, themes)."""
    chunk = F.struct("chapter", "session", "hash", "model", "prompt_version", "theme_list_version", "themes")
    books = tags.groupBy("gutenberg_id", "title").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    whole = books.agg(F.sort_array(F.collect_list(F.struct("gutenberg_id", "title", "chunks"))).alias("books"))
    return whole.select(F.to_json(F.struct(F.lit(1).alias("format"), "books")).alias("value"))


def read_tag_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tag file, one for each chunk."""
    whole = spark.read.schema(TAG_SCHEMA).option("multiLine", True).json(path).filter("format = 1")
    books = whole.select(F.explode("books").alias("b"))
    return books.select("b.gutenberg_id", "b.title", F.inline("b.chunks"))


def write_quoted_csv(rows: DataFrame, path: str) -> None:
    """All cells quoted, formulas made harmless, CRLF line ends, a header in each file."""
    cells = F.concat_ws(",", *[T.csv_cell(F.col(c)) for c in rows.columns])
    rows.select(cells.alias("value")).write.option("lineSep", "\r\n").text(path)


def documents(files: DataFrame) -> DataFrame:
    """(name, format, text, chapters, error) of uploads of every format: chapters (place, title, text) from EPUB files, else null."""
    from lectern.sources import pdf

    plain = text_documents(files).select("name", F.lit("txt").alias("format"), "text", "error")
    printed = pdf.text_documents(files.filter("format = 'pdf'")).select("name", F.lit("pdf").alias("format"), "text", "error")
    parts = epub_chapters(files).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "title", "text"))).alias("chapters"))
    books = files.filter("format = 'epub'").select("name").join(parts, "name", "left")
    whole = T.normalize_uploaded(F.array_join(F.transform("chapters", lambda c: c["text"]), "\n\n"), "epub")
    books = books.select("name", F.lit("epub").alias("format"), whole.alias("text"), F.when(F.col("chapters").isNull(), "epub_unreadable").alias("error"), "chapters")
    refused = files.filter("error is not null").select("name", "format", F.lit(None).cast("string").alias("text"), "error")
    return plain.unionByName(printed).unionByName(refused).unionByName(books, allowMissingColumns=True)
