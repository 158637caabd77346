"""Reading order and reader state: positions, running words, blocks, prefixes, recaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims

ORDER = ["chapter_index", "session_index"]


def story(sessions: DataFrame) -> DataFrame:
    """Passages of story chapters only."""
    return sessions.filter(F.col("section_kind") == "story")


def numbered(sessions: DataFrame) -> DataFrame:
    """Story passages with session_no (from 1), words_before, total_words and progress in percent, by book."""
    w = Window.partitionBy("book_id").orderBy(*ORDER)
    before = F.coalesce(F.sum("word_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("word_count").over(Window.partitionBy("book_id"))
    rows = story(sessions).withColumns({"session_no": F.row_number().over(w), "words_before": before, "total_words": total})
    return rows.withColumn("progress_pct", F.when(F.col("total_words") > 0, F.round((100 * F.col("words_before") / F.col("total_words")).cast("decimal(20,6)"), 2).cast("double")).otherwise(0.0))


def blocks(sessions: DataFrame, size: int) -> DataFrame:
    """For every start: the block of up to ``size`` passages that ends at a cliffhanger or the chapter's end, and what follows.

    Columns: n_merged, block_words, has_prompt (any), is_cliffhanger (the last's), next_session.
    """
    w = Window.partitionBy("book_id").orderBy(*ORDER)
    rows = numbered(sessions)
    ahead = [F.lead(F.struct("chapter_index", "is_cliffhanger", "word_count", "has_prompt", "session_id"), i).over(w).alias(f"a{i}") for i in range(1, size + 1)]
    rows = rows.select("*", F.struct("chapter_index", "is_cliffhanger", "word_count", "has_prompt", "session_id").alias("a0"), *ahead)
    goes_on: Column = F.lit(True)
    n: Column = F.lit(1)
    for i in range(1, size):
        goes_on = goes_on & ~F.col(f"a{i - 1}.is_cliffhanger") & F.col(f"a{i}").isNotNull() & (F.col(f"a{i}.chapter_index") == F.col("a0.chapter_index"))
        n = n + F.coalesce(goes_on, F.lit(False)).cast("int")
    rows = rows.withColumn("n_merged", n).withColumn("block", F.slice(F.array(*[f"a{i}" for i in range(size)]), 1, F.col("n_merged")))
    following = F.element_at(F.array(*[f"a{i}" for i in range(1, size + 1)]), F.col("n_merged"))
    return rows.select(
        "book_id", "session_id", "session_no", "n_merged",
        F.aggregate("block", F.lit(0), lambda a, x: a + x["word_count"]).alias("block_words"),
        F.exists("block", lambda x: x["has_prompt"]).alias("has_prompt"),
        F.element_at("block", -1)["is_cliffhanger"].alias("is_cliffhanger"),
        following["session_id"].alias("next_session"),
    )


def size_level(completed: Column) -> Column:
    """Passages that a session merges, from the number of completed sessions."""
    out = F.lit(1)
    for least, level in reversed(dims.SIZE_LEVELS):
        out = F.when(completed >= least, level).otherwise(out)
    return out


def block_ends(sessions: DataFrame) -> DataFrame:
    """(book_id, session_no, merges): how many passages a block of the greatest size that starts here merges.

    Smaller blocks stop at the same places, so a block of any size merges the lesser of the two numbers.
    """
    return blocks(sessions, max(level for _, level in dims.SIZE_LEVELS)).select("book_id", "session_no", F.col("n_merged").alias("merges"))


def reached(sessions: DataFrame, readers: DataFrame, completions: DataFrame) -> DataFrame:
    """(user_id, book_id, reached_no): the furthest passage that a reader may see tags of, counted from 1.

    ``readers`` has user_id, book_id, current_no (null or unknown: not started) and size; ``completions`` user_id,
    book_id, start_no and words_read. The furthest of: the end of the block at the current passage, or at the first one;
    for each completion the first passage up to which words_read words were read, at most the last one; where
    words_read is null or not positive, the end of a block of today's size. Books without story passages give no row.

    Where a completion ends is found by sorting running words and goals together by book and looking back, so no
    completion is held against all passages.
    """
    n = numbered(sessions).select("book_id", "session_no", "words_before", (F.col("words_before") + F.col("word_count")).alias("upto"))
    last = n.groupBy("book_id").agg(F.max("session_no").alias("last_no"))
    done = completions.join(n.select("book_id", F.col("session_no").alias("start_no"), "words_before"), ["book_id", "start_no"])
    known = F.coalesce("words_read", F.lit(0)) > 0
    goals = done.filter(known).select("book_id", "user_id", (F.col("words_before") + F.col("words_read")).alias("at"), F.lit(None).cast("int").alias("session_no"))
    marks = n.select("book_id", F.lit(None).cast(dict(goals.dtypes)["user_id"]).alias("user_id"), F.col("upto").alias("at"), F.col("session_no").cast("int").alias("session_no"))
    back = Window.partitionBy("book_id").orderBy(F.desc("at"), F.desc_nulls_last("session_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = goals.unionByName(marks).withColumn("end_no", F.last("session_no", ignorenulls=True).over(back)).filter("session_no is null")
    by_words = found.join(last, "book_id").select("user_id", "book_id", F.coalesce("end_no", "last_no").alias("end_no"))
    current = readers.join(last, "book_id").select("user_id", "book_id", "size", F.when(F.col("current_no").between(1, F.col("last_no")), F.col("current_no")).otherwise(1).alias("session_no"))
    sized = done.filter(~known).join(readers.select("user_id", "book_id", "size"), ["user_id", "book_id"]).select("user_id", "book_id", "size", F.col("start_no").alias("session_no"))
    by_block = current.unionByName(sized).join(block_ends(sessions), ["book_id", "session_no"]).select("user_id", "book_id", (F.col("session_no") + F.least("merges", F.greatest("size", F.lit(1))) - 1).alias("end_no"))
    return by_words.unionByName(by_block).groupBy("user_id", "book_id").agg(F.max("end_no").cast("int").alias("reached_no"))


def completed(sessions: DataFrame, readers: DataFrame) -> DataFrame:
    """(user_id, book_id, n_sessions, n_completed): a book's story passages, and those before a reader's position or on record.

    ``readers`` has user_id, book_id, cur (the current passage; null: only records count) and done (the distinct numbers
    on record). Passages are numbered from 1 without gaps, so a book is its number of passages and no reader is held
    against each of them. Books without story passages give no row.
    """
    sizes = story(sessions).groupBy("book_id").agg(F.count("*").alias("n_sessions"))
    passed = F.when(F.col("cur") > 1, F.least(F.col("cur") - 1, F.col("n_sessions"))).otherwise(0)
    further = F.filter("done", lambda x: x.between(1, F.col("n_sessions")) & (F.col("cur").isNull() | (x >= F.col("cur"))))
    return readers.join(sizes, "book_id").select("user_id", "book_id", "n_sessions", (passed + F.size(further)).cast("long").alias("n_completed"))


def recap(chapters: DataFrame) -> DataFrame:
    """Chapters with the last three non-empty recaps before each, in order, joined by a blank line.

    A chapter hands on its own recap with those that it was told, so the state is RECAP_CHAPTERS recaps, not the book's.
    """
    before = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    rows, told = chapters, F.expr("cast(array() as array<string>)")
    for _ in range(dims.RECAP_CHAPTERS):
        own = F.concat(told, F.array("recap"))
        handed = F.when(F.col("recap") != "", F.slice(own, F.greatest(F.size(own) - dims.RECAP_CHAPTERS + 1, F.lit(1)), dims.RECAP_CHAPTERS))
        rows = rows.withColumn("recaps", F.last(handed, ignorenulls=True).over(before))
        told = F.coalesce("recaps", F.expr("cast(array() as array<string>)"))
    return rows.withColumn("recaps", F.array_join(told, "\n\n"))


def neighbours(sections: DataFrame) -> DataFrame:
    """Previous and next readable section of each readable one."""
    w = Window.partitionBy("book_id").orderBy("chapter_index")
    return story(sections).withColumns({"prev_id": F.lag("chapter_id").over(w), "next_id": F.lead("chapter_id").over(w)})


def contiguous_ranges(numbered_sessions: DataFrame) -> DataFrame:
    """First and last position (from 0) of every chapter."""
    return numbered_sessions.groupBy("book_id", "chapter_index").agg((F.min("session_no") - 1).alias("start_pos"), (F.max("session_no") - 1).alias("end_pos"))
