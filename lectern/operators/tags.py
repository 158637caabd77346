"""Tag analytics: validation of model replies, shown tags, maps, agreement, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims
from lectern.functions.text import collapse


def shown(tags: DataFrame) -> DataFrame:
    """Tags that may be seen: strong enough and on the closed list."""
    return tags.join(F.broadcast(dims.theme_dim(tags.sparkSession)), "theme").filter(F.col("score") >= dims.MIN_SHOWN_SCORE)


def parse_reply(reply: Column) -> Column:
    """array<struct<theme, score>> of a valid reply, strongest first and at most three; null if anything is wrong.

    A fence around the JSON is taken off. Each entry needs a theme of the list and a whole score from 1 to 5 that is a
    JSON integer; a theme must not repeat.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    variant = F.try_parse_json(text)
    items = F.from_json(text, "themes array<struct<theme:string,score:int>>")["themes"]
    kinds = F.from_json(text, "themes array<struct<theme:string,score:string>>")["themes"]
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get(variant, "$.themes", "variant")).startswith("ARRAY"), F.lit(False))
    fits = F.forall(items, lambda x: x["theme"].isin(*dims.THEMES) & x["score"].isNotNull() & x["score"].between(1, 5))
    whole_numbers = F.forall(kinds, lambda x: x["score"].rlike("^-?[0-9]+$"))
    distinct = F.size(F.array_distinct(F.transform(items, lambda x: x["theme"]))) == F.size(items)
    ranked = F.transform(items, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("x")))
    best = F.slice(F.transform(F.array_sort(ranked), lambda r: r["x"]), 1, dims.MAX_THEMES)
    return F.when(is_list & items.isNotNull() & F.coalesce(fits, F.lit(False)) & F.coalesce(whole_numbers, F.lit(False)) & distinct, best)


def parse_key_points(reply: Column, most: int = 5, chars: int = 240) -> Column:
    """array<string> of a reply's first points, white space collapsed, cut to ``chars``, without empty ones.

    Null if the reply is no JSON object with a list of points, or one of those taken is not a string; an empty list is
    valid. A fence around the JSON is taken off.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    points = F.slice(F.try_variant_get(F.try_parse_json(text), "$.points", "array<variant>"), 1, most)
    strings = F.forall(points, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    tidy = F.transform(points, lambda x: F.trim(F.left(collapse(F.try_variant_get(x, "$", "string")), F.lit(chars))))
    return F.when(points.isNotNull() & strings, F.filter(tidy, lambda x: x != ""))


def valid_entries(themes: Column) -> Column:
    """Whether a tag file's list of (theme, score) holds only themes of the list with scores from 1 to 5; null does not."""
    fits = F.forall(themes, lambda t: F.coalesce(t["theme"].isin(*dims.THEMES) & t["score"].between(1, 5), F.lit(False)))
    return themes.isNotNull() & F.coalesce(fits, F.lit(False))


def judged_entries(entries: DataFrame, books: DataFrame, sessions: DataFrame, done: DataFrame) -> DataFrame:
    """The chunks of a tag file (gutenberg_id, chapter, session, hash, themes) with session_id and outcome.

    A chunk's book must be a shared one (``books``: book_id, gutenberg_id), else its outcome is missing_books, which
    counts by book; place and hash of the text must be those of a passage (``sessions``: book_id, chapter_index,
    session_index, session_id, text), else mismatched; a passage in ``done`` (session_id) is skipped_existing; bad
    themes make it invalid; the rest is imported.
    """
    placed = sessions.select("book_id", F.col("chapter_index").alias("chapter"), F.col("session_index").alias("session"), "session_id", chunk_hash(F.col("text")).alias("own_hash"))
    met = entries.join(books.select("gutenberg_id", "book_id"), "gutenberg_id", "left").join(placed, ["book_id", "chapter", "session"], "left").join(done.select("session_id", F.lit(True).alias("tagged")), "session_id", "left")
    outcome = (
        F.when(F.col("book_id").isNull(), "missing_books")
        .when(~F.col("hash").eqNullSafe(F.col("own_hash")) | F.col("session_id").isNull(), "mismatched")
        .when(F.col("tagged"), "skipped_existing")
        .when(~valid_entries(F.col("themes")), "invalid")
        .otherwise("imported")
    )
    return met.withColumn("outcome", outcome).select(*entries.columns, "session_id", "outcome")


def import_outcomes(judged: DataFrame) -> DataFrame:
    """(outcome, n): chunks by outcome, but books for missing_books."""
    return judged.groupBy("outcome").agg(F.count("*").alias("chunks"), F.countDistinct("gutenberg_id").alias("books")).select("outcome", F.when(F.col("outcome") == "missing_books", F.col("books")).otherwise(F.col("chunks")).alias("n"))


def theme_map(tags: DataFrame, numbered: DataFrame) -> DataFrame:
    """theme -> its cells [{pos, session_id, score}] by position, and how many, by book."""
    placed = shown(tags).join(numbered.select("session_id", (F.col("session_no") - 1).alias("pos")), "session_id")
    return placed.groupBy("book_id", "theme").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("pos", "session_id", "score"))).alias("cells"))


def block_themes(tags: DataFrame, numbered: DataFrame, merges: DataFrame, size: int) -> DataFrame:
    """(book_id, session_no, theme, score): the strongest score of each shown theme in the block that starts at a passage.

    ``merges`` (book_id, session_no, merges) says how many passages a block merges at most. Each tag goes to the at most
    ``size`` starts whose block holds its passage.
    """
    placed = shown(tags).join(numbered.select("session_id", F.col("session_no").alias("at")), "session_id")
    starts = placed.select("book_id", "theme", "score", "at", F.explode(F.sequence(F.greatest(F.col("at") - size + 1, F.lit(1)), F.col("at"))).alias("session_no"))
    inside = starts.join(merges, ["book_id", "session_no"]).filter(F.col("at") < F.col("session_no") + F.least("merges", F.lit(size)))
    return inside.groupBy("book_id", "session_no", "theme").agg(F.max("score").alias("score"))


def strongest_by_chapter(tags: DataFrame, numbered: DataFrame) -> DataFrame:
    """For each theme and chapter the strongest passage, the first of equals, and the count."""
    placed = shown(tags).join(numbered.select("session_id", (F.col("session_no") - 1).alias("pos")), "session_id")
    return placed.groupBy("book_id", "theme", "chapter_index").agg(
        F.max("score").alias("score"), F.count("*").alias("count"), F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max_by("session_id", F.struct("score", -F.col("pos"))).alias("session_id")
    )


def kappa(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two present/absent raters by key; null if chance agreement is certain."""
    n, same, pa, pb = F.count("*"), F.count_if(a == b), F.count_if(a), F.count_if(b)
    counts = rows.groupBy(*keys).agg(n.alias("n"), same.alias("same"), pa.alias("pa"), pb.alias("pb"))
    n, pa, pb = F.col("n").cast("double"), F.col("pa"), F.col("pb")
    expected = (pa * pb + (n - pa) * (n - pb)) / (n * n)
    undefined = ((pa == n) & (pb == n)) | ((pa == 0) & (pb == 0))
    return counts.withColumn("kappa", F.when(~undefined, (F.col("same") / n - expected) / (1 - expected)))


def column_count(total: Column, reached: Column, whole: Column) -> Column:
    """Columns of a map: the whole book's, or those read so far; a missing count falls back to the whole book."""
    all_, read = F.greatest(F.lit(0), F.coalesce(F.floor(total), F.lit(0))), F.greatest(F.lit(0), F.coalesce(F.floor(reached), F.lit(0)))
    part = F.least(read, F.when(all_ > 0, all_).otherwise(read))
    return F.greatest(F.lit(1), F.when(whole | (read == 0), all_).otherwise(part)).cast("int")


def in_range(chapters: DataFrame, columns: Column) -> DataFrame:
    """The chapters that begin inside the drawn columns, their ends cut to these."""
    return chapters.filter(F.col("start_pos") < columns).withColumn("end_pos", F.least("end_pos", columns - 1))


def thinned(chapters: DataFrame, gap: int = 5) -> DataFrame:
    """(book_id, labelled): the chapters that carry a label, each at least ``gap`` columns after the last labelled one.

    The first one always does. A fold over each book's chapters, whose state is the last labelled column.
    """
    items = F.sort_array(F.collect_list(F.struct("start_pos", "chapter_index")))
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.expr("cast(array() as array<int>)").alias("out"))
    take = lambda s, x: s["last"].isNull() | (x["start_pos"] - s["last"] >= max(1, gap))
    step = lambda s, x: F.struct(F.when(take(s, x), x["start_pos"]).otherwise(s["last"]).alias("last"), F.when(take(s, x), F.concat(s["out"], F.array(x["chapter_index"]))).otherwise(s["out"]).alias("out"))
    return chapters.groupBy("book_id").agg(F.aggregate(items, zero, step)["out"].alias("labelled"))


def stratified(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows spread evenly over books, what is left over to the first ones; by a hash of the id, so reruns agree."""
    books = rows.select("book_id").distinct()
    each, over = divmod(n, max(1, books.count()))
    favoured = books.orderBy("book_id").limit(over).withColumn("more", F.lit(1))  # fewer than n books, by partial top lists
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("session_id").cast("string"))), "session_id"))
    ranked = rows.withColumn("rn", rank).filter(F.col("rn") <= each + 1)
    return ranked.join(favoured, "book_id", "left").filter(F.col("rn") <= each + F.coalesce("more", F.lit(0))).drop("rn", "more")


def chunk_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the text with white space collapsed."""
    return F.substring(F.sha2(F.array_join(F.array_remove(F.split(text, r"(?U)\s+"), ""), " "), 256), 1, 16)
