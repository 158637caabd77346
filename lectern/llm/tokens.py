"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialise, prepare

#: Vocabulary as ranks, one base64 token and its rank a line; the path must hold on every worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that one group of the suffix sums holds.
SPAN = 4096


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens`` (long) of every row's whole text; null and empty texts have 0. One row for each row, ids kept."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length -> n_docs, with what every context limit needs.

    docs_over and tokens_over are the suffix sums over longer documents; total_tokens, truncated_tokens (what is left
    if every document is cut at this length) and share_upto (the quantile of this length) follow. Sums run inside
    groups of SPAN lengths and then over the groups' totals, so no task needs all lengths. Texts are read once: the counts
    are a table before anything is summed. An empty table gives no rows.
    """
    hist = materialise(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths").withColumn("g", F.floor(F.col("length") / SPAN))
    groups = hist.groupBy("g").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    over = Window.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = groups.select(
        "g", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("later_t"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("g").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = hist.join(F.broadcast(later), "g").select(
        "length", "n_docs", "total_docs", "total_tokens",
        (F.col("later_d") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("later_t") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), F.lit(0))).alias("tokens_over"),
    )
    return summed.select(
        "length", "n_docs", "docs_over", "tokens_over", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_tokens"),
        (1 - F.col("docs_over") / F.col("total_docs")).alias("share_upto"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at ``limit``, for any limit, from the histogram alone."""
    row = histogram.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")).alias("n")).first()
    return row["n"] or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of all documents do not exceed; None for an empty table."""
    row = histogram.filter(F.col("share_upto") >= share - 1e-12).agg(F.min("length").alias("n")).first()
    return row["n"]
