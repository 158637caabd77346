"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more with probability
r - floor(r). The cube method draws these extra copies: it moves the vector of probabilities inside the null-space of
the balancing constraints (words and documents of the source), three documents at a time, each move making at least
one of them whole, until OPEN are left. The landing phase then draws one of the choices of those few, by a linear
programme: of all designs that keep every document's probability, the one whose words and documents come nearest.

Documents move in blocks of a source, so a source of any size is spread over many tasks. What each block leaves open
meets in coarser blocks and, at last, in one small landing problem for each source.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import free_name, materialise, prepare, words

#: Weights of the sources in order, repeating; the share of all sizes; the cap over a source's size.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Documents that meet in one block of the flight phase on average, and those that a flight leaves open at most.
BLOCK, OPEN = 4096, 12
#: Weight of a document against the mean size in the landing phase.
DOCS_WEIGHT = 0.02


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(words(text)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) by filling: targets in proportion to weights, none above cap times its source.

    With sources by the ratio of cap to weight, those before the first one that its share does not fill stop at the
    cap; the rest divide what is left by weight. That is the end of re-sharing the excess until none is above. There
    is one row for each source, so the windows without keys run over sources, never over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "w", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = ranked.withColumns(
        {
            "full_before": F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap,
            "w_from": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(every) * share,
        }
    ).withColumn("level", (F.col("total") - F.col("full_before")) / F.col("w_from"))
    level = F.min(F.when(cap * F.col("source_size") >= F.col("level") * F.col("w"), F.struct(F.col("source_size") / F.col("w"), "level"))).over(every)["level"]
    return walked.withColumn("fill", level).select("source", "source_size", "n", F.least(F.col("fill") * F.col("w"), cap * F.col("source_size")).alias("target"))


def _uniform(seed: str) -> Iterator[float]:
    """Reproducible numbers in [0, 1) from a counter."""
    i = 0
    while True:
        block = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        for k in range(0, 32, 8):
            yield int.from_bytes(block[k : k + 8], "big") / 2**64
        i += 1


def flight(p: list[float], size: list[float], seed: str) -> None:
    """Move the probabilities ``p`` in place, keeping sum(p) and sum(p * size), until at most OPEN lie inside (0, 1).

    Each move takes the three open documents whose sizes are closest, so those left open differ in size.
    """
    draw, tiny = _uniform(seed), 1e-9
    open_: list[int] = []
    for k in range(len(p)):
        if not tiny < p[k] < 1 - tiny:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        while len(open_) > OPEN:
            open_.sort(key=lambda i: (size[i], i))
            at = min(range(len(open_) - 2), key=lambda i: size[open_[i + 2]] - size[open_[i]])
            a, b, c = three = open_[at : at + 3]
            move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(move):
                move = (1.0, -1.0, 0.0)  # equal sizes: any exchange keeps both sums
            up = min((1 - p[i]) / m if m > 0 else p[i] / -m for i, m in zip(three, move, strict=True) if m)
            down = min(p[i] / m if m > 0 else (1 - p[i]) / -m for i, m in zip(three, move, strict=True) if m)
            step = up if next(draw) * (up + down) < down else -down
            for i, m in zip(three, move, strict=True):
                x = p[i] + step * m
                p[i] = 0.0 if x < tiny else 1.0 if x > 1 - tiny else x
            open_ = [i for i in open_ if 0 < p[i] < 1]


def landing(p: list[float], size: list[float], seed: str) -> None:
    """Settle the at most OPEN open documents in place, each with its probability.

    Of all ways to draw one of their choices (subsets) that give every document its probability, that one is used whose
    words and documents come nearest to what is due on average. A simplex search finds it, from the nested choices.
    """
    open_ = sorted((k for k in range(len(p)) if 0 < p[k] < 1), key=lambda k: (-p[k], k))
    if not open_:
        return
    n, due, sizes = len(open_), np.array([p[k] for k in open_]), np.array([size[k] for k in open_])
    choices = (np.arange(1 << n)[None, :] >> np.arange(n)[:, None] & 1).astype(float)
    cost = np.abs(sizes @ choices - sizes @ due) / max(1.0, sizes.mean()) + DOCS_WEIGHT * np.abs(choices.sum(0) - due.sum())
    rules, wanted = np.vstack((choices, np.ones(1 << n))), np.append(due, 1.0)
    basis = [(1 << j) - 1 for j in range(n + 1)]  # nested choices, by falling probability
    for _ in range(300):  # any round's design keeps the probabilities; later ones come nearer
        square = rules[:, basis]
        gain = cost - np.linalg.solve(square.T, cost[basis]) @ rules
        enters = int(np.argmin(gain))
        if gain[enters] > -1e-9:
            break
        shares, change = np.linalg.solve(square, wanted), np.linalg.solve(square, rules[:, enters])
        ratio = np.where(change > 1e-9, np.maximum(shares, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[min(range(n + 1), key=lambda i: (ratio[i], basis[i]))] = enters
    shares = np.maximum(np.linalg.solve(rules[:, basis], wanted), 0)
    drawn = basis[min(int(np.searchsorted(np.cumsum(shares), next(_uniform(seed)) * shares.sum(), side="right")), n)]
    for j, k in enumerate(open_):
        p[k] = float(drawn >> j & 1)


def _move(rows: DataFrame, keys: list[str], last: bool, seed: str) -> DataFrame:
    """One flight over each block: rows (source, block, key, size, p); in the last one each source lands."""

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        p, size = pdf["p"].tolist(), [float(x) for x in pdf["size"]]
        own = f"{seed}:{pdf['source'].iloc[0]}:{pdf['block'].iloc[0]}"
        flight(p, size, own)
        if last:
            landing(p, size, f"{own}:landing")
        return pdf.assign(p=p)[["source", "block", "key", "size", "p"]]

    return rows.groupBy(*keys).applyInPandas(per_block, "source string, block long, key string, size long, p double")


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (a hash of the text) and number of each row; equal rows are told apart by the number.

    Where rows repeat, they are numbered inside their part of the table and after the parts before it, so no task has
    to hold all rows of one kind.
    """
    same, t = ["doc_id", "source", "h"], F.coalesce("text", F.lit(""))
    sized = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64(t).alias("h")).withColumn("part", F.spark_partition_id()), "sizes")
    if sized.groupBy(*same).count().filter("count > 1").isEmpty():
        return sized.withColumn("number", F.lit(1).cast("long")).drop("part")
    per_part = sized.groupBy(*same, "part").agg(F.count("*").alias("k"))
    before = per_part.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = sized.withColumn("at", F.row_number().over(Window.partitionBy(*same, "part").orderBy("size")))
    met = (F.col("i.part") == F.col("b.part")) & (F.col("i.h") == F.col("b.h")) & F.col("i.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("i.source").eqNullSafe(F.col("b.source"))
    return inside.alias("i").join(before.alias("b"), met).select("i.doc_id", "i.source", "i.size", "i.h", (F.col("i.at") + F.col("b.before")).alias("number"))


def take_counts(sized: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, h, number, source_size, target, copies (int): how often the mix takes each row.

    ``sized`` is as of :func:`sized_rows`. Each copy count is floor(r) or one more, r on average, where r is the
    source's target over its size. Sources of size 0 take nothing; null is a source of its own. Repeated rows are drawn
    one by one. An empty table gives no rows. Draws depend on ids, texts and the seed only, so reruns agree.
    """
    prepare(sized.sparkSession)
    per = materialise(targets(sized), "targets")
    most = per.agg(F.max("n")).first()[0] or 0
    rows = sized.alias("d").join(per.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.n")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.concat_ws("#", F.lpad(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 20, "0"), F.hex("h"), F.col("number").cast("string"))
    base = rows.withColumn("base", F.floor(ratio + 1e-12).cast("int")).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0))).withColumn("key", key)
    base = materialise(base, "mix-rows")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("long")
    left = base.select("source", F.pmod(F.xxhash64("key", "size"), blocks(F.col("n"))).alias("block"), "key", "size", "p")
    settled: list[DataFrame] = []
    most_blocks, level = max(1, math.ceil(most / BLOCK)), 0
    while True:
        last = most_blocks == 1
        moved = materialise(_move(left, ["source", "block"], last, f"{seed}:{level}"), f"flight-{level}")
        settled.append(moved.filter((F.col("p") <= 0) | (F.col("p") >= 1)).select("source", "key", "size", F.col("p").cast("int").alias("extra")))
        if last:
            break
        # each block leaves OPEN rows at most, so some hundred blocks make a block of the next level
        most_blocks, level = math.ceil(most_blocks * OPEN / BLOCK), level + 1
        left = moved.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("block", F.floor(F.col("block") * OPEN / BLOCK).cast("long"))
    extra = settled[0]
    for x in settled[1:]:
        extra = extra.unionByName(x)
    same = F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("b.key") == F.col("e.key")) & (F.col("b.size") == F.col("e.size"))
    return base.alias("b").join(extra.alias("e"), same, "left").select(*[f"b.{c}" for c in ("doc_id", "source", "size", "h", "number", "source_size", "target")], (F.col("b.base") + F.coalesce("e.extra", F.lit(0))).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs``.

    Null and empty texts have size 0 and take no words; null source and doc_id are values like others; repeated rows
    have a draw each; other columns are ignored and an empty table gives no rows.
    """
    return take_counts(sized_rows(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_report` takes it, with its columns as they are.

    Rows with equal doc_id, source and text are one kind: each comes as often as all of the kind on average, and so many
    of them once more (by a numbering of that kind's rows) that the kind's total is the report's.
    """
    kinds = take_counts(sized_rows(docs)).groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    kinds = materialise(kinds, "kinds")
    name = free_name("kind", docs)
    own = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda rows: own["doc_id"].eqNullSafe(rows["doc_id"]) & own["source"].eqNullSafe(rows["source"]) & (own[name] == rows["h"])
    of = lambda rows, *more: own.join(rows, same(rows)).select(*[own[c] for c in docs.columns], *more)
    sure = kinds.filter(F.floor(F.col("total") / F.col("rows")) > 0)
    taken = of(sure, F.explode(F.sequence(F.lit(1), F.floor(F.col("total") / F.col("rows")).cast("int"))).alias(name)).drop(name)
    some = kinds.filter((F.col("rows") > 1) & (F.col("total") % F.col("rows") > 0))
    if some.isEmpty():
        return taken
    # the rows of repeated kinds only: numbered in parts, so that none has to meet all others of its kind
    part, number = free_name("part", docs), free_name("number", docs)
    few = materialise(of(some, some["h"].alias(name), (some["total"] % some["rows"]).alias(number)).withColumn(part, F.spark_partition_id()), "repeated-rows")
    key = ["doc_id", "source", name]
    per_part = few.groupBy(*key, part).agg(F.count("*").alias("k"))
    before = per_part.select(*key, part, F.coalesce(F.sum("k").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = free_name("at", few)
    inside = few.withColumn(at, F.row_number().over(Window.partitionBy(*key, part).orderBy(name)))
    i, b = (lambda c: F.col(f"i.`{c}`")), (lambda c: F.col(f"b.`{c}`"))
    met = (i(part) == b(part)) & (i(name) == b(name)) & i("doc_id").eqNullSafe(b("doc_id")) & i("source").eqNullSafe(b("source"))
    more = inside.alias("i").join(before.alias("b"), met).filter(i(at) + b("before") <= i(number)).select(*[i(c).alias(c) for c in docs.columns])
    return taken.unionByName(more)
