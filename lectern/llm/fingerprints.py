"""Order MinHash fingerprints in DataFrame operations.

Every five-word k-mer of a text is numbered by its occurrence, so repeats count apart, and hashed. The hash space is
cut into BINS; each bin keeps its two least k-mers, puts them in text order and hashes the tuple. A fingerprint is the
set of these tuple hashes: two texts share one only if they hold the same k-mers in the same order, so its overlap
falls with edit distance and not just with the shared vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import free_name, let, materialise, words

K = 5
BIN_BITS = 6
#: Low bits of a packed value that hold the position; the rest identifies the k-mer.
POSITION_BITS = 24
#: Rows that one step of repeating makes at most.
CHUNK = 65_536


def _id(x: Column) -> Column:
    return F.call_function("shiftright", x, F.lit(POSITION_BITS))


def _pack(x: Column, position: Column) -> Column:
    mask = (1 << POSITION_BITS) - 1
    return x.bitwiseAND(F.lit(~mask)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(mask)))


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long"))


def _first(ordered: Column, x: Column) -> Column:
    """Index of the first ``x`` in a sorted array that has it: a scan of short arrays, halving in long ones."""
    mid = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get(ordered, mid(s)) < x, F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))))
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(ordered).cast("long"))))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), halve)["lo"]
    return F.when(F.size(ordered) < 2048, F.array_position(ordered, x).cast("int") - 1).otherwise(found)


def signatures(text: Column) -> Column:
    """array<int> of at most 64 tuple hashes; empty for a text without words. Fewer than five words are one k-mer."""

    def selected(key: Column) -> Column:
        def tuples(least: Column) -> Column:
            bin_of = lambda x: F.call_function("shiftright", x, F.lit(64 - BIN_BITS))

            def pair(x: Column, j: Column) -> Column:
                other = F.get(least, j + 1)
                alone = other.isNull() | (bin_of(other) != bin_of(x))
                return F.when((j > 0) & F.coalesce(bin_of(F.get(least, j - 1)) == bin_of(x), F.lit(False)), F.lit(None).cast("int")).otherwise(
                    F.when(alone, F.hash(bin_of(x), _id(x)))
                    .when(_position(x) < _position(other), F.hash(bin_of(x), _id(x), _id(other)))
                    .otherwise(F.hash(bin_of(x), _id(other), _id(x)))
                )

            return F.array_compact(F.transform(least, pair))

        bin_of = lambda x: F.call_function("shiftright", x, F.lit(64 - BIN_BITS))
        least = lambda s: F.filter(s, lambda x, j: F.coalesce(bin_of(F.get(s, j - 2)) != bin_of(x), F.lit(True)))
        return let(let(F.sort_array(key), least), tuples)

    def numbered(h: Column) -> Column:
        """Packed order hashes of (k-mer, occurrence number) with their positions."""
        plain = F.transform(h, lambda x, i: _pack(F.xxhash64(_id(x), F.lit(0)), i))

        def with_repeats(s: Column) -> Column:
            ids = F.transform(s, _id)
            return let(
                ids,
                lambda d: F.transform(
                    s,
                    lambda x, j: _pack(
                        F.xxhash64(_id(x), F.when(F.coalesce(F.get(d, j - 1) == _id(x), F.lit(False)), j - _first(d, _id(x))).otherwise(F.lit(0))), _position(x)
                    ),
                ),
            )

        repeats = F.size(F.array_distinct(F.transform(h, _id))) < F.size(h)
        return F.when(repeats, let(F.sort_array(F.transform(h, lambda x, i: _pack(x, i))), with_repeats)).otherwise(plain)

    def kmers(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))

    none = F.expr("cast(array() as array<int>)")
    return let(words(text), lambda w: F.when(F.size(w) == 0, none).otherwise(let(let(kmers(w), numbered), selected)))


def fingerprint(signature: Column) -> Column:
    """A signature as text: its hashes in hexadecimal, sorted, so equal texts have equal fingerprints."""
    return F.array_join(F.transform(F.sort_array(signature), lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared tuple hashes over the larger count, 0 to 1; two empty signatures are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


_LEAST = -(1 << 63)


def _keys(docs: DataFrame, *more: Column) -> DataFrame:
    """kid (the doc_id, the least long for null) and h (a hash of the text) of each row, and more."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST).cast("long")).alias("kid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *more)


def successors(docs: DataFrame) -> DataFrame:
    """(kid, h, copies, sig, next_sig, prev_kid, prev_h, prev_n) for each distinct (doc_id, text), after the last one the first.

    Signatures are made here, once. Keys without texts are range-partitioned and look to both sides inside their
    partition; of each partition the last key and the first signature, one row, go to its neighbours.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = _keys(docs, F.length(F.coalesce("text", F.lit(""))).alias("n"), signatures(F.col("text")).alias("sig"))
    keys = signed.groupBy("kid", "h").agg(F.max("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    placed = materialise(keys.repartitionByRange(parts, "kid", "h").withColumn("part", F.spark_partition_id()), "order")
    inside, me = Window.partitionBy("part").orderBy("kid", "h"), F.struct("kid", "h", "n")
    edges = placed.groupBy("part").agg(F.max(me).alias("last"), F.min_by("sig", F.struct("kid", "h")).alias("first_sig"))
    ring = Window.orderBy("part")  # one row for each partition
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("before_part"), F.coalesce(F.lead("first_sig").over(ring), F.first("first_sig").over(whole)).alias("after_part"))
    rows = placed.withColumns({"before": F.lag(me).over(inside), "after": F.lead("sig").over(inside)}).join(F.broadcast(edges), "part")
    prev = F.coalesce("before", "before_part")
    return rows.select("kid", "h", "copies", "sig", F.coalesce("after", "after_part").alias("next_sig"), prev["kid"].alias("prev_kid"), prev["h"].alias("prev_h"), prev["n"].alias("prev_n"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and sig of each distinct row (doc_id and text), next_head and next_sig of the one that follows, times.

    next_head is as much of the next text as half of the own one has code points. Null texts are empty. Null ids come
    first and count as the least long; rows with the same id follow each other by a hash of the text. Equal rows follow
    one after the other, so the last of them looks to the next text and the others (``times`` of them) to their own: a
    row that repeats gives two rows here. Equal rows meet before the shuffle; texts are shuffled once to meet their
    keys, and only heads go on to the document before.
    """
    order = materialise(successors(docs), "successors")
    texts = _keys(docs, F.coalesce("text", F.lit("")).alias("text")).groupBy("kid", "h").agg(F.first("text").alias("text"))
    met = texts.join(order.hint("merge"), ["kid", "h"])
    heads = met.select(F.col("prev_kid").alias("kid"), F.col("prev_h").alias("h"), F.expr("left(text, cast(floor(prev_n / 2) as int))").alias("head"))
    joined = met.select("kid", "h", "text", "sig", "next_sig", "copies").join(heads.hint("merge"), ["kid", "h"])
    one = F.lit(1).cast("long")
    parts = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(True).alias("own"), (F.col("copies") - 1).alias("times")), F.struct(F.lit(False).alias("own"), one.alias("times")))).otherwise(F.array(F.struct(F.lit(False).alias("own"), one.alias("times"))))
    half = F.floor(F.length("text") / 2).cast("int")
    return joined.select("*", F.inline(parts)).select(
        F.when(F.col("kid") != _LEAST, F.col("kid")).alias("doc_id"), "text", "sig",
        F.when(F.col("own"), F.left("text", half)).otherwise(F.col("head")).alias("next_head"), F.when(F.col("own"), F.col("sig")).otherwise(F.col("next_sig")).alias("next_sig"), "times",
    )


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, without that column; no array has over CHUNK elements."""
    name = free_name("chunk", rows)
    kept = [F.col(f"`{c}`") for c in rows.columns if c != times]
    chunks = rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
    return chunks.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col(name) * CHUNK)))).select(*kept)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text (null: empty) and of its edited text, whose last half is the next document's start.

    One row for each row of ``docs``; equal rows are worked out once. A text without words has an empty fingerprint, two
    of them are alike. Null ids come first; other columns are ignored and an empty table gives no rows.
    """
    pairs = with_next(docs.select("doc_id", "text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", n - half), "next_head")
    made = pairs.select("doc_id", "sig", "next_sig", n.cast("long").alias("n_chars"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), signatures(e).alias("sig"))).alias("e"), "times")
    told = made.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("e.sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("e.sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"), "times",
    )
    return repeated(told, "times")
