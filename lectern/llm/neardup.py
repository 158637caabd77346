"""Near-duplicates by Order MinHash and banded alignment.

A text's five-word k-mers are numbered by occurrence (two-word ones as well in short texts); for each of ROWS random
orders the two least are kept in text order and hashed. Unlike plain MinHash, two texts share such a tuple only if they
hold the same k-mers in the same order, so the chance follows edit similarity. Documents that share a tuple are
candidates, and candidates whose words align with at most 20 % edits (an edit distance in a band of that width) are
linked. Linked documents form classes.

Scale: equal texts collapse by digest first, and each distinct text is a node. Of the buckets (texts with one tuple)
only those of two or more texts are kept, by counts that combine before the shuffle and a join whose hot keys Spark can
split. Cheap questions come first, because texts of one class need not be compared again: each text with the leader of
most of its buckets; then, where classes differ, members of a bucket with its most connected one. The rest is exact:
every pair of a bucket whose classes still differ is asked, unless its word counts show that it has too many edits.
So classes are the connected parts of all alike pairs that share a bucket, whatever the partitions. A bucket's texts
are met in pairs of blocks there, by ranges of length, which bounds every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import free_name, held, materialise, mix, prepare, token_hashes

K, ROWS = 5, 72
SIMILARITY = 0.8
#: Texts under SHORT words, and those that may be alike to one, also get rows over SHORT_K-word k-mers: one edit spoils
#: most five-word ones of a short text.
SHORT, SHORT_K, SHORT_ROWS = 64, 2, 32
#: Keys of texts up to this number (some 150 to 250 bytes each) are broadcast to pick texts; more go through a shuffle join.
BROADCAST_IDS = 250_000
#: Words are counted in so many bins by hash; the counts bound an edit distance from below.
BINS = 512
#: Texts of a bucket in a block; what is left of a bucket is asked in pairs of blocks.
BLOCK = 4096
_STEP = np.uint64(0x9FB21C651E98DF25)
_SEEDS = mix(np.arange(1, ROWS + SHORT_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def kmers(tokens: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of ``k`` words; fewer words are one k-mer; no words, none."""
    n, k = len(tokens), min(k, len(tokens))
    if not n:
        return tokens
    value = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        value = value * _STEP + tokens[j : n - k + 1 + j]
    return mix(value)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    at = np.arange(len(values))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), at, 0))
    out = np.empty(len(values), np.uint64)
    out[order] = (at - first).astype(np.uint64)
    return out


def order_minhash(tokens: np.ndarray) -> np.ndarray:
    """ROWS tuple hashes of a text's words, SHORT_ROWS more of a short text's; none for a text without words."""
    if not len(tokens):
        return np.empty(0, np.uint64)
    rows = _rows(kmers(tokens), _SEEDS[:ROWS])
    return np.concatenate((rows, _rows(kmers(tokens, SHORT_K), _SEEDS[ROWS:]))) if SIMILARITY * len(tokens) < SHORT else rows


def _rows(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A hash of the two least k-mers, in text order, under each seed's order: labelled k-mers times an odd number."""
    labelled = mix(grams + (occurrences(grams) + np.uint64(1)) * _STEP)
    rows = []
    step = max(1, 2_000_000 // len(grams))  # rows of the hash matrix at a time, for very long texts
    for r in range(0, len(seeds), step):
        some = seeds[r : r + step]
        ranks, at = labelled[None, :] * some[:, None], np.arange(len(some))
        least = ranks.argmin(axis=1)
        value = some
        if len(grams) > 1:
            ranks[at, least] = np.iinfo(np.uint64).max
            second = ranks.argmin(axis=1)
            value = mix(value * _STEP + grams[np.minimum(least, second)])
            least = np.maximum(least, second)
        rows.append(mix(value * _STEP + grams[least]))
    return np.concatenate(rows)


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], width: int, limits: np.ndarray) -> np.ndarray:
    """Edit distances of word arrays inside a band of ``width`` around the diagonal; over the limit if given up early.

    A value is an upper bound on the distance, and exact if it is at most ``width``.
    """
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    far = np.int32(1 << 29)
    x = np.full((len(pairs), int(n.max(initial=0))), -1, np.int64)
    y = np.full((len(pairs), int(max(m.max(initial=0), n.max(initial=0))) + 2 * width + 1), -2, np.int64)
    for i, (a, b) in enumerate(pairs):
        x[i, : len(a)] = a
        y[i, width : width + len(b)] = b
    offset = np.arange(-width, width + 1, dtype=np.int32)
    row = np.where(offset >= 0, offset, far).astype(np.int32)[None, :].repeat(len(pairs), 0)
    out = np.full(len(pairs), far, np.int32)
    inside = np.abs(m - n) <= width
    ended = inside & (n == 0)
    out[ended] = row[ended, (m - n)[ended] + width]
    live = np.flatnonzero(inside & (n > 0))
    for i in range(1, x.shape[1] + 1):
        if not len(live):
            break
        before = row[live]
        best = before + (x[live, i - 1, None] != y[live, i - 1 : i + 2 * width])
        np.minimum(best[:, :-1], before[:, 1:] + 1, out=best[:, :-1])
        best = np.minimum.accumulate(best - offset, axis=1) + offset
        np.minimum(best, far, out=best)
        row[live] = best
        done = n[live] == i
        if done.any():
            at = live[done]
            out[at] = row[at, (m - n)[at] + width]
        keep = ~done
        if i % 16 == 0:
            keep &= best.min(axis=1) <= limits[live]
        if not keep.all():
            live = live[keep]
    return out


def bag(words: np.ndarray) -> bytes:
    """Counts of 32-bit word hashes in BINS bins as bytes; greater ones are cut, which keeps the bound below a bound."""
    return np.minimum(np.bincount(np.asarray(words, np.int64) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes()


def _spread(words: np.ndarray) -> np.ndarray:
    """Word counts in 1,024 bins of 32-bit hashes."""
    return np.bincount(np.asarray(words, np.int64) & 1023, minlength=1024)


def _least_edits(differences: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance from differences of counts in bins: an edit takes away one word, adds one or both."""
    more = np.maximum(differences, 0).sum(axis=1, dtype=np.int64)
    return np.maximum(more, more - differences.sum(axis=1, dtype=np.int64))


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs align with at most (1 - similarity) * the longer one's words of edits."""
    longer = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    limits = np.floor((1 - similarity) * longer + 1e-9).astype(np.int32)
    found = np.zeros(len(pairs), bool)
    todo = np.flatnonzero([_least_edits((_spread(a) - _spread(b))[None, :])[0] <= limit for (a, b), limit in zip(pairs, limits, strict=True)])
    for narrow in (True, False):  # a narrow band settles most true pairs
        order = todo[np.argsort(longer[todo], kind="stable")]
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and upto - at < 128 and longer[order[upto]] <= 1.3 * longer[order[at]] + 16:
                upto += 1
            chunk = order[at:upto]
            width = int(min(16, limits[chunk].max()) if narrow else limits[chunk].max())
            found[chunk] = banded_distances([pairs[i] for i in chunk], width, limits[chunk]) <= limits[chunk]
            at = upto
        todo = order[~found[order] & (limits[order] > 16)]
    return found


def text_key(text: Column) -> list[Column]:
    """h1, h2: 128 bits that stand for a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """node (a number of its own), h1, h2, rep (least doc_id), copies, n_words, sigs for each distinct text."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("neardup")
        for batch in batches:
            tokens = [token_hashes((text or "").encode("utf-8", "surrogatepass")) for text in batch["text"]]
            made = {"n_words": [len(t) for t in tokens], "sigs": [order_minhash(t).view(np.int64) for t in tokens]}
            yield pd.DataFrame({c: batch[c] for c in ("doc_id", "h1", "h2")} | made)

    rows = docs.select("doc_id", *text_key(F.col("text")), "text").mapInPandas(sketch, f"doc_id {kind}, h1 long, h2 long, n_words int, sigs array<long>")
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_words", "sigs")])
    return materialise(texts.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")


def shared_entries(texts: DataFrame) -> DataFrame:
    """(sig, node, leader) for each bucket of two or more texts and each of its members; the leader is its least node."""
    entries = texts.select("node", F.explode("sigs").alias("sig"))
    shared = entries.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1").select("sig", "leader")
    return materialise(entries.join(shared.hint("merge"), "sig"), "entries")


def leader_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): each text b with the leader a that it shares most buckets with."""
    met = entries.filter("node <> leader").repartition("node").groupBy("node", "leader").agg(F.count("*").alias("n"))
    return met.groupBy("node").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a")).select("a", F.col("node").alias("b"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, class) of each b of (a, b), where each b has one a < b: the end of its chain, by halving chains."""
    found = parents.select(F.col("b").alias("node"), F.col("a").alias("class"))
    while True:
        up = found.select(F.col("node").alias("class"), F.col("class").alias("above"))
        found = materialise(found.select("node", "class").join(up, "class", "left").select("node", F.coalesce("above", "class").alias("class"), F.col("above").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("node", "class")


def open_entries(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, node, class, n) for members of buckets (n texts each) that hold more than one class."""
    classed = entries.select("sig", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    some = classed.groupBy("sig").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("sig", "n")
    return materialise(classed.join(some, "sig"), "open")


def central_pairs(entries: DataFrame) -> DataFrame:
    """Distinct (a, b) of each open bucket's members with its most connected one, where classes differ.

    A text that many others were made from shares most buckets with most of them, so asking it first joins them all.
    """
    tied = entries.withColumn("ties", F.sum("n").over(Window.partitionBy("node")))  # a node has at most ROWS + SHORT_ROWS rows
    leaders = tied.groupBy("sig").agg(F.max(F.struct("ties", "node", "class")).alias("to"))
    across = entries.join(leaders, "sig").filter(F.col("to.class") != F.col("class"))
    return across.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()


def remaining_pairs(entries: DataFrame, bags: DataFrame) -> DataFrame:
    """All (a, b) of open buckets whose classes differ and whose word counts allow few enough edits, each pair once.

    Texts of different classes share only open buckets, so a pair is left to the first one that it shares. A bucket of up to BLOCK texts is one meeting. A larger one is dealt to ranges of length, so that alike texts are in
    one range or in neighbours, and inside these to blocks of about BLOCK; classes of more than BLOCK texts have blocks
    of their own. Each two blocks that can hold alike texts meet once, except two blocks of one class.
    """
    small = entries.filter(F.col("n") <= BLOCK).select("sig", F.col("sig").alias("meeting"), F.lit(0).alias("side"), "node", "class")
    large = entries.filter(F.col("n") > BLOCK)
    seated = small if large.isEmpty() else small.unionByName(_seated(large, bags))
    fat = seated.join(bags, "node").select("sig", "meeting", "side", "node", "class", "n_words", "bag", "sigs")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last meeting may go on in the next batch
        for batch in batches:
            last = batch["meeting"].iloc[-1]
            done = batch["meeting"] != last
            if held and held[0]["meeting"].iloc[0] != last:
                yield _allowed(pd.concat([*held, batch[done]], ignore_index=True))
                held = []
            elif done.any():
                yield _allowed(batch[done])
            held.append(batch[~done])
        if held:
            yield _allowed(pd.concat(held, ignore_index=True))

    return fat.repartition("meeting").sortWithinPartitions("meeting").mapInPandas(meet, "a long, b long")


def _seated(large: DataFrame, bags: DataFrame) -> DataFrame:
    """(sig, meeting, side, node, class): the members of large buckets at each meeting of their blocks."""
    span = F.floor(F.log("n_words") / F.log(F.lit(1 / SIMILARITY))).cast("int")
    of_class = large.groupBy("sig", "class").agg(F.when(F.count("*") > BLOCK, F.col("class")).otherwise(-1).alias("own"))
    known = materialise(large.join(of_class, ["sig", "class"]).join(bags.select("node", span.alias("span")), "node"), "spans")
    block = ["span", "own", "part"]
    parts = known.groupBy("sig", "span", "own").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = materialise(known.join(parts, ["sig", "span", "own"]).select("sig", "node", "class", F.struct("span", "own", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).alias("block")), "blocks")
    names = materialise(dealt.select("sig", "block").distinct(), "block-names")
    met = names.withColumnRenamed("block", "i").join(names.withColumnRenamed("block", "j"), "sig")
    near = ((F.col("i.span") == F.col("j.span")) & (F.col("i") <= F.col("j"))) | (F.col("i.span") + 1 == F.col("j.span"))
    met = met.filter(near & ((F.col("i.own") < 0) | (F.col("i.own") != F.col("j.own"))))
    seat = lambda x, side: F.struct(F.col(x).alias("block"), F.lit(side).alias("side"))
    sides = F.when(F.col("i") == F.col("j"), F.array(seat("i", 0))).otherwise(F.array(seat("i", 1), seat("j", 2)))
    seats = met.select("sig", F.xxhash64("sig", "i", "j").alias("meeting"), F.inline(sides))
    return dealt.join(seats, ["sig", "block"]).select("sig", "meeting", "side", "node", "class")


def _allowed(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) within the meetings of ``rows`` (sorted by them): of other sides and classes, with few enough edits by counts."""
    meeting, side, n_words, node, classes, sig = (rows[c].to_numpy() for c in ("meeting", "side", "n_words", "node", "class", "sig"))
    bags = np.frombuffer(b"".join(rows["bag"]), np.uint8).reshape(-1, BINS).astype(np.int16)
    coarse = bags.reshape(len(bags), -1, 16).sum(axis=2, dtype=np.int16)
    sigs = np.zeros((len(rows), ROWS + SHORT_ROWS), np.int64)
    for i, own in enumerate(rows["sigs"]):
        sigs[i, : len(own)] = own
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while len(x := np.flatnonzero(meeting[:-step] == meeting[step:])):
        y = x + step
        longer = np.maximum(n_words[x], n_words[y])
        ask = (classes[x] != classes[y]) & ((side[x] == 0) | (side[x] != side[y])) & (np.minimum(n_words[x], n_words[y]) >= SIMILARITY * longer)
        x, y, limits = x[ask], y[ask], np.floor((1 - SIMILARITY) * longer[ask] + 1e-9)
        for counts in (coarse, bags):  # the sums of bins bound the distance too, and rule most pairs out
            ask = _least_edits(counts[x] - counts[y]) <= limits
            x, y, limits = x[ask], y[ask], limits[ask]
        first = sigs[x, (sigs[x] == sigs[y]).argmax(axis=1)] == sig[x]
        found.append((x[first], y[first]))
        step += 1
    x, y = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    a, b = node[x], node[y]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b): the least id that it is connected to.

    Each round gives an id the least label around it and then its label's label, so chains shorten by halves; rounds
    end when no label changes. Labels and edges stay distributed and each round is a table in the shared folder.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(around, labels["id"] == around["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        jumped = met.join(roots, met["label"] == roots["root"], "left").select("id", "old", F.least("label", F.coalesce("root_label", "label")).alias("label"))
        found = materialise(jumped, "labels")
        if found.filter("old <> label").isEmpty():
            return found.select("id", F.col("label").alias("component"))
        labels = found.select("id", "label")



def of_fit_length(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose numbers of words allow few enough edits."""
    of = lambda end: texts.select(F.col("node").alias(end), F.col("n_words").alias(f"n{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")).select("a", "b")


def of_fit_words(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose word counts allow few enough edits."""
    of = lambda end: bags.select(F.col("node").alias(end), F.col("n_words").alias(f"n{end}"), F.col("bag").alias(f"w{end}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wa, wb = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("wa", "wb"))
            limits = np.floor((1 - SIMILARITY) * np.maximum(batch["na"], batch["nb"]).to_numpy() + 1e-9)
            yield batch.loc[_least_edits(wa - wb) <= limits, ["a", "b"]]

    return joined.select("a", "b", "na", "nb", "wa", "wb").mapInPandas(check, "a long, b long")


class Aligner:
    """Verifies pairs of nodes; the hashed words of a text are read once and kept in the shared folder."""

    def __init__(self, docs: DataFrame, texts: DataFrame):
        self.docs = docs.select("doc_id", *text_key(F.col("text")), "text")
        self.texts = texts
        self.tokens: DataFrame | None = None

    def _fetch(self, ids: DataFrame) -> None:
        wanted = self.texts.select("node", F.col("rep").alias("doc_id"), "h1", "h2", "copies").join(ids, "node")
        wanted = materialise(wanted if self.tokens is None else wanted.join(self.tokens.select("node"), "node", "left_anti"), "wanted")
        n = wanted.count()
        if self.tokens is not None and not n:
            return
        few = n <= BROADCAST_IDS
        w, d = wanted.alias("w"), self.docs.alias("d")
        same = (F.col("d.h1") == F.col("w.h1")) & (F.col("d.h2") == F.col("w.h2")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
        rows = d.join(F.broadcast(w) if few else w, same).select("node", "copies", "text")

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                toks = [(token_hashes((t or "").encode("utf-8", "surrogatepass")) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch["text"]]
                yield pd.DataFrame({"node": batch["node"], "copies": batch["copies"], "toks": toks})

        found = materialise(rows.mapInPandas(hashed, "node long, copies long, toks array<int>"), "tokens")
        once = found.filter("copies = 1").select("node", "toks")  # only a repeated text can have come twice
        found = once.unionByName(found.filter("copies > 1").groupBy("node").agg(F.first("toks").alias("toks")))
        self.tokens = found if self.tokens is None else self.tokens.unionByName(found)

    def bags(self, nodes: DataFrame) -> DataFrame:
        """(node, n_words, bag, sigs) for the nodes."""
        ids = materialise(nodes.select("node").distinct(), "ids")
        self._fetch(ids)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"node": batch["node"], "n_words": [len(t) for t in batch["toks"]], "bag": [bag(t) for t in batch["toks"]]})

        counted = self.tokens.join(ids, "node", "left_semi").mapInPandas(count, "node long, n_words int, bag binary")
        return materialise(counted.join(self.texts.select("node", "sigs"), "node"), "bags")

    def verified(self, pairs: DataFrame, fetched: bool = False) -> DataFrame:
        """The pairs (a, b) whose texts align; ``fetched``: all of them were read before, for their bags."""
        if not fetched:
            self._fetch(materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids"))
        of = lambda end: self.tokens.select(F.col("node").alias(end), F.col("toks").alias(f"t{end}"))

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = similar(list(zip(batch["ta"], batch["tb"], strict=True)))
                yield batch.loc[keep, ["a", "b"]]

        joined = pairs.join(of("a"), "a").join(of("b"), "b")
        return materialise(joined.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long"), "verified")


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, class) after the links (a, b) have joined some of them; nodes without a row are on their own."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("class").alias(f"{end}_class"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).filter("a <> b")
    merged = connected(across).select(F.col("id").alias("class"), F.col("component").alias("merged"))
    ends = classes.join(merged, "class", "left").select("node", F.coalesce("merged", "class").alias("class"))
    alone = merged.join(classes.select(F.col("node").alias("known")), F.col("class") == F.col("known"), "left_anti").select(F.col("class").alias("node"), F.col("merged").alias("class"))
    return materialise(ends.unionByName(alone), "classes")


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and (node, class) of those that are linked to others; the rest are classes of their own."""
    texts = distinct_texts(docs)
    entries = shared_entries(texts)
    aligner = Aligner(docs, texts)
    asked = materialise(of_fit_length(leader_pairs(entries), texts), "pairs")
    classes = roots(aligner.verified(asked))
    # then every bucket again, but only across classes, so what is linked stays unasked; the last time no pair is left out
    bags = None
    for pairs_of in (lambda e: of_fit_words(central_pairs(e), bags), lambda e: remaining_pairs(e, bags)):
        entries = open_entries(entries, classes)
        bags = aligner.bags(entries) if bags is None else bags
        pairs = materialise(pairs_of(entries).join(asked, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            classes = joined(classes, aligner.verified(pairs, fetched=True))
            asked = asked.unionByName(pairs)
    return texts, classes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the class's least doc_id), copies (rows with equal text).

    Null texts count as empty; all texts without words are alike only if equal. Rows without doc_id take part by their
    text; class_id is null only where no row of the class has a doc_id. Different texts under one doc_id are looked at
    apart. Other columns are ignored and an empty table gives no rows.
    """
    texts, classes = text_classes(docs)
    least = classes.join(texts.select("node", "rep"), "node").select(F.col("class"), "rep").unionByName(classes.select("class").distinct().join(texts.select(F.col("node").alias("class"), "rep"), "class")).groupBy("class").agg(F.min("rep").alias("class_id"))
    member = classes.select("node", "class").unionByName(classes.select(F.col("class").alias("node"), "class")).distinct()
    named = texts.join(member.join(least, "class").select("node", "class_id", F.lit(True).alias("linked")), "node", "left")
    of_text = named.select("h1", "h2", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("rep")).alias("class_id"), "copies")
    return docs.select("doc_id", *text_key(F.col("text"))).join(of_text.hint("merge"), ["h1", "h2"]).select("doc_id", "class_id", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """One whole row of each class: the one with the least doc_id, of different texts under that id the one with the least hash.

    Equal texts are one class, so of rows that repeat one stays, with or without doc_id; nulls come after any doc_id.
    """
    texts, classes = text_classes(docs)
    classed = texts.join(classes, "node", "left")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "h1", "h2")).alias("f")
    kept = classed.groupBy(F.coalesce("class", "node")).agg(first).select("f.doc_id", "f.h1", "f.h2")
    own = docs.select("*", F.struct("doc_id", *text_key(F.col("text"))).alias(mark := free_name("key", docs)))
    key = [F.col(f"{mark}.{c}").alias(c) for c in ("doc_id", "h1", "h2")]
    repeats = own.select(*key).groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("times")).filter("times > 1")
    same = lambda x, y: x["h1"].eqNullSafe(y["h1"]) & x["h2"].eqNullSafe(y["h2"]) & x["doc_id"].eqNullSafe(y["doc_id"])
    kept = materialise(kept.alias("k").join(repeats.alias("r"), same(*({c: F.col(f"{t}.{c}") for c in ("doc_id", "h1", "h2")} for t in "kr")), "left").select("k.*", F.col("times").isNotNull().alias("again")), "kept")
    few = kept.count() <= BROADCAST_IDS
    pick = lambda rows: own.join(F.broadcast(rows) if few else rows, same({c: F.col(f"{mark}.{c}") for c in ("doc_id", "h1", "h2")}, rows), "left_semi")
    once = pick(kept.filter("not again"))
    again = kept.filter("again")
    if not again.isEmpty():
        once = once.unionByName(pick(again).dropDuplicates([mark]))
    return once.drop(mark)
