"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j): beside a weight, each term has a short vector,
so two terms that are harmful together count although neither is alone, which additive weights miss. The model is
fitted on the driver from a bounded sample of labelled rows and is of fixed size; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import TERM_BYTES, hashed_sample, held, materialise, prepare, token_hashes

#: Terms are hashed to so many bits; the fit may use so many labelled rows.
HASH_BITS, SAMPLE_ROWS = 22, 40_000
RANK, RATE, PAIR_RATE, L2, BATCH = 4, 0.1, 0.05, 1e-4, 256
#: Passes over the sample: so many, and more of a small one, until so many steps are made.
EPOCHS, STEPS = 20, 600
#: Bytes that make a longer word's stem, a term of its own: words of one family share it.
STEM = 5
#: A term of at least MIN_ROWS of the sample's rows enters the model if its share among toxic rows differs by MIN_Z
#: standard errors. So does any term of at least FREQUENT of the rows, and of FREQUENT_ROWS rows, whatever its share: two
#: terms may be toxic only together. The rest is too rare to be learned from the sample.
MIN_ROWS, MIN_Z, FREQUENT, FREQUENT_ROWS = 3, 3.0, 0.02, 50


@dataclass
class Machine:
    """Sorted term hashes with weight and vector each. Without terms every score is the base rate."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """For ``n`` rows; ``at``: indices into the terms, ``row``: the row of each, without repeats inside a row."""
        v = self.vectors[at]
        pairs = sum(np.bincount(row, weights=v[:, k], minlength=n) ** 2 for k in range(v.shape[1]))
        return self.bias + np.bincount(row, weights=self.weights[at], minlength=n) + 0.5 * (pairs - np.bincount(row, weights=(v**2).sum(1), minlength=n))

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """0 to 1 for each text, from all its terms."""
        hashed = [text_terms(t) for t in texts]
        row = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
        found, at = find(self.terms, np.concatenate(hashed) if hashed else np.empty(0, np.int64))
        return 1 / (1 + np.exp(-np.clip(self.logits(at, row[found], len(hashed)), -30, 30)))


def find(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms are among the sorted ``terms``, and the indices of those."""
    at = np.searchsorted(terms, wanted)
    found = at < len(terms)
    found[found] = terms[at[found]] == wanted[found]
    return found, at[found]


def text_terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text: lower-cased runs of letters and digits, and their stems; null has none."""
    hashed = token_hashes((text or "").lower().encode("utf-8", "surrogatepass"), TERM_BYTES, STEM)
    return np.unique((hashed >> np.uint64(64 - HASH_BITS)).astype(np.int64))


def fit(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray) -> Machine:
    """Adaptive-rate stochastic descent on the logistic loss; rows hold indices into ``terms``, without repeats.

    The order is fixed, so equal rows give an equal machine.
    """
    n, toxic = len(rows), float(labels.sum())
    machine = Machine(float(np.log((toxic + 0.5) / (n - toxic + 0.5))), np.empty(0, np.int64), np.empty(0), np.empty((0, RANK)))
    if not len(terms) or toxic in (0.0, float(n)):
        return machine
    at, start = np.concatenate(rows, dtype=np.int32), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    rng = np.random.default_rng(7)
    machine.terms, machine.weights, machine.vectors = terms, np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), RANK))
    gw, gv, gb = np.full(len(terms), 1e-6), np.full((len(terms), RANK), 1e-6), 1e-6
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
        order = rng.permutation(n)
        for b in range(0, n, BATCH):
            batch = np.sort(order[b : b + BATCH])
            size = start[batch + 1] - start[batch]
            row = np.repeat(np.arange(len(batch)), size)
            t = at[np.repeat(start[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            error = (1 / (1 + np.exp(-np.clip(machine.logits(t, row, len(batch)), -30, 30))) - labels[batch]) / len(batch)
            used, t = np.unique(t, return_inverse=True)
            v, each = machine.vectors[used], error[row]
            sums = (np.bincount(row, weights=v[t, k], minlength=len(batch))[row] for k in range(RANK))
            dv = np.stack([np.bincount(t, weights=each * (s - v[t, k]), minlength=len(used)) for k, s in enumerate(sums)], axis=1) + L2 * v
            dw = np.bincount(t, weights=each, minlength=len(used)) + L2 * machine.weights[used]
            db = float(error.sum())
            gb += db * db
            gw[used] += dw * dw
            gv[used] += dv * dv
            machine.bias -= RATE * db / gb**0.5
            machine.weights[used] -= RATE * dw / np.sqrt(gw[used])
            machine.vectors[used] = v - PAIR_RATE * dv / np.sqrt(gv[used])
    return machine


def model_terms(sample: DataFrame) -> np.ndarray:
    """Sorted terms of ``sample`` (toxic, terms) that the model has: those that stand out alone, and all frequent ones."""
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    rate = (total["toxic"] or 0) / max(total["n"], 1)
    counts = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    z = F.abs(F.col("hits") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1e-9)
    chosen = counts.filter((F.col("n") >= MIN_ROWS) & ((z >= MIN_Z) | (F.col("n") >= max(FREQUENT_ROWS, FREQUENT * total["n"]))))
    return np.sort(np.array([r["term"] for r in chosen.select("term").collect()], np.int64))  # of a bounded sample


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on the labelled rows that are not held out, at most SAMPLE_ROWS ids of them, in the order of a hash of the id.

    Null labels and ids teach nothing. An id with different labels counts as toxic, and of different texts under one id
    the one with the least hash is read, so reruns agree. Without labels of both kinds every score is the base rate.
    """
    prepare(docs.sparkSession)
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = hashed_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", SAMPLE_ROWS)
    kind = dict(docs.dtypes)["doc_id"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("toxicity")
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "h": batch["h"], "terms": [text_terms(t).astype(np.int32) for t in batch["text"]]})

    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).join(F.broadcast(chosen), "doc_id")  # bounded by SAMPLE_ROWS
    found = texts.select("doc_id", "toxic", "h", "text").mapInPandas(hashed, f"doc_id {kind}, toxic int, h long, terms array<int>")
    sample = materialise(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("terms", "h").alias("terms")), "toxic-sample")
    terms = model_terms(sample)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "found": [find(terms, t)[1].astype(np.int32) for t in batch["terms"]]})

    rows = sample.mapInPandas(told, f"doc_id {kind}, toxic int, found array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists = rows["found"].combine_chunks()  # as Arrow: lists of Python numbers would take ten times the memory
    cuts = np.cumsum(lists.value_lengths().to_numpy())[:-1]
    return fit(np.split(lists.flatten().to_numpy(), cuts) if len(rows) else [], rows["toxic"].to_numpy().astype(float), terms)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for each row of ``docs``: repeated rows alike, empty and null texts at the base rate."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its terms come from a bounded sample
    kind = dict(docs.dtypes)["doc_id"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": shared.value.scores(batch["text"])})

    return docs.select("doc_id", "text").mapInPandas(scored, f"doc_id {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, one row for each row of ``docs``.

    Null and empty texts get the base rate's score; repeated rows and ties score alike; other columns are ignored and
    an empty table gives no rows.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under one half, with their columns as they are; repeated rows go or stay together."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts), dtype="float64")

    return docs.filter(of(F.col("text")) < 0.5)
