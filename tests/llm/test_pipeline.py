"""The pipeline: its stages in order, each against its operator on its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import mixing, neardup, pieces, pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(steps):
    assert [n for n, _, _ in steps] == ["toxicity", "minhash_near_dedup", "pii", "source_mixing", "sentencepiece"]
    assert all(after.columns == COLUMNS for _, _, after in steps[:-1])


def test_toxicity_stage(spark, steps):
    _, before, after = steps[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    clean = {r.doc_id for r in toxicity.toxicity_report(before, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == clean
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    assert not [i for i in {r.doc_id for r in before.collect()} - clean if marked.get(i) == 0]


def test_near_dedup_stage(steps):
    _, before, after = steps[1]
    classes = {r.class_id for r in neardup.near_duplicates(before).collect()}
    kept = [r.doc_id for r in after.collect()]
    assert set(kept) == classes and len(kept) == len(classes)


def test_pii_stage(steps):
    _, before, after = steps[2]
    assert before.count() == after.count()
    left = pii.pii_report(after).filter("n_email + n_ip + n_card + n_phone > 0").count()
    assert left == 0
    spans = {r.doc_id: r.spans for r in pii.pii_report(before).collect()}
    same = before.alias("b").join(after.alias("a"), "doc_id").select("doc_id", (F.col("a.text") == F.col("b.text")).alias("same"), (F.length("a.text") == F.col("a.n_chars")).alias("counted")).collect()
    assert all(r.counted and r.same == (spans[r.doc_id] == "") for r in same)


def test_mixing_stage(steps):
    _, before, after = steps[3]
    want = {r.doc_id: r.copies for r in mixing.mix_report(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == want


def test_sentencepiece_stage(steps):
    _, before, after = steps[4]
    rows = after.collect()
    assert len(rows) == before.count() and all(r.decoded == r.text for r in rows)
    model = pieces.PieceModel()
    assert all(list(r.piece_ids) == model.encode_batch([r.text])[0].tolist() for r in rows[:50])


def test_awkward_rows_pass_every_stage(spark, awkward, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == [*COLUMNS, "piece_ids", "decoded"] and got.count() > 0
