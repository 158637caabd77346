"""The corpus queries that SQL can express against their DuckDB oracles, and the shape of every query's result."""

from __future__ import annotations

import pytest

from lectern.llm.queries import ORACLES, QUERIES

from ..compare import connect, differences

DATA = "/root/testdata/sf0.01"
COLUMNS = {
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}
TYPES = {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "base_failed": "boolean", "kept": "boolean", "n_words": "bigint", "n_email": "bigint", "n_chars": "bigint", "near_next": "double", "payload_bytes": "bigint", "refers_to": "bigint"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert all(TYPES.get(c, t) == t for c, t in df.dtypes)
