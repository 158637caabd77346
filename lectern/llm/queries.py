"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import fingerprints, mixing, neardup, pieces, pii, quality, sharding, tokens, toxicity, warc
from lectern.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.encoded_lengths(_table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.place(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


_ALL = (op1_minhash_near_dedup, op2_token_counts, op3_quality_rules, op4_source_mixing, op5_sharding, op6_toxicity, op7_sentencepiece, op8_pii, op9_document_fingerprints, op10_warc)
QUERIES = {f.__name__: f for f in _ALL}

#: Measure -> how it follows from the counts, as in the operator.
_RATES = {"symbol_rate": "n_symbols * 1000", "dup_line_rate": "n_dup_lines * 1000", "repeat_rate": "n_repeat_words * 1000", "mean_word": "word_chars * 100"}


def _quality_sql() -> str:
    rates = ", ".join(f"{e} // greatest(n_words, 1) as {m}" for m, e in _RATES.items())
    long = " union all ".join(f"select lang, source, '{m}' as measure, {m} as v from fine" for m in _RATES)

    def quartiles(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""select {by}measure, max(total) total, min(b) filter (where 4 * upto >= total) q1, min(b) filter (where 4 * upto >= 3 * total) q3 from (
            select {by}measure, b, sum(n) over (partition by {by}measure) total, sum(n) over (partition by {by}measure order by b) upto from (select {by}measure, b, count(*) n from sketch group by {by}measure, b)) group by {by}measure"""

    pick = lambda q: f"case when o.total >= {quality.MIN_GROUP} then o.{q} when l.total >= {quality.MIN_GROUP} then l.{q} else a.{q} end"
    least = " ".join(f"when '{m}' then {v}" for m, (_, v) in quality.MEASURES.items())
    fences = ", ".join(f"max(q3 + {quality.FENCE} * spread) filter (where measure = '{m}') as hi_{m}, max(q1 - {quality.FENCE} * spread) filter (where measure = '{m}') as lo_{m}" for m in quality.MEASURES)
    within = " and ".join([f"{m} <= hi_{m}" for m in quality.MEASURES] + [f"{m} >= lo_{m}" for m, (low, _) in quality.MEASURES.items() if low])
    return rf"""with w as (select doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
    grams as (select doc_id, i, count(*) over (partition by doc_id, g) n from (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w))),
    repeats as (select doc_id, count(distinct i + k) n from grams, (select unnest([0, 1, 2]) k) where n > 1 group by doc_id),
    counts as (select w.doc_id, lang, source, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
      (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from w) w left join repeats r using (doc_id)),
    base as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words base_failed, {rates} from counts), fine as (select * from base where not base_failed),
    sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) b from ({long})),
    o as ({quartiles("lang, source")}), l as ({quartiles("lang")}), a as ({quartiles("")}),
    picked as (select o.lang, o.source, o.measure, {pick("q1")} q1, {pick("q3")} q3 from o join l on o.lang is not distinct from l.lang and o.measure = l.measure join a on a.measure = o.measure),
    fences as (select lang, source, {fences} from (select *, greatest(q3 - q1, case measure {least} end) spread from picked) group by lang, source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({within}, false) kept, {", ".join(_RATES)}
    from base b left join fences f on b.lang is not distinct from f.lang and b.source is not distinct from f.source"""


_WARC_SQL = """with p as (select page_id, encode(coalesce(html, '')) body, sha1(coalesce(html, '')) h from pages), g as (select *, max(page_id) over (partition by body) first_id from p)
    select page_id, octet_length(body)::bigint payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[i * 5 + 1:i * 5 + 5])::int >> s) & 31) + 1]), '')), '') payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end record_type, case when page_id <> first_id then first_id end refers_to from g"""

#: DuckDB SQL for the queries that SQL can express. Tokenizers, models, draws, random orders and look-behinds it cannot.
ORACLES: dict[str, str] = {"op3_quality_rules": _quality_sql(), "op10_warc": _WARC_SQL}
