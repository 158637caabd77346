"""Queries against their SQL on small tables with rows that the driver's small tables do not have."""

from __future__ import annotations

import duckdb

from lectern.plans import load

from .compare import differences

QUERIES, ORACLES = load()


def against_sql(spark, folder, name, **tables) -> str:
    """What differs first between a query and its SQL over these tables, each a frame."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    return differences(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "de", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_bylines_of_letters_whose_capital_is_two(spark, tmp_path):
    words = ("ßung", "ß", "ﬁsch", "ŉa", "ǰa", "ıne", "ſein", "ähre", "ᾳa", "ǆa", "ann", "")
    text = "\n".join(f"{w} und weiter" for w in words for _ in range(9))
    assert against_sql(spark, tmp_path, "str_21_bylines", documents=documents(spark, text)) == ""


def events(spark, *rows):
    """Events (event_id, user_id, event_type)."""
    return spark.createDataFrame([(*r, 1.5, '{"k": 3}') for r in rows], "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts")


def test_completed_passages_of_odd_readers(spark, tmp_path):
    """Positions at the start, beyond the end and none; records before, after and outside; books without passages."""
    rows = [(50, 1, "view"), (60, 1, "purchase"), (120, 1, "purchase"), (49, 2, "view"), (61, 2, "purchase"), (3, 1, "purchase"), (5, 41, "purchase"), (4, 41, "purchase"), (7, 21, "view"), (1, 3, "view"), (-7, 22, "purchase"), (9, None, "purchase"), (None, 61, "purchase"), (None, 62, "view"), (8, 81, None)]
    texts = ["a b\n" * 3, "c\n\nd", "e\n" * 70, *[None, "", "f\n"] * 3, "g"]
    assert against_sql(spark, tmp_path, "win_05_agg_02_completed_flag", documents=documents(spark, *texts), events=events(spark, *rows)) == ""


def test_readers_are_not_held_against_every_passage(spark, tmp_path):
    documents(spark, *["a\n" * 40] * 3).write.parquet(f"{tmp_path}/documents.parquet")
    events(spark, *[(i, i, "view") for i in range(60)]).write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["win_05_agg_02_completed_flag"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Aggregate") > plan.index("Join") and "Window" not in plan


def test_paragraphs_are_worked_out_once(spark):
    """What strips the paragraphs stands once in the plan, not in what is asked of each of them."""
    from pyspark.sql import functions as F

    from lectern.functions import text as T

    plan = spark.createDataFrame([(["a ", " b"],)], "ps array<string>").select(T.merge_continuations(F.col("ps")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1
