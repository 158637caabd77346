"""Queries over mutable state, as old rows and new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import reader, state
from lectern.plans.registry import query
from lectern.sources.adapters import adapt, table

_QUEUE = "q as (select o_orderkey id, case o_orderstatus when 'O' then 'pending' when 'P' then 'failed' else 'done' end status, timestamp '2024-01-01 00:00:00' + interval 1 minute * (o_orderkey % 60) claimed_at from orders)"
_NOW = "timestamp '2024-01-01 00:45:00'"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey % 60 as int), 0)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), at.alias("claimed_at"))


def _now():
    return F.expr("timestamp_ntz'2024-01-01 00:45:00'")


@query(
    f"""with {_QUEUE}, w as (select distinct o_orderkey * 2 id from orders where o_orderkey % 3 = 0), j as (select coalesce(q.id, w.id) id, q.status, q.claimed_at, w.id is not null and not coalesce(q.status = 'done' or (q.status = 'pending' and q.claimed_at > {_NOW} - interval 20 minutes), false) won from q full join w on q.id = w.id)
    select id, case when won then 'pending' else status end status, case when won then {_NOW} else claimed_at end claimed_at, won from j"""
)
def stm_08_dml_03_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("id"))
    return state.claim(_queue(spark, sf_dir), wanted, _now())


@query(f"with {_QUEUE} select id, status, case when status = 'pending' and claimed_at = timestamp '2024-01-01 00:07:00' then {_NOW} else claimed_at end claimed_at from q where not (status = 'pending' and claimed_at = timestamp '2024-01-01 00:09:00')")
def stm_08_dt_04_heartbeat_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda m: F.expr(f"timestamp_ntz'2024-01-01 00:{m}:00'")
    return state.release(state.heartbeat(_queue(spark, sf_dir), at("07"), _now()), at("09"))


@query(
    f"""with {_QUEUE}, n as (select session_id, book_id, row_number() over (partition by book_id order by chapter_index, session_index) no from sessions where section_kind = 'story')
    select n.session_id, n.book_id from n where no between 10 and 14 and not exists (select 1 from q where q.id = n.session_id and (q.status = 'done' or (q.status = 'pending' and q.claimed_at > {_NOW} - interval 20 minutes) or (q.status = 'failed' and q.claimed_at > {_NOW} - interval 15 minutes)))""",
    "sessions",
)
def stm_09_flt_07_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = reader.numbered(adapt(spark, sf_dir, "sessions")).select("session_id", "book_id", "session_no")
    current = numbered.select("book_id").distinct().withColumn("cur", F.lit(10))
    return state.prefetch(numbered, current, _queue(spark, sf_dir), _now()).select("session_id", "book_id")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def dml_01_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.cascade_delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), gone, "l_orderkey")


@query("with new as (select c_custkey * 2 as id, 'new' as name from customer) select coalesce(n.id, c.c_custkey) id, coalesce(n.name, c.c_name) name from customer c full join new n on n.id = c.c_custkey")
def dml_02_05_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return state.upsert(old, old.select((F.col("id") * 2).alias("id"), F.lit("new").alias("name")), ["id"])


@query("with new as (select c_custkey * 2 as id, 'new' as name from customer) select coalesce(c.c_custkey, n.id) id, coalesce(c.c_name, n.name) name from customer c full join new n on n.id = c.c_custkey")
def stm_10_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return state.upsert(old, old.select((F.col("id") * 2).alias("id"), F.lit("new").alias("name")), ["id"], keep_old=True)


@query("select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'renamed' else c_name end c_name, case when c_custkey % 3 = 1 then c_acctbal when c_custkey % 3 = 0 then 0.0 else c_acctbal end c_acctbal from customer")
def prj_03_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey") % 3
    sent = F.when(k == 0, F.array(F.lit("c_name"), F.lit("c_acctbal"))).when(k == 1, F.array(F.lit("c_name")))
    changes = rows.filter("c_custkey % 3 < 2").select("c_custkey", F.when(k == 1, "renamed").alias("c_name"), F.lit(0.0).alias("c_acctbal"), sent.alias("sent"))
    return state.patch(rows, changes, "c_custkey", ["c_name", "c_acctbal"])


@query("select doc_id, coalesce(nullif(case when doc_id % 2 = 0 then 'typed' else '' end, ''), nullif(lang, '')) value, case when doc_id % 3 = 0 then 'year' else '' end needs_review from documents")
def prj_04_metadata_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.when(F.col("doc_id") % 2 == 0, "typed").otherwise("")
    review = F.array_join(F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "year"))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(typed, F.lit("")), F.nullif("lang", F.lit(""))).alias("value"), review.alias("needs_review"))


@query("select user_id * 100 + book_id session_id, min(ts) filter (where event_type = 'view') started_at, min(ts) filter (where event_type = 'purchase') ended_at, count(*) filter (where event_type = 'purchase') n_complete, case when count(*) filter (where event_type = 'purchase') > 1 then 'already_completed' end error from reads group by 1", "reads")
def stm_02_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete")
    return state.session_state(adapt(spark, sf_dir, "reads").select((F.col("user_id") * 100 + F.col("book_id")).alias("session_id"), kind.alias("kind"), "ts"))


@query("select book_id, coalesce(p.cur, f.first_id) current_session from books b join (select book_id, min_by(session_id, chapter_index * 100000 + session_index) first_id from sessions where section_kind = 'story' group by 1) f using (book_id) left join (select book_id, max(session_id) cur from sessions where book_id % 2 = 0 group by 1) p using (book_id)", "books", "sessions")
def dml_06_get_or_create_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = adapt(spark, sf_dir, "sessions")
    first = reader.story(sessions).groupBy("book_id").agg(F.min_by("session_id", F.struct("chapter_index", "session_index")).alias("first_id"))
    progress = sessions.filter("book_id % 2 = 0").groupBy("book_id").agg(F.max("session_id").alias("cur"))
    return adapt(spark, sf_dir, "books").join(first, "book_id").join(progress, "book_id", "left").select("book_id", F.coalesce("cur", "first_id").alias("current_session"))


@query("select o_orderkey, cast(cast(o_orderdate as date) - 3 as varchar) as day from orders where o_custkey not in (select c_custkey from customer where c_name like 'Customer#00000000%')")
def dml_07_reset_and_backdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a prefix go with their orders; what is left is moved three days back."""
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    _, left = state.without_prefix(customers, {"orders": table(spark, sf_dir, "orders")}, "c_name", "Customer#00000000", "o_custkey")
    return state.backdated(left["orders"], "o_orderdate", 3).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
