"""Mutable state as pure functions of old rows and new: claims, leases, purges, merges, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import dims


def live_claim(status: Column, claimed_at: Column, now: Column) -> Column:
    return (status == "pending") & (claimed_at > now - F.expr(f"interval {dims.CLAIM_MINUTES} minutes"))


def claim(queue: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The queue after a claim of ``wanted`` ids: rows neither finished nor held by a live claim become pending now.

    ``won`` marks the claims that this caller holds. New ids are inserted. A full join by id, each side once.
    """
    q, w = queue.alias("q"), wanted.select("id").distinct().alias("w")
    free = F.col("w.id").isNotNull() & ~F.coalesce((F.col("q.status") == "done") | live_claim(F.col("q.status"), F.col("q.claimed_at"), now), F.lit(False))
    j = q.join(w, F.col("q.id") == F.col("w.id"), "full")
    return j.select(F.coalesce("q.id", "w.id").alias("id"), F.when(free, "pending").otherwise(F.col("q.status")).alias("status"), F.when(free, now).otherwise(F.col("q.claimed_at")).alias("claimed_at"), free.alias("won"))


def heartbeat(queue: DataFrame, held: Column, stamp: Column) -> DataFrame:
    """Rows that still carry the claim time ``held`` get a new one."""
    return queue.withColumn("claimed_at", F.when((F.col("status") == "pending") & (F.col("claimed_at") == held), stamp).otherwise(F.col("claimed_at")))


def release(queue: DataFrame, held: Column) -> DataFrame:
    """The queue without the pending rows that still carry the claim time ``held``."""
    return queue.filter(~((F.col("status") == "pending") & F.coalesce(F.col("claimed_at") == held, F.lit(False))))


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not deleted."""
    return children.join(deleted.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """Old and new rows by key; the new one wins, or with ``keep_old`` the old one (insert only)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_new") if keep_old else F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_new", "_rn")


def patch(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only sent fields change: ``changes`` has the fields and an array ``sent`` of their names."""
    j = rows.alias("r").join(changes.alias("c"), key, "left")
    put = [F.when(F.array_contains("c.sent", f), F.col(f"c.{f}")).otherwise(F.col(f"r.{f}")).alias(f) for f in fields]
    return j.select(*[F.col(f"r.{c}") if c != key else F.col(key) for c in rows.columns if c not in fields], *put)


def prefetch(numbered: DataFrame, current: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """Passages from the current one to PREFETCH_AHEAD after it that need tags: not done, not held, not failed just now."""
    ahead = numbered.join(current, "book_id").filter((F.col("session_no") >= F.col("cur")) & (F.col("session_no") <= F.col("cur") + dims.PREFETCH_AHEAD))
    fresh = (F.col("status") == "failed") & (F.col("claimed_at") > now - F.expr(f"interval {dims.FAILURE_MINUTES} minutes"))
    busy = queue.filter((F.col("status") == "done") | live_claim(F.col("status"), F.col("claimed_at"), now) | fresh).select(F.col("id").alias("session_id"))
    return ahead.join(busy, "session_id", "left_anti")


def session_state(events: DataFrame) -> DataFrame:
    """(session_id, started_at, ended_at, n_complete, error): a second completion is an error and changes nothing."""
    started = F.min(F.when(F.col("kind") == "start", F.col("ts")))
    done = F.min(F.when(F.col("kind") == "complete", F.col("ts")))
    n = F.count_if(F.col("kind") == "complete")
    return events.groupBy("session_id").agg(started.alias("started_at"), done.alias("ended_at"), n.alias("n_complete"), F.when(n > 1, "already_completed").alias("error"))


def without_prefix(parents: DataFrame, children: dict[str, DataFrame], name: str, prefix: str, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents whose ``name`` does not start with ``prefix``, and each table of children without rows of those that do."""
    gone = parents.filter(F.col(name).startswith(prefix))
    return parents.filter(~F.coalesce(F.col(name).startswith(prefix), F.lit(False))), {n: cascade_delete(rows, gone, key) for n, rows in children.items()}


def backdated(rows: DataFrame, column: str, days: int) -> DataFrame:
    """``rows`` with a time moved so many days into the past."""
    return rows.withColumn(column, F.col(column) - F.expr(f"interval {int(days)} days"))
