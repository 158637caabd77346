"""Streams over files in small batches equal the same question asked of all rows at once."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import events as batch
from lectern.streaming import events as S


def feed(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id")
    rows.withColumn("b", F.ntile(3).over(Window.orderBy("ts", "event_id"))).repartition(1).write.partitionBy("b").parquet(str(tmp_path / "parts"))
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(sorted((tmp_path / "parts").glob("b=*"))):
        for f in part.glob("*.parquet"):
            shutil.copy(f, folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))  # batches follow the files' times
    return S.read(spark, str(folder))


def drain(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_windows(spark, sf_dir, tmp_path):
    stream = feed(spark, sf_dir, tmp_path)
    got = drain(S.tumbling(stream, "6 hours", "60 days"), "tumbling", "complete", tmp_path).collect()
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").count().collect()
    assert {(r.start, r.event_type): r.n for r in got} == {(r.window.start, r.event_type): r["count"] for r in want}


def test_append_keeps_every_event(spark, sf_dir, tmp_path):
    stream = feed(spark, sf_dir, tmp_path)
    q = S.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_streak_state(spark, sf_dir, tmp_path):
    stream = feed(spark, sf_dir, tmp_path)
    got = drain(S.streaks(stream), "streaks", "update", tmp_path)
    last = got.groupBy("user_id").agg(F.max_by(F.struct("current", "longest", "last_day"), F.struct("last_day", "longest", "current")).alias("s")).select("user_id", "s.*").collect()
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("day")).distinct()
    want = {r.user_id: (r.current_streak, r.longest_streak, r.last_day) for r in batch.streaks(days).collect()}
    assert {r.user_id: (r.current, r.longest, r.last_day) for r in last} == want
