"""Helpers shared by the corpus operators: shared storage, worker set-up, let-bindings, token hashing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and code points that separate words in every word contract.
WHITESPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_GAP = r"[\x20\x09-\x0D]+"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small enough for long texts."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only in local mode without a setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.master.startswith("local-cluster"):
        return "file://" + os.path.join(tempfile.gettempdir(), "lectern-shared")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows (all, if there are fewer) with the least hash of ``key``; tasks send about four times as many in all.

    A threshold on the hash, from the row count, leaves some 4 n rows before they are sorted, so what reaches the last
    task does not grow with the data.
    """
    total = df.count()
    if total > 4 * n:
        df = df.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 31)) < max(1, (4 * n << 31) // total))
    return df.orderBy(F.xxhash64(F.lit(11), key), key).limit(n)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object] = dict) -> object:
    """What a Python worker keeps for one operator between tasks.

    Workers are used again by other operators, so what another one kept goes first and its memory returns to the system.
    """
    if name not in _HELD:
        if _HELD:
            import ctypes
            import gc

            _HELD.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # only this C library has it
                ctypes.CDLL(None).malloc_trim(0)
        _HELD[name] = make()
    return _HELD[name]


def free_name(name: str, rows: DataFrame) -> str:
    """``name``, with underscores before it as long as ``rows`` has such a column."""
    while name.lower() in (c.lower() for c in rows.columns):
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``, so that a costly expression is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: maximal runs of code points other than the six ASCII white-space ones."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


# --- token hashing on bytes -------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["up"], _TABLES["down"]


def _classes(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: Bytes that belong to words of the word contracts, and to lower-cased alphanumeric terms.
WORD_BYTES = _classes(lambda b: b not in WHITESPACE.encode())
TERM_BYTES = _classes(lambda b: b >= 128 or chr(b).isalnum())


def token_hashes(data: bytes, inside: np.ndarray = WORD_BYTES, stems: int = 0) -> np.ndarray:
    """64-bit hashes of the maximal byte runs inside the class, in text order, from prefix sums of a polynomial.

    With ``stems``, the hashes of the first ``stems`` bytes of every longer run follow.
    """
    if not data:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = inside[raw]
    edge = np.diff(flags)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    if stems:
        long = end - start > stems
        start, end = np.concatenate((start, start[long])), np.concatenate((end, start[long] + stems))
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
