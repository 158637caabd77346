"""Books fetched over HTTP: a metadata record for each id, then the plain text that it names."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lectern.sources.workers import let_import

#: Tries of one address; the pause after the n-th is n times so many seconds.
TRIES, STEP = 5, 5.0
#: Fixed value: where the metadata of a book is.
METADATA = "https://gutendex.com/books/{id}/"
Get = Callable[[str, float], bytes]


def http_get(url: str, timeout: float) -> bytes:
    """The body at an address; any status but success raises an OSError, as lost connections do."""
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # follows redirects
        return reply.read()


def patient(get: Get, url: str, timeout: float, pause: Callable[[float], None] = time.sleep) -> bytes:
    """``get`` with up to TRIES tries and pauses that grow by STEP; the last failure is raised."""
    for n in range(1, TRIES + 1):
        try:
            return get(url, timeout)
        except OSError:
            if n == TRIES:
                raise
            pause(STEP * n)
    raise AssertionError


def text_address(metadata: dict) -> str | None:
    """The first plain-text format of a metadata record that is no archive."""
    return next((url for kind, url in (metadata.get("formats") or {}).items() if kind.startswith("text/plain") and "zip" not in kind), None)


def fetched_books(ids: DataFrame, get: Get = http_get, pause: Callable[[float], None] = time.sleep, address: str = METADATA) -> DataFrame:
    """(gutenberg_id, metadata JSON, text, error) for each gutenberg_id; workers fetch, a failure is its row's error."""
    let_import(ids.sparkSession)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["gutenberg_id"]:
                found: dict[str, object] = {"gutenberg_id": int(i), "metadata": None, "text": None, "error": None}
                try:
                    raw = patient(get, address.format(id=int(i)), 60, pause)
                    found["metadata"] = raw.decode("utf-8")
                    if (url := text_address(json.loads(raw))) is None:
                        found["error"] = "no_plain_text"
                    else:
                        found["text"] = patient(get, url, 90, pause).decode("utf-8").replace("\r\n", "\n")
                except (OSError, ValueError) as e:
                    found["error"] = type(e).__name__
                yield pd.DataFrame([found], dtype=object)

    return ids.select("gutenberg_id").mapInPandas(fetch, "gutenberg_id long, metadata string, text string, error string")
