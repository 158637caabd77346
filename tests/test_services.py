"""Model transport, recaps, fetched books, stored and re-converted books, rotation."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import breaks, models, segment
from lectern.sources import web

GOOD = (200, {}, {"choices": [{"message": {"content": "fine"}}]})


def run(replies, text="secret passage"):
    waits, left, seen = [], list(replies), []

    def post(payload):
        seen.append(payload)
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    call = models.transport(post, lambda t: {"prompt": t}, waits.append)
    try:
        return call(text), waits, seen
    except models.ProviderError as e:
        assert "secret" not in str(e)
        return str(e), waits, seen


def test_transport():
    assert run([GOOD]) == ("fine", [], [{"prompt": "secret passage"}])
    assert run([(200, {}, {"message": {"content": "other shape"}})])[0] == "other shape"
    assert run([(429, {"Retry-After": "7"}, None), (503, {"retry-after": "x"}, None), ConnectionError("secret"), GOOD])[:2] == ("fine", [7.0, 10.0, 15.0])
    assert run([(200, {}, {"error": "overloaded"}), GOOD])[:2] == ("fine", [5.0])
    assert run([(429, {"retry-after": "61"}, None)])[0] == "HTTP 429, retry wanted after 61s"
    assert run([(401, {}, None)])[0] == "HTTP 401"
    assert run([(200, {}, {"choices": []})])[0] == "unexpected response shape"
    assert run([TimeoutError()] * 5)[:2] == ("gave up after 5 attempts (network error (TimeoutError))", [5.0, 10.0, 15.0, 20.0])


def test_final_errors_are_not_tried_again(spark):
    def provider(text):
        raise models.ProviderError("HTTP 401")

    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    assert models.ask(rows, provider, lambda s: 1 / 0).first().error == "HTTP 401"


def test_recaps_and_the_story_so_far(spark):
    def provider(text):
        if "bad" in text:
            raise models.ProviderError("HTTP 400")
        return f"<{text}>"

    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "bad")], "chapter_id int, n int, text string")
    assert {r.chapter_id: r.recap for r in models.recap(chunks, provider).collect()} == {1: "<- <a>\n- <b>>", 2: "<c>", 3: None}
    told = spark.createDataFrame([(1, ["x", "", None, "y"]), (2, []), (3, None)], "id int, recaps array<string>")
    assert {r.id: r.story for r in models.story_so_far(told, provider).collect()} == {1: "<- x\n- y>", 2: "", 3: ""}


def test_fetched_books(spark):
    def get(url, timeout):
        if url.endswith("/1/"):
            return json.dumps({"formats": {"text/plain; zip": "z", "text/plain": "http://t/1"}}).encode()
        if url.endswith("/2/"):
            return b'{"formats": {}}'
        if url == "http://t/1":
            return "Né\r\nhere".encode()
        raise ConnectionError

    waits: list = []
    with pytest.raises(OSError):
        web.patient(get, "http://x", 1, waits.append)
    assert waits == [5.0, 10.0, 15.0, 20.0]
    ids = spark.createDataFrame([(1,), (2,), (3,)], "gutenberg_id long")
    got = {r.gutenberg_id: (r.text, r.error) for r in web.fetched_books(ids, get, lambda s: None).collect()}
    assert got == {1: ("Né\nhere", None), 2: (None, "no_plain_text"), 3: (None, "ConnectionError")}


def book(n):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(150))
    return "\n\n".join(["Contents\n\nChapter I\nChapter II", *[f"CHAPTER {c}\n\n" + "\n\n".join(words(c * 10 + i) for i in range(n)) for c in (1, 2, 3)]])


def test_stored_books(spark):
    chapters, passages = segment.book_content(spark.createDataFrame([(1, book(8))], "doc_id long, text string"))
    story = chapters.filter("section_kind = 'story'").collect()
    assert len(story) == 3 and all(c.summary and c.word_count == 1200 for c in story)
    got = passages.orderBy("chapter_index", "index").collect()
    assert {p.chapter_index for p in got} == {c.chapter_index for c in story} and sum(p.word_count for p in got) == 3600
    for c in story:
        own = [p for p in got if p.chapter_index == c.chapter_index]
        assert [p.is_cliffhanger for p in own] == [False] * (len(own) - 1) + [True] and not own[0].has_prompt and not own[-1].has_prompt


def test_reconverted_books(spark):
    books = spark.createDataFrame([(1, book(4)), (2, "too short"), (3, None)], "doc_id long, text string")
    old = segment.book_content(spark.createDataFrame([(1, "old words here"), (2, "old two"), (9, "another book")], "doc_id long, text string"))
    events = spark.createDataFrame([(1, "e"), (2, "e"), (9, "e")], "doc_id long, kind string")
    status, after = segment.reconverted(books, {"chapters": old[0], "passages": old[1], "events": events})
    assert {r.doc_id: r.status for r in status.collect()} == {1: "ready", 2: "skipped_too_short", 3: "skipped_no_text"}
    assert {r.doc_id for r in after["events"].collect()} == {2, 9}
    texts = {(r.doc_id, r.text) for r in after["chapters"].collect()}
    assert (2, "old two") in texts and (9, "another book") in texts and not any(d == 1 and "old" in t for d, t in texts)
    assert after["passages"].filter("doc_id = 1").agg(F.sum("word_count")).first()[0] == 3 * 4 * 150


def test_rotation_state():
    draw = breaks.mulberry32(5)
    games, bag, last, out = ["a", "b", "c", "d"], [], None, []
    for _ in range(40):
        last, bag = breaks.next_game(games, bag, last, draw)
        out.append(last)
    assert all(sorted(out[i : i + 4]) == games for i in range(0, 40, 4)) and all(x != y for x, y in zip(out, out[1:], strict=False))
    assert breaks.next_game(["a"], ["gone", "a"], "a", draw) == ("a", []) and breaks.next_game(["a"], [], "a", draw) == ("a", [])
