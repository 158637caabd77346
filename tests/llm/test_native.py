"""Quality rules, personal data and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import fingerprints, pii, quality
from lectern.llm.common import WORD_GAP

from .conftest import awkward_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text: str | None) -> tuple[int, ...]:
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, sf_dir, awkward):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows, df in (([(r.doc_id, r.text) for r in docs.collect()], docs), ([(r[0], r[1]) for r in awkward_rows()], awkward)):
        got = quality.quality_rules(df).collect()
        assert Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == Counter((i, *brute_counts(t)) for i, t in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_repeats_are_exact_in_long_texts(spark):
    """So many windows that the bits left of their hashes agree by chance; words decide."""
    rng = random.Random(3)
    rows = [(0, " ".join(str(rng.randrange(10**9)) for _ in range(200_000))), (1, " ".join(str(rng.randrange(60)) for _ in range(60_000))), (2, "a b c a b c a b c d"), (3, "x x x x"), (4, "a b a b")]
    got = {r.doc_id: r.n for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", quality.base_features(F.col("text"))["n_repeat_words"].alias("n")).collect()}
    for i, text in rows:
        w = text.split()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        assert got[i] == len({i + k for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[t] > 1 for k in range(3)})


def test_quality_threshold_follows_the_group(spark):
    """The same text is fine where symbols are usual and out of range where they are not."""
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(100)), "en", "plain", 0) for i in range(80)]
    coded = [(100 + i, " ".join(f"w{i}x{j}{'|' if j % 2 else ''}" for j in range(100)), "en", "code", 0) for i in range(80)]
    odd = (500, " ".join(f"q{j}{'|' if j % 2 else ''}" for j in range(100)), "en", "plain", 0)
    docs = spark.createDataFrame([*plain, *coded, odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert not kept[500]
    assert all(v for i, v in kept.items() if i != 500)


def test_buckets_have_five_significant_bits(spark):
    rows = spark.range(1, 5000).select(F.col("id").alias("v"), quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.v and (r.v - r.b) * 16 < max(r.v, 16) for r in rows)
    assert all(r.b == r.v for r in rows if r.v < 32)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text: str | None) -> str:
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TRICKY = [
    "a@b.c%d@e.f x@y.z.w", "a@b.c._d@e.f @@a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 007.01.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  111111111111", "4111111111111111-4111111111111111",
    "+1 (017) 555-7713 and +12 +123456789 + 5 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "\U0001f600 é a@b.cd 中 10.0.0.1", "9" * 3000, "1 " * 20_000, "a" * 20_000 + "@", "00000000000000", "x@y", "1.1.1.1@a.b+1 22 333 4444 55",
]


def test_base_spans(spark, sf_dir, awkward):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (docs, tricky, awkward.select("doc_id", "text")):
        rows = df.select("text", "doc_id").collect()
        want = Counter((r.doc_id, hashlib.sha256(brute_spans(r.text).encode()).hexdigest()) for r in rows)
        got = pii.pii_report(df).collect()
        assert Counter((r.doc_id, r.base_sha256) for r in got) == want
        assert Counter((r.doc_id, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in got) == Counter((r.doc_id, len([x for x in brute_spans(r.text).split(",") if x])) for r in rows)


def test_added_spans_need_checksum_or_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 end", "iban DE88 3704 0044 0532 0130 00 end", "ssn 123-45-6789 here", "lot 123-45-6789 here", "call (212) 555-0123 now", "part 212-555-0123 now", "GB82WEST12345698765432"]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = {i: [x.split(":")[0] for x in s.split(",") if x] for i, s in got.items()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["local_phone"], 5: [], 6: ["iban"]}


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["BE68 5390 0754 7034", "to BE68 5390 0754 7034 2024 rest", "LT12 1000 0111 0100 1000 EUR", "BE68539007547034 BIC GEBABEBB", "SE4550000000058398257466 SWIFT", "NO93 8601 1117 947", "BE69 5390 0754 7034", "XX68 5390 0754 7034", "MT84 MALT 0110 0001 2345 MTLC AST0 01S x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.find_spans(F.col("text")).alias("s")).collect()
    found = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.s if x.kind == "iban"] for r in rows}
    assert found == {0: [texts[0]], 1: [texts[0]], 2: ["LT12 1000 0111 0100 1000"], 3: ["BE68539007547034"], 4: ["SE4550000000058398257466"], 5: [texts[5]], 6: [], 7: [], 8: [texts[8][:-2]]}


def test_context_words_of_four_languages(spark):
    texts = ["téléphone 212-555-0123", "llamar al 212-555-0123", "Anruf 212-555-0123", "mobile 212-555-0123", "pièce 212-555-0123"]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [bool(got[i]) for i in range(5)] == [True, True, True, True, False]


def test_redaction_takes_every_span_and_nothing_else(spark, awkward):
    text = "write a.b@c.de or +1 (017) 555-7713 from 10.0.0.1 today"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "clean", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "write [EMAIL] or [PHONE] from [IP] today"
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean"
    assert pii.redact(awkward).count() == awkward.count()


def brute_edited(rows: list[tuple]) -> Counter:
    t = sorted(((i if i is not None else -(1 << 63)), x or "") for i, x in rows)
    out = Counter()
    for k, (i, x) in enumerate(t):
        after = t[(k + 1) % len(t)][1]
        half = len(x) // 2
        out[(i, hashlib.sha256((x[: len(x) - half] + after[:half]).encode()).hexdigest())] += 1
    return out


def test_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fingerprints.fingerprint_report(docs).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == brute_edited(rows)
    texts = dict(rows)
    by_text: dict[str, set] = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.n_chars == len(texts[r.doc_id])
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in got if len(texts[r.doc_id].split()) >= 30]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.98 * len(long)


def test_fingerprints_of_awkward_rows(spark, awkward, nothing):
    got = fingerprints.fingerprint_report(awkward).collect()
    assert len(got) == len(awkward_rows())
    # ids decide the order where they differ; here equal ids are equal texts or the null ids
    want = brute_edited([(r[0], r[1]) for r in awkward_rows() if r[0] is not None])
    assert sum((Counter((r.doc_id, r.edited_sha256) for r in got if r.doc_id not in (None, 10)) - want).values()) == 0
    assert fingerprints.fingerprint_report(nothing).count() == 0
    one = fingerprints.fingerprint_report(awkward.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 2)
    rows = [(1, "one two three four"), *[(2, " ".join(f"w{i}" for i in range(40)))] * 7, (3, "the last one here"), (4, None), (4, ""), (4, "")]
    got = fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == brute_edited([(i, t or "") for i, t in rows])
    assert sorted(r.near_next for r in got if r.doc_id == 2) == [0.0] + [1.0] * 6 and len({r.fingerprint for r in got if r.doc_id == 2}) == 1


def test_signatures_equal_a_relational_version(spark, sf_dir, awkward):
    """The same definition as rows: k-mers exploded, numbered by windows, the two least of each bin paired."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(awkward.filter("doc_id <> 8").select("text")).distinct()
    docs = docs.withColumn("i", F.xxhash64("text")).cache()
    w = docs.select("i", F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_GAP), "").alias("w")).filter(F.size("w") > 0)
    grams = w.select("i", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0)))).alias("p"))
    ids = grams.select("i", "p", F.shiftright(F.xxhash64(*[F.get("w", F.col("p") + j) for j in range(5)]), 24).alias("id"))
    numbered = ids.withColumn("occ", (F.row_number().over(Window.partitionBy("i", "id").orderBy("p")) - 1).cast("int"))
    keyed = numbered.withColumn("key", F.xxhash64("id", "occ")).select("i", "p", F.shiftright("key", 24).alias("k"), F.shiftright("key", 58).alias("bin"))
    least = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("i", "bin").orderBy("k", "p"))).filter("rn <= 2")
    paired = least.groupBy("i", "bin").agg(F.sort_array(F.collect_list(F.struct("p", "k"))).alias("t"))
    one = F.when(F.size("t") == 1, F.hash("bin", F.col("t")[0]["k"])).otherwise(F.hash("bin", F.col("t")[0]["k"], F.get("t", F.lit(1))["k"]))
    want = {r.i: sorted(r.s) for r in paired.groupBy("i").agg(F.collect_list(one).alias("s")).collect()}
    got = {r.i: sorted(r.s) for r in docs.select("i", fingerprints.signatures(F.col("text")).alias("s")).collect()}
    assert {i: s for i, s in got.items() if s} == want


def test_order_and_repeats_matter(spark):
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w), " ".join(w[200:] + w[:200]), " ".join(reversed(w)), " ".join(w * 2), " ".join(w[:390])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", fingerprints.signatures(F.col("text")).alias("s"))
    a = rows.filter("i = 0").select(F.col("s").alias("a"))
    like = {r.i: r.x for r in rows.join(F.broadcast(a)).select("i", fingerprints.likeness(F.col("a"), F.col("s")).alias("x")).collect()}
    assert like[0] == 1.0 and like[4] > 0.8 and like[2] == 0.0
    assert like[1] < 0.75 and like[3] < 0.75


def test_empty_tables(nothing):
    assert quality.quality_rules(nothing).count() == 0
    assert pii.pii_report(nothing).count() == 0
    assert pii.redact(nothing).count() == 0
