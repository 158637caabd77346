"""The driver's tables seen as the engine's: each adapter is one SQL text that Spark and DuckDB both run.

Where the dialects differ, ``{name}`` placeholders hold the fragment of either; table names are placeholders too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.dims import THEMES

#: fragment -> (Spark, DuckDB)
FRAGMENTS = {
    "lines": (
        "lateral view posexplode(filter(split(text, '\\n'), x -> trim(x) <> '')) e as idx, line",
        "cross join lateral (select unnest(range(len(l))) as idx, unnest(l) as line from (select list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l))",
    ),
    "words": ("size(filter(split(line, ' '), x -> x <> ''))", "len(list_filter(string_split(line, ' '), lambda x: x <> ''))"),
    "theme": (f"element_at(array({', '.join(repr(t) for t in THEMES)}), cast((n * 7) % 14 + 1 as int))", f"([{', '.join(repr(t) for t in THEMES)}])[cast((n * 7) % 14 + 1 as int)]"),
    "k": ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"),
    "day": ("cast(ts as date)", "cast(ts as date)"),
}

ADAPTERS = {
    # one book for each source; some are owned, some are research
    "books": """select cast(substring(source, 4) as int) as book_id, concat('Book ', source) as title, concat('Doe, Jane ', source) as author,
        case when cast(substring(source, 4) as int) % 4 = 3 then cast(substring(source, 4) as int) else null end as owner_user_id,
        case when cast(substring(source, 4) as int) % 5 = 4 then 'research' when cast(substring(source, 4) as int) % 4 = 3 then 'upload' else 'seeded' end as source_type,
        case when cast(substring(source, 4) as int) % 4 = 3 then null else 1000 + cast(substring(source, 4) as int) end as gutenberg_id,
        1800 + cast(substring(source, 4) as int) as published_year, count(*) as n_docs
        from {documents} group by source""",
    "chapters": """select cast(substring(source, 4) as int) as book_id, doc_id as chapter_id, cast(row_number() over (partition by source order by doc_id) - 1 as int) as chapter_index, text, lang,
        case doc_id % 10 when 0 then 'front_matter' when 9 then 'back_matter' else 'story' end as section_kind
        from {documents}""",
    # a passage for each line
    "sessions": """select book_id, chapter_id, chapter_index, section_kind, cast(idx as int) as session_index, line as text, cast({words} as int) as word_count,
        length(line) % 5 = 0 as is_cliffhanger, length(line) % 7 = 0 as has_prompt, chapter_id * 10000 + idx as session_id
        from {chapters} {lines}""",
    "tags": """select session_id, book_id, chapter_id, chapter_index, session_index, {theme} as theme, cast(1 + (n * 2 + 1) % 5 as int) as base, cast(1 + (n * 3) % 5 as int) as score, n
        from (select *, row_number() over (partition by book_id order by chapter_index, session_index) as n from {sessions} where section_kind = 'story') s""",
    # every event is a reading session: k in 0..99 or so gives time, value gives words
    "reads": """select event_id, user_id, ts, event_type, cast(floor(value * 20) as int) as words, ({k} + 1) * 3000 as active_ms, cast(user_id % 20 as int) as book_id, value, {k} as k
        from {events}""",
    "days": "select distinct user_id, {day} as day from {events}",
    # spans on every document, from its start to beyond its end
    "highlights": """select event_id as highlight_id, user_id, (event_id * 31) % (select max(doc_id) + 1 from {documents}) as session_id, cast({k} + (event_id % 150) * 15 as int) as start_at,
        cast({k} + (event_id % 150) * 15 + 1 + cast(floor(value) as int) % 40 as int) as end_at, ts
        from {events}""",
}
_NEEDS = {"sessions": ["chapters"], "tags": ["chapters", "sessions"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's tables, as a lazy plan over the driver's."""
    text = ADAPTERS[name]
    own = {k: v[0] for k, v in FRAGMENTS.items()}
    used = {n: (adapt if n in ADAPTERS else table)(spark, sf_dir, n) for n in ("documents", "events", "chapters", "sessions") if f"{{{n}}}" in text}
    for key, fragment in own.items():
        text = text.replace(f"{{{key}}}", fragment)
    return spark.sql(text, **used)


def with_ctes(sql: str, *names: str) -> str:
    """A DuckDB query over adapted tables, given by name."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    ctes = []
    for n in wanted:
        text = ADAPTERS[n]
        for key, (_, fragment) in FRAGMENTS.items():
            text = text.replace(f"{{{key}}}", fragment)
        for t in ("documents", "events", "chapters", "sessions"):
            text = text.replace(f"{{{t}}}", t)
        ctes.append(f"{n} as ({text})")
    if sql.startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {sql[15:]}"
    head = f"with {', '.join(ctes)}"
    return f"{head}, {sql[5:]}" if sql.startswith("with ") else f"{head} {sql}"
