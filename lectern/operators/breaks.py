"""Break games and clocks: seeded shuffles, rotation, the phase machine, word play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (phase, action) -> next phase; other actions change nothing. How a game may have ended.
PHASES = {
    ("idle", "MARK_DUE"): "due", ("due", "CANCEL_DUE"): "idle", ("due", "SHOW_OFFER"): "offered", ("offered", "ACCEPT"): "playing",
    ("offered", "DECLINE"): "idle", ("playing", "FINISH"): "ended", ("ended", "DONE"): "idle",
}
OUTCOMES = ("solved", "shown_solution", "skipped", "time_cap")
MIN_ROUNDS, MAX_ROUNDS = 3, 4


def phase(actions: Column) -> Column:
    """Struct of phase and outcome after an array of actions (type, outcome), starting idle: a fold over a lookup.

    FINISH counts only with a known outcome, which stays until the machine is idle again.
    """
    table = F.create_map(*[F.lit(x) for (p, e), n in PHASES.items() for x in (f"{p}:{e}", n)])

    def step(s: Column, a: Column) -> Column:
        valid = (a["type"] != "FINISH") | F.coalesce(a["outcome"].isin(*OUTCOMES), F.lit(False))
        after = F.when(valid, table[F.concat_ws(":", s["phase"], a["type"])])
        outcome = F.when(after.isNull(), s["outcome"]).when(after == "ended", a["outcome"])
        return F.struct(F.coalesce(after, s["phase"]).alias("phase"), outcome.alias("outcome"))

    return F.aggregate(actions, F.struct(F.lit("idle").alias("phase"), F.lit(None).cast("string").alias("outcome")), step)


def round_count(multi_round: Column, seed: Column) -> Column:
    """Rounds of a break: one, or three to four by the seed for games of several rounds."""
    return F.when(F.coalesce(multi_round, F.lit(False)), MIN_ROUNDS + F.floor(seed / 2) % (MAX_ROUNDS - MIN_ROUNDS + 1)).otherwise(1).cast("int")


def round_seed(seed: Column, number: Column) -> Column:
    """The seed of a round, counted from 0: one after the other, in 32 bits."""
    return (seed + number).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def mulberry32(seed: int):
    """The 32-bit generator of numbers in [0, 1) that seeded games use."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def shuffled(items: list, seed) -> list:
    """A Fisher-Yates shuffle from a seed, or from a generator that goes on."""
    draw, out = seed if callable(seed) else mulberry32(seed), list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def next_game(games: list[str], bag: list[str], last: str | None, draw) -> tuple[str, list[str]]:
    """The next game and what is left in the bag, from what a reader's state holds.

    Games that are gone leave the bag; an empty one is filled and shuffled anew, and does not start with the last game.
    """
    left = [g for g in bag if g in games]
    if not left:
        left = shuffled(games, draw)
        if len(games) > 1 and left[0] == last:
            left = [*left[1:], left[0]]
    return left[0], left[1:]


def rotation(games: list[str], rounds: int, seed: int) -> list[str]:
    """Games from shuffled bags: none comes again before its bag is empty, nor twice in a row across bags."""
    out: list[str] = []
    bag: list[str] = []
    draw = mulberry32(seed)
    for _ in range(rounds):
        game, bag = next_game(games, bag, out[-1] if out else None, draw)
        out.append(game)
    return out


def one_letter_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of different words of equal length that differ in one letter.

    Each word gives a key for each letter with that letter masked, so equal keys meet by hash; no pair of unlike words
    is made.
    """
    keys = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).withColumn("key", F.concat(F.expr("left(word, i - 1)"), F.lit("_"), F.expr("substr(word, i + 1)")))
    a, b = keys.select(F.col("word").alias("a"), "key"), keys.select(F.col("word").alias("b"), "key")
    return a.join(b, "key").filter("a < b").select("a", "b").distinct()


def anagram_key(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(word), "")), "")


def ladder(pairs: DataFrame, start: str, most: int = 8) -> DataFrame:
    """(word, steps) reached from ``start`` by one-letter changes, level by level, each word once."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = pairs.sparkSession.createDataFrame([(start, 0)], "word string, steps int")
    frontier = seen
    for step in range(1, most + 1):
        found = frontier.join(both, frontier["word"] == both["a"]).select(F.col("b").alias("word")).distinct().join(seen, "word", "left_anti")
        frontier = found.withColumn("steps", F.lit(step))
        seen = seen.unionByName(frontier)
    return seen


def parse_hex(colour: Column) -> Column:
    """A colour as #rrggbb in lower case, from three or six digits; null if it is none."""
    c = F.lower(F.trim(colour))
    return F.when(c.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(c, "([0-9a-f])", "$1$1")).when(c.rlike("^#[0-9a-f]{6}$"), c)


def _channel(colour: Column, i: int) -> Column:
    return F.conv(F.substring(colour, 2 * i, 2), 16, 10).cast("int")


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    red, green, blue = (linear(_channel(colour, i) / 255) for i in (1, 2, 3))
    return 0.2126 * red + 0.7152 * green + 0.0722 * blue


def blend(a: Column, b: Column, share: Column) -> Column:
    """The colour that lies ``share`` (0 to 1) of the way from one #rrggbb to another, channels rounded half up."""
    k = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    part = lambda i: F.lower(F.lpad(F.hex(F.floor(_channel(a, i) + (_channel(b, i) - _channel(a, i)) * k + 0.5).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(1), part(2), part(3))


def readable_on(ground: Column) -> Column:
    """White or black, whichever stands out more."""
    return F.when(contrast(F.lit("#ffffff"), ground) >= contrast(F.lit("#000000"), ground), "#ffffff").otherwise("#000000")


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def palette_check(text: Column, ground: Column) -> Column:
    """ok, warn or refuse by contrast."""
    c = contrast(text, ground)
    return F.when(c >= 4.5, "ok").when(c >= 3, "warn").otherwise("refuse")
