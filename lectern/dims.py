"""Closed lists and tunables. Results depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

THEMES = (
    "mystery_detection", "romance", "grief_loss_death", "fear_supernatural", "adventure_travel", "war_conflict", "family_childhood",
    "class_money", "gender_womens_roles", "justice_morality", "nature_place", "identity_self", "humour_satire", "madness_mind",
)
RESEARCH_TAGS = ("problem_motivation", "claim", "method", "dataset", "result", "limitation", "definition", "future_work", "related_work")
MIN_SHOWN_SCORE, MAX_THEMES = 3, 3
READABLE_KINDS = ("abstract", "body", "appendix")
PACE_MIN_MS, PACE_MAX_MS, PACE_MIN_WORDS, PACE_MAX_WPM = 5_000, 7_200_000, 50, 2_000
PACE_RECENT, PACE_ROLLING, PACE_FETCH, PACE_BAND, DEFAULT_WPM = 3, 20, 40, 0.05, 200
SIZE_LEVELS = ((15, 3), (5, 2))
RECAP_SHORT_HOURS, RECAP_LONG_HOURS, RECAP_CHAPTERS = 24, 168, 3
NUDGE_AWAY_DAYS = 3
SUMMARY_CHARS = 240
STREAK_MILESTONES = (3, 7, 14)
QUIZ_EVERY = 3
BREAK_AFTER_MS, BREAK_AWAY_MS, BREAK_MAX_OFFERS, BREAK_MAX_ADD_MS = 600_000, 300_000, 3, 7_200_000
CLAIM_MINUTES, FAILURE_MINUTES, PREFETCH_AHEAD = 20, 15, 4
TOKENS_PER_CHUNK = 1400
CONTEXT_CHARS, MAX_SPAN = 40, 2000
SHELF_CAP, SHELF_BOOKS_CAP, SHELF_NAME_CHARS = 20, 200, 40


def theme_dim(spark: SparkSession) -> DataFrame:
    """theme, ordinal of the closed list."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(THEMES)], "theme string, ordinal int")
