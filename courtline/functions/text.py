"""Column builders for names, opponents, scores and play text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_opponent(text: Column) -> Column:
    """Without a leading @ and a venue after the name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^@\s*", ""), r"\s+@.*$", ""))


def name_key(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def swapped(text: Column) -> Column:
    """'Last, First' as 'First Last'."""
    parts = F.split(text, ",", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(text)


def name_key_swapped(text: Column) -> Column:
    return name_key(swapped(text))


def letters_key(text: Column) -> Column:
    """'Last, First' swapped, letters only, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(swapped(text), "[^A-Za-z ]", " "), r"\s+", " ")))


def score_part(score: Column, side: int) -> Column:
    """A side's points in a score 'a-b', null if it is none."""
    return F.regexp_extract(score, r"^\s*(\d+)\s*-\s*(\d+)\s*$", side + 1).try_cast("int")


def number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def first_match(text: Column, patterns: Sequence[tuple[str, str]], other: str = "Other") -> Column:
    """The label of the first pattern that text has."""
    out = F.lit(other)
    for label, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


# The kinds of a scored play and the phrases that tell them, in the order in which they count.
PLAYS = [
    ("Ace", "service ace"),
    ("Service error", "service error"),
    ("Attack error", "attack error"),
    ("Block error", "block error|blocking error"),
    ("Set error", "bad set|set error"),
    ("Ball handling error", "ball handling error"),
    ("Dig error", "dig error"),
    ("Kill", "kill"),
    ("Block", "block"),
]


def play_kind(text: Column) -> Column:
    """The kind of a play by its text: the first whose phrase stands in it as whole words, in any case; Other if none does."""
    return first_match(text, [(kind, rf"(?i)\b({phrase})\b") for kind, phrase in PLAYS])


def actor(text: Column) -> Column:
    """The name after 'by': from a capital to a full stop, comma or bracket; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"\bby ([A-Z][^.(,]*)", 1)), F.lit(""))


def kill_parts(text: Column) -> tuple[Column, Column]:
    """Hitter and setter of a kill's text; the setter is null if it is not named."""
    hitter = F.nullif(F.trim(F.regexp_extract(text, r"(?i)kill by ([^.(]+)", 1)), F.lit(""))
    return hitter, F.nullif(F.trim(F.regexp_extract(text, r"\(from ([^)]+)\)", 1)), F.lit(""))


def result_sets(text: Column, side: int) -> Column:
    """Sets of the own side (0) or the other (1) in a result such as 'W 3-1'."""
    return F.regexp_extract(text, r"(\d+)\s*-\s*(\d+)", side + 1).try_cast("int")


def signed_margin(sets_for: Column, sets_against: Column) -> Column:
    """Sets won less sets lost."""
    return (sets_for - sets_against).cast("int")


def result_text(won: Column, sets_for: Column, sets_against: Column) -> Column:
    """'W 3-1' or 'L 1-3'; null where the result is not known."""
    return F.concat(F.when(won, "W ").when(~won, "L "), sets_for.cast("int").cast("string"), F.lit("-"), sets_against.cast("int").cast("string"))


def location(team: Column, home: Column, away: Column, neutral: Column | None = None) -> Column:
    """home, away or neutral from a team's side; null if it is neither side."""
    side = F.when(team == home, "home").when(team == away, "away")
    return side if neutral is None else F.when(F.coalesce(neutral, F.lit(False)) & side.isNotNull(), "neutral").otherwise(side)


def opponent_of(team: Column, home: Column, away: Column) -> Column:
    """The other side; null if the team is neither."""
    return F.when(team == home, away).when(team == away, home)


def legal_final(a: Column, b: Column, points: int = 25) -> Column:
    """Whether a set may end so: points or more, two ahead, and no more than that beyond points."""
    high, margin = F.greatest(a, b), F.abs(a - b)
    return (high >= points) & (margin >= 2) & ((high == points) | (margin == 2))


def position_group(position: Column, groups: dict[str, str]) -> Column:
    """The group of a position label, null if it has none."""
    pairs = [F.lit(x) for kv in groups.items() for x in kv]
    return F.create_map(*pairs)[F.upper(F.trim(position))] if pairs else F.lit(None)
