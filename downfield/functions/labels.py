"""Labels: game situation, formation, injury type, short player names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def situation_label(
    down: str = "down",
    to_go: str = "ydstogo",
    yardline: str = "yardline_100",
    quarter: str = "qtr",
    clock: str = "time",
) -> Column:
    """The first situation a play falls in; the order of the rules matters."""
    down_, to_go_, clock_ = F.col(down), F.col(to_go), F.col(clock)
    minutes = F.split(clock_, ":")[0].try_cast("int")
    return (
        F.when(down_ == 4, "4th Down")
        .when((down_ == 3) & (to_go_ >= 7), "3rd & Long")
        .when((down_ == 3) & (to_go_ <= 3), "3rd & Short")
        .when(F.col(yardline) <= 20, "Red Zone")
        .when((F.col(quarter) == 4) & clock_.rlike("^[0-9]+:[0-9]+") & (minutes < 2), "Two Minute Drill")
        .otherwise("Standard")
    )


def formation_label(shotgun: str = "shotgun", no_huddle: str = "no_huddle") -> Column:
    in_shotgun, hurried = F.col(shotgun) == 1, F.col(no_huddle) == 1
    return (
        F.when(in_shotgun & hurried, "SHOTGUN NO HUDDLE")
        .when(in_shotgun, "SHOTGUN")
        .when(hurried, "NO HUDDLE")
        .otherwise("UNDER CENTER")
    )


# Body part searched in the report text -> injury type, first match wins.
INJURY_TYPES = {
    "hamstring": "hamstring",
    "knee": "knee",
    "ankle": "ankle",
    "shoulder": "shoulder",
    "concussion": "concussion",
    "groin": "groin",
    "foot": "foot",
    "calf": "calf",
    "hip": "hip",
    "back": "back",
    "quad": "quadriceps",
    "achilles": "achilles",
    "wrist": "wrist",
    "hand": "hand",
    "elbow": "elbow",
    "toe": "toe",
    "thigh": "thigh",
    "neck": "neck",
    "rib": "ribs",
    "pectoral": "pectoral",
}


def injury_type(report: Column) -> Column:
    """Injury type of a free-text report such as ' right Knee '."""
    text = F.lower(F.trim(report))
    (first_part, first_name), *others = INJURY_TYPES.items()
    found = F.when(text.contains(first_part), first_name)
    for part, name in others:
        found = found.when(text.contains(part), name)
    return found.otherwise("other")


def short_name(name: Column) -> Column:
    """'Justin Jefferson' -> 'J.Jefferson'; one word, or a dotted first word, stays as it is."""
    words = F.split(F.trim(name), r"\s+")
    first = words[0]
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    is_full = (F.size(words) > 1) & ~first.contains(".")
    return F.when(is_full, F.concat(first.substr(1, 1), F.lit("."), rest)).otherwise(name)


def shorten(name: str) -> str:
    """`short_name` for a name given as an argument."""
    first, *rest = name.split() or [name]
    return f"{first[0]}.{' '.join(rest)}" if rest and "." not in first else name
