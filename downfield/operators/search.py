"""Questions over single plays: search, player statistics, player comparison."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.functions.filters import (
    at_least,
    equals,
    number_equals,
    season_conditions,
    top_rows,
    upper_equals,
    where_all,
)
from downfield.functions.labels import shorten
from downfield.functions.numeric import half_up_text, percent_text

PLAYER_COLUMNS = ["passer_player_name", "rusher_player_name", "receiver_player_name"]
# The columns of an answer, in their order.
PLAY_COLUMNS = [
    "season", "week", "posteam", "defteam", "down", "ydstogo", "play_type", "yards_gained", "epa", "desc",
    "passer_player_name", "rusher_player_name", "receiver_player_name", "touchdown", "interception",
]


def names_any(player: str | None) -> Column | None:
    """The play has a passer, rusher or receiver whose name contains the text."""
    if player is None:
        return None
    passer, rusher, receiver = (F.col(c).ilike(f"%{player}%") for c in PLAYER_COLUMNS)
    return passer | rusher | receiver


def _situation(name: str | None) -> Column | None:
    rules = {
        "red_zone": F.col("yardline_100") <= 20,
        "third_down": F.col("down") == 3,
        "fourth_down": F.col("down") == 4,
        "two_minute": (F.col("qtr") == 4) & (F.col("half_seconds_remaining") <= 120),
    }
    return rules.get(name) if name else None


def search_plays(
    plays: DataFrame,
    team: str | None = None,
    opponent: str | None = None,
    player: str | None = None,
    season: int | None = None,
    season_from: int | None = None,
    season_to: int | None = None,
    week: int | None = None,
    season_type: str | None = None,
    play_type: str | None = None,
    situation: str | None = None,
    is_touchdown: bool = False,
    is_turnover: bool = False,
    min_yards: int | None = None,
    max_rows: int | None = 50,
) -> DataFrame:
    """Plays that meet every given filter, those with the largest effect (|epa|) first."""
    found = where_all(
        plays,
        [
            upper_equals("posteam", team),
            upper_equals("defteam", opponent),
            names_any(shorten(player)) if player is not None else None,
            *season_conditions(season, season_from, season_to),
            number_equals("week", week),
            equals("season_type", season_type),
            equals("play_type", play_type),
            _situation(situation),
            F.col("touchdown") == 1 if is_touchdown else None,
            (F.col("interception") == 1) | (F.col("fumble_lost") == 1) if is_turnover else None,
            at_least("yards_gained", min_yards),
        ],
    )
    return top_rows(found, [F.abs("epa").desc_nulls_last()], PLAY_COLUMNS, max_rows)


# stat type -> (player column, play type)
_ROLES = {
    "passing": ("passer_player_name", "pass"),
    "rushing": ("rusher_player_name", "run"),
    "receiving": ("receiver_player_name", "pass"),
}


_CAUGHT = "count_if(complete_pass = 1)"
# stat type -> output column -> aggregate over the player's plays, as SQL text
_STATISTICS = {
    "passing": {
        "attempts": "count(1)",
        "completions": _CAUGHT,
        "comp_pct": percent_text(_CAUGHT, "count(1)", 1),
        "yards": "sum(coalesce(passing_yards, 0))",
        "touchdowns": "count_if(pass_touchdown = 1)",
        "interceptions": "count_if(interception = 1)",
        "avg_epa": half_up_text("avg(epa)", 3),
        "avg_cpoe": half_up_text("avg(cpoe)", 3),
        "air_yards": "sum(coalesce(air_yards, 0))",
        "avg_air_yards": half_up_text("avg(air_yards)", 1),
    },
    "rushing": {
        "carries": "count(1)",
        "yards": "sum(coalesce(rushing_yards, 0))",
        "yards_per_carry": half_up_text("avg(yards_gained)", 1),
        "touchdowns": "count_if(rush_touchdown = 1)",
        "fumbles_lost": "count_if(fumble_lost = 1)",
        "avg_epa": half_up_text("avg(epa)", 3),
        "explosive_runs": "count_if(yards_gained >= 10)",
    },
    "receiving": {
        "targets": "count(1)",
        "receptions": _CAUGHT,
        "yards": "sum(coalesce(receiving_yards, 0))",
        "avg_yac": half_up_text("avg(yards_after_catch)", 1),
        "touchdowns": "count_if(pass_touchdown = 1)",
        "avg_epa": half_up_text("avg(epa)", 3),
        "explosive_plays": "count_if(yards_gained >= 20)",
    },
}


def player_stats(
    plays: DataFrame,
    player_name: str,
    season: int | None = None,
    season_from: int | None = None,
    season_to: int | None = None,
    season_type: str | None = None,
    stat_type: str = "passing",
) -> DataFrame:
    """A player's statistics per season and season type."""
    if stat_type not in _STATISTICS:
        raise ValueError(f"Unknown stat_type {stat_type!r}, known are {', '.join(_STATISTICS)}")
    column, play_type = _ROLES[stat_type]
    own = where_all(
        plays.where((F.col("play_type") == play_type) & F.col(column).ilike(f"%{shorten(player_name)}%")),
        [*season_conditions(season, season_from, season_to), equals("season_type", season_type)],
    )
    return (
        own.groupBy("season", "season_type")
        .agg(*[F.expr(value).alias(name) for name, value in _STATISTICS[stat_type].items()])
        .orderBy(F.asc_nulls_last("season"), F.asc_nulls_last("season_type"))
    )


def compare_players(
    plays: DataFrame,
    player1: str,
    player2: str,
    season: int | None = None,
    season_from: int | None = None,
    season_to: int | None = None,
    season_type: str | None = None,
) -> DataFrame:
    """Passing, rushing and receiving statistics of two players, one row per player, stat type and season.

    Columns a stat type does not have are NULL; a player without plays of a type has no rows for it.
    Each play is marked with the players and stat types it counts for while it is scanned, so the
    comparison is one scan and one grouping, without a join.
    """
    names = list(dict.fromkeys([player1, player2]))
    marks = {
        (name, stat_type): (F.col("play_type") == play_type) & F.col(column).ilike(f"%{shorten(name)}%")
        for name in names
        for stat_type, (column, play_type) in _ROLES.items()
    }
    scoped = where_all(
        plays,
        [
            reduce(or_, marks.values()),
            *season_conditions(season, season_from, season_to),
            equals("season_type", season_type),
        ],
    )
    marked = scoped.withColumn(
        "mark",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(condition, F.struct(F.lit(name).alias("player"), F.lit(stat_type).alias("stat_type")))
                        for (name, stat_type), condition in marks.items()
                    ]
                )
            )
        ),
    )
    grouped = marked.groupBy("mark.player", "mark.stat_type", "season", "season_type").agg(
        *[F.expr(value).alias(f"{t}_{name}") for t, columns in _STATISTICS.items() for name, value in columns.items()]
    )
    outputs = dict.fromkeys(name for columns in _STATISTICS.values() for name in columns)

    def chosen(name: str) -> str:
        cases = [f"WHEN '{t}' THEN {t}_{name}" for t, columns in _STATISTICS.items() if name in columns]
        return f"CASE stat_type {' '.join(cases)} END AS {name}"

    return grouped.selectExpr(
        "player", "stat_type", "season", "season_type", *[chosen(name) for name in outputs]
    ).orderBy("player", "stat_type", F.asc_nulls_last("season"), F.asc_nulls_last("season_type"))
