"""Team, situation and formation aggregates over plays, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.functions.filters import season_conditions, where_all
from downfield.functions.labels import formation_label, situation_label
from downfield.functions.numeric import flag_text, half_up_text, percent_text

# The play types that count as plays in the team tables.
COUNTED_PLAY_TYPES = [
    "pass", "run", "field_goal", "extra_point", "punt", "kickoff", "qb_spike", "qb_kneel", "no_play",
]

OFFENSE_DIMENSIONS = ["posteam", "season", "play_type", "situation", "formation", "has_down", "has_shotgun"]


_PASS, _RUSH = "pass_attempt = 1", "rush_attempt = 1"
_CONVERTED = "yards_gained >= ydstogo"
_LOST = "interception = 1 OR fumble_lost = 1"


def _sum_if(value: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN coalesce({value}, 0) ELSE 0 END"


# What one play adds to each total, as SQL text. Every table below is made of ratios of such totals.
MEASURES = {
    "plays": "1",
    "yards": "coalesce(yards_gained, 0)",
    "yards_n": flag_text("yards_gained IS NOT NULL"),
    "rush_plays": flag_text(_RUSH),
    "pass_plays": flag_text(_PASS),
    "rush_yards": _sum_if("yards_gained", _RUSH),
    "rush_yards_n": flag_text(f"{_RUSH} AND yards_gained IS NOT NULL"),
    "pass_yards": _sum_if("yards_gained", _PASS),
    "pass_yards_n": flag_text(f"{_PASS} AND yards_gained IS NOT NULL"),
    "touchdowns": flag_text("touchdown = 1"),
    "sacks": flag_text("sack = 1"),
    "interceptions": flag_text("interception = 1"),
    "turnovers": flag_text(_LOST),
    "third_downs": flag_text("down = 3"),
    "third_downs_made": flag_text(f"down = 3 AND {_CONVERTED}"),
    "third_downs_stopped": flag_text("down = 3 AND yards_gained < ydstogo"),
    "red_zone_plays": flag_text("yardline_100 <= 20"),
    "red_zone_touchdowns": flag_text("yardline_100 <= 20 AND touchdown = 1"),
    "conversions": flag_text(_CONVERTED),
    "explosive_plays": flag_text(f"({_PASS} AND yards_gained >= 20) OR ({_RUSH} AND yards_gained >= 10)"),
    "epa": "coalesce(epa, 0)",
    "epa_n": flag_text("epa IS NOT NULL"),
    "pass_epa": _sum_if("epa", _PASS),
    "pass_epa_n": flag_text(f"{_PASS} AND epa IS NOT NULL"),
    "rush_epa": _sum_if("epa", _RUSH),
    "rush_epa_n": flag_text(f"{_RUSH} AND epa IS NOT NULL"),
}

DEFENSE_MEASURES = [
    "plays", "yards", "yards_n", "sacks", "interceptions", "turnovers",
    "third_downs", "third_downs_stopped", "epa", "epa_n",
]
OFFENSE_MEASURES = [
    "plays", "yards", "yards_n", "rush_plays", "pass_plays", "rush_yards", "rush_yards_n",
    "pass_yards", "pass_yards_n", "touchdowns", "turnovers", "third_downs", "third_downs_made",
    "red_zone_plays", "red_zone_touchdowns", "conversions", "explosive_plays", "epa", "epa_n",
    "pass_epa", "pass_epa_n", "rush_epa", "rush_epa_n",
]


def _measured(measures: list[str]) -> list[Column]:
    return [F.expr(MEASURES[m]).alias(m) for m in measures]


def offense_facts(plays: DataFrame) -> DataFrame:
    """One row per play: the dimensions and measures the offense tables are totals of."""
    return plays.where("posteam IS NOT NULL").select(
        "posteam", "season", "play_type",
        situation_label().alias("situation"),
        formation_label().alias("formation"),
        F.expr("down IS NOT NULL AS has_down"),
        F.expr("shotgun IS NOT NULL AS has_shotgun"),
        *_measured(OFFENSE_MEASURES),
    )


def offense_cube(plays: DataFrame) -> DataFrame:
    """`offense_facts` totalled per dimension cell.

    Its size depends on teams, seasons and labels, not on plays, so one scan of the plays serves the
    three offense tables, which accept the cube in place of the facts.
    """
    return _total(offense_facts(plays), OFFENSE_DIMENSIONS, OFFENSE_MEASURES)


def _total(facts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(*[F.expr(f"sum({m}) AS {m}") for m in measures])


def _mean(total: str, digits: int) -> str:
    return half_up_text(f"{total} / nullif({total}_n, 0)", digits)


def team_offense_of(facts: DataFrame) -> DataFrame:
    """Team offense per season from offense facts or the offense cube."""
    counted = facts.where(F.col("play_type").isin(COUNTED_PLAY_TYPES))
    return _total(counted, ["posteam", "season"], OFFENSE_MEASURES).selectExpr(
        "posteam AS team",
        "season AS season_year",
        "plays AS total_plays",
        "yards AS total_yards",
        f"{_mean('yards', 2)} AS yards_per_play",
        "rush_plays", "pass_plays", "rush_yards", "pass_yards",
        f"{_mean('rush_yards', 2)} AS yards_per_rush",
        f"{_mean('pass_yards', 2)} AS yards_per_pass",
        "touchdowns", "turnovers",
        f"{percent_text('third_downs_made', 'third_downs', 1)} AS third_down_pct",
        f"{percent_text('red_zone_touchdowns', 'red_zone_plays', 1)} AS red_zone_td_pct",
        "explosive_plays",
        f"{_mean('epa', 3)} AS avg_epa",
        f"{_mean('pass_epa', 3)} AS pass_epa",
        f"{_mean('rush_epa', 3)} AS rush_epa",
    )


def team_offense(plays: DataFrame) -> DataFrame:
    return team_offense_of(offense_facts(plays))


def team_defense(plays: DataFrame) -> DataFrame:
    """What each team allowed per season."""
    counted = plays.where(F.col("defteam").isNotNull() & F.col("play_type").isin(COUNTED_PLAY_TYPES))
    facts = counted.select("defteam", "season", *_measured(DEFENSE_MEASURES))
    return _total(facts, ["defteam", "season"], DEFENSE_MEASURES).selectExpr(
        "defteam AS team",
        "season AS season_year",
        "plays AS plays_against",
        "yards AS yards_allowed",
        f"{_mean('yards', 2)} AS yards_per_play_allowed",
        "sacks", "interceptions",
        "turnovers AS turnovers_forced",
        f"{percent_text('third_downs_stopped', 'third_downs', 1)} AS third_down_stop_pct",
        f"{_mean('epa', 3)} AS avg_epa_allowed",
    )


def situational_of(facts: DataFrame) -> DataFrame:
    measures = ["plays", "yards", "yards_n", "touchdowns", "conversions", "epa", "epa_n"]
    return _total(facts.where("has_down"), ["posteam", "season", "situation"], measures).selectExpr(
        "posteam AS team",
        "season AS season_year",
        "situation", "plays",
        f"{_mean('yards', 2)} AS avg_yards",
        "touchdowns",
        f"{percent_text('conversions', 'plays', 1)} AS conversion_pct",
        f"{_mean('epa', 3)} AS avg_epa",
    )


def situational(plays: DataFrame) -> DataFrame:
    """Offense per team, season and game situation."""
    return situational_of(offense_facts(plays))


def formation_effectiveness_of(facts: DataFrame, min_plays: int = 5) -> DataFrame:
    scrimmage = facts.where(F.col("play_type").isin("pass", "run") & F.col("has_shotgun"))
    measures = ["plays", "yards", "yards_n", "touchdowns", "turnovers", "epa", "epa_n"]
    totals = _total(scrimmage, ["posteam", "season", "formation", "play_type"], measures)
    return totals.where(F.col("plays") >= min_plays).selectExpr(
        "posteam AS team",
        "season AS season_year",
        "formation", "play_type", "plays",
        f"{_mean('yards', 2)} AS avg_yards",
        "touchdowns", "turnovers",
        f"{_mean('epa', 3)} AS avg_epa",
    )


def formation_effectiveness(plays: DataFrame) -> DataFrame:
    """Pass and run plays per team, season and formation; groups below five plays are left out."""
    return formation_effectiveness_of(offense_facts(plays))


def team_stats(
    offense: DataFrame,
    defense: DataFrame,
    situations: DataFrame,
    team: str,
    season: int | None = None,
    side: str = "both",
) -> dict[str, DataFrame]:
    """The rows of one team in the team tables; `side` is offense, defense, situational or both."""
    tables = {
        "offense": (offense, ["season_year"]),
        "defense": (defense, ["season_year"]),
        "situational": (situations, ["season_year", "situation"]),
    }
    wanted = season_conditions(season, column="season_year")
    return {
        name: where_all(table.where(F.col("team") == team.upper()), wanted).orderBy(*order)
        for name, (table, order) in tables.items()
        if side in (name, "both")
    }


def compare_teams(
    offense: DataFrame,
    defense: DataFrame,
    team1: str,
    team2: str,
    season: int | None = None,
    season_from: int | None = None,
    season_to: int | None = None,
) -> dict[str, DataFrame]:
    """Offense and defense rows of two teams, ordered by team and season; each table is read once."""
    teams = [team1.upper(), team2.upper()]
    wanted = season_conditions(season, season_from, season_to, column="season_year")
    return {
        name: where_all(table.where(F.col("team").isin(teams)), wanted).orderBy("team", "season_year")
        for name, table in (("offense", offense), ("defense", defense))
    }
