"""Questions that filter, sort and cut one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.functions.filters import (
    at_least,
    at_most,
    contains_text,
    number_equals,
    same_text,
    top_rows,
    upper_equals,
    where_all,
)
from downfield.functions.labels import shorten

# The columns of each answer, in their order.
SCHEDULE_COLUMNS = [
    "game_id", "season", "week", "game_type", "gameday", "gametime", "away_team", "home_team", "away_score",
    "home_score", "result", "overtime", "spread_line", "total_line", "div_game", "roof", "surface", "temp",
    "wind", "away_coach", "home_coach", "referee", "stadium",
]
ROSTER_COLUMNS = [
    "full_name", "position", "depth_chart_position", "team", "season", "jersey_number", "status", "years_exp",
    "college", "height", "weight",
]
INJURY_COLUMNS = [
    "full_name", "position", "team", "season", "week", "report_primary_injury", "report_secondary_injury",
    "report_status", "practice_primary_injury", "practice_secondary_injury", "practice_status",
]
SNAP_COLUMNS = [
    "player", "position", "team", "opponent", "season", "week", "game_type", "offense_snaps", "offense_pct",
    "defense_snaps", "defense_pct", "st_snaps", "st_pct",
]
OPPORTUNITY_COLUMNS = [
    "season", "week", "posteam", "full_name", "position", "player_id", "rec_attempt", "rush_attempt",
    "rec_air_yards", "receptions", "receptions_exp", "rec_yards_gained", "rush_yards_gained", "rec_touchdown",
    "rush_touchdown", "total_fantasy_points", "total_fantasy_points_exp", "total_fantasy_points_diff",
    "rec_attempt_team", "rush_attempt_team",
]
# output column -> source column
RANKING_COLUMNS = {
    "draft": {
        "player": "player", "position": "pos", "team": "team", "ecr": "ecr", "sd": "sd", "best": "best",
        "worst": "worst", "bye": "bye", "ranking_set": "page_type", "ecr_type": "ecr_type",
        "scrape_date": "scrape_date",
    },
    "week": {
        "player": "player_name", "position": "pos", "team": "team", "rank": "rank", "ecr": "ecr", "sd": "sd",
        "best": "best", "worst": "worst", "pos_rank": "pos_rank", "opponent": "player_opponent",
        "bye": "player_bye_week", "start_sit_grade": "start_sit_grade", "note": "note", "ranking_set": "page",
        "scrape_date": "scrape_date",
    },
}
TD_LUCK_COLUMNS = [
    "player_id", "full_name", "position", "team", "season", "rec_td", "rec_td_exp", "rec_td_luck", "rush_td",
    "rush_td_exp", "rush_td_luck", "total_td_luck_score",
]
ROLE_TREND_COLUMNS = [
    "player_id", "full_name", "position", "team", "season", "week", "snap_pct", "target_share_pct",
    "carry_share_pct", "air_yards_share_pct", "snap_pct_3wk", "target_share_pct_3wk", "carry_share_pct_3wk",
    "air_yards_share_pct_3wk", "snap_pct_delta", "target_share_pct_delta", "carry_share_pct_delta",
    "air_yards_share_pct_delta",
]
SEPARATION_COLUMNS = [
    "player_id", "full_name", "position", "team", "season", "games", "fp_diff", "fp_diff_per_game", "td_luck",
    "catch_luck", "target_share_pct", "air_yards_share_pct", "avg_separation", "avg_yac_above_expectation",
    "catch_percentage", "regression_candidate",
]
DROP_RATE_COLUMNS = [
    "player_id", "player", "team", "season", "catchable_targets", "drops", "drop_rate_pct",
    "contested_targets", "created_receptions",
]
CONTRACT_COLUMNS = [
    "player_id", "full_name", "position", "team", "season", "apy", "cap_pct", "total_fp", "total_fp_exp",
    "fp_per_million",
]
INJURY_RETURN_COLUMNS = [
    "injury_type", "position", "week_post_return", "avg_snap_pct_recovery", "median_snap_pct_recovery",
    "sample_size",
]


def schedule(
    games: DataFrame,
    team: str | None = None,
    season: int | None = None,
    week: int | None = None,
    season_type: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Games and results; a team matches at home and away, `season_type` is the game type."""
    plays_in = (F.col("home_team") == team.upper()) | (F.col("away_team") == team.upper()) if team is not None else None
    found = where_all(
        games,
        [plays_in, number_equals("season", season), number_equals("week", week), upper_equals("game_type", season_type)],
    )
    return top_rows(found, [F.asc_nulls_last("season"), F.asc_nulls_last("week")], SCHEDULE_COLUMNS, limit)


def roster(
    rosters: DataFrame, team: str | None = None, season: int | None = None, position: str | None = None, limit: int | None = None
) -> DataFrame:
    found = where_all(
        rosters, [upper_equals("team", team), number_equals("season", season), same_text("position", position)]
    )
    order = [F.asc_nulls_last("position"), F.asc_nulls_last("full_name")]
    return top_rows(found, order, ROSTER_COLUMNS, limit)


def injury_report(
    injuries: DataFrame,
    team: str | None = None,
    season: int | None = None,
    week: int | None = None,
    player: str | None = None,
    report_status: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    found = where_all(
        injuries,
        [
            upper_equals("team", team),
            number_equals("season", season),
            number_equals("week", week),
            contains_text("full_name", player),
            contains_text("report_status", report_status),
        ],
    )
    order = [F.asc_nulls_last(c) for c in ("season", "week", "team", "full_name")]
    return top_rows(found, order, INJURY_COLUMNS, limit)


def snap_counts(
    snaps: DataFrame,
    player: str | None = None,
    team: str | None = None,
    season: int | None = None,
    week: int | None = None,
    position: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Snaps per player and game; the name is searched as given and in its short form."""
    named = None
    if player:
        named = F.col("player").ilike(f"%{player}%") | F.col("player").ilike(f"%{shorten(player)}%")
    found = where_all(
        snaps,
        [
            named,
            upper_equals("team", team),
            number_equals("season", season),
            number_equals("week", week),
            same_text("position", position),
        ],
    )
    order = [F.asc_nulls_last(c) for c in ("season", "week", "team")] + [F.desc_nulls_last("offense_snaps")]
    return top_rows(found, order, SNAP_COLUMNS, limit)


def fantasy_opportunity(
    opportunity: DataFrame,
    player: str | None = None,
    team: str | None = None,
    season: int | None = None,
    week: int | None = None,
    position: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    found = where_all(
        opportunity,
        [
            contains_text("full_name", player),
            upper_equals("posteam", team),
            number_equals("season", season),
            number_equals("week", week),
            same_text("position", position),
        ],
    )
    order = [F.desc_nulls_last(c) for c in ("season", "week", "total_fantasy_points_exp")]
    return top_rows(found, order, OPPORTUNITY_COLUMNS, limit)


def ranking_scope(scope: str | None) -> str:
    """The table a ranking question reads: draft or week."""
    name = (scope or "draft").lower()
    if name not in RANKING_COLUMNS:
        raise ValueError(f"No rankings of scope {scope!r}; there are {', '.join(RANKING_COLUMNS)}")
    return name


def fantasy_rankings(
    rankings: DataFrame,
    player: str | None = None,
    position: str | None = None,
    team: str | None = None,
    scope: str = "draft",
    ranking_set: str | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Expert consensus rankings, best (lowest ecr) first; `rankings` is the table of the scope."""
    columns = RANKING_COLUMNS[ranking_scope(scope)]
    renamed = rankings.select(*[F.col(source).alias(name) for name, source in columns.items()])
    found = where_all(
        renamed,
        [
            contains_text("player", player),
            same_text("position", position),
            upper_equals("team", team),
            contains_text("ranking_set", ranking_set),
        ],
    )
    return top_rows(found, [F.asc_nulls_last("ecr")], list(columns), limit)


def _player_rows(table: DataFrame, player, position, team, season) -> DataFrame:
    return where_all(
        table,
        [
            contains_text("full_name", player),
            same_text("position", position),
            upper_equals("team", team),
            number_equals("season", season),
        ],
    )


def td_luck_report(
    luck: DataFrame,
    player: str | None = None,
    position: str | None = None,
    team: str | None = None,
    season: int | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Unluckiest players first."""
    found = _player_rows(luck, player, position, team, season)
    return top_rows(found, [F.asc_nulls_last("total_td_luck_score")], TD_LUCK_COLUMNS, limit)


def role_trend_report(
    trend: DataFrame,
    player: str | None = None,
    position: str | None = None,
    team: str | None = None,
    season: int | None = None,
    week: int | None = None,
    min_snap_pct: float | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Largest gain in snap share first."""
    found = where_all(
        _player_rows(trend, player, position, team, season),
        [number_equals("week", week), at_least("snap_pct", min_snap_pct)],
    )
    return top_rows(found, [F.desc_nulls_last("snap_pct_delta")], ROLE_TREND_COLUMNS, limit)


def separation_report(
    separation: DataFrame,
    player: str | None = None,
    position: str | None = None,
    team: str | None = None,
    season: int | None = None,
    regression_candidate: bool | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Largest shortfall of fantasy points per game first; tracking data begins in 2016."""
    if season is not None and int(season) < 2016:
        raise ValueError(f"No receiver was tracked in {season}, the first season is 2016")
    found = _player_rows(separation, player, position, team, season)
    if regression_candidate is not None:
        found = found.where(F.col("regression_candidate") == bool(regression_candidate))
    return top_rows(found, [F.asc_nulls_last("fp_diff_per_game")], SEPARATION_COLUMNS, limit)


def drop_rate_report(
    drops: DataFrame,
    player: str | None = None,
    team: str | None = None,
    season: int | None = None,
    min_targets: int | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Highest drop rate first; charting begins in 2022."""
    if season is not None and int(season) < 2022:
        raise ValueError(f"No drops were charted in {season}, the first season is 2022")
    found = where_all(
        drops,
        [
            contains_text("player", player),
            upper_equals("team", team),
            number_equals("season", season),
            at_least("catchable_targets", min_targets),
        ],
    )
    return top_rows(found, [F.desc_nulls_last("drop_rate_pct")], DROP_RATE_COLUMNS, limit)


def contract_value_report(
    values: DataFrame,
    player: str | None = None,
    position: str | None = None,
    team: str | None = None,
    season: int | None = None,
    min_apy: float | None = None,
    max_apy: float | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Most fantasy points per million first."""
    found = where_all(
        _player_rows(values, player, position, team, season), [at_least("apy", min_apy), at_most("apy", max_apy)]
    )
    return top_rows(found, [F.desc_nulls_last("fp_per_million")], CONTRACT_COLUMNS, limit)


def injury_return_report(
    curve: DataFrame,
    injury_type: str | None = None,
    position: str | None = None,
    week_post_return: int | None = None,
    limit: int | None = 50,
) -> DataFrame:
    found = where_all(curve, [contains_text("injury_type", injury_type), upper_equals("position", position)])
    if week_post_return is not None:
        found = found.where(F.col("week_post_return") == int(week_post_return))
    order = [F.asc_nulls_last(c) for c in ("week_post_return", "injury_type", "position")]
    return top_rows(found, order, INJURY_RETURN_COLUMNS, limit)
