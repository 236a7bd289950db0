"""The datasets that can be loaded."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the seasons that a request without bounds means
FIRST_SEASON, LAST_SEASON = 2013, 2025


@dataclass(frozen=True)
class Dataset:
    """One source dataset: where its rows go, and which seasons the source covers."""

    dataset_id: str
    table: str
    loader: str
    description: str
    seasonal: bool = True
    min_season: int | None = None
    max_season: int | None = None
    options: dict[str, str] = field(default_factory=dict, compare=False)
    sort_by: tuple[str, ...] = ()

    def outside(self, season: int) -> str | None:
        """Why the source has nothing for the season; None if it is covered."""
        if self.min_season is not None and season < self.min_season:
            return f"not covered, starts in {self.min_season}"
        if self.max_season is not None and season > self.max_season:
            return f"not covered, ends in {self.max_season}"
        return None

    def covers(self, season: int) -> bool:
        return self.outside(season) is None


def _static(dataset_id: str, loader: str, description: str, **options: str) -> Dataset:
    return Dataset(dataset_id, dataset_id, loader, description, seasonal=False, options=options)


def _seasonal(
    dataset_id: str, loader: str, description: str, first: int | None = None, last: int | None = None,
    table: str | None = None, **options: str,
) -> Dataset:
    return Dataset(
        dataset_id, table or dataset_id, loader, description, min_season=first, max_season=last, options=options
    )


# Dataset names, table names, loader names and season windows.
_DATASETS = [
    _static("teams", "load_teams", "Team names, colors and logos"),
    _static("players", "load_players", "Player directory with ids of other sources"),
    _static("contracts", "load_contracts", "Player contracts"),
    _static("trades", "load_trades", "Trades"),
    _static("ff_playerids", "load_ff_playerids", "Player ids across fantasy sources"),
    _static("ff_rankings_draft", "load_ff_rankings", "Fantasy draft rankings", type="draft"),
    _static("ff_rankings_week", "load_ff_rankings", "Fantasy weekly rankings", type="week"),
    _static("combine", "load_combine", "Combine measurements"),
    _static("draft_picks", "load_draft_picks", "Draft picks"),
    _seasonal("pbp", "load_pbp", "Play-by-play, the main fact table", 1999, table="plays"),
    _seasonal("schedules", "load_schedules", "Games and results"),
    _seasonal("rosters", "load_rosters", "Season rosters", 1920),
    _seasonal("player_stats", "load_player_stats", "Weekly player statistics", 1999, summary_level="week"),
    _seasonal("team_stats_raw", "load_team_stats", "Weekly team statistics", 1999, summary_level="week"),
    _seasonal("injuries", "load_injuries", "Weekly injury reports", 2009),
    _seasonal("snap_counts", "load_snap_counts", "Snaps per player and game", 2012),
    _seasonal("rosters_weekly", "load_rosters_weekly", "Weekly rosters", 2002),
    _seasonal("depth_charts", "load_depth_charts", "Weekly depth charts", 2001),
    _seasonal("officials", "load_officials", "Officials per game", 2015),
    _seasonal("participation", "load_participation", "Players on the field per play", 2016, 2024),
    _seasonal("nextgen_stats_passing", "load_nextgen_stats", "Tracking, passing", 2016, stat_type="passing"),
    _seasonal("nextgen_stats_receiving", "load_nextgen_stats", "Tracking, receiving", 2016, stat_type="receiving"),
    _seasonal("nextgen_stats_rushing", "load_nextgen_stats", "Tracking, rushing", 2016, stat_type="rushing"),
    _seasonal("pfr_advstats_pass", "load_pfr_advstats", "Advanced passing", 2018, stat_type="pass"),
    _seasonal("pfr_advstats_rush", "load_pfr_advstats", "Advanced rushing", 2018, stat_type="rush"),
    _seasonal("pfr_advstats_rec", "load_pfr_advstats", "Advanced receiving", 2018, stat_type="rec"),
    _seasonal("pfr_advstats_def", "load_pfr_advstats", "Advanced defense", 2018, stat_type="def"),
    _seasonal("ftn_charting", "load_ftn_charting", "Manual charting per play", 2022),
    _seasonal("ff_opportunity", "load_ff_opportunity", "Weekly fantasy opportunity", 2006, stat_type="weekly"),
]

# Plays are mostly asked for by team and joined by game.
_SORTED = {"pbp": ("posteam", "game_id")}

DATASETS = {d.dataset_id: replace(d, sort_by=_SORTED.get(d.dataset_id, ())) for d in _DATASETS}


def season_range(start: int | None = None, end: int | None = None) -> list[int]:
    """Every season from start to end; a missing bound means the first or last season of a usual load.

    No season is left out here. What a dataset does not cover, `Dataset.outside` tells.
    """
    first = FIRST_SEASON if start is None else int(start)
    last = LAST_SEASON if end is None else int(end)
    if first > last:
        raise ValueError(f"No season lies between {first} and {last}")
    return list(range(first, last + 1))


def windows(spark: SparkSession) -> DataFrame:
    """(dataset_id, table_name, seasonal, min_season, max_season) of every dataset."""
    rows = [(d.dataset_id, d.table, d.seasonal, d.min_season, d.max_season) for d in DATASETS.values()]
    return spark.createDataFrame(rows, "dataset_id string, table_name string, seasonal boolean, min_season int, max_season int")


def window_report(requested: DataFrame) -> DataFrame:
    """The requested (dataset_id, season) pairs with `outcome`: covered, or why no source has the season.

    Requests of a dataset without seasons are covered where they name no season.
    """
    known = windows(requested.sparkSession).withColumnRenamed("dataset_id", "known_id").drop("table_name")
    season, least, most = F.col("season"), F.col("min_season"), F.col("max_season")
    outcome = (
        F.when(F.col("known_id").isNull(), "unknown dataset")
        .when(~F.col("seasonal"), F.when(season.isNull(), "covered").otherwise("not covered, has no seasons"))
        .when(season.isNull(), "not covered, has seasons")
        .when(season < least, F.concat(F.lit("not covered, starts in "), least.cast("string")))
        .when(season > most, F.concat(F.lit("not covered, ends in "), most.cast("string")))
        .otherwise("covered")
    )
    joined = requested.join(known, F.col("dataset_id") == F.col("known_id"), "left")
    return joined.select("dataset_id", "season", outcome.alias("outcome"))


def known_datasets(dataset_ids: Iterable[str]) -> tuple[list[Dataset], list[str]]:
    """The datasets of the given ids, each once, and the ids that are unknown.

    `all` and `default` both mean every dataset: a usual load takes all of them.
    """
    given = [name for d in dataset_ids for name in (DATASETS if d in ("all", "default") else [d])]
    unique = list(dict.fromkeys(given))
    return [DATASETS[d] for d in unique if d in DATASETS], [d for d in unique if d not in DATASETS]
