"""Loading and building everything in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame

from downfield.operators import players, recovery, teams
from downfield.sources.load import (
    IncompleteLoad, Loaded, Reader, load_dataset, outside_window, validate_loaded, wanted_seasons,
)
from downfield.sources.registry import known_datasets, season_range
from downfield.sources.warehouse import Warehouse


@dataclass(frozen=True)
class Derived:
    """A table built from stored tables."""

    table: str
    sources: list[str]
    build: Callable[..., DataFrame]
    # whether a source needs only the seasons that the first one has
    same_seasons: bool = False


OFFENSE_CUBE = "_offense_cube"

# a load that was asked for these and leaves them without rows has failed
CORE_TABLES = ("plays", "schedules")

# Plays are scanned twice, for the cube and for defense; the other offense tables read the cube.
PLAY_TABLES = [
    Derived(OFFENSE_CUBE, ["plays"], teams.offense_cube),
    Derived("team_defense_stats", ["plays"], teams.team_defense),
]
CUBE_TABLES = [
    Derived("team_offense_stats", [OFFENSE_CUBE], teams.team_offense_of),
    Derived("situational_stats", [OFFENSE_CUBE], teams.situational_of),
    Derived("formation_effectiveness", [OFFENSE_CUBE], teams.formation_effectiveness_of),
]

PLAYER_TABLES = [
    Derived("player_td_luck", ["ff_opportunity"], players.td_luck),
    Derived("player_role_trend", ["ff_opportunity", "snap_counts"], players.role_trend),
    Derived(
        "player_separation_opportunity", ["ff_opportunity", "nextgen_stats_receiving"], players.separation_opportunity
    ),
    Derived("player_drop_rate", ["ftn_charting", "plays"], players.drop_rate, same_seasons=True),
    Derived("player_contract_value", ["contracts", "ff_opportunity"], players.contract_value),
    Derived("injury_return_curve", ["injuries", "snap_counts"], recovery.injury_return_curve),
]

T = TypeVar("T")


def _side_by_side(action: Callable[[T], list[Loaded]], items: Iterable[T]) -> list[Loaded]:
    """Submit independent jobs together, so small ones fill what larger ones leave idle."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return [result for results in pool.map(action, items) for result in results]


def build_table(warehouse: Warehouse, item: Derived, record: bool) -> Loaded:
    """Write a table anew from its sources; it is passed over if a source is missing."""
    missing = [s for s in item.sources if not warehouse.exists(s)]
    if missing:
        return Loaded(item.table, None, 0, f"skipped, missing {', '.join(missing)}")
    first, *others = [warehouse.read(s) for s in item.sources]
    if item.same_seasons:
        others = [warehouse.of_seasons(rows, item.sources[0]) for rows in others]
    rows = warehouse.replace(item.table, item.build(first, *others))
    if record:
        warehouse.ledger.record(item.table, item.table, "derived", {None: rows})
    return Loaded(item.table, None, rows, "built")


def build_team_tables(warehouse: Warehouse) -> list[Loaded]:
    """The four team tables and the cube three of them come from."""
    return [
        result
        for tables in (PLAY_TABLES, CUBE_TABLES)
        for result in _side_by_side(lambda item: [build_table(warehouse, item, record=False)], tables)
    ]


def build_player_tables(warehouse: Warehouse) -> list[Loaded]:
    """The six player tables, each noted in the ledger as derived."""
    return _side_by_side(lambda item: [build_table(warehouse, item, record=True)], PLAYER_TABLES)


def load_datasets(
    warehouse: Warehouse,
    read: Reader,
    dataset_ids: Iterable[str],
    start: int | None = None,
    end: int | None = None,
    fresh: bool = False,
    build: bool = True,
    required: Iterable[str] | None = None,
) -> list[Loaded]:
    """Load the datasets, then build the team tables (if plays are among them) and the player tables.

    Raises `IncompleteLoad` before anything is built if one of the `required` tables has no rows then; those are
    the core tables among the datasets unless given. Requested seasons that a dataset does not cover are in the
    results, so that nothing is left out in silence.
    """
    seasons = season_range(start, end)
    datasets, unknown = known_datasets(dataset_ids)
    results = [Loaded(name, None, 0, "unknown dataset") for name in unknown]
    results += outside_window(datasets, seasons)
    wanted = wanted_seasons(warehouse, datasets, seasons, fresh)
    results += _side_by_side(lambda d: load_dataset(warehouse, d, read, wanted[d.dataset_id]), datasets)
    tables = [d.table for d in datasets]
    try:
        validate_loaded(warehouse, [t for t in CORE_TABLES if t in tables] if required is None else required)
    except ValueError as error:
        raise IncompleteLoad(str(error), results) from error
    if build:
        if "plays" in tables:
            results += build_team_tables(warehouse)
        results += build_player_tables(warehouse)
    return results
