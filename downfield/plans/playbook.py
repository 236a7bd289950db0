"""Questions over a loaded warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from downfield.functions.filters import MAX_ROWS
from downfield.operators import charting, lookups, search, sql, status, teams
from downfield.operators.answers import Answer
from downfield.sources.warehouse import Warehouse

FEW_ROWS = 50  # rows of a report unless the caller says otherwise


class Playbook:
    """Every question as a method.

    Questions with a row limit give an `Answer`, which tells whether it was cut; the others give DataFrames.
    Nothing runs until an answer is used.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.warehouse = Warehouse(spark, root)
        self._sql_session: SparkSession | None = None
        self._sql_version: tuple | None = None

    def table(self, name: str) -> DataFrame:
        return self.warehouse.read(name)

    def refresh(self) -> None:
        """Look up again which tables are stored, and which version of each."""
        self.warehouse.refresh()

    def schema(self, table: str | None = None) -> list[str] | list[tuple[str, str]]:
        """The table names, or the (column, type) pairs of one table."""
        if table is None:
            return self.warehouse.tables()
        return self.table(table).dtypes

    def status(self) -> dict[str, DataFrame]:
        return status.status(self.table("plays"), self.warehouse.ledger.latest())

    def catalog(self) -> DataFrame:
        return status.catalog(self.warehouse.ledger.latest())

    def query(self, text: str, max_rows: int = 100) -> Answer:
        """Free-form SELECT over the stored tables, in a session of its own that cannot read other files.

        The views follow the tables: they are registered anew once the logs hold a newer entry.
        """
        version = self.warehouse.version()
        if self._sql_session is None or version != self._sql_version:
            session = self.warehouse.spark.newSession()
            session.conf.set("spark.sql.runSQLOnFiles", "false")
            views = Warehouse(session, self.warehouse.root)
            for name in views.tables():
                views.read(name).createOrReplaceTempView(name)
            views.ledger.latest().createOrReplaceTempView("_ingest_metadata")
            self._sql_session, self._sql_version = session, version
        return sql.capped_query(self._sql_session, text, max_rows)

    def _answer(self, operator: Callable[..., DataFrame], table: str, limit: int, filters: dict) -> Answer:
        rows = self.table(table)
        return Answer(lambda n: operator(rows, **{**filters, "limit": n}), filters.pop("limit", limit))

    def search_plays(self, max_rows: int = FEW_ROWS, **filters) -> Answer:
        plays = self.table("plays")
        return Answer(lambda n: search.search_plays(plays, max_rows=n, **filters), max_rows)

    def team_stats(self, team: str, season: int | None = None, side: str = "both") -> dict[str, DataFrame]:
        tables = [self.table(t) for t in ("team_offense_stats", "team_defense_stats", "situational_stats")]
        return teams.team_stats(*tables, team=team, season=season, side=side)

    def player_stats(self, player_name: str, **filters) -> DataFrame:
        return search.player_stats(self.table("plays"), player_name, **filters)

    def compare(self, entity1: str, entity2: str, compare_type: str = "team", **filters):
        """Two teams (a dict of offense and defense rows) or two players (one DataFrame)."""
        if compare_type == "team":
            filters.pop("season_type", None)
            tables = [self.table(t) for t in ("team_offense_stats", "team_defense_stats")]
            return teams.compare_teams(*tables, entity1, entity2, **filters)
        if compare_type == "player":
            return search.compare_players(self.table("plays"), entity1, entity2, **filters)
        raise ValueError(f"Teams or players can be compared, not {compare_type!r}")

    def schedule(self, **filters) -> Answer:
        return self._answer(lookups.schedule, "schedules", MAX_ROWS, filters)

    def roster(self, **filters) -> Answer:
        return self._answer(lookups.roster, "rosters", MAX_ROWS, filters)

    def injuries(self, **filters) -> Answer:
        return self._answer(lookups.injury_report, "injuries", MAX_ROWS, filters)

    def snap_counts(self, **filters) -> Answer:
        return self._answer(lookups.snap_counts, "snap_counts", MAX_ROWS, filters)

    def fantasy_opportunity(self, **filters) -> Answer:
        return self._answer(lookups.fantasy_opportunity, "ff_opportunity", MAX_ROWS, filters)

    def fantasy_rankings(self, scope: str = "draft", **filters) -> Answer:
        name = lookups.ranking_scope(scope)
        return self._answer(lookups.fantasy_rankings, f"ff_rankings_{name}", FEW_ROWS, {**filters, "scope": name})

    def ftn_charting(self, **filters) -> DataFrame:
        plays = self.warehouse.of_seasons(self.table("plays"), "ftn_charting")
        return charting.charting_tendencies(self.table("ftn_charting"), plays, **filters)

    def td_luck(self, **filters) -> Answer:
        return self._answer(lookups.td_luck_report, "player_td_luck", FEW_ROWS, filters)

    def role_trend(self, **filters) -> Answer:
        return self._answer(lookups.role_trend_report, "player_role_trend", FEW_ROWS, filters)

    def separation_opportunity(self, **filters) -> Answer:
        return self._answer(lookups.separation_report, "player_separation_opportunity", FEW_ROWS, filters)

    def drop_rate(self, **filters) -> Answer:
        return self._answer(lookups.drop_rate_report, "player_drop_rate", FEW_ROWS, filters)

    def contract_value(self, **filters) -> Answer:
        return self._answer(lookups.contract_value_report, "player_contract_value", FEW_ROWS, filters)

    def injury_return(self, **filters) -> Answer:
        return self._answer(lookups.injury_return_report, "injury_return_curve", FEW_ROWS, filters)
