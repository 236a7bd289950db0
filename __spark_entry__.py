"""The registered queries, and the SQL each is checked against."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries as oracle  # noqa: E402
import samples  # noqa: E402
from downfield.functions.labels import formation_label, injury_type, short_name, situation_label  # noqa: E402
from downfield.functions.median import summarize  # noqa: E402
from downfield.functions.numeric import half_up  # noqa: E402
from downfield.operators import charting, lookups, players, recovery, search, sql, status, teams  # noqa: E402
from downfield.operators.answers import Answer  # noqa: E402
from downfield.plans.build import Derived, build_player_tables, build_table, load_datasets  # noqa: E402
from downfield.sources.ledger import Ledger, append_entry, latest_loads, pending_seasons  # noqa: E402
from downfield.sources.load import Loaded, file_reader, load_seasonal, load_static, validate_loaded  # noqa: E402
from downfield.sources.registry import DATASETS, Dataset, window_report  # noqa: E402
from downfield.sources.tables import append_by_name, prepare_plays  # noqa: E402
from downfield.sources.warehouse import Warehouse  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]


def scratch(spark: SparkSession) -> str:
    """A new directory in the folder the cluster shares, or in the warehouse where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{shared.rstrip('/')}/downfield-{uuid.uuid4().hex}"


def over(operator: Callable[..., DataFrame], *tables: str, **arguments) -> Query:
    """The operator over sample tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*[samples.load(spark, sf_dir, t) for t in tables], **arguments)

    return run


def _team_rows(side: str) -> Callable[[DataFrame], DataFrame]:
    def run(plays: DataFrame) -> DataFrame:
        facts = teams.offense_facts(plays)
        tables = [teams.team_offense_of(facts), teams.team_defense(plays), teams.situational_of(facts)]
        return teams.team_stats(*tables, team="t7", side=side)[side]

    return run


def _compared_teams(side: str) -> Callable[[DataFrame], DataFrame]:
    def run(plays: DataFrame) -> DataFrame:
        tables = [teams.team_offense(plays), teams.team_defense(plays)]
        return teams.compare_teams(*tables, "T3", "T11", season_from=2019, season_to=2023)[side]

    return run


def _report(operator: Callable[..., DataFrame], build: Callable[..., DataFrame], **arguments):
    return lambda *tables: operator(build(*tables), **arguments)


def _labels(plays: DataFrame) -> DataFrame:
    return plays.groupBy(situation_label().alias("situation"), formation_label().alias("formation")).agg(
        F.count(F.lit(1)).alias("plays")
    )


def _injury_types(injuries: DataFrame) -> DataFrame:
    report = F.coalesce("report_primary_injury", "practice_primary_injury")
    return injuries.where(report.isNotNull()).groupBy(injury_type(report).alias("injury_type")).agg(
        F.count(F.lit(1)).alias("reports")
    )


def _short_names(rosters: DataFrame) -> DataFrame:
    return rosters.groupBy(short_name(F.col("full_name")).alias("short_name")).agg(F.count(F.lit(1)).alias("rows"))


def _descriptions(plays: DataFrame) -> DataFrame:
    return prepare_plays(plays).select("game_id", "play_id", "enhanced_description")


def _ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load log as long as the orders: one entry per order, seasons missing for static datasets."""
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("dataset"), (F.col("o_custkey") % 29).cast("string")).alias("dataset_id"),
        F.concat(F.lit("table"), (F.col("o_custkey") % 29).cast("string")).alias("table_name"),
        F.when(F.col("o_custkey") % 29 >= 9, 2013 + key % 13).cast("int").alias("season"),
        F.col("o_custkey").alias("row_count"),
        (F.lit("2024-01-01T00:00:00Z").cast("timestamp") + F.make_dt_interval(secs=key)).alias("loaded_at"),
        F.concat(F.lit("load"), key.cast("string")).alias("loader_fn"),
    )


def _latest_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_loads(_ledger_log(spark, sf_dir))


def _in_seconds(query: Query, column: str) -> Query:
    """The query with a timestamp column as seconds, which both engines print alike."""
    return lambda spark, sf_dir: query(spark, sf_dir).withColumn(column, F.unix_timestamp(column))


def _status(part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return status.status(samples.load(spark, sf_dir, "plays"), _latest_loads(spark, sf_dir))[part]

    return run


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.catalog(_latest_loads(spark, sf_dir))


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("dataset"), (F.col("c_custkey") % 40).cast("string")).alias("dataset_id"),
        F.when(F.col("c_custkey") % 40 >= 9, 2010 + F.col("c_custkey") % 19).cast("int").alias("season"),
    )
    return pending_seasons(requested, _ledger_log(spark, sf_dir))


def _append_by_name(snaps: DataFrame, rosters: DataFrame) -> DataFrame:
    odd = rosters.select(
        F.col("full_name").alias("player"), "position", "team", "season",
        F.col("jersey_number").alias("jersey.number"), F.col("years_exp").alias("years exp"),
        F.array("status", "college").alias("status-list"),
    )
    return append_by_name(snaps, odd)


def _season_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injuries loaded season by season into a table that gains a column in 2021; 2019 cannot be read."""
    injuries = samples.load(spark, sf_dir, "injuries")

    def read(dataset: Dataset, season: int | None) -> DataFrame:
        if season == 2019:
            raise RuntimeError("source is down")
        rows = injuries.where(F.col("season") == season)
        return rows if season < 2021 else rows.withColumn("new column", F.col("week") * 10)

    warehouse = Warehouse(spark, scratch(spark))
    load_seasonal(warehouse, DATASETS["injuries"], read, range(2018, 2023))
    load_seasonal(warehouse, DATASETS["injuries"], read, range(2021, 2025))
    return warehouse.read("injuries")


def _odd_load(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, list[Loaded]]:
    """Injuries of 2008 to 2026 from sources that hold rows of no or the next season in two weeks; 2019 cannot be read."""
    injuries = samples.load(spark, sf_dir, "injuries")
    week, season = F.col("week"), F.col("season")
    said = F.when(week == 3, F.lit(None)).when(week == 5, season + 1).otherwise(season).cast("int")

    def read(dataset: Dataset, wanted: int | None) -> DataFrame:
        if wanted == 2019:
            raise RuntimeError("source is down")
        return injuries.where(season == wanted).withColumn("season", said)

    warehouse = Warehouse(spark, scratch(spark))
    return warehouse, load_datasets(warehouse, read, ["injuries"], 2008, 2026, build=False, required=["injuries"])


def _load_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, results = _odd_load(spark, sf_dir)
    rows = [(r.dataset_id, r.season, r.rows, r.rejected, r.outcome.split(":")[0]) for r in results]
    return spark.createDataFrame(rows, "dataset_id string, season int, loaded_rows long, rejected_rows long, outcome string")


def _rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse, _ = _odd_load(spark, sf_dir)
    injury = F.from_json("row", "gsis_id string, week int")
    return warehouse.rejected().select("dataset_id", "season", "reason", injury["gsis_id"].alias("gsis_id"), injury["week"].alias("week"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables a load has to fill, as the load itself counted them."""

    def read(dataset: Dataset, season: int | None) -> DataFrame:
        rows = samples.load(spark, sf_dir, dataset.table)
        return rows.where(F.col("season").cast("int") == season) if dataset.seasonal else rows

    warehouse, tables = Warehouse(spark, scratch(spark)), ["schedules", "snap_counts", "contracts"]
    load_datasets(warehouse, read, tables, 2018, 2024, build=False, required=tables)
    return spark.createDataFrame(list(validate_loaded(warehouse, tables).items()), "table_name string, loaded_rows long")


def _built_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the player tables where only opportunity and contracts are stored."""
    warehouse = Warehouse(spark, scratch(spark))
    for name in ("ff_opportunity", "contracts"):
        warehouse.replace(name, samples.load(spark, sf_dir, name))
    rows = [(r.dataset_id, r.rows, r.outcome) for r in build_player_tables(warehouse)]
    return spark.createDataFrame(rows, "table_name string, built_rows long, outcome string")


def _replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without seasons after two loads; the second one replaces all rows of the first."""
    contracts = samples.load(spark, sf_dir, "contracts")
    warehouse = Warehouse(spark, scratch(spark))
    load_static(warehouse, DATASETS["contracts"], lambda dataset, season: contracts.withColumn("apy", F.lit(0.0)))
    load_static(warehouse, DATASETS["contracts"], lambda dataset, season: contracts)
    return warehouse.read("contracts")


def _built_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touchdown luck as a build stores it, read back after a second build over more rows."""
    warehouse = Warehouse(spark, scratch(spark))
    item = Derived("player_td_luck", ["ff_opportunity"], players.td_luck)
    warehouse.replace("ff_opportunity", samples.load(spark, sf_dir, "ff_opportunity").limit(10))
    build_table(warehouse, item, record=True)
    warehouse.replace("ff_opportunity", samples.load(spark, sf_dir, "ff_opportunity"))
    build_table(warehouse, item, record=True)
    return warehouse.read("player_td_luck")


def _folded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest loads of a log of many entries, read after it was folded twice with new entries between."""
    log = _ledger_log(spark, sf_dir)
    ledger = Ledger(spark, f"{scratch(spark)}/_log")
    key = F.regexp_extract("loader_fn", "([0-9]+)", 1).cast("long")
    for part in range(4):
        append_entry(log.where(key % 4 == part), ledger.path)
        if part % 2:
            ledger.compact(grace=0)
    return ledger.latest()


def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of prices, where all lines of a flag and status are one group."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = ["l_returnflag", "l_linestatus"]
    counts = lines.groupBy(*keys, F.col("l_extendedprice").cast("double").alias("price")).agg(F.count(F.lit(1)).alias("copies"))
    return summarize(counts, keys, "price", "copies", resolution=1, digits=2).select(
        *keys, half_up(F.col("median"), 4).alias("median_price"), F.col("size").alias("line_count")
    )


def _season_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the customers' requests a dataset covers; some name no season or an unknown dataset."""
    names, key = sorted(DATASETS), F.col("c_custkey")
    requested = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.element_at(F.array(*[F.lit(n) for n in [*names, "nothing"]]), (key % 30 + 1).cast("int")).alias("dataset_id"),
        F.when(key % 7 > 0, 1995 + key % 32).cast("int").alias("season"),
    )
    return window_report(requested)


def _loaded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all sample tables, build the derived ones and list what the catalog shows."""
    root = scratch(spark)
    samples.write_sources(spark, sf_dir, f"{root}/sources")
    warehouse = Warehouse(spark, f"{root}/tables")
    names = [d.dataset_id for d in DATASETS.values() if d.table in samples.TABLES]
    load_datasets(warehouse, file_reader(spark, f"{root}/sources"), names, start=2018, end=2024)
    catalog = status.catalog(warehouse.ledger.latest())
    return catalog.select("dataset_id", "table_name", "total_rows", "seasons_loaded", "min_season", "max_season")


def _capped_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams.formation_effectiveness(samples.load(spark, sf_dir, "plays")).createOrReplaceTempView("formation_effectiveness")
    text = """SELECT team, formation, SUM(plays) AS plays FROM formation_effectiveness
              GROUP BY team, formation ORDER BY plays DESC, team, formation;"""
    return sql.capped_query(spark, text, max_rows=60).rows


def _answer(operator: Callable[..., DataFrame], limit: int, build: Callable[..., DataFrame] | None = None, **filters):
    """A limited question with its flag, from one run of limit + 1 rows."""

    def run(*tables: DataFrame) -> DataFrame:
        rows = build(*tables) if build else tables[0]
        return Answer(lambda n: operator(rows, limit=n, **filters), limit).flagged()

    return run


def _sql_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples.load(spark, sf_dir, "rosters").createOrReplaceTempView("rosters")
    text = "SELECT season, team, COUNT(*) AS players FROM rosters GROUP BY season, team ORDER BY season, team"
    return sql.capped_query(spark, text, max_rows=100).flagged()


_SEARCHES: dict[str, tuple[dict, str, int]] = {
    "search_plays": ({}, "TRUE", 50),
    "search_plays_team_red_zone": (
        {"team": "t3", "season_from": 2019, "season_to": 2022, "situation": "red_zone", "max_rows": 9999},
        "posteam = 'T3' AND season BETWEEN 2019 AND 2022 AND yardline_100 <= 20", 9999,
    ),
    "search_plays_two_minute": (
        {"situation": "two_minute", "play_type": "pass", "min_yards": 0, "max_rows": 200},
        "qtr = 4 AND half_seconds_remaining <= 120 AND play_type = 'pass' AND yards_gained >= 0", 200,
    ),
    "search_plays_player_touchdowns": (
        {"player": "Will N1", "is_touchdown": True, "season_type": "REG", "max_rows": 100},
        "(passer_player_name ILIKE '%W.N1%' OR rusher_player_name ILIKE '%W.N1%' OR receiver_player_name ILIKE '%W.N1%')"
        " AND touchdown = 1 AND season_type = 'REG'", 100,
    ),
    "search_plays_third_down_turnovers": (
        {"situation": "third_down", "is_turnover": True, "max_rows": 300},
        "down = 3 AND (interception = 1 OR fumble_lost = 1)", 300,
    ),
    "search_plays_fourth_down_week": (
        {"situation": "fourth_down", "opponent": "T9", "season": 2020, "week": 3},
        "down = 4 AND defteam = 'T9' AND season = 2020 AND week = 3", 50,
    ),
}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "team_offense": over(teams.team_offense, "plays"),
        "team_defense": over(teams.team_defense, "plays"),
        "situational": over(teams.situational, "plays"),
        "formation": over(teams.formation_effectiveness, "plays"),
        "offense_cube_totals": over(lambda plays: teams.team_offense_of(teams.offense_cube(plays)), "plays"),
        "td_luck": over(players.td_luck, "ff_opportunity"),
        "role_trend": over(players.role_trend, "ff_opportunity", "snap_counts"),
        "separation_opportunity": over(players.separation_opportunity, "ff_opportunity", "nextgen_stats_receiving"),
        "drop_rate": over(players.drop_rate, "ftn_charting", "plays"),
        "contract_value": over(players.contract_value, "contracts", "ff_opportunity"),
        "out_spells": over(recovery.out_spells, "injuries"),
        "injury_return_curve": over(recovery.injury_return_curve, "injuries", "snap_counts"),
        "team_stats_offense": over(_team_rows("offense"), "plays"),
        "team_stats_defense": over(_team_rows("defense"), "plays"),
        "team_stats_situational": over(_team_rows("situational"), "plays"),
        "player_stats_passing": over(search.player_stats, "plays", player_name="N1"),
        "player_stats_rushing": over(
            search.player_stats, "plays", player_name="R N2", stat_type="rushing", season_from=2019, season_to=2023
        ),
        "player_stats_receiving": over(
            search.player_stats, "plays", player_name="w.n3", stat_type="receiving", season_type="REG"
        ),
        "compare_teams_offense": over(_compared_teams("offense"), "plays"),
        "compare_teams_defense": over(_compared_teams("defense"), "plays"),
        "compare_players": over(search.compare_players, "plays", player1="N5", player2="N12"),
        "schedule": over(lookups.schedule, "schedules", team="t4", season_type="reg"),
        "schedule_first": over(lookups.schedule, "schedules", team="t4", season_type="reg", limit=500),
        "roster": over(lookups.roster, "rosters", season=2021, position="wr"),
        "injury_report": over(lookups.injury_report, "injuries", season=2020, report_status="out"),
        "snap_counts": over(lookups.snap_counts, "snap_counts", season=2022, position="TE"),
        "fantasy_opportunity": over(lookups.fantasy_opportunity, "ff_opportunity", player="n1", position="rb"),
        "fantasy_rankings_draft": over(
            lookups.fantasy_rankings, "ff_rankings_draft", position="wr", ranking_set="redraft", limit=500
        ),
        "fantasy_rankings_week": over(lookups.fantasy_rankings, "ff_rankings_week", scope="week", limit=200),
        "charting_tendencies": over(charting.charting_tendencies, "ftn_charting", "plays"),
        "charting_tendencies_team": over(
            charting.charting_tendencies, "ftn_charting", "plays", team="t5", season_from=2023, season_type="reg"
        ),
        "td_luck_report": over(
            _report(lookups.td_luck_report, players.td_luck, position="wr", limit=100), "ff_opportunity"
        ),
        "role_trend_report": over(
            _report(lookups.role_trend_report, players.role_trend, season=2021, min_snap_pct=40.0, limit=300),
            "ff_opportunity", "snap_counts",
        ),
        "separation_report": over(
            _report(lookups.separation_report, players.separation_opportunity, regression_candidate=True, limit=500),
            "ff_opportunity", "nextgen_stats_receiving",
        ),
        "drop_rate_report": over(
            _report(lookups.drop_rate_report, players.drop_rate, season=2023, min_targets=3, limit=200),
            "ftn_charting", "plays",
        ),
        "contract_value_report": over(
            _report(lookups.contract_value_report, players.contract_value, min_apy=5.0, max_apy=39.0),
            "contracts", "ff_opportunity",
        ),
        "injury_return_report": over(
            _report(lookups.injury_return_report, recovery.injury_return_curve, injury_type="k", limit=500),
            "injuries", "snap_counts",
        ),
        "status_totals": _status("totals"),
        "status_seasons": _status("seasons"),
        "status_datasets": _status("datasets"),
        "status_refreshed": _in_seconds(_status("refreshed"), "last_refreshed"),
        "catalog": _in_seconds(_catalog, "last_loaded"),
        "latest_loads": _in_seconds(_latest_loads, "loaded_at"),
        "folded_log": _in_seconds(_folded_log, "loaded_at"),
        "median_prices": _medians,
        "pending_seasons": _pending,
        "append_by_name": over(_append_by_name, "snap_counts", "rosters"),
        "season_load": _season_load,
        "load_outcomes": _load_outcomes,
        "rejected_rows": _rejected_rows,
        "validated_tables": _validated,
        "built_tables": _built_tables,
        "replaced_table": _replaced_table,
        "built_content": _built_content,
        "season_windows": _season_windows,
        "loaded_tables": _loaded_tables,
        "capped_sql": _capped_sql,
        "capped_sql_flag": _sql_answer,
        "schedule_flag": over(_answer(lookups.schedule, 500, team="t4"), "schedules"),
        "roster_flag": over(_answer(lookups.roster, 500, season=2021, position="qb"), "rosters"),
        "td_luck_flag": over(_answer(lookups.td_luck_report, 50, players.td_luck, position="rb"), "ff_opportunity"),
        "contract_value_flag": over(
            _answer(lookups.contract_value_report, 100_000, players.contract_value, min_apy=1), "contracts", "ff_opportunity"
        ),
        "play_labels": over(_labels, "plays"),
        "injury_types": over(_injury_types, "injuries"),
        "short_names": over(_short_names, "rosters"),
        "play_descriptions": over(_descriptions, "plays"),
    }
    for name, (arguments, _, _) in _SEARCHES.items():
        found[name] = over(search.search_plays, "plays", **arguments)
    return {**found, **_corpus_operators()[0]}


_LOG = """log AS (SELECT concat('dataset', CAST(o_custkey % 29 AS STRING)) AS dataset_id,
 concat('table', CAST(o_custkey % 29 AS STRING)) AS table_name,
 CAST(CASE WHEN o_custkey % 29 >= 9 THEN 2013 + o_orderkey % 13 END AS INT) AS season, o_custkey AS row_count,
 TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(o_orderkey AS INT)) AS loaded_at,
 concat('load', CAST(o_orderkey AS STRING)) AS loader_fn FROM orders)"""
_LATEST = f"""{_LOG}, latest AS (SELECT dataset_id, table_name, season, row_count, loaded_at, loader_fn FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, season ORDER BY loaded_at DESC) AS place FROM log) t
 WHERE place = 1)"""


def _loaded_tables_sql() -> str:
    """Rows per loaded dataset and per built table."""
    from oracle_queries import BUILT, CURVE, RECOVERY

    blocks = []
    for table in samples.TABLES:
        dataset = DATASETS["pbp" if table == "plays" else table]
        seasons = (
            "COUNT(DISTINCT season), CAST(MIN(CAST(season AS INT)) AS INT), CAST(MAX(CAST(season AS INT)) AS INT)"
            if dataset.seasonal else "1, CAST(NULL AS INT), CAST(NULL AS INT)"
        )
        kept = " WHERE posteam IS NOT NULL AND defteam IS NOT NULL" if table == "plays" else ""
        blocks.append(f"SELECT '{dataset.dataset_id}', '{table}', COUNT(*), {seasons} FROM {table}{kept}")
    built = {
        "player_td_luck": "td_luck", "player_role_trend": "role_trend",
        "player_separation_opportunity": "separation_opportunity", "player_drop_rate": "drop_rate",
        "player_contract_value": "contract_value",
    }
    bodies = {table: BUILT[name][1] for table, name in built.items()} | {"injury_return_curve": CURVE}
    for table, body in bodies.items():
        body = body.replace("JOIN plays p", "JOIN (SELECT * FROM plays WHERE posteam IS NOT NULL AND defteam IS NOT NULL) p")
        blocks.append(f"SELECT '{table}', '{table}', COUNT(*), 1, CAST(NULL AS INT), CAST(NULL AS INT) FROM ({body}) t")
    return samples.with_clause(*samples.TABLES, extra=RECOVERY) + (
        "SELECT * FROM (" + " UNION ALL ".join(blocks) + ") "
        "t(dataset_id, table_name, total_rows, seasons_loaded, min_season, max_season)"
    )


def _season_windows_sql() -> str:
    number = lambda n: "CAST(NULL AS INT)" if n is None else str(n)
    rows = ", ".join(
        f"({i}, '{name}', {DATASETS[name].seasonal}, {number(DATASETS[name].min_season)}, {number(DATASETS[name].max_season)})"
        for i, name in enumerate(sorted(DATASETS))
    )
    return f"""WITH known(i, dataset_id, seasonal, least, most) AS (VALUES {rows}),
requested AS (SELECT c_custkey % 30 AS i, CAST(CASE WHEN c_custkey % 7 > 0 THEN 1995 + c_custkey % 32 END AS INT) AS season FROM customer)
SELECT coalesce(dataset_id, 'nothing') AS dataset_id, season, CASE WHEN dataset_id IS NULL THEN 'unknown dataset'
 WHEN seasonal AND season IS NULL THEN 'not covered, has seasons' WHEN NOT seasonal AND season IS NOT NULL THEN 'not covered, has no seasons'
 WHEN seasonal AND season < least THEN concat('not covered, starts in ', least)
 WHEN seasonal AND season > most THEN concat('not covered, ends in ', most) ELSE 'covered' END AS outcome
FROM requested LEFT JOIN known USING (i)"""


def oracle_sql() -> dict[str, str]:
    o = oracle
    with_plays = samples.with_clause("plays")
    with_recovery = samples.with_clause("injuries", "snap_counts", extra=o.RECOVERY)
    teams_pair = "team IN ('T3', 'T11') AND season_year BETWEEN 2019 AND 2023"
    whole = {name: o.built(name) for name in o.BUILT}
    found = {
        **whole,
        "offense_cube_totals": whole["team_offense"],
        "out_spells": samples.with_clause("injuries", extra=o.SPELLS) + "SELECT DISTINCT * FROM spells",
        "injury_return_curve": with_recovery + o.CURVE,
        "team_stats_offense": o.report("team_offense", "team = 'T7'", "season_year", 1000),
        "team_stats_defense": o.report("team_defense", "team = 'T7'", "season_year", 1000),
        "team_stats_situational": o.report("situational", "team = 'T7'", "season_year", 1000),
        "player_stats_passing": o.player(o.PASSING, "passer_player_name", "pass", "N1"),
        "player_stats_rushing": o.player(
            o.RUSHING, "rusher_player_name", "run", "R.N2", "season BETWEEN 2019 AND 2023"
        ),
        "player_stats_receiving": o.player(
            o.RECEIVING, "receiver_player_name", "pass", "w.n3", "season_type = 'REG'"
        ),
        "compare_teams_offense": o.report("team_offense", teams_pair, "season_year", 1000),
        "compare_teams_defense": o.report("team_defense", teams_pair, "season_year", 1000),
        "compare_players": o.compared(["N5", "N12"]),
        "schedule": o.base_report(
            "schedules", lookups.SCHEDULE_COLUMNS, "(home_team = 'T4' OR away_team = 'T4') AND game_type = 'REG'",
            "season, week", None,
        ),
        "schedule_first": o.base_report(
            "schedules", lookups.SCHEDULE_COLUMNS, "(home_team = 'T4' OR away_team = 'T4') AND game_type = 'REG'",
            "season, week", 500,
        ),
        "roster": o.base_report(
            "rosters", lookups.ROSTER_COLUMNS, "season = 2021 AND position ILIKE 'WR'", "position, full_name", None
        ),
        "injury_report": o.base_report(
            "injuries", lookups.INJURY_COLUMNS, "season = 2020 AND report_status ILIKE '%out%'",
            "season, week, team, full_name", None,
        ),
        "snap_counts": o.base_report(
            "snap_counts", lookups.SNAP_COLUMNS, "season = 2022 AND position ILIKE 'TE'",
            "season, week, team, offense_snaps DESC NULLS LAST", None,
        ),
        "fantasy_opportunity": o.base_report(
            "ff_opportunity", lookups.OPPORTUNITY_COLUMNS, "full_name ILIKE '%n1%' AND position ILIKE 'RB'",
            "season DESC, week DESC, total_fantasy_points_exp DESC NULLS LAST", None,
        ),
        "charting_tendencies": o.charting("TRUE"),
        "charting_tendencies_team": o.charting("p.posteam = 'T5' AND p.season >= 2023 AND p.season_type = 'REG'"),
        "status_totals": with_plays + "SELECT COUNT(*) AS total_plays, MIN(season) AS first_season, "
        "MAX(season) AS last_season, COUNT(DISTINCT season) AS num_seasons FROM plays",
        "status_seasons": with_plays
        + "SELECT season, season_type, COUNT(*) AS plays FROM plays GROUP BY season, season_type",
        "status_datasets": f"WITH {_LATEST} SELECT dataset_id, table_name, CAST(SUM(row_count) AS BIGINT) AS total_rows "
        "FROM latest GROUP BY dataset_id, table_name",
        "status_refreshed": f"WITH {_LATEST} SELECT CAST(epoch(MAX(loaded_at)) AS BIGINT) AS last_refreshed FROM latest",
        "catalog": f"WITH {_LATEST} SELECT dataset_id, table_name, CAST(SUM(row_count) AS BIGINT) AS total_rows, "
        "COUNT(*) AS seasons_loaded, MIN(season) AS min_season, MAX(season) AS max_season, "
        "CAST(epoch(MAX(loaded_at)) AS BIGINT) AS last_loaded FROM latest GROUP BY dataset_id, table_name",
        "latest_loads": f"WITH {_LATEST} SELECT * REPLACE (CAST(epoch(loaded_at) AS BIGINT) AS loaded_at) FROM latest",
        "folded_log": f"WITH {_LATEST} SELECT * REPLACE (CAST(epoch(loaded_at) AS BIGINT) AS loaded_at) FROM latest",
        "median_prices": f"""SELECT l_returnflag, l_linestatus, {o.r("MEDIAN(CAST(l_extendedprice AS DOUBLE))", 4)} AS median_price,
 COUNT(*) AS line_count FROM lineitem GROUP BY l_returnflag, l_linestatus""",
        "pending_seasons": f"""WITH {_LOG}, requested AS (
 SELECT concat('dataset', CAST(c_custkey % 40 AS STRING)) AS dataset_id,
  CAST(CASE WHEN c_custkey % 40 >= 9 THEN 2010 + c_custkey % 19 END AS INT) AS season FROM customer)
SELECT * FROM requested q WHERE NOT EXISTS (
 SELECT 1 FROM log l WHERE l.dataset_id = q.dataset_id AND l.season IS NOT DISTINCT FROM q.season)""",
        "append_by_name": samples.with_clause("snap_counts", "rosters")
        + """SELECT * FROM snap_counts UNION ALL BY NAME
SELECT full_name AS player, position, team, season, CAST(jersey_number AS BIGINT) AS jersey_number,
 CAST(years_exp AS BIGINT) AS years_exp, '["' || status || '","' || college || '"]' AS status_list FROM rosters""",
        "season_load": samples.with_clause("injuries")
        + """SELECT * REPLACE (CAST(week AS BIGINT) AS week),
 CASE WHEN season >= 2021 THEN CAST(week * 10 AS BIGINT) END AS new_column
FROM injuries WHERE season <> 2019""",
        "load_outcomes": samples.with_clause("injuries")
        + """SELECT 'injuries' AS dataset_id, CAST(s AS INT) AS season,
 COUNT(season) FILTER (WHERE week NOT IN (3, 5) AND s <> 2019) AS loaded_rows,
 COUNT(season) FILTER (WHERE week IN (3, 5) AND s <> 2019) AS rejected_rows,
 CASE WHEN s < 2009 THEN 'not covered, starts in 2009' WHEN s = 2019 THEN 'failed'
      WHEN loaded_rows > 0 THEN 'loaded' ELSE 'no rows' END AS outcome
FROM range(2008, 2027) r(s) LEFT JOIN injuries ON season = s GROUP BY s""",
        "rejected_rows": samples.with_clause("injuries")
        + """SELECT 'injuries' AS dataset_id, season, gsis_id, week,
 CASE WHEN week = 3 THEN 'no season' ELSE concat('season ', season + 1) END AS reason
FROM injuries WHERE week IN (3, 5) AND season <> 2019""",
        "validated_tables": samples.with_clause("schedules", "snap_counts", "contracts")
        + " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS loaded_rows FROM {t}" for t in ("schedules", "snap_counts", "contracts")),
        "built_tables": samples.with_clause("ff_opportunity", "contracts")
        + f"""SELECT 'player_td_luck' AS table_name, COUNT(*) AS built_rows, 'built' AS outcome FROM ({o.BUILT["td_luck"][1]}) a
UNION ALL SELECT 'player_contract_value', COUNT(*), 'built' FROM ({o.BUILT["contract_value"][1]}) b
UNION ALL SELECT * FROM (VALUES ('player_role_trend', 0, 'skipped, missing snap_counts'),
 ('player_separation_opportunity', 0, 'skipped, missing nextgen_stats_receiving'),
 ('player_drop_rate', 0, 'skipped, missing ftn_charting, plays'),
 ('injury_return_curve', 0, 'skipped, missing injuries, snap_counts'))""",
        "replaced_table": samples.with_clause("contracts") + "SELECT * FROM contracts",
        "built_content": whole["td_luck"],
        "season_windows": _season_windows_sql(),
        "loaded_tables": _loaded_tables_sql(),
        "capped_sql_flag": samples.with_clause("rosters", extra="""a AS (SELECT season, team, COUNT(*) AS players FROM rosters
 GROUP BY season, team)""") + "SELECT *, (SELECT COUNT(*) FROM a) > 100 AS truncated FROM a ORDER BY season, team LIMIT 100",
        "schedule_flag": o.flagged("schedules", lookups.SCHEDULE_COLUMNS, "(home_team = 'T4' OR away_team = 'T4')", "season, week", 500),
        "roster_flag": o.flagged("rosters", lookups.ROSTER_COLUMNS, "season = 2021 AND position ILIKE 'QB'", "position, full_name", 500),
        "td_luck_flag": o.flagged(
            "td_luck", lookups.TD_LUCK_COLUMNS, "position ILIKE 'RB'", "total_td_luck_score ASC NULLS LAST", 50, built=True
        ),
        "contract_value_flag": o.flagged(
            "contract_value", lookups.CONTRACT_COLUMNS, "apy >= 1", "fp_per_million DESC NULLS LAST", 100_000, built=True
        ),
        "capped_sql": samples.with_clause("plays", extra=f"built AS ({o.BUILT['formation'][1]})")
        + """SELECT team, formation, CAST(SUM(plays) AS BIGINT) AS plays FROM built
GROUP BY team, formation ORDER BY plays DESC, team, formation LIMIT 60""",
        "play_labels": with_plays
        + f"SELECT {o.SITUATION} AS situation, {o.FORMATION} AS formation, COUNT(*) AS plays FROM plays p GROUP BY 1, 2",
        "injury_types": samples.with_clause("injuries")
        + f"SELECT {o.INJURY_TYPE} AS injury_type, COUNT(*) AS reports "
        f"FROM (SELECT {o.REPORT} AS report FROM injuries) t WHERE report IS NOT NULL GROUP BY 1",
        "short_names": samples.with_clause("rosters")
        + "SELECT regexp_replace(full_name, '^([^.\\s])[^.\\s]*\\s+', '\\1.') AS short_name, COUNT(*) AS \"rows\" "
        "FROM rosters GROUP BY 1",
        "play_descriptions": with_plays + "SELECT game_id, play_id, " + o.description(),
    }
    draft = lookups.RANKING_COLUMNS["draft"]
    week = lookups.RANKING_COLUMNS["week"]
    for name, columns, where, limit in (
        ("draft", draft, "pos ILIKE 'WR' AND page_type ILIKE '%redraft%'", 500),
        ("week", week, "TRUE", 200),
    ):
        select = ", ".join(f"{source} AS {output}" for output, source in columns.items())
        found[f"fantasy_rankings_{name}"] = o.base_report(
            f"ff_rankings_{name}", list(columns), where, "ecr ASC NULLS LAST", limit, select
        )
    for name, table, columns, where, order, limit in (
        ("td_luck_report", "td_luck", lookups.TD_LUCK_COLUMNS, "position ILIKE 'WR'",
         "total_td_luck_score ASC NULLS LAST", 100),
        ("role_trend_report", "role_trend", lookups.ROLE_TREND_COLUMNS, "season = 2021 AND snap_pct >= 40",
         "snap_pct_delta DESC NULLS LAST", 300),
        ("separation_report", "separation_opportunity", lookups.SEPARATION_COLUMNS, "regression_candidate",
         "fp_diff_per_game ASC NULLS LAST", 500),
        ("drop_rate_report", "drop_rate", lookups.DROP_RATE_COLUMNS, "season = 2023 AND catchable_targets >= 3",
         "drop_rate_pct DESC NULLS LAST", 200),
        ("contract_value_report", "contract_value", lookups.CONTRACT_COLUMNS, "apy BETWEEN 5 AND 39",
         "fp_per_million DESC NULLS LAST", 50),
    ):
        found[name] = o.report(table, where, f"{order}, {o.ties(columns)}", limit, ", ".join(columns))
    found["injury_return_report"] = (
        with_recovery + f"SELECT * FROM ({o.CURVE}) t WHERE injury_type ILIKE '%k%' "
        "ORDER BY week_post_return, injury_type, position LIMIT 500"
    )
    columns = ", ".join("play_desc AS \"desc\"" if c == "desc" else c for c in search.PLAY_COLUMNS)
    for name, (_, where, limit) in _SEARCHES.items():
        found[name] = with_plays + (
            f"SELECT * FROM (SELECT {columns} FROM plays WHERE {where}) t "
            f"ORDER BY ABS(epa) DESC NULLS LAST, {o.ties(search.PLAY_COLUMNS)} LIMIT {limit}"
        )
    return {**found, **_corpus_operators()[1]}


def entry(spark: SparkSession) -> DataFrame:
    """Team offense per season over the smallest test data."""
    return teams.team_offense(samples.load(spark, "/root/testdata/sf0.001", "plays"))


def _corpus_operators() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the operators on text corpora; none where that subpackage is not installed."""
    try:
        import corpus_pipeline
        from downfield.llm import queries as corpus
    except ModuleNotFoundError as error:
        if error.name not in ("corpus_pipeline", "downfield.llm"):
            raise
        return {}, {}
    found = {"pipeline": corpus_pipeline.run, **corpus.QUERIES}
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return found, {**pipeline_sql, **corpus.ORACLE_SQL}
