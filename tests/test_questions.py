import pytest
from pyspark.sql import functions as F

import samples
from downfield.functions.filters import row_limit
from downfield.functions.numeric import half_even
from downfield.operators import charting, lookups, players, search, sql, status
from downfield.operators.answers import Answer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: samples.load(spark, SF, name).cache() for name in samples.TABLES}


def test_search_orders_by_effect_with_nulls_last(tables):
    rows = search.search_plays(tables["plays"], max_rows=500).collect()
    effects = [abs(r.epa) if r.epa is not None else -1 for r in rows]
    assert len(rows) == 500 and effects == sorted(effects, reverse=True)
    everything = search.search_plays(tables["plays"].limit(100), max_rows=100).collect()
    missing = [r.epa is None for r in everything]
    assert missing == sorted(missing)


def test_search_filters(tables):
    plays = tables["plays"]
    rows = search.search_plays(plays, team="t3", season=2020, is_touchdown=True).collect()
    assert rows and all(r.posteam == "T3" and r.season == 2020 and r.touchdown == 1 for r in rows)
    assert search.search_plays(plays, max_rows=9999).count() == min(9999, plays.count()) > 500
    assert all(r.down == 4 for r in search.search_plays(plays, situation="fourth_down").collect())
    assert search.search_plays(plays, situation="unknown").count() == 50
    named = search.search_plays(plays, player="Willy N1").collect()
    assert named and all("W.N1" in r.receiver_player_name for r in named)
    assert all(r.yards_gained >= 0 for r in search.search_plays(plays, min_yards=0).collect())


def test_player_stats(tables):
    rows = search.player_stats(tables["plays"], "N1", season_type="REG").collect()
    assert [r.season for r in rows] == sorted(r.season for r in rows)
    assert {r.season_type for r in rows} == {"REG"}
    with pytest.raises(ValueError, match="Unknown stat_type"):
        search.player_stats(tables["plays"], "N1", stat_type="kicking")


def test_compare_players_leaves_out_empty_statistics(tables):
    rows = search.compare_players(tables["plays"], "P.N7", "W.N9").collect()
    assert {(r.player, r.stat_type) for r in rows} == {("P.N7", "passing"), ("W.N9", "receiving")}
    alone = {r.season: r.attempts for r in search.player_stats(tables["plays"], "P.N7", season_type="REG").collect()}
    assert {r.season: r.attempts for r in rows if r.stat_type == "passing" and r.season_type == "REG"} == alone
    same = search.compare_players(tables["plays"], "P.N7", "P.N7").collect()
    assert len(same) == len({(r.season, r.season_type) for r in same})


def test_schedule_matches_home_and_away(tables):
    rows = lookups.schedule(tables["schedules"], team="t4").collect()
    assert all("T4" in (r.home_team, r.away_team) for r in rows)
    assert {"T4"} < {r.home_team for r in rows} and {"T4"} < {r.away_team for r in rows}
    assert [(r.season, r.week) for r in rows] == sorted((r.season, r.week) for r in rows)
    assert lookups.schedule(tables["schedules"], season_type="reg").select("game_type").distinct().count() == 1


def test_position_is_an_exact_match(tables):
    assert lookups.roster(tables["rosters"], position="wr").count() > 0
    assert lookups.roster(tables["rosters"], position="w").count() == 0


def test_injury_report_searches_text(tables):
    rows = lookups.injury_report(tables["injuries"], report_status="quest", player="n1").collect()
    assert rows and all(r.report_status == "Questionable" and "N1" in r.full_name for r in rows)


def test_snap_counts_search_given_and_short_names(spark):
    rows = [("Travis Kelce", None), ("T.Kelce", 5.0), ("Other", 9.0)]
    snaps = spark.createDataFrame(rows, "player string, offense_snaps double").selectExpr(
        "player", "'TE' position", "'KC' team", "'SF' opponent", "2024 season", "1 week", "'REG' game_type",
        "offense_snaps", "0.5D offense_pct", "0D defense_snaps", "0D defense_pct", "0D st_snaps", "0D st_pct",
    )
    found = lookups.snap_counts(snaps, player="Travis Kelce").collect()
    assert [r.player for r in found] == ["T.Kelce", "Travis Kelce"]


def test_fantasy_opportunity_order(tables):
    rows = lookups.fantasy_opportunity(tables["ff_opportunity"]).collect()
    keys = [(r.season, r.week, r.total_fantasy_points_exp) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_rankings(tables):
    rows = lookups.fantasy_rankings(tables["ff_rankings_draft"], limit=500).collect()
    ranks = [r.ecr for r in rows]
    known = [r for r in ranks if r is not None]
    assert known == sorted(known) and ranks[len(known):] == [None] * (len(ranks) - len(known)) and None in ranks
    week = lookups.fantasy_rankings(tables["ff_rankings_week"], scope="WEEK", limit=1)
    assert week.count() == 1 and "opponent" in week.columns
    with pytest.raises(ValueError, match="scope"):
        lookups.fantasy_rankings(tables["ff_rankings_draft"], scope="season")


@pytest.mark.parametrize("given, expected", [(5, 5), (0, 0), (9999, 9999), (None, None), ("7", 7)])
def test_limits(given, expected):
    assert row_limit(given) == expected


@pytest.mark.parametrize("given", [-3, "x"])
def test_wrong_limits(given):
    with pytest.raises(ValueError):
        row_limit(given)


def test_rounding_of_the_double_itself(spark):
    values = [(a / b, digits) for b in (40, 8, 200, 2000, 7, 1024) for a in range(-3, b) for digits in (1, 2)]
    for digits in (1, 2):
        own = [v for v, d in values if d == digits]
        frame = spark.createDataFrame([(v,) for v in own], "v double")
        found = frame.select("v", half_even(F.col("v"), digits).alias("r")).collect()
        assert [r.r for r in found] == [round(r.v, digits) for r in found]
    assert round(1 / 40, 2) == 0.03 and round(3 / 40, 2) == 0.07


def test_reports_guard_their_first_season(tables):
    separation = players.separation_opportunity(tables["ff_opportunity"], tables["nextgen_stats_receiving"])
    drops = players.drop_rate(tables["ftn_charting"], tables["plays"])
    with pytest.raises(ValueError, match="2016"):
        lookups.separation_report(separation, season=2015)
    with pytest.raises(ValueError, match="2022"):
        lookups.drop_rate_report(drops, season=2021)
    assert lookups.separation_report(separation, regression_candidate=False).count() > 0


def test_charting_without_plays_has_no_row(tables):
    assert charting.charting_tendencies(tables["ftn_charting"], tables["plays"], team="none").count() == 0
    row = charting.charting_tendencies(tables["ftn_charting"], tables["plays"], player="n1").first()
    assert row.total_plays > 0 and row.rpo_pct == pytest.approx(100 * row.rpo / row.total_plays, abs=0.051)


def test_charting_counts_repeated_rows(spark):
    plays = spark.createDataFrame(
        [("g", 1.0, "pass"), ("g", 2.0, "run")], "game_id string, play_id double, play_type string"
    )
    flags = ", ".join(f"{c} boolean" for c in charting.TENDENCIES.values())
    rows = [("g", 1.0, *[True] * 6, 6, 4, 1)] * 2 + [("g", 2.0, *[None] * 6, 8, 9, 9)]
    schema = f"nflverse_game_id string, nflverse_play_id double, {flags}, n_defense_box int, n_pass_rushers int, n_blitzers int"
    row = charting.charting_tendencies(spark.createDataFrame(rows, schema), plays).first()
    assert (row.total_plays, row.rpo, row.rpo_pct) == (3, 2, 66.7)
    assert (row.avg_defenders_in_box, row.avg_pass_rushers, row.avg_blitzers) == (6.67, 4.0, 1.0)


def test_status_of_nothing(spark, tables):
    empty = status.status(tables["plays"].limit(0), spark.createDataFrame([], "dataset_id string, table_name string, "
                          "season int, row_count long, loaded_at timestamp"))
    assert tuple(empty["totals"].first()) == (0, None, None, 0)


@pytest.mark.parametrize(
    "text", ["INSERT INTO plays VALUES (1)", "DROP TABLE plays", "WITH a AS (SELECT 1) SELECT * FROM a", ""]
)
def test_sql_is_a_select(spark, text):
    with pytest.raises(ValueError, match="SELECT"):
        sql.capped_query(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM (UPDATE t SET a = 0) AS x", "SELECT * FROM (DROP TABLE t)", "SELECT 1; DROP TABLE plays",
        "SELECT 1; SELECT 2", "SELECT 1) AS a, (SELECT 2",
    ],
)
def test_only_one_query_parses(spark, text):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR|ParseException"):
        sql.capped_query(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT reflect('java.lang.System', 'exit', 0)",
        "SELECT * FROM range(3) WHERE id IN (SELECT length(try_reflect('java.util.UUID', 'randomUUID')))",
        "SELECT java_method('java.util.UUID', 'randomUUID') AS x FROM range(2) GROUP BY 1",
    ],
)
def test_sql_calls_no_other_code(spark, text):
    with pytest.raises(PermissionError, match="outside SQL"):
        sql.capped_query(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM parquet.`{0}`", "SELECT 1 AS a WHERE 1 IN (SELECT id FROM parquet.`{0}`)",
        "SELECT * FROM (WITH w AS (SELECT * FROM parquet.`{0}`) SELECT count(*) FROM w)",
        "SELECT v.id FROM kept v JOIN parquet.`{0}` p ON v.id = p.id",
    ],
)
def test_sql_reads_no_files_in_any_session(spark, tmp_path, text):
    """Without any setting of the session; a view over the same files is fine, and so are words in strings."""
    path = str(tmp_path / "files")
    spark.range(3).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("kept")
    with pytest.raises(PermissionError, match="no registered table"):
        sql.capped_query(spark, text.format(path))
    answer = sql.capped_query(spark, "SELECT id, 'reflect; parquet' AS said FROM kept ORDER BY id")
    assert [tuple(r) for r in answer.collect()] == [(i, "reflect; parquet") for i in range(3)]


def test_sql_is_capped(spark):
    spark.range(600).createOrReplaceTempView("numbers")
    answer = sql.capped_query(spark, "SELECT * FROM numbers;", max_rows=3)
    assert answer.rows.count() == 3 and answer.truncated()
    assert sql.capped_query(spark, "select * from numbers -- all", max_rows=9999).rows.count() == 600
    assert not sql.capped_query(spark, "SELECT * FROM numbers WHERE id < 3", max_rows=3).truncated()
    none = sql.capped_query(spark, "SELECT 1 AS one", max_rows=0)
    assert none.rows.count() == 0 and none.truncated()
    with pytest.raises(ValueError, match="negative"):
        sql.capped_query(spark, "SELECT 1 AS one", max_rows=-5)


def test_an_answer_takes_one_run(spark, tables):
    """Rows, count and flag come from the same job, however often they are asked for."""
    games = tables["schedules"]
    total = lookups.schedule(games, team="t4").count()

    def jobs(limit):
        spark.sparkContext.setJobGroup(f"answer-{limit}", "one answer")
        answer = Answer(lambda n: lookups.schedule(games, team="t4", limit=n), limit)
        found = answer.truncated(), answer.row_count(), len(answer.collect()), answer.to_dict()["truncated"]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"answer-{limit}"))

    assert jobs(total - 1) == ((True, total - 1, total - 1, True), 1)
    assert jobs(total) == ((False, total, total, False), 1)
    assert jobs(total + 5) == ((False, total, total, False), 1)


def test_flagged_answers(spark, tables):
    for limit, flag in ((10, True), (10_000_000, False)):
        answer = Answer(lambda n: lookups.roster(tables["rosters"], limit=n), limit)
        rows = answer.flagged().collect()
        assert {r.truncated for r in rows} == {flag} and [tuple(r)[:-1] for r in rows] == [tuple(r) for r in answer.collect()]
    with pytest.raises(ValueError, match="limit"):
        Answer(lambda n: tables["rosters"].limit(n), None)


def test_a_filter_of_zero_or_no_text_is_a_filter(tables):
    assert lookups.schedule(tables["schedules"], season=0).count() == 0
    assert lookups.schedule(tables["schedules"], week=0).count() == 0
    assert search.search_plays(tables["plays"], season_to=0).count() == 0
    assert lookups.roster(tables["rosters"], position="").count() == 0
    assert lookups.roster(tables["rosters"], team="").count() == 0
