import random
from collections import defaultdict

import pytest

import samples
from downfield.operators import charting, players, recovery

LUCK = (
    "player_id string, full_name string, position string, posteam string, season string, week double, "
    "rec_touchdown double, rec_touchdown_exp double, rec_touchdown_diff double, rush_touchdown double, "
    "rush_touchdown_exp double, rush_touchdown_diff double"
)


def test_td_luck(spark):
    rows = [
        ("00-1", "A Back", "RB", "KC", "2024", 1.0, 1.0, 1.5, -0.5, 1.0, 0.5, 0.5),
        ("00-1", "A Back", "RB", "KC", "2024", 2.0, 0.0, 0.5, -0.5, 1.0, 2.0, -1.0),
        ("00-2", "B Wr", "WR", "BAL", "2024", 1.0, 2.0, 1.0, 1.0, 0.0, 0.0, None),
        (None, "C", "WR", "BAL", "2024", 1.0, 2.0, 1.0, 1.0, 0.0, 0.0, 0.0),
    ]
    found = {r.player_id: r for r in players.td_luck(spark.createDataFrame(rows, LUCK)).collect()}
    assert found["00-1"].total_td_luck_score == -1.5
    assert (found["00-1"].season, found["00-1"].rec_td, found["00-1"].rush_td_luck) == (2024, 1.0, -0.5)
    assert found["00-2"].total_td_luck_score is None
    assert set(found) == {"00-1", "00-2"}


WEEKLY = (
    "player_id string, full_name string, position string, posteam string, season string, week double, "
    "rec_attempt double, rec_attempt_team double, rush_attempt double, rush_attempt_team double, "
    "rec_air_yards double, rec_air_yards_team double"
)
SNAPS = "player string, team string, season int, week int, offense_pct double"


def test_role_trend_counts_played_weeks(spark):
    rows = [
        ("p", "P", "WR", "KC", "2024", float(week), targets, 40.0, 0.0, 0.0, None, 100.0)
        for week, targets in ((1, 4.0), (2, 8.0), (5, 12.0), (6, 4.0))
    ]
    snaps = [("P", "KC", 2024, 1, 0.5), ("P", "KC", 2024, 2, 0.7), ("P", "KC", 2024, 6, 0.9), ("P", "SF", 2024, 5, 0.1)]
    trend = players.role_trend(spark.createDataFrame(rows, WEEKLY), spark.createDataFrame(snaps, SNAPS))
    found = {r.week: r for r in trend.collect()}
    assert [found[w].target_share_pct for w in (1, 2, 5, 6)] == [10.0, 20.0, 30.0, 10.0]
    assert [found[w].target_share_pct_3wk for w in (1, 2, 5, 6)] == [10.0, 15.0, 20.0, 20.0]
    assert [found[w].snap_pct for w in (1, 2, 5, 6)] == [50.0, 70.0, None, 90.0]
    assert [found[w].snap_pct_3wk for w in (1, 2, 5, 6)] == [50.0, 60.0, 60.0, 80.0]
    assert [found[w].snap_pct_delta for w in (1, 2, 5, 6)] == [0.0, 10.0, None, 10.0]
    assert found[1].carry_share_pct is None and found[1].air_yards_share_pct_3wk is None


def test_role_trend_keeps_copies_and_keyless_rows(spark):
    row = ("p", "P", "WR", "KC", "2024", 1.0, 4.0, 40.0, 1.0, 10.0, 5.0, 100.0)
    keyless = ("q", None, "WR", "KC", "2024", 1.0, 4.0, 40.0, 1.0, 10.0, 5.0, 100.0)
    snaps = [("P", "KC", 2024, 1, 0.5), ("P", "KC", 2024, 1, 0.5), ("P", "KC", 2024, 1, 0.6), (None, "KC", 2024, 1, 0.9)]
    trend = players.role_trend(
        spark.createDataFrame([row] * 3 + [keyless] * 2, WEEKLY), spark.createDataFrame(snaps, SNAPS)
    ).collect()
    assert sorted(r.snap_pct for r in trend if r.player_id == "p") == [50.0] * 6 + [60.0] * 3
    assert [r.snap_pct for r in trend if r.player_id == "q"] == [None, None]


def test_separation_flag_has_three_values(spark):
    schema = (
        "player_id string, full_name string, position string, posteam string, season string, week double, "
        "total_fantasy_points_diff double, rec_touchdown_diff double, receptions_diff double, rec_attempt double, "
        "rec_attempt_team double, rec_air_yards double, rec_air_yards_team double"
    )
    weeks = [("a", -2.0, -0.8), ("b", 3.0, 1.0), ("c", -2.0, None)]
    rows = [
        (p, p.upper(), "WR", "KC", "2024", w, diff, td, 0.5, 5.0, 25.0, 10.0, 0.0)
        for p, diff, td in weeks for w in (1.0, 2.0, 2.0)
    ]
    tracked = [(p, 2024, w, sep, 0.5, 70.0) for p in "abc" for w, sep in ((0, 9.0), (1, 2.5), (2, 2.75))]
    tracked += [("a", 2023, 1, 3.0, 0.5, 70.0), (None, 2024, 1, 3.0, 0.5, 70.0)]
    receiving = spark.createDataFrame(
        tracked,
        "player_gsis_id string, season int, week int, avg_separation double, avg_yac_above_expectation double, "
        "catch_percentage double",
    )
    found = {
        r.player_id: r
        for r in players.separation_opportunity(spark.createDataFrame(rows, schema), receiving).collect()
    }
    assert {p: r.regression_candidate for p, r in found.items()} == {"a": True, "b": False, "c": None}
    assert (found["a"].games, found["a"].fp_diff_per_game, found["a"].td_luck) == (2, -3.0, -2.4)
    assert (found["a"].avg_separation, found["a"].target_share_pct) == (2.625, 20.0)
    assert found["a"].air_yards_share_pct is None


def test_drop_rate_per_team_with_repeated_charting(spark):
    plays = spark.createDataFrame(
        [
            ("g1", 1.0, 2024, "KC", "r1", "A.One"), ("g1", 2.0, 2024, "KC", "r1", "A.One"),
            ("g2", 1.0, 2024, "SF", "r1", "A.One"), ("g2", 2.0, 2024, "SF", None, None),
        ],
        "game_id string, play_id double, season int, posteam string, receiver_player_id string, "
        "receiver_player_name string",
    )
    charting = spark.createDataFrame(
        [
            ("g1", 1, True, True, False, None), ("g1", 1, True, True, False, None), ("g1", 2, True, False, True, True),
            ("g2", 1, True, None, False, False), ("g2", 1, False, True, True, True), ("g2", 2, True, True, True, True),
        ],
        "nflverse_game_id string, nflverse_play_id int, is_catchable_ball boolean, is_drop boolean, "
        "is_contested_ball boolean, is_created_reception boolean",
    )
    found = {r.team: tuple(r)[4:] for r in players.drop_rate(charting, plays).collect()}
    assert found == {"KC": (3, 2, 66.67, 1, 1), "SF": (1, 0, 0.0, 0, 0)}


def test_contract_value_uses_active_contracts_for_all_seasons(spark):
    contracts = spark.createDataFrame(
        [("a", "WR", "KC", 10.0, 0.05, True), ("a", "WR", "SF", 20.0, 0.04, True), ("a", "WR", "SF", 99.0, 0.9, False),
         ("b", "RB", "KC", 0.0, 0.0, True), (None, "RB", "KC", 5.0, 0.0, True)],
        "gsis_id string, position string, team string, apy double, apy_cap_pct double, is_active boolean",
    )
    opportunity = spark.createDataFrame(
        [("a", "A", None, "KC", "2023", 1.0, 50.0, 40.0), ("a", "A", None, "KC", "2024", 1.0, 25.0, 40.0),
         ("b", "B", "FB", "KC", "2024", 1.0, 5.0, 4.0), ("c", "C", "FB", "KC", "2024", 1.0, 5.0, 4.0)],
        "player_id string, full_name string, position string, posteam string, season string, week double, "
        "total_fantasy_points double, total_fantasy_points_exp double",
    )
    found = {(r.player_id, r.season): r for r in players.contract_value(contracts, opportunity).collect()}
    assert set(found) == {("a", 2023), ("a", 2024), ("b", 2024)}
    assert (found["a", 2023].apy, found["a", 2023].cap_pct, found["a", 2023].fp_per_million) == (20.0, 0.05, 2.5)
    assert found["a", 2024].position == "WR" and found["b", 2024].position == "FB"
    assert found["b", 2024].fp_per_million is None


INJURIES = (
    "gsis_id string, full_name string, position string, season int, week int, report_status string, "
    "report_primary_injury string, practice_primary_injury string"
)


def brute_spells(rows):
    """Number the rows per player-season, group by week - number; the distinct spells."""
    names = {"Knee": "knee", "Ankle": "ankle", "Flu": "other"}
    groups = defaultdict(list)
    for row in rows:
        groups[row[0], row[3]].append((row[4], names[row[6]], row[1], row[2]))
    spells = set()
    for (player, season), own in groups.items():
        islands = defaultdict(list)
        for number, row in enumerate(sorted(own), start=1):
            islands[row[0] - number].append(row)
        for members in islands.values():
            kinds = [m[1] for m in members]
            kind = min(kinds, key=lambda k: (-kinds.count(k), k))
            last = max(members)
            spells.add((player, last[2], last[3], season, kind, min(members)[0], last[0]))
    return spells


@pytest.mark.parametrize("seed", range(4))
def test_out_spells_equal_numbering_all_rows(spark, seed):
    random.seed(seed)
    rows = []
    for player in ("a", "b", "c", "d"):
        for week in range(1, 8):
            copies = 1 if player == "a" else random.choice([0, 1, 2, 5, 60])
            kind = random.choice(["Knee", "Ankle", "Flu"])
            rows += [(player, player.upper(), "WR", 2024, week, "Out", kind, None)] * (copies if week != 4 else 0)
            if random.random() < 0.3:
                rows.append((player, player.upper(), "WR", 2024, week, "Out", "Knee", None))
    rows = [r for r in rows]
    found = [tuple(r) for r in recovery.out_spells(spark.createDataFrame(rows, INJURIES)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_spells(rows)


def test_injury_return_curve(spark):
    injuries = [
        ("a", "A", "WR", 2024, 3, "Out", None, "Knee"), ("a", "A", "WR", 2024, 4, "Out", "Knee", None),
        ("b", "B", "WR", 2024, 3, "Out", "left knee", None), ("b", "B", "WR", 2024, 5, "Questionable", "Knee", None),
        ("c", "C", "WR", 2024, 1, "Out", "Knee", None), (None, "A", "WR", 2024, 9, "Out", "Knee", None),
        ("a", "A", "WR", 2024, 9, "Out", None, None),
    ]
    snaps = [
        ("A", "KC", 2024, 1, 0.8), ("A", "KC", 2024, 2, 0.4), ("A", "KC", 2024, 5, 0.3), ("A", "KC", 2024, 6, 0.6),
        ("A", "KC", 2024, 13, 0.6), ("A", "KC", 2023, 5, 0.9), ("B", "KC", 2024, 2, 0.5), ("B", "KC", 2024, 4, 0.5),
        ("B", "KC", 2024, 5, None), ("C", "KC", 2024, 2, 0.5),
    ]
    curve = recovery.injury_return_curve(spark.createDataFrame(injuries, INJURIES), spark.createDataFrame(snaps, SNAPS))
    found = {r.week_post_return: tuple(r)[3:] for r in curve.collect()}
    # Player a has a baseline of 0.6, b of 0.5, c none; week 13 is nine weeks after a's return.
    assert found == {1: (75.0, 75.0, 2), 2: (100.0, 100.0, 2)}
    assert {(r.injury_type, r.position) for r in curve.collect()} == {("knee", "WR")}


def test_recovery_needs_few_shuffles(spark, tmp_path):
    """Spells and shares meet in one shuffle, and no join has a range of weeks."""
    for name in ("injuries", "snap_counts"):
        samples.load(spark, "/root/testdata/sf0.001", name).write.parquet(f"{tmp_path}/{name}")
    tables = [spark.read.parquet(f"{tmp_path}/{name}") for name in ("injuries", "snap_counts")]
    curve = recovery.injury_return_curve(*tables)
    assert curve.count() > 0
    curve.collect()
    final = curve._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert 0 < len(shuffles) <= 10
    joins = [line for line in final.splitlines() if "Join" in line]
    assert joins and not any("week" in line.split("week_post_return")[0] for line in joins)


def test_recovery_with_digits_equals_without(spark):
    tables = [samples.load(spark, "/root/testdata/sf0.001", name) for name in ("injuries", "snap_counts")]
    plain = sorted(map(tuple, recovery.injury_return_curve(*tables).collect()), key=repr)
    assert plain == sorted(map(tuple, recovery.injury_return_curve(*tables, digits=2).collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Sample tables as stored ones, charting and plays by season."""
    root = tmp_path_factory.mktemp("stored")
    for name in ("plays", "ftn_charting", "ff_opportunity", "nextgen_stats_receiving", "contracts"):
        writer = samples.load(spark, "/root/testdata/sf0.001", name).write
        (writer.partitionBy("season") if name in ("plays", "ftn_charting") else writer).parquet(f"{root}/{name}")
    return lambda name: spark.read.parquet(f"{root}/{name}")


def planned(frame):
    """Lines of the plan before adaptive execution changes it."""
    return frame._jdf.queryExecution().executedPlan().toString().splitlines()


def shuffles(frame):
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in planned(frame))


def scans(frame, column):
    return [line for line in planned(frame) if "FileScan" in line and column in line]


def test_a_season_of_plays_reaches_charting(stored):
    question = charting.charting_tendencies(stored("ftn_charting"), stored("plays"), season=2023)
    assert question.count() == 1
    (scan,) = scans(question, "nflverse_game_id")
    assert "2023" in scan.split("PartitionFilters: [")[1].split("]")[0]
    later = charting.charting_tendencies(stored("ftn_charting"), stored("plays"), season_from=2023)
    assert ">= 2023" in scans(later, "nflverse_game_id")[0].split("PartitionFilters: [")[1].split("]")[0]
    drops = players.drop_rate(stored("ftn_charting"), stored("plays").where("season IN (2022, 2024)"))
    assert "2022,2024" in scans(drops, "nflverse_game_id")[0].split("PartitionFilters: [")[1].split("]")[0].replace(" ", "")


def test_shuffles_of_the_player_tables(stored):
    assert shuffles(players.drop_rate(stored("ftn_charting"), stored("plays"))) <= 4
    assert shuffles(players.contract_value(stored("contracts"), stored("ff_opportunity"))) <= 4
    separation = players.separation_opportunity(stored("ff_opportunity"), stored("nextgen_stats_receiving"))
    assert shuffles(separation) <= 3 and len(scans(separation, "total_fantasy_points_diff")) == 1
    assert len([line for line in planned(separation) if "FileScan" in line]) == 2


def test_games_count_each_week_once(spark):
    rows = [("a", "X", "WR", t, "2024", w) for t, w in (("KC", 1.0), ("SF", 1.0), ("KC", 2.0), ("KC", 2.0), ("KC", None))]
    names = [
        "total_fantasy_points_diff", "rec_touchdown_diff", "receptions_diff", "rec_attempt", "rec_attempt_team",
        "rec_air_yards", "rec_air_yards_team",
    ]
    opportunity = spark.createDataFrame(
        rows, "player_id string, full_name string, position string, posteam string, season string, week double"
    ).selectExpr("*", *[f"1D AS {n}" for n in names])
    receiving = spark.createDataFrame(
        [("a", 2024, 1, 3.0, 1.0, 60.0)],
        "player_gsis_id string, season int, week int, avg_separation double, avg_yac_above_expectation double, catch_percentage double",
    )
    row = players.separation_opportunity(opportunity, receiving).first()
    assert (row.games, row.fp_diff, row.team) == (2, 5.0, "KC")
