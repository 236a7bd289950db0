import pytest

from downfield.operators import teams

COLUMNS = (
    "posteam string, defteam string, season int, yards_gained double, rush_attempt double, pass_attempt double, "
    "touchdown double, interception double, fumble_lost double, down double, ydstogo double, yardline_100 double, "
    "epa double, sack double, qtr double, time string, shotgun double, no_huddle double, play_type string"
)
ROWS = [
    ("KC", "BAL", 2024, 5.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 10.0, 80.0, 0.1, 0.0, 1.0, "10:00", 1.0, 0.0, "run"),
    ("KC", "BAL", 2024, 8.0, 0.0, 1.0, 0.0, 0.0, 0.0, 3.0, 7.0, 45.0, 0.2, 0.0, 2.0, "08:00", 1.0, 1.0, "pass"),
    ("KC", "BAL", 2024, 12.0, 1.0, 0.0, 0.0, 0.0, 0.0, 3.0, 2.0, 18.0, 0.4, 0.0, 4.0, "01:30", 1.0, 0.0, "run"),
    ("KC", "BAL", 2024, 20.0, 0.0, 1.0, 1.0, 0.0, 0.0, 4.0, 1.0, 10.0, 1.1, 1.0, 4.0, "05:00", 1.0, 0.0, "pass"),
    ("KC", "BAL", 2024, 25.0, 0.0, 1.0, 0.0, 0.0, 0.0, 3.0, 8.0, 30.0, 0.8, 0.0, 4.0, "00:45", 1.0, 1.0, "pass"),
    ("BAL", "KC", 2024, 3.0, 0.0, 1.0, 0.0, 1.0, 0.0, 3.0, 5.0, 40.0, -0.6, 0.0, 2.0, "09:15", 0.0, 0.0, "pass"),
]


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def by_team(df):
    return {row.team: row.asDict() for row in df.collect()}


@pytest.mark.parametrize("source", [teams.offense_facts, teams.offense_cube])
def test_offense_from_plays_or_cube(plays, source):
    found = by_team(teams.team_offense_of(source(plays)))
    assert found["KC"] == {
        "team": "KC", "season_year": 2024, "total_plays": 5, "total_yards": 70.0, "yards_per_play": 14.0,
        "rush_plays": 2, "pass_plays": 3, "rush_yards": 17.0, "pass_yards": 53.0, "yards_per_rush": 8.5,
        "yards_per_pass": 17.67, "touchdowns": 1, "turnovers": 0, "third_down_pct": 100.0, "red_zone_td_pct": 50.0,
        "explosive_plays": 3, "avg_epa": 0.52, "pass_epa": 0.7, "rush_epa": 0.25,
    }
    assert found["BAL"]["turnovers"] == 1
    assert found["BAL"]["third_down_pct"] == 0.0
    assert found["BAL"]["red_zone_td_pct"] is None
    assert found["BAL"]["yards_per_rush"] is None


def test_defense(plays):
    found = by_team(teams.team_defense(plays))
    assert (found["BAL"]["plays_against"], found["BAL"]["sacks"], found["BAL"]["third_down_stop_pct"]) == (5, 1, 0.0)
    assert (found["KC"]["interceptions"], found["KC"]["third_down_stop_pct"]) == (1, 100.0)


def test_situations(plays):
    found = {(r.team, r.situation): r.plays for r in teams.situational(plays).collect()}
    assert found == {
        ("KC", "Standard"): 1, ("KC", "3rd & Long"): 2, ("KC", "3rd & Short"): 1, ("KC", "4th Down"): 1,
        ("BAL", "Standard"): 1,
    }


def test_formations_need_five_plays(plays):
    assert teams.formation_effectiveness(plays).count() == 0
    assert teams.formation_effectiveness_of(teams.offense_facts(plays), min_plays=2).count() == 2


def test_uncounted_plays_and_missing_teams_are_left_out(spark, plays):
    timeout = list(ROWS[0])
    timeout[-1] = "timeout"
    teamless = list(ROWS[0])
    teamless[0] = None
    more = plays.unionByName(spark.createDataFrame([tuple(timeout), tuple(teamless)], COLUMNS))
    assert by_team(teams.team_offense(more))["KC"]["total_plays"] == 5
    assert by_team(teams.team_defense(more))["BAL"]["plays_against"] == 6


def test_team_stats_and_comparison(plays):
    tables = [teams.team_offense(plays), teams.team_defense(plays)]
    stats = teams.team_stats(*tables, teams.situational(plays), team="kc")
    assert {name: df.count() for name, df in stats.items()} == {"offense": 1, "defense": 1, "situational": 4}
    assert [r.situation for r in stats["situational"].collect()] == sorted(
        r.situation for r in stats["situational"].collect()
    )
    assert list(teams.team_stats(*tables, teams.situational(plays), team="KC", side="defense")) == ["defense"]
    assert teams.team_stats(*tables, teams.situational(plays), team="KC", season=2023)["offense"].count() == 0
    compared = teams.compare_teams(*tables, "kc", "bal", season_from=2024)
    assert [r.team for r in compared["offense"].collect()] == ["BAL", "KC"]
    assert teams.compare_teams(*tables, "kc", "bal", season_to=2023)["defense"].count() == 0
