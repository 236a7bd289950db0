import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from downfield.functions import trailing
from downfield.functions.grouping import counted, join_on_same, totals_with_profile
from downfield.functions.labels import formation_label, injury_type, short_name, shorten, situation_label
from downfield.functions.median import middle_rows, summarize
from downfield.functions.numeric import half_up, percent
from downfield.functions.text import with_description


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_half_up_scales_before_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,), (-0.001,), (None,), (0.125,)], "x double")
    rounded = values(df, half_up(F.col("x"), 2))
    assert rounded == [1.0, 2.5, -2.5, 0.0, None, 0.13]
    assert math.copysign(1, rounded[3]) == 1
    assert values(df, half_up(F.col("x"), 0))[1:3] == [3.0, -3.0]


def test_percent_is_null_for_zero(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (None, 2)], "a int, b int")
    assert values(df, percent(F.col("a"), F.col("b"), 1)) == [33.3, None, None]


def test_situations_follow_their_order(spark):
    rows = [
        (4.0, 1.0, 10.0, 4.0, "01:00", "4th Down"),
        (3.0, 7.0, 10.0, 4.0, "01:00", "3rd & Long"),
        (3.0, 3.0, 10.0, 4.0, "01:00", "3rd & Short"),
        (3.0, 5.0, 20.0, 1.0, "01:00", "Red Zone"),
        (3.0, 5.0, 21.0, 4.0, "01:59", "Two Minute Drill"),
        (1.0, 10.0, 50.0, 4.0, "02:00", "Standard"),
        (1.0, 10.0, 50.0, 3.0, "01:00", "Standard"),
        (1.0, 10.0, None, 4.0, "bad", "Standard"),
        (1.0, 10.0, 50.0, 4.0, None, "Standard"),
        (1.0, 10.0, 50.0, 4.0, "99999999999:00", "Standard"),
    ]
    df = spark.createDataFrame(
        rows, "down double, ydstogo double, yardline_100 double, qtr double, time string, expected string"
    )
    assert values(df, situation_label()) == [r[-1] for r in rows]


def test_formations(spark):
    rows = [(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1.0, None)]
    df = spark.createDataFrame(rows, "shotgun double, no_huddle double")
    assert values(df, formation_label()) == [
        "SHOTGUN NO HUDDLE", "SHOTGUN", "NO HUDDLE", "UNDER CENTER", "SHOTGUN",
    ]


def test_injury_types_take_the_first_match(spark):
    rows = [("Left Knee",), (" ANKLE, Knee ",), ("Quadricep",), ("Ribs",), ("Illness",), ("Hamstring/Hip",)]
    df = spark.createDataFrame(rows, "x string")
    assert values(df, injury_type(F.col("x"))) == ["knee", "knee", "quadriceps", "ribs", "other", "hamstring"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Justin Jefferson", "J.Jefferson"),
        ("J.Jefferson", "J.Jefferson"),
        ("Jefferson", "Jefferson"),
        ("J. Jefferson", "J. Jefferson"),
        ("Amon Ra St. Brown", "A.Ra St. Brown"),
        ("  Travis   Kelce ", "T.Kelce"),
    ],
)
def test_short_names(spark, name, expected):
    assert shorten(name) == expected
    assert values(spark.createDataFrame([(name,)], "x string"), short_name(F.col("x"))) == [expected]


def describe(spark, schema, row):
    df = spark.createDataFrame([row], schema)
    return with_description(df, "text").first().text


def test_play_description_with_all_parts(spark):
    schema = (
        "down double, ydstogo double, qtr double, season int, week int, season_type string, posteam string, "
        "defteam string, play_type string, passer_player_name string, rusher_player_name string, "
        "receiver_player_name string, desc string, yardline_100 double, touchdown double, interception double, "
        "fumble_lost double, yards_gained double, pass_attempt double, rush_attempt double"
    )
    row = (
        3.0, 8.0, 4.0, 2024, 9, "POST", "KC", "BAL", "pass", "P.Mahomes", None, "T.Kelce",
        "Deep middle pass complete", 12.0, 1.0, 1.0, 0.0, 25.0, 1.0, 0.0,
    )
    assert describe(spark, schema, row) == (
        "3 & 8 — Q4 — Week 9 2024 (POST): KC vs BAL — PASS — QB: P.Mahomes — Receiver: T.Kelce — "
        "Deep middle pass complete — [Red Zone, 3rd Down, TOUCHDOWN, TURNOVER, EXPLOSIVE, PLAYOFFS]"
    )


def test_play_description_leaves_out_what_cannot_be_read(spark):
    schema = (
        "down string, ydstogo string, qtr string, season string, week string, season_type string, posteam string, "
        "defteam string, play_type string, desc string, yardline_100 string, yards_gained string, pass_attempt int"
    )
    row = ("bad", "bad", "bad", "2024", "bad", "REG", "KC", "BAL", "run", "Simple run", "bad", "bad", 1)
    assert describe(spark, schema, row) == "2024 (REG): KC vs BAL — RUN — Simple run"


def test_play_description_of_sparse_rows(spark):
    assert describe(spark, "season int, posteam string, defteam string, play_type string", (2024, "KC", "BAL", "run")) == (
        "2024 (REG): KC vs BAL — RUN"
    )
    schema = "season int, down double, ydstogo double, yards_gained double, pass_attempt double, play_type string"
    row = (2024, 0.0, float("nan"), float("nan"), 1.0, "nan")
    assert describe(spark, schema, row) == "2024 (REG):  vs "


def test_play_description_stays_within_what_the_jvm_compiles(spark):
    """HotSpot interprets methods of over 8,000 bytes; a wide step before the description must not fill one with it."""
    names = [
        "season", "season_type", "posteam", "defteam", "play_type", "passer_player_name", "rusher_player_name", "receiver_player_name",
        "desc", "down", "ydstogo", "qtr", "week", "yardline_100", "yards_gained", "touchdown", "interception", "fumble_lost",
        "pass_attempt", "rush_attempt", *[f"other{i}" for i in range(15)],
    ]
    columns = [f"CASE WHEN id % {i + 3} > 0 THEN concat('{c}', CAST(id % {i + 5} AS STRING)) END AS {c}" for i, c in enumerate(names)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plays = spark.range(10).selectExpr("*", *columns)
        code = with_description(plays)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8000


def test_counted_and_null_safe_join(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    counts = counted(df, "a", "b")
    assert sorted(tuple(r) for r in counts.collect()) == [(1, None, 2), (2, "x", 1)]
    other = spark.createDataFrame([(1, None, 10)], "a int, b string, c int")
    assert [tuple(r) for r in join_on_same(counts, other, ["a", "b"]).collect()] == [(1, None, 2, 10)]


def test_profile_is_taken_from_the_latest_week(spark):
    rows = [("p", 1, "A", "KC", 1.0), ("p", 2, None, "SF", 2.0), ("p", 3, None, "SF", None), ("q", 1, None, None, None)]
    df = spark.createDataFrame(rows, "id string, week int, name string, team string, x double")
    result = totals_with_profile(df, ["id"], {"name": "name", "club": "team"}, {"total": "x"})
    assert sorted(tuple(r) for r in result.collect()) == [("p", "A", "SF", 3.0), ("q", None, None, None)]


def brute_trailing(rows, size):
    """Trailing means per (week, value) order, as a multiset of (key, week, value, mean)."""
    result = []
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        for i, row in enumerate(own):
            frame = [r[2] for r in own[max(0, i - size + 1): i + 1] if r[2] is not None]
            result.append((*row, sum(frame) / len(frame) if frame else None))
    return result


@pytest.mark.parametrize("lanes, block", [(1, 2), (1, 100_000), (1, 3)])
def test_trailing_means_equal_a_window_over_unfolded_rows(spark, monkeypatch, lanes, block):
    # With one lane the order within a week is that of the row hashes, which brute force can follow.
    monkeypatch.setattr(trailing, "LANES", lanes)
    monkeypatch.setattr(trailing, "BLOCK", block)
    random.seed(7)
    rows = []
    for key in ("hot", "b", "c"):
        for week in range(1, 9):
            for _ in range(random.choice([0, 1, 1, 2, 9]) if key == "hot" else random.choice([0, 1])):
                rows.append((key, week, random.choice([None, 1.0, 2.0, 4.0])))
    rows += [("copies", 1, 8.0)] * 50 + [("copies", 2, 2.0)]
    df = spark.createDataFrame(rows, "key string, week int, x double")
    hashes = {tuple(r)[:3]: r.h for r in df.distinct().withColumn("h", F.xxhash64(*df.columns)).collect()}
    rows.sort(key=lambda r: (r[0], r[1], hashes[r]))
    result = trailing.trailing_means(counted(df, *df.columns), ["key"], "week", {"mean": "x"}, rows=3)
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(brute_trailing(rows, 3), key=repr)


def test_trailing_means_with_lanes_keep_every_row_and_frame(spark):
    # 500 distinct rows in one week: the order within the week is free, so frames are checked as a whole.
    rows = [("hot", 1, float(i)) for i in range(500)] + [("hot", 2, 1000.0)]
    df = spark.createDataFrame(rows, "key string, week int, x double")
    result = trailing.trailing_means(counted(df, *df.columns), ["key"], "week", {"mean": "x"}, rows=3).collect()
    assert sorted(r.x for r in result) == sorted(r[2] for r in rows)
    # Every value but those at both ends of the week occurs in three frames; week 2 sees the last two.
    in_week = [r for r in result if r.week == 1]
    assert sum(r["mean"] == r.x for r in in_week) < 500
    total = sum(r["mean"] for r in in_week)
    assert abs(total - sum(r.x for r in in_week)) < 1500
    last = next(r for r in result if r.week == 2)
    assert 1000 / 3 < last["mean"] < (1000 + 499 + 498) / 3 + 1e-9


def test_summary_equals_statistics(spark):
    random.seed(11)
    rows = []
    for key in ("even", "odd", "copies", "one", None):
        size = {"even": 40, "odd": 41, "copies": 7, "one": 1, None: 12}[key]
        rows += [(key, random.choice([0.25, 1.75, 1.5, 99.0, 100.0, 100.5, -3.0])) for _ in range(size)]
    rows += [("copies", 100.0)] * 200 + [("odd", None)] * 3 + [("empty", None)] * 2
    rows += [("straddle", 1.5), ("straddle", 2.5)]
    df = spark.createDataFrame(rows, "key string, x double")
    found = {
        r.key: (r["mean"], r["median"], r["size"])
        for r in summarize(counted(df, "key", "x"), ["key"], "x", "copies").collect()
    }
    for key in {r[0] for r in rows}:
        known = [r[1] for r in rows if r[0] == key and r[1] is not None]
        mean, median, size = found[key]
        assert size == sum(r[0] == key for r in rows)
        assert median == (statistics.median(known) if known else None)
        assert mean == (pytest.approx(statistics.fmean(known)) if known else None)
    assert len(found) == len({r[0] for r in rows})


def test_median_of_a_million_values_inside_one_whole_number(spark):
    """Each digit leaves a small share of the group to be ranked, and none changes the result."""
    size = 1_000_000
    values = spark.range(size, numPartitions=8).select(
        F.lit("a").alias("key"), (F.lit(7.0) + F.pmod(F.col("id") * 7919, F.lit(size)) / F.lit(1.1 * size)).alias("x"),
        F.lit(1).cast("long").alias("copies"),
    )
    whole = [middle_rows(values, ["key"], "x", "copies", resolution=1, digits=n).count() for n in (0, 1, 2)]
    assert whole[0] == size and whole[1] < 60 and 1 <= whole[2] <= 2
    expected = ((size // 2 - 1) / (1.1 * size) + (size // 2) / (1.1 * size)) / 2 + 7
    for digits in (0, 1, 2):
        row = summarize(values, ["key"], "x", "copies", digits=digits).first()
        assert row["median"] == pytest.approx(expected, abs=1e-12) and row["size"] == size


def test_median_digits_agree(spark):
    """Negative, tiny, huge, equal and missing values, with copies; every number of digits gives the exact median."""
    random.seed(4)
    rows = []
    for key in range(30):
        for _ in range(random.randint(1, 40)):
            x = random.choice([None, random.gauss(0, 1), random.gauss(0, 1) * 1e-9, random.gauss(0, 1e9), 1.0, -0.5, 1e-300, -1e-300])
            rows.append((key, x, random.randint(1, 5)))
    rows += [(99, None, 3), (None, 2.0, 1), (None, 4.0, 1)]
    frame = spark.createDataFrame(rows, "key int, x double, copies long").groupBy("key", "x").agg(F.sum("copies").alias("copies"))
    expected = {}
    for key in {r[0] for r in rows}:
        known = [x for k, x, n in rows if k == key and x is not None for _ in range(n)]
        expected[key] = (statistics.median(known) if known else None, sum(n for k, _, n in rows if k == key))
    for digits in range(4):
        found = {r.key: (r["median"], r["size"]) for r in summarize(frame, ["key"], "x", "copies", digits=digits).collect()}
        assert found == expected
