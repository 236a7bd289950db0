"""Player-season analytics: touchdown luck, role trend, separation, drops, contract value."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.functions.grouping import counted, totals_with_profile
from downfield.functions.numeric import half_up, percent, ratio
from downfield.functions.trailing import trailing_means



def play_keys(charting: DataFrame) -> list[str]:
    """What identifies a charted play among plays."""
    return ["game_id", "play_id", "season"] if "season" in charting.columns else ["game_id", "play_id"]


def charted_play(charting: DataFrame) -> list[Column]:
    """The `play_keys` of charting rows, named and typed as those of plays."""
    keys = [F.col("nflverse_game_id").alias("game_id"), F.col("nflverse_play_id").cast("double").alias("play_id")]
    return [*keys, F.col("season").cast("int").alias("season")] if "season" in charting.columns else keys


_PROFILE = {"full_name": "full_name", "position": "position", "team": "posteam"}


def _player_weeks(opportunity: DataFrame) -> DataFrame:
    """Opportunity rows of known players; the season arrives as text and the week as a double."""
    return opportunity.where(F.col("player_id").isNotNull()).withColumns(
        {"season": F.col("season").cast("int"), "week": F.col("week").cast("int")}
    )


def td_luck(opportunity: DataFrame) -> DataFrame:
    """Touchdowns scored against touchdowns expected, per player and season."""
    totals = totals_with_profile(
        _player_weeks(opportunity),
        ["player_id", "season"],
        _PROFILE,
        {
            "rec_td": "rec_touchdown",
            "rec_td_exp": "rec_touchdown_exp",
            "rec_td_luck": "rec_touchdown_diff",
            "rush_td": "rush_touchdown",
            "rush_td_exp": "rush_touchdown_exp",
            "rush_td_luck": "rush_touchdown_diff",
        },
    )
    luck = half_up(F.col("rec_td_luck") + F.col("rush_td_luck"), 3)
    return totals.select(
        "player_id", "full_name", "position", "team", "season",
        "rec_td", "rec_td_exp", "rec_td_luck", "rush_td", "rush_td_exp", "rush_td_luck",
        luck.alias("total_td_luck_score"),
    )


def role_trend(opportunity: DataFrame, snaps: DataFrame) -> DataFrame:
    """Weekly usage shares with their average over the last three played weeks and the change against it."""
    shares = ["snap_pct", "target_share_pct", "carry_share_pct", "air_yards_share_pct"]
    where = ["full_name", "team", "season", "week"]
    players = _player_weeks(opportunity).select(
        "player_id", "full_name", "position",
        F.col("posteam").alias("team"),
        "season", "week",
        percent(F.col("rec_attempt"), F.col("rec_attempt_team"), 2).alias("target_share_pct"),
        percent(F.col("rush_attempt"), F.col("rush_attempt_team"), 2).alias("carry_share_pct"),
        percent(F.col("rec_air_yards"), F.col("rec_air_yards_team"), 2).alias("air_yards_share_pct"),
    )
    played = snaps.select(
        F.col("player").alias("full_name"), "team",
        F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"),
        half_up(F.lit(100.0) * F.col("offense_pct"), 2).alias("snap_pct"),
    )
    # Both sides are counted first: copies multiply counts instead of pairs. Rows without a full key
    # match nothing and would all meet in one partition, so the salt spreads them.
    keyless = reduce(or_, [F.col(c).isNull() for c in where])
    salt = F.when(keyless, F.pmod(F.xxhash64(*players.columns), F.lit(256))).otherwise(0)
    counted_players = counted(players, *players.columns).withColumn("salt", salt)
    counted_snaps = counted(played, *played.columns, count="snap_copies").withColumn("salt", F.lit(0).cast("long"))
    weekly = counted_players.join(counted_snaps, [*where, "salt"], "left").select(
        "player_id", "full_name", "position", "team", "season", "week", *shares,
        (F.col("copies") * F.coalesce("snap_copies", F.lit(1))).alias("copies"),
    )
    trend = trailing_means(
        weekly, ["player_id", "season"], "week", {f"{share}_mean": share for share in shares}, rows=3
    )
    return trend.select(
        "player_id", "full_name", "position", "team", "season", "week", *shares,
        *[half_up(F.col(f"{share}_mean"), 2).alias(f"{share}_3wk") for share in shares],
        *[half_up(F.col(share) - F.col(f"{share}_mean"), 2).alias(f"{share}_delta") for share in shares],
    )


def separation_opportunity(opportunity: DataFrame, receiving: DataFrame) -> DataFrame:
    """Receivers who get open, against what they produced, per player and season.

    Both sides are grouped by player and season first, so the join meets one row per key on the
    partitioning the grouping left behind. Opportunity is read once: its first grouping is by week, so the
    second one sees the weeks of a player as well as the sums.
    """
    keys = ["player_id", "season"]
    totals = totals_with_profile(
        _player_weeks(opportunity),
        keys,
        _PROFILE,
        {
            "fp_diff": "total_fantasy_points_diff",
            "td_diff": "rec_touchdown_diff",
            "catch_diff": "receptions_diff",
            "targets": "rec_attempt",
            "targets_team": "rec_attempt_team",
            "air_yards": "rec_air_yards",
            "air_yards_team": "rec_air_yards_team",
        },
        weeks="games",
    )
    tracked = ["avg_separation", "avg_yac_above_expectation", "catch_percentage"]
    open_space = (
        receiving.where((F.col("week") > 0) & F.col("player_gsis_id").isNotNull())
        .groupBy(F.col("player_gsis_id").alias("player_id"), F.col("season").cast("int").alias("season"))
        .agg(*[F.avg(c).alias(c) for c in tracked])
    )
    per_game = half_up(ratio(F.col("fp_diff"), F.col("games")), 3)
    td = half_up(F.col("td_diff"), 3)
    return (
        totals.join(open_space, keys)
        .select(
            "player_id", "full_name", "position", "team", "season", "games", "fp_diff",
            per_game.alias("fp_diff_per_game"),
            td.alias("td_luck"),
            half_up(F.col("catch_diff"), 3).alias("catch_luck"),
            percent(F.col("targets"), F.col("targets_team"), 2).alias("target_share_pct"),
            percent(F.col("air_yards"), F.col("air_yards_team"), 2).alias("air_yards_share_pct"),
            half_up(F.col("avg_separation"), 3).alias("avg_separation"),
            half_up(F.col("avg_yac_above_expectation"), 3).alias("avg_yac_above_expectation"),
            half_up(F.col("catch_percentage"), 2).alias("catch_percentage"),
            ((F.col("avg_separation") > 2.5) & (per_game < -1.5) & (td < -1.0)).alias("regression_candidate"),
        )
    )


def drop_rate(charting: DataFrame, plays: DataFrame) -> DataFrame:
    """Catchable targets dropped per receiver, team and season.

    Charting is summed per play before the join, on the partitioning of the join, so repeated charting of a play
    multiplies counts, not rows. Where both tables have a season it is part of the join key, and a filter on the
    season of plays reaches charting.
    """
    flags = ["is_drop", "is_contested_ball", "is_created_reception"]
    keys = play_keys(charting)
    charted = (
        charting.where(F.col("is_catchable_ball")).select(*charted_play(charting), *flags)
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("catchable_targets"), *[F.count_if(f).alias(f) for f in flags])
    )
    targets = plays.where(F.col("receiver_player_id").isNotNull()).select(
        "game_id", F.col("play_id").cast("double").alias("play_id"), F.col("season").cast("int").alias("season"),
        F.col("posteam").alias("team"), "receiver_player_id", "receiver_player_name",
    )
    sums = ["catchable_targets", *flags]
    parts = (
        targets.join(charted, keys)
        .groupBy("receiver_player_id", "team", "season", "receiver_player_name")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
    return (
        parts.groupBy("receiver_player_id", "team", "season")
        .agg(F.min("receiver_player_name").alias("player"), *[F.sum(name).alias(name) for name in sums])
        .select(
            F.col("receiver_player_id").alias("player_id"), "player", "team", "season", "catchable_targets",
            F.col("is_drop").alias("drops"),
            percent(F.col("is_drop"), F.col("catchable_targets"), 2).alias("drop_rate_pct"),
            F.col("is_contested_ball").alias("contested_targets"),
            F.col("is_created_reception").alias("created_receptions"),
        )
    )


def contract_value(contracts: DataFrame, opportunity: DataFrame) -> DataFrame:
    """Fantasy points per million of yearly pay; the active contract is set against every season.

    A player's seasons are summed on the partitioning by player that the join needs.
    """
    active = (
        contracts.where(F.col("is_active") & F.col("gsis_id").isNotNull())
        .groupBy(F.col("gsis_id").alias("player_id"), F.col("position").alias("contract_position"))
        .agg(F.max("apy").alias("apy"), F.max("apy_cap_pct").alias("cap_pct"))
        .groupBy("player_id")
        .agg(
            F.min("contract_position").alias("contract_position"),
            F.max("apy").alias("apy"),
            F.max("cap_pct").alias("cap_pct"),
        )
    )
    produced = totals_with_profile(
        _player_weeks(opportunity),
        ["player_id", "season"],
        _PROFILE,
        {"total_fp": "total_fantasy_points", "total_fp_exp": "total_fantasy_points_exp"},
        partition_by=["player_id"],
    )
    return produced.join(active, "player_id").select(
        "player_id", "full_name",
        F.coalesce("position", "contract_position").alias("position"),
        "team", "season",
        half_up(F.col("apy"), 4).alias("apy"),
        half_up(F.col("cap_pct"), 4).alias("cap_pct"),
        half_up(F.col("total_fp"), 2).alias("total_fp"),
        half_up(F.col("total_fp_exp"), 2).alias("total_fp_exp"),
        half_up(ratio(F.col("total_fp"), F.col("apy")), 2).alias("fp_per_million"),
    )
