"""How snap share recovers in the weeks after an injury absence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from downfield.functions.grouping import counted, latest
from downfield.functions.labels import injury_type
from downfield.functions.median import summarize
from downfield.functions.numeric import half_up

SPELL = ["gsis_id", "full_name", "position", "season", "injury_type", "first_out_week", "last_out_week"]


def out_spells(injuries: DataFrame) -> DataFrame:
    """Runs of consecutive weeks a player was listed as out, each distinct run once.

    Rows are numbered per player-season in week order, and rows with the same `week - number` form a
    spell. Copies of a row are counted first and numbered as a range. Two ranges can only share a
    spell within `span` numbers of their ends, where `span` is the player's first-to-last week
    distance; all numbers further inside a range are one-row spells of equal content, and the kept
    ends contain such a spell. Unfolding `span + 1` numbers at each end therefore gives every
    distinct spell, however many copies there are.
    """
    reported = F.coalesce("report_primary_injury", "practice_primary_injury")
    outs = injuries.where(
        (F.col("report_status") == "Out") & F.col("gsis_id").isNotNull() & reported.isNotNull()
    ).select(
        "gsis_id", "full_name", "position",
        F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"),
        injury_type(reported).alias("injury_type"),
    )
    player_season = Window.partitionBy("gsis_id", "season")
    so_far = player_season.orderBy("week", "injury_type", "full_name", "position")
    stop, size, reach = F.col("stop"), F.col("copies"), F.col("reach")
    numbered = (
        counted(outs, *outs.columns)
        .withColumns(
            {
                "stop": F.sum("copies").over(so_far.rowsBetween(Window.unboundedPreceding, 0)),
                "reach": F.max("week").over(player_season) - F.min("week").over(player_season) + 1,
            }
        )
        .withColumn(
            "number",
            F.explode(
                F.when(size <= 2 * reach, F.sequence(stop - size + 1, stop)).otherwise(
                    F.concat(F.sequence(stop - size + 1, stop - size + reach), F.sequence(stop - reach + 1, stop))
                )
            ),
        )
        .withColumn("island", F.col("week") - F.col("number"))
    )
    return (
        numbered.groupBy("gsis_id", "season", "island")
        .agg(
            latest("full_name", "week").alias("full_name"),
            latest("position", "week").alias("position"),
            F.mode("injury_type", deterministic=True).alias("injury_type"),
            F.min("week").alias("first_out_week"),
            F.max("week").alias("last_out_week"),
        )
        .select(*SPELL)
        .distinct()
    )


def _spells_with_shares(spells: DataFrame, snaps: DataFrame) -> DataFrame:
    """Each spell with the player's shares of the season: an array of (week, pct, copies), earliest first.

    Spells and shares meet by name and season in one shuffle. Equal shares of a week are counted before, and a share
    is a percentage with two decimals, so an array has at most some hundred entries per week.
    """
    seen = snaps.select(
        F.col("player").alias("full_name"), F.col("season").cast("int").alias("season"),
        F.col("week").cast("int").alias("week"), F.col("offense_pct").alias("pct"),
    ).where(F.col("full_name").isNotNull() & F.col("season").isNotNull())
    share = F.struct("week", "pct", "copies")
    shares = counted(seen, "full_name", "season", "week", "pct").select("full_name", "season", share.alias("share"))
    named = spells.where(F.col("full_name").isNotNull() & F.col("season").isNotNull())
    kept = [c for c in SPELL if c not in ("full_name", "season")]
    absences = named.select("full_name", "season", F.struct(*kept).alias("spell"))
    # collect_list passes over the null that stands for the other side
    return (
        shares.unionByName(absences, allowMissingColumns=True).groupBy("full_name", "season")
        .agg(F.array_sort(F.collect_list("share")).alias("shares"), F.collect_list("spell").alias("spells"))
        .withColumn("spell", F.explode("spells"))
        .select("full_name", "season", "spell.*", "shares")
    )


def injury_return_curve(injuries: DataFrame, snaps: DataFrame, weeks_after: int = 8, digits: int = 0) -> DataFrame:
    """Snap share 1 to 8 weeks after return as percent of the share before, per injury and position.

    Snap rows are counted per (player, season, week, share), so copies multiply counts. The share before is the
    mean over the weeks before the first week out, a slice of the player's season, and so are the weeks after.
    `digits` is handed to the median, see `summarize`.
    """
    spells = _spells_with_shares(out_spells(injuries), snaps)
    before = F.filter("shares", lambda s: (s["week"] < F.col("first_out_week")) & s["pct"].isNotNull())
    amount = F.aggregate("before", F.lit(0.0), lambda total, s: total + s["pct"] * s["copies"])
    known = F.aggregate("before", F.lit(0).cast("long"), lambda total, s: total + s["copies"])
    weeks_since = lambda s: s["week"] - F.col("last_out_week")
    after = F.filter("shares", lambda s: weeks_since(s).between(1, weeks_after))
    returned = (
        spells.withColumn("before", before)
        .withColumn("baseline_pct", amount / F.nullif(known, F.lit(0)))
        .where(F.col("baseline_pct") > 0)
        .withColumn("after", F.explode(after))
    )
    keys = ["injury_type", "position", "week_post_return"]
    recovery = returned.groupBy(
        "injury_type", "position", weeks_since(F.col("after")).alias("week_post_return"),
        (F.lit(100.0) * F.col("after.pct") / F.col("baseline_pct")).alias("recovery_pct"),
    ).agg(F.sum("after.copies").alias("copies"))
    return summarize(recovery, keys, "recovery_pct", "copies", digits=digits).select(
        *keys,
        half_up(F.col("mean"), 1).alias("avg_snap_pct_recovery"),
        half_up(F.col("median"), 1).alias("median_snap_pct_recovery"),
        F.col("size").alias("sample_size"),
    )
