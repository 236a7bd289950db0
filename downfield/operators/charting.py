"""Usage rates of charted tendencies over pass and run plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.functions.filters import number_equals, season_conditions, upper_equals, where_all
from downfield.functions.numeric import half_even
from downfield.operators.players import charted_play, play_keys
from downfield.operators.search import names_any

# Names of the answer and the charting columns they count. Output name -> charting flag.
TENDENCIES = {
    "play_action": "is_play_action",
    "rpo": "is_rpo",
    "screen_pass": "is_screen_pass",
    "no_huddle": "is_no_huddle",
    "motion": "is_motion",
    "trick_play": "is_trick_play",
}
# output name -> (charting column, pass plays only)
CROWDS = {
    "avg_defenders_in_box": ("n_defense_box", False),
    "avg_pass_rushers": ("n_pass_rushers", True),
    "avg_blitzers": ("n_blitzers", True),
}


def charting_tendencies(
    charting: DataFrame,
    plays: DataFrame,
    team: str | None = None,
    opponent: str | None = None,
    player: str | None = None,
    season: int | None = None,
    season_from: int | None = None,
    season_to: int | None = None,
    week: int | None = None,
    season_type: str | None = None,
) -> DataFrame:
    """One row: plays, count and percent per tendency, average crowds; no row if no play matches.

    Charting is summed per play before the join, on the partitioning of the join. Where it has a season, that
    is part of the join key, so a filter on the season reaches the scans of both tables.
    """
    keys = play_keys(charting)
    sums = {"charted": F.count(F.lit(1))}
    sums |= {name: F.count_if(column) for name, column in TENDENCIES.items()}
    for name, (column, _) in CROWDS.items():
        sums |= {name: F.sum(column), f"{name}_n": F.count(column)}
    charted = (
        charting.select(*charted_play(charting), *TENDENCIES.values(), *[column for column, _ in CROWDS.values()])
        .groupBy(*keys).agg(*[value.alias(name) for name, value in sums.items()])
    )
    chosen = where_all(
        plays.where(F.col("play_type").isin("pass", "run")),
        [
            upper_equals("posteam", team),
            upper_equals("defteam", opponent),
            names_any(player),
            *season_conditions(season, season_from, season_to),
            number_equals("week", week),
            upper_equals("season_type", season_type),
        ],
    ).select(
        *[k for k in keys if k != "play_id"], F.col("play_id").cast("double").alias("play_id"),
        (F.col("play_type") == "pass").alias("is_pass"),
    )

    totals = {"total_plays": F.sum("charted")} | {name: F.sum(name) for name in TENDENCIES}
    for name, (_, pass_only) in CROWDS.items():
        for part in (name, f"{name}_n"):
            totals[part] = F.sum(F.when(F.col("is_pass"), F.col(part)) if pass_only else F.col(part))
    found = chosen.join(charted, keys).agg(*[value.alias(name) for name, value in totals.items()])

    # an exact tie goes to the even digit here, unlike in the stored tables
    columns = [F.col("total_plays")]
    for name in TENDENCIES:
        columns += [F.col(name), half_even(F.lit(100.0) * F.col(name) / F.col("total_plays"), 1).alias(f"{name}_pct")]
    columns += [half_even(F.col(name) / F.col(f"{name}_n"), 2).alias(name) for name in CROWDS]
    return found.where(F.col("total_plays") > 0).select(*columns)
