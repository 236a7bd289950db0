"""What is loaded: play counts per season and the load ledger per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(plays: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """Totals over plays, plays per season and type, loaded datasets and the last refresh.

    `ledger` has one row per dataset and season. Plays are scanned for two columns and grouped once;
    the totals are taken from the grouped rows.
    """
    seasons = plays.groupBy("season", "season_type").agg(F.count(F.lit(1)).alias("plays"))
    totals = seasons.agg(
        F.coalesce(F.sum("plays"), F.lit(0)).alias("total_plays"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        F.countDistinct("season").alias("num_seasons"),
    )
    datasets = ledger.groupBy("dataset_id", "table_name").agg(F.sum("row_count").alias("total_rows"))
    return {
        "totals": totals,
        "seasons": seasons.orderBy(F.asc_nulls_last("season"), F.asc_nulls_last("season_type")),
        "datasets": datasets.orderBy("dataset_id"),
        "refreshed": ledger.agg(F.max("loaded_at").alias("last_refreshed")),
    }


def catalog(ledger: DataFrame) -> DataFrame:
    """Rows, seasons and last load per dataset."""
    return (
        ledger.groupBy("dataset_id", "table_name")
        .agg(
            F.sum("row_count").alias("total_rows"),
            F.count(F.lit(1)).alias("seasons_loaded"),
            F.min("season").alias("min_season"),
            F.max("season").alias("max_season"),
            F.max("loaded_at").alias("last_loaded"),
        )
        .orderBy("dataset_id")
    )
