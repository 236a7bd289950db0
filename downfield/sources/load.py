"""Loading datasets into the warehouse."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from downfield.sources.registry import Dataset
from downfield.sources.tables import merged_schema, prepare_plays, safe_names, with_stored_types
from downfield.sources.warehouse import Warehouse

# (dataset, season or None) -> rows of the source
Reader = Callable[[Dataset, int | None], DataFrame]

# what a reader may raise
_SOURCE_ERRORS = (PySparkException, OSError, KeyError, ValueError, RuntimeError)
# what a job raises, whether its source or its target fails
_JOB_ERRORS = (PySparkException, Py4JError)


@dataclass(frozen=True)
class Loaded:
    """What became of one dataset and season; `rejected` rows of the source were set aside."""

    dataset_id: str
    season: int | None
    rows: int
    outcome: str
    rejected: int = 0


class IncompleteLoad(ValueError):
    """A load after which a required table has no rows; `results` tells what became of each dataset and season."""

    def __init__(self, message: str, results: list[Loaded]):
        super().__init__(message)
        self.results = results


def file_reader(
    spark: SparkSession, root: str, format: str = "parquet", pattern: str = "{root}/{dataset}/season={season}",
    static_pattern: str = "{root}/{dataset}", **options: str,
) -> Reader:
    """Reads one path per dataset and season, and one per dataset without seasons.

    Patterns may name the dataset's loader and its options as well, such as `{root}/{loader}/{stat_type}/{season}`.
    """

    def read(dataset: Dataset, season: int | None) -> DataFrame:
        path = pattern if dataset.seasonal else static_pattern
        names = {**dataset.options, "root": root, "dataset": dataset.dataset_id, "loader": dataset.loader, "season": season}
        return spark.read.format(format).options(**options).load(path.format(**names))

    return read


def _read_rows(read: Reader, dataset: Dataset, season: int | None) -> DataFrame:
    rows = safe_names(read(dataset, season))
    return prepare_plays(rows) if dataset.table == "plays" else rows


def wanted_seasons(
    warehouse: Warehouse, datasets: Iterable[Dataset], seasons: Iterable[int], fresh: bool = False
) -> dict[str, list[int | None]]:
    """Per dataset, the covered seasons that are not loaded yet, or all covered ones if `fresh`.

    A dataset without seasons counts as one season, None.
    """
    seasons = list(seasons)
    covered = {d.dataset_id: [s for s in seasons if d.covers(s)] if d.seasonal else [None] for d in datasets}
    return covered if fresh else warehouse.ledger.pending(covered)


def outside_window(datasets: Iterable[Dataset], seasons: Iterable[int]) -> list[Loaded]:
    """One result for each requested season that a dataset does not cover, with the reason."""
    return [
        Loaded(d.dataset_id, season, 0, d.outside(season))
        for d in datasets if d.seasonal for season in seasons if not d.covers(season)
    ]


def _reads(frame: DataFrame) -> str | None:
    """Why the frame cannot be read to its end, None if it can."""
    try:
        frame.write.format("noop").mode("overwrite").save()
    except _JOB_ERRORS as error:
        return f"failed: {error}"
    return None


def load_seasonal(warehouse: Warehouse, dataset: Dataset, read: Reader, seasons: Iterable[int]) -> list[Loaded]:
    """Load the given seasons of a dataset and replace what is stored for them.

    A season that cannot be read, or has no rows, is passed over and leaves the others, and what is
    stored for it, untouched. Rows whose season is missing or another one are set aside, see
    `Warehouse.rejected`; the rest of their season is loaded. An error of the write itself is raised.
    """
    results, frames = [], {}
    for season in seasons:
        try:
            frames[season] = _read_rows(read, dataset, season)
        except _SOURCE_ERRORS as error:
            results.append(Loaded(dataset.dataset_id, season, 0, f"failed: {error}"))
    if frames:
        results += _load_seasons(warehouse, dataset, frames)
    return sorted(results, key=lambda result: result.season)


def _load_seasons(warehouse: Warehouse, dataset: Dataset, frames: dict[int, DataFrame]) -> list[Loaded]:
    """All seasons as one job; if it fails, the seasons whose source is at fault are left out of a second one."""
    try:
        return _load_together(warehouse, dataset, frames)
    except _JOB_ERRORS:
        faults = {season: fault for season, frame in frames.items() if (fault := _reads(frame))}
        if not faults:
            raise
    results = [Loaded(dataset.dataset_id, season, 0, fault) for season, fault in faults.items()]
    sound = {season: frame for season, frame in frames.items() if season not in faults}
    return results + (_load_seasons(warehouse, dataset, sound) if sound else [])


def _labelled(frame: DataFrame, season: int) -> DataFrame:
    """The rows with the season they were asked for and the one they say they belong to."""
    said = F.col("season").cast("int") if "season" in frame.columns else F.lit(season)
    return frame.withColumns({"_wanted": F.lit(season), "_said": said}).drop("season")


_LABELS = ["_wanted", "_said"]
_SEASON = T.StructType([T.StructField("season", T.IntegerType())])


def _fits() -> Column:
    return F.coalesce(F.col("_said") == F.col("_wanted"), F.lit(False))


def _load_together(warehouse: Warehouse, dataset: Dataset, frames: dict[int, DataFrame]) -> list[Loaded]:
    """Write the seasons in one job that reads every source once; the same job counts their rows.

    Only where rows are to be set aside are the seasons in question read again.
    """
    schema, parts, results = warehouse.schema(dataset.table), {}, []
    for season, frame in frames.items():
        try:
            parts[season] = with_stored_types(_labelled(frame, season), schema, keep=_LABELS)
        except AnalysisException as error:  # a type that the stored one cannot take
            results.append(Loaded(dataset.dataset_id, season, 0, f"failed: {error}"))
        else:
            schema = merged_schema(schema, parts[season].drop(*_LABELS).schema)
    if not parts:
        return results
    counts: list[Column] = []
    for season in parts:
        own = F.col("_wanted") == season
        counts += [F.count_if(own & _fits()).alias(f"good_{season}"), F.count_if(own & ~_fits()).alias(f"odd_{season}")]
    seen, at = Observation(), datetime.now(timezone.utc)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values()).observe(seen, *counts)
    fitting = rows.where(_fits()).withColumn("season", F.col("_wanted").cast("int")).drop(*_LABELS)
    warehouse.write_seasons(dataset.table, fitting, dataset.sort_by)
    good = {season: seen.get[f"good_{season}"] for season in parts}
    odd = {season: seen.get[f"odd_{season}"] for season in parts}
    filled = [season for season in parts if good[season]]
    if filled:
        columns = reduce(merged_schema, [parts[s].drop(*_LABELS).schema for s in filled], warehouse.schema(dataset.table))
        warehouse.extend_schema(dataset.table, merged_schema(columns, _SEASON))
        noted = {season: good[season] for season in filled}
        warehouse.ledger.record(dataset.dataset_id, dataset.table, dataset.loader, noted, at)
    for season in parts:
        if odd[season]:
            warehouse.set_aside(dataset.dataset_id, season, _odd_rows(frames[season], season), at)
        results.append(
            Loaded(dataset.dataset_id, season, good[season], "loaded" if good[season] else "no rows", odd[season])
        )
    return results


def _odd_rows(frame: DataFrame, season: int) -> DataFrame:
    """(reason, row) of the rows that do not belong to the season they came with; the row as JSON."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]))
    labelled = _labelled(frame.withColumn("_row", text), season)
    reason = F.when(F.col("_said").isNull(), "no season").otherwise(F.concat(F.lit("season "), F.col("_said").cast("string")))
    return labelled.where(~_fits()).select(reason.alias("reason"), F.col("_row").alias("row"))


def load_static(warehouse: Warehouse, dataset: Dataset, read: Reader) -> Loaded:
    """Replace a dataset without seasons; one that cannot be read or is empty leaves the stored rows.

    An error of the write itself is raised.
    """
    try:
        rows = with_stored_types(_read_rows(read, dataset, None))
    except _SOURCE_ERRORS as error:
        return Loaded(dataset.dataset_id, None, 0, f"failed: {error}")
    try:
        count = warehouse.replace(dataset.table, rows, allow_empty=False)
    except _JOB_ERRORS:
        fault = _reads(rows)
        if not fault:
            raise
        return Loaded(dataset.dataset_id, None, 0, fault)
    if not count:
        return Loaded(dataset.dataset_id, None, 0, "no rows")
    warehouse.ledger.record(dataset.dataset_id, dataset.table, dataset.loader, {None: count})
    return Loaded(dataset.dataset_id, None, count, "loaded")


def load_dataset(
    warehouse: Warehouse, dataset: Dataset, read: Reader, wanted: list[int | None]
) -> list[Loaded]:
    """Load what `wanted_seasons` lists for the dataset."""
    if dataset.seasonal:
        return load_seasonal(warehouse, dataset, read, wanted)
    return [load_static(warehouse, dataset, read) for _ in wanted]


def validate_loaded(warehouse: Warehouse, tables: Iterable[str]) -> dict[str, int]:
    """The rows of every table; an error unless each is stored and has rows.

    Rows are the counts that the loads noted when they wrote; only a table that no load noted is looked at.
    """
    tables = list(tables)
    sums = warehouse.ledger.latest().groupBy("table_name").agg(F.sum("row_count").alias("n"))
    noted = {r.table_name: r.n for r in sums.where(F.col("table_name").isin(tables)).collect()}
    rows = {
        t: 0 if not warehouse.exists(t) else noted[t] if t in noted else warehouse.read(t).count() for t in tables
    }
    empty = [t for t, n in rows.items() if not n]
    if empty:
        raise ValueError(f"No rows in required tables: {', '.join(empty)}")
    return rows
