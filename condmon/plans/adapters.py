"""The driver's tables in the roles that the operators expect.

An ``events`` row of any type but signup is a log reading of the asset ``user_id``; the index counts all
of an asset's rows in time, so a signup leaves a hole in it. Errors above 60 are failures of one hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import add_seconds
from ..operators import cycles, features, labels, profiles, quality, snapshots
from ..operators.windows import numbered
from ..steps import Steps

DAY = 86_400
GAP, WINDOW, HORIZON, NOMINAL = DAY, 3 * DAY, 2 * DAY, 36_000
VALIDATION_START, TEST_START = "2024-01-15 00:00:00", "2024-01-22 00:00:00"


CONTRACT = quality.Contract(bounds=(("value", 0.0, 450.0),))
#: Steps that a query of each kind reads in several places.
LABELS = ("cycle_rows",)
WINDOWS = ("sequence", "cycle_rows", "windowed")
COVERED = (*WINDOWS, "covered", "bounds")
VIEW = (*COVERED, "view")
SCORES = ("cycle_rows", "score_points")


def step(make: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
    """A table that a run derives once; if its name is in ``kept`` it is written at first use."""

    @wraps(make)
    def once(self: Run) -> DataFrame:
        name = make.__name__
        if name not in self.made:
            df = make(self)
            self.made[name] = self.steps.keep(df, name) if name in self.kept else df
        return self.made[name]

    return once


class Run:
    """The steps of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: Iterable[str] = ()) -> None:
        self.spark, self.sf_dir, self.kept = spark, sf_dir, frozenset(kept)
        self.made: dict[str, DataFrame] = {}
        self.steps = Steps(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @step
    def rows(self) -> DataFrame:
        """All event rows in the columns of a log."""
        return self.table("events").select(
            F.col("user_id").alias("asset"),
            "ts",
            "event_id",
            "value",
            F.get_json_object("props", "$.k").cast("double").alias("second"),
            F.col("event_type").isin("click", "view", "purchase").cast("byte").alias("active"),
            F.concat(F.lit("e"), F.col("event_id")).alias("record_id"),
            "event_type",
        )

    @step
    def readings(self) -> DataFrame:
        """The log without its index, which costs a pass over all rows."""
        return self.rows().where("event_type != 'signup'").drop("event_type", "event_id")

    @step
    def log(self) -> DataFrame:
        """asset, idx, ts, value, second, active (0 or 1), record_id."""
        return numbered(self.rows(), ["asset"], "ts", ["ts", "event_id"], "idx").where("event_type != 'signup'").drop("event_type", "event_id")

    @step
    def failures(self) -> DataFrame:
        """asset, record_id, source_row, failure_start, failure_end."""
        e = self.table("events").where("event_type = 'error' and value > 60")
        start, end = F.col("ts").alias("failure_start"), add_seconds(F.col("ts"), 3600).alias("failure_end")
        return e.select(F.col("user_id").alias("asset"), F.concat(F.lit("f"), F.col("event_id")).alias("record_id"), F.col("event_id").alias("source_row"), start, end)

    @step
    def raw_log(self) -> DataFrame:
        """The log as dirty text: some keys, times, numbers and states are broken by rule."""
        n = F.substring("record_id", 2, 20).cast("long")
        return self.log().select(
            "asset",
            "record_id",
            F.when(n % 97 == 0, "x").when(n % 89 == 0, "1").otherwise(F.col("idx").cast("string")).alias("idx_raw"),
            F.when(n % 83 == 0, "2024-13-01 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts_raw"),
            F.when(n % 79 == 0, "NaN").when(n % 73 == 0, F.lit(None)).otherwise(F.col("value").cast("string")).alias("value_raw"),
            F.when(n % 71 == 0, "2.0").when(F.col("active") == 1, "1.0").otherwise("0.0").alias("active_raw"),
            F.when(n % 67 == 0, "broken,row").alias("corrupt_record"),
            F.concat(F.lit("src"), F.col("asset") % 3).alias("source"),
        )

    @step
    def raw_events(self) -> DataFrame:
        """Order rows as event reports with broken fields by rule."""
        o, n = self.table("orders"), F.col("o_orderkey")
        stamp = lambda c: F.date_format(c, "M/d/yyyy H:mm")
        return o.select(
            F.col("o_orderkey").alias("report_id"),
            F.when(n % 53 == 0, "?").when(n % 47 == 0, "7").otherwise(n.cast("string")).alias("source_row_raw"),
            F.when(n % 43 == 0, " ").otherwise(F.col("o_orderpriority")).alias("report_raw"),
            F.when(n % 41 == 0, "31/31/2020 1:00").otherwise(stamp("o_orderdate")).alias("start_raw"),
            F.when(n % 37 == 0, stamp(add_seconds(F.col("o_orderdate"), -3600))).otherwise(stamp(add_seconds(F.col("o_orderdate"), 3600))).alias("end_raw"),
            F.when(n % 31 == 0, "").otherwise("stop").alias("kind_raw"),
            F.col("o_orderstatus").alias("severity_raw"),
            F.when(n % 29 == 0, "bad").alias("corrupt_record"),
        )

    @step
    def annotated(self) -> DataFrame:
        return quality.annotate(self.raw_log(), CONTRACT, "asset", GAP)

    @step
    def sequence(self) -> DataFrame:
        rows = self.log().withColumn(quality.REASONS, F.expr("cast(array() as array<string>)"))
        return quality.sequence(rows, "asset", 1, GAP, ("active",))

    @step
    def cycle_rows(self) -> DataFrame:
        return cycles.derive(self.sequence())

    @step
    def labelled(self) -> DataFrame:
        return labels.label(self.cycle_rows(), self.failures(), labels.observation_end(self.readings()), HORIZON)

    @step
    def points(self) -> DataFrame:
        """Cycles with their prediction time."""
        return self.cycle_rows().withColumn("prediction_ts", F.when(~F.col("right_censored"), F.col("stop_ts")))

    @step
    def windowed(self) -> DataFrame:
        return features.signal_window(self.points(), self.readings(), "value", WINDOW)

    @step
    def covered(self) -> DataFrame:
        return features.internal_gaps(features.coverage(self.windowed(), self.sequence()), self.sequence(), WINDOW)

    @step
    def bounds(self) -> DataFrame:
        return profiles.tail_bounds(self.covered(), steps=self.steps)

    @step
    def eligible(self) -> DataFrame:
        return features.eligibility(self.windowed(), self.covered(), GAP)

    @step
    def snapshot_v1(self) -> DataFrame:
        return snapshots.snapshot(self.eligible(), {"dataset_version": F.lit("events-v1")})

    @step
    def snapshot_v2(self) -> DataFrame:
        return snapshots.snapshot_v2(self.snapshot_v1(), cycles.context(self.cycle_rows()))

    @step
    def view_v1(self) -> DataFrame:
        return snapshots.modelling_view(self.snapshot_v1(), self.labelled(), {"failure_dataset_version": F.lit("errors-v1")}, False)

    @step
    def view(self) -> DataFrame:
        """The v2 view with the part each row belongs to."""
        df = snapshots.modelling_view(self.snapshot_v2(), self.labelled(), {"failure_dataset_version": F.lit("errors-v1")}, True)
        return df.withColumn("part", snapshots.partition(F.col("prediction_ts"), VALIDATION_START, TEST_START))

    @step
    def score_points(self) -> DataFrame:
        """Available windows with mean value / 500 as a score: a fixed rule, so that SQL can repeat it."""
        win = self.windowed().where("win_status = 'available' and win_mean is not null")
        return win.select("asset", "cycle_id", "prediction_ts", F.least(F.round(F.col("win_mean") / 500, 9), F.lit(1.0)).alias("probability"))
