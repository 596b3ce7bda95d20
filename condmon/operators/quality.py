"""Typing, row rules with reasons, quarantine and quality metrics. Rules append reasons and drop no row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bad_number, blank, content_id, count_if, exact_timestamp, pattern_timestamp, reasons, safe_number, seconds_between

REASONS = "reasons"


@dataclass(frozen=True)
class Contract:
    """Raw columns of a log: key, time, analogue and binary signals, and the limits of the analogue ones."""

    key: str = "idx_raw"
    ts: str = "ts_raw"
    analogue: tuple[tuple[str, str], ...] = (("value_raw", "value"),)
    binary: tuple[tuple[str, str], ...] = (("active_raw", "active"),)
    bounds: tuple[tuple[str, float, float], ...] = ()
    corrupt: str = "corrupt_record"


def typed(raw: DataFrame, c: Contract) -> DataFrame:
    """PRJ1, PRJ2: typed columns beside the raw ones."""
    numbers = {t: safe_number(F.col(r)) for r, t in (*c.analogue, *c.binary)}
    return raw.withColumns({"idx": F.col(c.key).try_cast("long"), "ts": exact_timestamp(F.col(c.ts)), **numbers})


def parsing_reasons(df: DataFrame, c: Contract) -> DataFrame:
    """VAL1: corrupt row, bad key, bad time, bad numbers."""
    rules = [(F.col(c.corrupt).isNotNull(), "malformed_csv"), (F.col("idx").isNull(), "invalid_idx"), (F.col("ts").isNull(), "invalid_ts")]
    rules += [(bad_number(F.col(t)), f"invalid_{t}") for _, t in (*c.analogue, *c.binary)]
    return df.withColumn(REASONS, reasons(*rules))


def add_reasons(df: DataFrame, *pairs: tuple[Column, str]) -> DataFrame:
    return df.withColumn(REASONS, F.concat(REASONS, reasons(*pairs)))


def range_reasons(df: DataFrame, bounds: tuple[tuple[str, float, float], ...]) -> DataFrame:
    """VAL2: finite values outside their limits."""
    return add_reasons(df, *[(~bad_number(F.col(n)) & ~F.col(n).between(lo, hi), f"out_of_range_{n}") for n, lo, hi in bounds])


def binary_reasons(df: DataFrame, names: list[str]) -> DataFrame:
    """VAL3: finite values other than 0 and 1; good ones become bytes, others null."""
    out = add_reasons(df, *[(~bad_number(F.col(n)) & ~F.col(n).isin(0.0, 1.0), f"invalid_domain_{n}") for n in names])
    return out.withColumns({n: F.when(F.col(n).isin(0.0, 1.0), F.col(n).cast("byte")) for n in names})


def duplicate_reasons(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """VAL4: every member of a group with a repeated key, null keys aside.

    Keys are counted first and only repeated ones are joined back, so no key's rows meet in a window.
    """
    for key in keys:
        flag = f"_repeated_{key[-1]}"
        known = df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key, F.lit(True).alias(flag))
        df = add_reasons(df.join(known, key, "left"), (F.col(flag), f"duplicate_{key[-1]}")).drop(flag)
    return df


def sequence(df: DataFrame, asset: str = "asset", step: int = 1, gap_seconds: int = 86_400, carried: tuple[str, ...] = ()) -> DataFrame:
    """VAL5, JN1: predecessor at exactly one index step, elapsed seconds, forward gap, out-of-order reason; ``carried`` columns of the predecessor as ``previous_``."""
    repeated = F.arrays_overlap(REASONS, F.array(F.lit("duplicate_idx"), F.lit("duplicate_ts")))
    fit = F.col("idx").isNotNull() & F.col("ts").isNotNull() & ~repeated
    rows = df.withColumn("_at", F.when(fit, F.col("idx")))
    before = rows.where("_at is not null").select(asset, (F.col("idx") + step).alias("_at"), F.col("idx").alias("previous_idx"), F.col("ts").alias("previous_ts"), *[F.col(c).alias(f"previous_{c}") for c in carried])
    out = rows.join(before, [asset, "_at"], "left").drop("_at")
    out = out.withColumn("interval_s", seconds_between(F.col("previous_ts"), F.col("ts")))
    out = out.withColumn("forward_gap", F.coalesce(F.col("interval_s") >= gap_seconds, F.lit(False)))
    return add_reasons(out, (F.col("interval_s") < 0, "out_of_order_ts"))


def annotate(raw: DataFrame, c: Contract, asset: str = "asset", gap_seconds: int = 86_400) -> DataFrame:
    """VAL6: all row rules of a log in order."""
    df = parsing_reasons(typed(raw, c), c)
    df = binary_reasons(range_reasons(df, c.bounds), [t for _, t in c.binary])
    return sequence(duplicate_reasons(df, [[asset, "idx"], [asset, "ts"]]), asset, 1, gap_seconds)


def annotate_events(raw: DataFrame) -> DataFrame:
    """VAL7, PRJ3: source row, times and texts of event reports."""
    df = raw.withColumns(
        {
            "source_row": F.col("source_row_raw").try_cast("long"),
            "event_start": pattern_timestamp(F.col("start_raw")),
            "event_end": pattern_timestamp(F.col("end_raw")),
            REASONS: F.expr("cast(array() as array<string>)"),
        }
    )
    df = add_reasons(df, (F.col("corrupt_record").isNotNull(), "malformed_csv"), (F.col("source_row").isNull(), "invalid_source_row"))
    df = duplicate_reasons(df, [["source_row"]])
    return add_reasons(
        df,
        (blank(F.col("report_raw")), "missing_report"),
        (F.col("event_start").isNull(), "invalid_event_start"),
        (F.col("event_end").isNull(), "invalid_event_end"),
        (F.col("event_end") < F.col("event_start"), "reversed_interval"),
        (blank(F.col("kind_raw")), "missing_kind"),
        (blank(F.col("severity_raw")), "missing_severity"),
    )


def split(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT1: accepted and quarantined rows."""
    return annotated.where(F.size(REASONS) == 0), annotated.where(F.size(REASONS) > 0)


def reason_histogram(annotated: DataFrame) -> DataFrame:
    """AGG3."""
    return annotated.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def metrics(annotated: DataFrame, version: str = "log-validation-v1", lineage: list[str] | None = None) -> DataFrame:
    """AGG1, AGG2: one row per lineage tuple with totals, gaps, a map of reason counts and a content-derived batch id."""
    by = lineage or []
    totals = annotated.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        count_if(F.size(REASONS) == 0).alias("accepted"),
        count_if(F.size(REASONS) > 0).alias("quarantined"),
        count_if(F.col("forward_gap")).alias("forward_gaps"),
    )
    each = annotated.select(*by, F.explode(REASONS).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))
    held = each.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    out = totals.join(held, by, "left") if by else totals.crossJoin(held)
    out = out.withColumn("reason_counts", F.coalesce("reason_counts", F.expr("cast(map() as map<string,bigint>)")))
    return out.withColumn("quality_batch_id", content_id("quality", version, *[F.col(b) for b in by]))


def key_safety(df: DataFrame, key: str) -> DataFrame:
    """VAL8: one row with null, blank and repeated keys."""
    nulls = df.agg(F.count("*").alias("n_rows"), count_if(F.col(key).isNull()).alias("null_keys"), count_if(blank(F.col(key).cast("string")) & F.col(key).isNotNull()).alias("blank_keys"))
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_keys"))
    return nulls.crossJoin(repeated)


def lineage_tuples(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """VAL9: keys (or the whole table) with other than exactly one complete lineage tuple."""
    by = by or []
    blanks = F.lit(False)
    for c in columns:
        blanks = blanks | blank(F.col(c).cast("string"))
    found = df.groupBy(*by).agg(F.count_distinct(F.struct(*columns)).alias("n_tuples"), count_if(blanks).alias("incomplete_rows"))
    return found.where("n_tuples != 1 or incomplete_rows > 0")


def source_profile(raw: DataFrame, asset: str = "asset", gap_seconds: int = 86_400, nominal_seconds: int = 36_000) -> DataFrame:
    """SRCPROF: per asset the counts, extrema, gaps, missing intervals and index breaks of a typed log with ``sequence`` columns."""
    missing = F.when(F.col("forward_gap"), F.floor(F.col("interval_s") / nominal_seconds) - 1).otherwise(0)
    return raw.groupBy(asset).agg(
        F.count("*").alias("n_rows"),
        count_if(F.col("ts").isNull()).alias("bad_ts"),
        count_if(F.col("value").isNull()).alias("bad_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        count_if(F.col("forward_gap")).alias("forward_gaps"),
        F.max("interval_s").alias("largest_interval_s"),
        F.sum(missing).cast("long").alias("missing_intervals"),
        (F.count("idx") - F.count("previous_idx") - 1).alias("index_breaks"),
        F.array_join(F.transform(F.sort_array(F.collect_set("active")), lambda x: x.cast("string")), ",").alias("active_domain"),
    )


def frequent_intervals(seq: DataFrame, k: int = 10, unit: int = 3600) -> DataFrame:
    """TOP5: the k most frequent intervals, in whole units."""
    each = seq.where("interval_s is not null").groupBy(F.floor(F.col("interval_s") / unit).alias("interval_units")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "interval_units").limit(k)
