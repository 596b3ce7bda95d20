"""Keyed merges as pure functions of (target, source), and writers to versioned Parquet folders.

Plain Parquet has no row-level merge. Appends go through an anti join; a merge that changes rows is
written as a new version, and readers take the newest version that was committed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def same_rows(columns: list[str], a: str = "s", b: str = "t") -> Column:
    """JN11: null-safe equality of all columns."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _on(key: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in key])


def insert_only(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """SNK1, JN10: the source rows whose key the target lacks."""
    return source.join(target.select(*key), key, "left_anti")


def immutable_merge(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """SNK3: source keys with the action insert, equal or conflict (a changed row)."""
    joined = source.alias("s").join(target.alias("t"), _on(key), "left")
    found = F.col(f"t.{key[0]}").isNotNull()
    action = F.when(~found, "insert").when(same_rows(columns), "equal").otherwise("conflict")
    return joined.select(*[F.col(f"s.{k}").alias(k) for k in key], action.alias("action"))


def monotonic_merge(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """SNK2: the merged cycles with the action taken on each.

    New keys are inserted. An open row is updated when it has more observations or its stop has come. A changed start, fewer
    observations, or a change of a closed row is a conflict, which keeps the target's row.
    """
    columns = target.columns
    joined = source.select(*columns).alias("s").join(target.alias("t"), _on(key), "full")
    old, new = F.col(f"t.{key[0]}").isNotNull(), F.col(f"s.{key[0]}").isNotNull()
    fixed = same_rows([c for c in ("start_record_id", "start_type", "start_ts") if c in columns])
    open_, grown = F.col("t.right_censored"), F.col("s.n_observations") > F.col("t.n_observations")
    action = (
        F.when(~new, "keep")
        .when(~old, "insert")
        .when(same_rows(columns), "equal")
        .when(~fixed | ~open_ | (F.col("s.n_observations") < F.col("t.n_observations")), "conflict")
        .when(grown | ~F.col("s.right_censored"), "update")
        .otherwise("conflict")
    )
    take = action.isin("insert", "update")
    return joined.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns], action.alias("action"))


def reconcile(written: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """JN10, JN11: source rows that are missing from what was written or differ in it; none after a good write."""
    joined = source.alias("s").join(written.alias("t"), _on(key), "left")
    missing = F.col(f"t.{key[0]}").isNull()
    return joined.where(missing | ~same_rows(columns)).select(*[F.col(f"s.{k}").alias(k) for k in key], F.when(missing, "missing").otherwise("changed").alias("problem"))


def create(df: DataFrame, path: str) -> None:
    """SNK6: the first write; an error if the folder exists."""
    df.write.mode("errorifexists").parquet(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """SNK1: create the table or append the rows with new keys. A rerun appends none."""
    spark = df.sparkSession
    if not exists(spark, path):
        create(df, path)
        return
    insert_only(spark.read.parquet(path), df, key).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever store it names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions below a table's folder, oldest first."""
    if not exists(spark, path):
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    names = [str(f.getPath().getName()) for f in top.getFileSystem(conf).listStatus(top)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def write_version(df: DataFrame, path: str) -> str:
    """A whole new version; older ones stay readable. Two writers at once are not told apart."""
    found = versions(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(out := f"{path}/v={(found[-1] if found else 0) + 1}")
    return out


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def write_immutable(df: DataFrame, path: str, key: list[str], columns: list[str], lineage: list[str]) -> int:
    """SNK3: append the rows with new keys; refuse changed rows, and a source or target with other than one and the same lineage. Returns the rows added."""
    spark = df.sparkSession
    tuples = lambda x: {tuple(r) for r in x.select(*lineage).distinct().limit(2).collect()}
    own = tuples(df)
    if len(own) > 1:
        raise ValueError(f"more than one lineage: {sorted(map(str, own))}")
    if not exists(spark, path):
        create(df, path)
        return df.count()
    target = spark.read.parquet(path)
    if own and tuples(target) - own:
        raise ValueError("the target has another lineage")
    actions = {r["action"]: r["count"] for r in immutable_merge(target, df, key, columns).groupBy("action").count().collect()}
    if actions.get("conflict"):
        raise ValueError(f"{actions['conflict']} rows were changed")
    if actions.get("insert"):
        insert_only(target, df, key).write.mode("append").parquet(path)
    return actions.get("insert", 0)


def write_split(accepted: DataFrame, quarantined: DataFrame, path: str, key: list[str], n_expected: int) -> dict[str, int]:
    """SNK4: both tables, once their rows add up to the source's number; nothing is written otherwise."""
    sides = {"accepted": accepted, "quarantine": quarantined}
    counts = {name: df.count() for name, df in sides.items()}
    if sum(counts.values()) != n_expected:
        raise ValueError(f"{counts} do not add up to {n_expected} rows")
    for name, df in sides.items():
        append_new(df, f"{path}/{name}", key)
    return counts


def write_outputs(annotated: DataFrame, metrics: DataFrame, path: str, key: list[str]) -> dict[str, int]:
    """SNK5: accepted, quarantine and metrics; the metrics' totals must equal what was written."""
    from ..operators.quality import split

    totals = metrics.agg(F.sum("n_rows").alias("n"), F.sum("accepted").alias("a")).first()
    accepted, quarantined = split(annotated)
    if (found := accepted.count()) != totals["a"]:
        raise ValueError(f"metrics count {totals['a']} accepted rows, there are {found}")
    counts = write_split(accepted, quarantined, path, key, totals["n"])
    append_new(metrics, f"{path}/metrics", ["quality_batch_id"])
    return counts
