"""Steps that several others read, written once.

A derived table that is used in many places of a plan is derived anew in each. A step is written as Parquet to the folder
that the driver and all executors share and read from there, which also cuts its lineage: a lost executor costs the step at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process by application, for ``clear``.
_folders: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a local session takes its warehouse folder, and any other is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return top.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


class Steps:
    """Tables of one run in a folder of their own. What a result still reads stays until ``close`` or ``clear``."""

    def __init__(self, spark: SparkSession, name: str = "steps") -> None:
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _folders.setdefault(spark.sparkContext.applicationId, []).append(self.top)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n:03}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        _delete(self.spark, self.top)


def clear(spark: SparkSession) -> None:
    """Delete all steps of this session; results that read them are gone with them."""
    for top in _folders.pop(spark.sparkContext.applicationId, []):
        _delete(spark, top)
