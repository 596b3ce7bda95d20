"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions below: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark deletes the shuffle files of a finished query where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once. A lambda body that names an expression evaluates it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, separators: str = SPACE) -> Column:
    """Non-empty pieces between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share, the one named by ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) takes its warehouse folder; any other session is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one run in a folder of their own below the shared folder.

    Writing a table and reading it back cuts lineage, so lost executors cost no more than the step
    at hand. Each step's shuffle files go when it has been written, and ``drop`` deletes a table that
    no later step reads, so the files of a long operator don't add up on disk.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.top = spark, shared_path(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(f"{self.top}/{name}")
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table on its own; see ``Scratch``."""
    return Scratch(df.sparkSession, name).write(df, "table")


def require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 in groups of about ``size`` bytes, with the first one's row; null is empty."""
    at, group, held = 0, [], 0
    for k, x in enumerate(column):
        group.append((x.as_py() or "").encode())
        held += len(group[-1])
        if held >= size:
            yield at, group
            at, group, held = k + 1, [], 0
    if group:
        yield at, group


#: Bits of a Bloom filter for each of its hashes, most bits in all (32 MB), and how far a hash is shifted for each probe.
BITS_EACH, MOST_BITS, PROBES = 32, 1 << 28, (0, 17, 34)


def bloom(hashes: DataFrame, most_bits: int | None = None) -> np.ndarray:
    """Filter over 64-bit hashes (column ``h``), as uint64 words. Its size is bounded, and so is what the driver gathers: the words in use, as Arrow columns."""
    n = hashes.count()
    size = min(most_bits or MOST_BITS, 1 << max(10, (BITS_EACH * n).bit_length()))
    places = F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(size - 1) for s in PROBES])
    words = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be among those in the filter ``bits`` (uint64 words, a power of two)."""
    at = np.arange(len(w))
    for shift in PROBES:
        place = (w[at] >> np.uint64(shift)) & np.uint64(64 * len(bits) - 1)
        at = at[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
    return at
