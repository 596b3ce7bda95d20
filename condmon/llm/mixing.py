"""Mixing sources to target weights by Poisson replication.

A source with share s of the corpus and target weight w is repeated w / s times on average (times
``size``, the output's size over the input's). Each row's count is the inverse Poisson
distribution, with that mean, of a uniform number hashed from seed, id and text; the row is
exploded by its count, and every copy gets a hashed place in one global order. No mean is too large:
beyond ``DIRECT_RATE`` the terms start some deviations below the mean, the first by Stirling's series.

Counts depend on a row's content and the rates alone, so the result is the same however the rows
are partitioned, and a lost task recomputes its own rows. Sources are counted over all rows; the
table of rates, one row for each source, is written, so its size decides how Spark joins it. Places are uniform, so
the k-th of p partitions takes the places from k / p on, and no pass over the rows is needed to find borders.

Defined cases: a null source is a source of its own; a source without a target weight takes the
weight 0 (no copies) if weights are given; null ids and texts are hashed as empty ones; repeated rows
get equal counts and places, as they are equal in all that is hashed; rows of one place go by id and replica;
texts of any length are kept whole; further columns are kept, but columns named replica, rate or mix_key are
refused; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, require, written

BITS = 52
#: Up to this mean terms are summed from 0, where exp(-mean) is a normal double.
DIRECT_RATE = 500
#: Copies of a row are exploded by this many at a time.
RUN = 1 << 16


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) of 52 hashed bits."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / float(1 << BITS)


def poisson_count(u: Column, rate: Column) -> Column:
    """Least k whose cumulative probability exceeds ``u``, found term by term.

    The terms within 12 deviations + 24 of the mean hold all but 1e-16 of the probability.
    """
    far = F.lit(12.0) * F.sqrt(rate) + 24
    first = F.when(rate > DIRECT_RATE, F.floor(rate - far)).otherwise(0).cast("int")
    given = F.struct(u.alias("u"), rate.alias("rate"), first.alias("first"), F.ceil(rate + far).cast("int").alias("last"))

    def start(g: Column) -> Column:
        k = g["first"].cast("double")
        d = g["rate"] - k
        stirling = k * F.log1p(d / k) - d - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
        return F.exp(F.when(g["first"] > 0, stirling).otherwise(-g["rate"]))

    def count(g: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            term = s["term"] * g["rate"] / k
            more = g["u"] >= s["below"]
            return F.struct(
                F.when(more, k).otherwise(s["k"]).alias("k"), term.alias("term"), F.when(more, s["below"] + term).otherwise(s["below"]).alias("below")
            )

        zero = let(start(g), lambda t: F.struct(g["first"].alias("k"), t.alias("term"), t.alias("below")))
        return F.aggregate(F.sequence(g["first"] + 1, g["last"]), zero, step, lambda s: s["k"])

    return let(given, count)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, by: str = "source") -> DataFrame:
    """by, n, rate. Without weights, a source's weight is its count to the power ``temperature``."""
    require(docs, by)
    counts = docs.groupBy(by).agg(F.count("*").alias("n"))
    if weights is None:
        given = counts.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()), f"{by} string, weight double")
        given = counts.join(table, by, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = given.agg(F.sum("n").alias("all"), F.sum("weight").alias("weights"))
    return given.crossJoin(F.broadcast(total)).select(by, "n", (size * F.col("weight") / F.col("weights") * F.col("all") / F.col("n")).alias("rate"))


def copies(count: Column) -> Column:
    """Arrays of at most RUN replica numbers, 1 to ``count`` in all; null for none. The count is evaluated once."""
    last = lambda r, n: F.least((r + 1) * RUN, n)
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda r: F.struct((r * RUN + 1).alias("a"), last(r, n).alias("b")))
    return let(count, lambda n: F.when(n > 0, runs(n)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 17, by: str = "source") -> DataFrame:
    """The columns of ``docs`` with rate, replica (from 1) and mix_key; the partitions' order and their rows' order follow mix_key."""
    require(docs, "doc_id", "text", by)
    if clash := {"replica", "rate", "mix_key"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    rated = written(rates(docs, weights, temperature, size, by).select(F.col(by).alias("_by"), "rate"), "rates")
    key = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    joined = docs.withColumn("_text", key).join(rated, docs[by].eqNullSafe(F.col("_by"))).drop("_by")
    runs = joined.withColumn("_run", F.explode(copies(poisson_count(uniform(seed, F.col("doc_id"), F.col("_text")), F.col("rate")))))
    each = runs.withColumn("replica", F.explode(F.sequence("_run.a", "_run.b"))).drop("_run")
    placed = each.withColumn("mix_key", uniform(seed + 1, F.col("doc_id"), F.col("_text"), F.col("replica"))).drop("_text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(parts, F.floor(F.col("mix_key") * parts).cast("int")).sortWithinPartitions("mix_key", "doc_id", "replica")
