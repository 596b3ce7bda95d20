"""Compression classifier.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad.
A text is cut into chunks, each chunk is compressed with either dictionary, and the difference of
the two sizes over the text's bytes is its raw score: a text like the good ones packs better with
the good dictionary. A logistic curve turns the raw score into the probability of the good label. It
is fitted on scores of labelled rows by dictionaries of the other rows, in ``FOLDS`` parts; one of these
pairs of dictionaries then scores all texts, so the curve holds for it however few the labels are. The curve starts from the share of good labels,
so a text without bytes gets that share, and a few words say little either way.

Training takes at most ``max_rows`` rows of each label and at most ``max_bytes`` bytes of text of each,
from the rows with the smallest hash of their id; both bounds are parameters. Both labels are counted
over all usable rows, and calibration weights each label's rows to its count, so the prior does not depend
on the bounds. Scoring compresses every whole text, chunk by chunk, in bounded memory.

Defined cases: a null or empty text gets the share of good labels; repeated rows get equal scores;
rows with a null id are scored and never trained on; a label stands for all rows of its id; an id
with both labels has none; where one label has no training rows, every score is the share of good
labels; without any labels it is 0.5; texts of any length are taken whole; further columns are left
alone, and columns named score or predicted are replaced; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

CHUNK, DICT_BYTES, LEVEL, FOLDS = 512, 262144, 5, 5
#: Bytes of a text at which its score counts half.
SHRINK = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    prior: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Probability of the good label from rows of ``scorer``'s features."""
        z = np.log(self.prior / (1 - self.prior)) + features @ np.array([self.slope, self.shift])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scorer(good: bytes, bad: bytes) -> Callable[[str | None], tuple[float, float]]:
    """Function from text to its features: the size difference over the bytes, and 1, both shrunk for short texts."""
    if not good or not bad:
        return lambda text: (0.0, 0.0)
    import zstandard

    def sized(raw: bytes) -> Callable[[bytes], int]:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return lambda chunk: len(c.compress(chunk))

    of_good, of_bad = sized(good), sized(bad)

    def features(text: str | None) -> tuple[float, float]:
        parts = chunks(text)
        n = sum(map(len, parts))
        return sum(of_bad(p) - of_good(p) for p in parts) / (n + SHRINK), n / (n + SHRINK)

    return features


def chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]


def dictionary(texts: list[str]) -> bytes:
    """Dictionary of the texts' chunks; empty if they are too few."""
    import zstandard

    samples = [c for t in texts for c in chunks(t) if len(c) >= 8]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float, ridge: float = 4.0) -> tuple[float, float]:
    """Weights of the two features beside a fixed offset, by Newton's method; ``ridge`` holds few rows to the offset. The rows' mean weight is 1."""
    scale = np.array([x[:, 0].std() or 1.0, 1.0])
    a, w, pull = x / scale, np.zeros(2), ridge * np.ones(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + a @ w, -30, 30)))
        hess = (a * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, a.T @ (weight * (p - y)) + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def fit(texts: list[str], labels: list[int], counts: dict[int, int]) -> Model:
    """Model of the given rows; ``counts`` of the labels give the prior."""
    own = {y: [t for t, label in zip(texts, labels, strict=True) if label == y] for y in (0, 1)}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    flat = Model(b"", b"", 0.0, 0.0, prior)
    rows, pairs, of = [], [], {1: 1.0, 0: 0.0}
    for fold in range(FOLDS):
        pair = [dictionary([t for k, t in enumerate(own[y]) if k % FOLDS != fold]) for y in (1, 0)]
        if not all(pair):
            return flat
        pairs.append(pair)
        features = scorer(*pair)
        rows += [(*features(t), of[y], counts[y] / len(own[y])) for y in (1, 0) for t in own[y][fold::FOLDS]]
    x, y, weight = np.array(rows)[:, :2], np.array(rows)[:, 2], np.array(rows)[:, 3]
    curve = logistic(x, y, weight / weight.mean(), float(np.log(prior / (1 - prior))))
    return Model(*pairs[-1], *curve, prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_rows: int = 2000, max_bytes: int = 8 << 20) -> Model:
    """Fit on a bounded sample of the labelled rows that ``usable`` (over doc_id) lets through."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", label)
    given = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y in (0, 1)")
    given = given.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    given = given.where(usable) if usable is not None else given
    counts = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    key = F.xxhash64("doc_id", F.lit("train"))
    # max_rows ids of each label at most, picked on the labels alone: no text moves for the others.
    some = given.where("y = 1").orderBy(key, "doc_id").limit(max_rows).unionByName(given.where("y = 0").orderBy(key, "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    taken = {0: 0, 1: 0}
    texts, ys = [], []
    # Drawn partition by partition, so the driver never holds more than the bound and one partition.
    for r in rows.select(key.alias("k"), "doc_id", "text", "y").orderBy("k", "doc_id", "text").toLocalIterator():
        if taken[r["y"]] < max_bytes:
            taken[r["y"]] += len(r["text"].encode())
            texts.append(r["text"])
            ys.append(r["y"])
    return fit(texts, ys, counts)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add score and predicted (1 where score >= threshold)."""
    require(docs, text)
    # Plain values: a broadcast of an own class would ask the workers for this module.
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(*shared.value)
        features = scorer(held.good, held.bad)
        for s in parts:
            yield pd.Series(held.probability(np.array([features(t) for t in s], float).reshape(-1, 2)))

    out = docs.withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
