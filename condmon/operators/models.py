"""Baselines, logistic models and their comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import named, percentiles_of
from .windows import running_down

#: Fixed values of the logistic fit.
MAX_ITERATIONS, REGULARISATION, ELASTIC_NET = 100, 0.1, 0.0


def robust_baseline(train: DataFrame, value: str, by: list[str]) -> DataFrame:
    """BAS1: exact median and median absolute deviation of the negative rows of each group. ``train`` is read four times."""
    rows = train.where(F.col(value).isNotNull() & ~F.col("failure_within")).select(*by, value)
    middle = percentiles_of(rows, value, by, (0.5,)).select(*by, "n", F.get("p", F.lit(0)).alias("median"))
    away = rows.join(middle, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("away"))
    return middle.join(percentiles_of(away, "away", by, (0.5,)).select(*by, F.get("p", F.lit(0)).alias("mad")), by)


def robust_score(df: DataFrame, baseline: DataFrame, value: str, by: list[str]) -> DataFrame:
    """BAS2: |x - median| / MAD; null without a baseline or a spread."""
    score = F.when(F.col("mad") > 0, F.abs(F.col(value) - F.col("median")) / F.col("mad"))
    return df.join(baseline.select(*by, "median", "mad"), by, "left").withColumn("deviation", score)


def directional(value: Column, threshold: float, scorable: Column) -> Column:
    """BAS4: value <= threshold, null where the row cannot be scored."""
    return F.when(scorable, value <= threshold)


def development_rows(view: DataFrame, inputs: list[str], test_start: str) -> DataFrame:
    """MOD1: trainable rows before the test boundary with all inputs; later rows are filtered in the scan."""
    return view.where((F.col("prediction_ts") < F.lit(test_start).cast("timestamp_ntz")) & (F.col("row_status") == "trainable")).dropna(subset=inputs)


def fit(train: DataFrame, inputs: list[str], label: str = "failure_within") -> LogisticRegressionModel:
    """MOD2, MOD3: standardised L2 logistic regression; an invalid input is an error."""
    vectors = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(train)
    lr = LogisticRegression(
        maxIter=MAX_ITERATIONS, regParam=REGULARISATION, elasticNetParam=ELASTIC_NET, standardization=True, fitIntercept=True, family="binomial", labelCol="label"
    )
    return lr.fit(vectors.withColumn("label", F.col(label).cast("double")))


def predict(model: LogisticRegressionModel, df: DataFrame, inputs: list[str]) -> DataFrame:
    """MOD7: probability of the positive class."""
    vectors = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(df)
    out = model.transform(vectors).withColumn("_p", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("_p", "probability")


def direction(model: LogisticRegressionModel) -> float:
    """Whether the probability rises (1) or falls (-1) with the input of a model of one, or does neither (0).

    Probabilities of inputs that differ in the last digits round to the same; the input times this orders rows without that loss.
    """
    slope = float(model.coefficients[0])
    return float((slope > 0) - (slope < 0))


def pr_area(scored: DataFrame, label: str = "failure_within") -> float:
    """MOD4."""
    rows = scored.select(F.col("probability"), F.col(label).cast("double").alias("label"))
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label", metricName="areaUnderPR").evaluate(rows)


def average_precision(scored: DataFrame, by: list[str], score: str = "probability", label: str = "failure_within") -> DataFrame:
    """MOD4 per group as rows: mean over positives of the precision at their score, ties sharing one point; null without positives.

    Equal scores are counted first; rows and positives above each score are sums over ranges of scores (``running_down``), so no window holds a group.
    """
    points = scored.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(label).alias("tp"), F.count_if(label).alias("pos"))
    ranked = running_down(points, by, score, ["n", "tp"])
    return ranked.groupBy(*by).agg(F.sum("pos").alias("positives"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos")).alias("average_precision"))


def evaluation(scored: DataFrame, by: list[str], score: str = "probability", label: str = "failure_within", shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """MOD8, MOD9: aggregates of a scored population: rows, positives, assets, time range, score distribution of all and of positives, average precision."""
    positive = F.when(F.col(label), F.col(score))
    also = {
        "n_rows": F.count("*"),
        "n_assets": F.count_distinct("asset"),
        "first_ts": F.min("prediction_ts"),
        "last_ts": F.max("prediction_ts"),
        "least": F.min(score),
        "mean": F.avg(score),
        "most": F.max(score),
        "mean_positive": F.avg(positive),
        "most_positive": F.max(positive),
    }
    out = named(percentiles_of(scored, score, by, shares, also), shares).drop("n")
    return out.join(average_precision(scored, by, score, label), by)


@dataclass(frozen=True)
class Candidate:
    name: str
    inputs: tuple[str, ...]


def compare(train: DataFrame, validation: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """MOD5: evidence per candidate, all on the same rows. The loop is over the given short list of candidates."""
    rows = []
    for c in candidates:
        scored = predict(fit(train, list(c.inputs)), validation, list(c.inputs))
        n, positives = scored.agg(F.count("*"), F.count_if("failure_within")).first()
        rows.append((c.name, len(c.inputs), n, positives, pr_area(scored)))
    return train.sparkSession.createDataFrame(rows, "candidate string, n_inputs int, n_rows long, positives long, pr_area double")


def select_best(evidence: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """MOD6: the best candidate, no row if several share the best value."""
    return unique_best(evidence, metric if largest else f"-{metric}")


def unique_best(table: DataFrame, score: str) -> DataFrame:
    """The row whose score (SQL) is alone the largest, in one pass: the best row of each score, then the best score if one row has it."""
    scored = table.select(F.expr(score).alias("_s"), F.struct(*table.columns).alias("row"))
    each = scored.groupBy("_s").agg(F.count("*").alias("n"), F.first("row").alias("row"))
    return each.agg(F.max_by(F.struct("n", "row"), "_s").alias("top")).where("top.n = 1").select("top.row.*")


def cross_partition_keys(train: DataFrame, test: DataFrame, key: list[str]) -> DataFrame:
    """SET3: keys that occur on both sides of a split."""
    both = train.select(*key, F.lit(0).alias("side")).unionByName(test.select(*key, F.lit(1).alias("side")))
    return both.groupBy(*key).agg(F.count_distinct("side").alias("n")).where("n > 1").drop("n")
