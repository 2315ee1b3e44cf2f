"""Classifiers over features, by pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_vector(df: DataFrame, features: str | list[str]) -> DataFrame:
    """A vector column ``features`` from an array column or from number columns."""
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def train_network(df: DataFrame, n_features: int, hidden: tuple[int, ...] = (32,), classes: int = 2, epochs: int = 100, seed: int = 0):
    """A network with hidden layers over rows (features vector, label); a functional stand-in with sigmoid units."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, classes], maxIter=epochs, seed=seed, featuresCol="features", labelCol="label").fit(df)


def scores(model, df: DataFrame) -> DataFrame:
    """``df`` with the probability of class 1 as score and the most likely class as label_pred."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("label_pred", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")


def train_linear(df: DataFrame, features: list[str], c: float = 100.0):
    """Min-max scaling and logistic regression with inverse regularisation ``c``."""
    n = df.count()
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features"), LogisticRegression(regParam=1.0 / (c * max(n, 1)), labelCol="label")]
    return Pipeline(stages=stages).fit(df)


def discriminant(df: DataFrame, features: list[str]):
    """Two-class linear discriminant: (weights, cut) from class means and the pooled covariance, which one pass of sums gives."""
    import numpy as np

    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count("*"), *(F.sum(F.col(f).cast("double")) for f in features), *(F.sum(F.col(features[i]).cast("double") * F.col(features[j])) for i, j in pairs)]
    rows = {r[0]: r[1:] for r in df.groupBy("label").agg(*sums).collect()}  # two rows
    mean, scatter, n = {}, np.zeros((d, d)), 0
    for k, r in rows.items():
        m = np.array(r[1 : 1 + d]) / r[0]
        mean[k] = m
        s = np.zeros((d, d))
        for (i, j), v in zip(pairs, r[1 + d :], strict=True):
            s[i, j] = s[j, i] = v
        scatter += s - r[0] * np.outer(m, m)
        n += r[0]
    w = np.linalg.solve(scatter / max(1, n - 2) + 1e-12 * np.eye(d), mean[1] - mean[0])
    cut = w @ (mean[0] + mean[1]) / 2 - np.log(rows[1][0] / rows[0][0])
    return w, float(cut)


def auc(df: DataFrame, score: str = "score") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label").evaluate(df)


def roc(df: DataFrame, score: str = "score", cuts: int = 101) -> DataFrame:
    """(cut, tpr, fpr) at evenly spaced score cuts: one combined count by bin, then sums over at most ``cuts`` rows."""
    from pyspark.sql import Window

    b = F.least(F.floor(F.col(score) * (cuts - 1)), F.lit(cuts - 1)).cast("int")
    n = df.groupBy(b.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return n.select((F.col("bin") / (cuts - 1)).alias("cut"), (F.sum("p").over(w) / F.sum("p").over(every)).alias("tpr"), (F.sum("q").over(w) / F.sum("q").over(every)).alias("fpr"))


def cross_validate(df: DataFrame, n_features: int, k: int, epochs: int = 50) -> DataFrame:
    """(mean, std) of accuracy over folds 0..k-1 in column fold; population standard deviation."""
    rows = []
    for f in range(k):
        model = train_network(df.filter(F.col("fold") != f), n_features, epochs=epochs)
        hit = scores(model, df.filter(F.col("fold") == f)).agg(F.avg((F.col("label_pred") == F.col("label")).cast("double"))).first()[0]
        rows.append((f, hit))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def boundary_purity(df: DataFrame, x: str, y: str, slopes: list[float], offsets: list[float]) -> DataFrame:
    """The line y = slope x + offset that separates the classes best by the sum of its sides' purities; all candidates in one aggregate."""
    spark = df.sparkSession
    lines = spark.createDataFrame([(float(a), float(b)) for a in slopes for b in offsets], "slope double, offset double")
    side = F.col(y) > F.col("slope") * F.col(x) + F.col("offset")
    # The candidates are the caller's list; rows are combined by candidate before the shuffle.
    n = df.join(F.broadcast(lines)).groupBy("slope", "offset").agg(F.count_if(side & (F.col("label") == 1)).alias("a"), F.count_if(side).alias("na"), F.count_if(~side & (F.col("label") == 0)).alias("b"), F.count_if(~side).alias("nb"))
    purity = F.coalesce(F.try_divide("a", "na"), F.lit(0.0)) + F.coalesce(F.try_divide("b", "nb"), F.lit(0.0))
    return n.select("slope", "offset", purity.alias("purity")).orderBy(F.desc("purity"), "slope", "offset").limit(1)
