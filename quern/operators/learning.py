"""Learners of the ML-shaped tasks, on pyspark.ml, and baselines that must lose to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, NGram, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.sampling import hash_bucket


def hash_split(df: DataFrame, key: str, test_percent: int = 25) -> tuple[DataFrame, DataFrame]:
    b = hash_bucket(F.col(key))
    return df.filter(b >= test_percent), df.filter(b < test_percent)


def _assembled(categories: Sequence[str], numbers: Sequence[str]) -> list:
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}__i" for c in categories], handleInvalid="keep") if categories else None
    return [s for s in (index, VectorAssembler(inputCols=[*[f"{c}__i" for c in categories], *numbers], outputCol="features", handleInvalid="keep")) if s is not None]


def boosted_classifier(train: DataFrame, categories, numbers, label: str, iterations: int = 10):
    stages = _assembled(categories, numbers)
    return Pipeline(stages=[*stages, GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxBins=64, seed=1)]).fit(train)


def boosted_regressor(train: DataFrame, categories, numbers, label: str, iterations: int = 10):
    stages = _assembled(categories, numbers)
    return Pipeline(stages=[*stages, GBTRegressor(labelCol=label, featuresCol="features", maxIter=iterations, maxBins=64, seed=1)]).fit(train)


def text_classifier(train: DataFrame, text: str, label: str, min_df: float = 2.0, vocabulary: int = 1 << 14):
    """One- and two-word TF-IDF with a linear SVM per class."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
        RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"\W+"),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", minDF=min_df, vocabSize=vocabulary),
        IDF(inputCol="tf", outputCol="features"),
        OneVsRest(classifier=LinearSVC(maxIter=5), labelCol="label", featuresCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


def logistic_folds(df: DataFrame, numbers: Sequence[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """fold, accuracy: impute, scale and a logistic model, fitted inside each fold; folds by the key's hash."""
    fold = hash_bucket(F.col(key)) % folds
    out = None
    for k in range(folds):
        stages = [
            Imputer(inputCols=list(numbers), outputCols=[f"{c}__f" for c in numbers]),
            VectorAssembler(inputCols=[f"{c}__f" for c in numbers], outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
            LogisticRegression(labelCol=label, maxIter=20),
        ]
        one = Pipeline(stages=stages).fit(df.filter(fold != k)).transform(df.filter(fold == k))
        acc = one.agg(F.lit(k).alias("fold"), F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy"))
        out = acc if out is None else out.unionByName(acc)
    return out


def knn(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5) -> DataFrame:
    """key, predicted: majority of the k nearest rows on scaled features; test is a small stated query set.

    Distances stream past one bounded heap per query and task (a partial top-k before the shuffle).
    """
    stats = train.agg(*[F.avg(c).alias(f"{c}__m") for c in features], *[F.stddev_pop(c).alias(f"{c}__s") for c in features]).first()
    scaled = lambda c: (F.col(c) - F.lit(stats[f"{c}__m"])) / F.lit(stats[f"{c}__s"] or 1.0)
    a = test.select(F.col(key).alias("__q"), *[scaled(c).alias(f"a_{c}") for c in features])
    b = train.select(F.col(key).alias("__t"), F.col(label).alias("__y"), *[scaled(c).alias(f"b_{c}") for c in features])
    d = sum((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in features)
    pairs = b.join(F.broadcast(a)).select("__q", "__t", "__y", d.alias("d"))
    near = pairs.withColumn("r", F.row_number().over(W.partitionBy("__q").orderBy("d", "__t"))).filter(F.col("r") <= k)
    votes = near.groupBy("__q", "__y").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(W.partitionBy("__q").orderBy(F.desc("n"), "__y"))).filter("r = 1")
    return best.select(F.col("__q").alias(key), F.col("__y").alias("predicted"))


def accuracy(df: DataFrame, label: str, predicted: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"))


def mean_absolute_error(df: DataFrame, label: str, predicted: str = "prediction") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(label) - F.col(predicted))).alias("mae"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    top = train.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("prediction"))
    return test.join(F.broadcast(top))


def median_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    return test.join(F.broadcast(train.agg(F.median(label).alias("prediction"))))


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a key: the seeded column of synthetic tables."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def synthetic_task(spark, name: str, rows: int) -> DataFrame:
    """id, x1, x2, category, y of one of seven tasks; hash-seeded columns, so any partitioning gives the same rows."""
    kinds = {"widget": (2.0, 1.0), "delivery": (1.0, 3.0), "churn": (3.0, 0.5), "energy": (1.5, 1.5), "ticket": (0.5, 2.5), "credit": (2.5, 2.0), "upsell": (1.0, 1.0)}
    a, b = kinds[name]
    i = F.col("id")
    df = spark.range(rows).select("id", uniform(i, name + "1").alias("x1"), uniform(i, name + "2").alias("x2"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (i % 3 + 1).cast("int")).alias("category"))
    signal = F.lit(a) * F.col("x1") - F.lit(b) * F.col("x2") + F.when(F.col("category") == "a", 0.5).otherwise(0.0)
    return df.withColumn("signal", signal).withColumn("y", (F.col("signal") + 0.3 * (uniform(i, name + "n") - 0.5) > (a - b) / 2).cast("double"))


def credit_leak(df: DataFrame) -> DataFrame:
    """A copy with a column that gives the label away: models that use it are to be caught by comparing folds."""
    return df.withColumn("leak", F.col("y") + 0.01 * uniform(F.col("id"), "leak"))
