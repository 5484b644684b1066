"""Per-position residue models with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from strandlens.functions import residues as R
from strandlens.operators.counts import features

INPUTS = ["charge", "hydro", "aromatic", "n_cys", "volume", "beta"]


def measured(rows: DataFrame, place: int) -> DataFrame:
    """doc_id, aa and raw, the vector of INPUTS, for every row."""
    base = features(rows).withColumns({"aa": R.residue("v", place), "volume": R.weighted("cdr3", R.VOLUME), "beta": R.weighted("cdr3", R.BETA)})
    return VectorAssembler(inputCols=INPUTS, outputCol="raw").transform(base).select("doc_id", "aa", "raw")


def classes(base: DataFrame, kinds: int = 8, least: int = 20) -> DataFrame:
    """aa, n and label of the `kinds` most frequent residues of `least` rows or more."""
    top = base.groupBy("aa").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "aa").limit(kinds)
    return top.withColumn("label", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "aa")) - 1).cast("double"))


def inputs(rows: DataFrame, place: int, cap: int, kinds: int = 8, least: int = 20) -> DataFrame:
    """doc_id, label, aa and features that a model is fitted to: rows of classes(), at most `cap` of each (by hash)."""
    base = measured(rows, place)
    sampled = base.join(F.broadcast(classes(base, kinds, least)), "aa").withColumn("place", F.row_number().over(Window.partitionBy("aa").orderBy(F.md5(F.col("doc_id").cast("string"))))).filter(F.col("place") <= cap)
    return sampled.select("doc_id", "aa", "label", "n", "raw")


def predict(rows: DataFrame, place: int, cap: int = 100_000, forest: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """Each row's probability of its own residue, the expected one, and whether they match. Classes weigh the same.

    Fitted to inputs() of `fit_on` (or of the rows), which are bounded; every row is scored, one whose residue has no class with probability 0.
    """
    known = rows if fit_on is None else fit_on
    data = inputs(known, place, cap).withColumn("weight", 1.0 / F.least("n", F.lit(cap)))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data)
    kind = RandomForestClassifier(numTrees=20, maxDepth=5, seed=3, weightCol="weight") if forest else LogisticRegression(maxIter=30, regParam=0.01, weightCol="weight")
    model = kind.fit(scaler.transform(data))
    base = measured(rows, place)
    made = model.transform(scaler.transform(base.join(F.broadcast(classes(measured(known, place))), "aa", "left")))
    own = F.coalesce(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(0.0))
    return made.select("doc_id", "aa", F.round(own, 6).alias("p_own"), F.coalesce(F.col("prediction") == F.col("label"), F.lit(False)).alias("match"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, the majority residue's share, their ratio, and rows of low probability."""
    share = predicted.groupBy("aa").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    return predicted.agg(F.avg(F.col("match").cast("double")).alias("accuracy"), F.count_if(F.col("p_own") < 0.1).alias("unlikely")).crossJoin(share).withColumn("lift", F.col("accuracy") / F.col("majority"))


def importances(rows: DataFrame, place: int, cap: int = 100_000) -> DataFrame:
    """The forest's importance of each feature, largest first."""
    data = inputs(rows, place, cap).withColumnRenamed("raw", "features")
    found = RandomForestClassifier(numTrees=20, maxDepth=5, seed=3).fit(data).featureImportances.toArray().tolist()
    return rows.sparkSession.createDataFrame([(k, round(v, 6)) for k, v in zip(INPUTS, found)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def coefficients(rows: DataFrame, place: int, cap: int = 100_000) -> DataFrame:
    """The mean absolute coefficient of each feature over the classes of the logistic model, largest first."""
    data = inputs(rows, place, cap).withColumn("weight", 1.0 / F.least("n", F.lit(cap)))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data)
    model = LogisticRegression(maxIter=30, regParam=0.01, weightCol="weight").fit(scaler.transform(data))
    mean = abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist()
    return rows.sparkSession.createDataFrame([(k, round(x, 6)) for k, x in zip(INPUTS, mean)], "feature string, weight double").orderBy(F.desc("weight"), "feature")
