"""A Spark ML text classifier pipeline (tokenise, hash, IDF, logistic regression)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import NEGATIVE, POSITIVE
from ..functions.text import TOKEN_PATTERN


def lr_pipeline(num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.01) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="_y", maxIter=max_iter, regParam=reg),
    ])


def lr_fit(train: DataFrame, **kw) -> PipelineModel:
    y = F.when(F.col("label") == POSITIVE, F.lit(1.0)).otherwise(F.lit(0.0))
    return lr_pipeline(**kw).fit(train.withColumn("_y", y))


def lr_predict(model: PipelineModel, docs: DataFrame, id_col: str = "row_id") -> DataFrame:
    out = model.transform(docs)
    return out.select(id_col, *[c for c in ("label",) if c in docs.columns],
                      F.when(F.col("prediction") == 1.0, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE)).alias("pred"))


def lr_save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def lr_load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
