"""Boosted-tree regression with split-conformal intervals."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.dates import time_features
from stockloom.operators.series import lag_features
from stockloom.operators.split import split_frames
from stockloom.operators.stats import conformal_intervals
from stockloom.plans.boosting import fit_trees
from stockloom.session import fresh_folder, shared_folder
from stockloom.sources.files import write_csv

TIME_FEATURES = ["weekofyear", "month", "dayofweek", "year"]


def weekly_features(df, keys, date, value, lags=(1, 2, 4, 8)):
    """Calendar features of the date and lags of the value; returns the frame and the feature names."""
    wide = lag_features(time_features(df, date), keys, date, value, lags)
    return wide, [*TIME_FEATURES, *[f"{value}_lag_{k}" for k in lags]]


def _complete(df, features):
    """Rows with all features, which must be numbers."""
    other = [c for c in features if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    if other:
        raise ValueError(f"features must be numbers: {other}")
    return df.dropna(subset=list(features))


def fit_gbt(df, features, target, max_depth=4, trees=100, rate=0.1, seed=42):
    """Gradient-boosted trees with squared error; rows with a NULL feature or target are dropped. All rows take part in every tree and in
    the borders of the bins, so nothing depends on `seed`."""
    shared_folder(df.sparkSession)
    return fit_trees(_complete(df.dropna(subset=[target]), features), list(features), target, max_depth, trees, rate)


def predict_gbt(model, df, features):
    @F.pandas_udf("double")
    def predicted(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(rows.to_numpy(float).T))

    return _complete(df, features).withColumn("predicted", predicted(F.struct(*[F.col(c).cast("double") for c in features])))


def feature_importances(spark, model, features):
    """Feature and importance, most important first. One row per feature."""
    rows = [(name, float(model.importances[i])) for i, name in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _written(df):
    """The rows, read from a copy in the checkpoint folder."""
    folder = fresh_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def regress_with_intervals(df, features, target, row_keys, alpha=0.1, test=0.2, cal=0.2, seed=42, **gbt):
    """Train on the training part, take the error quantile of the calibration part, predict the test part.

    Returns the model, the test rows with actual, predicted, lower and upper, and the calibration residuals. The rows are read several
    times by the split, and the split rows by the fit and by all three parts, so both are written once to the checkpoint folder, with
    the columns that are needed.
    """
    needed = dict.fromkeys([*row_keys, *features, target])
    rows = _written(df.dropna(subset=[*features, target]).select(*needed))
    split = _written(split_frames(rows, row_keys, test, cal, seed))
    model = fit_gbt(split.filter(F.col("split") == "train"), features, target, seed=seed, **gbt)

    def scored(part):
        rows = predict_gbt(model, split.filter(F.col("split") == part), features)
        return rows.select(*row_keys, F.col(target).cast("double").alias("actual"), "predicted")

    calibration, tested = scored("cal"), scored("test")
    residuals = calibration.withColumn("residual", F.abs(F.col("actual") - F.col("predicted")))
    return model, conformal_intervals(calibration, tested, alpha=alpha), residuals


def write_results(path, tested, residuals, importances):
    """CSV folders below `path`: predictions with intervals, raw predictions, calibration residuals, feature importances."""
    bare = [c for c in tested.columns if c not in ("actual", "lower", "upper")]
    write_csv(tested, f"{path}/predictions_with_intervals")
    write_csv(tested.select(*bare), f"{path}/raw_predictions")
    write_csv(residuals.drop("actual", "predicted"), f"{path}/calibration_residuals")
    write_csv(importances, f"{path}/feature_importances")
