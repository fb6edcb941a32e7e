"""Boosted trees against Spark ML's, which take the same splits where a feature has few values."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from stockloom.plans import boosting, regression


def numbers(spark, n=3000, parts=8):
    h = F.xxhash64("id")
    df = spark.range(0, n, 1, parts).select("id", F.pmod(h, F.lit(29)).cast("double").alias("a"), F.pmod(h, F.lit(7)).cast("int").alias("b"), F.pmod(h, F.lit(31)).alias("c"))
    return df.withColumn("y", F.col("a") ** 2 + F.when(F.col("b") > 3, 100).otherwise(0) * F.col("c") + F.pmod(h, F.lit(1009)) / 100)


def test_same_trees_as_spark_ml(spark):
    df, features = numbers(spark), ["a", "b", "c"]
    wide = VectorAssembler(inputCols=features, outputCol="f").transform(df)
    theirs = GBTRegressor(featuresCol="f", labelCol="y", predictionCol="theirs", maxDepth=4, maxIter=8, stepSize=0.1).fit(wide)
    ours = regression.fit_gbt(df, features, "y", trees=8)
    rows = regression.predict_gbt(ours, theirs.transform(wide), features).select("predicted", "theirs").collect()
    assert len(rows) == 3000
    assert [r.predicted for r in rows] == pytest.approx([r.theirs for r in rows], rel=1e-9)
    assert ours.importances == pytest.approx(theirs.featureImportances.toArray(), rel=1e-9)


def test_a_level_takes_few_tasks(spark):
    """Some thousand rows in 64 partitions are read twice, and are one task for each level then."""
    sc = spark.sparkContext
    sc.setJobGroup("few-tasks", "fit")
    try:
        regression.fit_gbt(numbers(spark, parts=64), ["a", "b", "c"], "y", max_depth=3, trees=5)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("few-tasks") for s in track.getJobInfo(j).stageIds}
    assert sum(info.numTasks for s in stages if (info := track.getStageInfo(s)) and info.numCompletedTasks) < 250


def test_rows_of_the_features_are_computed_once(spark):
    """The split reads its rows several times, but they come from a copy."""
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    df = numbers(spark, n=500, parts=2)
    _, tested, residuals = regression.regress_with_intervals(df.mapInArrow(seen, df.schema), ["a", "b", "c"], "y", ["id"], max_depth=2, trees=2)
    assert (tested.count(), residuals.count()) == (100, 80)
    assert counted.value == 500


def test_errors_left_are_stored_after_some_trees(spark, monkeypatch):
    """What is left is the same, whether it is stored after every tree, after some or never."""
    found, before = [], set(spark.sparkContext._jsc.getPersistentRDDs())
    for held in (1, 4, 100):
        monkeypatch.setattr(boosting, "TREES_HELD", held)
        found.append(regression.fit_gbt(numbers(spark, n=400, parts=2), ["a", "b", "c"], "y", max_depth=2, trees=9))
    assert all((f.value == found[0].value).all() and (f.cut == found[0].cut).all() for f in found)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_features_are_counted_together():
    """Eight features take three counts of a row, not eight, and give the counts and sums of each."""
    sizes, rng = [32, 12, 1, 7, 32, 32, 32, 32], np.random.default_rng(3)
    groups = boosting.counted_together(sizes)
    assert len(groups) == 3 and sorted(i for g in groups for i in g) == list(range(8))
    blocks = [(np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8), rng.normal(size=n)) for n in (1, 700, 5000)]
    feature = rng.integers(0, 8, 2**7 - 1)
    cut = np.array([rng.choice([rng.integers(0, sizes[f]), boosting.BINS - 1]) for f in feature])
    for level in (0, 1, 4, 5, 7):
        (sums,) = boosting.histogram(iter(blocks), sizes, feature, cut, level)
        plain = np.zeros((2, 8, 2**level, boosting.BINS))
        for bins, errors in blocks:
            for row, error in zip(bins.T, errors):
                node = 0
                for _ in range(level):
                    node = 2 * node + 1 + int(row[feature[node]] > cut[node])
                for i, b in enumerate(row):
                    plain[:, i, node - (2**level - 1), b] += 1, error
        assert (sums[0] == plain[0]).all() and sums[1] == pytest.approx(plain[1], abs=1e-9)


def test_rows_without_a_gain(spark):
    flat = spark.range(50).select("id", F.lit(1.5).alias("a"), F.when(F.col("id") > 3, F.col("id") % 2).alias("b"), F.lit(0.1).alias("y"))
    model = regression.fit_gbt(flat, ["a", "b"], "y", trees=3)
    assert model.importances.tolist() == [0, 0]
    assert regression.predict_gbt(model, flat, ["a", "b"]).select("predicted").distinct().count() == 1
    assert regression.predict_gbt(model, flat, ["a", "b"]).first().predicted == pytest.approx(0.1)
    with pytest.raises(ValueError):
        regression.fit_gbt(flat.filter("id < 3"), ["a", "b"], "y")
    with pytest.raises(ValueError):
        regression.fit_gbt(flat.withColumn("b", F.lit("x")), ["a", "b"], "y")


def test_borders_of_bins():
    steps = np.linspace(0, 1, boosting.MARKS + 1)
    many = boosting.thresholds_of(np.quantile(np.arange(100_000.0), steps))
    counts = np.bincount(boosting.binned([np.arange(100_000.0)], [many])[0])
    assert len(counts) == boosting.BINS and counts.min() > 3000 and counts.max() < 3200
    assert boosting.thresholds_of(np.quantile([1.0, 2.0, 4.0] * 9, steps, method="lower")).tolist() == [1.5, 3.0]
    assert boosting.thresholds_of(np.full(boosting.MARKS + 1, 7.0)).tolist() == []
