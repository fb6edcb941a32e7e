"""What the physical plans must and must not do."""

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()

# Queries that start jobs while they are built (writes, streams, model fits) are looked at by their results only.
LAZY = [
    "weekly_sales_mart", "weekly_sales_mart_by_vendor", "iso_weekly_sales", "weeks_before_latest", "regular_weeks", "forecast_input",
    "marked_points", "holiday_weeks", "daily_usage", "stock_with_reorders", "reorder_events", "items_without_label",
    "dimension_upsert", "user_upsert", "login_history", "words_by_edit_distance", "error_quantile", "error_quantile_by_key",
    "prediction_intervals", "prediction_intervals_by_key", "autocorrelation", "partial_autocorrelation", "dominant_period", "random_split_sizes", "class_summary",
    "metric_analysis", "seasonal_forecasts",
]


def plan(spark, name, broadcast=True):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_of_everything(spark, name):
    text = plan(spark, name, broadcast=False)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", LAZY)
def test_scans_read_only_what_is_used(spark, name):
    wide = {"lineitem": 11, "orders": 6, "documents": 5, "part": 6}
    for columns, table in re.findall(r"FileScan parquet \[([^\]]*)\].*?/(\w+)\.parquet", plan(spark, name)):
        if table in wide and not name.startswith(("prediction", "error")):
            assert len(columns.split(",")) < wide[table], (name, table, columns)


@pytest.mark.parametrize("name", ["weekly_sales_mart", "random_split_sizes"])
def test_one_partition_steps_follow_an_aggregate(spark, name):
    text = plan(spark, name)
    for child in text.split("Exchange SinglePartition")[1:]:
        ahead = child[: child.find("FileScan")]
        assert "Aggregate" in ahead


@pytest.mark.parametrize("name", ["weekly_sales_mart", "iso_weekly_sales", "weeks_before_latest", "autocorrelation", "marked_points"])
def test_raw_rows_are_summed_before_the_shuffle(spark, name):
    text = plan(spark, name)
    line = text.rfind("lineitem.parquet")
    above = text[:line]
    assert above.rfind("partial_sum") > above.rfind("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["error_quantile", "error_quantile_by_key", "prediction_intervals", "prediction_intervals_by_key", "random_split_sizes", "time_split_by_key"])
def test_no_job_runs_while_the_query_is_built(spark, name):
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    try:
        QUERIES[name](spark, SF_DIR)
        # Reading the Parquet schema is the only job.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}")) <= 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name, scans", [("error_quantile", 2), ("error_quantile_by_key", 2), ("prediction_intervals_by_key", 3), ("random_split_sizes", 3)])
def test_tables_are_read_no_more_often_than_needed(spark, name, scans):
    """Scans of the plan that ran, those of exchanges and subqueries that are used again not counted."""
    frame = QUERIES[name](spark, SF_DIR)
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= scans, final


def test_python_only_where_it_must(spark):
    python = {name for name in LAZY if re.search(r"InPandas|ArrowEval|BatchEvalPython", plan(spark, name))}
    assert python == {"metric_analysis", "seasonal_forecasts"}
