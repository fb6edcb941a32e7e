"""JDBC tables and queries. The driver jar and the database are the caller's."""


def write_jdbc(df, url, table, partitions=10, batch_size=50_000, mode="append", truncate=False, **options):
    """Write rows over `partitions` connections. `truncate` with mode overwrite empties the table instead of dropping it."""
    writer = df.repartition(partitions).write.format("jdbc").options(**options)
    writer = writer.option("url", url).option("dbtable", table).option("batchsize", batch_size)
    if truncate:
        writer = writer.option("truncate", True)
    writer.mode(mode).save()


def read_jdbc_query(spark, url, query, partition_column=None, bounds=None, partitions=None, **options):
    """Rows of a query that the database runs, such as a weekly aggregate.

    With a partition column, its bounds and a number of partitions the result is read over several connections.
    """
    reader = spark.read.format("jdbc").options(**options).option("url", url)
    if partition_column is None:
        return reader.option("query", query).load()
    lower, upper = bounds
    reader = reader.option("dbtable", f"({query}) AS source_rows").option("partitionColumn", partition_column)
    return reader.option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()


def weekly_aggregate_query(table, date_col="date", value_col="sale_dollars"):
    """Weekly totals by Monday, in the dialect of databases that have date_trunc."""
    week = f"CAST(date_trunc('week', {date_col}) AS date)"
    return f"SELECT {week} AS week_start, SUM({value_col}) AS sales FROM {table} GROUP BY {week}"
