"""CSV and JSON files."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_sales_csv(spark, path, schema=None, date_col="date", date_format="yyyy-MM-dd"):
    """CSV with header, from one path or a list; the date column is parsed with a format, bad dates become NULL.

    Give the schema (a StructType or its DDL): a header that names other columns is then an error. Without one the types are inferred,
    which reads the files twice.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        schema = reader.option("inferSchema", True).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # The date is read as text first, to be parsed with its own format and no guess of the reader.
    as_text = [T.StructField(f.name, T.StringType()) if f.name == date_col else f for f in schema.fields]
    df = spark.read.option("header", True).option("enforceSchema", False).schema(T.StructType(as_text)).csv(path)
    if date_col in df.columns:
        df = df.withColumn(date_col, F.try_to_date(F.col(date_col), date_format))
    return df


def write_csv(df, path, by=None, mode="overwrite"):
    """CSV with header; `by` makes one folder per value beside the combined data."""
    writer = df.write.mode(mode).option("header", True)
    if by:
        writer = writer.partitionBy(by) if isinstance(by, str) else writer.partitionBy(*by)
    writer.csv(path)


def write_json(df, path, by=None, mode="overwrite"):
    """JSON lines, NULL fields kept; `by` makes one folder per value, such as the labelling batch."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def read_json_rows(spark, path, key, multi_line=True):
    """Rows of the array found under a top-level key; types are inferred over all rows.

    One document per file, or with `multi_line` false one per line, which Spark can split.
    """
    whole = spark.read.option("multiLine", multi_line).json(path)
    if key not in whole.columns:
        raise ValueError(f"no list under the key '{key}'")
    return whole.select(F.explode(F.col(key)).alias("row")).select("row.*")


def path_exists(spark, path):
    """True when a reader finds the path, on whatever file system it names."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException:
        return False
