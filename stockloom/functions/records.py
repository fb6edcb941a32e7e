"""Record cleaning: numbers, missing values, required fields."""

from pyspark.sql import functions as F


def null_nan(column):
    """NaN to NULL, so that ranks, averages and filters treat both alike."""
    return F.nullif(column.cast("double"), F.lit(float("nan")))


def to_number_or_zero(column):
    """Value as a number; text that is no number, and NaN, count as 0."""
    return F.coalesce(null_nan(column.try_cast("double")), F.lit(0.0))


def usable(df, column):
    """Rows whose value is present and above zero."""
    return df.filter(F.col(column) > 0)


def missing_fields(df, required, out="missing_fields"):
    """Add the array of required columns that are NULL or empty in the row."""
    names = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]
    return df.withColumn(out, F.filter(F.array(*names), lambda name: name.isNotNull()))


def with_defaults(df, defaults):
    """Fill missing values per column; a column that is absent altogether is added."""
    filled = {
        name: F.coalesce(F.col(name), value) if name in df.columns else value for name, value in defaults.items()
    }
    return df.withColumns(filled)


def with_detection_defaults(df, now=None):
    """Source `unknown`, arrival time and table `default` where a detection carries none."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if now is None else now
    return with_defaults(df, {"source": F.lit("unknown"), "timestamp": now, "table": F.lit("default")})
