"""ISO calendar functions."""

from pyspark.sql import functions as F


def monday(date):
    """Monday of the ISO week of a date."""
    return F.to_date(F.trunc(date, "week"))


def iso_year(date):
    return F.extract(F.lit("YEAROFWEEK"), date).cast("int")


def iso_week(date):
    return F.weekofyear(date)


def iso_weeks_in_year(year):
    """Last ISO week number of a year: 28 December always lies in it."""
    return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))


def week_start(year, week):
    """Monday of an ISO (year, week); 4 January always lies in week 1."""
    first = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    return F.date_add(first, (week - 1) * 7)


def week_index(date):
    """Number of weeks since Monday 1970-01-05: consecutive weeks differ by one, also across years."""
    return F.floor(F.datediff(monday(date), F.lit("1970-01-05").cast("date")) / 7).cast("long")


def year_week_label(year, week):
    """Text such as 201907."""
    return F.concat(year.cast("string"), F.lpad(week.cast("string"), 2, "0"))


def date_int(date):
    """20190531 for 31 May 2019."""
    return F.date_format(date, "yyyyMMdd").cast("int")


def time_features(df, date):
    """Add weekofyear, month, dayofweek (Monday is 0) and year."""
    d = F.col(date)
    return df.withColumns(
        {"weekofyear": F.weekofyear(d), "month": F.month(d), "dayofweek": F.weekday(d), "year": F.year(d)}
    )


def filter_years(df, date_col, start=None, end=None):
    """Keep rows of the years start..end; a missing bound is open.

    Written as bounds on the date itself, so that files and row groups are pruned.
    """
    if start is not None:
        df = df.filter(F.col(date_col) >= F.lit(f"{int(start):04d}-01-01").cast("date"))
    if end is not None:
        df = df.filter(F.col(date_col) < F.lit(f"{int(end) + 1:04d}-01-01").cast("date"))
    return df
