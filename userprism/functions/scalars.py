"""Scalar expressions over columns."""

from pyspark.sql import functions as F


def date_parts(df, column="time"):
    """month, year, day and floored epoch seconds of a timestamp.

    Epoch seconds come from the calendar fields, so they do not depend on the session time
    zone and round down before 1970 too.
    """
    ts = F.col(column)
    if dict(df.dtypes)[column] == "string":
        df = df.withColumn(column, F.to_timestamp_ntz(ts))
    seconds = (
        F.unix_date(F.to_date(ts)).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )
    return df.withColumns(
        {
            "month": F.month(ts),
            "year": F.year(ts),
            "day": F.dayofmonth(ts),
            "timestamp_sec": seconds.cast("double"),
        }
    )


def conversion_flag(amount, enrolled):
    """0 where both amounts agree, else 1; a missing side counts as converted."""
    return F.when(amount - enrolled == 0, 0).otherwise(1)


def balance_label(balance_type):
    """Type 1 is real money; anything else, and a missing type, is not."""
    # The two labels.
    return F.when(balance_type == 1, "Real_money").otherwise("Whatever_else")


def category_label(value):
    """``cat_id_{value}``; a missing value reads ``cat_id_nan``."""
    # Fixed value: the prefix.
    return F.concat(F.lit("cat_id_"), F.coalesce(value.cast("string"), F.lit("nan")))
