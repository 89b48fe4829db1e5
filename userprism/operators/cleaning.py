"""Cleaning and bucketing of raw logs."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import col, fits_broadcast, lookup_join, quoted, stage


def drop_repeats(df, key=None):
    """Full-row de-duplication; missing values equal each other. Copies fold before the shuffle.

    With ``key`` rows are dealt by it instead, in ranges that also hold a hash of the row: rows of a
    key come out side by side, and a key with very many rows takes several ranges. Aggregates by the
    key then combine map-side, and no task holds all its input rows to look for copies.
    """
    if key is None:
        return df.dropDuplicates()
    spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(1024))
    return df.withColumn("__spread", spread).repartitionByRange(col(key), "__spread").dropDuplicates().drop("__spread")


def null_audit(df):
    """One row per column: whether any value is missing, and how many."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("missing"), F.col("rows"))
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*entries))).withColumn(
        "has_missing", F.col("missing") > 0
    )


def shape_audit(df):
    """Row and column counts before and after de-duplication."""
    def shape(frame, step):
        return frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(step).alias("step"), "rows", F.lit(len(frame.columns)).alias("columns")
        )

    return shape(df, "read").unionByName(shape(drop_repeats(df), "de-duplicated"))


def fill_missing(df, values):
    """Constant per column."""
    return df.na.fill(values)


def fill_zero(df, columns=None):
    """0 for every missing number, in the given columns or all; texts stay."""
    return df.na.fill(0, None if columns is None else [quoted(c) for c in columns])


def fill_mean(df, columns):
    """Mean of the present values, as a scalar subquery: no join and no window over all rows."""
    means = df.agg(*[F.avg(col(c)).alias(c) for c in columns])
    return df.withColumns(
        {c: F.coalesce(col(c).cast("double"), means.select(col(c)).scalar()) for c in columns}
    )


def drop_present(df, columns):
    """Drop the columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def frequent_values(df, columns, min_count=100):
    """(feature, value) pairs on strictly more than ``min_count`` rows, counted in one pass."""
    return (
        df.select(F.inline(F.array(*_pairs(columns))))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > min_count)
    )


def bucket_rare(df, replacements, min_count=100, frequent=None):
    """Keep frequent values; every other value, and a missing one, becomes the replacement.

    ``replacements`` maps each column to what stands for its rare values. The frequent values
    are staged once and looked up per column; ``frequent`` gives those of an earlier log instead.
    """
    frequent = stage(frequent_values(df, list(replacements), min_count) if frequent is None else frequent)
    fits = fits_broadcast(frequent)
    order = [col(c) for c in df.columns]
    for column, replacement in replacements.items():
        data_type = df.schema[column].dataType
        known = frequent.filter(F.col("feature") == column).select(
            F.col("value").cast(data_type).alias(column), F.lit(True).alias("__frequent")
        )
        kept = F.when(F.col("__frequent"), col(column)).otherwise(F.lit(replacement).cast(data_type))
        found = lookup_join(df, known, column, staged=True, fits=fits)
        df = found.withColumn(column, kept).select(*order)
    return df


def bucket_others(df, column, keep, replacement="OTHER"):
    """Keep the listed values; every other value, and a missing one, becomes ``replacement``."""
    return df.withColumn(
        column, F.when(col(column).isin(list(keep)), col(column)).otherwise(replacement)
    )


def _pairs(columns):
    return [F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in columns]


def category_values(df, columns):
    """Present values of each category in long form, one row per (feature, value)."""
    pairs = F.inline(F.array(*_pairs(columns)))
    return df.select(pairs).filter(F.col("value").isNotNull()).distinct()


def keep_columns(df, names, extra=("target", "user_id")):
    """Selected features plus the label and the id; a name given twice is kept once."""
    return df.select(*[col(c) for c in dict.fromkeys([*names, *extra])])


def normalize_missing(df, tokens=()):
    """One missing marker: NaN and the given text tokens become null."""
    def clean(f):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
        if tokens and isinstance(f.dataType, T.StringType):
            return F.when(~col(f.name).isin(list(tokens)), col(f.name)).alias(f.name)
        return col(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])
