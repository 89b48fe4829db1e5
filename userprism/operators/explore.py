"""Exploration reports: frequency, count summaries, class balance, category lift, statistics."""

from pyspark.sql import functions as F

from .idsets import count_histogram, distinct_ids
from .quantiles import by_rank
from .scale import col


def value_counts(df, column):
    """Rows per present value, most frequent first; ties by value."""
    return (
        df.filter(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def count_summary(per_key, column="n"):
    """mean, median, q10, q90, q99 and max of per-key counts, from their histogram."""
    weight = F.col("keys")
    probs = F.array(*[F.lit(p) for p in (0.5, 0.1, 0.9, 0.99)])
    found = count_histogram(per_key, column).agg(
        (F.sum(F.col(column) * weight) / F.sum(weight)).alias("mean"),
        F.percentile(column, probs, weight).alias("p"),
        F.max(column).alias("max"),
        F.sum(weight).alias("keys"),
    )
    return found.select(
        "mean",
        *[F.col("p")[i].alias(n) for i, n in enumerate(("median", "q10", "q90", "q99"))],
        "max",
        "keys",
    )


def labelled_folds(df, positive_ids, columns, key="user_id"):
    """(key, feature, value, n, made_depo): rows folded by key and value, then labelled.

    Folding first means the join on the key moves no hot key's rows. A row without a value is
    kept under a null value, so each row counts once per feature.
    """
    pairs = [F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in columns]
    folded = (
        df.select(col(key), F.inline(F.array(*pairs)))
        .groupBy(col(key), "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ids = distinct_ids(positive_ids, key).withColumn("made_depo", F.lit(1))
    labelled = folded.join(ids, key, "left")
    return labelled.withColumn("made_depo", F.coalesce("made_depo", F.lit(0)))


def category_lift(df, positive_ids, columns, key="user_id"):
    """Share of positive rows minus share of negative rows, per category value.

    Shares are of all rows of the class, also those without a value.
    """
    per_value = labelled_folds(df, positive_ids, columns, key).groupBy("feature", "value").agg(
        F.sum(F.when(F.col("made_depo") == 1, F.col("n")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("made_depo") == 0, F.col("n")).otherwise(0)).alias("negative"),
    )
    # Every row appears once under each feature, so one feature carries the class totals. A
    # conditional sum keeps the plan below equal to the one above, whose shuffle is reused.
    first = F.col("feature") == columns[0]
    whole = per_value.agg(
        F.sum(F.when(first, F.col("positive"))).alias("positive"),
        F.sum(F.when(first, F.col("negative"))).alias("negative"),
    )
    lift = F.coalesce(
        F.try_divide("positive", whole.select("positive").scalar()), F.lit(0.0)
    ) - F.coalesce(F.try_divide("negative", whole.select("negative").scalar()), F.lit(0.0))
    return per_value.filter(F.col("value").isNotNull()).select(
        "feature", "value", "positive", "negative", lift.alias("lift")
    )


def class_balance(df, positive_ids, key="user_id"):
    """Rows and distinct users per label."""
    per_key = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    ids = distinct_ids(positive_ids, key).withColumn("made_depo", F.lit(1))
    return (
        per_key.join(ids, key, "left")
        .groupBy(F.coalesce("made_depo", F.lit(0)).alias("made_depo"))
        .agg(F.sum("n").alias("rows"), F.count(col(key)).alias("users"))
    )


def count_matching(df, conditions):
    """One row: rows meeting each named condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def describe(df, columns):
    """count, mean, std, min, exact quartiles and max of each numeric column, one row each."""
    moments = df.agg(
        *[
            F.struct(
                F.count(col(c)).alias("count"),
                F.avg(col(c)).alias("mean"),
                F.stddev_samp(col(c)).alias("std"),
                F.min(col(c)).cast("double").alias("min"),
                F.max(col(c)).cast("double").alias("max"),
            ).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
    )
    quartiles = by_rank(df, [], columns, ["q25", "median", "q75"])

    def long(frame, fields):
        rows = [F.struct(F.lit(c).alias("feature"), *fields(i, c)) for i, c in enumerate(columns)]
        return frame.select(F.inline(F.array(*rows)))

    simple = ("count", "mean", "std", "min", "max")
    left = long(moments, lambda i, c: [F.col(f"m{i}")[s].alias(s) for s in simple])
    right = long(quartiles, lambda i, c: [col(f"{c}_{s}").alias(s) for s in ("q25", "median", "q75")])
    return left.join(right, "feature").select(
        "feature", "count", "mean", "std", "min", "q25", "median", "q75", "max"
    )


def top_rows(df, by, n, ascending=False, ties=()):
    """The first n rows by a value; ``ties`` makes the choice unambiguous."""
    order = F.asc(by) if ascending else F.desc(by)
    return df.orderBy(order, *ties).limit(n)

