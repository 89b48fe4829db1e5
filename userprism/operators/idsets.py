"""Id sets: overlap, differences, outlier users."""

from functools import reduce

from pyspark.sql import functions as F

from .features import rows_per_key
from .scale import col


def distinct_ids(df, key="user_id"):
    return df.select(col(key)).filter(col(key).isNotNull()).distinct()


def presence(tables, key="user_id"):
    """One row per id with a flag ``in_{name}`` per table.

    Repeats of an id fold before the one shuffle, and no join is needed.
    """
    names = list(tables)
    marked = [
        df.select(col(key), *[F.lit(m == n).alias(f"in_{m}") for m in names])
        for n, df in tables.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b), marked).filter(col(key).isNotNull())
    return rows.groupBy(col(key)).agg(*[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in names])


def id_intersection(a, b, key="user_id"):
    """Ids in both tables. Repeats fold before the shuffle, unlike in a semi join."""
    return presence({"a": a, "b": b}, key).filter("in_a AND in_b").select(col(key))


def id_difference(a, b, key="user_id"):
    """Ids in the first table only."""
    return presence({"a": a, "b": b}, key).filter("in_a AND NOT in_b").select(col(key))


def _overlap_conditions():
    pos, dep, ev, attr = (F.col(f"in_{n}") for n in ("pos", "dep", "ev", "attr"))
    # Names of the set sizes.
    return {
        "inter_pos_dep": pos & dep,
        "dif_pos_dep": pos & ~dep,
        "dif_dep_pos": dep & ~pos,
        "inter_dep_ev": dep & ev,
        "inter_pos_no_dep_events": pos & ~dep & ev,
        "inter_pos_events": pos & ev,
        "inter_pos_attr": pos & attr,
    }


def overlap_sets(positions, deposits, events, attribution, key="user_id"):
    """The named id sets as (set_name, id) rows; an id is listed once per set it is in."""
    tables = {"pos": positions, "dep": deposits, "ev": events, "attr": attribution}
    tags = [
        F.when(condition, F.lit(name)) for name, condition in _overlap_conditions().items()
    ]
    return (
        presence(tables, key)
        .select(col(key), F.explode(F.array_compact(F.array(*tags))).alias("set_name"))
        .select("set_name", col(key))
    )


def overlap_report(positions, deposits, events, attribution, key="user_id"):
    """Size of each named id set, counted in one pass."""
    tables = {"pos": positions, "dep": deposits, "ev": events, "attr": attribution}
    conditions = _overlap_conditions()
    sizes = presence(tables, key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    rows = [F.struct(F.lit(n).alias("set_name"), F.col(n).alias("ids")) for n in conditions]
    return sizes.select(F.inline(F.array(*rows)))


def count_histogram(per_key, column="n"):
    """Keys per row count. Distinct counts grow with the square root of all rows at most."""
    return per_key.groupBy(column).agg(F.count(F.lit(1)).alias("keys"))


def count_quantile(per_key, probability, column="n"):
    """Exact quantile of per-key counts as a one-row table, from the weighted histogram."""
    return count_histogram(per_key, column).agg(
        F.percentile(column, F.lit(probability), F.col("keys")).alias("q")
    )


def split_outliers(df, key="user_id", probability=0.99):
    """(outliers, others): keys with more rows than the quantile of rows per key, and the rest."""
    per_key = rows_per_key(df, key)
    limit = count_quantile(per_key, probability).scalar()
    return per_key.filter(F.col("n") > limit), per_key.filter(F.col("n") <= limit)


def without_ids(df, ids, key="user_id"):
    """Rows of a per-user table whose id is not listed.

    A flag from an outer join, as Spark may move an anti join below the aggregate that made
    the table, where one user's rows would meet in one task.
    """
    listed = distinct_ids(ids, key).withColumn("__listed", F.lit(True))
    return df.join(listed, key, "left").filter(F.col("__listed").isNull()).drop("__listed")


def with_ids(df, ids, key="user_id"):
    """Rows of a per-user table whose id is listed."""
    return df.join(distinct_ids(ids, key), key)


def outer_indicator(left, right, keep_both=False):
    """Which side each row is on, compared on all common columns; missing equals missing.

    ``copies`` is the number of result rows a row stands for, so repeats stay counted
    without being paired up.
    """
    common = [c for c in left.columns if c in right.columns]
    tagged = left.select(*[col(c) for c in common], F.lit(1).alias("__l"), F.lit(0).alias("__r"))
    tagged = tagged.unionByName(
        right.select(*[col(c) for c in common], F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    merged = tagged.groupBy(*[col(c) for c in common]).agg(
        F.sum("__l").alias("__l"), F.sum("__r").alias("__r")
    )
    exist = (
        F.when(F.col("__r") == 0, "left_only").when(F.col("__l") == 0, "right_only").otherwise("both")
    )
    copies = F.greatest("__l", F.lit(1)) * F.greatest("__r", F.lit(1))
    result = merged.select(*[col(c) for c in common], exist.alias("exist"), copies.alias("copies"))
    return result if keep_both else result.filter(F.col("exist") != "both")
