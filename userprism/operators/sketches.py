"""Opt-in sketches per user: bounded size, mergeable, with a stated error. Exact ones stay the default.

Quantiles use KLL sketches: a quantile's rank is off by less than ``rank_error(k)`` of a user's rows
with 99 % confidence, and is exact up to about ``k`` rows. Distinct counts use HyperLogLog sketches
with a relative standard error of ``count_error(lg)``.
"""

from pyspark.sql import functions as F

from .quantiles import QUANTILES
from .scale import col

K, LG = 200, 12


def rank_error(k=K):
    return 2.296 / k**0.9021


def count_error(lg=LG):
    return 1.04 / 2 ** (lg / 2)


def sketch_user(df, key="user_id", numbers=(), categories=(), k=K, lg=LG):
    """One row per key with a binary column ``{column}_kll`` or ``{column}_hll`` for each column.

    Sketches combine map-side, so a user with very many rows is never gathered.
    """
    rows = df.filter(col(key).isNotNull())
    return rows.groupBy(col(key)).agg(
        *[F.kll_sketch_agg_double(col(c).cast("double"), k).alias(f"{c}_kll") for c in numbers],
        *[F.hll_sketch_agg(col(c).cast("string"), lg).alias(f"{c}_hll") for c in categories],
    )


def merge_sketches(states, key="user_id", k=K):
    """One row per key of several stored sketch tables."""
    first, *others = states
    for other in others:
        first = first.unionByName(other)
    return first.groupBy(col(key)).agg(*[
        (F.kll_merge_agg_double(col(c), k) if c.endswith("_kll") else F.hll_union_agg(col(c))).alias(c)
        for c in first.columns if c != key
    ])


def read_sketches(sketches, key="user_id", stats=("q10", "median", "q90")):
    """Approximate statistics: ``{column}_{stat}`` and ``{column}_distinct``."""
    out = [col(key)]
    for c in sketches.columns:
        if c.endswith("_kll"):
            some = F.kll_sketch_get_n_double(col(c)) > 0
            for s in stats:
                value = F.when(some, F.kll_sketch_get_quantile_double(col(c), F.lit(QUANTILES[s])))
                out.append(value.alias(f"{c[:-4]}_{s}"))
        elif c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(col(c)).alias(f"{c[:-4]}_distinct"))
    return sketches.select(*out)
