"""The training table: feature tables joined on the positions users, zero-filled and labelled."""

from pyspark.sql import functions as F

from .cleaning import fill_zero
from .idsets import distinct_ids
from .scale import lookup_join


def side_by_side(a, b, key="user_id"):
    """Two per-user tables as one; a key of either side is kept."""
    return a.join(b, key, "full")


def _checked_join(left, right, key, key_present):
    shared = set(left.columns) & set(right.columns) - {key}
    if shared:
        raise ValueError(f"feature names in both tables: {sorted(shared)}")
    joined = left.join(right, key, "left")
    return fill_zero(joined, [c for c in joined.columns if c != key] if key_present else None)


def merge_features(positions, events, attribution, key="user_id", key_present=False):
    """All positions users with their events and attribution features, zero where absent.

    ``key_present`` states that no position lacks its key. It then stays the column that the tables
    were grouped by, so that no join deals the wide rows anew.
    """
    return _checked_join(_checked_join(positions, events, key, key_present), attribution, key, key_present)


def label_users(users, deposits, key="user_id", name="target"):
    """1 for users with a deposit, else 0. Both sides have one row per user."""
    ids = distinct_ids(deposits, key).withColumn("__paid", F.lit(1))
    flagged = users.join(ids, key, "left")
    return flagged.withColumn(name, F.coalesce("__paid", F.lit(0))).drop("__paid")


def label_rows(rows, deposits, key="user_id", name="made_depo"):
    """The label on every row of a log; a user with very many rows stays spread out."""
    ids = distinct_ids(deposits, key).withColumn("__paid", F.lit(1))
    flagged = lookup_join(rows, ids, key)
    return flagged.withColumn(name, F.coalesce("__paid", F.lit(0))).drop("__paid")
