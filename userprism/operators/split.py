"""Deterministic row splits that do not depend on partitioning."""

from pyspark.sql import functions as F

from .scale import col


def hash_fraction(key, seed, part="test"):
    """First 32 bits of a hash of the key, as eight hex digits: uniform and ordered as text."""
    text = F.concat_ws(":", F.lit(f"{part}{seed}"), key.cast("string"))
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def in_fraction(key, fraction, seed, part="test"):
    if fraction >= 1:
        return F.lit(True)
    return hash_fraction(key, seed, part) < F.lit(f"{int(fraction * 2**32):08x}")


def hash_split(df, fraction=0.2, seed=42, key="user_id", part="test"):
    """(rest, chosen): about ``fraction`` of the keys are chosen, the same ones every time.

    ``part`` names the purpose, so a second split of the rest is independent of the first.
    """
    chosen = in_fraction(col(key), fraction, seed, part)
    return df.filter(~chosen), df.filter(chosen)


def fold_column(key, folds, seed):
    """Fold number 0..folds-1 from the key's hash."""
    return (F.conv(hash_fraction(key, seed, "fold"), 16, 10).cast("long") % folds).cast("int")
