"""Pearson correlation with the label, and the full matrix."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from .scale import col, literal, quoted, stage
from .sparse import cells, dictionary

# Features of a strip, and products of two strips that a task holds at once: 512 KB each.
STRIP = 256
HELD = 64


def _numbers(df, features):
    """Array of (feature, number) of a row, as SQL text."""
    cells = (f"struct({literal(n)} AS feature, CAST({quoted(n)} AS DOUBLE) AS x)" for n in features)
    return F.expr(f"array({', '.join(cells)})")


def _correlation(x, y):
    """Pearson correlation over the rows where both are present; null for a constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def target_correlation(df, features, target="target"):
    """One row per feature: Pearson correlation with the label, null for a constant feature.

    Each feature uses the rows where it and the label are present. A task folds its rows to one row
    of moments per feature, and only those are shuffled and added up.
    """
    numbers = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate([target, *features])])
    moments = numbers.mapInArrow(lambda b: _moments(b, features), MOMENTS)
    each = Window.partitionBy("feature")

    def mean(c):
        return F.try_divide(F.sum(F.col("n") * F.col(c)).over(each), F.sum("n").over(each))

    apart = moments.withColumns({"dx": F.col("x") - mean("x"), "dy": F.col("y") - mean("y")})
    products = {"xx": ("dx", "dx"), "yy": ("dy", "dy"), "xy": ("dx", "dy")}
    sums = apart.groupBy("feature").agg(
        *[F.sum(F.col(s) + F.col("n") * F.col(a) * F.col(b)).alias(s) for s, (a, b) in products.items()],
        *[F.min(c).alias(c) for c in ("x_low", "y_low")], *[F.max(c).alias(c) for c in ("x_high", "y_high")],
    )

    def spread(c):
        # The means of a constant's parts may be rounded apart.
        constant = (F.col(f"{c}_low") == F.col(f"{c}_high")) & (F.abs(f"{c}_low") < float("inf"))
        return F.when(constant, 0.0).otherwise(F.sqrt(c + c))

    return sums.select("feature", F.try_divide("xy", spread("x") * spread("y")).alias("correlation"))


MOMENTS = "feature string, n double, " + ", ".join(
    f"{c} double" for c in ("x", "y", "xx", "yy", "xy", "x_low", "x_high", "y_low", "y_high")
)


def _moments(batches, features):
    """One row per feature and task: count, means, centred sums of products and extremes.

    Rows without the feature or the label are left out of both.
    """
    held = None
    with np.errstate(all="ignore"):
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0)
                found = np.array([_column_moments(batch.column(i + 1), y) for i in range(len(features))]).reshape(-1, 10).T
                held = found if held is None else _added(held, found)
    if held is not None:
        arrays = [pa.array(features, pa.string()), *[pa.array(a) for a in held]]
        yield pa.RecordBatch.from_arrays(arrays, names=["feature", "n", "x", "y", "xx", "yy", "xy", "x_low", "x_high", "y_low", "y_high"])


def _column_moments(x, y):
    present = None
    if x.null_count or y.null_count:
        present = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
    x, y = (v.to_numpy(zero_copy_only=False) for v in (x, y))
    if present is not None:
        x, y = x[present], y[present]
    if not len(x):
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, np.inf, -np.inf, np.inf, -np.inf
    # Less the first value, so that a constant has exactly itself as its mean.
    dx, dy = x - x[0], y - y[0]
    mx, my = dx.mean(), dy.mean()
    dx, dy = dx - mx, dy - my
    return len(x), x[0] + mx, y[0] + my, dx @ dx, dy @ dy, dx @ dy, x.min(), x.max(), y.min(), y.max()


def _added(a, b):
    """The moments of two sets of rows as those of their union."""
    (na, xa, ya), (nb, xb, yb) = a[:3], b[:3]
    n = na + nb
    part = nb / np.maximum(n, 1)
    dx, dy = xb - xa, yb - ya
    between = na * part
    return np.array([
        n, np.where(na > 0, xa + dx * part, xb), np.where(na > 0, ya + dy * part, yb),
        a[3] + b[3] + dx * dx * between, a[4] + b[4] + dy * dy * between, a[5] + b[5] + dx * dy * between,
        np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9]),
    ])


def select_by_correlation(df, target="target", key="user_id", threshold=0.2):
    """Features whose absolute correlation with the label is strictly above the threshold."""
    features = [c for c in df.columns if c not in (target, key)]
    found = target_correlation(df, features, target).filter(F.abs("correlation") > threshold)
    kept = {r[0] for r in found.select("feature").collect()}
    return [f for f in features if f in kept]


def correlation_matrix(df, columns):
    """All pairs in long form; null where either feature is constant.

    Each pair uses the rows where both are present, as with the label. Pairs are made, folded
    map-side and returned by the executors.
    """
    rows = df.select(_numbers(df, columns).alias("a")).withColumn("b", F.col("a"))
    pairs = rows.select("b", F.inline("a")).select(F.col("feature"), F.col("x"), F.inline("b").alias("other", "y"))
    return pairs.groupBy("feature", "other").agg(_correlation(F.col("x"), F.col("y")).alias("correlation"))


def _products(batches, strip):
    """Sums of products of two strips of features over the users of a task.

    Yields (row, other, sums): a feature, a strip, and the sums with each feature of the strip.
    """
    held = {}

    def flush():
        for (s, t), product in held.items():
            some = np.flatnonzero(product.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((some + s * strip).astype(np.int64)), pa.array(np.full(len(some), t, np.int64)),
                    pa.array(list(product[some]), pa.list_(pa.float64())),
                ],
                names=["row", "other", "sums"],
            )
        held.clear()

    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        user = np.repeat(np.arange(len(lists)), sizes)
        flat = lists.flatten()
        index, value = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("index", "value"))
        strips = {}
        for s in np.unique(index // strip):
            mine = index // strip == s
            dense = np.zeros((len(lists), strip))
            dense[user[mine], index[mine] - s * strip] = value[mine]
            strips[int(s)] = dense
        for s, left in strips.items():
            for t, right in strips.items():
                if s <= t:
                    product = left.T @ right
                    held[s, t] = held[s, t] + product if (s, t) in held else product
                    if len(held) >= HELD:
                        yield from flush()
    yield from flush()


def gram(long, names, key="user_id", strip=STRIP):
    """(row, column, xy): sums of products of all pairs of features, zeros left out.

    The matrix is made in tiles of ``strip`` features a side: a task multiplies its users' strips
    and holds at most ``HELD`` tiles, whose rows are added up by executors. A user's row is read
    once, not once for each pair of its features.
    """
    rows = cells(long, names, key).groupBy(col(key)).agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("cells"))
    tiles = rows.select("cells").mapInArrow(lambda b: _products(b, strip), "row long, other long, sums array<double>")
    summed = tiles.groupBy("row", "other").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    pairs = summed.select("row", "other", F.posexplode(vector_to_array("sums")).alias("at", "xy"))
    return pairs.select("row", (F.col("other") * strip + F.col("at")).alias("column"), "xy").filter("xy <> 0")


def wide_correlation_matrix(long, users, key="user_id", strip=STRIP):
    """(feature, other, correlation) of all pairs of a long table's features over ``users``.

    A user without a cell is a 0. Null where either feature is constant.
    """
    long = stage(long)
    names = stage(dictionary(long))
    n = F.lit(float(users.count()))
    x = F.col("value")
    sums = cells(long, names, key).groupBy("index").agg(
        F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.count(F.lit(1)).alias("cells"), F.min(x).alias("low"), F.max(x).alias("high"),
    )
    spread = F.when((F.col("cells") < n) | (F.col("low") < F.col("high")), n * F.col("xx") - F.col("x") * F.col("x"))
    sums = stage(sums.join(names, "index").select("index", "name", "x", F.when(spread > 0, F.sqrt(spread)).alias("spread")))
    half = gram(long, names, key, strip)
    xy = half.unionByName(
        half.filter(F.floor(F.col("row") / strip) < F.floor(F.col("column") / strip)).select(
            F.col("column").alias("row"), F.col("row").alias("column"), "xy"
        )
    )
    a, b = (sums.select(*[F.col(c).alias(c + side) for c in sums.columns]) for side in ("_a", "_b"))
    # Every pair of features is a row of the result, also those that no user has both.
    pairs = a.select("*", F.explode(F.sequence(F.lit(0), F.lit(names.count() - 1))).alias("index_b")).join(b, "index_b")
    pairs = pairs.join(xy, (pairs.index_a == xy.row) & (pairs.index_b == xy.column), "left")
    value = F.try_divide(n * F.coalesce("xy", F.lit(0.0)) - F.col("x_a") * F.col("x_b"), F.col("spread_a") * F.col("spread_b"))
    return pairs.select(F.col("name_a").alias("feature"), F.col("name_b").alias("other"), value.alias("correlation"))
