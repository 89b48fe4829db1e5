"""Features of a spec whose categories have any number of values: long and sparse form.

Nothing of the width reaches the driver: names are a table, numbered by running totals over
range partitions, and a user's row holds only the features it has.
"""

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import CountBy, FeatureSpec, FlagBy, SumBy, build_features
from .scale import col, literal, lookup_join, prefix_sums, quoted, stage


def _name(part, text, **fields):
    """Column of the output names: the template with the category's text put in."""
    before, _, after = part.name.format(value="\0", **fields).partition("\0")
    # Whole numbers read the same whatever their type.
    return F.concat(F.lit(before), F.regexp_replace(text, r"^(-?[0-9]+)\.0$", "$1"), F.lit(after))


def _folded(df, key, part):
    """(key, name, value) of one category part: one fold by (key, value)."""
    by = part.by if isinstance(part, SumBy) else part.column
    fields = {"amount": part.amount, "by": by} if isinstance(part, SumBy) else {"feature": by}
    amount = (
        F.sum(col(part.amount).cast("double")) if isinstance(part, SumBy)
        else F.count(F.lit(1)).cast("double") if isinstance(part, CountBy) else F.lit(1.0)
    )
    rows = df.filter(col(by).isNotNull())
    if part.values is not None:
        rows = rows.filter(col(by).isin(list(part.values)))
    folded = rows.groupBy(col(key), col(by).alias("__value")).agg(F.count(F.lit(1)).alias("__n"), amount.alias("value"))
    return folded.select(col(key), _name(part, F.col("__value").cast("string"), **fields).alias("name"), "value")


def long_features(df, spec):
    """One row (key, name, value) per feature a user has; a feature without a row is 0."""
    df = df.filter(col(spec.key).isNotNull())
    wide = [p for p in spec.parts if isinstance(p, (CountBy, SumBy, FlagBy))]
    narrow = [p for p in spec.parts if p not in wide]
    narrow += [CountBy(p.column, (), p.name, p.null_name) for p in wide if isinstance(p, CountBy) and p.null_name]
    parts = [_folded(df, spec.key, p) for p in wide]
    if narrow or spec.rows:
        dense = build_features(df, FeatureSpec(spec.key, spec.rows, tuple(narrow)))
        cells = ", ".join(
            f"struct({literal(c)} AS name, CAST({quoted(c)} AS DOUBLE) AS value)" for c in dense.columns if c != spec.key
        )
        parts.append(dense.select(col(spec.key), F.inline(F.expr(f"array({cells})"))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter("value IS NOT NULL AND value <> 0")


def dictionary(long):
    """(name, index) of all features of a long table, numbered by name from 0."""
    names = long.select("name").distinct().withColumn("one", F.lit(1))
    return prefix_sums(names, [], "name", "one").select("name", F.col("before").cast("long").alias("index"))


def cells(long, names, key="user_id"):
    """(key, index, value) of the features that a staged dictionary ``names`` knows; others are left out.

    A feature that every user has is a hot name, which ``lookup_join`` keeps out of the shuffle.
    """
    return lookup_join(long, names, "name", "inner", staged=True).select(
        col(key), F.col("index").cast("int").alias("index"), "value"
    )


def vectors(long, key, users=None, names=None):
    """(one sparse vector per key, the dictionary) of a long table.

    With ``names``, a stored dictionary, vectors have its layout: unseen names are ignored, absent
    ones are 0. With ``users``, a table of keys, exactly these have a row; one without features is
    all zero, and the table's other columns, as a label, follow. Vectors are built as the struct that
    holds them in Parquet, so no Python runs.
    """
    if names is None:
        long = stage(long)
        names = dictionary(long)
    names = stage(names)
    width = names.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    placed = cells(long, names, key).groupBy(col(key)).agg(
        F.sort_array(F.collect_list(F.struct("index", "value"))).alias("cells")
    )
    more = []
    if users is not None:
        placed = users.join(placed, key, "left")
        more = [c for c in users.columns if c != key]
    held = F.coalesce(F.col("cells"), F.array().cast("array<struct<index: int, value: double>>"))
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(width).cast("int").alias("size"),
        held["index"].alias("indices"), held["value"].alias("values"),
    )
    rows = placed.select(col(key), vector.alias("features"), *[col(c) for c in more])
    schema = T.StructType([placed.schema[key], T.StructField("features", VectorUDT()), *[placed.schema[c] for c in more]])
    return stage(rows, schema), names


def sparse_features(df, spec):
    """(one sparse vector per key, the dictionary) of a table's features."""
    return vectors(long_features(df, spec), spec.key)


def target_correlation(long, labels, key="user_id", target="target"):
    """(name, correlation) of every feature of a long table with the label of its users.

    ``labels`` has a row (key, target) per user. Only present cells are read: a user without a
    cell is a 0, so the moments of n users follow from the cells' own sums. Null for a constant.
    """
    y = col(target).cast("double")
    whole = labels.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))
    n, sum_y, sum_yy = (F.lit(v or 0.0) for v in whole.first())
    labelled = long.join(labels.select(col(key), y.alias("__y")), key)
    x = F.col("value").cast("double")
    sums = labelled.groupBy("name").agg(
        F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(x * F.col("__y")).alias("xy"),
        F.count(F.lit(1)).alias("cells"), F.min(x).alias("low"), F.max(x).alias("high"),
    )
    spread_x = n * F.col("xx") - F.col("x") * F.col("x")
    spread_y = n * sum_yy - sum_y * sum_y
    constant = (F.col("cells") == n) & (F.col("low") == F.col("high"))
    value = F.try_divide(n * F.col("xy") - F.col("x") * sum_y, F.sqrt(spread_x) * F.sqrt(spread_y))
    return sums.select("name", F.when(~constant & (spread_x > 0), value).alias("correlation"))


def select_names(correlations, threshold=0.2):
    """The dictionary (name, index) of the features whose absolute correlation is above ``threshold``."""
    return dictionary(correlations.filter(F.abs("correlation") > threshold))
