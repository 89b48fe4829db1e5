"""Declarative per-user features: a ``FeatureSpec`` becomes a few grouped aggregates.

All conditional counts and sums of a spec share one aggregate instead of one pass per output
column. They combine map-side, so a user with very many rows costs no more in the shuffle
than any other.
"""

from collections import Counter
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import HEAVY_ROWS, QUANTILES, exact_quantiles
from .scale import col, literal, quoted

# Measured: one generated aggregate is fastest up to about this many columns.
AGGREGATE_COLUMNS = 95
# A category with more values than this is counted by (key, value) first and then pivoted.
PIVOT_VALUES = 60
POSITION_STATS = ("mean", "median", "max", "min", "q10", "q25", "q75", "q90")
SIMPLE_STATS = {"mean": "avg", "max": "max", "min": "min", "sum": "sum"}


@dataclass(frozen=True)
class Stats:
    """Statistics of numeric columns, named ``{column}_{stat}``."""

    columns: tuple
    stats: tuple = POSITION_STATS


@dataclass(frozen=True)
class CountBy:
    """Rows per value of a category. ``null_name`` also counts rows without a value."""

    column: str
    values: tuple | None = None
    name: str = "{feature}_{value}_count"
    null_name: str | None = None


@dataclass(frozen=True)
class SumBy:
    """Sum of an amount over the rows of each category value; 0 where there are none."""

    amount: str
    by: str
    values: tuple | None = None
    name: str = "{amount}_sum_{by}_{value}"


@dataclass(frozen=True)
class FlagBy:
    """1 where the user has any row with the value, else 0.

    The column name holds the feature, so equal values of two features stay apart.
    """

    column: str
    values: tuple | None = None
    name: str = "uses_{feature}_{value}"


@dataclass(frozen=True)
class CountWhere:
    """Rows that meet a condition, given as SQL text."""

    name: str
    condition: str


@dataclass(frozen=True)
class DistinctCount:
    """Distinct present values of a column."""

    column: str
    name: str


@dataclass(frozen=True)
class FeatureSpec:
    key: str = "user_id"
    rows: str | None = None
    parts: tuple = field(default_factory=tuple)

    def of(self, kind):
        return [p for p in self.parts if isinstance(p, kind)]


def feature_name(template, value, **fields):
    """A column name from a template; whole numbers read the same whatever their type."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return template.format(value=value, **fields)


def _typed(text, data_type):
    if isinstance(data_type, T.IntegralType):
        return int(text)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return float(text)
    if isinstance(data_type, T.BooleanType):
        return text == "true"
    return text


def discover_values(df, columns, limit=None):
    """Sorted present values of each category column, found in one pass.

    They become columns, and so part of the schema on the driver. ``limit`` lets a caller state
    how wide that may get; ``sparse.sparse_features`` serves categories of any size instead.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    pairs = [F.struct(F.lit(c).alias("f"), col(c).cast("string").alias("v")) for c in columns]
    found = (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("v").isNotNull())
        .distinct()
    )
    found = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"more than {limit} category values in {columns}: bucket them first")
    values = {c: [] for c in columns}
    for name, text in found:
        values[name].append(_typed(text, df.schema[name].dataType))
    return {c: tuple(sorted(v)) for c, v in values.items()}


def count_pairs(df, key, columns):
    """Rows per (key, feature, value) in long form, for categories of any size."""
    pairs = [F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in columns]
    return (
        df.filter(col(key).isNotNull())
        .select(col(key), F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy(col(key), "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_pairs(df, key, columns):
    """The set of values per key, one row per (key, feature, value)."""
    return count_pairs(df, key, columns).drop("n")


def rows_per_key(df, key="user_id", name="n"):
    return df.filter(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias(name))


def distinct_per_key(df, key, columns):
    """Exact distinct counts per key, one for each name of ``columns`` (name: column).

    All columns share one fold by (key, column, value) and one count per key.
    """
    fold = value_pairs(df, key, list(dict.fromkeys(columns.values())))
    counts = fold.groupBy(col(key)).agg(*[
        F.count_if(F.col("feature") == c).alias(n) for n, c in columns.items()
    ])
    return counts


def same(df, column, value):
    """SQL condition that a column has a value, compared in the column's own type.

    A value found as text, or given as a Python number, is cast to the type: 0.1 in a FLOAT
    column is not the DOUBLE 0.1.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DoubleType)):
        return f"{quoted(column)} = {literal(value)}"
    return f"{quoted(column)} = CAST({literal(str(value))} AS {kind.simpleString()})"


def _pivot_values(df, part):
    """(column to pivot on, its values): types that a pivot cannot name are compared as text."""
    kind = df.schema[part.column].dataType
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DoubleType)):
        return col(part.column), list(part.values)
    if isinstance(kind, T.FloatType):
        return col(part.column).cast("double"), [float(np.float32(v)) for v in part.values]
    if isinstance(kind, T.DecimalType):
        digits = Decimal(1).scaleb(-kind.scale)
        return col(part.column).cast("string"), [str(Decimal(str(v)).quantize(digits)) for v in part.values]
    return col(part.column).cast("string"), [str(v) for v in part.values]


def pivot_counts(df, key, part):
    """Counts of a category with many values: fold by (key, value), then spread to columns.

    The fold is dealt by key before it is spread: a task then holds the wide rows of its own keys,
    not one for nearly every key of the table.
    """
    column, values = _pivot_values(df, part)
    fold = (
        df.filter(col(key).isNotNull())
        .select(col(key), column.alias("__value"))
        .groupBy(col(key), "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    wide = fold.repartition(col(key)).groupBy(col(key)).pivot("__value", values).agg(F.sum("__n"))
    names = [feature_name(part.name, v, feature=part.column) for v in part.values]
    wide = wide.toDF(key, *names)
    filled = [f"coalesce({quoted(n)}, 0L) AS {quoted(n)}" for n in names]
    return wide.selectExpr(quoted(key), *filled)


def with_values(df, spec, limit=None):
    """The spec with every category's value list filled in."""
    column_of = lambda p: p.by if isinstance(p, SumBy) else p.column
    open_parts = [p for p in spec.of((CountBy, SumBy, FlagBy)) if p.values is None]
    found = discover_values(df, [column_of(p) for p in open_parts], limit)
    filled = []
    for part in spec.parts:
        if part in open_parts:
            settings = dict(part.__dict__, values=found[column_of(part)])
            part = type(part)(**settings)
        filled.append(part)
    return FeatureSpec(spec.key, spec.rows, tuple(filled))


def _counted_values(df, spec, found):
    """The values of the distinct counts' columns that are counted one by one anyway, all of them.

    ``found`` names the columns whose values were found in the rows, so that none is left out.
    """
    exact = (T.StringType, T.IntegralType, T.BooleanType)
    wanted = {p.column for p in spec.of(DistinctCount) if isinstance(df.schema[p.column].dataType, exact)}
    return {
        p.column: p.values for p in spec.of((CountBy, FlagBy))
        if p.column in wanted & found and 0 < len(p.values) <= PIVOT_VALUES
    }


def _cells(df, spec, counted_values):
    """(aggregates by hidden name, output columns in order, distinct counts) for statistics, counts, sums and flags.

    Expressions are SQL texts: a spec has hundreds of them, and a text reaches the JVM in one
    call. Equal counts behind several outputs are computed once. Distinct values of the columns in
    ``counted_values`` are those that are counted at all.
    """
    names, outputs, distinct = {}, [], {}

    def cell(aggregate):
        return names.setdefault(aggregate, f"__c{len(names)}")

    def count(condition):
        return cell(f"count_if({condition})")

    for stats in spec.of(Stats):
        for c in stats.columns:
            for s in stats.stats:
                simple = s in SIMPLE_STATS
                outputs.append((f"{c}_{s}", cell(f"{SIMPLE_STATS[s]}({quoted(c)})") if simple else quoted(f"{c}_{s}")))
    if spec.rows:
        outputs.append((spec.rows, cell("count(1)")))
    for part in spec.parts:
        if isinstance(part, CountWhere):
            outputs.append((part.name, count(part.condition)))
        elif isinstance(part, SumBy):
            for v in part.values:
                total = cell(f"sum(CASE WHEN {same(df, part.by, v)} THEN {quoted(part.amount)} END)")
                name = feature_name(part.name, v, amount=part.amount, by=part.by)
                outputs.append((name, f"coalesce({total}, 0D)"))
        elif isinstance(part, (CountBy, FlagBy)) and len(part.values) <= PIVOT_VALUES:
            for v in part.values:
                counted = count(same(df, part.column, v))
                if isinstance(part, FlagBy):
                    counted = f"CAST({counted} > 0 AS INT)"
                outputs.append((feature_name(part.name, v, feature=part.column), counted))
        elif isinstance(part, DistinctCount) and part.column in counted_values:
            some = (f"CAST({count(same(df, part.column, v))} > 0 AS LONG)" for v in counted_values[part.column])
            distinct[part.name] = " + ".join(some)
        if isinstance(part, CountBy) and part.null_name:
            counted = count(f"{quoted(part.column)} IS NULL")
            outputs.append((feature_name(part.name, part.null_name, feature=part.column), counted))
    return {name: aggregate for aggregate, name in names.items()}, outputs, distinct


def _chunks(items, size):
    pieces = -(-len(items) // size)
    width = -(-len(items) // pieces) if pieces else 1
    return [items[i : i + width] for i in range(0, len(items), width)]


def build_features(df, spec, heavy_rows=HEAVY_ROWS, max_values=None):
    """One row per key with every column the spec declares. Rows without a key are left out.

    ``max_values`` states how many values of open categories may become columns.
    """
    df = df.filter(col(spec.key).isNotNull())
    found = {p.column for p in spec.of((CountBy, FlagBy)) if p.values is None}
    spec = with_values(df, spec, max_values)
    counted_values = _counted_values(df, spec, found)
    key = col(spec.key)
    parts, outputs = [], []

    for stats in spec.of(Stats):
        ranks = [s for s in stats.stats if s in QUANTILES]
        if ranks:
            parts.append(exact_quantiles(df, spec.key, list(stats.columns), ranks, heavy_rows))

    aggregates, cells, counted_distinct = _cells(df, spec, counted_values)
    for chunk in _chunks(list(aggregates.items()), AGGREGATE_COLUMNS):
        parts.append(df.groupBy(key).agg(*[F.expr(f"{a} AS {n}") for n, a in chunk]))
    outputs += cells

    pivoted = {}
    for part in spec.of((CountBy, FlagBy)):
        if len(part.values) > PIVOT_VALUES:
            # Counts and flags of the same values share a pivot.
            same_values = part.column, tuple(part.values)
            if same_values not in pivoted:
                parts.append(pivot_counts(df, spec.key, part))
                pivoted[same_values] = parts[-1].columns[1:]
            for v, n in zip(part.values, pivoted[same_values]):
                counted = quoted(n)
                if isinstance(part, FlagBy):
                    counted = f"CAST({counted} > 0 AS INT)"
                outputs.append((feature_name(part.name, v, feature=part.column), counted))

    distinct = {part.name: part.column for part in spec.of(DistinctCount) if part.name not in counted_distinct}
    if distinct:
        # A key whose values are all missing has no fold.
        keys = df.select(key).distinct()
        parts.append(keys.join(distinct_per_key(df, spec.key, distinct), spec.key, "left"))

    names = dict.fromkeys(part.name for part in spec.of(DistinctCount))
    outputs += [(n, f"coalesce({counted_distinct.get(n, quoted(n))}, 0L)") for n in names]

    repeated = sorted(n for n, times in Counter(n for n, _ in outputs).items() if times > 1)
    if repeated:
        raise ValueError(f"feature names used twice: {repeated}")
    # Every part has the same keys and arrives partitioned by the key.
    joined: DataFrame = reduce(lambda a, b: a.join(b, spec.key), parts)
    return joined.selectExpr(quoted(spec.key), *[f"{c} AS {quoted(n)}" for n, c in outputs])
