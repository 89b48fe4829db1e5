"""Exact interpolated quantiles per key and for a whole table."""

from functools import reduce

from pyspark.sql import functions as F

from .scale import col, fits_broadcast, lookup_join, prefix_sums, quoted, stage

# Quantile statistics by name.
QUANTILES = {"q10": 0.10, "q25": 0.25, "median": 0.50, "q75": 0.75, "q90": 0.90, "q99": 0.99}

# Keys with more rows than this leave ``percentile`` and lists, which hold a key's values in a task.
HEAVY_ROWS = 100_000
# From this many columns on, a sorted list a column is faster than ``percentile``, which counts values in a map.
LISTED_COLUMNS = 4


def quantile_columns(columns, stats):
    return [f"{c}_{s}" for c in columns for s in stats]


def exact_quantiles(df, key, columns, stats, heavy_rows=HEAVY_ROWS):
    """One row per key with ``{column}_{stat}``; missing values are skipped.

    Keys up to ``heavy_rows`` rows use the built-in ``percentile`` with one array per column, or a
    sorted list per column where there are several. Larger keys are ranked over range partitions.
    All give the same interpolated value.
    """
    rows = df.select(col(key), *[col(c) for c in columns]).filter(col(key).isNotNull())
    counts = rows.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.filter(F.col("n") > heavy_rows).select(col(key))
    per_key = by_lists if len(columns) >= LISTED_COLUMNS else by_percentile
    if heavy.isEmpty():
        return per_key(rows, key, columns, stats)
    heavy = stage(heavy)
    fits = fits_broadcast(heavy)

    def part(how):
        return lookup_join(rows, heavy, key, how, staged=True, fits=fits)

    light = per_key(part("left_anti"), key, columns, stats)
    ranked = by_rank(part("left_semi"), [key], columns, stats)
    # A heavy key whose numbers are all missing has no ranked cell but keeps its row.
    return light.unionByName(heavy.join(ranked, key, "left"))


def by_percentile(rows, key, columns, stats):
    probs = ", ".join(f"{QUANTILES[s]}D" for s in stats)
    arrays = [f"percentile({quoted(c)}, array({probs})) AS __p{i}" for i, c in enumerate(columns)]
    grouped = rows.groupBy(col(key)).agg(*[F.expr(a) for a in arrays])
    return grouped.selectExpr(
        quoted(key),
        *[
            f"__p{i}[{j}] AS {quoted(f'{c}_{s}')}"
            for i, c in enumerate(columns)
            for j, s in enumerate(stats)
        ],
    )


def by_lists(rows, key, columns, stats):
    """``by_percentile`` from one sorted list of present values per column."""
    lists = [f"sort_array(collect_list(CAST({quoted(c)} AS DOUBLE))) AS __l{i}" for i, c in enumerate(columns)]
    grouped = rows.groupBy(col(key)).agg(*[F.expr(a) for a in lists])

    def interpolated(values, p):
        at = f"({p}D * (size({values}) - 1))"
        low, high = f"get({values}, CAST(floor({at}) AS INT))", f"get({values}, CAST(ceil({at}) AS INT))"
        between = f"(ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high}"
        return f"CASE WHEN {low} = {high} THEN {low} ELSE {between} END"

    return grouped.selectExpr(
        quoted(key),
        *[
            f"{interpolated(f'__l{i}', QUANTILES[s])} AS {quoted(f'{c}_{s}')}"
            for i, c in enumerate(columns)
            for s in stats
        ],
    )


def by_rank(rows, keys, columns, stats):
    """Quantiles through global ranks: no key is ever gathered in one task.

    Values are first counted per (key, column, value), which folds repeats before the
    shuffle; ranks then come from running totals, and only the range partitions that hold a
    wanted rank are sorted.
    """
    key_cols = [col(k) for k in keys]
    numbered = [
        F.struct(F.lit(i).alias("__feature"), col(c).cast("double").alias("__value"))
        for i, c in enumerate(columns)
    ]
    cells = (
        rows.select(*key_cols, F.inline(F.array(*numbered)))
        .filter(F.col("__value").isNotNull())
        .groupBy(*key_cols, "__feature", "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    return rank_cells(cells, keys, columns, stats)


def rank_cells(cells, keys, columns, stats):
    """Quantiles of counted values: (keys, __feature, __value, __n), the feature by its place in ``columns``."""
    key_cols = [col(k) for k in keys]
    position = {s: F.lit(QUANTILES[s]) * (F.col("group_total") - 1) for s in stats}
    wanted = [edge(position[s]) for s in stats for edge in (F.floor, F.ceil)]

    def holds(rank, start, count):
        return (start <= rank) & (rank < start + count)

    keep = reduce(
        lambda a, b: a | b, [holds(r, F.col("part_before"), F.col("part_total")) for r in wanted]
    )
    ranked = prefix_sums(cells, [*keys, "__feature"], "__value", "__n", keep=keep)

    def value_at(rank):
        return F.max(F.when(holds(rank, F.col("before"), F.col("__n")), F.col("__value")))

    edges = ranked.groupBy(*key_cols, "__feature").agg(
        F.max("group_total").alias("group_total"),
        *[value_at(F.floor(position[s])).alias(f"__lo_{s}") for s in stats],
        *[value_at(F.ceil(position[s])).alias(f"__hi_{s}") for s in stats],
    )

    def interpolated(stat):
        h = position[stat]
        low, high = F.col(f"__lo_{stat}"), F.col(f"__hi_{stat}")
        return F.when(low == high, low).otherwise(
            (F.ceil(h) - h) * low + (h - F.floor(h)) * high
        )

    values = edges.select(*key_cols, "__feature", *[interpolated(s).alias(s) for s in stats])
    return values.groupBy(*key_cols).agg(
        *[
            F.max(F.when(F.col("__feature") == i, F.col(s))).alias(f"{c}_{s}")
            for i, c in enumerate(columns)
            for s in stats
        ]
    )
