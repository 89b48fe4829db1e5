"""Building blocks that stay whole when one key holds a large share of all rows.

* ``stage`` cuts lineage by writing a table to the shared checkpoint folder, so lost executors
  only cost a re-read.
* ``lookup_join`` broadcasts the small side only after measuring it; beyond the bound it
  broadcasts the few hot keys and shuffles the rest.
* ``prefix_sums`` is a running total over any number of rows, computed per range partition.
"""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side is broadcast only up to this measured size.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot above total / HOT_SHARE rows, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000

PART = "__part"
# Spark deletes the shuffle files of a query as it ends, not when the driver's JVM comes to collect it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def quoted(name):
    return "`" + name.replace("`", "``") + "`"


def literal(value):
    """A Python value as SQL text."""
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name):
    """Column by exact name: feature names may hold dots, dashes and spaces."""
    return F.col(quoted(name))


def shared_dir(spark):
    """The folder for staged tables: the session's checkpoint folder.

    Only a local session may fall back to a temporary folder; on a cluster executors would
    not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="userprism-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df, schema=None):
    """Write ``df`` once to the shared folder and continue from the written table.

    ``schema`` reads it with other types of the same layout, as ML vectors are a struct in Parquet.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


_scopes = []
_cleanup_lock = threading.Lock()
_cleanups = {"open": 0, "before": None}


@contextmanager
def shuffles_removed(spark):
    """Queries that end inside leave no shuffle files: for writes, whose result is read from what they wrote."""
    with _cleanup_lock:
        if not _cleanups["open"]:
            _cleanups["before"] = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _cleanups["open"] += 1
    try:
        yield
    finally:
        with _cleanup_lock:
            _cleanups["open"] -= 1
            if not _cleanups["open"]:
                if _cleanups["before"] is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, _cleanups["before"])


@contextmanager
def staging(spark):
    """Tables staged inside are deleted at the end: write or collect results before that."""
    paths = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        # By identity: two scopes may hold equal lists.
        _scopes[:] = [s for s in _scopes if s is not paths]
        for path in paths:
            _delete(spark, path)


def without_steps(spark, build):
    """The frames that ``build()`` returns; tables staged on the way that none of them reads are deleted."""
    with staging(spark) as paths:
        found = build()
        frames = found if isinstance(found, tuple) else (found,)
        files = [file for frame in frames for file in frame.inputFiles()]
        paths[:] = [p for p in paths if not any(f"/{p.rsplit('/', 1)[1]}/" in file for file in files)]
    return found


def _delete(spark, pattern):
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(place) or ():
        files.delete(status.getPath(), True)


def clear_staged(spark):
    """Delete what this application staged, once its results are no longer read."""
    for kind in ("stage", "events", "halves", "store", "warc"):
        _delete(spark, f"{shared_dir(spark)}/{kind}-*")


def measured_bytes(df):
    """Uncompressed size of a frame, from one aggregate over it."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = 8 * len(df.columns) + 16
    sizes = [F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)) for c in texts]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"t{i}") for i, s in enumerate(sizes)]).first()
    return row[0] * width + sum(row[1:])


def hot_keys(facts, key):
    """Values of ``key`` on more than 1/HOT_SHARE of the rows: at most HOT_SHARE of them."""
    counts = facts.filter(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return [r[0] for r in counts.filter(F.col("n") * HOT_SHARE > total).collect()]


def fits_broadcast(table, limit_bytes=BROADCAST_BYTES):
    return measured_bytes(table) <= limit_bytes


def join_side(table, key, limit_bytes=BROADCAST_BYTES):
    """A table to join by its ``key``, broadcast by Spark only if its keys measure no more than the limit.

    Spark goes by the size of the files, less the columns that are not read: a small part of what many
    rows take in the driver, and each join of a query may collect them anew.
    """
    return table if fits_broadcast(table.select(col(key)), limit_bytes) else table.hint("merge")


def lookup_join(facts, lookup, key, how="left", limit_bytes=BROADCAST_BYTES, staged=False, fits=None):
    """Join many rows to a lookup that is unique on ``key``, without shuffling a hot key.

    The lookup is staged and measured. Within ``limit_bytes`` it is broadcast. Beyond, rows
    with a hot or null key meet only the hot part of the lookup (a broadcast of at most
    HOT_SHARE rows) and all other rows are joined through a shuffle. ``fits`` passes on a
    measurement the caller has made of a staged lookup.
    """
    lookup = lookup if staged else stage(lookup)
    if fits_broadcast(lookup, limit_bytes) if fits is None else fits:
        return facts.join(F.broadcast(lookup), key, how)
    hot = hot_keys(facts, key)
    is_hot = col(key).isin(hot) if hot else F.lit(False)
    stays = is_hot | col(key).isNull()
    local = facts.filter(stays).join(F.broadcast(lookup.filter(is_hot)), key, how)
    spread = facts.filter(~stays).join(lookup.filter(~is_hot), key, how)
    return local.unionByName(spread)


def sorted_parts(df, group, order, amount, partitions=None):
    """Range-partition ``df`` by (group, order) and total ``amount`` per group and partition.

    Returns the staged rows with their partition number and one row per (group, partition)
    with ``part_before``, ``part_total`` and ``group_total``. The partition number is written
    with the rows, so both results always agree on it.
    """
    keys = [col(g) for g in group]
    # Without a given number, adaptive execution merges small neighbouring ranges.
    ordered = df.repartitionByRange(*([partitions] if partitions else []), *keys, col(order))
    parts = stage(ordered.withColumn(PART, F.spark_partition_id()))
    totals = parts.groupBy(*keys, PART).agg(F.sum(col(amount)).alias("part_total"))
    # At most one row per range partition in each group, whatever the number of input rows.
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(
        *keys,
        PART,
        "part_total",
        F.coalesce(F.sum("part_total").over(earlier), F.lit(0)).alias("part_before"),
        F.sum("part_total").over(whole).alias("group_total"),
    )
    return parts, placed


def prefix_sums(df, group, order, amount, keep=None, partitions=None):
    """Add ``before``: the sum of ``amount`` over earlier rows of the group, and ``group_total``.

    Rows must be unique on (group, order). A group of any size is spread over range
    partitions; only the per-partition totals meet in one window. ``keep`` filters partitions
    on their totals when the caller needs a few ranks only.
    """
    parts, placed = sorted_parts(df, group, order, amount, partitions)
    if keep is not None:
        placed = placed.filter(keep)
    if not group:
        placed = F.broadcast(placed)  # one row per range partition
    keys = [col(g) for g in group]
    earlier = (
        Window.partitionBy(*keys, PART).orderBy(col(order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("part_before") + F.coalesce(F.sum(col(amount)).over(earlier), F.lit(0))
    return (
        parts.join(placed, [*group, PART])
        .withColumn("before", before)
        .drop(PART, "part_total", "part_before")
    )
