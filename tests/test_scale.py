import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import bag, by_key
from userprism.operators import scale
from userprism.operators.quantiles import by_rank, exact_quantiles

STATS = ["q10", "q25", "median", "q75", "q90"]


@pytest.fixture(scope="module")
def skewed(spark):
    """User 0 holds a third of all rows, many of them equal; some values are missing."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 == 0, 0).otherwise(n % 40 + 1).cast("long").alias("user_id"),
        F.when(n % 17 != 0, (n * 7919 % 1013).cast("double") / 4).alias("x"),
        F.when(n % 2 == 0, 5.0).otherwise((n % 11).cast("double")).alias("y"),
    )


def numpy_quantiles(rows, columns):
    groups = {}
    for r in rows:
        groups.setdefault(r["user_id"], []).append(r)
    expected = {}
    for user, members in groups.items():
        for c in columns:
            values = [m[c] for m in members if m[c] is not None]
            for s, p in zip(STATS, (0.1, 0.25, 0.5, 0.75, 0.9)):
                expected[user, f"{c}_{s}"] = float(np.quantile(values, p)) if values else None
    return expected


@pytest.mark.parametrize("heavy_rows", [10**6, 500, 0])
def test_quantiles_are_exact_on_every_path(skewed, heavy_rows):
    expected = numpy_quantiles(skewed.collect(), ["x", "y"])
    found = by_key(exact_quantiles(skewed, "user_id", ["x", "y"], STATS, heavy_rows))
    assert len(found) == 41
    for (user, name), value in expected.items():
        assert found[user][name] == pytest.approx(value), (user, name)


def test_documented_quantiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 10)], "user_id long, v double")
    for heavy in (0, 100):
        row = exact_quantiles(df, "user_id", ["v"], STATS, heavy).first()
        assert [round(x, 9) for x in row[1:]] == [1.3, 1.75, 3.0, 5.5, 8.2]


def test_heavy_user_without_numbers_is_kept(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "user_id long, v double")
    found = by_key(exact_quantiles(df, "user_id", ["v"], ["median"], heavy_rows=1))
    assert found[1]["v_median"] is None and found[2]["v_median"] == 3.0


def test_whole_table_quantiles(skewed):
    values = [r.x for r in skewed.collect() if r.x is not None]
    row = by_rank(skewed, [], ["x"], STATS).first()
    assert list(row) == pytest.approx([np.quantile(values, p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])


def test_prefix_sums_match_a_plain_running_total(spark):
    rows = [(g, v, (v * 7 + g) % 5 + 1) for g in range(3) for v in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, n int").repartition(7)
    for group in (["g"], []):
        source = df if group else df.filter("g = 0")
        found = scale.prefix_sums(source, group, "v", "n", partitions=5)
        running = {}
        for r in sorted(found.collect(), key=lambda r: (r["g"], r["v"])):
            assert r["before"] == running.get(r["g"], 0)
            running[r["g"]] = r["before"] + r["n"]
        assert all(r["group_total"] == running[r["g"]] for r in found.collect())


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_beyond_the_broadcast_bound(spark, how, monkeypatch):
    monkeypatch.setattr(scale, "HOT_SHARE", 20)
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id") % 500).alias("k"),
        F.col("id").alias("row"),
    )
    lookup = spark.range(0, 600, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    lookup = lookup.union(spark.createDataFrame([(7, 70)], "k long, v long"))
    assert 7 in scale.hot_keys(facts, "k")
    small = scale.lookup_join(facts, lookup, "k", how)
    large = scale.lookup_join(facts, lookup, "k", how, limit_bytes=0)
    assert bag(small) == bag(large) == bag(facts.join(lookup, "k", how))


def test_hot_keys_are_few(spark):
    facts = spark.range(5000).select(F.when(F.col("id") < 1700, -1).otherwise(F.col("id")).alias("k"))
    assert scale.hot_keys(facts, "k") == [-1]


def test_stage_reads_back_the_same_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "a long, b string, e double")
    df = df.withColumnRenamed("a", "x.y").withColumnRenamed("b", "c d")
    staged = scale.stage(df)
    assert staged.columns == ["x.y", "c d", "e"] and bag(staged) == bag(df)


def test_staged_tables_can_be_cleared(spark):
    staged = scale.stage(spark.range(3))
    assert staged.count() == 3
    scale.clear_staged(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|FAILED_READ_FILE"):
        staged.selectExpr("sum(id)").collect()


def test_measured_bytes_counts_text(spark):
    short = spark.createDataFrame([("a",)] * 10, "t string")
    long = spark.createDataFrame([("a" * 1000,)] * 10, "t string")
    assert scale.measured_bytes(long) - scale.measured_bytes(short) == 10 * 999
    assert math.isclose(scale.measured_bytes(short.limit(0)), 0)


def test_a_staging_scope_deletes_its_own_tables(spark):
    outside = scale.stage(spark.range(3))
    with scale.staging(spark) as paths:
        inside = scale.stage(spark.range(5))
        assert inside.count() == 5 and len(paths) == 1
    assert outside.count() == 3
    with pytest.raises(Exception, match="(?i)does not exist|not found|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(paths[0]).count()


def test_quantiles_from_lists_equal_percentile(spark):
    from userprism.operators import quantiles

    nan, inf = float("nan"), float("inf")
    values = [[1.0, 2.0, 4.0, 10.0], [None, None], [5.0], [3.0, 3.0, None, 1.5], [nan, 1.0, 2.0], [inf, inf, 0.0], [-inf, inf], [0.1] * 7]
    rows = [(k, v, None if v is None or v != v or abs(v) == inf else int(v)) for k, some in enumerate(values) for v in some]
    df = spark.createDataFrame(rows, "k long, `a.b` double, i int").repartition(3)
    stats = list(quantiles.QUANTILES)
    lists, maps = (
        sorted(map(str, f(df, "k", ["a.b", "i"], stats).collect())) for f in (quantiles.by_lists, quantiles.by_percentile)
    )
    assert lists == maps and len(lists) == len(values)


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_a_staged_table_leaves_no_shuffle_files(spark, tmp_path):
    from userprism.sources.store import TableStore

    before, setting = shuffle_files(spark), spark.conf.get(scale.SHUFFLE_CLEANUP)
    counts = spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count().repartitionByRange(3, "k")
    staged, stored = scale.stage(counts), TableStore(spark, str(tmp_path)).save("t", counts)
    until = time.monotonic() + 10
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(scale.SHUFFLE_CLEANUP) == setting
    # A frame that was staged can be read again, as its shuffles are made anew.
    assert staged.count() == stored.count() == counts.count() == 70


def test_steps_on_the_way_are_deleted(spark):
    def build():
        step = scale.stage(spark.range(6))
        kept = scale.stage(step.groupBy("id").count())
        return kept.filter("id > 0"), scale.stage(step.join(kept, "id"))

    with scale.staging(spark) as paths:
        some, joined = scale.without_steps(spark, build)
        assert len(paths) == 3 and (some.count(), joined.count()) == (5, 6)
        left = [os.path.exists(p.removeprefix("file:")) for p in paths]
        assert left == [False, True, True]
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_a_side_of_many_keys_is_not_broadcast(spark, tmp_path, monkeypatch):
    from userprism.plans import samples

    spark.range(1000).withColumnRenamed("id", "k").selectExpr("k", "k % 7 AS x").write.parquet(str(tmp_path / "t"))
    side, rows = spark.read.parquet(str(tmp_path / "t")), spark.range(5000).withColumnRenamed("id", "k")

    def joins(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [j for j in ("BroadcastHashJoin", "SortMergeJoin") if j in plan]

    few, many = (rows.join(scale.join_side(side, "k", limit), "k") for limit in (1000 * 24, 1000 * 24 - 1))
    assert joins(few) == ["BroadcastHashJoin"] and joins(many) == ["SortMergeJoin"] and bag(few) == bag(many)
    # However few columns are left of it.
    monkeypatch.setattr(scale, "fits_broadcast", lambda table, limit: False)
    for log in (samples.positions, samples.attribution):
        assert joins(log(spark, "/root/testdata/sf0.001").select("user_id")) == ["SortMergeJoin"]
