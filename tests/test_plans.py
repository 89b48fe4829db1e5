"""The shape of the physical plans: what is shuffled, scanned and joined."""

import re

import pytest
from pyspark.sql import functions as F

from userprism.operators import cleaning, explore, features as ft, idsets, scale
from userprism.plans import samples

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_shuffle_per_aggregate_and_none_for_the_joins(events, no_broadcast):
    spec = ft.FeatureSpec(
        rows="n", parts=(ft.Stats(("value",), ("mean", "max", "median", "q10")), ft.CountBy("event_type")),
    )
    text = plan(ft.build_features(events, spec))
    # Simple statistics share the counts' aggregate; only the percentiles have their own.
    assert exchanges(text) == 2 and text.count("SortMergeJoin") == 1
    assert "partial_count" in text and "partial_avg" in text and "partial_percentile" in text


def test_scans_read_used_columns_only(events):
    text = plan(ft.build_features(events, ft.FeatureSpec(parts=(ft.CountBy("event_type", ("click",)),))))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["user_id:bigint,event_type:string"]
    assert "PushedFilters: [IsNotNull(user_id)]" in text


def test_mean_is_a_subquery_not_a_join(events):
    text = plan(cleaning.fill_mean(events.select("user_id", "value"), ["value"]))
    assert "Subquery" in text and "Join" not in text and "Window" not in text


def test_set_operations_fold_before_the_shuffle(events):
    for df in (idsets.id_intersection(events, events), idsets.id_difference(events, events)):
        text = plan(df)
        assert "Join" not in text and exchanges(text) == 1
        assert text.count("partial_max") == 2  # bool_or runs as max


def test_id_filters_stay_above_the_aggregate(events, no_broadcast):
    per_user = ft.rows_per_key(events)
    ids = events.filter("value > 100")
    for df in (idsets.without_ids(per_user, ids), idsets.with_ids(per_user, ids)):
        text = plan(df)
        assert text.index("SortMergeJoin") < text.index("HashAggregate")
        assert exchanges(text) == 2


def test_lift_joins_folded_rows(events, no_broadcast):
    text = plan(explore.labelled_folds(events, events.filter("value > 100"), ["event_type"]))
    join = text.index("SortMergeJoin")
    assert text.index("HashAggregate", join) > join
    assert "partial_count" in text[join:]


def test_prefix_sums_keep_no_unpartitioned_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), F.lit(1).alias("n"))
    text = plan(scale.prefix_sums(df, [], "v", "n"))
    # The only single-partition step sees one row per range partition.
    single = text.index("Exchange SinglePartition")
    assert "HashAggregate" in text[single : single + 400]


@pytest.mark.parametrize("name", ["category_lift", "training_table", "overlap_report", "outlier_users"])
def test_no_pairing_joins(spark, name):
    from userprism.plans.queries import QUERIES

    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_samples_repeat_lines_of_fifty(spark):
    found = samples.positions(spark, SF_DIR)
    assert found.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count() + found.filter(
        "count = 50"
    ).count() / 2


def test_repeats_of_a_key_meet_in_one_shuffle_by_key(spark):
    rows = [(i % 7, i % 3, None if i % 5 else "x") for i in range(300)] + [(None, 1, "x")] * 3
    df = spark.createDataFrame(rows, "user_id long, n int, text string")
    found = cleaning.drop_repeats(df, "user_id")
    text = plan(found)
    assert exchanges(text) == 1 and text.index("HashAggregate") < text.index("Exchange rangepartitioning(user_id")
    # No task looks for copies among all its input rows: both steps come after the shuffle.
    assert text.rindex("HashAggregate") < text.index("Exchange rangepartitioning")
    assert found.columns == df.columns and sorted(map(str, found.collect())) == sorted(map(str, df.distinct().collect()))


def test_pivots_spread_folds_of_their_own_keys_once_a_category(events, no_broadcast):
    values = tuple(range(100))
    rows = events.withColumn("v", F.pmod("event_id", F.lit(100)).cast("int"))
    text = plan(ft.pivot_counts(rows, "user_id", ft.CountBy("v", values)))
    assert exchanges(text) == 2
    assert text.rindex("pivotfirst") < text.index("Exchange hashpartitioning(user_id")
    found = ft.build_features(rows, ft.FeatureSpec(parts=(ft.CountBy("v", values), ft.FlagBy("v", values))))
    assert plan(found).count("partial_pivotfirst") == len(re.findall("partial_pivotfirst", text))
    some = found.filter("v_7_count > 0 OR v_8_count > 0")
    assert some.filter("uses_v_7 <> CAST(v_7_count > 0 AS INT) OR uses_v_8 <> CAST(v_8_count > 0 AS INT)").isEmpty()
    assert some.agg(F.sum("v_7_count")).first()[0] == rows.filter("v = 7 AND user_id IS NOT NULL").count()


def test_outliers_and_their_table_read_positions_once(spark):
    from userprism.plans.queries import QUERIES

    text = plan(QUERIES["exclude_outliers"](spark, SF_DIR))
    assert "lineitem.parquet" not in text and text.count("/stage-") >= 2


def test_merged_table_of_one_pass_is_dealt_by_user_once_an_aggregate(spark, no_broadcast):
    from userprism.plans.queries import QUERIES, models

    table = models.passing_table(spark, SF_DIR)
    text = plan(table)
    # Three aggregates of positions, two of events, one of attribution and the labelled users.
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", text)) == exchanges(text) == 7
    # Tasks fold their users to moments: no row per user and feature is made.
    text = plan(QUERIES["target_corr_merged"](spark, SF_DIR))
    assert "Generate" not in text and text.index("hashpartitioning(feature") < text.index("MapInArrow")


def test_distinct_values_that_are_counted_anyway_need_no_fold(spark):
    rows = [(u, None if i % 3 == 0 else i % (u + 2), "ab"[i % 2]) for u in range(5) for i in range(u * 3)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "user_id long, n long, t string")
    spec = ft.FeatureSpec(parts=(ft.DistinctCount("n", "ns"), ft.CountBy("n"), ft.DistinctCount("t", "ts"), ft.FlagBy("t")))
    found = ft.build_features(df, spec)
    assert exchanges(plan(found)) == 1 and found.columns[-2:] == ["ns", "ts"]
    want = {u: (len({n for v, n, _ in rows if v == u} - {None}), len({t for v, _, t in rows if v == u} - {None})) for u in (1, 2, 3, 4, 9)}
    assert {r.user_id: (r.ns, r.ts) for r in found.collect()} == want
    # A caller's list of values may leave some out.
    some = ft.FeatureSpec(parts=(ft.DistinctCount("n", "ns"), ft.CountBy("n", (1,))))
    assert {r.user_id: r.ns for r in ft.build_features(df, some).collect()} == {u: n for u, (n, _) in want.items()}
