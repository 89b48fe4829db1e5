import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import bag, by_key
from userprism.operators import assemble, correlation, explore, features, idsets, metrics, split


@pytest.fixture(scope="module")
def logs(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "user_id long")

    return dict(
        positions=ids(1, 1, 1, 2, 3, 4, None), deposits=ids(1, 2, 9, None),
        events=ids(2, 3, 9, 9), attribution=ids(1, 2, 3, 4, 5),
    )


def test_set_operations(logs):
    pos, dep = logs["positions"], logs["deposits"]
    assert bag(idsets.id_intersection(pos, dep)) == [(1,), (2,)]
    assert bag(idsets.id_difference(pos, dep)) == [(3,), (4,)]
    assert bag(idsets.distinct_ids(pos)) == [(1,), (2,), (3,), (4,)]


def test_overlap(logs):
    expected = {
        "inter_pos_dep": {1, 2}, "dif_pos_dep": {3, 4}, "dif_dep_pos": {9}, "inter_dep_ev": {2, 9},
        "inter_pos_no_dep_events": {3}, "inter_pos_events": {2, 3}, "inter_pos_attr": {1, 2, 3, 4},
    }
    assert dict(bag(idsets.overlap_report(**logs))) == {n: len(s) for n, s in expected.items()}
    found = {}
    for name, user in bag(idsets.overlap_sets(**logs)):
        found.setdefault(name, set()).add(user)
    assert found == expected


def test_outliers_and_summary(spark):
    counts = [1] * 50 + [2] * 48 + [100, 1000]
    rows = spark.createDataFrame([(u, n) for u, n in enumerate(counts)], "user_id long, n int")
    rows = rows.select("user_id", F.explode(F.sequence(F.lit(1), "n")))
    high, rest = idsets.split_outliers(rows)
    assert bag(high) == [(99, 1000)] and rest.count() == 99
    row = explore.count_summary(features.rows_per_key(rows)).first()
    assert (row["mean"], row["median"], row["q10"], row["max"], row["keys"]) == (12.46, 1.5, 1.0, 1000, 100)
    assert row["q99"] == pytest.approx(109.0)
    assert bag(idsets.without_ids(rows.select("user_id").distinct(), high))[-1] == (98,)
    assert bag(idsets.with_ids(features.rows_per_key(rows), high.union(high))) == [(99, 1000)]
    left = idsets.outer_indicator(features.rows_per_key(rows), rest)
    assert bag(left) == [(99, 1000, "left_only", 1)]


def test_outer_indicator_counts_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "l"), (3, "l")], "k long, t string")
    b = spark.createDataFrame([(1, None), (1, None), (1, None), (4, "r")], "k long, t string")
    assert bag(idsets.outer_indicator(a, b, keep_both=True)) == [
        (1, None, "both", 6), (2, "x", "left_only", 1), (3, "l", "left_only", 2), (4, "r", "right_only", 1),
    ]


@pytest.fixture(scope="module")
def skewed_log(spark):
    """User 1 has a third of the rows and a deposit; a third of the categories is missing."""
    n = F.col("id")
    return spark.range(900).select(
        F.when(n % 3 == 0, 1).when(n % 50 == 1, None).otherwise(n % 20 + 2).cast("long").alias("user_id"),
        F.when(n % 3 != 1, n % 4).alias("c"),
        F.lit("only").alias("d"),
    )


def test_category_lift(spark, skewed_log):
    deposits = spark.createDataFrame([(1,), (1,), (5,), (77,)], "user_id long")
    rows = [(r.c, r.d, int(r.user_id in (1, 5))) for r in skewed_log.collect()]
    positive = sum(y for *_, y in rows)
    found = {
        (r.feature, r.value): r.lift
        for r in explore.category_lift(skewed_log, deposits, ["c", "d"]).collect()
    }
    expected = {}
    for i, name in ((0, "c"), (1, "d")):
        for v in {r[i] for r in rows} - {None}:
            hits = [r[2] for r in rows if r[i] == v]
            expected[name, str(v)] = sum(hits) / positive - (len(hits) - sum(hits)) / (900 - positive)
    assert found == pytest.approx(expected)
    balance = bag(explore.class_balance(skewed_log, deposits))
    assert sum(n for _, n, _ in balance) == 900 and balance[1] == (1, positive, 2)
    labelled = assemble.label_rows(skewed_log, deposits)
    assert labelled.agg(F.sum("made_depo")).first()[0] == positive and labelled.count() == 900


def test_lift_without_positives(spark, skewed_log):
    nobody = spark.createDataFrame([], "user_id long")
    lift = explore.category_lift(skewed_log, nobody, ["d"]).first()
    assert (lift.positive, lift.lift) == (0, -1.0)


def test_value_counts_and_top(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    assert [tuple(r) for r in explore.value_counts(df, "v").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert explore.top_rows(df.groupBy("v").count(), "count", 1).first()[0] == "b"
    found = explore.count_matching(df, {"bs": F.col("v") == "b", "gaps": F.col("v").isNull()})
    assert found.first() == (2, 1)


def test_describe(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, None), (4.0, 3), (10.0, None)], "x double, y int")
    found = by_key(explore.describe(df, ["x", "y"]), "feature")
    assert found["x"] == {
        "feature": "x", "count": 4, "mean": 4.25, "std": pytest.approx(4.031129), "min": 1.0,
        "q25": 1.75, "median": 3.0, "q75": 5.5, "max": 10.0,
    }
    assert found["y"]["count"] == 2 and found["y"]["median"] == 2.0


def test_merge_keeps_positions_users(spark):
    pos = spark.createDataFrame([(1, 5.0), (2, None)], "user_id long, p double")
    ev = spark.createDataFrame([(2, 7), (3, 8)], "user_id long, e long")
    attr = spark.createDataFrame([(1, 1)], "user_id long, a int")
    assert bag(assemble.merge_features(pos, ev, attr)) == [(1, 5.0, 0, 1), (2, 0.0, 7, 0)]
    assert bag(assemble.side_by_side(pos, ev)) == [(1, 5.0, None), (2, None, 7), (3, None, 8)]
    with pytest.raises(ValueError, match="both"):
        assemble.merge_features(pos, ev, ev)
    labelled = assemble.label_users(pos, spark.createDataFrame([(2,), (2,), (3,)], "user_id long"))
    assert bag(labelled, "user_id", "target") == [(1, 0), (2, 1)]


def test_correlation(spark):
    rows = [(i, float(i), -float(i), 5.0, float(i % 2), int(i > 4)) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id long, up double, down double, same double, `a.b` double, target int")
    found = {r.feature: r.correlation for r in correlation.target_correlation(df, ["up", "down", "same", "a.b"]).collect()}
    assert found["same"] is None
    assert found["up"] == pytest.approx(-found["down"]) and found["up"] > 0.8
    assert correlation.select_by_correlation(df) == ["up", "down"]
    assert correlation.select_by_correlation(df, threshold=found["up"]) == []
    matrix = {(r.feature, r.other): r.correlation for r in correlation.correlation_matrix(df, ["up", "down", "same"]).collect()}
    assert matrix["up", "down"] == pytest.approx(-1) and matrix["up", "same"] is None


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_matches_pair_counting(spark):
    rows = [((i * 37 % 101) / 10 if i % 3 else 5.0, int(i * 7 % 10 > 6 - i % 4), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "score double, target int, g int").repartition(6)
    found = metrics.rank_auc(df, "score", digits=12).first()
    assert found.auc == pytest.approx(brute_auc([r[:2] for r in rows]))
    for r in metrics.rank_auc(df, "score", digits=12, group=["g"]).collect():
        assert r.auc == pytest.approx(brute_auc([x[:2] for x in rows if x[2] == r.g]))
    assert metrics.rank_auc(df.filter("target = 1"), "score").first().auc is None


def test_split_is_stable_and_sized(spark):
    users = spark.range(5000).withColumnRenamed("id", "user_id")
    train, test = split.hash_split(users)
    again = split.hash_split(users.repartition(13))[1]
    assert bag(test) == bag(again) and train.count() + test.count() == 5000
    assert 900 < test.count() < 1100
    rest, valid = split.hash_split(train, 0.1, part="valid")
    assert 340 < valid.count() < 460 and rest.count() + valid.count() == train.count()
    folds = users.select(split.fold_column(F.col("user_id"), 4, 42).alias("f")).groupBy("f").count()
    sizes = dict(bag(folds))
    assert set(sizes) == {0, 1, 2, 3} and min(sizes.values()) > 1100
    assert split.hash_split(users, 1.0)[0].isEmpty()


def test_label_correlations_of_many_tasks(spark):
    rng = np.random.default_rng(1)
    x = rng.random((200, 3)) + [0, 1e6, 0]
    rows = [(float(a), float(b), None if i % 7 == 0 else float(c), 0.1, None, float("nan") if i == 3 else 1.0 * i, i % 3 == 0)
            for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, far double, gaps double, same double, none double, nan double, target boolean")
    names = ["a", "far", "gaps", "same", "none", "nan"]
    y = np.arange(200) % 3 == 0
    there = np.arange(200) % 7 != 0
    want = {"a": np.corrcoef(x[:, 0], y)[0, 1], "far": np.corrcoef(x[:, 1], y)[0, 1], "gaps": np.corrcoef(x[there, 2], y[there])[0, 1]}
    for parts in (1, 7, 40):
        df_parts = df.repartition(parts)
        found = {r.feature: r.correlation for r in correlation.target_correlation(df_parts, names).collect()}
        assert list(sorted(found)) == sorted(names) and found["same"] is None and found["none"] is None and np.isnan(found["nan"])
        assert {n: found[n] for n in want} == pytest.approx(want)
    # A batch's rows are folded in its task: a feature has a row a task.
    assert "MapInArrow" in correlation.target_correlation(df, names)._jdf.queryExecution().executedPlan().toString()
    assert correlation.target_correlation(df.limit(0), names).count() == 0
