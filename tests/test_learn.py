import os
import threading

import pytest
from pyspark.sql import functions as F

from userprism.operators import learn, selection, split
from userprism.sources.store import TableStore

FEATURES = ["signal", "weak", "noise1", "noise.2", "noise3"]


@pytest.fixture(scope="module")
def table(spark):
    """A label planted on one feature, with some noise."""
    noise = lambda salt: (F.pmod(F.xxhash64("user_id", F.lit(salt)), F.lit(1000)) / 1000)
    base = spark.range(1500).withColumnRenamed("id", "user_id")
    return base.select(
        "user_id",
        noise(1).alias("signal"), noise(2).alias("weak"), noise(3).alias("noise1"),
        noise(4).alias("noise.2"), noise(5).alias("noise3"),
    ).withColumn("target", ((F.col("signal") + F.col("weak") * 0.3 + noise(6) * 0.2) > 0.9).cast("int")).persist()


@pytest.fixture(scope="module")
def parts(table):
    train, test = split.hash_split(table)
    return learn.to_vectors(train, FEATURES).persist(), learn.to_vectors(test, FEATURES).persist()


def test_tree_scores_hard_labels_and_importance(spark, parts, tmp_path):
    train, test = parts
    model = learn.fit_tree(train, max_depth=5)
    row = learn.evaluate(model, test).first()
    assert row.auc > 0.85
    found = {r.feature: r.importance for r in learn.importances(spark, model, FEATURES).collect()}
    assert max(found, key=found.get) == "signal" and set(found) == set(FEATURES)
    store = TableStore(spark, str(tmp_path))
    store.save_model("tree", model)
    assert learn.evaluate(store.load_model("tree"), test).first() == row


def test_boosting_scores_probabilities(parts):
    train, test = parts
    model = learn.fit_boosted(train, rounds=8, maxDepth=3, stepSize=0.2)
    assert learn.evaluate(model, test, use_probability=True).first().auc > 0.92
    by_round = {r["round"]: r["auc"] for r in learn.auc_by_round(model, test).collect()}
    assert set(by_round) == set(range(1, len(model.trees) + 1))
    last = learn.evaluate(model, test, use_probability=True).first().auc
    assert by_round[len(model.trees)] == pytest.approx(last, abs=1e-4)


def test_boosting_is_cut_at_the_best_round(parts):
    model = learn.fit_boosted_on_auc(parts[0], rounds=5, patience=2, maxDepth=2)
    assert 1 <= len(model.trees) <= 5
    assert learn.best_round([(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.65), (5, 0.9)], patience=2) == 2
    assert learn.best_round([(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.65), (5, 0.9)], patience=5) == 5
    assert learn.best_round([(1, 0.7), (2, 0.7)], patience=5) == 1


def test_setting_names():
    assert learn.spark_settings({"learning_rate": 0.1, "num_leaves": 12, "colsample_bytree": 0.65}) == {
        "stepSize": 0.1, "maxDepth": 4, "featureSubsetStrategy": "0.65",
    }
    assert learn.spark_settings({"n_estimators": 200, "max_depth": None}, forest=True) == {
        "numTrees": 200, "maxDepth": 30,
    }
    with pytest.raises(ValueError):
        learn.spark_settings({"lambda_l1": 5})
    assert len(learn.combinations(learn.BOOSTED_GRID)) == 288
    draws = learn.sample_combinations(learn.FOREST_SPACE, 100)
    assert len(draws) == 100 and draws == learn.sample_combinations(learn.FOREST_SPACE, 100)


def test_searches(parts):
    train, test = parts
    model, best, scores = learn.grid_search(
        train, {"learning_rate": [0.1], "n_estimators": [1, 4], "num_leaves": [4]}, folds=2
    )
    assert scores.count() == 2 and scores.filter("best").count() == 1
    assert best["maxDepth"] == 2 and learn.evaluate(model, test, use_probability=True).first().auc > 0.7
    space = {"n_estimators": [3, 5], "max_depth": [2, 4], "bootstrap": [True, False], "max_features": ["sqrt"]}
    model, best, scores = learn.random_search(train, space, draws=2, folds=2)
    assert scores.count() == 2 and learn.evaluate(model, test, use_probability=True).first().auc > 0.7


def test_elimination(table):
    train, test = split.hash_split(table, 0.3, seed=0)
    path = selection.elimination_path(train, FEATURES, 1, test=test, max_depth=4)
    assert [len(s.features) for s in path] == [5, 4, 3, 2, 1]
    assert all(set(b.features) < set(a.features) for a, b in zip(path, path[1:]))
    assert path[-1].features == ("signal",) and all(s.accuracy > 0.7 for s in path)
    assert selection.select_by_elimination(train, FEATURES, optimal=2, step=0.5, max_depth=4)[0] == "signal"
    best = selection.select_by_elimination(
        train, FEATURES, find_optimal=True, start=1, upto=4, test=test, max_depth=4
    )
    assert "signal" in best and len(best) <= 3


def test_best_size_prefers_fewer_features_on_a_tie():
    steps = [selection.Step(("a", "b"), 0.9), selection.Step(("a",), 0.9), selection.Step(("b",), None)]
    assert selection.best_size(steps).features == ("a",)


def test_model_queries_do_the_whole_job(spark, monkeypatch):
    from userprism.plans.queries import assembly, models

    sf_dir = "/root/testdata/sf0.001"
    table = models.model_table(spark, sf_dir).persist()
    assert table.columns == assembly.full_table(spark, sf_dir).columns and len(table.columns) > 200
    monkeypatch.setattr(models, "model_table", lambda *_: table)

    searches = []
    for name in ("search_boosted", "search_forests"):
        monkeypatch.setattr(learn, name, lambda train, candidates, folds, *_: searches.append((len(candidates), folds)) or [None] * 3)
    models.grid_search(spark, sf_dir)
    models.random_search(spark, sf_dir)
    assert searches == [(144, 4), (100, 3)]

    found = {r.feature: r.correlation for r in models.target_corr_merged(spark, sf_dir).collect()}
    assert sorted(found) == sorted(learn.feature_columns(table))
    kept = {r.feature for r in models.corr_filter_merged(spark, sf_dir).collect()}
    assert kept == {f for f, r in found.items() if r is not None and abs(r) > 0.2}

    paths = []
    monkeypatch.setattr(selection, "elimination_path", lambda train, features, smallest, step=1, sizes=None, **options: paths.append(
        (len(features), smallest, step, sizes, options.get("max_depth"))) or [selection.Step(tuple(features), 1.0)])
    models.rfe_path(spark, sf_dir)
    models.optimal_features(spark, sf_dir)
    n = len(found)
    assert paths == [(n, 30, 1, None, None), (n, 10, 1, set(range(10, 60)), None)]


def test_vectors_hold_the_training_table_without_value_lists(spark, monkeypatch):
    from userprism.operators import features
    from userprism.plans.queries import assembly

    sf_dir = "/root/testdata/sf0.001"
    dense = {r.user_id: r.asDict() for r in assembly.full_table(spark, sf_dir).collect()}

    def discover(df, columns, limit=None):
        assert not columns, "category values on the driver"
        return {}

    monkeypatch.setattr(features, "discover_values", discover)
    vectors, names = assembly.full_vectors(spark, sf_dir)
    of = {r["index"]: r.name for r in names.collect()}
    rows = vectors.collect()
    assert len(rows) == len(dense) and len(of) > 150
    for row in rows:
        got = {of[int(i)]: v for i, v in zip(row.features.indices, row.features.values)}
        want = {k: v for k, v in dense[row.user_id].items() if k not in ("user_id", "target") and v}
        assert got == pytest.approx(want) and row.target == dense[row.user_id]["target"]


def test_affiliates_without_number_are_no_columns(spark):
    from userprism.plans.queries import assembly
    from userprism.plans import samples, training

    sf_dir, n = "/root/testdata/sf0.001", 20_000
    attribution = spark.range(n).selectExpr(
        "id % 50 AS user_id", "9L AS client_platform_id", "1D AS country_id", "'d' AS device", "id AS aff_id", "'m' AS media_source"
    )
    logs = samples.deposits(spark, sf_dir), samples.positions(spark, sf_dir), attribution, samples.events(spark, sf_dir)
    vectors, names = training.training_vectors(*logs, min_count=0, instruments=assembly.BRANDS)
    assert names.filter("name LIKE 'amount_of_clicks_per_aff_%'").count() == n
    assert vectors.count() == samples.positions(spark, sf_dir).select("user_id").distinct().count()


def test_a_fit_has_no_more_partitions_than_cores(spark, parts, monkeypatch):
    monkeypatch.setattr(learn, "FIT_BYTES", 64)
    cores = spark.sparkContext.defaultParallelism
    with learn.prepared(*parts) as held:
        for part, given in zip(held, parts):
            assert part.rdd.getNumPartitions() == cores and part.count() == given.count()
    assert learn.fit_partitions(64 * (cores - 1), cores) == cores - 1 and learn.fit_partitions(0, cores) == 1


def test_elimination_fits_ahead_on_free_cores(table, monkeypatch):
    """Fits of one partition run side by side, and the path is that of one fit after the other."""
    train, test = split.hash_split(table, 0.3, seed=0)
    plain, lock, now, most = selection.DecisionTreeClassifier.fit, threading.Lock(), [0], [0]

    def fit(self, df):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return plain(self, df)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(selection.DecisionTreeClassifier, "fit", fit)
    ahead = selection.elimination_path(train, FEATURES, 1, test=test, max_depth=6)
    assert most[0] > 1
    # Sets that a dropped feature makes useless change nothing, also when importances are no guide.
    order = selection._drops
    monkeypatch.setattr(selection, "_drops", lambda left, weight, *rest: (
        (s, d) for i, (s, d) in enumerate(order(left, weight, *rest)) if i == 0))
    assert selection.elimination_path(train, FEATURES, 1, test=test, max_depth=6) == ahead
    assert [len(s.features) for s in ahead] == [5, 4, 3, 2, 1]


def test_a_small_table_has_a_copy_on_each_executor(parts, monkeypatch):
    assert learn.fit_copies(1, 12, 3) == 3 and learn.fit_copies(6, 12, 3) == 2 and learn.fit_copies(12, 12, 3) == 1
    assert learn.fit_copies(1, 400, 100) == learn.COPIES and learn.fit_copies(16, 8, 2) == 1
    with learn.prepared(parts[0]) as (held,):
        assert held.storageLevel.replication == 1  # a local session is one executor
    monkeypatch.setattr(learn, "executors", lambda spark: 3)
    with learn.prepared(parts[0]) as (held,):
        assert held.storageLevel.replication == 3 and held.count() == parts[0].count()


def test_forests_that_keep_nodes_are_the_same(parts, monkeypatch):
    space = {"n_estimators": [2, 5], "max_depth": [3, None], "bootstrap": [True, False]}
    kept, plain = [], learn.RandomForestClassifier
    monkeypatch.setattr(learn, "RandomForestClassifier", lambda **given: kept.append(given.get("cacheNodeIds")) or plain(**given))

    def found():
        kept.clear()
        model, best, table = learn.random_search(parts[0], space, draws=8, folds=2)
        return str(model.toDebugString).partition("\n")[2], best, [tuple(r) for r in table.orderBy("candidate").collect()]

    with_nodes = found()
    assert any(kept) and not learn.keeps_nodes(10**6, 2000, 12) and learn.keeps_nodes(8000, 2000, 1)
    monkeypatch.setattr(learn, "NODE_BYTES", 0)
    assert found() == with_nodes and not any(kept)


def test_training_vectors_leave_no_steps_and_are_written_once(spark):
    from userprism.operators import scale
    from userprism.plans.queries import models

    with scale.staging(spark) as paths:
        names, train, test = models.model_parts(spark, "/root/testdata/sf0.001")
        left = [p for p in paths if os.path.exists(p.removeprefix("file:"))]
        assert len(left) == 2  # the vectors and their names
        assert train.count() + test.count() == 150 and train.first().features.size == names.count()


def test_a_single_fit_writes_nothing_anew(spark, parts, tmp_path, monkeypatch):
    frame, kept = type(parts[0]), []
    plain = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, level: kept.append((self, level)) or plain(self, level))
    learn.fit_tree(parts[0], max_depth=2)
    learn.fit_boosted_on_auc(parts[0], rounds=1, maxDepth=1)
    assert len(kept) == 3 and not any(level.useDisk for _, level in kept)
    # Files of a table are put together; few of them are dealt anew.
    path = str(tmp_path / "many")
    parts[0].repartition(2 * learn.FILES).write.parquet(path)
    many = spark.read.schema(parts[0].schema).parquet(path)
    monkeypatch.setattr(learn, "fit_partitions", lambda size, cores: 2)
    with learn.prepared(many, parts[0]) as (together, dealt):
        plans = [df._jdf.queryExecution().analyzed().toString() for df in (kept[-2][0], kept[-1][0])]
        assert together.rdd.getNumPartitions() == dealt.rdd.getNumPartitions() == 2
        assert together.count() == dealt.count() == parts[0].count()
    assert "Repartition 2, false" in plans[0] and "Repartition 2, true" in plans[1]


def test_dense_tables_are_staged_whole_and_once(spark):
    from userprism.operators import scale
    from userprism.plans.queries import models, wide

    def left(paths):
        return sum(os.path.exists(p.removeprefix("file:")) for p in paths)

    sf_dir = "/root/testdata/sf0.001"
    with scale.staging(spark) as paths:
        names, train, test = wide.planted_parts(spark, sf_dir)
        assert left(paths) == 1 and train.count() + test.count() == 150 and train.first().features.size == len(names)
        assert models.model_table(spark, sf_dir).count() == 150 and left(paths) == 2
        assert models.save_load(spark, sf_dir).count() > 140 and left(paths) == 2  # its table is in the store alone
