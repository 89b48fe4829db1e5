"""Wide categories without value lists, layouts for later logs, daily state, sketches, shared fits."""

import math
import os
import re

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from conftest import bag, by_key
from userprism.operators import correlation, daily, features as ft, learn, selection, sketches, sparse, split
from userprism.sources.store import TableStore

SPEC = ft.FeatureSpec(rows="n", parts=(
    ft.CountBy("c"), ft.CountBy("d", null_name="none"), ft.SumBy("x", "d"), ft.FlagBy("c"),
    ft.Stats(("x", "c"), ("mean", "q10", "median", "q90", "max", "min")), ft.DistinctCount("d", "kinds"),
    ft.CountWhere("big", "x > 100"),
))


@pytest.fixture(scope="module")
def rows(spark):
    """One user on a third of the rows, rows without a user, missing categories and numbers."""
    return spark.range(3000).selectExpr(
        "if(id % 50 = 0, null, if(id % 3 = 0, 1, 2 + id % 11)) AS user_id", "id % 4 AS day", "cast(id % 13 AS double) AS c",
        "if(id % 5 = 0, null, 'v' || id % 4) AS d", "if(id % 6 = 0, null, cast(id AS double) * 0.1) AS x",
    ).persist()


@pytest.fixture(scope="module")
def labels(rows):
    return rows.select("user_id").distinct().filter("user_id IS NOT NULL").withColumn("target", (F.col("user_id") % 2).cast("int")).persist()


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow") if n in plan]


def test_vectors_are_made_without_python(rows, monkeypatch):
    plans = []
    monkeypatch.setattr(sparse, "stage", lambda df, *schema: plans.append(python_nodes(df)) or stage(df, *schema))
    from userprism.operators.scale import stage
    vectors, names = sparse.sparse_features(rows, SPEC)
    assert len(plans) >= 3 and not any(plans)
    assert vectors.count() == 12 and vectors.first().features.size == names.count()


def test_later_rows_take_the_stored_layout(spark, rows, tmp_path):
    _, names = sparse.sparse_features(rows.filter("c < 5"), ft.FeatureSpec(parts=(ft.CountBy("c"),)))
    store = TableStore(spark, str(tmp_path))
    store.save("names", names)
    later = spark.createDataFrame([(1, 4.0), (1, 9.0), (1, 4.0), (2, 77.0), (None, 3.0)], "user_id long, c double")
    long = sparse.long_features(later, ft.FeatureSpec(parts=(ft.CountBy("c"),)))
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    found, kept = sparse.vectors(long, "user_id", users, store.load("names"))
    of = {r["index"]: r.name for r in kept.collect()}
    got = {r.user_id: {of[int(i)]: v for i, v in zip(r.features.indices, r.features.values)} for r in found.collect()}
    assert got == {1: {"c_4_count": 2.0}, 2: {}, 3: {}}
    assert {r.features.size for r in found.collect()} == {5}


def test_scoring_buckets_values_as_the_training_log_did(spark, tmp_path):
    from userprism.plans import attribution, training

    def clicks(rows):
        full = [(u, 9, 1.0, "d", a, "m") for u, a in rows]
        return spark.createDataFrame(
            full, "user_id long, client_platform_id long, country_id double, device string, aff_id long, media_source string"
        )

    store = TableStore(spark, str(tmp_path))
    first = clicks([(1, 5)] * 3 + [(2, 6)])
    rows, spec = attribution.attribution_rows(first, min_count=2)
    training.save_layout(store, sparse.sparse_features(rows, spec)[1], first, min_count=2)
    later, _ = attribution.attribution_rows(clicks([(7, 6)] * 9 + [(8, 5), (9, 4)]), frequent=store.load("layout_frequent"))
    assert bag(later, "user_id", "aff_id") == sorted([(7, 99999)] * 9 + [(8, 5), (9, 99999)], key=repr)


def test_correlations_from_cells_equal_the_dense_ones(rows, labels):
    dense = ft.build_features(rows, SPEC).join(labels, "user_id").na.fill(0)
    names = learn.feature_columns(dense)
    want = {r.feature: r.correlation for r in correlation.target_correlation(dense, names).collect()}
    long = sparse.long_features(rows, SPEC)
    got = {r.name: r.correlation for r in sparse.target_correlation(long, labels).collect()}
    assert set(got) <= set(want) and all(same(got[n], want[n]) or abs(got[n] - want[n]) < 1e-9 for n in got)
    kept = sorted(n for n, v in want.items() if v is not None and abs(v) > 0.2)
    chosen = sparse.select_names(sparse.target_correlation(long, labels), 0.2).orderBy("index").collect()
    assert [r.name for r in chosen] == kept and [r["index"] for r in chosen] == list(range(len(kept)))


def test_constant_features_and_labels_have_no_correlation(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", 2.0), (1, "b", 1.0)], "user_id long, name string, value double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "user_id long, target int")
    got = {r.name: r.correlation for r in sparse.target_correlation(long, labels).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)
    level = labels.withColumn("target", F.lit(1))
    assert all(r.correlation is None for r in sparse.target_correlation(long, level).collect())
    assert sparse.target_correlation(long.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("strip, held", [(256, 64), (8, 64), (8, 2)])
def test_matrix_by_strips_equals_the_dense_one(rows, labels, monkeypatch, strip, held):
    monkeypatch.setattr(correlation, "HELD", held)
    dense = ft.build_features(rows, SPEC).join(labels, "user_id").na.fill(0)
    long = sparse.long_features(rows, SPEC)
    names = [r.name for r in long.select("name").distinct().collect()]
    want = {(r.feature, r.other): r.correlation for r in correlation.correlation_matrix(dense, names).collect()}
    found = correlation.wide_correlation_matrix(long, labels, strip=strip).collect()
    assert len(found) == len(names) ** 2 == len(want)
    for r in found:
        a, b = r.correlation, want[r.feature, r.other]
        assert same(a, b) or abs(a - b) < 1e-9


@pytest.mark.parametrize("heavy_rows", [100_000, 60])
def test_state_of_days_equals_one_run(spark, rows, tmp_path, heavy_rows):
    kept = daily.DailyState(TableStore(spark, str(tmp_path)), "state", SPEC)
    for day in (2, 0, 3, 1):
        kept.add(day, rows.filter(F.col("day") == day))
    kept.add(1, rows.filter("day = 1"))  # a day added again replaces itself
    got, want = kept.features(heavy_rows=heavy_rows), ft.build_features(rows, SPEC)
    assert sorted(got.dtypes) == sorted(want.dtypes)
    got, want = by_key(got), by_key(want)
    assert set(got) == set(want)
    assert all(same(got[u][c], want[u][c]) for u in want for c in want[u])


def test_a_state_is_added_up_by_narrow_keys(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2.0, None), (1, "a", 2.0, 5.0), (1, None, 1.0, 1.0), (2, "b", None, None), (None, "a", 1.0, 1.0)],
        "user_id long, kind string, x double, y double",
    )
    spec = ft.FeatureSpec(rows="n", parts=(
        ft.Stats(("x", "y"), ("mean", "max", "median")), ft.CountWhere("big", "x > 1"), ft.CountBy("kind"),
        ft.SumBy("x", "kind"), ft.SumBy("x", "kind", name="again_{value}"), ft.SumBy("y", "kind"), ft.DistinctCount("kind", "kinds"),
    ))
    state = daily.day_state(rows, spec)
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert groups and all(keys.count(",") <= 2 for keys in groups)
    got, want = by_key(daily.features_from_state(state, spec)), by_key(ft.build_features(rows, spec))
    assert set(got) == set(want) == {1, 2}
    assert all(same(got[u][c], want[u][c]) for u in want for c in want[u])


def test_a_state_is_read_from_its_days_alone(spark, rows, tmp_path):
    from userprism.operators import scale

    kept = daily.DailyState(TableStore(spark, str(tmp_path)), "state", SPEC)
    with scale.staging(spark) as paths:
        for day in range(4):
            kept.add(day, rows.filter(F.col("day") == day))
        assert paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)  # a day's rows are not kept
        done = len(paths)
        found = kept.features()
        assert len(paths) == done + 1 and spark.read.parquet(paths[-1]).count() == 0  # the list of users with many entries
        plan = found._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange (\w+)\(([^)]*)", plan)
        assert {kind for kind, _ in dealt} <= {"hashpartitioning", "HashedRelationBroadcastMode"}
        assert all(keys.count("#") == 1 for kind, keys in dealt if kind == "hashpartitioning")  # by the user, nothing else


def test_state_without_rows(spark, rows):
    state = daily.day_state(rows.limit(0), SPEC)
    assert state.count() == 0 and daily.features_from_state(state, SPEC).count() == 0


def test_sketches_keep_their_stated_errors(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS user_id", "cast(pmod(xxhash64(id), 10000) AS double) AS x", "id % 20000 AS c", "id % 5 AS day")
    days = [sketches.sketch_user(rows.filter(F.col("day") == d), "user_id", ("x",), ("c",)) for d in range(5)]
    found = by_key(sketches.read_sketches(sketches.merge_sketches(days)))
    exact = by_key(rows.groupBy("user_id").agg(
        *[F.percentile("x", F.lit(p)).alias(s) for s, p in (("q10", 0.1), ("median", 0.5), ("q90", 0.9))], F.count_distinct("c").alias("n")
    ))
    for user, want in exact.items():
        for s in ("q10", "median", "q90"):  # x is uniform: its rank is its value
            assert abs(found[user][f"x_{s}"] - want[s]) / 10_000 < 2 * sketches.rank_error()
        assert abs(found[user]["c_distinct"] - want["n"]) / want["n"] < 5 * sketches.count_error()


def test_sketches_of_missing_values(spark):
    rows = spark.createDataFrame([(1, None, None), (None, 2.0, "a")], "user_id long, x double, c string")
    found = sketches.read_sketches(sketches.sketch_user(rows, "user_id", ("x",), ("c",))).collect()
    assert [tuple(r) for r in found] == [(1, None, None, None, 0)]


FEATURES = ["signal", "weak", "noise1", "noise.2", "noise3"]


@pytest.fixture(scope="module")
def planted(spark):
    noise = lambda salt: (F.pmod(F.xxhash64("user_id", F.lit(salt)), F.lit(1000)) / 1000)
    base = spark.range(900).withColumnRenamed("id", "user_id")
    return base.select("user_id", *[noise(i + 1).alias(n) for i, n in enumerate(FEATURES)]).withColumn(
        "target", ((F.col("signal") + F.col("weak") * 0.3 + noise(9) * 0.3) > 1.2).cast("int")
    ).persist()


@pytest.fixture(scope="module")
def vectors(planted):
    return learn.to_vectors(planted, FEATURES).persist()


def scores(model, df):
    return sorted((r.user_id, r.p) for r in model.transform(df).select("user_id", learn.probability(df).alias("p")).collect())


def test_first_rounds_are_the_shorter_fit(vectors, tmp_path, spark):
    settings = dict(labelCol="target", maxDepth=3, seed=7, subsamplingRate=0.8, featureSubsetStrategy="0.6")
    full, short = (GBTClassifier(maxIter=n, **settings).fit(vectors) for n in (8, 3))
    cut = learn.first_rounds(full, 3)
    assert scores(cut, vectors) == scores(short, vectors) and learn.first_rounds(full, 8) is full
    store = TableStore(spark, str(tmp_path))
    store.save_model("cut", cut)
    assert scores(store.load_model("cut"), vectors) == scores(short, vectors)
    assert bag(learn.importances(spark, cut, FEATURES)) == bag(learn.importances(spark, short, FEATURES))


def test_grid_shares_fits_and_trees_split(vectors):
    base = {"min_split_gain": 0.5, "min_child_samples": 5}
    grid = {"learning_rate": [0.1, 0.4], "n_estimators": [1, 3, 6], "num_leaves": [4, 8]}
    model, best, table = learn.grid_search(vectors, grid, folds=3, base=base)
    rows = table.collect()
    assert len(rows) == 12 and len({round(r.score, 6) for r in rows}) > 3 and sum(r.best for r in rows) == 1
    assert all(t.numNodes > 1 for t in model.trees) and model.getNumTrees == best["maxIter"]
    # One candidate, fitted by itself on each fold.
    settings = {**learn.spark_settings(base, rows=900), "stepSize": 0.4, "maxDepth": 2, "maxIter": 3}
    fold, alone = split.fold_column(F.col("user_id"), 3, 42), []
    with learn.prepared(vectors) as (held,):
        for f in range(3):
            fitted = GBTClassifier(labelCol="target", seed=42, **settings).fit(held.filter(fold != f))
            alone.append(fitted.transform(held.filter(fold == f)).agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0])
    mine = [r.score for r in rows if eval(r.settings) == {"stepSize": 0.4, "maxDepth": 2, "maxIter": 3}]
    assert mine == [pytest.approx(sum(alone) / 3)]


def test_tuned_fit_carries_the_best_settings(vectors):
    grid = {"learning_rate": [0.3], "n_estimators": [2, 4], "num_leaves": [4, 16]}
    model, table = learn.fit_tuned(vectors, grid, folds=2, base=learn.BOOSTED_BASE, rounds=6)
    best = eval(table.filter("best").first().settings)
    assert model.getMaxDepth() == best["maxDepth"] and model.getStepSize() == 0.3 and 1 <= model.getNumTrees <= 6
    with pytest.raises(ValueError):
        learn.spark_settings({"min_split_gain": 0.5})


def test_forests_add_up(vectors):
    assert learn.forest_parts([200, 600, 1000]) == [200, 400, 400]
    space = {"n_estimators": [2, 5, 9], "max_depth": [2, 6, 40, None], "max_features": ["auto", "sqrt"], "min_samples_leaf": [1, 4]}
    unique = learn.unique_settings(learn.combinations(space), forest=True)
    assert len(unique) == 3 * 3 * 2  # auto is sqrt, and 40 levels are Spark's 30
    model, best, table = learn.random_search(vectors, space, draws=11, folds=2)
    rows = table.collect()
    assert len(rows) == 11 and all(0.5 < r.score <= 1 for r in rows) and model.getNumTrees == best["numTrees"]
    # Forests that end above a limit by themselves are scored once for all such limits.
    flat = {"minInstancesPerNode": 150, "numTrees": 4}
    _, _, table = learn.search_forests(vectors, [{**flat, "maxDepth": d} for d in (1, 9, 20)], 2)
    shallow, deep, deeper = [r.score for r in table.orderBy("candidate").collect()]
    assert deep == deeper
    # The smallest count of a family is one forest by itself.
    settings = {"maxDepth": 2, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 1}
    _, _, table = learn.search_forests(vectors, [{**settings, "numTrees": n} for n in (3, 7)], 2)
    fold, alone = split.fold_column(F.col("user_id"), 2, 42), []
    with learn.prepared(vectors) as (held,):
        for f in range(2):
            forest = RandomForestClassifier(labelCol="target", seed=42, numTrees=3, **settings).fit(held.filter(fold != f))
            alone.append(forest.transform(held.filter(fold == f)).agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0])
    assert table.orderBy("candidate").first().score == pytest.approx(sum(alone) / 2)


@pytest.mark.parametrize("depth", [2, 5])
def test_skipped_fits_change_nothing(planted, monkeypatch, depth):
    names = ["target_twin", *FEATURES, "flat", "flat.2"]
    table = planted.withColumns({"target_twin": F.col("signal") * 2, "flat": F.lit(1.0), "flat.2": F.lit(0.0)})
    train, test = split.hash_split(table, 0.3, seed=0)
    fits = []
    plain = selection.DecisionTreeClassifier.fit
    monkeypatch.setattr(selection.DecisionTreeClassifier, "fit", lambda self, df: fits.append(1) or plain(self, df))
    quick = selection.elimination_path(train, names, 1, test=test, max_depth=depth)
    few = len(fits)
    slow = selection.elimination_path(train, names, 1, test=test, max_depth=depth, skip=False)
    assert quick == slow and few < len(fits) - few
