"""Tree models, searches, feature elimination and correlations on the merged table. These have no SQL.

Rounds, depths, folds, steps, sizes, thresholds and candidate lists are the operators' own.
"""

import uuid
from functools import partial

from pyspark.sql import functions as F

from ...operators import correlation, explore, idsets, learn, scale, selection, split
from ...sources.store import TableStore
from .. import samples, training
from .assembly import full_table, full_vectors
from .registry import query

# The part of the grid that ``gbt_tuned_auc`` searches; ``grid_search`` takes all of it.
TUNED_GRID = {k: learn.BOOSTED_GRID[k] for k in ("n_estimators", "num_leaves", "subsample")}


def model_table(spark, sf_dir):
    """The labelled merged table of all features, staged: each fit reads it many times."""
    return scale.without_steps(spark, lambda: scale.stage(passing_table(spark, sf_dir)))


def passing_table(spark, sf_dir):
    """The labelled merged table of all features for one pass over it: neither it nor its parts are written."""
    return full_table(spark, sf_dir, partial(training.training_table, staged=False), samples.likely_deposits)


def model_parts(spark, sf_dir):
    """The table of feature names, and sparse vectors of the train and the test users."""
    vectors, names = full_vectors(spark, sf_dir, samples.likely_deposits)
    return names, *split.hash_split(vectors)


@query("tree_importance")
def tree_importance(spark, sf_dir):
    names, train, _ = model_parts(spark, sf_dir)
    model = learn.fit_tree(train)
    return explore.top_rows(
        learn.importances(spark, model, [r.name for r in names.orderBy("index").collect()]), "importance", 20, ties=("feature",)
    )


@query("tree_auc")
def tree_auc(spark, sf_dir):
    _, train, test = model_parts(spark, sf_dir)
    return learn.evaluate(learn.fit_tree(train), test)


def boosted(train, **settings):
    """The boosted model's own settings, then those of a search, cut at the best held-out AUC."""
    base = learn.spark_settings(learn.BOOSTED_BASE, rows=train.count())
    return learn.fit_boosted_on_auc(train, **{**base, **settings})


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    _, train, test = model_parts(spark, sf_dir)
    scored = boosted(train).transform(test)
    return scored.select("user_id", "target", learn.probability(scored).alias("score"))


@query("gbt_auc")
def gbt_auc(spark, sf_dir):
    _, train, test = model_parts(spark, sf_dir)
    return learn.evaluate(boosted(train), test, use_probability=True)


@query("gbt_auc_rounds")
def gbt_auc_rounds(spark, sf_dir):
    """AUC after each round of a fit that stops when its held-out loss rises."""
    _, train, test = model_parts(spark, sf_dir)
    base = learn.spark_settings(learn.BOOSTED_BASE, rows=train.count())
    return learn.auc_by_round(learn.fit_boosted(train, tolerance=0.0, **base), test)


@query("gbt_selected_auc")
def gbt_selected_auc(spark, sf_dir):
    """The boosted model on the features that correlate with the train users' label."""
    _, *logs = samples.logs(spark, sf_dir)
    learns = ~split.in_fraction(F.col("user_id"), 0.2, 42)
    vectors, _ = training.selected_vectors(
        samples.likely_deposits(spark, sf_dir), *logs, learns=learns, instruments=samples.BRANDS
    )
    train, test = split.hash_split(vectors)
    return learn.evaluate(boosted(train), test, use_probability=True)


@query("grid_search")
def grid_search(spark, sf_dir):
    """Every combination of ``BOOSTED_GRID`` that differs on Spark: 144 candidates, 4 folds."""
    _, train, _ = model_parts(spark, sf_dir)
    return learn.grid_search(train, base=learn.BOOSTED_BASE)[2]


@query("gbt_tuned_auc")
def gbt_tuned_auc(spark, sf_dir):
    """A search over depth and rows, whose best settings enter the final fit."""
    _, train, test = model_parts(spark, sf_dir)
    model, _ = learn.fit_tuned(train, TUNED_GRID, base=learn.BOOSTED_BASE)
    return learn.evaluate(model, test, use_probability=True)


@query("random_search")
def random_search(spark, sf_dir):
    """100 draws from ``FOREST_SPACE``, 3 folds, forests of 200 to 2000 trees."""
    _, train, _ = model_parts(spark, sf_dir)
    return learn.random_search(train)[2]


@query("rfe_path")
def rfe_path(spark, sf_dir):
    """One feature less a fit, down to 30."""
    table = model_table(spark, sf_dir)
    train, test = split.hash_split(table)
    path = selection.elimination_path(train, learn.feature_columns(table), 30, test=test)
    rows = [(len(s.features), f, s.accuracy) for s in path for f in s.features]
    return spark.createDataFrame(rows, "size int, feature string, accuracy double")


@query("optimal_features")
def optimal_features(spark, sf_dir):
    """The best of all sizes from 10 to 59, by steps of one feature."""
    table = model_table(spark, sf_dir)
    train, test = split.hash_split(table, 0.3, seed=0)
    kept = selection.select_by_elimination(train, learn.feature_columns(table), find_optimal=True, test=test)
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept)], "position int, feature string")


@query("target_corr_merged")
def target_corr_merged(spark, sf_dir):
    """All features; ``target_corr`` and its siblings show six columns, as their SQL does."""
    table = passing_table(spark, sf_dir)
    return correlation.target_correlation(table, learn.feature_columns(table))


@query("corr_filter_merged")
def corr_filter_merged(spark, sf_dir):
    kept = correlation.select_by_correlation(passing_table(spark, sf_dir))
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query("corr_matrix_merged")
def corr_matrix_merged(spark, sf_dir):
    """Every pair of the merged table's features, from strips of the long form."""
    _, positions, attribution, events = samples.logs(spark, sf_dir)
    return correlation.wide_correlation_matrix(
        *training.long_rows(positions, attribution, events, instruments=samples.BRANDS)
    )


@query("save_load")
def save_load(spark, sf_dir):
    """Features, names, ids and a model written to a store and read back."""
    store = TableStore(spark, f"{scale.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    table = scale.without_steps(spark, lambda: store.save("merged", passing_table(spark, sf_dir)))
    names = learn.feature_columns(table)
    store.save_selected("rfe", names)
    store.save_ids("outliers", idsets.split_outliers(samples.positions(spark, sf_dir))[0])
    store.save_model("tree", learn.fit_tree(learn.to_vectors(table, names)))
    kept = idsets.without_ids(store.load("merged"), store.load("outliers"))
    vectors = learn.to_vectors(kept, store.selected_features("rfe"))
    return store.load_model("tree").transform(vectors).select("user_id", "target", "prediction")
