"""Tree classifiers on the training table."""

import math
import random
from contextlib import contextmanager
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from .metrics import rank_auc
from .scale import col, quoted
from .split import fold_column, in_fraction

# Spark's limit; the nearest to a tree without a depth limit.
MAX_DEPTH = 30
# Trees keep a 4-byte bin per row and feature; a task of a fit reads at least about this much of them.
FIT_BYTES = 16 * 1024 * 1024
# From so many files a partition on, files put together make partitions of about the same size.
FILES = 4
# Copies of a table whose fits run side by side: no more of them than a search runs at once.
COPIES = 16
# A forest keeps the node of each row in each tree, 4 bytes, while a partition of them is at most this.
NODE_BYTES = 128 * 1024 * 1024

# The boosted-tree search grid, in the names used below.
BOOSTED_GRID = {
    "learning_rate": [0.005, 0.01],
    "n_estimators": [8, 16, 24],
    "num_leaves": [6, 8, 12, 16],
    "max_bin": [255, 510],
    "colsample_bytree": [0.64, 0.65, 0.66],
    "subsample": [0.7, 0.75],
}

# Settings of the boosted model that the search leaves alone.
BOOSTED_BASE = {
    "learning_rate": 0.05, "num_leaves": 62, "max_depth": -1, "max_bin": 510, "min_split_gain": 0.5,
    "min_child_samples": 5, "colsample_bytree": 0.8,
}

# The random-forest search space. The smallest node that may still split has no
# Spark counterpart and is left out; the forest here is a classifier, as the label is 0 or 1.
FOREST_SPACE = {
    "n_estimators": list(range(200, 2001, 200)),
    "max_features": ["auto", "sqrt"],
    "max_depth": [*range(10, 111, 10), None],
    "min_samples_leaf": [1, 2, 4],
    "bootstrap": [True, False],
}

_NAMES = {
    "learning_rate": "stepSize",
    "n_estimators": "maxIter",
    "num_leaves": "maxDepth",
    "max_depth": "maxDepth",
    "max_bin": "maxBins",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "max_features": "featureSubsetStrategy",
    "min_split_gain": "minInfoGain",
    "min_child_samples": "minInstancesPerNode",
    "min_samples_leaf": "minInstancesPerNode",
    "bootstrap": "bootstrap",
    "random_state": "seed",
}


def spark_settings(params, forest=False, rows=None):
    """Common boosting and forest parameter names as Spark ML parameters.

    Leaf counts become the depth that can hold them. A least split gain is a sum over rows, where
    Spark compares impurity per row, so it is divided by the ``rows`` to fit on. Unknown names
    raise: Spark's boosting has no L1/L2 penalty and no dropout of trees.
    """
    settings = {}
    for name, value in params.items():
        if name not in _NAMES:
            raise ValueError(f"no Spark counterpart for {name}")
        target = "numTrees" if forest and name == "n_estimators" else _NAMES[name]
        if name == "num_leaves":
            value = max(1, math.ceil(math.log2(value)))
        elif name == "max_depth":
            value = MAX_DEPTH if value is None or value < 0 else min(value, MAX_DEPTH)
        elif name == "colsample_bytree":
            value = str(value)
        elif name == "min_split_gain":
            if not rows:
                raise ValueError("min_split_gain needs the number of rows")
            value = value / rows
        elif name == "max_features" and value == "auto":
            value = "sqrt"  # what it means for a forest of classifiers
        # Leaves and depth both limit the depth, in whatever order they come.
        settings[target] = min(value, settings.get(target, value)) if target == "maxDepth" else value
    return settings


def feature_columns(df, target="target", key="user_id"):
    return [c for c in df.columns if c not in (target, key)]


def to_vectors(df, features, target="target", key="user_id"):
    """(key, features vector, target as double): the input of every fit."""
    values = F.expr(f"array({', '.join(f'coalesce(CAST({quoted(f)} AS DOUBLE), 0D)' for f in features)})")
    return df.select(
        col(key), array_to_vector(values).alias("features"), col(target).cast("double").alias(target)
    )


def fit_partitions(size, cores):
    """Partitions of a fit on ``size`` bytes of bins: as many as there are cores, fewer for a small table.

    Each partition shuffles a histogram of every node, feature and bin, whatever its rows, so more of
    them would make a fit's shuffle grow with the table times its trees.
    """
    return max(1, min(-(-size // FIT_BYTES), cores))


def executors(spark):
    """Executors of the session now; a local session is its own."""
    return max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)


def fit_copies(partitions, cores, among):
    """Copies of a table that fits side by side read: one for each of the ``among`` executors, if cores stay free.

    A fit's tasks wait for a core of an executor that holds the table. One copy of a small table
    would keep all fits of a search on one executor.
    """
    return max(1, min(among, cores // partitions, COPIES))


def dealt(part, partitions):
    """``part`` in so many partitions. One of many files is not shuffled, as files are put together as well."""
    return part.coalesce(partitions) if len(part.inputFiles()) >= FILES * partitions else part.repartition(partitions)


@contextmanager
def prepared(*parts, disk=True):
    """The parts persisted in partitions sized for fits, which run a job per level of each tree.

    A task's overhead outweighs a small partition's work many times over there. A single fit keeps bins
    of its own and reads a part a few times only: without ``disk`` what memory does not hold is read
    where it came from, and is not written again.
    """
    held = []
    for part in parts:
        row = part.select(F.count(F.lit(1)).alias("n"), F.first("features").alias("v")).first()
        size = row.n * (row.v.size if row.v is not None else 0) * 4
        cores = part.sparkSession.sparkContext.defaultParallelism
        partitions = fit_partitions(size, cores)
        copies = fit_copies(partitions, cores, executors(part.sparkSession))
        held.append(dealt(part, partitions).persist(StorageLevel(disk, True, False, True, copies)))
    try:
        yield held
    finally:
        for part in held:
            part.unpersist()


def fit_tree(train, target="target", max_depth=MAX_DEPTH, seed=42, **settings):
    tree = DecisionTreeClassifier(**{"labelCol": target, "maxDepth": max_depth, "seed": seed, **settings})
    with prepared(train, disk=False) as (held,):
        return tree.fit(held)


def fit_boosted(train, target="target", key="user_id", rounds=100, valid_fraction=0.1,
                tolerance=0.01, seed=42, **settings):
    """Boosted trees that stop adding rounds when the held-out part no longer improves.

    ``settings`` in Spark's names win over the arguments, so a search's result fits as it is.
    """
    marked = train.withColumn("__valid", in_fraction(col(key), valid_fraction, seed, "valid"))
    given = {"labelCol": target, "maxIter": rounds, "seed": seed, "validationTol": tolerance}
    booster = GBTClassifier(**{**given, **settings, "validationIndicatorCol": "__valid"})
    with prepared(marked, disk=False) as (held,):
        return booster.fit(held)


def _margins(model, df, target):
    """(target, steps) with the weighted prediction of each tree of a boosted model, in order."""
    for i, tree in enumerate(model.trees):
        df = tree.setPredictionCol(f"__t{i}").transform(df)
    steps = ", ".join(f"{w!r}D * __t{i}" for i, w in enumerate(model.treeWeights))
    return df.select(col(target), F.expr(f"array({steps})").alias("steps"))


def auc_by_round(model, test, target="target", digits=6):
    """(round, auc) of a boosted model after each of its trees, from one pass over ``test``."""
    # One walk over the trees: each margin is the one before plus the tree's own.
    sums = (
        "aggregate(steps, CAST(array() AS array<double>),"
        " (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0D) + x)))"
    )
    margins = _margins(model, test, target).select(col(target), F.posexplode(F.expr(sums)).alias("round", "margin"))
    found = rank_auc(margins, "margin", target, digits, group=["round"])
    return found.select((F.col("round") + 1).alias("round"), "auc")


def first_rounds(model, rounds):
    """The boosted model of the first ``rounds`` trees: what a fit of so many rounds gives."""
    if rounds >= len(model.trees):
        return model
    gateway, trees, weights = SparkContext._active_spark_context._gateway, model._java_obj.trees(), model.treeWeights
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    kept_weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        kept[i], kept_weights[i] = trees[i], weights[i]
    build = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel
    cut = GBTClassificationModel(build(model.uid, kept, kept_weights))
    model._copyValues(cut)
    return cut


def accuracy_by_round(model, test, counts, target="target"):
    """Accuracy of a boosted model's first k trees for each k of ``counts``, from one pass over ``test``."""
    right = []
    for i, k in enumerate(counts):
        cut = first_rounds(model, k).copy().setRawPredictionCol("").setProbabilityCol("").setPredictionCol(f"__p{i}")
        test = cut.transform(test)
        right.append(F.avg((F.col(f"__p{i}") == col(target)).cast("double")).alias(f"k{i}"))
    return list(test.agg(*right).first())


def best_round(aucs, patience):
    """First round with the best AUC, looking no further than ``patience`` rounds without gain."""
    best, best_auc = 0, float("-inf")
    for number, auc in sorted(aucs):
        if auc > best_auc:
            best, best_auc = number, auc
        elif number - best >= patience:
            break
    return best


def fit_boosted_on_auc(train, target="target", key="user_id", rounds=100, patience=50,
                       valid_fraction=0.1, seed=42, **settings):
    """Boosted trees cut at the round with the best AUC on a held-out part of ``train``.

    One fit: the first k trees of a long fit are the fit of k rounds.
    """
    held_out = in_fraction(col(key), valid_fraction, seed, "valid")
    booster = GBTClassifier(**{"labelCol": target, "maxIter": rounds, "seed": seed, **settings})
    with prepared(train.filter(~held_out), train.filter(held_out), disk=False) as (fit_on, valid):
        full = booster.fit(fit_on)
        aucs = [(r["round"], r["auc"]) for r in auc_by_round(full, valid, target).collect()]
    return first_rounds(full, best_round([(n, a) for n, a in aucs if a is not None], patience) or len(full.trees))


def probability(df):
    """Probability of class 1 of a scored frame."""
    return vector_to_array(F.col("probability"))[1]


def evaluate(model, test, target="target", use_probability=False):
    """AUC of a fitted model as one row: on hard labels, or on probabilities."""
    scored = model.transform(test)
    score = probability(scored) if use_probability else F.col("prediction")
    return rank_auc(scored.select(score.alias("score"), col(target)), "score", target)


def importances(spark, model, features):
    """(feature, importance), one row per feature."""
    values = model.featureImportances.toArray()
    # A vector of importances ends at the last feature used in a model cut to its first rounds.
    rows = [(f, float(values[i]) if i < len(values) else 0.0) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double")


def combinations(grid):
    names = list(grid)
    return [dict(zip(names, values)) for values in product(*grid.values())]


def sample_combinations(space, draws, seed=42):
    """Random distinct draws from a search space."""
    every = combinations(space)
    return random.Random(seed).sample(every, min(draws, len(every)))


def _folds(train, folds, key, seed):
    """(rest, fold) for each fold of a persisted table; folds come from the key's hash."""
    fold = fold_column(col(key), folds, seed)
    return [(train.filter(fold != f), train.filter(fold == f)) for f in range(folds)]


def _run(spark, jobs, parallelism):
    """Results of independent fits, ``parallelism`` of them at a time."""
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPool(min(parallelism, max(1, len(jobs)))) as pool:
        return pool.map(run, jobs, chunksize=1)


def _families(candidates, count):
    """Candidates that differ in the number of trees alone share their fits: [(settings, counts)]."""
    families = {}
    for candidate in candidates:
        settings = {k: v for k, v in candidate.items() if k != count}
        families.setdefault(repr(sorted(settings.items())), (settings, []))[1].append(candidate[count])
    return [(settings, sorted(set(counts))) for settings, counts in families.values()]


def _searched(spark, candidates, count, families, scores, folds):
    """(index of the best candidate, one row per candidate) from each family's scores by fold.

    The first of equally good candidates wins.
    """
    found = {}
    for i, (settings, counts) in enumerate(families):
        by_fold = scores[i * folds : (i + 1) * folds]
        for j, k in enumerate(counts):
            found[repr(sorted({**settings, count: k}.items()))] = sum(s[j] for s in by_fold) / folds
    ordered = [found[repr(sorted(c.items()))] for c in candidates]
    best = max(range(len(ordered)), key=lambda i: (ordered[i], -i))
    table = spark.createDataFrame(
        [(i, str(c), float(s), i == best) for i, (c, s) in enumerate(zip(candidates, ordered))],
        "candidate int, settings string, score double, best boolean",
    )
    return best, table


def unique_settings(params, **options):
    """Spark settings of each combination, those that are the same on Spark once."""
    unique = {}
    for given in params:
        settings = spark_settings(given, **options)
        unique.setdefault(repr(sorted(settings.items())), settings)
    return list(unique.values())


def search_boosted(train, candidates, folds, target="target", key="user_id", seed=42, base=None, parallelism=16):
    """Cross-validated accuracy of boosted-tree candidates that each give ``maxIter``.

    One fit a fold serves all candidates that differ in their rounds: it is scored after each of
    the rounds asked for. Returns the best candidate refitted, its settings, and a row per candidate.
    """
    spark, families = train.sparkSession, _families(candidates, "maxIter")
    common = {"labelCol": target, "seed": seed, **(base or {})}

    def job(settings, counts, fit_on, held_out):
        def run():
            model = GBTClassifier(**{**common, **settings, "maxIter": counts[-1]}).fit(fit_on)
            return accuracy_by_round(model, held_out, counts, target)

        return run

    with prepared(train) as (held,):
        parts = _folds(held, folds, key, seed)
        jobs = [job(*family, *part) for family in families for part in parts]
        best, table = _searched(spark, candidates, "maxIter", families, _run(spark, jobs, parallelism), folds)
        model = GBTClassifier(**{**common, **candidates[best]}).fit(held)
    return model, candidates[best], table


def grid_search(train, grid=None, folds=4, target="target", key="user_id", seed=42, base=None, parallelism=16):
    """Search every combination of boosted-tree settings; ``base`` holds those that stay."""
    candidates = unique_settings(combinations(grid or BOOSTED_GRID))
    default = GBTClassifier().getMaxIter()
    candidates = [{"maxIter": default, **c} for c in candidates]
    stays = spark_settings(base, rows=train.count()) if base else None
    return search_boosted(train, candidates, folds, target, key, seed, stays, parallelism)


def fit_tuned(train, grid=None, folds=4, target="target", key="user_id", seed=42, base=None, rounds=100, **options):
    """Search, then boosted trees with the best settings, cut at the best AUC of a held-out part.

    All of the best settings are carried over but the number of rounds, which the held-out part
    decides. Returns the model and one row per candidate.
    """
    _, best, table = grid_search(train, grid, folds, target, key, seed, base, **options)
    stays = spark_settings(base, rows=train.count()) if base else {}
    model = fit_boosted_on_auc(train, target, key, seed=seed, **{**stays, **best, "maxIter": rounds})
    return model, table


def forest_parts(counts):
    """Sizes of forests that add up, one after the other, to each of the sorted ``counts``."""
    return [k - before for before, k in zip([0, *counts], counts)]


def keeps_nodes(rows, trees, partitions):
    """Whether a forest keeps the node of each row in each tree, instead of walking down to it for every level."""
    return rows * trees * 4 <= NODE_BYTES * partitions


def search_forests(train, candidates, folds, target="target", key="user_id", seed=42, parallelism=16):
    """Cross-validated accuracy of random-forest candidates that each give ``numTrees``.

    Trees of a forest are independent, so a forest of k trees is part of a larger one: candidates
    that differ in their trees alone share forests that add up, and votes are summed from one to
    the next. Depths are tried from the largest down: forests that stay below a limit by themselves
    are the forests under that limit, and are not fitted again. Returns the best candidate
    refitted, its settings, and a row per candidate.
    """
    spark, families = train.sparkSession, _families(candidates, "numTrees")
    groups = {}
    for settings, counts in families:
        rest = {k: v for k, v in settings.items() if k != "maxDepth"}
        group = groups.setdefault(repr(sorted(rest.items())), (rest, set(), set()))
        group[1].add(settings.get("maxDepth"))
        group[2].update(counts)

    def job(settings, counts, fit_on, held_out):
        def run():
            scored, margin, right, depth = held_out, "0D", [], 0
            for i, size in enumerate(forest_parts(counts)):
                forest = RandomForestClassifier(
                    labelCol=target, seed=seed + i, cacheNodeIds=keeps_nodes(rows, size, partitions),
                    **{**settings, "numTrees": size}
                )
                model = forest.fit(fit_on).setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("")
                depth = max(depth, *(tree.depth() for tree in model._java_obj.trees()))
                votes = vector_to_array("__raw")
                scored = model.transform(scored).withColumn(f"__m{i}", votes[1] - votes[0]).drop("__raw")
                margin += f" + __m{i}"
                right.append(F.expr(f"avg(IF(({margin} > 0) = ({quoted(target)} = 1), 1D, 0D)) AS k{i}"))
            return depth, dict(zip(counts, scored.agg(*right).first()))

        return run

    found, last = {}, {}
    with prepared(train) as (held,):
        rows, partitions = held.count(), held.rdd.getNumPartitions()
        parts = _folds(held, folds, key, seed)
        depths = sorted({d for _, of, _ in groups.values() for d in of}, key=lambda d: -1 if d is None else d, reverse=True)
        for limit in depths:
            todo = []
            for name, (rest, of, counts) in groups.items():
                for f, part in enumerate(parts if limit in of else []):
                    depth, scores = last.get((name, f), (None, None))
                    if limit is not None and depth is not None and depth <= limit:
                        found[name, limit, f] = scores
                    else:
                        settings = rest if limit is None else {**rest, "maxDepth": limit}
                        todo.append(((name, f), job(settings, sorted(counts), *part)))
            for (name, f), result in zip([t[0] for t in todo], _run(spark, [t[1] for t in todo], parallelism)):
                last[name, f], found[name, limit, f] = result, result[1]
        scores = []
        for settings, counts in families:
            name = repr(sorted((k, v) for k, v in settings.items() if k != "maxDepth"))
            scores += [[found[name, settings.get("maxDepth"), f][k] for k in counts] for f in range(folds)]
        best, table = _searched(spark, candidates, "numTrees", families, scores, folds)
        nodes = keeps_nodes(rows, candidates[best]["numTrees"], partitions)
        model = RandomForestClassifier(labelCol=target, seed=seed, cacheNodeIds=nodes, **candidates[best]).fit(held)
    return model, candidates[best], table


def random_search(train, space=None, draws=100, folds=3, target="target", key="user_id", seed=42, parallelism=16):
    """Search random draws of random-forest settings."""
    # Depths beyond Spark's limit are one candidate, not several.
    every = unique_settings(combinations(space or FOREST_SPACE), forest=True)
    default = RandomForestClassifier().getNumTrees()
    every = [{"numTrees": default, **c} for c in every]
    candidates = random.Random(seed).sample(every, min(draws, len(every)))
    return search_forests(train, candidates, folds, target, key, seed, parallelism)
