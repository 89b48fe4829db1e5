"""Queries on wide categories, typed categories, JSON pairs, and a label that a tree must find."""

from functools import partial

from pyspark.sql import functions as F

from ...functions import jsonprops
from ...operators import explore, features, learn, scale, sparse, split
from .. import samples, training
from .assembly import full_table
from .registry import near_all, query

WIDE = features.FeatureSpec(parts=(
    features.CountBy("position_id"), features.FlagBy("position_id"), features.SumBy("buy_amount", "position_id"),
))


@query(
    "sparse_positions",
    """SELECT user_id, 'position_id_' || position_id || '_count' AS name, count(*)::DOUBLE AS value
    FROM positions GROUP BY user_id, position_id
    UNION ALL SELECT DISTINCT user_id, 'uses_position_id_' || position_id, 1.0::DOUBLE FROM positions
    UNION ALL SELECT user_id, 'buy_amount_sum_position_id_' || position_id, round(sum(buy_amount) + 1e-7, 4)
    FROM positions GROUP BY user_id, position_id""",
)
def sparse_positions(spark, sf_dir):
    """Long features of a category with a value for every position."""
    return near_all(sparse.long_features(samples.positions(spark, sf_dir), WIDE))


@query(
    "sparse_dictionary",
    """SELECT name, row_number() OVER (ORDER BY encode(name)) - 1 AS "index" FROM (
    SELECT DISTINCT 'position_id_' || position_id || '_count' AS name FROM positions)""",
)
def sparse_dictionary(spark, sf_dir):
    """The features' numbers, without a window over all of them."""
    spec = features.FeatureSpec(parts=(features.CountBy("position_id"),))
    return sparse.dictionary(sparse.long_features(samples.positions(spark, sf_dir), spec))


RATES = tuple(n / 100 for n in range(11))


@query(
    "typed_counts",
    "SELECT user_id, " + ", ".join(
        f"count(*) FILTER (WHERE close_effect_amount::FLOAT = {v}::FLOAT) AS \"{features.feature_name('rate_{value}_count', v)}\""
        for v in RATES
    ) + ", " + ", ".join(
        f"max(CASE WHEN close_effect_amount::DECIMAL(4, 2) = {v} THEN 1 ELSE 0 END)::INTEGER"
        f" AS \"{features.feature_name('exact_{value}', v)}\"" for v in RATES
    ) + " FROM positions GROUP BY user_id",
)
def typed_counts(spark, sf_dir):
    """Counts and flags of a FLOAT and a DECIMAL category, compared in these types."""
    rate = F.col("close_effect_amount")
    rows = samples.positions(spark, sf_dir).withColumns({"rate": rate.cast("float"), "exact": rate.cast("decimal(4,2)")})
    spec = features.FeatureSpec(parts=(
        features.CountBy("rate", RATES, "rate_{value}_count"), features.FlagBy("exact", RATES, "exact_{value}"),
    ))
    return features.build_features(rows, spec)


@query(
    "json_pairs",
    """SELECT event_id, 'k' AS path, 'BIGINT' AS type, json_extract_string(parameters, '$.k') AS value
    FROM event_rows WHERE parameters IS NOT NULL""",
)
def json_pairs(spark, sf_dir):
    return jsonprops.property_pairs(samples.events(spark, sf_dir), "parameters", "event_id")


def _split_sql(fraction, part):
    limit = f"{int(fraction * 2**32):08x}"
    return f"SELECT DISTINCT user_id, substring(md5('{part}42:' || user_id), 1, 8) < '{limit}' AS chosen FROM positions"


def _split(spark, sf_dir, fraction, part):
    users = samples.positions(spark, sf_dir).select("user_id").distinct()
    rest, chosen = split.hash_split(users, fraction, part=part)
    return rest.withColumn("chosen", F.lit(False)).unionByName(chosen.withColumn("chosen", F.lit(True)))


@query("split_valid", _split_sql(0.1, "valid"))
def split_valid(spark, sf_dir):
    """90 / 10, as for early stopping."""
    return _split(spark, sf_dir, 0.1, "valid")


@query("split_selection", _split_sql(0.3, "test"))
def split_selection(spark, sf_dir):
    """70 / 30, as for feature selection."""
    return _split(spark, sf_dir, 0.3, "test")


@query(
    "fold_numbers",
    """SELECT DISTINCT user_id, (('0x' || substring(md5('fold42:' || user_id), 1, 8))::BIGINT % 4)::INTEGER AS fold
    FROM positions""",
)
def fold_numbers(spark, sf_dir):
    users = samples.positions(spark, sf_dir).select("user_id").distinct()
    return users.withColumn("fold", split.fold_column(F.col("user_id"), 4, 42))


# A label that one feature of the merged table decides: a tree has to find it among all others.
DECISIVE, LIMIT = "leverage_1_count", 5


def planted_parts(spark, sf_dir):
    """(names, train, test) of the full merged table under the planted label."""
    planted = (F.col(DECISIVE) > LIMIT).cast("int")
    build = partial(training.training_table, staged=False)  # the whole table is staged, not its parts too
    table = scale.without_steps(spark, lambda: scale.stage(full_table(spark, sf_dir, build).withColumn("target", planted)))
    names = learn.feature_columns(table)
    return names, *[learn.to_vectors(part, names) for part in split.hash_split(table)]


TEST_USER = "substring(md5('test42:' || user_id), 1, 8) < '33333333'"
PLANTED_SQL = f"SELECT user_id, (count(*) FILTER (WHERE leverage = 1) > {LIMIT})::INTEGER AS target FROM clean_positions GROUP BY user_id"


@query(
    "tree_planted",
    f"SELECT user_id, target::DOUBLE AS target, target::DOUBLE AS prediction FROM ({PLANTED_SQL}) WHERE {TEST_USER}",
)
def tree_planted(spark, sf_dir):
    """Predictions of a tree without a depth limit on the whole merged table."""
    _, train, test = planted_parts(spark, sf_dir)
    return learn.fit_tree(train).transform(test).select("user_id", "target", "prediction")


@query("importance_planted", f"SELECT '{DECISIVE}' AS feature, 1.0::DOUBLE AS importance")
def importance_planted(spark, sf_dir):
    """The features a tree uses: the decisive one alone."""
    names, train, _ = planted_parts(spark, sf_dir)
    found = learn.importances(spark, learn.fit_tree(train), names)
    return explore.top_rows(found.filter("importance > 0"), "importance", 20, ties=("feature",))


@query("gbt_planted", "SELECT 1.0::DOUBLE AS auc")
def gbt_planted(spark, sf_dir):
    """AUC of boosting with the AUC stop: 100 rounds, patience 50; the first round is perfect."""
    _, train, test = planted_parts(spark, sf_dir)
    return learn.evaluate(learn.fit_boosted_on_auc(train, maxDepth=2), test, use_probability=True).select("auc")
