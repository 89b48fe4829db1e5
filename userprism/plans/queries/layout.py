"""Wide categories: a stored layout for later logs, and correlations from present cells only."""

import uuid

from pyspark.sql import functions as F

from ...operators import assemble, correlation, features, learn, scale, sparse, split
from ...operators.idsets import distinct_ids
from ...sources.store import TableStore
from .. import samples, training
from .registry import near, query

SPEC = features.FeatureSpec(parts=(
    features.CountBy("instrument_active_id"), features.FlagBy("instrument_active_id"),
    features.SumBy("buy_amount", "instrument_active_id"), features.CountBy("leverage"),
))
CELLS_SQL = """ cells AS (
  SELECT user_id, 'instrument_active_id_' || instrument_active_id || '_count' AS name, count(*)::DOUBLE AS value
  FROM positions GROUP BY ALL
  UNION ALL SELECT DISTINCT user_id, 'uses_instrument_active_id_' || instrument_active_id, 1.0::DOUBLE FROM positions
  UNION ALL SELECT user_id, 'buy_amount_sum_instrument_active_id_' || instrument_active_id, sum(buy_amount) FROM positions GROUP BY ALL
  UNION ALL SELECT user_id, 'leverage_' || leverage || '_count', count(*)::DOUBLE FROM positions GROUP BY ALL),
labels AS (SELECT DISTINCT user_id, CASE WHEN user_id IN (SELECT user_id FROM deposits) THEN 1 ELSE 0 END AS target FROM positions)"""
CORRELATIONS_SQL = CELLS_SQL + """,
correlations AS (
  SELECT name, CASE WHEN min(coalesce(value, 0)) < max(coalesce(value, 0)) THEN corr(coalesce(value, 0), target) END AS correlation
  FROM (SELECT DISTINCT name FROM cells) CROSS JOIN labels LEFT JOIN cells USING (user_id, name) GROUP BY name)"""

# The users whose log comes first, in the layout queries.
EARLY = 0.004
EARLY_SQL = f"substring(md5('layout42:' || user_id), 1, 8) < '{int(EARLY * 2**32):08x}'"


@query(
    "scoring_cells",
    f"""SELECT user_id, "index", round(value + 1e-7, 4) AS value FROM cells JOIN (
    SELECT name, (row_number() OVER (ORDER BY encode(name)) - 1)::INTEGER AS "index"
    FROM (SELECT DISTINCT name FROM cells WHERE {EARLY_SQL})) USING (name) WHERE NOT {EARLY_SQL}""",
    CELLS_SQL,
)
def scoring_cells(spark, sf_dir):
    """Later users' features at the places that the early users' log gave them; unseen values are left out."""
    long = scale.stage(sparse.long_features(samples.positions(spark, sf_dir), SPEC))
    later, early = split.hash_split(long, EARLY, part="layout")
    names = scale.stage(sparse.dictionary(early))
    return sparse.cells(later, names).withColumn("value", near(F.col("value")))


@query("score_new_users")
def score_new_users(spark, sf_dir):
    """A model and its layout are stored; the logs of other users are laid out and scored by them."""
    _, *logs = samples.logs(spark, sf_dir)
    known, new = zip(*(split.hash_split(log) for log in logs))
    store = TableStore(spark, f"{scale.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    vectors, names = training.training_vectors(samples.likely_deposits(spark, sf_dir), *known, instruments=samples.BRANDS)
    training.save_layout(store, names, known[1])
    store.save_model("tree", learn.fit_tree(vectors))
    laid_out = training.scoring_vectors(store, *new, instruments=samples.BRANDS)
    scored = store.load_model("tree").transform(laid_out)
    return scored.select("user_id", "prediction", learn.probability(scored).alias("score"))


def labelled_cells(spark, sf_dir):
    def build():
        # Each part of the spec reads the rows: the log is joined once.
        rows = scale.stage(samples.positions(spark, sf_dir).select("user_id", "instrument_active_id", "buy_amount", "leverage"))
        labels = assemble.label_users(distinct_ids(rows), samples.deposits(spark, sf_dir))
        return scale.stage(sparse.long_features(rows, SPEC)), scale.stage(labels)

    return scale.without_steps(spark, build)


@query("wide_target_corr", "SELECT name, round(correlation + 1e-9, 6) AS correlation FROM correlations", CORRELATIONS_SQL)
def wide_target_corr(spark, sf_dir):
    """Each wide feature's correlation with the label, zeros implied."""
    found = sparse.target_correlation(*labelled_cells(spark, sf_dir))
    return found.withColumn("correlation", F.round(F.col("correlation") + 1e-9, 6))


@query(
    "wide_corr_filter",
    """SELECT name, row_number() OVER (ORDER BY encode(name)) - 1 AS "index" FROM correlations WHERE abs(correlation) > 0.05""",
    CORRELATIONS_SQL,
)
def wide_corr_filter(spark, sf_dir):
    """The dictionary of the features that pass the filter."""
    return sparse.select_names(sparse.target_correlation(*labelled_cells(spark, sf_dir)), 0.05)


@query(
    "wide_corr_matrix",
    """SELECT a.name AS feature, b.name AS other, round((n * coalesce(xy, 0) - a.x * b.x) / (a.spread * b.spread) + 1e-9, 5) AS correlation
    FROM sums a CROSS JOIN sums b CROSS JOIN total LEFT JOIN (
      SELECT p.name AS left_name, q.name AS right_name, sum(p.value * q.value) AS xy FROM counted p JOIN counted q USING (user_id) GROUP BY 1, 2
    ) ON a.name = left_name AND b.name = right_name""",
    CELLS_SQL + """, total AS (SELECT count(*)::DOUBLE AS n FROM labels),
counted AS (SELECT * FROM cells WHERE name LIKE '%_count'),
sums AS (SELECT name, sum(value) AS x, sqrt(any_value(n) * sum(value * value) - sum(value) ** 2) AS spread FROM counted CROSS JOIN total GROUP BY name)""",
)
def wide_corr_matrix(spark, sf_dir):
    """All pairs of the counts of two categories, by strips of features."""
    long, labels = labelled_cells(spark, sf_dir)
    counts = long.filter(F.col("name").endswith("_count"))
    found = correlation.wide_correlation_matrix(counts, labels, strip=64)
    return found.withColumn("correlation", F.round(F.col("correlation") + 1e-9, 5))
