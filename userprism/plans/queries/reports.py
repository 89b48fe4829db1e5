"""Frequencies, summaries, class balance, lift and correlation."""

from pyspark.sql import functions as F

from ...functions import scalars
from ...operators import assemble, cleaning, correlation, explore, features
from .. import positions as positions_plan
from .. import samples
from ..samples import BRANDS
from .registry import near, near_all, query


@query(
    "value_counts",
    "SELECT name AS value, count(*) AS n FROM event_rows GROUP BY 1",
)
def value_counts(spark, sf_dir):
    return explore.value_counts(samples.events(spark, sf_dir), "name")


@query(
    "count_summary",
    """SELECT round(avg(n) + 1e-7, 4) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median,
    round(quantile_cont(n, 0.1) + 1e-7, 4) AS q10, round(quantile_cont(n, 0.9) + 1e-7, 4) AS q90,
    round(quantile_cont(n, 0.99) + 1e-7, 4) AS q99, max(n) AS max, count(*) AS keys
    FROM (SELECT user_id, count(*) AS n FROM clean_positions GROUP BY 1)""",
)
def count_summary(spark, sf_dir):
    per_user = features.rows_per_key(cleaning.drop_repeats(samples.positions(spark, sf_dir)))
    return near_all(explore.count_summary(per_user))


LABELLED = """ labelled AS (
  SELECT *, CASE WHEN user_id IN (SELECT user_id FROM deposits) THEN 1 ELSE 0 END AS made_depo
  FROM clean_positions)"""


@query(
    "class_balance",
    """SELECT made_depo, count(*) AS "rows", count(DISTINCT user_id) AS users FROM labelled GROUP BY 1""",
    LABELLED,
)
def class_balance(spark, sf_dir):
    rows = cleaning.drop_repeats(samples.positions(spark, sf_dir))
    return explore.class_balance(rows, samples.deposits(spark, sf_dir))


@query(
    "label_rows",
    "SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM deposits) THEN 1 ELSE 0 END AS made_depo FROM event_rows",
)
def label_rows(spark, sf_dir):
    rows = samples.events(spark, sf_dir).select("event_id", "user_id")
    return assemble.label_rows(rows, samples.deposits(spark, sf_dir)).select("event_id", "made_depo")


@query(
    "month_counts",
    """SELECT count(*) FILTER (WHERE month(time) = 1) AS month_1,
    count(*) FILTER (WHERE month(time) = 2) AS month_2 FROM event_rows""",
)
def month_counts(spark, sf_dir):
    month = F.month("time")
    return explore.count_matching(
        samples.events(spark, sf_dir), {"month_1": month == 1, "month_2": month == 2}
    )


LIFT_COLUMNS = ("client_platform_id", "country_id", "device", "aff_id")


@query(
    "category_lift",
    """SELECT feature, value, count(*) FILTER (WHERE d = 1) AS positive,
    count(*) FILTER (WHERE d = 0) AS negative,
    round(coalesce(count(*) FILTER (WHERE d = 1)
        / nullif((SELECT count(*) FROM labelled_attr WHERE d = 1), 0), 0)
      - coalesce(count(*) FILTER (WHERE d = 0)
        / nullif((SELECT count(*) FROM labelled_attr WHERE d = 0), 0), 0), 8) AS lift
    FROM (""" + " UNION ALL ".join(
        f"SELECT d, '{c}' AS feature, {v} AS value FROM labelled_attr"
        for c, v in zip(
            LIFT_COLUMNS,
            ("client_platform_id::VARCHAR",
             "'cat_id_' || coalesce(country_id::BIGINT::VARCHAR, 'nan')",
             "device", "'cat_id_' || aff_id"),
        )
    ) + ") WHERE value IS NOT NULL GROUP BY ALL",
    """ labelled_attr AS (SELECT *, CASE WHEN user_id IN (SELECT user_id FROM deposits) THEN 1 ELSE 0 END AS d
    FROM attribution)""",
)
def category_lift(spark, sf_dir):
    rows = samples.attribution(spark, sf_dir).withColumns(
        {
            "country_id": scalars.category_label(F.col("country_id").cast("long")),
            "aff_id": scalars.category_label(F.col("aff_id")),
        }
    )
    lift = explore.category_lift(rows, samples.deposits(spark, sf_dir), list(LIFT_COLUMNS))
    return lift.withColumn("lift", F.round("lift", 8))


@query(
    "recode",
    """SELECT label, platform, count(*) AS n FROM (
      SELECT CASE WHEN user_balance_type = 1 THEN 'Real_money' ELSE 'Whatever_else' END AS label,
        'cat_id_' || client_platform_id AS platform FROM positions) GROUP BY ALL""",
)
def recode(spark, sf_dir):
    return (
        samples.positions(spark, sf_dir)
        .select(
            scalars.balance_label(F.col("user_balance_type")).alias("label"),
            scalars.category_label(F.col("client_platform_id")).alias("platform"),
        )
        .groupBy("label", "platform")
        .agg(F.count(F.lit(1)).alias("n"))
    )


SUMMARIZED = ("buy_amount", "count", "instrument_strike")


@query(
    "summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count("{c}") AS "count", round(avg("{c}") + 1e-7, 4) AS mean,
        round(stddev_samp("{c}"), 4) AS std, min("{c}") AS min,
        round(quantile_cont("{c}", 0.25) + 1e-7, 4) AS q25, round(quantile_cont("{c}", 0.5) + 1e-7, 4) AS median,
        round(quantile_cont("{c}", 0.75) + 1e-7, 4) AS q75, max("{c}") AS max FROM positions"""
        for c in SUMMARIZED
    ),
)
def summary(spark, sf_dir):
    found = explore.describe(samples.positions(spark, sf_dir), list(SUMMARIZED))
    rounded = {c: near(F.col(c)) for c in ("mean", "q25", "median", "q75")}
    return found.withColumns({**rounded, "std": F.round("std", 4)})


PER_USER = """ per_user AS (
  SELECT u.*, CASE WHEN d.user_id IS NULL THEN 0 ELSE 1 END AS target
  FROM (SELECT user_id, avg(buy_amount) AS buy_amount_mean, max(sell_amount) AS sell_amount_max,
      min(pnl_total) AS pnl_total_min, count(*) FILTER (WHERE leverage = 1) AS leverage_1_count,
      count(*) AS deals, 5 AS constant
    FROM clean_positions GROUP BY user_id) u
  LEFT JOIN (SELECT DISTINCT user_id FROM deposits) d ON u.user_id = d.user_id)"""
CORRELATED = ("buy_amount_mean", "sell_amount_max", "pnl_total_min", "leverage_1_count", "deals", "constant")


def per_user(spark, sf_dir, rows=None):
    """A small labelled per-user table with one constant feature; ``rows`` are cleaned positions at hand."""
    if rows is None:
        rows = positions_plan.clean_positions(samples.positions(spark, sf_dir), BRANDS)
    grouped = rows.groupBy("user_id").agg(
        F.avg("buy_amount").alias("buy_amount_mean"),
        F.max("sell_amount").alias("sell_amount_max"),
        F.min("pnl_total").alias("pnl_total_min"),
        F.count_if(F.col("leverage") == 1).alias("leverage_1_count"),
        F.count(F.lit(1)).alias("deals"),
        F.lit(5).alias("constant"),
    )
    return assemble.label_users(grouped, samples.deposits(spark, sf_dir))


def sql_corr(a, b):
    return (
        f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN"
        f" round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) END"
    )


@query(
    "target_corr",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_corr(c, 'target')} AS correlation FROM per_user" for c in CORRELATED
    ),
    PER_USER,
)
def target_corr(spark, sf_dir):
    found = correlation.target_correlation(per_user(spark, sf_dir), list(CORRELATED))
    return found.withColumn("correlation", F.round("correlation", 6))


@query(
    "corr_filter",
    "SELECT feature FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_corr(c, 'target')} AS r FROM per_user" for c in CORRELATED
    )
    + ") WHERE abs(r) > 0.05",
    PER_USER,
)
def corr_filter(spark, sf_dir):
    kept = correlation.select_by_correlation(per_user(spark, sf_dir), threshold=0.05)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, {sql_corr(a, b)} AS correlation FROM per_user"
        for a in CORRELATED[:-1] for b in CORRELATED[:-1]
    ),
    PER_USER,
)
def corr_matrix(spark, sf_dir):
    found = correlation.correlation_matrix(per_user(spark, sf_dir), list(CORRELATED[:-1]))
    return found.withColumn("correlation", F.round("correlation", 6))


@query(
    "topn",
    "SELECT user_id, deals FROM per_user ORDER BY deals DESC, user_id LIMIT 20",
    PER_USER,
)
def topn(spark, sf_dir):
    return explore.top_rows(
        per_user(spark, sf_dir).select("user_id", "deals"), "deals", 20, ties=("user_id",)
    )


@query("keep_columns", "SELECT deals, leverage_1_count, target, user_id FROM per_user", PER_USER)
def keep_columns(spark, sf_dir):
    return cleaning.keep_columns(per_user(spark, sf_dir), ["deals", "leverage_1_count", "deals"])
