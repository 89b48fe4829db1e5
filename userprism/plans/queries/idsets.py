"""Id sets and outlier users."""

from ...operators import cleaning, features, idsets, scale
from .. import positions, samples
from .registry import query
from .reports import PER_USER, per_user


def ids(spark, sf_dir):
    return {
        "positions": samples.positions(spark, sf_dir),
        "deposits": samples.deposits(spark, sf_dir),
        "events": samples.events(spark, sf_dir),
        "attribution": samples.attribution(spark, sf_dir),
    }


@query("id_distinct", "SELECT DISTINCT user_id FROM event_rows")
def id_distinct(spark, sf_dir):
    return idsets.distinct_ids(samples.events(spark, sf_dir))


@query(
    "id_intersect",
    "SELECT user_id FROM positions INTERSECT SELECT user_id FROM deposits",
)
def id_intersect(spark, sf_dir):
    logs = ids(spark, sf_dir)
    return idsets.id_intersection(logs["positions"], logs["deposits"])


@query("id_subtract", "SELECT user_id FROM positions EXCEPT SELECT user_id FROM deposits")
def id_subtract(spark, sf_dir):
    logs = ids(spark, sf_dir)
    return idsets.id_difference(logs["positions"], logs["deposits"])


SETS_SQL = {
    "inter_pos_dep": "SELECT user_id FROM positions INTERSECT SELECT user_id FROM deposits",
    "dif_pos_dep": "SELECT user_id FROM positions EXCEPT SELECT user_id FROM deposits",
    "dif_dep_pos": "SELECT user_id FROM deposits EXCEPT SELECT user_id FROM positions",
    "inter_dep_ev": "SELECT user_id FROM deposits INTERSECT SELECT user_id FROM event_rows",
    "inter_pos_no_dep_events": "(SELECT user_id FROM positions EXCEPT SELECT user_id FROM deposits)"
    " INTERSECT SELECT user_id FROM event_rows",
    "inter_pos_events": "SELECT user_id FROM positions INTERSECT SELECT user_id FROM event_rows",
    "inter_pos_attr": "SELECT user_id FROM positions INTERSECT SELECT user_id FROM attribution",
}


@query(
    "overlap_report",
    " UNION ALL ".join(f"SELECT '{n}' AS set_name, count(*) AS ids FROM ({s})" for n, s in SETS_SQL.items()),
)
def overlap_report(spark, sf_dir):
    return idsets.overlap_report(**ids(spark, sf_dir))


@query(
    "overlap_sets",
    " UNION ALL ".join(f"SELECT '{n}' AS set_name, user_id FROM ({s})" for n, s in SETS_SQL.items()),
)
def overlap_sets(spark, sf_dir):
    return idsets.overlap_sets(**ids(spark, sf_dir))


COUNTS = " per_user_n AS (SELECT user_id, count(*) AS n FROM clean_positions GROUP BY user_id)"


def clean_user_rows(spark, sf_dir):
    return cleaning.drop_repeats(samples.positions(spark, sf_dir))


@query(
    "outlier_users",
    "SELECT user_id, n FROM per_user_n WHERE n > (SELECT quantile_cont(n, 0.99) FROM per_user_n)",
    COUNTS,
)
def outlier_users(spark, sf_dir):
    return idsets.split_outliers(clean_user_rows(spark, sf_dir))[0]


@query(
    "exclude_outliers",
    """SELECT p.user_id, p.deals, p.target FROM per_user p WHERE p.user_id NOT IN
    (SELECT user_id FROM per_user_n WHERE n > (SELECT quantile_cont(n, 0.99) FROM per_user_n))""",
    PER_USER + "," + COUNTS,
)
def exclude_outliers(spark, sf_dir):
    # De-duplicated once, for the outliers and for the table.
    cleaned = positions.clean_positions(samples.positions(spark, sf_dir), samples.BRANDS)
    rows = scale.stage(cleaned.select("user_id", "buy_amount", "sell_amount", "pnl_total", "leverage"))
    outliers, _ = idsets.split_outliers(rows)
    table = per_user(spark, sf_dir, rows).select("user_id", "deals", "target")
    return idsets.without_ids(table, outliers)


@query(
    "outer_indicator",
    """SELECT user_id, n, 'left_only' AS exist, 1::BIGINT AS copies FROM per_user_n
    WHERE n > (SELECT quantile_cont(n, 0.99) FROM per_user_n)""",
    COUNTS,
)
def outer_indicator(spark, sf_dir):
    rows = clean_user_rows(spark, sf_dir)
    _, others = idsets.split_outliers(rows)
    return idsets.outer_indicator(features.rows_per_key(rows), others)
