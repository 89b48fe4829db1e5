"""The merged and labelled training table."""

from ...operators import assemble, features
from .. import samples, training
from ..samples import BRANDS
from .idsets import COUNTS, clean_user_rows
from .registry import (
    ATTRIBUTION_SQL, CLEAN_ATTRIBUTION, CLEAN_EVENTS, EVENT_SQL, POSITION_SQL, near_all, query, sql_by_user,
)
from .reports import PER_USER, per_user


@query(
    "merge_features",
    """SELECT p.user_id, p.n AS deals, coalesce(e.n, 0) AS events, coalesce(a.n, 0) AS clicks
    FROM per_user_n p
    LEFT JOIN (SELECT user_id, count(*) AS n FROM event_rows GROUP BY 1) e USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n FROM attribution GROUP BY 1) a USING (user_id)""",
    COUNTS,
)
def merge_features(spark, sf_dir):
    return assemble.merge_features(
        features.rows_per_key(clean_user_rows(spark, sf_dir), name="deals"),
        features.rows_per_key(samples.events(spark, sf_dir), name="events"),
        features.rows_per_key(samples.attribution(spark, sf_dir), name="clicks"),
    )


@query(
    "side_by_side",
    """SELECT coalesce(e.user_id, d.user_id) AS user_id, e.n AS events, d.n AS deposits
    FROM (SELECT user_id, count(*) AS n FROM event_rows GROUP BY 1) e
    FULL JOIN (SELECT user_id, count(*) AS n FROM deposits GROUP BY 1) d ON e.user_id = d.user_id""",
)
def side_by_side(spark, sf_dir):
    return assemble.side_by_side(
        features.rows_per_key(samples.events(spark, sf_dir), name="events"),
        features.rows_per_key(samples.deposits(spark, sf_dir), name="deposits"),
    )


@query(
    "label_users",
    "SELECT user_id, deals, target FROM per_user",
    PER_USER,
)
def label_users(spark, sf_dir):
    return per_user(spark, sf_dir).select("user_id", "deals", "target")


def full_table(spark, sf_dir, build=training.training_table, deposits=samples.deposits):
    _, *logs = samples.logs(spark, sf_dir)
    return build(deposits(spark, sf_dir), *logs, instruments=BRANDS)


def full_vectors(spark, sf_dir, deposits=samples.deposits):
    """The merged table as sparse vectors, and the table of feature names."""
    return full_table(spark, sf_dir, training.training_vectors, deposits)


@query(
    "training_table",
    "SELECT p.*, "
    + "coalesce(COLUMNS(e.* EXCLUDE (user_id)), 0), a.* EXCLUDE (user_id), "
    + "CASE WHEN d.user_id IS NULL THEN 0 ELSE 1 END AS target "
    + """FROM pos_users p LEFT JOIN ev_users e ON p.user_id = e.user_id
    LEFT JOIN attr_users a ON p.user_id = a.user_id
    LEFT JOIN (SELECT DISTINCT user_id FROM deposits) d ON p.user_id = d.user_id""",
    ",".join(
        [
            CLEAN_EVENTS,
            CLEAN_ATTRIBUTION,
            " pos_users AS (" + sql_by_user("clean_positions", [
                c if not c.startswith("round(") else "coalesce(" + c.replace(" AS ", ", 0) AS ", 1)
                for c in POSITION_SQL
            ]) + ")",
            " ev_users AS (" + sql_by_user("clean_events", EVENT_SQL) + ")",
            " attr_users AS (" + sql_by_user("clean_attribution", ATTRIBUTION_SQL) + ")",
        ]
    ),
)
def training_table(spark, sf_dir):
    return near_all(full_table(spark, sf_dir))
