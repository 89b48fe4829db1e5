"""Features per user."""

import uuid

from ...operators import cleaning, features, quantiles, scale
from ...sources.store import TableStore
from .. import attribution as attribution_plan
from .. import events as events_plan
from .. import positions as positions_plan
from .. import samples
from ..samples import BRANDS
from .registry import (
    ATTRIBUTION_SQL, CLEAN_ATTRIBUTION, CLEAN_EVENTS, CONVERSION_SQL, EVENT_SQL, FREQUENCY_SQL,
    POSITION_SQL, TYPES, near_all, query, sql_by_user, sql_counts, sql_flags, sql_stats, sql_sums,
)


@query("rows_per_user", sql_by_user("positions", ["count(*) AS n"]))
def rows_per_user(spark, sf_dir):
    return features.rows_per_key(samples.positions(spark, sf_dir))


@query(
    "numeric_stats",
    sql_by_user("positions", sql_stats(("buy_amount", "instrument_strike"), features.POSITION_STATS)),
)
def numeric_stats(spark, sf_dir):
    spec = features.FeatureSpec(parts=(features.Stats(("buy_amount", "instrument_strike")),))
    return near_all(features.build_features(samples.positions(spark, sf_dir), spec))


@query(
    "heavy_user_quantiles",
    sql_by_user(
        "positions",
        sql_stats(("buy_amount", "instrument_strike", "pnl_total"), ("q10", "q25", "median", "q75", "q90")),
    ),
)
def heavy_user_quantiles(spark, sf_dir):
    """Users above the mean row count go through ranked range partitions."""
    used = ["buy_amount", "instrument_strike", "pnl_total"]
    rows = scale.stage(samples.positions(spark, sf_dir).select("user_id", *used))
    return near_all(
        quantiles.exact_quantiles(
            rows, "user_id", used, ["q10", "q25", "median", "q75", "q90"], heavy_rows=40,
        )
    )


@query(
    "cond_counts",
    sql_by_user(
        "positions",
        [
            *sql_counts("instrument_type", TYPES, "deals_per_{value}_instr_count"),
            *sql_counts("instrument_dir", ("A", "R"), "deals_per_instr_dir_type_{value}_count"),
            "count(*) FILTER (WHERE instrument_dir IS NULL) AS deals_per_instr_dir_type_none_count",
            *sql_counts("leverage", range(1, 8), "{feature}_{value}_count"),
        ],
    ),
)
def cond_counts(spark, sf_dir):
    spec = features.FeatureSpec(
        parts=(
            features.CountBy("instrument_type", name="deals_per_{value}_instr_count"),
            features.CountBy(
                "instrument_dir", name="deals_per_instr_dir_type_{value}_count", null_name="none"
            ),
            features.CountBy("leverage"),
        )
    )
    return features.build_features(samples.positions(spark, sf_dir), spec)


@query(
    "wide_counts",
    sql_by_user("positions", sql_counts("instrument_active_id", range(178), "{feature}_{value}_count")),
)
def wide_counts(spark, sf_dir):
    """178 values: counted by pivot."""
    spec = features.FeatureSpec(parts=(features.CountBy("instrument_active_id"),))
    return features.build_features(samples.positions(spark, sf_dir), spec)


@query(
    "long_counts",
    """SELECT user_id, feature, value, count(*) AS n FROM (
      SELECT user_id, 'instrument_active_id' AS feature, instrument_active_id::VARCHAR AS value FROM positions
      UNION ALL SELECT user_id, 'instrument_dir', instrument_dir FROM positions)
    WHERE value IS NOT NULL GROUP BY ALL""",
)
def long_counts(spark, sf_dir):
    return features.count_pairs(
        samples.positions(spark, sf_dir), "user_id", ["instrument_active_id", "instrument_dir"]
    )


@query(
    "value_sets",
    "SELECT DISTINCT user_id, 'instrument_type' AS feature, instrument_type AS value FROM positions",
)
def value_sets(spark, sf_dir):
    return features.value_pairs(samples.positions(spark, sf_dir), "user_id", ["instrument_type"])


@query(
    "cond_sums",
    sql_by_user(
        "clean_events",
        sql_sums("duration", "platform_id", range(10), "duration_per_platform_{value}"),
    ),
    CLEAN_EVENTS,
)
def cond_sums(spark, sf_dir):
    spec = features.FeatureSpec(
        parts=(features.SumBy("duration", "platform_id", name="duration_per_platform_{value}"),)
    )
    rows = events_plan.clean_events(samples.events(spark, sf_dir))
    return near_all(features.build_features(rows, spec))


@query(
    "distinct_per_user",
    sql_by_user(
        "positions",
        [
            "count(DISTINCT client_platform_id) AS ids_client_platform_count",
            "count(DISTINCT user_balance_id) AS ids_balances_count",
        ],
    ),
)
def distinct_per_user(spark, sf_dir):
    spec = features.FeatureSpec(
        parts=(
            features.DistinctCount("client_platform_id", "ids_client_platform_count"),
            features.DistinctCount("user_balance_id", "ids_balances_count"),
        )
    )
    return features.build_features(samples.positions(spark, sf_dir), spec)


@query(
    "membership_flags",
    sql_by_user(
        "positions",
        [
            *sql_flags("user_balance_type", (1, 2, 4), "has_balance_type_{value}"),
            *sql_flags("position_type", ("long", "short"), "has_position_type_{value}"),
            *sql_flags("instrument_dir", ("A", "R"), "has_instr_dir_type_{value}"),
            *sql_flags("client_platform_id", range(12)),
        ],
    ),
)
def membership_flags(spark, sf_dir):
    spec = features.FeatureSpec(parts=positions_plan.extra_flag_spec())
    return features.build_features(samples.positions(spark, sf_dir), spec)


@query("conversion_counts", sql_by_user("positions", CONVERSION_SQL))
def conversion_counts(spark, sf_dir):
    parts = tuple(p for p in positions_plan.number_spec() if isinstance(p, features.CountWhere))
    return features.build_features(samples.positions(spark, sf_dir), features.FeatureSpec(parts=parts))


@query(
    "conversion_flags",
    "SELECT DISTINCT position_id, user_id, "
    + ", ".join(
        f"CASE WHEN {c} - {c}_enrolled = 0 THEN 0 ELSE 1 END AS {c}_conversion_happened"
        for c in positions_plan.CONVERTED
    )
    + " FROM positions",
)
def conversion_flags(spark, sf_dir):
    flagged = positions_plan.with_conversions(samples.positions(spark, sf_dir))
    return cleaning.drop_repeats(
        flagged.select("position_id", "user_id", *[c for c in flagged.columns if c.endswith("_happened")])
    )


@query("position_features", sql_by_user("clean_positions", POSITION_SQL))
def position_features(spark, sf_dir):
    return near_all(positions_plan.position_features(samples.positions(spark, sf_dir), BRANDS))


@query("event_features", sql_by_user("clean_events", EVENT_SQL), CLEAN_EVENTS)
def event_features(spark, sf_dir):
    return near_all(events_plan.event_features(samples.events(spark, sf_dir)))


@query(
    "stored_halves",
    sql_by_user("clean_events", [EVENT_SQL[0], *[c for c in EVENT_SQL if "duration" in c]]),
    CLEAN_EVENTS,
)
def stored_halves(spark, sf_dir):
    """Numbers and frequencies stored apart and loaded side by side."""
    store = TableStore(spark, f"{scale.shared_dir(spark)}/halves-{uuid.uuid4().hex}")
    rows = events_plan.clean_events(samples.events(spark, sf_dir))
    numbers = [p for p in events_plan.event_spec().parts if not isinstance(p, features.CountBy)]
    store.save("numbers", features.build_features(rows, features.FeatureSpec(parts=tuple(numbers))))
    store.save("frequency", features.rows_per_key(rows, name="ids_events_count"))
    return near_all(store.load_halves("numbers", "frequency"))


@query("attribution_features", sql_by_user("clean_attribution", ATTRIBUTION_SQL), CLEAN_ATTRIBUTION)
def attribution_features(spark, sf_dir):
    return attribution_plan.attribution_features(samples.attribution(spark, sf_dir))


@query(
    "exploration_features",
    sql_by_user(
        "(SELECT DISTINCT * FROM positions)",
        [
            "count(*) AS ids_deals_count",
            "count(DISTINCT user_balance_id) AS ids_balances_count",
            *[s for s in FREQUENCY_SQL if "instrument_underlying" not in s],
            *sql_counts("instrument_underlying", [f"Brand#{i}" for i in range(1, 26)], "{feature}_{value}_count"),
            *sql_flags("user_balance_type", (1, 2, 4), "has_balance_type_{value}"),
            *sql_flags("position_type", ("long", "short"), "has_position_type_{value}"),
            *sql_flags("instrument_dir", ("A", "R"), "has_instr_dir_type_{value}"),
            *sql_flags("client_platform_id", range(12)),
            *sql_counts("instrument_active_id", range(178), "{feature}_{value}_count"),
        ],
    ),
)
def exploration_features(spark, sf_dir):
    return positions_plan.exploration_features(samples.positions(spark, sf_dir))
