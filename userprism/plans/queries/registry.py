"""Named queries over the test tables, each with the SQL that gives the same rows.

Every query reads its whole tables. Computed doubles are rounded alike on both sides; the
small shift keeps exact halves from depending on the order of a floating-point sum.
"""

from pyspark.sql import functions as F

from ...operators import features, quantiles, scale
from .. import positions as positions_plan
from ..samples import BRANDS, LOGS_SQL

QUERIES, ORACLES = {}, {}

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
REASONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NAMES = ("click", "error", "purchase", "signup", "view")


def query(name, sql=None, extra=""):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = f"WITH {LOGS_SQL}{',' + extra if extra else ''}\n{sql}"
        return function

    return register


def near(column, digits=4):
    return F.round(column + 1e-7, digits)


def near_all(df, digits=4):
    """Round every double column."""
    texts = []
    for name, kind in df.dtypes:
        c = scale.quoted(name)
        texts.append(f"round({c} + 1e-7, {digits}) AS {c}" if kind == "double" else c)
    return df.selectExpr(*texts)


def sql_text(value):
    return f"'{value}'" if isinstance(value, str) else str(value)


def sql_stat(column, stat):
    simple = {"mean": "avg", "max": "max", "min": "min", "sum": "sum"}
    if stat in simple:
        return f'{simple[stat]}("{column}")'
    return f'quantile_cont("{column}", {quantiles.QUANTILES[stat]})'


def sql_stats(columns, stats):
    return [
        f'round({sql_stat(c, s)} + 1e-7, 4) AS "{c}_{s}"' for c in columns for s in stats
    ]


def sql_counts(column, values, name):
    return [
        f'count(*) FILTER (WHERE "{column}" = {sql_text(v)}) AS "{name.format(feature=column, value=v)}"'
        for v in values
    ]


def sql_flags(column, values, name="uses_{feature}_{value}"):
    return [
        f'max(CASE WHEN "{column}" = {sql_text(v)} THEN 1 ELSE 0 END)::INTEGER'
        f' AS "{name.format(feature=column, value=v)}"'
        for v in values
    ]


def sql_sums(amount, by, values, name):
    return [
        f'round(coalesce(sum("{amount}") FILTER (WHERE "{by}" = {sql_text(v)}), 0) + 1e-7, 4)'
        f' AS "{name.format(amount=amount, by=by, value=v)}"'
        for v in values
    ]


def sql_by_user(table, columns):
    return f"SELECT user_id, {', '.join(columns)} FROM {table} WHERE user_id IS NOT NULL GROUP BY user_id"


MONEY = positions_plan.MONEY
CONVERSION_SQL = [
    f"count(*) FILTER (WHERE NOT coalesce({c} - {c}_enrolled = 0, false))"
    f" AS amount_of_conversions_for_feature_{c}"
    for c in positions_plan.CONVERTED
]
BALANCE_SUM_SQL = [
    s for m in MONEY
    for s in sql_sums(m, "user_balance_type", (1, 2, 4), "{amount}_sum_balance_type_{value}")
]
FREQUENCY_SQL = [
    "count(DISTINCT client_platform_id) AS ids_client_platform_count",
    *sql_flags("instrument_type", TYPES),
    *sql_counts("instrument_type", TYPES, "deals_per_{value}_instr_count"),
    *sql_counts("user_balance_type", (1, 2, 4), "deals_per_balance_type_{value}_count"),
    *sql_counts("position_type", ("long", "short"), "deals_per_position_type_{value}_count"),
    *sql_counts("instrument_dir", ("A", "R"), "deals_per_instr_dir_type_{value}_count"),
    *sql_counts("client_platform_id", range(12), "deals_per_client_platform_{value}_count"),
    *sql_counts("close_reason", REASONS, "{feature}_{value}_count"),
    *sql_counts("instrument_underlying", (*BRANDS, "OTHER"), "{feature}_{value}_count"),
    *sql_counts("leverage", range(1, 8), "{feature}_{value}_count"),
]
POSITION_SQL = [
    *sql_stats(("count", *MONEY), features.POSITION_STATS), *CONVERSION_SQL, *BALANCE_SUM_SQL,
    *FREQUENCY_SQL,
]
EVENT_STATS = ("mean", "median", "max", "min", "q10", "q90")
EVENT_SQL = [
    "count(*) AS ids_events_count",
    *sql_stats(("duration",), EVENT_STATS),
    *sql_sums("duration", "platform_id", range(10), "duration_per_platform_{value}"),
    *sql_counts("platform_id", range(10), "events_per_platform_{value}"),
    *sql_counts("category", ("system", "user"), "{feature}_{value}_count"),
    *sql_counts("name", NAMES, "{feature}_{value}_count"),
]
CLEAN_EVENTS = " clean_events AS (SELECT * REPLACE (coalesce(duration, 0) AS duration) FROM event_rows)"
DEVICES = [f"{s}-{r}" for s in SEGMENTS for r in REASONS]
COUNTRIES = [-1, *[n for n in range(25) if n != 7]]
ATTRIBUTION_SQL = [
    "count(*) AS ids_records_count",
    *sql_counts("client_platform_id", (9, 12, 15), "amount_of_clicks_per_platform_{value}"),
    *sql_counts("aff_id", range(25), "amount_of_clicks_per_aff_{value}"),
    *sql_flags("client_platform_id", (9, 12, 15)),
    *sql_flags("aff_id", range(25)),
    *sql_flags("country_id", COUNTRIES, "is_{feature}_{value}"),
    *sql_flags("device", DEVICES),
]
CLEAN_ATTRIBUTION = (
    " clean_attribution AS (SELECT * REPLACE (coalesce(country_id, -1) AS country_id) FROM attribution)"
)
