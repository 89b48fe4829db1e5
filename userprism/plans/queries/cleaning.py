"""Reading, cleaning and bucketing."""

import uuid

from pyspark.sql import functions as F

from ...operators import cleaning, scale
from ...sources import logs, schemas
from .. import attribution as attribution_plan
from .. import events as events_plan
from .. import samples
from ..samples import BRANDS
from .registry import near_all, query


AUDITED = ("instrument_dir", "sell_amount_enrolled", "instrument_strike", "volatility", "buy_amount")


@query(
    "null_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing,
        count(*) AS "rows", bool_or({c} IS NULL) AS has_missing FROM positions"""
        for c in AUDITED
    ),
)
def null_audit(spark, sf_dir):
    return cleaning.null_audit(samples.positions(spark, sf_dir).select(*AUDITED))


@query(
    "delimited_read",
    """SELECT user_id, time, name, category, platform_id, NULL::VARCHAR AS device_id, duration,
    parameters FROM event_rows""",
)
def delimited_read(spark, sf_dir):
    """The events written as tab-separated text, with gaps as NA, and read as a log."""
    folder = f"{scale.shared_dir(spark)}/events-{uuid.uuid4().hex}"
    rows = samples.events(spark, sf_dir).withColumn("device_id", F.lit(None).cast("string"))
    writer = rows.select(*schemas.EVENTS.names).write
    writer = writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writer.csv(folder, sep="\t", header=True, nullValue="NA", escape='"')
    return logs.read_delimited(spark, folder, schemas.EVENTS)


@query(
    "shape_audit",
    """SELECT 'read' AS step, count(*) AS "rows", 26 AS "columns" FROM positions
    UNION ALL SELECT 'de-duplicated', count(*), 26 FROM clean_positions""",
)
def shape_audit(spark, sf_dir):
    return cleaning.shape_audit(samples.positions(spark, sf_dir).drop("take_profit_at"))


@query(
    "dedup",
    """SELECT DISTINCT user_id, position_id, user_balance_type, instrument_dir, "count", buy_amount,
    volatility FROM positions""",
)
def dedup(spark, sf_dir):
    rows = samples.positions(spark, sf_dir).select(
        "user_id", "position_id", "user_balance_type", "instrument_dir", "count", "buy_amount",
        "volatility",
    )
    return cleaning.drop_repeats(rows)


@query(
    "const_fill",
    """SELECT event_id, user_id, coalesce(duration, 0) AS duration,
    coalesce(parameters, '{}') AS parameters FROM event_rows""",
)
def const_fill(spark, sf_dir):
    rows = events_plan.clean_events(samples.events(spark, sf_dir))
    return rows.select("event_id", "user_id", "duration", "parameters")


@query(
    "mean_impute",
    """SELECT position_id, round(coalesce(volatility, (SELECT avg(volatility) FROM rows_)) + 1e-7, 5)
    AS volatility FROM rows_""",
    " rows_ AS (SELECT DISTINCT position_id, user_id, volatility FROM positions)",
)
def mean_impute(spark, sf_dir):
    rows = samples.positions(spark, sf_dir).select("position_id", "user_id", "volatility")
    filled = cleaning.fill_mean(cleaning.drop_repeats(rows), ["volatility"])
    return near_all(filled.select("position_id", "volatility"), 5)


@query(
    "rare_bucket",
    """SELECT user_id, client_platform_id,
    CASE WHEN aff_id IN (SELECT aff_id FROM attribution GROUP BY 1 HAVING count(*) > 600)
      THEN aff_id ELSE 99999 END AS aff_id,
    CASE WHEN device IN (SELECT device FROM attribution GROUP BY 1 HAVING count(*) > 600)
      THEN device ELSE 'Other' END AS device,
    CASE WHEN coalesce(country_id, -1) IN
        (SELECT coalesce(country_id, -1) FROM attribution GROUP BY 1 HAVING count(*) > 600)
      THEN coalesce(country_id, -1) ELSE 999 END AS country_id,
    coalesce(media_source, 'Unknown') AS media_source
    FROM attribution""",
)
def rare_bucket(spark, sf_dir):
    rows = attribution_plan.clean_attribution(samples.attribution(spark, sf_dir), 600)
    return rows.select(
        "user_id", "client_platform_id", "aff_id", "device", "country_id", "media_source"
    )


@query("whitelist_bucket", "SELECT position_id, instrument_underlying FROM clean_positions")
def whitelist_bucket(spark, sf_dir):
    rows = cleaning.drop_repeats(samples.positions(spark, sf_dir))
    bucketed = cleaning.bucket_others(rows, "instrument_underlying", BRANDS)
    return bucketed.select("position_id", "instrument_underlying")


@query(
    "category_values",
    " UNION ".join(
        f"SELECT '{c}' AS feature, {c}::VARCHAR AS value FROM positions WHERE {c} IS NOT NULL"
        for c in ("instrument_type", "instrument_dir", "leverage", "close_reason", "client_platform_id")
    ),
)
def category_values(spark, sf_dir):
    return cleaning.category_values(
        samples.positions(spark, sf_dir),
        ["instrument_type", "instrument_dir", "leverage", "close_reason", "client_platform_id"],
    )
