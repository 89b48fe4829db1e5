"""Date parts and JSON properties."""

from pyspark.sql import functions as F

from ...functions import jsonprops, scalars
from .. import samples
from .registry import query


@query(
    "date_parts",
    """SELECT event_id, month(time)::INTEGER AS month, year(time)::INTEGER AS year,
    day(time)::INTEGER AS day, floor(epoch_us(time) / 1e6)::DOUBLE AS timestamp_sec FROM event_rows""",
)
def date_parts(spark, sf_dir):
    return scalars.date_parts(samples.events(spark, sf_dir)).select(
        "event_id", "month", "year", "day", "timestamp_sec"
    )


def json_events(spark, sf_dir):
    """Event properties of every shape: flat, nested, with a list, empty, not an object, broken."""
    kind = F.col("event_type")
    detail = F.struct(F.col("value").alias("amount"), kind.alias("kind"))
    return samples.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", F.to_json(F.struct(F.col("user_id").alias("owner"), detail.alias("detail"))))
        .when(kind == "view", F.to_json(F.struct(F.array("event_id", "user_id").alias("refs"))))
        .when(
            kind == "signup",
            F.to_json(
                F.struct(
                    (F.col("event_id") % 4).alias("balance_type"),
                    F.col("event_id").alias("position_id"),
                    kind.alias("instrument_type"),
                )
            ),
        )
        .when((kind == "purchase") & (F.col("event_id") % 2 == 0), F.to_json(F.array("event_id")))
        .when(kind == "purchase", F.concat(F.lit('{"owner": '), kind))
        .otherwise("{}")
        .alias("parameters"),
    )


@query(
    "json_flatten",
    """SELECT event_id,
    CASE WHEN event_type = 'click' THEN user_id END AS p_owner,
    CASE WHEN event_type = 'click' THEN value END AS p_detail_amount,
    CASE WHEN event_type = 'click' THEN 'click' END AS p_detail_kind,
    CASE WHEN event_type = 'view' THEN event_id END AS p_refs,
    CASE WHEN event_type = 'signup' THEN event_id % 4 END AS p_balance_type,
    CASE WHEN event_type = 'signup' THEN event_id END AS p_position_id,
    CASE WHEN event_type = 'signup' THEN 'signup' END AS p_instrument_type
    FROM events""",
)
def json_flatten(spark, sf_dir):
    rows = json_events(spark, sf_dir)
    return jsonprops.unpack_properties(rows, "parameters", prefix="p_").drop("parameters")


@query(
    "json_keys",
    """SELECT event_id,
    CASE WHEN event_type = 'signup' THEN (event_id % 4)::VARCHAR END AS balance_type,
    CASE WHEN event_type = 'signup' THEN event_id::VARCHAR END AS position_id,
    CASE WHEN event_type = 'signup' THEN 'signup' END AS instrument_type
    FROM events""",
)
def json_keys(spark, sf_dir):
    return jsonprops.extract_keys(json_events(spark, sf_dir), "parameters").drop("parameters")


@query(
    "json_nested",
    """SELECT event_id, CASE WHEN event_type <> 'purchase' THEN event_type = 'click' END AS is_nested
    FROM events""",
)
def json_nested(spark, sf_dir):
    return jsonprops.nested_flag(json_events(spark, sf_dir), "parameters").drop("parameters")


@query(
    "json_status",
    """SELECT CASE WHEN event_type <> 'purchase' THEN 'object' WHEN event_id % 2 = 0 THEN 'other'
    ELSE 'bad' END AS kind, count(*) AS n FROM events GROUP BY 1""",
)
def json_status(spark, sf_dir):
    return jsonprops.json_status(json_events(spark, sf_dir), "parameters")


@query(
    "json_props",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
)
def json_props(spark, sf_dir):
    rows = samples.table(spark, sf_dir, "events").select("event_id", "props")
    return jsonprops.unpack_properties(rows, "props").drop("props")
