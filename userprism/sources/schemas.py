"""Columns and types of the four logs."""

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType


def _schema(**types):
    kinds = {
        "long": LongType(), "double": DoubleType(), "string": StringType(), "time": TimestampNTZType(),
    }
    return StructType([StructField(name, kinds[kind], True) for name, kind in types.items()])


DEPOSITS = _schema(user_id="long", client_platform_id="long")

POSITIONS = _schema(
    user_id="long",
    user_balance_id="long",
    user_balance_type="long",
    instrument_type="string",
    instrument_underlying="string",
    instrument_active_id="long",
    client_platform_id="long",
    position_type="string",
    instrument_dir="string",
    close_reason="string",
    leverage="long",
    count="double",
    buy_amount="double",
    buy_amount_enrolled="double",
    sell_amount="double",
    sell_amount_enrolled="double",
    pnl_realized="double",
    pnl_realized_enrolled="double",
    pnl_total="double",
    pnl_total_enrolled="double",
    close_effect_amount="double",
    close_underlying_price="double",
    open_underlying_price="double",
    instrument_strike="double",
    volatility="double",
    take_profit_at="double",
    stop_lose_at="double",
    take_profit_date="string",
    stop_lose_date="string",
    spread_total_enrolled="double",
    instrument_expiration="string",
)

EVENTS = _schema(
    user_id="long",
    time="time",
    name="string",
    category="string",
    platform_id="long",
    device_id="string",
    duration="double",
    parameters="string",
)

ATTRIBUTION = _schema(
    user_id="long",
    client_platform_id="long",
    country_id="double",
    device="string",
    os_version="string",
    apps_flyer_device_id="string",
    aff_id="long",
    media_source="string",
)
