"""Features of the trading positions log."""

from ..functions.scalars import conversion_flag
from ..operators import cleaning
from ..operators.features import (
    CountBy, CountWhere, DistinctCount, FeatureSpec, FlagBy, Stats, SumBy, build_features,
)
from ..operators.quantiles import HEAVY_ROWS
from ..operators.scale import col, stage

# Columns that are almost entirely missing.
SPARSE = (
    "take_profit_at", "stop_lose_at", "take_profit_date", "stop_lose_date",
    "spread_total_enrolled", "instrument_expiration",
)
# Instruments kept by name.
INSTRUMENTS = ("EURUSD", "GBPJPY", "AUDCAD-OTC", "EURJPY", "EURGBP-OTC", "AUDCAD", "USDJPY")
# Amounts, amounts that may be converted, categories.
MONEY = (
    "buy_amount", "sell_amount", "pnl_realized", "close_effect_amount", "pnl_total",
    "close_underlying_price", "open_underlying_price", "instrument_strike",
)
CONVERTED = ("buy_amount", "sell_amount", "pnl_realized", "pnl_total")
CATEGORIES = (
    "instrument_type", "user_balance_type", "position_type", "instrument_dir", "client_platform_id",
    "close_reason", "instrument_underlying", "leverage",
)

# Columns that the features read.
USED = ("user_id", "count", *MONEY, *[f"{c}_enrolled" for c in CONVERTED], *CATEGORIES)


def clean_positions(df, instruments=INSTRUMENTS):
    """De-duplicated positions with gaps filled and rare instruments bucketed."""
    df = cleaning.drop_present(cleaning.drop_repeats(df, "user_id"), SPARSE)
    df = cleaning.fill_missing(df, {"instrument_strike": 0.0})
    df = cleaning.fill_mean(df, ["volatility"])
    return cleaning.bucket_others(df, "instrument_underlying", instruments)


def number_spec(balance_types=None):
    """Order statistics, conversions and sums per balance type."""
    conversions = tuple(
        CountWhere(
            f"amount_of_conversions_for_feature_{c}",
            f"NOT coalesce({c} - {c}_enrolled = 0, false)",
        )
        for c in CONVERTED
    )
    sums = tuple(
        SumBy(m, "user_balance_type", balance_types, "{amount}_sum_balance_type_{value}")
        for m in MONEY
    )
    return (Stats(("count", *MONEY)), *conversions, *sums)


def frequency_spec():
    """Distinct platforms, instrument flags and deals per category value."""
    return (
        DistinctCount("client_platform_id", "ids_client_platform_count"),
        FlagBy("instrument_type"),
        CountBy("instrument_type", name="deals_per_{value}_instr_count"),
        CountBy("user_balance_type", name="deals_per_balance_type_{value}_count"),
        CountBy("position_type", name="deals_per_position_type_{value}_count"),
        CountBy("instrument_dir", name="deals_per_instr_dir_type_{value}_count"),
        CountBy("client_platform_id", name="deals_per_client_platform_{value}_count"),
        CountBy("close_reason"),
        CountBy("instrument_underlying"),
        CountBy("leverage"),
    )


def extra_flag_spec():
    """Membership flags used in exploration."""
    return (
        FlagBy("user_balance_type", name="has_balance_type_{value}"),
        FlagBy("position_type", name="has_position_type_{value}"),
        FlagBy("instrument_dir", name="has_instr_dir_type_{value}"),
        FlagBy("client_platform_id"),
    )


def position_rows(df, instruments=INSTRUMENTS):
    """The rows and the spec of the positions features.

    The cleaned rows are staged: several aggregates read them, and de-duplication is the most
    expensive step of the plan. Only columns the features use are written.
    """
    rows = stage(clean_positions(df, instruments).select(*USED))
    return rows, FeatureSpec(parts=number_spec() + frequency_spec())


def position_features(df, instruments=INSTRUMENTS, heavy_rows=HEAVY_ROWS):
    """One row per positions user."""
    return build_features(*position_rows(df, instruments), heavy_rows)


def exploration_features(df):
    """The wider exploration table: deals, balances, all flags and unbucketed instruments."""
    used = ["user_id", "user_balance_id", "instrument_active_id", *CATEGORIES]
    rows = stage(cleaning.drop_repeats(df, "user_id").select(*used))
    parts = (
        DistinctCount("user_balance_id", "ids_balances_count"),
        *frequency_spec(),
        *extra_flag_spec(),
        CountBy("instrument_active_id"),
    )
    return build_features(rows, FeatureSpec(rows="ids_deals_count", parts=parts))


def with_conversions(df, features=CONVERTED):
    """0/1 column per amount: whether it differs from its enrolled twin."""
    return df.withColumns(
        {f"{c}_conversion_happened": conversion_flag(col(c), col(f"{c}_enrolled")) for c in features}
    )

