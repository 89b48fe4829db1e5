"""Features of the app events log."""

from ..operators import cleaning
from ..operators.features import CountBy, FeatureSpec, Stats, SumBy, build_features
from ..operators.quantiles import HEAVY_ROWS
from ..operators.scale import stage


def clean_events(df):
    return cleaning.fill_missing(df, {"duration": 0.0, "parameters": "{}"})


def event_spec():
    # The names of the features.
    return FeatureSpec(
        rows="ids_events_count",
        parts=(
            Stats(("duration",), ("mean", "median", "max", "min", "q10", "q90")),
            SumBy("duration", "platform_id", name="duration_per_platform_{value}"),
            CountBy("platform_id", name="events_per_platform_{value}"),
            CountBy("category"),
            CountBy("name"),
        ),
    )


def event_rows(df):
    """The rows and the spec of the events features.

    The used columns of the cleaned log are staged: value lists, row counts and two aggregates
    read them, and the log itself is parsed once.
    """
    rows = stage(clean_events(df).select("user_id", "duration", "platform_id", "category", "name"))
    return rows, event_spec()


def event_features(df, heavy_rows=HEAVY_ROWS):
    """One row per events user."""
    return build_features(*event_rows(df), heavy_rows)
