"""Features of the install attribution log."""

from ..operators import cleaning
from ..operators.features import CountBy, FeatureSpec, FlagBy, build_features
from ..operators.scale import stage

# Replacements of rare values.
RARE = {"aff_id": 99999, "device": "Other", "country_id": 999}


def filled_attribution(df):
    return cleaning.fill_missing(df, {"country_id": -1, "media_source": "Unknown"})


def frequent_attribution(df, min_count=100):
    """(feature, value, n) of the values that stay, to bucket a later log alike."""
    return cleaning.frequent_values(filled_attribution(df), list(RARE), min_count)


def clean_attribution(df, min_count=100, frequent=None):
    """Gaps filled, then values on at most ``min_count`` rows, or not in ``frequent``, bucketed."""
    return cleaning.bucket_rare(filled_attribution(df), RARE, min_count, frequent)


def attribution_spec():
    # The names of the features.
    return FeatureSpec(
        rows="ids_records_count",
        parts=(
            CountBy("client_platform_id", name="amount_of_clicks_per_platform_{value}"),
            CountBy("aff_id", name="amount_of_clicks_per_aff_{value}"),
            FlagBy("client_platform_id"),
            FlagBy("aff_id"),
            FlagBy("country_id", name="is_{feature}_{value}"),
            FlagBy("device"),
        ),
    )


def attribution_rows(df, min_count=100, frequent=None):
    """The rows and the spec of the attribution features. Bucketed rows are staged for the aggregates after it."""
    used = ["user_id", "client_platform_id", "aff_id", "country_id", "device"]
    rows = stage(clean_attribution(df.select(*used, "media_source"), min_count, frequent).select(*used))
    return rows, attribution_spec()


def attribution_features(df, min_count=100):
    """One row per attribution user; every affiliate, device and country left becomes columns.

    ``training.training_vectors`` holds the same features for any number of them.
    """
    return build_features(*attribution_rows(df, min_count))
