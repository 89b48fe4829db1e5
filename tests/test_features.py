import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import bag, by_key
from userprism.operators import features as ft
from userprism.plans import attribution, events, positions, training
from userprism.sources import schemas


def rows_of(schema, records):
    return [tuple(r.get(f.name) for f in schema.fields) for r in records]


@pytest.fixture(scope="module")
def position_records():
    """Three users; user 1 holds most rows; repeats, gaps and a missing id included."""
    records = []
    for i in range(60):
        user = 1 if i % 3 else (2 if i % 2 else 3)
        records.append(
            dict(
                user_id=user, user_balance_id=user * 10 + i % 2, user_balance_type=1 if i % 4 else 4,
                instrument_type="turbo" if i % 5 else "digital",
                instrument_underlying=["EURUSD", "XAU", None][i % 3], instrument_active_id=i % 7,
                client_platform_id=i % 4, position_type="long" if i % 2 else "short",
                instrument_dir=[None, "call", "put"][i % 3], close_reason="win" if i % 2 else "loose",
                leverage=1 + i % 3, count=float(i % 6), buy_amount=i * 1.5,
                buy_amount_enrolled=None if i % 9 == 0 else i * 1.5 + (i % 2),
                sell_amount=float(i), sell_amount_enrolled=float(i), pnl_realized=i / 4,
                pnl_realized_enrolled=i / 4, pnl_total=-i / 8, pnl_total_enrolled=-i / 8 + 1,
                close_effect_amount=float(i % 3), close_underlying_price=1.1,
                open_underlying_price=1.2 + i % 2, instrument_strike=None if i % 2 else float(i),
                volatility=None if i % 3 else 0.5,
            )
        )
    return records + records[:7] + [dict(records[0], user_id=None)]


@pytest.fixture(scope="module")
def position_log(spark, position_records):
    return spark.createDataFrame(rows_of(schemas.POSITIONS, position_records), schemas.POSITIONS)


def brute_force(records):
    """The expected position features, with pandas over the small fixture."""
    df = pd.DataFrame([{f.name: r.get(f.name) for f in schemas.POSITIONS.fields} for r in records])
    df = df.drop_duplicates()
    df["instrument_strike"] = df["instrument_strike"].astype(float).fillna(0)
    df["instrument_underlying"] = df["instrument_underlying"].where(
        df["instrument_underlying"].isin(positions.INSTRUMENTS), "OTHER"
    )
    expected = {}
    for user, g in df[df.user_id.notna()].groupby("user_id"):
        row = {}
        for c in ("count", *positions.MONEY):
            v = g[c].astype(float)
            row |= {
                f"{c}_mean": v.mean(), f"{c}_median": v.median(), f"{c}_max": v.max(), f"{c}_min": v.min(),
                **{f"{c}_q{int(p * 100)}": v.quantile(p) for p in (0.1, 0.25, 0.75, 0.9)},
            }
        for c in positions.CONVERTED:
            same = (g[c].astype(float) - g[f"{c}_enrolled"].astype(float)) == 0
            row[f"amount_of_conversions_for_feature_{c}"] = int((~same).sum())
        for c in positions.MONEY:
            for b in (1, 4):
                row[f"{c}_sum_balance_type_{b}"] = g.loc[g.user_balance_type == b, c].astype(float).sum()
        row["ids_client_platform_count"] = g.client_platform_id.nunique()
        templates = {
            "instrument_type": "deals_per_{}_instr_count",
            "user_balance_type": "deals_per_balance_type_{}_count",
            "position_type": "deals_per_position_type_{}_count",
            "instrument_dir": "deals_per_instr_dir_type_{}_count",
            "client_platform_id": "deals_per_client_platform_{}_count",
            "close_reason": "close_reason_{}_count",
            "instrument_underlying": "instrument_underlying_{}_count",
            "leverage": "leverage_{}_count",
        }
        for c, template in templates.items():
            for v in df[c].dropna().unique():
                row[template.format(v)] = int((g[c] == v).sum())
        for v in df.instrument_type.unique():
            row[f"uses_instrument_type_{v}"] = int((g.instrument_type == v).any())
        expected[int(user)] = row
    return expected


@pytest.mark.parametrize("heavy_rows", [10**6, 15])
def test_position_features_match_brute_force(position_log, position_records, heavy_rows):
    expected = brute_force(position_records)
    found = by_key(positions.position_features(position_log, heavy_rows=heavy_rows))
    assert set(found) == set(expected)
    for user, row in expected.items():
        assert set(found[user]) == {*row, "user_id"}
        for name, value in row.items():
            assert math.isclose(found[user][name], value, abs_tol=1e-9), (user, name)


def test_counts_over_values_add_up(position_log):
    spec = ft.FeatureSpec(
        rows="deals", parts=(ft.CountBy("instrument_dir", null_name="missing"), ft.FlagBy("instrument_dir"))
    )
    for row in by_key(ft.build_features(position_log, spec)).values():
        counts = {n: v for n, v in row.items() if n.endswith("_count")}
        assert sum(counts.values()) == row["deals"]
        for v in ("call", "put"):
            assert row[f"uses_instrument_dir_{v}"] == int(row[f"instrument_dir_{v}_count"] > 0)


def test_missing_category_has_no_column_by_default(position_log):
    spec = ft.FeatureSpec(parts=(ft.CountBy("instrument_dir"),))
    assert ft.build_features(position_log, spec).columns == [
        "user_id", "instrument_dir_call_count", "instrument_dir_put_count",
    ]


def test_all_missing_numbers(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a")], "user_id long, v double, c string")
    spec = ft.FeatureSpec(parts=(ft.Stats(("v",), ("mean", "median")), ft.SumBy("v", "c")))
    assert ft.build_features(df, spec).first() == (1, None, None, 0.0)


def test_equal_values_of_two_features_stay_apart(spark):
    df = spark.createDataFrame([(1, "x", "x")], "user_id long, a string, b string")
    spec = ft.FeatureSpec(parts=(ft.FlagBy("a"), ft.FlagBy("b")))
    assert ft.build_features(df, spec).columns == ["user_id", "uses_a_x", "uses_b_x"]
    with pytest.raises(ValueError, match="used twice"):
        ft.build_features(df, ft.FeatureSpec(parts=(ft.FlagBy("a", name="uses_{value}"), ft.FlagBy("b", name="uses_{value}"))))


def test_odd_values_become_names(spark):
    df = spark.createDataFrame(
        [(1, "AUDCAD-OTC", 2.5), (1, "it's.a`b", 840.0), (2, "back\\slash", None)],
        "user_id long, c string, d double",
    )
    spec = ft.FeatureSpec(parts=(ft.CountBy("c"), ft.CountBy("d")))
    found = by_key(ft.build_features(df, spec))
    assert found[1]["c_AUDCAD-OTC_count"] == 1 and found[1]["c_it's.a`b_count"] == 1
    assert found[2]["c_back\\slash_count"] == 1
    assert found[1]["d_840_count"] == 1 and found[1]["d_2.5_count"] == 1


def test_many_values_are_pivoted_alike(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("user_id"),
        (F.col("id") * 31 % 90).alias("c"),
    )
    spec = ft.FeatureSpec(parts=(ft.CountBy("c"),))
    wide = by_key(ft.build_features(df, spec))
    assert len(next(iter(wide.values()))) == 91
    pairs = bag(ft.count_pairs(df, "user_id", ["c"]))
    assert sum(n for *_, n in pairs) == 2000
    for user, _, value, n in pairs:
        assert wide[user][f"c_{value}_count"] == n


def test_too_many_values_raise(spark):
    df = spark.range(50).select(F.lit(1).alias("user_id"), F.col("id").alias("c"))
    with pytest.raises(ValueError, match="bucket"):
        ft.discover_values(df, ["c"], limit=49)
    assert ft.discover_values(df, ["c"], limit=50) == {"c": tuple(range(50))}


def test_exploration_features(position_log):
    found = by_key(positions.exploration_features(position_log))
    assert found[1]["ids_deals_count"] == 40 and found[1]["ids_balances_count"] == 2
    assert found[1]["has_balance_type_1"] == 1 and "instrument_active_id_6_count" in found[1]


@pytest.fixture(scope="module")
def other_logs(spark):
    from datetime import datetime

    day = datetime(2019, 9, 1)
    event_rows = [
        dict(user_id=1, time=day, name="login", category="a", platform_id=9, duration=2.0),
        dict(user_id=1, time=day, name="chart", category="a", platform_id=12, duration=None),
        dict(user_id=7, time=day, name="login", category="b", platform_id=9, duration=5.0, parameters='{"k": 1}'),
        dict(user_id=None, time=day, name="login", category="b", platform_id=9, duration=5.0),
    ]
    clicks = [
        dict(user_id=1, client_platform_id=9, country_id=None, device="d1", aff_id=1),
        dict(user_id=2, client_platform_id=9, country_id=5.0, device="d2", aff_id=1),
        dict(user_id=2, client_platform_id=2, country_id=5.0, device="d2", aff_id=2),
    ]
    return (
        spark.createDataFrame(rows_of(schemas.EVENTS, event_rows), schemas.EVENTS),
        spark.createDataFrame(rows_of(schemas.ATTRIBUTION, clicks), schemas.ATTRIBUTION),
        spark.createDataFrame([(1, 9), (1, 9), (99, 9), (None, 9)], schemas.DEPOSITS),
    )


def test_event_features(other_logs):
    found = by_key(events.event_features(other_logs[0]))
    assert set(found) == {1, 7}
    one = found[1]
    assert (one["ids_events_count"], one["duration_mean"], one["duration_q90"]) == (2, 1.0, 1.8)
    assert (one["duration_per_platform_9"], one["duration_per_platform_12"]) == (2.0, 0.0)
    assert (one["name_login_count"], one["category_b_count"], one["events_per_platform_9"]) == (1, 0, 1)


def test_attribution_features(other_logs):
    found = by_key(attribution.attribution_features(other_logs[1], min_count=1))
    assert found[1] == {
        "user_id": 1, "ids_records_count": 1, "amount_of_clicks_per_platform_2": 0,
        "amount_of_clicks_per_platform_9": 1, "amount_of_clicks_per_aff_1": 1,
        "amount_of_clicks_per_aff_99999": 0, "uses_client_platform_id_2": 0,
        "uses_client_platform_id_9": 1, "uses_aff_id_1": 1, "uses_aff_id_99999": 0,
        "is_country_id_5": 0, "is_country_id_999": 1, "uses_device_Other": 1, "uses_device_d2": 0,
    }
    assert found[2]["amount_of_clicks_per_aff_99999"] == 1


def test_training_table_keeps_exactly_the_positions_users(position_log, other_logs):
    event_log, clicks, deposits = other_logs
    table = training.training_table(deposits, position_log, clicks, event_log, min_count=1)
    found = by_key(table)
    assert set(found) == {1, 2, 3}
    assert [found[u]["target"] for u in (1, 2, 3)] == [1, 0, 0]
    assert found[3]["ids_events_count"] == 0 and found[3]["ids_records_count"] == 0
    assert all(v is not None for row in found.values() for v in row.values())
    unlabelled = training.training_table(deposits, position_log, clicks, event_log, add_target=False, min_count=1)
    assert "target" not in unlabelled.columns
    kept = training.model_columns(table, ["ids_events_count", "count_mean"])
    assert kept.columns[:2] == ["ids_events_count", "count_mean"]
    assert len(set(kept.columns)) == len(kept.columns)
