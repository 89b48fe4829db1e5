from pyspark.sql import functions as F

from conftest import bag
from userprism.functions import scalars
from userprism.operators import cleaning


def test_repeats_with_missing_values_are_one_row(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, None, nan), (1, None, nan), (2, "a", 1.0), (2, "a", 1.0), (2, "a", 2.0)],
        "user_id long, t string, v double",
    )
    assert cleaning.drop_repeats(df).count() == 3
    shape = {r.step: (r["rows"], r["columns"]) for r in cleaning.shape_audit(df).collect()}
    assert shape == {"read": (5, 3), "de-duplicated": (3, 3)}


def test_null_audit(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert bag(cleaning.null_audit(df)) == [("a", 0, 2, False), ("b", 1, 2, True)]


def test_fill_mean_skips_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "id long, v double")
    assert bag(cleaning.fill_mean(df, ["v"])) == [(1, 1.0), (2, 2.5), (3, 4.0)]


def test_fill_zero_fills_numbers_only(spark):
    df = spark.createDataFrame([(None, float("nan"), None)], "a long, b double, c string")
    assert cleaning.fill_zero(df).first() == (0, 0.0, None)


def test_constant_fill(spark):
    df = spark.createDataFrame([(None, None)], "duration double, parameters string")
    filled = cleaning.fill_missing(df, {"duration": 0.0, "parameters": "{}"})
    assert filled.first() == (0.0, "{}")


def test_rare_values_are_replaced_up_to_exactly_the_threshold(spark):
    kept = spark.range(101).select(F.lit("kept").alias("v"), F.lit(1).cast("long").alias("n"))
    rare = spark.range(100).select(F.lit("rare").alias("v"), F.lit(2).cast("long").alias("n"))
    gaps = spark.range(200).select(F.lit(None).cast("string").alias("v"), F.lit(None).cast("long").alias("n"))
    df = kept.union(rare).union(gaps)
    counts = cleaning.bucket_rare(df, {"v": "Other", "n": 99999}).groupBy("v", "n").count()
    assert bag(counts) == [("Other", 99999, 300), ("kept", 1, 101)]


def test_listed_values_are_kept(spark):
    df = spark.createDataFrame([("EURUSD",), ("XAU",), (None,)], "v string")
    assert bag(cleaning.bucket_others(df, "v", ["EURUSD"])) == [("EURUSD",), ("OTHER",), ("OTHER",)]


def test_category_values_leave_out_missing(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 1.0)], "c string, d double")
    assert bag(cleaning.category_values(df, ["c", "d"])) == [("c", "a"), ("c", "b"), ("d", "1.0")]


def test_keep_columns_once(spark):
    df = spark.createDataFrame([(1, 2, 0, 9)], "a int, b int, target int, user_id int")
    names = ["b", "a", "b"]
    assert cleaning.keep_columns(df, names).columns == ["b", "a", "target", "user_id"]
    assert names == ["b", "a", "b"]


def test_normalize_missing(spark):
    df = spark.createDataFrame([(float("nan"), "NA"), (1.0, "x")], "v double, t string")
    assert bag(cleaning.normalize_missing(df, ["NA"])) == [(1.0, "x"), (None, None)]


def test_epoch_seconds_round_down_in_any_zone(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'1969-12-31 23:59:58.5'), "
        "(TIMESTAMP_NTZ'2019-10-03 10:20:30.9'), (NULL) AS t(time)"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            found = [tuple(r)[1:] for r in scalars.date_parts(df).collect()]
            assert found == [
                (12, 1969, 31, -2.0), (10, 2019, 3, 1570098030.0), (None, None, None, None),
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_text_times_are_parsed(spark):
    df = spark.createDataFrame([("2019-09-01 00:00:01",)], "time string")
    row = scalars.date_parts(df).first()
    assert (row.month, row.timestamp_sec) == (9, 1567296001.0)


def test_recodes(spark):
    df = spark.createDataFrame([(1,), (4,), (None,)], "v long")
    found = df.select(scalars.balance_label(F.col("v")), scalars.category_label(F.col("v")))
    assert bag(found) == [
        ("Real_money", "cat_id_1"), ("Whatever_else", "cat_id_4"), ("Whatever_else", "cat_id_nan"),
    ]


def test_missing_enrolled_amount_counts_as_converted(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None), (None, None)], "a double, b double")
    flags = df.select(scalars.conversion_flag(F.col("a"), F.col("b")).alias("f"))
    assert [r.f for r in flags.collect()] == [0, 1, 1, 1]
