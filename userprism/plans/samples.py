"""The four logs as views of the order and event tables, for checks and the benchmark.

The same definitions are written as SQL in ``LOGS_SQL``.
"""

from pyspark.sql import functions as F

from ..operators import scale

# Brands standing in for the instruments kept by name.
BRANDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#5", "Brand#8", "Brand#13", "Brand#21")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_table(spark, sf_dir, name, key):
    return scale.join_side(table(spark, sf_dir, name), key)


def positions(spark, sf_dir):
    """One row per order line; lines of 50 units are repeated to give duplicates."""
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(joined_table(spark, sf_dir, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(joined_table(spark, sf_dir, "part", "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    )
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    status = F.col("o_orderstatus")
    rows = joined.select(
        F.col("o_custkey").alias("user_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position_id"),
        (F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("user_balance_id"),
        F.when(status == "F", 1).when(status == "O", 4).otherwise(2).cast("long").alias("user_balance_type"),
        F.col("p_type").alias("instrument_type"),
        F.col("p_brand").alias("instrument_underlying"),
        (F.col("p_partkey") % 178).alias("instrument_active_id"),
        (F.col("l_suppkey") % 12).alias("client_platform_id"),
        F.when(F.col("l_linestatus") == "F", "long").otherwise("short").alias("position_type"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("instrument_dir"),
        F.col("o_orderpriority").alias("close_reason"),
        F.col("l_linenumber").cast("long").alias("leverage"),
        F.col("l_quantity").alias("count"),
        price.alias("buy_amount"),
        (price * (1 - F.col("l_discount"))).alias("buy_amount_enrolled"),
        F.col("o_totalprice").alias("sell_amount"),
        F.when(tax > 0.02, F.col("o_totalprice")).alias("sell_amount_enrolled"),
        (price * tax).alias("pnl_realized"),
        (price * tax).alias("pnl_realized_enrolled"),
        (price * F.col("l_discount")).alias("pnl_total"),
        F.when(tax > 0.05, price * F.col("l_discount")).otherwise(0.0).alias("pnl_total_enrolled"),
        F.col("l_discount").alias("close_effect_amount"),
        F.col("p_retailprice").alias("close_underlying_price"),
        (F.col("p_retailprice") + tax).alias("open_underlying_price"),
        F.when(F.col("l_returnflag") == "A", F.col("p_size").cast("double")).alias("instrument_strike"),
        F.when(tax > 0, tax).alias("volatility"),
        F.lit(None).cast("double").alias("take_profit_at"),
    )
    return rows.withColumn(
        "copy", F.explode(F.when(F.col("count") == 50, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    ).drop("copy")


def events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").alias("time"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "error", "system").otherwise("user").alias("category"),
        (k % 10).alias("platform_id"),
        F.when(k % 11 != 0, F.col("value")).alias("duration"),
        F.when(k % 13 != 0, F.col("props")).alias("parameters"),
    )


def attribution(spark, sf_dir):
    """One row per order with the customer's properties."""
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .join(joined_table(spark, sf_dir, "customer", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.when(status == "F", 9).when(status == "O", 12).otherwise(15).cast("long").alias("client_platform_id"),
            F.nullif(F.col("c_nationkey"), F.lit(7)).cast("double").alias("country_id"),
            F.concat_ws("-", "c_mktsegment", "o_orderpriority").alias("device"),
            F.col("c_nationkey").cast("long").alias("aff_id"),
            F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("media_source"),
        )
    )


def deposits(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_totalprice") > 497000)
        .select(
            F.col("o_custkey").alias("user_id"),
            F.when(F.col("o_orderstatus") == "F", 9).otherwise(15).cast("long").alias("client_platform_id"),
        )
    )


def likely_deposits(spark, sf_dir):
    """Deposits for the model queries: most large orders, so that the label is neither rare nor certain."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 450000 AND o_orderkey % 10 <> 0").select(
        F.col("o_custkey").alias("user_id")
    )


def logs(spark, sf_dir):
    """Deposits, positions, attribution, events."""
    return deposits(spark, sf_dir), positions(spark, sf_dir), attribution(spark, sf_dir), events(spark, sf_dir)


LOGS_SQL = """
position_rows AS (
  SELECT o_custkey AS user_id, l_orderkey * 10 + l_linenumber AS position_id,
    o_custkey * 10 + o_orderkey % 3 AS user_balance_id,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 4 ELSE 2 END::BIGINT AS user_balance_type,
    p_type AS instrument_type, p_brand AS instrument_underlying,
    p_partkey % 178 AS instrument_active_id, l_suppkey % 12 AS client_platform_id,
    CASE l_linestatus WHEN 'F' THEN 'long' ELSE 'short' END AS position_type,
    nullif(l_returnflag, 'N') AS instrument_dir, o_orderpriority AS close_reason,
    l_linenumber::BIGINT AS leverage, l_quantity AS "count",
    l_extendedprice AS buy_amount, l_extendedprice * (1 - l_discount) AS buy_amount_enrolled,
    o_totalprice AS sell_amount, CASE WHEN l_tax > 0.02::DOUBLE THEN o_totalprice END AS sell_amount_enrolled,
    l_extendedprice * l_tax AS pnl_realized, l_extendedprice * l_tax AS pnl_realized_enrolled,
    l_extendedprice * l_discount AS pnl_total,
    CASE WHEN l_tax > 0.05::DOUBLE THEN l_extendedprice * l_discount ELSE 0.0::DOUBLE END AS pnl_total_enrolled,
    l_discount AS close_effect_amount, p_retailprice AS close_underlying_price,
    p_retailprice + l_tax AS open_underlying_price,
    CASE WHEN l_returnflag = 'A' THEN p_size::DOUBLE END AS instrument_strike,
    CASE WHEN l_tax > 0 THEN l_tax END AS volatility
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
positions AS (
  SELECT * FROM position_rows
  UNION ALL
  SELECT * FROM position_rows WHERE "count" = 50
),
clean_positions AS (
  SELECT * REPLACE (
    coalesce(instrument_strike, 0) AS instrument_strike,
    CASE WHEN instrument_underlying IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5', 'Brand#8', 'Brand#13', 'Brand#21')
      THEN instrument_underlying ELSE 'OTHER' END AS instrument_underlying)
  FROM (SELECT DISTINCT * FROM positions)
),
raw_events AS (
  SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events
),
event_rows AS (
  SELECT event_id, user_id, ts AS time, event_type AS name,
    CASE WHEN event_type = 'error' THEN 'system' ELSE 'user' END AS category,
    k % 10 AS platform_id, CASE WHEN k % 11 <> 0 THEN value END AS duration,
    CASE WHEN k % 13 <> 0 THEN props END AS parameters
  FROM raw_events
),
attribution AS (
  SELECT o_custkey AS user_id,
    CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 12 ELSE 15 END::BIGINT AS client_platform_id,
    nullif(c_nationkey, 7)::DOUBLE AS country_id,
    c_mktsegment || '-' || o_orderpriority AS device, c_nationkey::BIGINT AS aff_id,
    CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS media_source
  FROM orders JOIN customer ON o_custkey = c_custkey
),
deposits AS (
  SELECT o_custkey AS user_id,
    CASE o_orderstatus WHEN 'F' THEN 9 ELSE 15 END::BIGINT AS client_platform_id
  FROM orders WHERE o_totalprice > 497000
)
"""
