"""Splits and scores."""

from pyspark.sql import functions as F

from ...operators import idsets, metrics, split
from .. import samples
from .idsets import COUNTS
from .registry import query


@query(
    "hash_split",
    """SELECT user_id, substr(md5('test42:' || user_id), 1, 8) < '33333333' AS is_test
    FROM per_user_n""",
    COUNTS,
)
def hash_split(spark, sf_dir):
    users = idsets.distinct_ids(samples.positions(spark, sf_dir))
    train, test = split.hash_split(users)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query(
    "rank_auc",
    """SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
      / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)), 6) AS auc,
    count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives
    FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM (
      SELECT l_extendedprice AS s, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem))""",
)
def rank_auc(spark, sf_dir):
    rows = samples.table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_quantity") > 25).cast("int").alias("target")
    )
    return metrics.rank_auc(rows, "score", digits=6)


@query(
    "accuracy_score",
    """SELECT round(avg(CASE WHEN (l_extendedprice > 50000) = (l_quantity > 25) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)
    AS accuracy FROM lineitem""",
)
def accuracy_score(spark, sf_dir):
    rows = samples.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") > 50000).cast("double").alias("prediction"),
        (F.col("l_quantity") > 25).cast("double").alias("target"),
    )
    return metrics.accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))
