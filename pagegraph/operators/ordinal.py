"""Global ordinals and exact ranks without moving all rows to one task.

Rows are range-partitioned by the order, counted by partition, and numbered within it; only one count a
partition is summed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def global_ordinal(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``name``: 1-based position in the order. The order should be total, else ties fall as they come."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__pg_o{i}" for i in range(len(order))]
    dealt = df.select("*", *(o.alias(k) for o, k in zip(order, keys, strict=True))).repartitionByRange(n, *keys)
    dealt = stage(dealt.withColumn("__pg_part", F.spark_partition_id()), "ordinal")
    counts = dealt.groupBy(F.col("__pg_part").alias("__pg_p2")).count()
    before = F.sum("count").over(Window.orderBy("__pg_p2").rowsBetween(Window.unboundedPreceding, -1))
    counts = F.broadcast(counts.select("__pg_p2", F.coalesce(before, F.lit(0)).alias("__pg_before")))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("__pg_part").orderBy(*keys))
    return dealt.withColumn("__pg_nth", nth).join(counts, F.col("__pg_part") == F.col("__pg_p2")).select(*df.columns, (F.col("__pg_before") + F.col("__pg_nth")).alias(name))


def exact_percentiles(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """One row of order statistics at floor(p * (n - 1) + 0.5), of positive values; 0.0 if there are none.

    Equal values are counted before anything is ordered, so the ordered side holds distinct values only.
    """
    each = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("v")).count()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(each.repartitionByRange(n, "v").withColumn("p", F.spark_partition_id()), "percentiles")
    parts = dealt.groupBy(F.col("p").alias("p2")).agg(F.sum("count").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("p2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("p2", before.alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    upto = F.sum("count").over(Window.partitionBy("p").orderBy("v"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(parts), F.col("p") == F.col("p2"))
    ranked = ranked.select("v", (F.col("before") + F.col("upto")).alias("last"), (F.col("before") + F.col("upto") - F.col("count") + 1).alias("first"), "n")
    rank = lambda p: F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) + 1
    picks = [F.max(F.when(rank(p).between(F.col("first"), F.col("last")), F.col("v"))) for p in points.values()]
    return ranked.agg(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in zip(points, picks, strict=True)])
