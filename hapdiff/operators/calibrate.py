"""Empirical p values against a pooled null, and false discovery rates, without ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statistics are ranked within bins of their size; each bin's offset is the count of the bins above it.
BINS_PER_UNIT, MOST_BINS = 64, 16_384


def _bin(x: Column) -> Column:
    return F.least(F.floor(x * BINS_PER_UNIT), F.lit(MOST_BINS)).cast("int")


def empirical_p(observed: DataFrame, null: DataFrame, statistic: str = "wald") -> DataFrame:
    """observed with empirical_p_value, (null values at least as large in size + 1) / (null values + 1), and null_pool_size.

    Null values that aren't finite don't count; without any p is 1. An observed value that isn't finite has no p.
    """
    size = F.abs(F.col(statistic))
    pool = null.select(size.alias("_x")).filter(F.col("_x") < float("inf")).withColumn("_b", _bin(F.col("_x")))
    per_bin = pool.groupBy("_b").agg(F.count("*").alias("_n"))
    above = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)  # a row for each bin: at most MOST_BINS
    own = observed.withColumn("_x", F.when(size < float("inf"), size)).withColumn("_b", _bin(F.col("_x")))
    bins = own.select("_b").filter("_b is not null").distinct().join(per_bin, "_b", "full").withColumn("_n", F.coalesce("_n", F.lit(0)))
    bins = bins.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    key = [c for c in observed.columns]
    both = own.select(F.struct(*key).alias("_row"), "_x", "_b").unionByName(
        pool.select(F.lit(None).cast(own.select(F.struct(*key).alias("r")).schema["r"].dataType).alias("_row"), "_x", "_b")
    )
    # equal sizes are peers: the default frame of an ordered window counts them all
    w = W.partitionBy("_b").orderBy(F.col("_x").desc())
    ranked = both.withColumn("_in", F.count_if(F.col("_row").isNull()).over(w)).filter("_row is not null")
    total = pool.agg(F.count("*").alias("null_pool_size"))
    out = ranked.join(bins.select("_b", "_above"), "_b", "left").crossJoin(F.broadcast(total))
    p = F.when(F.col("null_pool_size") == 0, 1.0).when(F.col("_x").isNotNull(), (F.col("_above") + F.col("_in") + 1) / (F.col("null_pool_size") + 1))
    return out.select("_row.*", p.alias("empirical_p_value"), "null_pool_size")


def false_discovery(df: DataFrame, p: str = "empirical_p_value", name: str = "fdr") -> DataFrame:
    """df and the Benjamini-Hochberg adjustment of p; a null p has none.

    Equal p have equal adjustments, so the table of distinct p with its ranks is what is ordered, in bins.
    """
    values = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_k")).withColumn("_b", F.floor(F.col("_p") * 4096).cast("int"))
    per_bin = values.groupBy("_b").agg(F.sum("_k").alias("_kb"))
    before = per_bin.withColumns({"_off": F.sum("_kb").over(W.orderBy("_b")) - F.col("_kb"), "_n": F.sum("_kb").over(W.partitionBy())}).drop("_kb")
    ranked = values.join(before, "_b")
    rank = F.col("_off") + F.sum("_k").over(W.partitionBy("_b").orderBy("_p"))
    ranked = ranked.withColumn("_a", F.col("_p") * F.col("_n") / rank)
    later = ranked.groupBy("_b").agg(F.min("_a").alias("_m"))
    later = later.withColumn("_later", F.min("_m").over(W.orderBy("_b").rowsBetween(1, W.unboundedFollowing))).drop("_m")
    own = F.min("_a").over(W.partitionBy("_b").orderBy("_p").rowsBetween(W.currentRow, W.unboundedFollowing))
    table = ranked.join(later, "_b").select("_p", F.least(F.lit(1.0), own, F.coalesce("_later", F.lit(1.0))).alias(name))
    return df.join(table, F.col(p) == F.col("_p"), "left").drop("_p")
