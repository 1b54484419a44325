"""Which loci are tested, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.functions.arrays import MAD_SCALE, let, mad

#: Fixed values of the spread: its least value, and the least coverage that limits a weight.
LEAST_SD, LEAST_COVERAGE = 1e-5, 5.0
#: Values are ranked within bins of a 64th; all beyond the outermost bins are in these.
BINS_PER_UNIT, MOST_BINS = 64, 8192


def _covered(group: int, groups: list[int]) -> Column:
    own = [F.get("t", F.lit(k)) for k, g in enumerate(groups) if g == group]
    return sum(own[1:], own[0])


def screen(wide: DataFrame, groups: list[int]) -> DataFrame:
    """The loci of a dense table that both groups cover; groups: 1 or 2 for each sample."""
    return wide.filter((_covered(1, groups) > 0) & (_covered(2, groups) > 0))


def excluded(wide: DataFrame, groups: list[int]) -> DataFrame:
    return wide.filter(~((_covered(1, groups) > 0) & (_covered(2, groups) > 0)))


def coverage_mean() -> Column:
    return F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t")


def quantile(df: DataFrame, value: Column, p: float, name: str) -> DataFrame:
    """One row: the exact p-quantile of value, between its two nearest ranks; null without values.

    Distinct values are counted and ranked within bins of a value's size, whose offsets are summed over at most MOST_BINS rows.
    """
    values = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("k"))
    values = values.withColumn("b", F.least(F.greatest(F.floor(F.col("v") * BINS_PER_UNIT), F.lit(-MOST_BINS)), F.lit(MOST_BINS)).cast("int"))
    bins = values.groupBy("b").agg(F.sum("k").alias("n"))
    bins = bins.select("b", (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    upto = F.col("before") + F.sum("k").over(W.partitionBy("b").orderBy("v"))
    ranked = values.join(F.broadcast(bins), "b").select("v", upto.alias("upto"), ((F.col("total") - 1) * F.lit(p)).alias("at"))
    low, high = (F.min(F.when(F.col("upto") > rank(F.col("at")), F.col("v"))) for rank in (F.floor, F.ceil))
    share = F.first("at") - F.floor(F.first("at"))
    return ranked.agg((low + share * (high - low)).alias(name))


def screen_parameters(kept: DataFrame, min_in_span: float) -> DataFrame:
    """One row: cov_q75, the exact 75 % quantile of mean coverage, and density_span, the mean over chromosomes of
    min_in_span * (max - min + 1) / loci."""
    q = quantile(kept, coverage_mean(), 0.75, "cov_q75")
    span = kept.groupBy("chr").agg((min_in_span * (F.max("pos") - F.min("pos") + 1) / F.count("*")).alias("d")).agg(F.avg("d").alias("density_span"))
    return q.crossJoin(span)


def locus_statistics(kept: DataFrame, plan: DataFrame, parameters: DataFrame) -> DataFrame:
    """For each labelling (perm_id, grp: array of 1 and 2 for each sample) and locus: pooled rates and their
    difference, spreads, coverage, weight and the standardised raw difference. plan and parameters are a few rows.
    """
    df = kept.crossJoin(F.broadcast(plan)).crossJoin(F.broadcast(parameters))
    rows = F.arrays_zip("s", "t", "grp")

    def of(g: int, name: str) -> list[Column]:
        own = F.filter(rows, lambda x: x["grp"] == g)
        total = lambda c: F.aggregate(own, F.lit(0.0), lambda a, x: a + x[c])
        covered = F.filter(own, lambda x: x["t"] > 0)
        return [
            F.when(total("t") > 0, total("s") / total("t")).alias(f"group{g}_pooled"),
            mad(F.transform(covered, lambda x: x["s"] / x["t"])).alias(f"_mad{g}"),
            F.size(covered).alias(f"n_covered_group{g}"),
        ]

    df = df.select("*", *of(1, "a"), *of(2, "b"), coverage_mean().alias("cov_mean"), F.size("t").alias("_n"))
    n1, n2 = F.col("n_covered_group1"), F.col("n_covered_group2")  # a single covered sample has no spread of its own
    m1, m2 = F.col("_mad1"), F.col("_mad2")
    df = df.withColumn("mad_group1", F.when((n1 == 1) & (n2 == 1), 1.0).when((n1 == 1) & (n2 >= 2), m2).otherwise(m1))
    df = df.withColumn("mad_group2", F.when((n1 == 1) & (n2 == 1), 1.0).when((n2 == 1) & (n1 >= 2), m1).otherwise(m2))
    spread = MAD_SCALE * F.sqrt(F.col("mad_group1") * F.col("mad_group1") + F.col("mad_group2") * F.col("mad_group2"))
    df = df.withColumn("sd_raw", let(spread, lambda x: F.when(x < LEAST_SD, LEAST_SD).otherwise(x)))
    df = df.withColumn("beta", F.col("group1_pooled") - F.col("group2_pooled"))
    floor = F.greatest(F.col("sd_raw"), 1 / F.greatest(F.col("cov_mean"), F.lit(LEAST_COVERAGE)))
    df = df.withColumn("weight", F.when(F.col("sd_raw").isNotNull(), F.least("cov_mean", "cov_q75") / floor))
    df = df.withColumn("beta_raw_std", F.col("beta") / (F.col("sd_raw") * 2 / F.sqrt("_n")))
    return df.select(
        "perm_id", "chr", "pos", "group1_pooled", "group2_pooled", "beta", "beta_raw_std", "mad_group1", "mad_group2", "sd_raw", "cov_mean",
        "weight", "n_covered_group1", "n_covered_group2", "density_span",
    )
