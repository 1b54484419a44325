"""Runs of loci with one direction, trimmed to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.functions.stats import SQRT_EPS, t_far, t_table
from hapdiff.operators.ordered import number_runs
from hapdiff.operators.storage import cut

KEYS = ["perm_id", "chr"]
#: Fixed values of the peak-and-shoulder rule: the share of a segment beside its peak, the weight of its mean, the ratio of its ends.
SHOULDER, MEAN_SHARE, PEAKED = 0.125, 0.75, 4 / 3


def direction(x: Column, threshold: float) -> Column:
    """1 at or above threshold (a rounding error below counts), -1 at or below its negative, which is judged last, else 0."""
    up = (x >= threshold) | (F.abs(x - threshold) <= SQRT_EPS)
    return F.when(x.isNotNull(), F.when(x <= -threshold, -1).when(up, 1).otherwise(0))


def clusters(signals: DataFrame, max_gap: float) -> DataFrame:
    """cluster: a new one after a gap of over max_gap between loci, with or without a signal. signals: a table or a checkpoint."""
    return number_runs(signals, KEYS, ["pos"], lambda before: (F.col("pos") - before["pos"]) > max_gap, "cluster")


def runs(signals: DataFrame, threshold: float, max_gap: float) -> DataFrame:
    """Loci with a signal, their dir, raw_dir and segment: a run of one cluster and direction. Direction 0 breaks runs."""
    own = clusters(signals, max_gap).filter("signal is not null")
    own = own.withColumn("dir", direction(F.col("signal"), threshold)).withColumn("raw_dir", direction(F.col("beta_raw_std"), threshold))
    return number_runs(
        cut(own), KEYS, ["cluster", "dir"], lambda before: (before["cluster"] != F.col("cluster")) | (before["dir"] != F.col("dir")), "segment"
    )


def raw_trim(segmented: DataFrame, min_cpgs: int) -> DataFrame:
    """Loci of non-zero segments from the first to the last whose raw direction agrees, where that leaves min_cpgs."""
    seg = W.partitionBy(*KEYS, "segment")
    own = segmented.filter("dir <> 0").withColumn("i", F.row_number().over(seg.orderBy("pos")))
    agrees = F.when(F.col("raw_dir") == F.col("dir"), F.col("i"))
    own = own.withColumn("n", F.count("*").over(seg)).withColumn("lo", F.min(agrees).over(seg)).withColumn("hi", F.max(agrees).over(seg))
    trim = (F.col("n") > min_cpgs) & F.coalesce(F.col("hi") - F.col("lo") + 1 >= min_cpgs, F.lit(False))
    return own.filter(~trim | F.col("i").between(F.col("lo"), F.col("hi"))).drop("i", "n", "lo", "hi")


def shape_limits(trimmed: DataFrame, min_cpgs: int) -> DataFrame:
    """perm_id, chr, segment, n, first, last: what the peak-and-shoulder rule keeps of each segment."""
    seg = W.partitionBy(*KEYS, "segment")
    own = trimmed.withColumn("i", F.row_number().over(seg.orderBy("pos"))).withColumn("x", F.col("signal") * F.col("dir"))
    # Spark's max_by takes the last of equal values: the first peak is asked for
    own = own.withColumn("mid", F.min_by("i", F.struct(-F.col("x"), F.col("i"))).over(seg))
    own = own.withColumn("n", F.count("*").over(seg)).withColumn("_max", F.max("x").over(seg)).withColumn("_min", F.min("x").over(seg))
    own = own.withColumn("cut", (0.5 * (F.col("_max") - F.col("_min")) + F.col("_min") + MEAN_SHARE * F.avg("x").over(seg)) / 2)
    on = lambda c, v="x": F.when(c, F.col(v).cast("double"))
    sides = []
    for name, c in (("l", F.col("i") <= F.col("mid")), ("r", F.col("i") >= F.col("mid"))):
        y, x = on(c), on(c, "i")
        sides += [F.count(y).cast("int").alias(f"{name}n"), F.regr_sxx(y, x).alias(f"{name}xx"), F.regr_syy(y, x).alias(f"{name}yy"), F.regr_sxy(y, x).alias(f"{name}xy")]
    g = own.groupBy(*KEYS, "segment").agg(
        F.first("n").cast("int").alias("n"), F.first("mid").alias("mid"), F.first("_max").alias("mx"), F.first("_min").alias("mn"),
        F.min(F.when((F.col("x") >= F.col("cut")) & (F.col("i") <= F.col("mid")), F.col("i"))).alias("fi"),
        F.max(F.when((F.col("x") >= F.col("cut")) & (F.col("i") >= F.col("mid")), F.col("i"))).alias("la"), *sides,
    )
    table = F.broadcast(t_table(trimmed.sparkSession))
    for name in ("l", "r"):
        t = table.select(F.col("df").alias(f"{name}df"), F.col("t_crit").alias(f"{name}t"))
        df = F.col(f"{name}n") - 2
        g = g.join(t, df == F.col(f"{name}df"), "left").withColumn(f"{name}t", F.coalesce(f"{name}t", t_far(F.greatest(df, F.lit(1)))))

    def slope_is(name: str, sign: int) -> Column:
        n, xx, yy, xy, t = (F.col(f"{name}{c}") for c in ("n", "xx", "yy", "xy", "t"))
        explained = F.when(xx > 0, xy * xy / xx)
        return F.coalesce((n > 4) & (sign * xy > 0) & (explained * (n - 2) > t * t * (yy - explained)), F.lit(False))

    peaked = (F.col("n") > min_cpgs) & (((F.col("mn") == 0) & (F.col("mx") > 0)) | ((F.col("mn") != 0) & (F.try_divide("mx", "mn") > PEAKED)))
    one, mid, n = F.lit(1), F.col("mid"), F.col("n")
    left = F.least(F.greatest(one, F.rint(mid - SHOULDER * n).cast("int")), F.greatest(one, mid - 2), F.coalesce("fi", "mid"))
    right = F.greatest(F.least(n, F.rint(mid + SHOULDER * n).cast("int")), F.least(n, mid + 2), F.coalesce("la", "mid"))
    g = g.withColumn("first", F.when(slope_is("l", 1), left).otherwise(one)).withColumn("last", F.when(slope_is("r", -1), right).otherwise(n))
    use = peaked & (F.col("last") - F.col("first") + 1 >= min_cpgs)
    return g.select(
        *KEYS, "segment", "n", F.when(use, F.col("first")).otherwise(one).cast("int").alias("first"), F.when(use, F.col("last")).otherwise(n).cast("int").alias("last")
    )


def candidates(signals: DataFrame, threshold: float = 0.1, max_gap: float = 1000, min_cpgs: int = 5) -> DataFrame:
    """perm_id, chr, start, end, direction (+: group 1 is higher), max_abs_smooth, mean_smooth, n_loci, block, n_smoothed.

    All windows are within a labelling and chromosome or one of its segments.
    """
    trimmed = raw_trim(runs(signals, threshold, max_gap), min_cpgs)
    limits = shape_limits(trimmed, min_cpgs).drop("n")
    own = trimmed.withColumn("i", F.row_number().over(W.partitionBy(*KEYS, "segment").orderBy("pos")))
    own = own.join(limits, [*KEYS, "segment"]).filter(F.col("i").between(F.col("first"), F.col("last")))
    return own.groupBy(*KEYS, "segment").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.when(F.first("dir") > 0, "+").otherwise("-").alias("direction"),
        F.max(F.abs("signal")).alias("max_abs_smooth"), F.avg("signal").alias("mean_smooth"), F.count("*").alias("n_loci"),
        F.min_by("block", "pos").alias("block"), F.count_if("smoothed").alias("n_smoothed"),
    ).filter(F.col("n_loci") >= min_cpgs).drop("segment")
