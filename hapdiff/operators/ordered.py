"""Numbering and running sums along a chromosome, in bins of bases with offsets: no task orders a whole chromosome."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.operators.names import fresh

#: Bases in a bin; a genome has hundreds of bins, and a bin's rows are ordered in one task.
BASES = 1 << 22


def _binned(df: DataFrame) -> tuple[DataFrame, str]:
    name = fresh(df, "order_bin")
    return df.withColumn(name, F.floor(F.col("pos") / BASES)), name


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """df and name: the sum of value (a whole number) over the rows of equal keys up to each pos, which is unique within keys.

    df is read twice, so it should be a table or a checkpoint. A row for each bin is what the offsets' window orders.
    """
    own, at = _binned(df)
    of, before = fresh(own, "order_value"), fresh(own, "order_before")
    own = own.withColumn(of, value.cast("long"))
    per_bin = own.groupBy(*keys, at).agg(F.sum(of).alias(before))
    over = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    per_bin = per_bin.withColumn(before, F.coalesce(F.sum(before).over(over), F.lit(0)))
    inside = W.partitionBy(*keys, at).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return own.join(per_bin, [*keys, at]).withColumn(name, F.col(before) + F.sum(of).over(inside)).drop(at, of, before)


def number_runs(df: DataFrame, keys: Sequence[str], looked_at: Sequence[str], begins: Callable[[Column], Column], name: str) -> DataFrame:
    """df and name: the number, from 1, of each row's run; begins(struct of looked_at in the row before) says where a new one begins.

    Rows are in the order of pos, which is unique within keys. The row before a bin's first is the last of the bin before it.
    """
    own, at = _binned(df)
    ends, new = fresh(own, "order_end"), fresh(own, "order_new")
    state = F.struct(*looked_at)
    last = own.groupBy(*keys, at).agg(F.max_by(state, "pos").alias(ends))
    last = last.withColumn(ends, F.lag(ends).over(W.partitionBy(*keys).orderBy(at)))
    before = F.coalesce(F.lag(state).over(W.partitionBy(*keys, at).orderBy("pos")), F.col(ends))
    flagged = own.join(last, [*keys, at]).withColumn(ends, before)
    flagged = flagged.withColumn(new, F.coalesce(begins(F.col(ends)), F.lit(True)).cast("int")).drop(at, ends)
    return running_sum(flagged, keys, F.col(new), name).drop(new)
