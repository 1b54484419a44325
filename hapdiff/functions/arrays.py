"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: what makes a median absolute deviation a standard deviation.
MAD_SCALE = 1.4826


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where a lambda of body uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median(values: Column) -> Column:
    """The mean of the middle two of an array without nulls; null if it is empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return let(F.array_sort(values), middle)


def mad(values: Column) -> Column:
    """1.4826 times the median absolute deviation from the median."""
    return MAD_SCALE * let(values, lambda v: let(median(v), lambda m: median(F.transform(v, lambda x: F.abs(x - m)))))
