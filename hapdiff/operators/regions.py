"""Sums over regions, by joins on bins of positions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.operators.align import annotation_of, count_at_most
from hapdiff.operators.names import fresh
from hapdiff.operators.storage import cut

#: Spans meet in bins of a tree: a leaf has BIN bases and each level above it 2 ** STEP times as many. A span's level is the lowest
#: whose bins are as long as it is, so it lies in two bins of that level at most.
BIN, STEP, TOP = 1 << 14, 3, 7
#: Spans of the left side in one bin are dealt over so many tasks, each of which has the right side's.
SALTS = 4


def _size(level: int) -> int:
    return BIN << STEP * level


def _level(a: str, b: str) -> Column:
    length = F.col(b) - F.col(a) + 1
    return functools.reduce(lambda other, k: F.when(length <= _size(k), k).otherwise(other), range(TOP - 1, -1, -1), F.lit(TOP))


def _bins(a: str, b: str, level: int, kind: int) -> Column:
    """The bins of a level that a span lies in, as struct(kind, level, bin)."""
    at = F.sequence(F.floor(F.col(a) / _size(level)).cast("long"), F.floor(F.col(b) / _size(level)).cast("long"))
    return F.transform(at, lambda k: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), k.alias("bin")))


def _slots(df: DataFrame, a: str, b: str, levels: Sequence[int], kind: int, wanted: Callable[[Column, int], Column]) -> Column:
    """The bins of those levels for which wanted(the span's level, level) holds."""
    none = F.array().cast("array<struct<kind:int,level:int,bin:bigint>>")
    parts = [F.when(wanted(_level(a, b), k), _bins(a, b, k, kind)).otherwise(none) for k in levels]
    return F.concat(none, *parts)


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], salts: int = SALTS, look: bool = False) -> DataFrame:
    """Pairs of rows of one chr whose closed spans share a base, each pair once. The other columns' names must differ.

    A pair meets on the level of its longer span, in the bin in which what both share begins. The left side, the larger one, goes to
    the levels that spans of the right side have, which are looked up first, and where it is longer to its own; the right side to its
    own level and, for longer spans of the left side, to those above it. So a span is in a few bins however long it is. salts: how many
    tasks share a bin's rows of the left side. look: the left side's levels are looked up too, in a pass over it, so that the right
    side goes to no others; else it goes to all above its own, unless the left side's spans are single positions.
    """
    (a, b), (c, d) = left_span, right_span
    slot, salt = fresh(left, "tree_slot"), fresh(left, "tree_salt")
    sides = right.select(_level(c, d).alias("level"), F.lit(False).alias("of_left"))
    if look and a != b:
        sides = sides.unionByName(left.select(_level(a, b).alias("level"), F.lit(True).alias("of_left")))
    found = sides.distinct().collect()  # one for each level of the tree and side
    levels = sorted(r.level for r in found if not r.of_left)
    above = [] if a == b else sorted(r.level for r in found if r.of_left and r.level > 0) if look else range(1, TOP + 1)
    own = [_slots(left, a, b, levels, 1, lambda mine, k: mine <= k), _slots(left, a, b, above, 2, lambda mine, k: mine == k)]
    one = left.withColumn(salt, F.pmod(F.xxhash64(a, b, F.monotonically_increasing_id()), F.lit(salts))).withColumn(slot, F.explode(F.concat(*own)))
    own = [_slots(right, c, d, levels, 1, lambda mine, k: mine == k), _slots(right, c, d, above, 2, lambda mine, k: mine < k)]
    two = right.withColumn(slot, F.explode(F.concat(*own))).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    pairs = one.join(two, ["chr", slot, salt]).filter((F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)))
    size = functools.reduce(lambda other, k: F.when(F.col(f"{slot}.level") == k, _size(k)).otherwise(other), range(TOP), F.lit(_size(TOP)))
    return pairs.filter(F.col(f"{slot}.bin") == F.floor(F.greatest(F.col(a), F.col(c)) / size)).drop(slot, salt)


def region_sums(loci: DataFrame, regions: DataFrame) -> DataFrame:
    """perm_id, region_id, sample, s, t: sums over all loci in each region (perm_id, region_id, chr, start, end)."""
    own = regions.select("perm_id", "region_id", "chr", "start", "end")
    at = overlaps(loci.select("sample", "chr", "pos", "s", "t"), own, ("pos", "pos"), ("start", "end"))
    return at.groupBy("perm_id", "region_id", "sample").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def region_pairs(regions: DataFrame, cpg: DataFrame) -> DataFrame:
    """regions with r_start and r_end, the numbers of their first and last position; with r_annotation, a row for each index file, where
    samples have indexes of their own."""
    which = annotation_of(cpg)
    own = regions.select("perm_id", "region_id", "chr", "start", "end")
    if which:
        own = own.crossJoin(F.broadcast(cpg.select(*which).distinct()))  # a row for each index file
    own = count_at_most(own, cpg, r_start=F.col("start") - 1, r_end=F.col("end")).withColumn("r_start", F.col("r_start") + 1)
    return own.withColumnsRenamed({c: f"r_{c}" for c in which})


def region_reads(mapped: DataFrame, regions: DataFrame, cpg: DataFrame) -> DataFrame:
    """Valid reads and regions that overlap, with n, the positions of the reads' index that they share."""
    which = annotation_of(cpg)
    spans = mapped.filter("mapping_valid").groupBy("sample", *which, "chr", "read_start", "read_end", "ci_start", "ci_end", "hap", "strand", "state").agg(F.sum("cnt").alias("cnt"))
    own = cut(region_pairs(regions, cpg))
    pairs = overlaps(spans, own, ("read_start", "read_end"), ("start", "end"))
    for c in which:
        pairs = pairs.filter(F.col(c) == F.col(f"r_{c}")).drop(c, f"r_{c}")
    return pairs.withColumn("n", F.greatest(F.lit(0), F.least("ci_end", "r_end") - F.greatest("ci_start", "r_start") + 1))


def region_squares(pairs: DataFrame) -> DataFrame:
    """perm_id, region_id, sample, nsq: the sum of cnt * n * n over region_reads()."""
    return pairs.filter("n > 0").groupBy("perm_id", "region_id", "sample").agg(F.sum(F.col("cnt") * F.col("n") * F.col("n")).alias("nsq"))


def reads_without_local_position(pairs: DataFrame) -> DataFrame:
    """One row: the different reads that overlap a region of the observed labelling but share no position with it."""
    own = pairs.filter("n = 0 and perm_id = 0").select("region_id", "sample", "read_start", "read_end", "hap", "strand").distinct()
    return own.agg(F.count("*").alias("reads_without_local_cpg"))


def sums_from_reads(pairs: DataFrame) -> DataFrame:
    """region_sums() and nsq from the reads themselves."""
    own = pairs.filter("n > 0")
    return own.groupBy("perm_id", "region_id", "sample").agg(
        F.sum(F.when(F.col("state"), F.col("cnt") * F.col("n")).otherwise(0.0)).alias("s"), F.sum(F.col("cnt") * F.col("n")).alias("t"),
        F.sum(F.col("cnt") * F.col("n") * F.col("n")).alias("nsq"),
    )


def complete(matrices: DataFrame, n_samples: int) -> DataFrame:
    """The rows of regions for which every sample has finite s and positive t and nsq."""
    ok = (F.col("t") > 0) & (F.col("nsq") > 0) & F.col("s").isNotNull() & ~F.isnan("s")
    w = W.partitionBy("perm_id", "region_id")
    return matrices.withColumn("_ok", F.count_if(F.coalesce(ok, F.lit(False))).over(w)).filter(F.col("_ok") == n_samples).drop("_ok")


def region_matrices(loci: DataFrame, mapped: DataFrame, regions: DataFrame, cpg: DataFrame) -> DataFrame:
    """perm_id, region_id, sample, s, t, nsq."""
    return region_sums(loci, regions).join(region_squares(region_reads(mapped, regions, cpg)), ["perm_id", "region_id", "sample"])


def overlap_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """results, a table or a checkpoint, and labelled regions (label_id, chr, start0: zero-based, label_end, category) that overlap.

    Labels are the side that may be large: they go to the levels of results alone, without a copy for each task of a bin.
    """
    own = labels.withColumn("label_start", F.col("start0") + 1)
    return overlaps(own, results, ("label_start", "label_end"), ("start", "end"), look=True)


def best_hit(pairs: DataFrame) -> DataFrame:
    """For each label its result with the smallest fdr (then the first in order)."""
    w = W.partitionBy("label_id").orderBy("fdr", "chr", "start", "end")
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def confusion(hits: DataFrame) -> DataFrame:
    """category, call, n: how labelled regions were called."""
    return hits.groupBy("category", "call").agg(F.count("*").alias("n"))
