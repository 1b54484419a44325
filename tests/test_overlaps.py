"""Overlaps by a tree of bins against comparing all with all."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from hapdiff.operators import regions


def spans(rng, n, names, most=26):
    """Spans of all lengths, many at the borders of bins of all levels."""
    out = []
    for k in range(n):
        length = int(2 ** rng.uniform(0, most))
        at = int(rng.integers(1, 3e8)) if rng.random() < 0.5 else int(rng.integers(1, 9)) * (regions.BIN << int(rng.integers(0, 6))) - int(rng.integers(-2, length + 3))
        out.append((str(rng.choice(["1", "2"])), max(at, 1), max(at, 1) + length - 1, k))
    return out


@pytest.mark.parametrize("salts", [1, 4])
def test_each_pair_once(spark, salts):
    rng = np.random.default_rng(1)
    left, right = spans(rng, 400, "ab"), spans(rng, 250, "cd", 30)
    left += [("1", 5, 5, 400), ("1", 1, 300_000_000, 401), ("3", 1, 9, 402), ("1", 16_383, 16_384, 403)]
    right += [("1", 5, 5, 250), ("1", 2, 100_000_001, 251), ("1", 16_384, 16_384, 252), ("4", 1, 9, 253)]
    one = spark.createDataFrame(left, "chr string, a long, b long, i long")
    two = spark.createDataFrame(right, "chr string, c long, d long, j long")
    got = [(r.i, r.j) for r in regions.overlaps(one, two, ("a", "b"), ("c", "d"), salts).collect()]
    want = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    doubles = one.select("chr", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "i")
    assert set(map(tuple, regions.overlaps(doubles, two, ("a", "b"), ("c", "d")).select("i", "j").collect())) == want


def test_long_spans_lie_in_few_bins(spark):
    df = spark.createDataFrame([("1", 1_000, 100_001_000), ("1", 16_000, 17_000)], "chr string, a long, b long")
    slots = regions._slots(df, "a", "b", range(regions.TOP + 1), 1, lambda mine, k: mine <= k)
    assert [r[0] <= 2 * (regions.TOP + 1) for r in df.select(F.size(slots)).collect()] == [True, True]


def test_a_million_reads_in_one_bin(spark):
    """They are dealt over several tasks, and each finds its regions."""
    n = 1_000_000
    reads = spark.range(n).select(F.lit("1").alias("chr"), (F.col("id") % 9000 + 1).alias("a"), (F.col("id") % 9000 + 100).alias("b"), "id")
    own = spark.createDataFrame([("1", 4001, 4010, "x"), ("1", 1, 90_000_000, "y"), ("1", 20_000, 30_000, "z")], "chr string, c long, d long, j string")
    pairs = regions.overlaps(reads, own, ("a", "b"), ("c", "d"))
    got = {r.j: r["count"] for r in pairs.groupBy("j").count().collect()}
    assert got == {"x": spark.range(n).filter("id % 9000 + 1 <= 4010 and id % 9000 + 100 >= 4001").count(), "y": n}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = regions.overlaps(reads, own, ("a", "b"), ("c", "d")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 0.75 * sum(r["count"] for r in tasks)


def test_nothing_on_one_side(spark):
    some = spark.createDataFrame([("1", 1, 9)], "chr string, a long, b long")
    other = some.withColumnsRenamed({"a": "c", "b": "d"})
    assert regions.overlaps(some, other.limit(0), ("a", "b"), ("c", "d")).count() == 0
    assert regions.overlaps(some.limit(0), other, ("a", "b"), ("c", "d")).count() == 0


@pytest.mark.parametrize("most", [(26, 30), (30, 12), (9, 9)])
def test_each_pair_once_with_both_sides_looked_up(spark, most):
    rng = np.random.default_rng(2)
    left, right = spans(rng, 300, "ab", most[0]), spans(rng, 250, "cd", most[1])
    one = spark.createDataFrame(left, "chr string, a long, b long, i long")
    two = spark.createDataFrame(right, "chr string, c long, d long, j long")
    got = [(r.i, r.j) for r in regions.overlaps(one, two, ("a", "b"), ("c", "d"), look=True).collect()]
    want = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]}
    assert len(got) == len(set(got)) and set(got) == want


def test_positions_within_spans(spark):
    """A side of single positions has the lowest level alone."""
    rng = np.random.default_rng(3)
    left, right = [(str(rng.choice(["1", "2"])), int(rng.integers(1, 3e6)), k) for k in range(2000)], spans(rng, 200, "cd", 30)
    one = spark.createDataFrame(left, "chr string, a long, i long")
    two = spark.createDataFrame(right, "chr string, c long, d long, j long")
    got = [(r.i, r.j) for r in regions.overlaps(one, two, ("a", "a"), ("c", "d")).collect()]
    want = {(x[2], y[3]) for x in left for y in right if x[0] == y[0] and y[1] <= x[1] <= y[2]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def shuffled_rows(spark, df):
    """The rows of df, and how many rows were written to shuffles for them."""
    group = f"overlaps-{id(df)}"
    spark.sparkContext.setJobGroup(group, group)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return rows, sum(context.statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_labels_are_dealt_once(spark):
    """Labels are the many; each goes to its bins once, not to every level and every task of a bin."""
    n = 4000
    labels = spark.range(n).select(F.col("id").alias("label_id"), F.lit("1").alias("chr"), (F.col("id") * 40).alias("start0"), (F.col("id") * 40 + 600).alias("label_end"), F.lit("NC").alias("category"))
    results = spark.createDataFrame([("1", 1 + 9000 * k, 250 + 9000 * k, "+", 0.5) for k in range(20)], "chr string, start long, end long, direction string, fdr double")
    rows, written = shuffled_rows(spark, regions.overlap_labels(results, labels))
    want = {(i, 1 + 9000 * k) for i in range(n) for k in range(20) if 40 * i + 1 <= 250 + 9000 * k and 40 * i + 600 >= 1 + 9000 * k}
    assert len(rows) == len(want) and {(r.label_id, r.start) for r in rows} == want
    assert 0 < written < 2 * n


def many_labels(spark, n):
    """Labels, regions whose fdr goes up and down, and each label's first region by fdr and place, by all pairs."""
    own = [(i, 40 * i, 40 * i + 600, ("Hyper", "Hypo", "NC")[i % 3]) for i in range(n)]
    found = [("1", 1 + 700 * k, 500 + 700 * k, "+-"[k % 2], (k * 7 % 5) / 50) for k in range(40)]
    best = {}
    for i, a, b, category in own:
        hit = [(r[4], r[1], r[3]) for r in found if r[1] <= b and r[2] >= a + 1]
        if hit:
            best[i] = (category, *min(hit))
    labels = spark.createDataFrame([(i, "1", a, b, c) for i, a, b, c in own], "label_id long, chr string, start0 long, label_end long, category string")
    return labels, spark.createDataFrame(found, "chr string, start long, end long, direction string, fdr double"), best


def test_best_hits_of_many_labels(spark):
    labels, results, best = many_labels(spark, 4000)
    rows, written = shuffled_rows(spark, regions.best_hit(regions.overlap_labels(results, labels)))
    assert {r.label_id: (r.category, r.fdr, r.start, r.direction) for r in rows} == best and len(rows) == len(best) > 600
    assert 0 < written < 3 * 4000


def test_confusion_of_many_labels(spark):
    labels, results, best = many_labels(spark, 4000)
    hits = regions.best_hit(regions.overlap_labels(results, labels))
    rows, written = shuffled_rows(spark, regions.confusion(hits.withColumn("call", F.when(F.col("fdr") > 0.05, "NC").otherwise(F.col("direction")))))
    want = collections.Counter((c, "NC" if fdr > 0.05 else direction) for c, fdr, _, direction in best.values())
    assert {(r.category, r.call): r.n for r in rows} == want and len(want) > 3
    assert 0 < written < 3 * 4000
