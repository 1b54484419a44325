"""Analyses from a cache of mapped reads against those from the reads themselves."""

import numpy as np
import pandas as pd
import pytest

from hapdiff.operators import align, regions
from hapdiff.operators.storage import cut
from hapdiff.plans import catalog, differential, fixture
from hapdiff.sources import cache
from tests.conftest import SMALL, rows
from tests.test_units import READS

DESIGN = pd.DataFrame({"group": list("aaabbb")})


@pytest.fixture(scope="module")
def tables(spark):
    reads, cpg = fixture.tables(spark, SMALL)
    return cut(reads), cut(cpg.select("chr", "pos"))


@pytest.fixture(scope="module")
def kept(spark, tables, tmp_path_factory):
    return cache.write(str(tmp_path_factory.mktemp("cache") / "small"), *tables, buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_locus_counts_without_an_exchange(kept, tables, spark):
    own = kept.locus_counts()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the joins that large tables have
    try:
        assert "Exchange" not in plan(kept.locus_counts()) and "SortMergeJoin" in plan(kept.locus_counts()) and "Bucketed: true" in plan(kept.locus_counts())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cpg = align.position_index(tables[1])
    assert rows(own.toPandas()) == rows(align.locus_counts(align.map_reads(tables[0], cpg), cpg).toPandas())


def test_regions_open_only_their_zones(kept, tables, spark):
    """The reads of some regions: the same as from whole reads; the plan prunes zones when it runs."""
    cpg = cut(align.position_index(tables[1]))
    mapped = cut(align.map_reads(tables[0], cpg))
    found = cut(catalog._found(spark, SMALL).filter("chr in ('chr1', 'chr3')"))
    assert 0 < found.count()
    got, want = kept.region_reads(found), regions.region_reads(mapped, found, cpg)
    assert rows(got.select(want.columns).toPandas()) == rows(want.toPandas())
    assert rows(regions.region_squares(got).toPandas()) == rows(regions.region_squares(want).toPandas())
    text = plan(got)
    assert "dynamicpruning" in text and "PartitionFilters: [" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "dynamicpruning" in plan(kept.region_reads(found)) and "Bucketed: true" in plan(kept.region_reads(found))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_differential_regions_from_a_cache(kept, tables):
    arguments = {"samples": fixture.SAMPLES, "design": DESIGN, "formula": "~ group", "coef": "groupb", "permutations": 3}
    got, qc = differential.from_cache(kept, **arguments)
    want, counted = differential.differential_regions(*tables, **arguments)
    assert rows(got.toPandas()) == rows(want.toPandas()) and got.count()
    a, b = qc.first().asDict(), counted.first().asDict()
    assert a == b and a["coordinate_system"] == "1-based inclusive" and a["settings"]["min_cpgs"] == 5 and a["annotation_files"] == []
    found, qc = differential.candidates_from_cache(kept, fixture.SAMPLES, list("aaabbb"))
    again, counted = differential.find_candidates(*tables, fixture.SAMPLES, list("aaabbb"))
    assert rows(found.toPandas()) == rows(again.toPandas()) and qc.first() == counted.first()


def test_counters_are_those_of_a_pass_of_their_own(kept, tables):
    cpg = align.position_index(tables[1])
    want = align.read_qc(align.map_reads(tables[0], cpg)).first()
    assert kept.qc.first().asDict() == want.asDict() == differential.MappedReads(*tables).qc.first().asDict()


def test_another_session(kept, spark):
    """A session whose catalog doesn't know the tables yet finds buckets and zones again."""
    own = spark.newSession()
    for part in ("reads", "cells"):
        spark.sql(f"drop table {cache._name(kept.path, part)}")
    again = cache.open_cache(own, kept.path)
    assert again.reads.count() > 0 and again.qc.first() == kept.qc.first()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    assert "Exchange" not in plan(again.locus_counts())
    assert dict(again.reads.dtypes)["zone"] == "string"


def test_long_reads_lie_in_each_bin(spark, tmp_path):
    """Reads over several bins, one of them without positions, an index for each sample, invalid reads, and numbers as chromosomes."""
    rng = np.random.default_rng(3)
    positions = {f: sorted(set(rng.integers(1, 120_000, 300).tolist()) - set(range(40_000, 60_000)) - {77 if f == "u" else 0}) for f in "uv"}
    index = spark.createDataFrame([("1", float(p), f) for f, own in positions.items() for p in own], "chr string, pos double, annotation string")
    made = []
    for k in range(200):
        f = "uv"[k % 2]
        a = int(rng.integers(1, 100_000))
        b = a + int(rng.integers(0, 70_000 if k % 3 else 500))
        n = sum(a <= p <= b for p in positions[f])
        made.append((f"s{k % 2}", "1", float(a), float(b), ("1" if k % 4 else "0") * (n if k % 11 else n + 1) or "0", float(1 + k % 3), "+", f))
    reads = spark.createDataFrame(made, READS + ", annotation string")
    kept = cache.write(str(tmp_path / "long"), reads, index, buckets=3)
    cpg = cut(align.position_index(index))
    mapped = cut(align.map_reads(reads, cpg))
    assert mapped.filter("mapping_valid").count() > 100 and kept.reads.count() > mapped.filter("mapping_valid").count()
    assert kept.reads.filter("begins").count() == mapped.filter("mapping_valid").dropDuplicates(["sample", "read_start", "read_end", "hap"]).count()
    assert rows(kept.locus_counts().toPandas()) == rows(align.locus_counts(mapped, cpg).toPandas())
    assert rows(kept.cpg.select(*cpg.columns).toPandas()) == rows(cpg.toPandas())
    found = spark.createDataFrame([(0, "a", "1", 100, 50_000), (0, "b", "1", 16_384, 16_384), (1, "c", "1", 45_000, 55_000), (0, "d", "2", 1, 9)], "perm_id int, region_id string, chr string, start long, end long")
    got, want = kept.region_reads(found), regions.region_reads(mapped, found, cpg)
    assert rows(got.select(want.columns).toPandas()) == rows(want.toPandas()) and want.filter("n = 0").count()


def test_a_cache_is_replaced_and_removed(spark, tables, tmp_path):
    path = str(tmp_path / "again")
    cache.write(path, tables[0].filter("sample = 's1'"), tables[1], buckets=2)
    kept = cache.write(path, tables[0].filter("sample = 's2'"), tables[1], buckets=3)
    assert [r.sample for r in kept.reads.select("sample").distinct().collect()] == ["s2"]
    cache.remove(spark, path)
    assert not (tmp_path / "again").exists()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cache.open_cache(spark, path)


def test_empty_reads(spark, tables, tmp_path):
    kept = cache.write(str(tmp_path / "none"), tables[0].limit(0), tables[1], buckets=2)
    assert kept.locus_counts().count() == 0 and kept.qc.first().total_records == 0
