"""Spreads of single samples, clean-up after analyses, and metadata."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hapdiff.operators import screen
from hapdiff.operators.storage import checkpoint_folder, cut, scratch
from hapdiff.plans import differential, fixture
from tests.conftest import SMALL, rows


def test_spreads_of_single_covered_samples(spark):
    """Covered samples count, not the group's: a group with one takes the other's spread; where both have one it is 1."""
    wide = spark.createDataFrame(
        [("1", 1, [1.0, 0.0, 0.0, 1.0, 3.0, 9.0], [4.0, 0.0, 0.0, 10.0, 10.0, 10.0]), ("1", 2, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [4.0, 0.0, 0.0, 10.0, 0.0, 0.0]),
         ("1", 3, [1.0, 2.0, 5.0, 1.0, 0.0, 0.0], [10.0, 10.0, 10.0, 10.0, 0.0, 0.0]), ("1", 4, [0.0] * 6, [0.0] * 3 + [5.0, 0.0, 0.0])],
        "chr string, pos long, s array<double>, t array<double>",
    )
    parameters = spark.createDataFrame([(9.0, 500.0)], "cov_q75 double, density_span double")
    got = {r.pos: r for r in screen.locus_statistics(wide, differential.plan_frame(spark, [[1, 1, 1, 2, 2, 2]]), parameters).collect()}
    assert got[1].mad_group1 == got[1].mad_group2 == pytest.approx(1.4826 * 0.2)  # |0.1 - 0.3|, 0, |0.9 - 0.3|
    assert got[2].mad_group1 == got[2].mad_group2 == 1
    assert got[3].mad_group1 == got[3].mad_group2 == pytest.approx(1.4826 * 0.1)
    assert got[4].group1_pooled is None and got[4].mad_group1 is None and got[4].weight is None and got[4].beta is None


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}


def test_scratch_goes_also_after_an_error(spark):
    base = checkpoint_folder(spark).replace("file:", "")
    before = files(base)
    with pytest.raises(RuntimeError), scratch(spark) as keep:
        stays = keep(spark.range(5))
        goes = cut(spark.range(7))
        assert goes.count() == 7 and len(files(base)) > len(before)
        raise RuntimeError
    left = files(base) - before
    assert stays.count() == 5 and left and not any("/run-" in f for f in left)
    assert cut(spark.range(3)).count() == 3 and checkpoint_folder(spark).replace("file:", "") == base
    with pytest.raises(Exception, match="does not exist|FileNotFound|not found"):
        goes.count()


def test_an_analysis_leaves_its_results_only(spark):
    base = checkpoint_folder(spark).replace("file:", "")
    reads, cpg = fixture.tables(spark, SMALL)
    reads, positions = cut(reads), cut(cpg.select("chr", "pos"))
    before = files(base)
    design = pd.DataFrame({"group": list("aaabbb")})
    settings = differential.Settings(min_cpgs=6)
    found, qc = differential.differential_regions(reads, positions, fixture.SAMPLES, design, "~ group", "groupb", permutations=2, settings=settings)
    left = files(base) - before
    assert not any("/run-" in f for f in left)
    assert found.count() and qc.first().settings["min_cpgs"] == 6.0 and qc.first().coordinate_system == "1-based inclusive"
    broken = reads.withColumn("cnt", F.when(F.col("cnt") > 2, F.raise_error("a bad record").cast("double")).otherwise(F.col("cnt")))
    before = files(base)
    with pytest.raises(Exception, match="a bad record"):
        differential.differential_regions(broken, positions, fixture.SAMPLES, design, "~ group", "groupb", permutations=2)
    assert files(base) == before


def test_metadata_names_the_files(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("".join(f"1\t{p}\n" for p in range(100, 2000, 20)))
    (tmp_path / "v.tsv").write_text("".join(f"1\t{p}\n" for p in range(100, 2200, 20)))
    names = {}
    for k in range(4):
        (tmp_path / f"{k}.tsv").write_text("".join(f"1\t{p}\t{p + 40}\t{'100' if (k < 2) == (p % 3 == 0) else '000'}\t2\t+\n" for p in range(100, 1900, 20)))
        names[f"s{k}"] = str(tmp_path / f"{k}.tsv")
    of_each = {n: str(tmp_path / ("u.tsv" if n != "s3" else "v.tsv")) for n in names}
    found, qc = differential.candidates_from_files(spark, names, of_each, groups=list("aabb"))
    assert qc.first().annotation_files == [str(tmp_path / "u.tsv"), str(tmp_path / "v.tsv")]
    kept = differential.cache_files(spark, names, of_each, str(tmp_path / "cache"), buckets=2)
    again, counts = differential.candidates_from_cache(kept, list(names), list("aabb"))
    assert rows(found.toPandas()) == rows(again.toPandas())
    assert counts.first().annotation_files == [] and counts.first().valid_records == qc.first().valid_records == 360
