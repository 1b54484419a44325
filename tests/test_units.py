"""Operators on hand-made rows, and the driver's small functions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hapdiff.functions import design, permutations, stats
from hapdiff.operators import align, calibrate, model, regions, segment, smooth
from hapdiff.plans import differential
from hapdiff.sources import records

READS = "sample string, chr string, read_start double, read_end double, hap string, cnt double, strand string"


def reads_of(spark, *own):
    return spark.createDataFrame([("a", "1", s, e, h, c, "+") for s, e, h, c in own], READS)


def index(spark, *pos):
    return align.position_index(spark.createDataFrame([("1", float(p)) for p in pos], "chr string, pos double"))


def test_whole_read_state_counts_everywhere(spark):
    cpg = index(spark, 10, 20, 30)
    mapped = align.map_reads(reads_of(spark, (10.0, 30.0, "010", 2.0), (20.0, 30.0, "00", 3.0)), cpg)
    for f in (align.locus_counts, align.locus_counts_by_events):
        got = {r.pos: (r.t, r.s) for r in f(mapped, cpg).collect()}
        assert got == {10: (2.0, 2.0), 20: (5.0, 2.0), 30: (5.0, 2.0)}


def test_flags_of_bad_records(spark):
    cpg = index(spark, 10, 20, 30)
    bad = reads_of(spark, (10.0, 20.0, "0", 1.0), (11.0, 19.0, "0", 1.0), (10.0, 10.0, "x", 1.0), (10.0, 10.0, None, 1.0), (20.0, 10.0, "0", 1.0), (None, 10.0, "0", 1.0), (10.0, 10.0, "1", float("nan")))
    got = align.read_qc(align.map_reads(bad, cpg)).first().asDict()
    assert got == {"total_records": 7, "valid_records": 0, "invalid_records": 7, "invalid_haplotype_string": 2, "missing_cpg_annotation": 1, "cpg_length_mismatch": 1}


def test_empty_reads(spark):
    cpg = index(spark, 10, 20)
    mapped = align.map_reads(spark.createDataFrame([], READS), cpg)
    assert align.locus_counts(mapped, cpg).count() == 0
    assert align.read_qc(mapped).first().total_records == 0


def test_index_keeps_distinct_positive_positions(spark):
    assert [(r.pos, r.ci) for r in index(spark, 5, 3, 5, 0, -1, float("nan")).orderBy("ci").collect()] == [(3, 1), (5, 2)]


def test_overlaps_gives_each_pair_once(spark):
    left = spark.createDataFrame([("1", 1, 100_000), ("1", 5, 9), ("2", 1, 5)], "chr string, a long, b long")
    right = spark.createDataFrame([("1", 9, 50_000), ("1", 100_001, 100_002)], "chr string, c long, d long")
    got = {(r.a, r.c) for r in regions.overlaps(left, right, ("a", "b"), ("c", "d")).collect()}
    assert got == {(1, 9), (5, 9)}
    assert regions.overlaps(left, right, ("a", "b"), ("c", "d")).count() == 2


def test_direction_ties(spark):
    df = spark.createDataFrame([(0.1,), (0.1 - 1e-9,), (0.09,), (-0.1,), (None,)], "x double")
    assert [r[0] for r in df.select(segment.direction(F.col("x"), 0.1)).collect()] == [1, 1, 0, -1, None]


def test_local_fit_is_exact_for_quadratics():
    x = np.arange(0.0, 300.0, 7.0)
    y = 1 + 0.02 * x - 3e-5 * x * x
    assert np.allclose(smooth.local_fit(x, y, np.ones_like(x), x, len(x) // 2, 50.0), y, atol=1e-9)


def test_fit_without_covariates_is_the_closed_form():
    s, t, nsq = np.array([3.0, 5, 2, 9, 8, 7]), np.array([10.0, 12, 9, 11, 10, 13]), np.array([30.0, 40, 25, 33, 21, 50])
    x = np.column_stack([np.ones(6), np.array([0, 0, 0, 1, 1, 1.0])])
    one = model.fit_one(s, t, nsq, x, np.array([0, 1.0]))
    w = np.array(one["kappa"]) / (1 + (np.array(one["kappa"]) - 1) * one["phi"])
    z = np.array(one["z"])
    assert math.isclose(one["coef"][1], np.average(z[3:], weights=w[3:]) - np.average(z[:3], weights=w[:3]), rel_tol=1e-9)


def test_empirical_p_and_fdr(spark):
    observed = spark.createDataFrame([(1, 2.0), (2, -3.0), (3, float("nan")), (4, 2.0)], "id int, wald double")
    null = spark.createDataFrame([(2.0,), (-2.5,), (0.1,), (float("inf"),)], "wald double")
    got = {r.id: r.empirical_p_value for r in calibrate.empirical_p(observed, null).collect()}
    assert got == {1: 0.75, 2: 0.25, 3: None, 4: 0.75}
    p = spark.createDataFrame([(0.01,), (0.02,), (0.02,), (0.9,), (None,)], "empirical_p_value double")
    got = sorted(round(r.fdr, 9) for r in calibrate.false_discovery(p).collect() if r.fdr is not None)
    assert got == [round(0.08 / 3, 9)] * 3 + [0.9]
    assert {r.empirical_p_value for r in calibrate.empirical_p(observed, null.limit(0)).filter("id < 3").collect()} == {1.0}


def _all_labellings(groups):
    """Every usable labelling, one of each complementary pair, with how evenly its small group mixes the observed ones."""
    n, small = len(groups), 1 if 2 * groups.count(1) <= len(groups) else 2
    k = groups.count(small)
    found = {}
    for own in itertools.combinations(range(n), k):
        mixed = sum(groups[i] == small for i in own)
        if mixed in (0, k):
            continue
        rest = tuple(i for i in range(n) if i not in own)
        found[min(own, rest) if 2 * k == n else own] = max(mixed, k - mixed)
    return found


def _small(labels, groups):
    n, small = len(groups), 1 if 2 * groups.count(1) <= len(groups) else 2
    own, rest = (tuple(i for i in range(n) if (labels[i] == small) == of) for of in (True, False))
    return min(own, rest) if len(own) == len(rest) else own


@pytest.mark.parametrize("groups", [[1, 1, 1, 2, 2, 2], [1, 2, 2, 2, 2], [1, 1, 2, 2, 2], [1, 2, 1, 2, 1, 2, 2, 1], [2, 2, 1, 2, 2, 1, 2, 1], [1, 1, 2, 2]])
def test_plans_hold_what_is_available(groups):
    everything = _all_labellings(groups)
    got, available = permutations.plan(groups, 1000, seed=1)
    assert len(got) == available == len(everything) and {_small(x, groups) for x in got} == set(everything)
    evenness = [everything[_small(x, groups)] for x in got]
    assert evenness == sorted(evenness)
    # fewer: the most even ones, drawn within the last tier
    for wanted in (1, 3, available - 1):
        if 0 < wanted < available:
            some = permutations.plan(groups, wanted, seed=2)[0]
            assert sorted(everything[_small(x, groups)] for x in some) == sorted(everything.values())[:wanted]


def test_large_plans_are_drawn_without_listing():
    groups = [1] * 30 + [2] * 30
    got, available = permutations.plan(groups, 20, seed=3)
    assert len({tuple(x) for x in got}) == 20 and got == permutations.plan(groups, 20, seed=3)[0] != permutations.plan(groups, 20, seed=4)[0]
    assert available == math.comb(60, 30) // 2 - 1
    assert all(sum(g == 1 for g in x[:30]) == 15 for x in got)
    assert [permutations.subset(r, "abcd", 2) for r in range(6)] == [list(x) for x in itertools.combinations("abcd", 2)]


def test_designs():
    d = pd.DataFrame({"sample": ["b", "a", "c", "d"], "group": ["x", "y", "x", "y"], "age": [1.0, 2, 3, 5]})
    own = design.align_design(d, ["a", "b", "c", "d"])
    assert own["sample"].tolist() == ["a", "b", "c", "d"]
    x, names = design.design_matrix(own, "~ group + age")
    assert names == ["(Intercept)", "groupy", "age"] and x[:, 1].tolist() == [1, 0, 0, 1]
    assert design.contrast("groupy", names).tolist() == [0, 1, 0] and design.group_column(own, "~ group + age", "groupy") == "group"
    for bad in ("x", 4, [0, 0, 0]):
        with pytest.raises(ValueError):
            design.contrast(bad, names)
    with pytest.raises(ValueError):
        design.design_matrix(own.assign(copy=own["age"] * 2), "~ age + copy")
    with pytest.raises(ValueError):
        design.design_matrix(own.iloc[:2], "~ group")  # no degree of freedom is left
    # names that aren't the samples': by the index, else as given
    assert design.align_design(d.set_index(pd.Index(["s2", "s1", "s3", "s4"])), ["s1", "s2", "s3", "s4"])["sample"].tolist() == ["a", "b", "c", "d"]
    assert design.align_design(d, ["s1", "s2", "s3", "s4"])["sample"].tolist() == ["b", "a", "c", "d"]


def test_formula_terms():
    f = design.formula_terms
    assert f("~ a + b") == ([("a",), ("b",)], True) and f("~ 0 + a") == f("~ a - 1") == ([("a",)], False)
    assert f("~ a * b + c - b") == ([("a",), ("c",), ("a", "b")], True) and f("~ a:b + a") == ([("a",), ("a", "b")], True)
    for bad in ("y ~ a", "a + b", "~ log(a)", "~"):
        with pytest.raises(ValueError):
            f(bad)
    d = pd.DataFrame({"a": list("uvuvuvuv"), "b": list("ppqqppqq"), "n": [1.0, 2, 3, 4, 6, 5, 8, 9]})
    x, names = design.design_matrix(d, "~ a * b")
    assert names == ["(Intercept)", "av", "bq", "av:bq"] and x[:, 3].tolist() == [0, 0, 0, 1, 0, 0, 0, 1]
    assert design.design_matrix(d, "~ 0 + a + b")[1] == ["au", "av", "bq"]
    assert design.design_matrix(d, "~ a + a:n")[1] == ["(Intercept)", "av", "au:n", "av:n"]
    unused = d.assign(a=pd.Categorical(d["a"], categories=["v", "none", "u"]))
    assert design.design_matrix(unused, "~ a")[1] == ["(Intercept)", "au"]


def test_group_column_and_levels():
    d = pd.DataFrame({"group": ["tumor", "tumor", "normal", "normal"], "sex": ["M", "F", "M", "F"], "site": [0.0, 1.0, 1.0, 0.0], "age": [1, 2, 3, 4]})
    assert design.group_column(d, "~ group + sex", "sexM") == "group"  # group is preferred, whatever the coefficient
    assert design.group_column(d, "~ sex + site", "sexM") == "sex" and design.group_column(d, "~ site + age", 2) == "site"
    for formula, coef in (("~ age", 2), ("~ sex + site", 2)):
        with pytest.raises(ValueError):
            design.group_column(d, formula, coef)
    assert list(design.as_groups(d["group"]).cat.categories) == ["tumor", "normal"]  # as they first appear
    assert list(design.as_groups(d["site"]).cat.categories) == ["0", "1"]
    assert design.design_matrix(d.assign(group=design.as_groups(d["group"])), "~ group")[1] == ["(Intercept)", "groupnormal"]


def test_plain_contrasts():
    codes = [1, 1, 2, 2]
    d = pd.DataFrame({"group": ["a", "a", "b", "b"], "age": [1.0, 2, 3, 4]})
    plain = lambda formula, c: differential.is_plain(design.design_matrix(d, formula)[0], np.array(c), codes)
    assert plain("~ group", [0, 1]) and not plain("~ group", [1, 0]) and not plain("~ 0 + group", [0, 1]) and not plain("~ age", [0, 1])


def test_model_contracts(spark):
    rows = [(p, "r", s, s1, 10.0, n) for p in (0, 1, 2) for s, s1, n in (("a", 3.0, 30.0), ("b", 5.0, 40.0), ("c", 7.0, 60.0))]
    schema = "perm_id int, region_id string, sample string, s double, t double, nsq double"
    x, c = np.array([[1.0, 0], [1, 0], [1, 1]]), np.array([0, 1.0])
    fit = lambda own, **more: model.fit_regions(spark.createDataFrame(own, schema), ["a", "b", "c"], {k: x for k in range(3)}, c, **more)
    assert {r.perm_id: r.statistic is None for r in fit(rows).collect()} == {0: False, 1: False, 2: False}
    broken = [r if r[0] != 1 or r[2] != "b" else (*r[:5], 4000.0) for r in rows]  # effective coverage far under 1
    for fits in (fit(broken).withColumnRenamed("statistic", "wald"), model.two_groups(model.with_link(spark.createDataFrame(broken, schema)), differential.label_frame(spark, ["a", "b", "c"], [[1, 1, 2]] * 3))):
        assert {r.perm_id: r.wald is None for r in fits.collect()} == {0: False, 1: True, 2: False}
        assert {r.perm_id for r in model.null_statistics(fits).collect()} == {2}
    with pytest.raises(Exception, match="coverage"):
        fit([(0, *r[1:]) for r in broken if r[0] == 1]).collect()
    for bad in ({"pseudo": 0.0}, {"phi": (0.5, 0.1)}, {"phi": (0.0, 1.0)}):
        with pytest.raises(ValueError):
            fit(rows, **bad)


def _fit_one_by_one(x, y, w, at, k, span):
    """The local fit point by point with least squares on the points that have weight."""
    out = []
    for x0 in at:
        h = max(np.sort(np.abs(x - x0))[k - 1], span)
        h = h if h > 0 else 1.0
        u = (x - x0) / h
        own = np.maximum(1 - np.abs(u) ** 3, 0) ** 3 * w * (np.abs(u) < 1)
        different = len(np.unique(u[own > 0]))
        powers = np.vander(u, min(3, different), increasing=True) * np.sqrt(own)[:, None]
        out.append(np.linalg.lstsq(powers, y * np.sqrt(own), rcond=None)[0][0] if different else np.nan)
    return np.array(out)


def test_local_fit_against_least_squares(monkeypatch):
    rng = np.random.default_rng(6)
    for n, k, span in ((300, 30, 40.0), (50, 7, 0.0), (12, 12, 1000.0), (40, 3, 5.0)):
        x = np.sort(rng.choice(n * 9, n, replace=False)).astype(float)
        y, w = rng.normal(size=n), rng.uniform(0.5, 9, n)
        at = np.sort(np.r_[x, x[:5] + 0.5, x[0] - 30, x[-1] + 3])
        assert np.allclose(smooth.kth_distances(x, at, k), [np.sort(np.abs(x - a))[k - 1] for a in at])
        want = _fit_one_by_one(x, y, w, at, k, span)
        assert np.allclose(smooth.local_fit(x, y, w, at, k, span), want, atol=1e-6, equal_nan=True)
        monkeypatch.setattr(smooth, "PAIRS", 37)
        assert np.allclose(smooth.local_fit(x, y, w, at, k, span), want, atol=1e-6, equal_nan=True)
        monkeypatch.undo()


def test_local_fit_drops_degrees():
    one, w = np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 1.0, 2.0, 1.0])
    same = np.full(4, 5.0)
    assert np.allclose(smooth.local_fit(same, one, w, np.array([5.0]), 4, 10.0), [2.6])  # one place: the weighted mean
    two = np.array([0.0, 0.0, 4.0, 4.0])
    assert np.allclose(smooth.local_fit(two, np.array([1.0, 1, 3, 3]), np.ones(4), np.array([2.0]), 4, 10.0), [2.0])  # two: a line
    assert np.isnan(smooth.local_fit(np.array([0.0]), np.array([1.0]), np.array([1.0]), np.array([100.0]), 1, 5.0)).all()


def _index_by_hand(pos, x):
    return sum(p <= x for p in pos)


@pytest.mark.parametrize("small", [True, False])
def test_lookups_near_and_far(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(align, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    pos = sorted({int(p) for p in rng.integers(9000, 60_000, 400)} | {4095, 4096, 8191, 8192, 63, 64, 127, 128})
    cpg = index(spark, *pos)
    spans = [(float(a), float(a + d)) for a in [-5, 0, 1, 62, 63, 64, 4094, 4095, 4096, 8191, 61_000, 200_000, *rng.integers(0, 61_000, 60).tolist()] for d in (0, 1, 100, 4096, 9000, 300_000)]
    df = spark.createDataFrame([(k, "1", a, b) for k, (a, b) in enumerate(spans)] + [(-1, "none", 1.0, 2.0), (-2, None, 1.0, 2.0), (-3, "1", None, 9.5)], "k int, chr string, a double, b double")
    got = {r.k: (r.n, r.m) for r in align.count_at_most(df, cpg, n=F.col("a"), m=F.col("b")).collect()}
    assert got == {k: (_index_by_hand(pos, a), _index_by_hand(pos, b)) for k, (a, b) in enumerate(spans)} | {-1: (0, 0), -2: (0, 0), -3: (0, _index_by_hand(pos, 9.5))}


def test_orders_over_bins(spark, monkeypatch):
    from hapdiff.operators import ordered

    monkeypatch.setattr(ordered, "BASES", 50)
    rng = np.random.default_rng(2)
    pos = sorted({int(p) for p in rng.integers(1, 4000, 200)})
    df = spark.createDataFrame([("1", p) for p in pos] + [("2", 7)], "chr string, pos long")
    got = {(r.chr, r.pos): r.block for r in smooth.blocks(df, 30).collect()}
    want, block = {("2", 7): 1}, 0
    for k, p in enumerate(pos):
        block += k == 0 or p - pos[k - 1] > 30
        want["1", p] = block
    assert got == want
    got = {(r.chr, r.pos): r.ci for r in align.position_index(df).collect()}
    assert got == {("1", p): k for k, p in enumerate(pos, 1)} | {("2", 7): 1}


def test_exact_quantile(spark):
    from hapdiff.operators import screen

    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 40, 301) / 7, np.array([2.5]), rng.normal(size=64) * 300):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for p in (0.0, 0.5, 0.75, 1.0):
            assert math.isclose(screen.quantile(df, F.col("v"), p, "q").first().q, np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12)
    assert screen.quantile(df.limit(0), F.col("v"), 0.75, "q").first().q is None


def test_long_blocks_in_pieces(spark):
    """A block of many pieces has the values of one fit of the whole."""
    rng = np.random.default_rng(5)
    n = 700
    pos = np.cumsum(rng.integers(1, 9, n))
    beta = [float(b) if rng.random() < 0.8 else None for b in rng.normal(size=n)]
    rows = [(1, "1", int(p), 1, b, float(w), 0.0, 40.0) for p, b, w in zip(pos, beta, rng.uniform(1, 5, n), strict=True)]
    df = spark.createDataFrame(rows, "perm_id int, chr string, pos long, block long, beta double, weight double, beta_raw_std double, density_span double")
    got = {r.pos: r.signal for r in smooth.smooth(df, 9, 5, 6).collect()}  # reach 11, pieces of 88
    ok = np.array([b is not None for b in beta])
    nn = min(40.0 / (pos[-1] - pos[0] + 1), 9 / n, 0.75)
    k = max(int(ok.sum() * nn + 1e-8), 1)
    want = smooth.local_fit(pos[ok].astype(float), np.array([b for b in beta if b is not None]), np.array([r[5] for r in rows])[ok], pos.astype(float), k, 6.0)
    assert np.allclose([np.nan if got[int(p)] is None else got[int(p)] for p in pos], want, atol=1e-12, equal_nan=True)


def test_repeated_positions_keep_the_last_row(spark):
    rows = [("a", "1", 5, 3.0, 1.0), ("b", "1", 5, 9.0, 2.0), ("a", "1", 5, 2.0, 0.0), ("b", "1", 7, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, chr string, pos long, t double, s double").coalesce(1)
    got = {r.pos: (r.s, r.t) for r in align.dense(df, ["a", "b"]).collect()}
    assert got == {5: ([0.0, 2.0], [2.0, 9.0]), 7: ([0.0, 1.0], [0.0, 1.0])}


@pytest.mark.parametrize("change", [{"threshold": -1}, {"min_cpgs": 2}, {"bp_span": 0}, {"max_gap_smooth": float("nan")}])
def test_settings_are_checked(change):
    with pytest.raises(ValueError):
        differential.Settings(**change)


def test_t_quantiles():
    assert math.isclose(stats.t_critical(1), 63.6567411629, rel_tol=1e-8)
    assert math.isclose(stats.t_critical(10), 3.16927266, rel_tol=1e-7)


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\t10\t20\t01\t2\t+\textra\r\n\n1\t 10 \tx\t01\t2\t-\n")
    (tmp_path / "b.tsv").write_text("1\t10\t20\t11\t1\t+\n")
    got = records.read_records(spark, {"a": str(tmp_path / "a.tsv"), "b": str(tmp_path / "b.tsv")}).collect()
    assert sorted((r.sample, r.read_start, r.read_end is None) for r in got) == [("a", 10.0, False), ("a", 10.0, True), ("b", 10.0, False)]
    (tmp_path / "c.tsv").write_text("1\t10\n")
    with pytest.raises(Exception, match="fewer than 6"):
        records.read_records(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "c.tsv")]).collect()
    with pytest.raises(ValueError):
        records.sample_paths(["one"])


def test_written_results_and_caches(spark, tmp_path):
    cpg = index(spark, 10, 20, 30)
    mapped = align.map_reads(reads_of(spark, (10.0, 30.0, "010", 2.0), (20.0, 30.0, "00", 3.0)), cpg)
    mapped = mapped.unionByName(mapped.withColumn("chr", F.lit("X")))
    records.write_read_cache(mapped, str(tmp_path / "cache"))
    got = records.read_read_cache(spark, str(tmp_path / "cache"), ["1"])
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and dict(got.dtypes)["chr"] == "string"
    assert {(r.pos, r.t) for r in align.locus_counts(got, cpg).collect()} == {(10, 2.0), (20, 5.0), (30, 5.0)}
    assert records.read_read_cache(spark, str(tmp_path / "cache")).count() == 4
    loci = align.locus_counts(mapped, cpg).orderBy("chr", "pos")
    for kind in ("csv", "parquet"):
        records.write_result(loci, str(tmp_path / kind), kind)
        back = spark.read.format(kind).options(header="true", inferSchema="true").load(str(tmp_path / kind))
        assert back.columns == loci.columns and back.count() == 3
    with pytest.raises(ValueError):
        records.write_result(loci, str(tmp_path / "x"), "json")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_records(spark, [str(tmp_path / "none"), str(tmp_path / "no")])


def test_whole_analysis_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    pos = list(itertools.accumulate(rng.integers(20, 60, 120).tolist()))
    (tmp_path / "index.tsv").write_text("".join(f"1\t{p}\n" for p in pos))
    files = {}
    for k in range(6):
        lines = []
        for i in range(0, 118, 2):
            for _ in range(4):
                on = rng.random() < (0.9 if 40 <= i < 80 and k < 3 else 0.1)
                lines.append(f"1\t{pos[i]}\t{pos[i + 2]}\t{'110' if on else '000'}\t1\t+\n")
        (tmp_path / f"s{k}.tsv").write_text("".join(lines))
        files[f"s{k}"] = str(tmp_path / f"s{k}.tsv")
    d = pd.DataFrame({"group": list("aaabbb")})
    path = str(tmp_path / "index.tsv")
    got, qc = differential.from_files(spark, files, path, design=d, formula="~ group", coef="groupb")
    got = got.orderBy("chr", "start").toPandas()
    best = got.loc[got["wald_statistic"].abs().idxmax()]
    counted = qc.first()
    assert counted.valid_records == 6 * 59 * 4 and counted.candidate_loci_before_screen == counted.candidate_loci_retained == 119
    assert (counted.permutations_requested, counted.nonredundant_permutations_available, counted.permutations_generated) == (10, 9, 9)
    assert 0 < counted.permutations_successful <= 9 and counted.regions_dropped_incomplete_coverage == counted.reads_without_local_cpg == 0
    assert best.direction == "+" and pos[30] <= best.start <= pos[45] and best.wald_statistic < -3
    # the first level to appear is the first group: with the groups' names swapped the same coefficient's place has the same sign
    swapped = pd.DataFrame({"group": list("bbbaaa")})
    again = differential.from_files(spark, files, path, design=swapped, formula="~ group", coef=2)[0].orderBy("chr", "start").toPandas()
    assert np.allclose(again["wald_statistic"], got["wald_statistic"]) and (again["direction"] == got["direction"]).all()
    # an index for each sample, of which two differ in a position that no read covers
    (tmp_path / "other.tsv").write_text("".join(f"1\t{p}\n" for p in [*pos, pos[-1] + 9000]))
    of_each = {name: path if k % 2 else str(tmp_path / "other.tsv") for k, name in enumerate(files)}
    own = differential.from_files(spark, files, of_each, design=d, formula="~ group", coef="groupb")[0].orderBy("chr", "start").toPandas()
    assert np.allclose(own["wald_statistic"], got["wald_statistic"]) and (own["start"] == got["start"]).all()
    found, counts = differential.candidates_from_files(spark, files, of_each, groups=list("aaabbb"))
    assert sorted(r.start for r in found.collect()) == sorted(got["start"]) and counts.first().valid_records == 6 * 59 * 4
    # sample s0's index lacks the first position: its reads that begin there map to one position less
    (tmp_path / "short.tsv").write_text("".join(f"1\t{p}\n" for p in pos[1:]))
    of_each["s0"] = str(tmp_path / "short.tsv")
    assert differential.candidates_from_files(spark, files, of_each, groups=list("aaabbb"))[1].first().cpg_length_mismatch == 4
    with pytest.raises(ValueError):
        differential.from_files(spark, files, {"s0": path}, design=d, formula="~ group", coef="groupb")
