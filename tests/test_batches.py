"""Fits of many regions and blocks at a time against fits one by one, and the index of bits in runs of bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hapdiff.operators import align, model, smooth
from tests.conftest import rows


def _weighted(x, z, w):
    root = np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(x * root, z * root[:, 0], rcond=None)[0]
    return beta, np.linalg.inv((x * w[:, None]).T @ x)


def test_stacked_fits_are_those_of_each_region():
    rng = np.random.default_rng(1)
    n, r = 7, 300
    x = np.column_stack([np.ones(n), np.arange(n) % 2, rng.normal(size=n)])
    c = np.array([0.0, 1.0, -0.5])
    t = rng.integers(5, 60, (r, n)).astype(float)
    s = np.floor(t * rng.random((r, n)))
    nsq = t * rng.uniform(1, 4, (r, n))
    nsq = np.minimum(nsq, t * t)
    s[7, 2], nsq[11, 3], t[13, 0] = np.nan, 1e9, 0.0
    found = model.fit_stacked(s, t, nsq, x, c)
    bad = {7, 11, 13}
    assert {int(k) for k in np.flatnonzero(np.isnan(found["statistic"]))} == bad
    for k in set(range(r)) - bad:
        kappa = np.maximum(t[k] ** 2 / nsq[k], 1)
        z = np.arcsin(2 * (s[k] + 0.5) / (t[k] + 1) - 1)
        first, _ = _weighted(x, z, kappa)
        sigma2 = (kappa * (z - x @ first) ** 2).sum() / (n - 3)
        extra = (kappa - 1).sum()
        phi = 0.001 if extra <= 1.5e-8 else min(max(n * (sigma2 - 1) / extra, 0.001), 0.999)
        beta, v = _weighted(x, z, kappa / (1 + (kappa - 1) * phi))
        assert np.allclose(found["coef"][k], beta) and np.allclose(found["cov"][k], v) and np.isclose(found["phi"][k], phi)
        assert np.isclose(found["statistic"][k], c @ beta / np.sqrt(c @ v @ c))


def test_regions_are_fitted_in_batches(spark):
    rng = np.random.default_rng(2)
    samples = list("abcd")
    own = [(p, f"r{k}", v, float(rng.integers(0, 9)), 10.0, float(rng.integers(12, 90))) for p in range(3) for k in range(500) for v in samples]
    own[5] = (*own[5][:3], -1.0, *own[5][4:]) if own[5][0] else own[5]
    own = [r if r[:3] != (2, "r9", "b") else (*r[:3], 11.0, *r[4:]) for r in own]  # s over t
    rng.shuffle(own)
    df = spark.createDataFrame([(int(p), k, v, float(a), float(b), float(d)) for p, k, v, a, b, d in own], "perm_id int, region_id string, sample string, s double, t double, nsq double")
    designs = {p: np.column_stack([np.ones(4), rng.permutation([0, 0, 1, 1])]) for p in range(3)}
    c = np.array([0.0, 1.0])
    fits = model.fit_regions(df, samples, designs, c)
    plan = fits._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {(r.perm_id, r.region_id): r for r in fits.collect()}
    assert len(got) == 1500 and got[2, "r9"].statistic is None and got[2, "r9"].coef is None and got[2, "r9"].cov is None
    for p, k in ((0, "r0"), (1, "r77"), (2, "r499")):
        table = {r.sample: r for r in df.filter((F.col("perm_id") == p) & (F.col("region_id") == k)).collect()}
        one = model.fit_one(*(np.array([table[v][f] for v in samples]) for f in ("s", "t", "nsq")), designs[p], c)
        assert all(np.allclose(got[p, k][f], one[f]) for f in ("coef", "stage1_coef", "cov", "statistic", "p_value", "phi", "z", "kappa"))
    for broken in (df.filter("not (region_id = 'r3' and sample = 'c')"), df.unionByName(df.filter("region_id = 'r3' and sample = 'c'"))):
        with pytest.raises(Exception, match="one row for each sample"):
            model.fit_regions(broken, samples, designs, c).collect()
    assert model.fit_regions(df.limit(0), samples, designs, c).count() == 0


def test_blocks_side_by_side():
    rng = np.random.default_rng(3)
    block, pos, k = [], [], []
    for b, n in enumerate((40, 7, 300, 12)):
        block += [b] * n
        pos += (rng.integers(1, 9000) + np.cumsum(rng.integers(1, 30, n))).tolist()
        k += [int(rng.integers(1, n // 2))] * n
    block, pos, k = np.array(block), np.array(pos, float), np.array(k)
    n = len(block)
    ok, asked = rng.random(n) < 0.9, rng.random(n) < 0.8
    y, w = rng.normal(size=(3, n)), rng.uniform(0.5, 3, (3, n))
    got = smooth.fit_blocks(block, pos, asked, k, ok, y, w, 60.0)
    for p in range(3):
        want = []
        for b in range(4):
            own = block == b
            want += smooth.local_fit(pos[own & ok], y[p, own & ok], w[p, own & ok], pos[own & asked], int(k[own][0]), 60.0).tolist()
        assert np.allclose(got[p], want, atol=1e-11, equal_nan=True)


def test_kth_distances_with_a_k_for_each_point():
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(500, 80, replace=False)).astype(float)
    at, k = rng.uniform(-10, 510, 200), rng.integers(1, 81, 200)
    want = [np.sort(np.abs(x - a))[j - 1] for a, j in zip(at, k, strict=True)]
    assert np.allclose(smooth.kth_distances(x, at, k), want)


STATS = "perm_id int, chr string, pos long, block long, beta double, weight double, beta_raw_std double, density_span double"


def test_labellings_together_are_each_alone(spark):
    """Several labellings, some with loci that aren't fitted, give what each gives by itself; so do many blocks in one stretch."""
    rng = np.random.default_rng(5)
    pos = np.cumsum(np.where(rng.random(900) < 0.03, 4000, rng.integers(2, 60, 900)))
    block = 1 + np.cumsum(np.r_[0, np.diff(pos) > 2500])
    made = []
    for p in range(4):
        for x, b in zip(pos.tolist(), block.tolist(), strict=True):
            gap = p == 3 and rng.random() < 0.2
            made.append((p, "1", x, b, None if gap else float(rng.normal()), None if gap else float(rng.uniform(1, 4)), float(rng.normal()), 700.0))
    df = spark.createDataFrame(made, STATS)
    together = smooth.smooth(df)
    assert together.columns == [*df.columns, "signal", "smoothed"]
    alone = None
    for p in range(4):
        one = smooth.smooth(df.filter(F.col("perm_id") == p))
        alone = one if alone is None else alone.unionByName(one)
    assert rows(together.toPandas()) == rows(alone.toPandas()) and together.filter("not smoothed").count() and together.filter("smoothed").count() > 1000


def test_index_in_runs_of_bins(spark, monkeypatch):
    """Runs without positions, positions at the borders of bins and runs, and an index for each sample."""
    monkeypatch.setattr(align, "RUN", 4)
    rng = np.random.default_rng(6)
    edges = [b * align.BIN + d for b in (1, 3, 4, 7, 8, 40) for d in (-1, 0, 1)]
    pos = {f: sorted({int(p) for p in rng.integers(1, 9 * align.BIN, 60)} | set(edges)) for f in "uv"}
    pos["v"] = pos["v"][3:]
    cpg = spark.createDataFrame([(f, "1", p) for f, own in pos.items() for p in own], "annotation string, chr string, pos long")
    asked = [(f, "1", float(x), float(x + d)) for f in "uv" for x in [*edges, *rng.integers(0, 44 * align.BIN, 60).tolist()] for d in (0, 5000, 200_000)]
    df = spark.createDataFrame(asked, "annotation string, chr string, lo double, hi double")
    for size in (align.BROADCAST_BYTES, 0):
        monkeypatch.setattr(align, "BROADCAST_BYTES", size)
        got = align.count_at_most(df, cpg, x=F.col("lo"), y=F.col("hi")).collect()
        assert len(got) == len(asked)
        assert all((r.x, r.y) == tuple(sum(p <= v for p in pos[r.annotation]) for v in (r.lo, r.hi)) for r in got)


def test_events_are_summed_in_parts(spark, monkeypatch):
    """Parts of a few positions, runs without reads over whole parts, and reads that end where others begin."""
    monkeypatch.setattr(align, "EVENTS", 5)
    rng = np.random.default_rng(7)
    pos = sorted({int(p) for p in rng.integers(1, 3000, 90)})
    cpg = align.position_index(spark.createDataFrame([("1", float(p)) for p in pos], "chr string, pos double"))
    own = []
    for _ in range(60):
        a = int(rng.integers(0, 25)) + (60 if rng.random() < 0.5 else 0)
        b = min(a + int(rng.integers(0, 12)), len(pos) - 1)
        own.append((str(rng.choice(["s", "t"])), "1", float(pos[a]), float(pos[b]), ("1" if rng.random() < 0.5 else "0") * (b - a + 1), float(rng.integers(1, 4)), "+"))
    reads = spark.createDataFrame(own, "sample string, chr string, read_start double, read_end double, hap string, cnt double, strand string")
    mapped = align.map_reads(reads, cpg)
    assert rows(align.locus_counts_by_events(mapped, cpg).toPandas()) == rows(align.locus_counts(mapped, cpg).toPandas())
