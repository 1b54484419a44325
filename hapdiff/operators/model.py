"""Two-stage weighted least squares for each region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapdiff.functions.stats import SQRT_EPS, normal_two_sided

PHI = (0.001, 0.999)
KEYS = ["perm_id", "region_id"]
_VECTOR = pa.list_(pa.float64())
RESULT = pa.schema([
    ("coef", _VECTOR), ("stage1_coef", _VECTOR), ("cov", pa.list_(_VECTOR)), ("statistic", pa.float64()), ("p_value", pa.float64()),
    ("phi", pa.float64()), ("z", _VECTOR), ("kappa", _VECTOR),
])


def link(s: Column, t: Column, pseudo: float = 0.5) -> Column:
    """asin of the smoothed rate on [-1, 1]."""
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (s + pseudo) / (t + 2 * pseudo) - 1)))


def with_link(matrices: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """matrices with z and kappa, the effective coverage t * t / nsq, at least 1.

    Far under 1 is an error of the observed labelling (perm_id 0) and null in a permuted one, whose fits then fail.
    """
    raw = F.col("t") * F.col("t") / F.col("nsq")
    low = F.when(F.col("perm_id") == 0, F.raise_error("effective coverage below 1").cast("double"))
    ok = F.when(raw < 1 - SQRT_EPS, low).otherwise(F.greatest(raw, F.lit(1.0)))
    return matrices.withColumn("kappa", ok).withColumn("z", link(F.col("s"), F.col("t"), pseudo))


def null_statistics(fits: DataFrame, statistic: str = "wald") -> DataFrame:
    """The finite statistics of permuted labellings. A labelling with a region whose fit failed (a null statistic) has none."""
    own = fits.filter("perm_id > 0")
    failed = own.filter(F.col(statistic).isNull()).select("perm_id").distinct()  # at most a row for each labelling
    return own.join(F.broadcast(failed), "perm_id", "left_anti").filter(F.abs(F.col(statistic)) < float("inf"))


def two_groups(linked: DataFrame, labels: DataFrame, phi: tuple[float, float] = PHI) -> DataFrame:
    """perm_id, region_id, estimate, wald, phi of group 2 against group 1; labels (perm_id, sample, g) is a few rows.

    The design is an intercept and one indicator, so both stages have closed forms. A region with a null kappa has no fit.
    """
    check_settings(0.5, phi)
    df = linked.join(F.broadcast(labels), ["perm_id", "sample"])
    side = lambda c, g: F.sum(F.when(F.col("g") == g, c))
    k, kz, kzz = F.col("kappa"), F.col("kappa") * F.col("z"), F.col("kappa") * F.col("z") * F.col("z")
    rows = F.collect_list(F.struct("g", "z", "kappa"))
    one = df.groupBy(*KEYS).agg(
        *[side(c, g).alias(f"{n}{g}") for g in (1, 2) for n, c in (("k", k), ("kz", kz), ("kzz", kzz))],
        F.count("*").alias("n"), F.sum(k - 1).alias("extra"), rows.alias("rows"),
    )
    mean = lambda g: F.col(f"kz{g}") / F.col(f"k{g}")
    residual = F.aggregate(
        "rows", F.lit(0.0), lambda a, x: a + x["kappa"] * F.pow(x["z"] - F.when(x["g"] == 1, mean(1)).otherwise(mean(2)), F.lit(2.0))
    )
    one = one.withColumn("sigma2", residual / (F.col("n") - 2))
    raw = F.col("n") * (F.col("sigma2") - 1) / F.col("extra")
    one = one.withColumn("phi", F.when(F.col("extra") <= SQRT_EPS, phi[0]).otherwise(F.greatest(F.lit(phi[0]), F.least(F.lit(phi[1]), raw))))
    weight = lambda x: x["kappa"] / (1 + (x["kappa"] - 1) * F.col("phi"))
    total = lambda g, f: F.aggregate(F.filter("rows", lambda x: x["g"] == g), F.lit(0.0), lambda a, x: a + f(x))
    for g in (1, 2):
        one = one.withColumn(f"w{g}", total(g, weight)).withColumn(f"wz{g}", total(g, lambda x: weight(x) * x["z"]))
    one = one.withColumns({w: F.when(~F.exists("rows", lambda x: x["kappa"].isNull()), F.col(w)) for w in ("w1", "w2")})
    estimate = F.col("wz2") / F.col("w2") - F.col("wz1") / F.col("w1")
    return one.select(*KEYS, estimate.alias("estimate"), (estimate / F.sqrt(1 / F.col("w1") + 1 / F.col("w2"))).alias("wald"), "phi")


def check_settings(pseudo: float, phi: tuple[float, float]) -> None:
    if not np.isfinite(pseudo) or pseudo <= 0:
        raise ValueError("the pseudo count must be finite and positive")
    if len(phi) != 2 or not np.isfinite(phi).all() or not 0 <= phi[0] < phi[1] < 1:
        raise ValueError("the bounds of phi must be 0 <= lower < upper < 1")


def fit_stacked(s: np.ndarray, t: np.ndarray, nsq: np.ndarray, x: np.ndarray, c: np.ndarray, pseudo: float = 0.5, phi_bounds: tuple = PHI) -> dict[str, np.ndarray]:
    """The fits of many regions with one design, each a row of s, t and nsq: coefficients, covariances, Wald statistics and their p.

    Both stages solve all regions' equations at once. A region whose values can't be fitted, or whose effective coverage is below 1,
    has NaN everywhere.
    """
    n, p = x.shape
    good = (np.isfinite(s) & np.isfinite(t) & np.isfinite(nsq) & (t > 0) & (nsq > 0) & (s >= 0) & (s <= t)).all(axis=1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        raw = t * t / nsq
        good &= (raw >= 1 - SQRT_EPS).all(axis=1)
        kappa = np.where(good[:, None], np.maximum(raw, 1.0), 1.0)
        z = np.where(good[:, None], np.arcsin(np.clip(2 * (s + pseudo) / (t + 2 * pseudo) - 1, -1, 1)), 0.0)

    def solve(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.linalg.inv(np.einsum("ni,rn,nj->rij", x, w, x, optimize=True))
        return np.einsum("rij,rj->ri", v, (w * z) @ x), v

    first, _ = solve(kappa)
    sigma2 = (kappa * (z - first @ x.T) ** 2).sum(axis=1) / (n - p)
    extra = (kappa - 1).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        phi = np.where(extra <= SQRT_EPS, phi_bounds[0], np.clip(n * (sigma2 - 1) / extra, *phi_bounds))
    beta, v = solve(kappa / (1 + (kappa - 1) * phi[:, None]))
    wald = beta @ c / np.sqrt(np.einsum("i,rij,j->r", c, v, c))
    out = {"coef": beta, "stage1_coef": first, "cov": v, "statistic": wald, "phi": phi, "z": z, "kappa": kappa}
    for values in out.values():
        values[~good] = np.nan
    return out | {"p_value": np.array([normal_two_sided(x) for x in wald.tolist()])}


def fit_one(s: np.ndarray, t: np.ndarray, nsq: np.ndarray, x: np.ndarray, c: np.ndarray, pseudo: float = 0.5, phi_bounds: tuple = PHI) -> dict:
    """The fit of one region: coefficients, covariance, Wald statistic and its p."""
    if (t * t / nsq < 1 - SQRT_EPS).any():
        raise ValueError("effective coverage below 1")
    found = fit_stacked(s[None], t[None], nsq[None], x, c, pseudo, phi_bounds)
    return {k: v[0].tolist() for k, v in found.items()}


def _lists(values: np.ndarray, good: np.ndarray) -> pa.Array:
    """An array of (nested) lists of the rows of values, null where a row isn't good."""
    inner = pa.array(values.reshape(-1))
    for size in reversed(values.shape[1:]):
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, size), pa.int32()), inner)
    return inner.take(pa.array(np.arange(len(good)), mask=~good))


def fit_regions(matrices: DataFrame, samples: list[str], designs: dict[int, np.ndarray], c: np.ndarray, pseudo: float = 0.5, phi: tuple = PHI) -> DataFrame:
    """One row for each region (perm_id, region_id) with fit_one()'s results; designs: for each perm_id the matrix, rows by samples.

    A region's rows, as many as the samples, become one of arrays, and a task fits thousands of those at a time. Designs are small
    and travel with the tasks. Where a fit fails, the observed labelling (perm_id 0) stops the job, and a permuted one's row has nulls.
    """
    check_settings(pseudo, phi)
    if len(set(samples)) != len(samples) or not all(samples):
        raise ValueError("samples need different names")
    for x in designs.values():
        if not np.isfinite(x).all() or not np.isfinite(c).all() or len(c) != x.shape[1] or not np.any(c):
            raise ValueError("the design and the contrast must be finite, and the contrast has one number for each column, not all 0")
        if x.shape[0] != len(samples) or x.shape[0] <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
            raise ValueError("the design needs full rank and more samples than columns")
    place = F.array_position(F.array(*[F.lit(v) for v in samples]), F.col("sample"))
    nan = lambda v: F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v)
    rows = F.sort_array(F.collect_list(F.struct(place.alias("place"), nan("s"), nan("t"), nan("nsq"))))
    gathered = matrices.groupBy(*KEYS).agg(rows.alias("rows"))
    each = F.col("rows.place") == F.array(*[F.lit(k + 1).cast("long") for k in range(len(samples))])
    checked = F.when(each, F.col("rows")).otherwise(F.raise_error("a region needs one row for each sample").cast(gathered.schema["rows"].dataType))
    gathered = gathered.withColumn("rows", checked).select(*KEYS, *[F.col(f"rows.{v}").alias(v) for v in ("s", "t", "nsq")])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            perms = np.asarray(batch.column("perm_id"))
            for perm in np.unique(perms).tolist():
                own = batch.filter(pa.array(perms == perm))
                s, t, nsq = (np.asarray(own.column(v).flatten(), np.float64).reshape(own.num_rows, -1) for v in ("s", "t", "nsq"))
                found = fit_stacked(s, t, nsq, designs[perm], c, pseudo, phi)
                good = np.isfinite(found["statistic"])
                if perm == 0 and not good.all():
                    raise ValueError("regions need 0 <= s <= t, t > 0, nsq > 0 and an effective coverage of 1 at least")
                columns = [own.column(k) for k in KEYS] + [_lists(found[f.name], good) for f in RESULT]
                yield pa.RecordBatch.from_arrays(columns, [*KEYS, *RESULT.names])

    schema = (
        "perm_id int, region_id string, coef array<double>, stage1_coef array<double>, cov array<array<double>>, statistic double, "
        "p_value double, phi double, z array<double>, kappa array<double>"
    )
    return gathered.mapInArrow(fit, schema)
