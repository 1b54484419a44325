"""The public analyses: candidates, region fits, and differential regions with a permutation null."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hapdiff.functions import design as designs
from hapdiff.functions.permutations import plan as permutation_plan
from hapdiff.operators import align, calibrate, model, regions, screen, segment, smooth
from hapdiff.operators.storage import cut, scratch
from hapdiff.sources import cache, records


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.10
    max_gap_smooth: float = 2500
    max_gap_region: float = 1000
    min_cpgs: int = 5
    bp_span: float = 1000
    min_in_span: float = 30

    def __post_init__(self) -> None:
        designs.check_parameters(self.threshold, self.max_gap_smooth, self.max_gap_region, self.min_cpgs, self.bp_span, self.min_in_span)


def plan_frame(spark: SparkSession, labellings: list[list[int]]) -> DataFrame:
    """perm_id (0: observed), grp: a few rows."""
    return spark.createDataFrame([(k, g) for k, g in enumerate(labellings)], "perm_id int, grp array<int>")


def label_frame(spark: SparkSession, samples: Sequence[str], labellings: list[list[int]]) -> DataFrame:
    """perm_id, sample, g."""
    return spark.createDataFrame([(k, s, g) for k, own in enumerate(labellings) for s, g in zip(samples, own, strict=True)], "perm_id int, sample string, g int")


def locus_signals(wide: DataFrame, groups: list[int], labellings: list[list[int]], settings: Settings) -> DataFrame:
    """Locus statistics of every labelling with blocks and smoothed signals. The loci, the quantile and the span are the observed ones'."""
    kept = screen.screen(wide, groups)
    parameters = screen.screen_parameters(kept, settings.min_in_span)
    stats = screen.locus_statistics(kept, plan_frame(wide.sparkSession, labellings), parameters)
    placed = smooth.blocks(cut(kept.select("chr", "pos")), settings.max_gap_smooth)
    stats = cut(stats.join(placed, ["chr", "pos"]))
    return smooth.smooth(stats, settings.min_in_span, settings.min_cpgs, settings.bp_span)


def find_regions(wide: DataFrame, groups: list[int], labellings: list[list[int]], settings: Settings) -> DataFrame:
    """Candidates of every labelling, with region_id (unique within perm_id)."""
    signals = cut(locus_signals(wide, groups, labellings, settings))
    found = segment.candidates(signals, settings.threshold, settings.max_gap_region, settings.min_cpgs)
    return found.withColumn("region_id", F.concat_ws(":", "chr", F.col("start").cast("string"), F.col("end").cast("string"), "direction"))


def screen_qc(wide: DataFrame, groups: list[int]) -> DataFrame:
    """One row: loci before the screen, kept by it and dropped."""
    n, kept = wide.agg(F.count("*").alias("candidate_loci_before_screen")), screen.screen(wide, groups).agg(F.count("*").alias("candidate_loci_retained"))
    dropped = F.col("candidate_loci_before_screen") - F.col("candidate_loci_retained")
    return n.crossJoin(kept).withColumn("candidate_loci_dropped_group_coverage", dropped)


COORDINATES = "1-based inclusive"


class MappedReads:
    """Reads mapped to positions for one analysis: what a cache.ReadCache offers, of reads that are at hand."""

    def __init__(self, reads: DataFrame, positions: DataFrame):
        self.spark, self.cpg, seen = reads.sparkSession, cut(align.position_index(positions)), Observation()
        # counted as they are written: no other pass over the reads
        self.reads = cut(align.map_reads(reads, self.cpg).observe(seen, *align.qc_counters()))
        counters = align.observed(seen)
        self.qc = self.spark.createDataFrame([tuple(counters.values())], ", ".join(f"{c} long" for c in counters))

    def locus_counts(self) -> DataFrame:
        return align.locus_counts(self.reads, self.cpg)

    def region_reads(self, found: DataFrame) -> DataFrame:
        return regions.region_reads(self.reads, found, self.cpg)


def _metadata(settings: Settings, annotation_files: Sequence[str]) -> list:
    """annotation_files (the different index files, if the analysis read files), coordinate_system and settings, as columns."""
    values = [F.lit(v) for pair in asdict(settings).items() for v in (pair[0], float(pair[1]))]
    files = F.array(*[F.lit(f) for f in annotation_files]).cast("array<string>")
    return [files.alias("annotation_files"), F.lit(COORDINATES).alias("coordinate_system"), F.create_map(*values).alias("settings")]


def find_candidates(
    reads: DataFrame, positions: DataFrame, samples: Sequence[str], groups: Mapping[str, str] | Sequence[str],
    levels: Sequence[str] | None = None, settings: Settings | None = None, annotation_files: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Candidate regions, and one row of counters of reads and loci with the analysis' metadata. Parameters are checked before any
    read is touched."""
    settings = settings or Settings()
    codes, _ = designs.group_codes(groups, samples, levels)
    with scratch(reads.sparkSession) as keep:
        return tuple(map(keep, _candidates(MappedReads(reads, positions), samples, codes, settings, annotation_files)))


def candidates_from_cache(
    kept: cache.ReadCache, samples: Sequence[str], groups: Mapping[str, str] | Sequence[str],
    levels: Sequence[str] | None = None, settings: Settings | None = None, annotation_files: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """find_candidates() of reads that are in a cache."""
    codes, _ = designs.group_codes(groups, samples, levels)
    with scratch(kept.spark) as keep:
        return tuple(map(keep, _candidates(kept, samples, codes, settings or Settings(), annotation_files)))


def _candidates(source: MappedReads | cache.ReadCache, samples: Sequence[str], codes: list[int], settings: Settings, annotation_files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    wide = cut(align.dense(source.locus_counts(), list(samples)))
    qc = source.qc.crossJoin(screen_qc(wide, codes)).select("*", *_metadata(settings, annotation_files))
    return find_regions(wide, codes, [codes], settings).drop("perm_id"), qc


def differential_regions(
    reads: DataFrame, positions: DataFrame, samples: Sequence[str], design: pd.DataFrame, formula: str, coef: str | int | Sequence[float],
    permutations: int = 10, settings: Settings | None = None, seed: int = 0, annotation_files: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Regions with wald_statistic, empirical_p_value, fdr and null_pool_size, and one row of counters: of reads, loci, reads of
    regions, regions without coverage in every sample, and permutations requested, available, generated and successful; and of
    metadata: annotation_files, coordinate_system, settings.

    Permuted labellings are rows like the observed one: perm_id is a column from the locus statistics on. Where the coefficient is
    the difference of two groups without anything else, regions are fitted in closed form, others by region with numpy. Labellings
    whose design is rank deficient, and those with a failed fit, give no null statistics. What the analysis keeps on its way is
    deleted at its end, also when it fails; the two results stay.
    """
    plan = _planned(samples, design, formula, coef, permutations, seed)
    with scratch(reads.sparkSession) as keep:
        return tuple(map(keep, _differential(MappedReads(reads, positions), plan, settings or Settings(), annotation_files)))


def from_cache(
    kept: cache.ReadCache, samples: Sequence[str], design: pd.DataFrame, formula: str, coef: str | int | Sequence[float],
    permutations: int = 10, settings: Settings | None = None, seed: int = 0, annotation_files: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """differential_regions() of reads that are in a cache: nothing is mapped, and only zones with a region are opened for its reads."""
    plan = _planned(samples, design, formula, coef, permutations, seed)
    with scratch(kept.spark) as keep:
        return tuple(map(keep, _differential(kept, plan, settings or Settings(), annotation_files)))


@dataclass(frozen=True)
class _Plan:
    """The labellings of an analysis, the observed one first, with the design matrix of each, and how they were drawn."""

    samples: list[str]
    labellings: list[list[int]]
    matrices: list[np.ndarray]
    contrast: np.ndarray
    requested: int
    available: int
    generated: int


def _planned(samples: Sequence[str], design: pd.DataFrame, formula: str, coef: str | int | Sequence[float], permutations: int, seed: int) -> _Plan:
    samples = list(samples)
    design = designs.align_design(design, samples)
    column = designs.group_column(design, formula, coef)
    design = design.assign(**{column: designs.as_groups(design[column])})
    levels = list(design[column].cat.categories)
    x, names = designs.design_matrix(design, formula)
    c = designs.contrast(coef, names)
    codes = [levels.index(v) + 1 for v in design[column]]
    drawn, available = permutation_plan(codes, permutations, seed)
    labellings, matrices_of = [codes], [x]
    for own in drawn:
        permuted = design.assign(**{column: pd.Categorical([levels[g - 1] for g in own], categories=levels)})
        try:
            matrix, own_names = designs.design_matrix(permuted, formula)
        except ValueError:
            continue
        if own_names == names:
            matrices_of.append(matrix)
            labellings.append(own)
    return _Plan(samples, labellings, matrices_of, c, permutations, available, len(drawn))


def _differential(source: MappedReads | cache.ReadCache, plan: _Plan, settings: Settings, annotation_files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    codes, n = plan.labellings[0], len(plan.samples)
    loci = cut(source.locus_counts())
    wide = cut(align.dense(loci, plan.samples))
    found = cut(find_regions(wide, codes, plan.labellings, settings))
    pairs = cut(source.region_reads(found))
    whole = cut(regions.complete(regions.region_sums(loci, found).join(regions.region_squares(pairs), ["perm_id", "region_id", "sample"]), n))
    fits = fit_matrices(source.spark, whole, plan.samples, plan.labellings, plan.matrices, plan.contrast)
    tested = whole.filter("perm_id = 0").agg(F.count_distinct("region_id").alias("n"))
    dropped = found.filter("perm_id = 0").agg(F.count("*").alias("all")).crossJoin(tested).select((F.col("all") - F.col("n")).alias("regions_dropped_incomplete_coverage"))
    successful = model.null_statistics(fits).agg(F.count_distinct("perm_id").alias("permutations_successful"))
    drawn = (("permutations_requested", plan.requested), ("nonredundant_permutations_available", min(plan.available, 2**62)), ("permutations_generated", plan.generated))
    qc = source.qc.crossJoin(screen_qc(wide, codes)).crossJoin(regions.reads_without_local_position(pairs)).crossJoin(dropped).select(
        "*", *[F.lit(v).cast("long").alias(k) for k, v in drawn]
    )
    return calibrated(found, fits), qc.crossJoin(successful).select("*", *_metadata(settings, annotation_files))


def fit_matrices(
    spark: SparkSession, whole: DataFrame, samples: list[str], labellings: list[list[int]], matrices_of: list[np.ndarray] | None = None, c: np.ndarray | None = None,
) -> DataFrame:
    """perm_id, region_id, wald of complete regions."""
    if matrices_of is None or is_plain(matrices_of[0], c, labellings[0]):
        fits = model.two_groups(model.with_link(whole), label_frame(spark, samples, labellings))
    else:
        fits = model.fit_regions(whole, samples, dict(enumerate(matrices_of)), c).withColumnRenamed("statistic", "wald")
    return cut(fits.select("perm_id", "region_id", "wald"))


def is_plain(x: np.ndarray, c: np.ndarray, codes: list[int]) -> bool:
    """Whether the contrast is that of an intercept and the indicator of group 2."""
    return x.shape[1] == 2 and bool((x == np.column_stack([np.ones(len(codes)), np.array(codes) == 2])).all()) and list(c) == [0.0, 1.0]


def calibrated(found: DataFrame, fits: DataFrame) -> DataFrame:
    """The observed regions that have a fit, calibrated against the permuted ones."""
    observed = found.filter("perm_id = 0").join(fits.filter("perm_id = 0").drop("perm_id"), "region_id")
    tested = cut(calibrate.empirical_p(observed.drop("perm_id"), model.null_statistics(fits)))
    return calibrate.false_discovery(tested).withColumnRenamed("wald", "wald_statistic")


def test_regions(
    spark: SparkSession, found: DataFrame, loci: DataFrame, mapped: DataFrame, cpg: DataFrame, samples: list[str],
    labellings: list[list[int]], matrices_of: list[np.ndarray] | None = None, c: np.ndarray | None = None,
) -> DataFrame:
    """The observed regions that are complete, with their statistics and calibration against the permuted ones."""
    whole = regions.complete(regions.region_matrices(loci, mapped, found, cpg), len(samples))
    return calibrated(found, fit_matrices(spark, whole, samples, labellings, matrices_of, c))


def _tables(spark: SparkSession, files: Mapping[str, str] | Sequence[str], positions: str | Mapping[str, str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Reads, positions and sample names of read files and of one index file, or of one for each sample by name."""
    named = records.sample_paths(files)
    reads = records.read_records(spark, named)
    if isinstance(positions, str):
        return reads, records.read_positions(spark, positions), list(named)
    paths = records.annotation_paths(list(named), positions)
    of_sample = F.create_map(*[F.lit(v) for pair in paths.items() for v in pair])
    own = [records.read_positions(spark, path).withColumn("annotation", F.lit(path)) for path in dict.fromkeys(paths.values())]
    return reads.withColumn("annotation", of_sample[F.col("sample")]), functools.reduce(DataFrame.unionByName, own), list(named)


def _annotations(positions: str | Mapping[str, str]) -> list[str]:
    return [positions] if isinstance(positions, str) else list(dict.fromkeys(positions.values()))


def from_files(spark: SparkSession, files: Mapping[str, str] | Sequence[str], positions: str | Mapping[str, str], **arguments) -> tuple[DataFrame, DataFrame]:
    """differential_regions() on read files and a position index file, or one for each sample by name."""
    return differential_regions(*_tables(spark, files, positions), annotation_files=_annotations(positions), **arguments)


def candidates_from_files(spark: SparkSession, files: Mapping[str, str] | Sequence[str], positions: str | Mapping[str, str], **arguments) -> tuple[DataFrame, DataFrame]:
    """find_candidates() on read files and a position index file, or one for each sample by name."""
    return find_candidates(*_tables(spark, files, positions), annotation_files=_annotations(positions), **arguments)


def cache_files(spark: SparkSession, files: Mapping[str, str] | Sequence[str], positions: str | Mapping[str, str], path: str, buckets: int = cache.BUCKETS) -> cache.ReadCache:
    """A cache under path of read files and a position index file, or one for each sample by name: from_cache() and
    candidates_from_cache() start from it."""
    reads, index, _ = _tables(spark, files, positions)
    return cache.write(path, reads, index, buckets)
