"""Queries of the engine by name, with the SQL that another engine can check them by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hapdiff.functions.permutations import plan as permutation_plan_of
from hapdiff.operators import align, calibrate, model, regions, screen, segment, smooth
from hapdiff.operators.storage import checkpoint_folder, cut, remove
from hapdiff.plans import differential, oracle
from hapdiff.plans.fixture import GROUPS, SAMPLES, tables
from hapdiff.sources import cache
from hapdiff.streaming import ingest

SETTINGS = differential.Settings()
LABELLINGS = oracle.LABELLINGS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _r(name: str, digits: int = 6) -> Column:
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def _rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f'round({n}, {digits})+0.0 as "{n}"' for n in names)


def _query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reads, cpg = tables(spark, d)
    return align.map_reads(reads, cpg), cpg


def _kept_reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mapped reads and positions, kept as an analysis keeps them."""
    reads, cpg = tables(spark, d)
    cpg = cut(cpg)
    return cut(align.map_reads(reads, cpg)), cpg


def _loci(spark: SparkSession, d: str) -> DataFrame:
    return align.locus_counts(*_kept_reads(spark, d))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return cut(align.dense(_loci(spark, d), SAMPLES))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return screen.screen(_wide(spark, d), GROUPS)


def _stats(spark: SparkSession, d: str, labellings: list | None = None) -> DataFrame:
    kept = _kept(spark, d)
    stats = screen.locus_statistics(kept, differential.plan_frame(spark, labellings or [GROUPS]), screen.screen_parameters(kept, SETTINGS.min_in_span))
    return stats.join(smooth.blocks(cut(kept.select("chr", "pos")), SETTINGS.max_gap_smooth), ["chr", "pos"])


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return cut(differential.locus_signals(_wide(spark, d), GROUPS, [GROUPS], SETTINGS))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return segment.runs(_signals(spark, d), SETTINGS.threshold, SETTINGS.max_gap_region)


def _found(spark: SparkSession, d: str, labellings: list | None = None) -> DataFrame:
    return cut(differential.find_regions(_wide(spark, d), GROUPS, labellings or [GROUPS], SETTINGS))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    mapped, cpg = _kept_reads(spark, d)
    wide = cut(align.dense(align.locus_counts(mapped, cpg), SAMPLES))
    return regions.region_reads(mapped, cut(differential.find_regions(wide, GROUPS, [GROUPS], SETTINGS)), cpg)


def _matrices(spark: SparkSession, d: str, labellings: list | None = None) -> DataFrame:
    mapped, cpg = _kept_reads(spark, d)
    loci = cut(align.locus_counts(mapped, cpg))
    found = cut(differential.find_regions(cut(align.dense(loci, SAMPLES)), GROUPS, labellings or [GROUPS], SETTINGS))
    own = regions.region_matrices(loci, mapped, found, cpg)
    return regions.complete(own, len(SAMPLES))


def _fits(spark: SparkSession, d: str, labellings: list | None = None) -> DataFrame:
    own = labellings or [GROUPS]
    return model.two_groups(model.with_link(_matrices(spark, d, own)), differential.label_frame(spark, SAMPLES, own))


# ---- reads and positions


@_query("read_scan", oracle.sql("reads", "select * from reads"))
def read_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)[0].select("sample", "chr", "read_start", "read_end", "hap", "cnt", "strand")


@_query("read_validity", oracle.sql("mapped", "select sample, ok, count(*) as n, sum(cnt) as cnt from mapped group by all"))
def read_validity(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)[0].groupBy("sample", align.valid_record().alias("ok")).agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt"))


@_query(
    "read_qc",
    oracle.sql("flagged", """select count(*) as total_records, count(*) filter (mapping_valid) as valid_records, count(*) filter (not mapping_valid) as invalid_records,
    count(*) filter (bad_hap) as invalid_haplotype_string, count(*) filter (missing_annotation) as missing_cpg_annotation, count(*) filter (length_mismatch) as cpg_length_mismatch from flagged"""),
)
def read_qc(spark: SparkSession, d: str) -> DataFrame:
    return align.read_qc(_mapped(spark, d)[0])


@_query("cpg_index", oracle.sql("cpg", "select chr, pos, ci::bigint as ci from cpg"))
def cpg_index(spark: SparkSession, d: str) -> DataFrame:
    cpg = tables(spark, d)[1].select("chr", "pos")
    return align.position_index(cpg.unionByName(cpg)).select("chr", "pos", F.col("ci").cast("long").alias("ci"))


@_query("index_in_span", oracle.sql("reads", "select c.chr as chr, c.pos as pos from cpg c join (select chr, min(read_start) as lo, max(read_end) as hi from reads group by chr) s on s.chr=c.chr and c.pos between lo and hi"))
def index_in_span(spark: SparkSession, d: str) -> DataFrame:
    reads, cpg = tables(spark, d)
    return align.needed_positions(cpg.select("chr", "pos"), reads)


_MAP = ("sample", "chr", "read_start", "read_end", "hap", "cnt", "strand")


@_query("read_map", oracle.sql("flagged", f"select {', '.join(_MAP)}, ci_start::bigint as ci_start, ci_end::bigint as ci_end, missing_annotation, length_mismatch, mapping_valid, state from flagged"))
def read_map(spark: SparkSession, d: str) -> DataFrame:
    flags = ("missing_annotation", "length_mismatch", "mapping_valid", "state")
    return _mapped(spark, d)[0].select(*_MAP, *[F.col(c).cast("long").alias(c) for c in ("ci_start", "ci_end")], *flags)


@_query("read_collapse", oracle.sql("reads", "select sample, chr, read_start, read_end, hap, strand, sum(cnt) as cnt, count(*) as n_records from reads group by all"))
def read_collapse(spark: SparkSession, d: str) -> DataFrame:
    return align.collapse(tables(spark, d)[0])


@_query(
    "read_distinct_span",
    oracle.sql("flagged", "select sample, chr, read_start, read_end, ci_start::bigint as ci_start, ci_end::bigint as ci_end, sum(cnt) as cnt, count(distinct (hap, strand)) as nd from flagged where mapping_valid group by all"),
)
def read_distinct_span(spark: SparkSession, d: str) -> DataFrame:
    return align.distinct_spans(_mapped(spark, d)[0]).withColumns({c: F.col(c).cast("long") for c in ("ci_start", "ci_end")})


# ---- loci

_LOCI = oracle.sql("loci", f"select sample, chr, pos, t, s, {_rs('m')} from loci")


@_query("locus_counts", _LOCI)
def locus_counts(spark: SparkSession, d: str) -> DataFrame:
    return _loci(spark, d).select("sample", "chr", "pos", "t", "s", _r("m"))


@_query("locus_counts_events", _LOCI)
def locus_counts_events(spark: SparkSession, d: str) -> DataFrame:
    return align.locus_counts_by_events(*_kept_reads(spark, d)).select("sample", "chr", "pos", "t", "s", _r("m"))


@_query(
    "locus_dense",
    oracle.sql("loci", "select chr, pos, " + ", ".join(f"coalesce(sum({c}) filter (sample='{s}'), 0) as {c}_{s}" for c in "st" for s in SAMPLES) + " from loci group by chr, pos"),
)
def locus_dense(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).select("chr", "pos", *[F.col(c)[k].alias(f"{c}_{s}") for c in "st" for k, s in enumerate(SAMPLES)])


@_query("locus_long", _LOCI)
def locus_long(spark: SparkSession, d: str) -> DataFrame:
    return align.long(_wide(spark, d), SAMPLES).select("sample", "chr", "pos", "t", "s", _r("m"))


@_query("locus_screen", oracle.sql("kept", f"select chr, pos, {_rs('cov_mean')} from kept"))
def locus_screen(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("chr", "pos", screen.coverage_mean().alias("cov_mean")).select("chr", "pos", _r("cov_mean"))




@_query(
    "locus_excluded",
    oracle.sql("loci", """select chr, pos from loci group by chr, pos
    having coalesce(sum(s) filter (sample in ('s1','s2','s3')), 0) = 0 or coalesce(sum(s) filter (sample in ('s4','s5','s6')), 0) = 0"""),
)
def locus_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Loci that one group doesn't cover where only reads with a 1 count as coverage."""
    return screen.excluded(_wide(spark, d).withColumn("t", F.col("s")), GROUPS).select("chr", "pos")


@_query("screen_qc", oracle.sql("totals", "select count(*) as n_loci, count(*) filter (t1 > 0 and t2 > 0) as n_kept from totals"))
def screen_qc(spark: SparkSession, d: str) -> DataFrame:
    wide = _wide(spark, d)
    return wide.agg(F.count("*").alias("n_loci")).crossJoin(screen.screen(wide, GROUPS).agg(F.count("*").alias("n_kept")))


@_query("coverage_q75", oracle.sql("parameters", f"select {_rs('cov_q75')} from parameters"))
def coverage_q75(spark: SparkSession, d: str) -> DataFrame:
    return screen.screen_parameters(_kept(spark, d), SETTINGS.min_in_span).select(_r("cov_q75"))


@_query("density_span", oracle.sql("parameters", f"select {_rs('density_span')} from parameters"))
def density_span(spark: SparkSession, d: str) -> DataFrame:
    return screen.screen_parameters(_kept(spark, d), SETTINGS.min_in_span).select(_r("density_span"))


_STATS = ("group1_pooled", "group2_pooled", "beta", "beta_raw_std", "mad_group1", "mad_group2", "sd_raw", "cov_mean", "weight")


@_query("locus_stats", oracle.sql("stats", f"select chr, pos, {_rs(*_STATS)}, n_covered_group1::bigint as n_covered_group1, n_covered_group2::bigint as n_covered_group2 from stats where perm_id = 0"))
def locus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("chr", "pos", *map(_r, _STATS), *[F.col(c).cast("long").alias(c) for c in ("n_covered_group1", "n_covered_group2")])


@_query("permuted_stats", oracle.sql("stats", f"select perm_id, count(*) as n, {', '.join(f'round(sum(abs({c})), 4)+0.0 as {c}' for c in ('beta', 'sd_raw', 'weight'))} from stats group by perm_id"))
def permuted_stats(spark: SparkSession, d: str) -> DataFrame:
    own = _stats(spark, d, LABELLINGS).groupBy("perm_id").agg(F.count("*").alias("n"), *[F.sum(F.abs(c)).alias(c) for c in ("beta", "sd_raw", "weight")])
    return own.select("perm_id", "n", *[_r(c, 4) for c in ("beta", "sd_raw", "weight")])


# ---- smoothing and segments


@_query("locus_blocks", oracle.sql("blocked", "select chr, pos, block::bigint as block from blocked"))
def locus_blocks(spark: SparkSession, d: str) -> DataFrame:
    return smooth.blocks(cut(_kept(spark, d).select("chr", "pos")), SETTINGS.max_gap_smooth).select("chr", "pos", F.col("block").cast("long").alias("block"))


@_query("block_bandwidth", oracle.sql("bands", f"select chr, block::bigint as block, n, n_fit, is_short, case when not is_short then round(nn, 6)+0.0 end as nn from bands where perm_id = 0"))
def block_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    own = smooth.bandwidths(_stats(spark, d), SETTINGS.min_in_span, SETTINGS.min_cpgs)
    return own.select("chr", F.col("block").cast("long").alias("block"), "n", "n_fit", "is_short", _r("nn"))


@_query("local_fit", oracle.sql("signals", f"select chr, pos, {_rs('signal')} from signals where perm_id = 0 and smoothed"))
def local_fit(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).filter("smoothed").select("chr", "pos", _r("signal"))


@_query("smoothed_signal", oracle.sql("signals", f"select chr, pos, smoothed, {_rs('signal', 'beta_raw_std')} from signals where perm_id = 0"))
def smoothed_signal(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("chr", "pos", "smoothed", _r("signal"), _r("beta_raw_std"))


@_query("signal_direction", oracle.sql("directed", "select dir, raw_dir, count(*) as n from directed where perm_id = 0 group by all"))
def signal_direction(spark: SparkSession, d: str) -> DataFrame:
    own = _signals(spark, d).filter("signal is not null")
    return own.groupBy(segment.direction(F.col("signal"), 0.1).alias("dir"), segment.direction(F.col("beta_raw_std"), 0.1).alias("raw_dir")).agg(F.count("*").alias("n"))


@_query("region_clusters", oracle.sql("clustered", "select chr, cluster::bigint as cluster, min(pos) as lo, max(pos) as hi, count(*) as n from clustered where perm_id = 0 group by all"))
def region_clusters(spark: SparkSession, d: str) -> DataFrame:
    own = segment.clusters(_signals(spark, d), SETTINGS.max_gap_region)
    return own.groupBy("chr", F.col("cluster").cast("long").alias("cluster")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))


@_query("signal_runs", oracle.sql("segmented", "select chr, segment::bigint as segment, any_value(dir)::bigint as dir, min(pos) as lo, max(pos) as hi, count(*) as n from segmented where perm_id = 0 group by chr, segment"))
def signal_runs(spark: SparkSession, d: str) -> DataFrame:
    own = _runs(spark, d).groupBy("chr", F.col("segment").cast("long").alias("segment"))
    return own.agg(F.first("dir").cast("long").alias("dir"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))


@_query("raw_trim", oracle.sql("trimmed", "select chr, min(pos) as lo, max(pos) as hi, count(*) as n from trimmed where perm_id = 0 group by chr, segment"))
def raw_trim(spark: SparkSession, d: str) -> DataFrame:
    own = segment.raw_trim(_runs(spark, d), SETTINGS.min_cpgs)
    return own.groupBy("chr", "segment").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).drop("segment")


@_query("shape_trim", oracle.sql("limits", "select chr, segment::bigint as segment, n::bigint as n, f::bigint as first, l::bigint as last from limits where perm_id = 0"))
def shape_trim(spark: SparkSession, d: str) -> DataFrame:
    own = segment.shape_limits(segment.raw_trim(_runs(spark, d), SETTINGS.min_cpgs), SETTINGS.min_cpgs)
    return own.select("chr", *[F.col(c).cast("long").alias(c) for c in ("segment", "n", "first", "last")])


_CAND = f'select chr, start, "end", direction, {_rs("max_abs_smooth", "mean_smooth")}, n_loci, block::bigint as block, n_smoothed from candidates where perm_id = 0'


@_query("candidates", oracle.sql("candidates", _CAND))
def candidates(spark: SparkSession, d: str) -> DataFrame:
    own = _found(spark, d)
    return own.select("chr", "start", "end", "direction", _r("max_abs_smooth"), _r("mean_smooth"), "n_loci", F.col("block").cast("long").alias("block"), "n_smoothed")


# ---- regions


@_query("region_sums", oracle.sql("sums", "select region_id, sample, s, t from sums where perm_id = 0"))
def region_sums(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_sums(cut(_loci(spark, d)), _found(spark, d)).select("region_id", "sample", "s", "t")


@_query("region_nsq", oracle.sql("squares", "select region_id, sample, nsq from squares where perm_id = 0"))
def region_nsq(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_squares(_pairs(spark, d)).select("region_id", "sample", "nsq")


@_query("region_sums_from_reads", oracle.sql("matrices", "select region_id, sample, s, t, nsq from matrices where perm_id = 0"))
def region_sums_from_reads(spark: SparkSession, d: str) -> DataFrame:
    return regions.sums_from_reads(_pairs(spark, d)).select("region_id", "sample", "s", "t", "nsq")


@_query("reads_without_local_cpg", oracle.sql("pairs", "select count(*) as reads_without_local_cpg from (select distinct region_id, sample, read_start, read_end, hap, strand from pairs where n = 0 and perm_id = 0)"))
def reads_without_local_cpg(spark: SparkSession, d: str) -> DataFrame:
    return regions.reads_without_local_position(_pairs(spark, d))


@_query("region_complete", oracle.sql("whole", "select region_id, sample, s, t, nsq from whole where perm_id = 0"))
def region_complete(spark: SparkSession, d: str) -> DataFrame:
    return _matrices(spark, d).select("region_id", "sample", "s", "t", "nsq")


# ---- model and calibration


@_query("link_kappa", oracle.sql("linked", f"select region_id, sample, {_rs('z', 'kappa')} from linked where perm_id = 0"))
def link_kappa(spark: SparkSession, d: str) -> DataFrame:
    return model.with_link(_matrices(spark, d)).select("region_id", "sample", _r("z"), _r("kappa"))


@_query("gls_two_group", oracle.sql("fits", f"select region_id, {_rs('estimate', 'wald', 'phi')} from fits where perm_id = 0"))
def gls_two_group(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).select("region_id", _r("estimate"), _r("wald"), _r("phi"))


@_query("gls_general", oracle.sql("fits", "select region_id, round(estimate, 6)+0.0 as estimate, round(wald, 6)+0.0 as wald, round(phi, 6)+0.0 as phi from fits where perm_id = 0"))
def gls_general(spark: SparkSession, d: str) -> DataFrame:
    """The general fit at the design whose closed form gls_two_group has."""
    x = np.column_stack([np.ones(len(SAMPLES)), np.array(GROUPS) - 1.0])
    own = model.fit_regions(_matrices(spark, d), SAMPLES, {0: x}, np.array([0.0, 1.0]))
    own = own.select("region_id", F.col("coef")[1].alias("estimate"), F.col("statistic").alias("wald"), "phi")
    return own.select("region_id", _r("estimate"), _r("wald"), _r("phi"))


@_query("wald_pvalue", oracle.sql("covariate", "select region_id, round(statistic, 6)+0.0 as statistic, round(p_value, 9)+0.0 as p_value, round(phi, 6)+0.0 as phi from covariate"))
def wald_pvalue(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and normal p values of a design with a covariate."""
    x = np.column_stack([np.ones(len(SAMPLES)), np.array(GROUPS) - 1.0, np.array(oracle.COVARIATE)])
    own = model.fit_regions(_matrices(spark, d), SAMPLES, {0: x}, np.array([0.0, 1.0, 0.0]))
    return own.select("region_id", _r("statistic"), _r("p_value", 9), _r("phi"))


@_query(
    "permutation_plan",
    """with m as (select r_name as sample, avg(c_acctbal) as b from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by r_name),
    g as (select row_number() over (order by sample) - 1 as k, (row_number() over (order by b, sample) <= 2)::int as small from m),
    o as (select sum(small * (1 << k)::int) as mask, count(*) as n from g),
    l as (select i as mask, bit_count(i & o.mask::bigint) as own, n from (select unnest(range(32)) as i), o where bit_count(i) = 2),
    t as (select array_to_string(list_transform(range(n), lambda k: case when mask & (1 << k)::int <> 0 then '1' else '2' end), '') as labels, own from l)
    select labels, own = 2 as observed, (select count(*) from t where own = 1) as available from t where own >= 1""",
)
def permutation_plan(spark: SparkSession, d: str) -> DataFrame:
    """All labellings of the regions' customers, observed with the two poorest regions as one group: those whose smaller group mixes both."""
    customer, nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    means = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.avg("c_acctbal").alias("b"))
    poorest = {r.r_name for r in means.orderBy("b", "r_name").limit(2).collect()}
    names = sorted(r.r_name for r in means.collect())  # a row for each sample, as in any design
    observed = [1 if n in poorest else 2 for n in names]
    drawn, available = permutation_plan_of(observed, 100)
    spelled = F.array_join(F.transform("grp", lambda g: g.cast("string")), "").alias("labels")
    return differential.plan_frame(spark, [observed, *drawn]).select(spelled, (F.col("perm_id") == 0).alias("observed"), F.lit(available).cast("long").alias("available"))


@_query("null_pool", oracle.sql("fits", f"select perm_id, region_id, {_rs('wald')} from fits where perm_id > 0"))
def null_pool(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, LABELLINGS).filter("perm_id > 0").select("perm_id", "region_id", _r("wald"))



@_query(
    "empirical_p",
    """with o as (select o_orderkey as id, (o_totalprice - 150000)/30000 as wald from orders), n as (select (c_acctbal - 4500)/1500 as wald from customer),
    a as (select abs(wald) as x, 1 as of_null, null as id, wald from n union all select abs(wald), 0, id, wald from o)
    select id, round(wald, 6)+0.0 as wald, round((c+1)/((select count(*) from n)+1), 9)+0.0 as empirical_p_value, (select count(*) from n) as null_pool_size
    from (select *, sum(of_null) over (order by x desc range between unbounded preceding and current row) as c from a) where of_null = 0""",
)
def empirical_p(spark: SparkSession, d: str) -> DataFrame:
    """The operator over all order prices as statistics and all customer balances as their null."""
    observed = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), ((F.col("o_totalprice") - 150000) / 30000).alias("wald"))
    null = spark.read.parquet(f"{d}/customer.parquet").select(((F.col("c_acctbal") - 4500) / 1500).alias("wald"))
    return calibrate.empirical_p(observed, null).select("id", _r("wald"), _r("empirical_p_value", 9), "null_pool_size")


@_query(
    "bh_fdr",
    """select id, p, round(least(1, min(p*n/rk) over (order by rk desc rows between unbounded preceding and current row)), 9)+0.0 as fdr from (
    select o_orderkey as id, round(o_totalprice/1000000, 4) as p, count(*) over () as n, row_number() over (order by round(o_totalprice/1000000, 4)) as rk from orders)""",
)
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000000, 4).alias("p"))
    return calibrate.false_discovery(own, "p").select("id", "p", _r("fdr", 9))


def _results(spark: SparkSession, d: str) -> DataFrame:
    mapped, cpg = _kept_reads(spark, d)
    loci = cut(align.locus_counts(mapped, cpg))
    found = cut(differential.find_regions(cut(align.dense(loci, SAMPLES)), GROUPS, LABELLINGS, SETTINGS))
    return differential.test_regions(spark, found, loci, mapped, cpg, SAMPLES, LABELLINGS)


@_query(
    "diff_regions",
    oracle.sql("called", f'select chr, start, "end", direction, n_loci, n_smoothed, {_rs("max_abs_smooth", "mean_smooth")}, round(wald, 6)+0.0 as wald_statistic, round(p, 9)+0.0 as empirical_p_value, round(fdr, 9)+0.0 as fdr, null_pool_size from called'),
)
def diff_regions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_results(spark, d))


def _rounded(results: DataFrame) -> DataFrame:
    return results.select(
        "chr", "start", "end", "direction", "n_loci", "n_smoothed", _r("max_abs_smooth"), _r("mean_smooth"), _r("wald_statistic"), _r("empirical_p_value", 9), _r("fdr", 9), "null_pool_size"
    )


_LABELS_SQL = """(select p_partkey as label_id, concat('chr', cast(1+p_partkey%4 as {text})) as chr, 90 + 40*cast(floor(p_partkey/4) as bigint) + 3000*cast(floor(floor(p_partkey/4)/60) as bigint) as start0,
 690 + 40*cast(floor(p_partkey/4) as bigint) + 3000*cast(floor(floor(p_partkey/4)/60) as bigint) as label_end, case when p_size%3=0 then 'Hyper' when p_size%3=1 then 'Hypo' else 'NC' end as category from {part})"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    labels = spark.sql("select * from " + _LABELS_SQL.format(text="string", part="{part}"), part=part)
    return regions.overlap_labels(cut(_results(spark, d).select("chr", "start", "end", "direction", "fdr")), labels)


_HITS = "(select l.label_id, l.category, r.chr, r.start, r.\"end\", r.direction, r.fdr from called r join " + _LABELS_SQL.format(text="varchar", part="part") + " l on l.chr=r.chr and r.start <= l.label_end and r.\"end\" >= l.start0+1)"
_BEST = f'(select * from {_HITS} qualify row_number() over (partition by label_id order by fdr, chr, start, "end") = 1)'


@_query("overlap_labels", oracle.sql("called", f'select label_id, category, chr, start, "end", direction from {_HITS}'))
def overlap_labels(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("label_id", "category", "chr", "start", "end", "direction")


@_query("best_hit", oracle.sql("called", f'select label_id, category, chr, start, "end", direction, round(fdr, 9)+0.0 as fdr from {_BEST}'))
def best_hit(spark: SparkSession, d: str) -> DataFrame:
    return regions.best_hit(_hits(spark, d)).select("label_id", "category", "chr", "start", "end", "direction", _r("fdr", 9))


@_query("confusion", oracle.sql("called", f"select category, case when fdr > 0.05 then 'NC' when direction = '-' then 'Hyper' else 'Hypo' end as call, count(*) as n from {_BEST} group by all"))
def confusion(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("fdr") > 0.05, "NC").when(F.col("direction") == "-", "Hyper").otherwise("Hypo")
    return regions.confusion(regions.best_hit(_hits(spark, d)).withColumn("call", call))


# ---- from a cache of mapped reads, and in batches


def _from_cache(spark: SparkSession, d: str, of: Callable[[cache.ReadCache], DataFrame]) -> DataFrame:
    """What `of` makes of a cache of all reads, which is removed again."""
    reads, cpg = tables(spark, d)
    kept = cache.write(f"{checkpoint_folder(spark)}/cache-{uuid.uuid4().hex}", reads, cpg.select("chr", "pos"), buckets=8)
    try:
        return cut(of(kept))
    finally:
        cache.remove(spark, kept.path)


@_query("locus_counts_cached", _LOCI)
def locus_counts_cached(spark: SparkSession, d: str) -> DataFrame:
    return _from_cache(spark, d, lambda kept: kept.locus_counts().select("sample", "chr", "pos", "t", "s", _r("m")))


@_query("region_nsq_cached", ORACLE_SQL["region_nsq"])
def region_nsq_cached(spark: SparkSession, d: str) -> DataFrame:
    def of(kept: cache.ReadCache) -> DataFrame:
        found = cut(differential.find_regions(cut(align.dense(kept.locus_counts(), SAMPLES)), GROUPS, [GROUPS], SETTINGS))
        return regions.region_squares(kept.region_reads(found)).select("region_id", "sample", "nsq")

    return _from_cache(spark, d, of)


@_query("diff_regions_cached", ORACLE_SQL["diff_regions"])
def diff_regions_cached(spark: SparkSession, d: str) -> DataFrame:
    design = pd.DataFrame({"group": ["ab"[g - 1] for g in GROUPS]})
    return _from_cache(spark, d, lambda kept: _rounded(differential.from_cache(kept, SAMPLES, design, "~ group", "groupb", permutations=len(LABELLINGS) - 1)[0]))


@_query("locus_counts_stream", _LOCI)
def locus_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """All reads in batches of two files, added to a store; the store's sums."""
    reads, cpg = tables(spark, d)
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        reads.repartition(8).write.parquet(f"{base}/reads")
        stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/reads")
        ingest.ingest(stream, cpg.select("chr", "pos"), f"{base}/store", once=True).awaitTermination()
        return cut(ingest.locus_counts(spark, f"{base}/store").select("sample", "chr", "pos", "t", "s", _r("m")))
    finally:
        remove(spark, base)
