"""Mapped reads and positions kept as bucketed tables, from which analyses start.

A cache has a table of the valid reads, each identical group once and in each bin of bases that it touches, and a table of the
positions of each bin. Both are bucketed by (chr, bin), so counts by locus and sums over regions join and group them without an
exchange. Reads are partitioned by zone, a chromosome's stretch of ZONE bases; a reader that has regions at hand opens only the
zones of those regions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hapdiff.operators import align, storage
from hapdiff.operators.regions import BIN, region_pairs
from hapdiff.operators.storage import cut

#: Bases of a zone: a genome has a few hundred.
ZONE = 1 << 24
BUCKETS = 64
KEYS = ("chr", "bin")


def _bin(c: Column) -> Column:
    return F.floor(c / BIN).cast("long")


def _zone(bin_: Column) -> Column:
    return F.concat_ws(":", "chr", F.floor(bin_ * BIN / ZONE).cast("string"))


def _keys(df: DataFrame) -> list[str]:
    return [*align.annotation_of(df), *KEYS]


def bin_cells(cpg: DataFrame) -> DataFrame:
    """chr, bin, first_ci, at: the positions of each bin in order and the number of the first. A bin has at most BIN of them."""
    keys = [*align.annotation_of(cpg), "chr"]
    return cpg.groupBy(*keys, _bin(F.col("pos")).alias("bin")).agg(F.min("ci").alias("first_ci"), F.sort_array(F.collect_list("pos")).alias("at"))


def bin_reads(mapped: DataFrame, cells: DataFrame) -> DataFrame:
    """The valid reads of map_reads(), identical ones as one, in a row for each bin that they touch: with bin, begins (it is the bin
    in which the read begins), ci_from and ci_to, the numbers of its positions in the bin (none: ci_from > ci_to), and zone."""
    which = align.annotation_of(mapped)
    own = mapped.filter("mapping_valid").groupBy("sample", *which, "chr", "read_start", "read_end", "ci_start", "ci_end", "hap", "strand", "state").agg(F.sum("cnt").alias("cnt"))
    rows = own.withColumn("bin", F.explode(F.sequence(_bin(F.col("read_start")), _bin(F.col("read_end")))))
    at = rows.join(cells.select(*_keys(cells), "first_ci", F.size("at").alias("size")), _keys(cells), "left")
    none = F.lit(0)
    return at.select(
        "sample", *which, "chr", "bin", (F.col("bin") == _bin(F.col("read_start"))).alias("begins"), "read_start", "read_end", "ci_start", "ci_end",
        F.coalesce(F.greatest("ci_start", "first_ci"), none + 1).alias("ci_from"), F.coalesce(F.least(F.col("ci_end"), F.col("first_ci") + F.col("size") - 1), none).alias("ci_to"),
        "hap", "strand", "state", "cnt", _zone(F.col("bin")).alias("zone"),
    )


def _name(path: str, part: str) -> str:
    return f"hapdiff_cache_{hashlib.md5(path.encode()).hexdigest()[:16]}_{part}"


@dataclass(frozen=True)
class ReadCache:
    """A cache that is open in a session: reads and cells, bucketed; qc, the one row of counters of the reads it was made from."""

    spark: SparkSession
    path: str
    reads: DataFrame
    cells: DataFrame
    qc: DataFrame

    @property
    def cpg(self) -> DataFrame:
        """chr, pos, ci, as position_index() gives them."""
        keys = [*align.annotation_of(self.cells), "chr"]
        at = self.cells.select(*keys, "first_ci", F.posexplode("at").alias("k", "pos"))
        return at.select(*keys, "pos", (F.col("first_ci") + F.col("k")).cast("int").alias("ci"))

    def locus_counts(self) -> DataFrame:
        """align.locus_counts() of the reads: joins and groups within bins, so nothing is exchanged."""
        keys = _keys(self.cells)
        spans = self.reads.filter("ci_from <= ci_to").groupBy("sample", *keys, "ci_from", "ci_to").agg(
            F.sum("cnt").alias("t"), F.sum(F.when(F.col("state"), F.col("cnt")).otherwise(0.0)).alias("s")
        )
        own = F.slice("at", F.col("ci_from") - F.col("first_ci") + 1, F.col("ci_to") - F.col("ci_from") + 1)
        at = spans.join(self.cells, keys).select("sample", *keys, "t", "s", F.explode(own).alias("pos"))
        loci = at.groupBy("sample", *keys, "pos").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
        return loci.select("sample", "chr", "pos", "t", "s", (F.col("s") / F.col("t")).alias("m"))

    def region_reads(self, regions: DataFrame) -> DataFrame:
        """regions.region_reads() of the cached reads. Zones without a region are not opened: their names, at most one for each
        partition of the cache, are known before the reads are looked at."""
        own = cut(region_pairs(regions, self.cpg))
        own = own.withColumn("bin", F.explode(F.sequence(_bin(F.col("start")), _bin(F.col("end")))))
        zones = own.filter(F.col("start") <= F.col("end")).select(_zone(F.col("bin")).alias("zone")).distinct()
        near = self.reads.join(F.broadcast(zones), "zone", "left_semi")
        which = align.annotation_of(self.cells)
        pairs = near.join(own.withColumnsRenamed({f"r_{c}": c for c in which}), [*which, *KEYS])
        pairs = pairs.filter((F.col("read_start") <= F.col("end")) & (F.col("read_end") >= F.col("start")))
        pairs = pairs.filter(F.col("bin") == _bin(F.greatest("read_start", "start")))
        shared = F.greatest(F.lit(0), F.least("ci_end", "r_end") - F.greatest("ci_start", "r_start") + 1)
        return pairs.withColumn("n", shared).drop(*which, "bin", "begins", "ci_from", "ci_to", "zone")


def write(path: str, reads: DataFrame, positions: DataFrame, buckets: int = BUCKETS) -> ReadCache:
    """Maps reads to positions, once, and keeps what later analyses need under path, a folder of the cluster's shared storage, where
    an older cache is replaced. Invalid reads are only counted: the counters are observed as the reads pass."""
    spark = reads.sparkSession
    remove(spark, path)
    cpg = cut(align.position_index(positions))
    cells = cut(bin_cells(cpg))
    seen = Observation()
    mapped = align.map_reads(reads, cpg).observe(seen, *align.qc_counters())
    for part, df, zones in (("cells", cells, []), ("reads", bin_reads(mapped, cells), ["zone"])):
        keys = _keys(cells)
        dealt = df.repartition(buckets, *keys)  # each bucket's rows in one task: one file for each bucket and zone
        out = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{part}")
        (out.partitionBy(*zones) if zones else out).saveAsTable(_name(path, part))
    counters = align.observed(seen)
    spark.createDataFrame([(buckets, *counters.values())], ", ".join(["buckets int", *[f"{c} long" for c in counters]])).coalesce(1).write.parquet(f"{path}/about")
    return _opened(spark, path, spark.read.parquet(f"{path}/about"))


def open_cache(spark: SparkSession, path: str) -> ReadCache:
    """A cache that write() made, in any session: its tables are made known to the session's catalog with their buckets."""
    about = spark.read.parquet(f"{path}/about")
    buckets = about.first()["buckets"]
    for part in ("cells", "reads"):
        name = _name(path, part)
        if spark.catalog.tableExists(name):
            continue
        found = spark.read.parquet(f"{path}/{part}").schema
        own = StructType([StructField(f.name, StringType() if f.name == "zone" else f.dataType) for f in found])
        keys = ", ".join(f"`{c}`" for c in (["annotation"] if "annotation" in own.names else []) + list(KEYS))
        zones = " partitioned by (zone)" if "zone" in own.names else ""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
        spark.sql(f"create table {name} ({columns}) using parquet{zones} clustered by ({keys}) sorted by ({keys}) into {buckets} buckets location '{path}/{part}'")
        if zones:
            spark.sql(f"alter table {name} recover partitions")
    return _opened(spark, path, about)


def _opened(spark: SparkSession, path: str, about: DataFrame) -> ReadCache:
    qc = about.select(*[F.col(c).cast("long").alias(c) for c in about.columns if c != "buckets"])
    return ReadCache(spark, path, spark.table(_name(path, "reads")), spark.table(_name(path, "cells")), qc)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a cache and forgets its tables."""
    for part in ("cells", "reads"):
        spark.sql(f"drop table if exists {_name(path, part)}")
    storage.remove(spark, path)
