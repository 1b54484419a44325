"""Read records and position indexes from headerless text, and results to files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hapdiff.sources.bgzf import read_lines

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def sample_paths(files: Mapping[str, str] | Sequence[str]) -> dict[str, str]:
    """Sample name to path; unnamed files become sample1, sample2, ... At least two, names and paths unique. That a path is there
    Spark checks when it makes the plan."""
    named = dict(files) if isinstance(files, Mapping) else {f"sample{k}": p for k, p in enumerate(files, 1)}
    if len(named) < 2:
        raise ValueError("at least two samples are needed")
    if any(not n or not p for n, p in named.items()):
        raise ValueError("sample names and paths must not be empty")
    if len(set(named.values())) != len(named):
        raise ValueError("a path is given twice")
    return named


def annotation_paths(samples: Sequence[str], paths: str | Mapping[str, str]) -> dict[str, str]:
    """Sample to index path: one for all, or one for each sample by name."""
    if isinstance(paths, str):
        return {s: paths for s in samples}
    if set(paths) != set(samples):
        raise ValueError("annotation names must be the sample names")
    return {s: paths[s] for s in samples}


def _trimmed(c: Column) -> Column:
    value = F.trim(c, F.lit(" \t\r"))
    return F.when(value != "NA", value)


def _number(c: Column) -> Column:
    """Finite numbers only; anything else is null."""
    value = _trimmed(c)
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def _fields(df: DataFrame, least: int) -> DataFrame:
    rows = df.filter(F.length(F.trim("value", F.lit(" \t\r"))) > 0)
    parts = F.split(F.rtrim("value", F.lit("\r")), "\t")
    last = F.element_at(parts, -1)
    n = F.size(parts) - F.when((F.size(parts) > 1) & (last == ""), 1).otherwise(0)
    checked = F.when(n >= least, parts).otherwise(F.raise_error(F.concat(F.lit(f"a record has fewer than {least} fields: "), F.col("value"))).cast("array<string>"))
    return rows.withColumn("f", checked)


def as_records(lines: DataFrame) -> DataFrame:
    """sample, chr, read_start, read_end, hap, cnt, strand of lines (sample, value)."""
    f = _fields(lines, 6)
    return f.select(
        "sample", _trimmed(F.col("f")[0]).alias("chr"), _number(F.col("f")[1]).alias("read_start"), _number(F.col("f")[2]).alias("read_end"),
        _trimmed(F.col("f")[3]).alias("hap"), _number(F.col("f")[4]).alias("cnt"), _trimmed(F.col("f")[5]).alias("strand"),
    )


def read_records(spark: SparkSession, files: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """sample, chr, read_start, read_end, hap, cnt, strand of all samples' files (plain, gz or block-gzip), blank lines left out.

    A block-gzip file is read by as many tasks as its size asks for.
    A line with fewer than six fields stops the job; fields that aren't numbers become null.
    """
    parts = [as_records(read_lines(spark, path).select(F.lit(sample).alias("sample"), "value")) for sample, path in sample_paths(files).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos of an index file, as position_index() takes it."""
    f = _fields(read_lines(spark, path), 2)
    return f.select(_trimmed(F.col("f")[0]).alias("chr"), _number(F.col("f")[1]).alias("pos"))


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as csv (with header) or parquet."""
    if kind not in ("csv", "parquet"):
        raise ValueError("kind is csv or parquet")
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_read_cache(mapped: DataFrame, path: str) -> None:
    """Mapped reads as Parquet by chromosome, so that a later job reads only the chromosomes it asks for."""
    mapped.write.mode("overwrite").partitionBy("chr").parquet(path)


def read_read_cache(spark: SparkSession, path: str, chromosomes: Sequence[str] | None = None) -> DataFrame:
    """Reads that write_read_cache() wrote, of some chromosomes or all; the folders of the others are not opened."""
    reads = spark.read.schema(_cache_schema(spark, path)).parquet(path)
    return reads if chromosomes is None else reads.filter(F.col("chr").isin(list(chromosomes)))


def _cache_schema(spark: SparkSession, path: str) -> StructType:
    """The cache's columns with chr as text: a folder named chr=1 would else be read as a number."""
    found = spark.read.parquet(path).schema
    return StructType([StructField(f.name, StringType() if f.name == "chr" else f.dataType) for f in found])
