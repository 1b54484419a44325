"""Counts by locus of reads that arrive bit by bit: each micro-batch adds its sums to a store, once, however often it is run.

A store is a folder of the cluster's shared storage with a folder of sums and one of counters for each batch, named by its id. A batch
that Spark repeats after a failure has the id and the rows that it had before and writes the same folders again, so no read counts
twice. What one batch holds in memory is bounded by the stream's batch size, not by the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hapdiff.operators import align
from hapdiff.operators.storage import cut
from hapdiff.sources.records import as_records

LOCI = "sample string, chr string, pos long, t double, s double, batch long"


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the records of text files (plain or gz) that appear in a folder; a file's name up to the first dot is its sample."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return as_records(lines.select(F.url_decode(F.substring_index(name, ".", 1)).alias("sample"), "value"))


def add_batch(reads: DataFrame, batch: int, cpg: DataFrame, store: str) -> None:
    """Adds a batch of reads to the store, or replaces the batch of that id."""
    seen = Observation()
    mapped = align.map_reads(reads, cpg).observe(seen, *align.qc_counters())
    sums = align.locus_counts(mapped, cpg).select("sample", "chr", "pos", "t", "s")
    sums.write.mode("overwrite").parquet(f"{store}/loci/batch={batch}")
    counters = align.observed(seen)
    row = reads.sparkSession.createDataFrame([tuple(counters[c] for c in align.QC)], ", ".join(f"{c} long" for c in align.QC))
    row.coalesce(1).write.mode("overwrite").parquet(f"{store}/counters/batch={batch}")


def ingest(reads: DataFrame, positions: DataFrame, store: str, once: bool = False) -> StreamingQuery:
    """Starts to add a stream of reads to the store; what was added before goes on counting. once: what is there now, then it ends.

    The stream's own checkpoint, in the store, keeps which reads are in which batch.
    """
    cpg = cut(align.position_index(positions))
    writer = reads.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, cpg, store)).option("checkpointLocation", f"{store}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def locus_counts(spark: SparkSession, store: str) -> DataFrame:
    """align.locus_counts() of all reads so far."""
    loci = spark.read.schema(LOCI).parquet(f"{store}/loci").groupBy("sample", "chr", "pos").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    return loci.select("sample", "chr", "pos", "t", "s", (F.col("s") / F.col("t")).alias("m"))


def read_qc(spark: SparkSession, store: str) -> DataFrame:
    """align.read_qc() of all reads so far."""
    rows = spark.read.schema(", ".join(f"{c} long" for c in align.QC)).parquet(f"{store}/counters")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in align.QC])
