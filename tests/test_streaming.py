"""Reads in batches: the same sums for every split, also after a repeated batch and a restart."""

import pytest

from hapdiff.operators import align
from hapdiff.operators.storage import cut
from hapdiff.plans import fixture
from hapdiff.streaming import ingest
from tests.conftest import SMALL, rows


@pytest.fixture(scope="module")
def tables(spark):
    reads, cpg = fixture.tables(spark, SMALL)
    return cut(reads), cut(cpg.select("chr", "pos"))


@pytest.fixture(scope="module")
def whole(tables):
    cpg = align.position_index(tables[1])
    mapped = align.map_reads(tables[0], cpg)
    return rows(align.locus_counts(mapped, cpg).toPandas()), align.read_qc(mapped).first()


@pytest.mark.parametrize("files, each", [(5, 1), (5, 2), (3, 8)])
def test_every_split_gives_the_same_sums(spark, tables, whole, tmp_path, files, each):
    reads, store = tables[0], str(tmp_path / "store")
    reads.repartition(files).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", each).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, tables[1], store, once=True).awaitTermination()
    assert spark.read.parquet(f"{store}/loci").select("batch").distinct().count() == -(-files // each)
    assert rows(ingest.locus_counts(spark, store).toPandas()) == whole[0] and ingest.read_qc(spark, store).first() == whole[1]


def test_a_repeated_batch_counts_once(spark, tables, whole, tmp_path):
    cpg, store = cut(align.position_index(tables[1])), str(tmp_path / "store")
    a, b = tables[0].filter("cnt < 3"), tables[0].filter("not cnt < 3")
    for batch, own in ((0, a), (1, a), (1, b), (0, a)):  # batch 1 is run again with what it holds
        ingest.add_batch(own, batch, cpg, store)
    assert rows(ingest.locus_counts(spark, store).toPandas()) == whole[0] and ingest.read_qc(spark, store).first() == whole[1]


def test_a_stream_goes_on(spark, tmp_path):
    """Text files that arrive between two runs are added to the sums of the first; a stream without files adds nothing."""
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    index = spark.createDataFrame([("1", float(p)) for p in (10, 20, 30)], "chr string, pos double")
    (folder / "a.1.tsv").write_text("1\t10\t30\t010\t2\t+\n\n1\t5\t6\t0\t1\t+\n")
    run = lambda: ingest.ingest(ingest.record_stream(spark, str(folder), 1), index, store, once=True).awaitTermination()
    run()
    (folder / "a.2.tsv").write_text("1\t20\t30\t00\t3\t-\n")
    (folder / "b c.tsv").write_text("1\t10\t10\t1\t1\t-\n")
    run()
    run()
    got = {(r.sample, r.pos): (r.t, r.s) for r in ingest.locus_counts(spark, store).collect()}
    assert got == {("a", 10): (2.0, 2.0), ("a", 20): (5.0, 2.0), ("a", 30): (5.0, 2.0), ("b c", 10): (1.0, 1.0)}
    qc = ingest.read_qc(spark, store).first()
    assert (qc.total_records, qc.valid_records, qc.missing_cpg_annotation) == (4, 3, 1)
