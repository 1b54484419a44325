"""Shards that all hold the corpus's mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.llm.common import whole

#: Ranks are counted inside bins of uniform hashes, so that no source is ordered by one task.
HEX_DIGITS = 3
BINS = 16**HEX_DIGITS


def _before(total: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order) if keys else W.orderBy(order)
    return total.withColumn(name, F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's shard and slot, with size (UTF-8 bytes plus 1) and text_crc32; law: shards' row counts differ by one at most.

    Rows of a source are put in the order of a seeded hash of their id; row r of n gets the fractional rank
    (2r-1)/2n, all rows are ordered by it, and the order is cut into runs of equal length. Null sources are
    one source, apart from the empty name; null texts are empty; rows with equal ids are told apart by their text, and rows equal in
    both are interchangeable.
    """
    text = whole(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        # a null source is none of the others, the empty one included
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("_src"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_k"),
    ).withColumn("_bin", F.conv(F.substring("_k", 1, HEX_DIGITS), 16, 10).cast("int"))
    per_bin = rows.groupBy("_src", "_bin").agg(F.count("*").alias("n"))
    per_bin = _before(per_bin, ["_src"], "_bin", "_off").withColumn("_n_src", F.sum("n").over(W.partitionBy("_src"))).drop("n")
    own = W.partitionBy("_src", "_bin").orderBy("_k", "doc_id", "text_crc32", "size")
    ranked = rows.join(per_bin, ["_src", "_bin"]).withColumn("_r", F.col("_off") + F.row_number().over(own))
    f = (2 * F.col("_r") - 1) / (2 * F.col("_n_src"))
    ranked = ranked.select("doc_id", "size", "text_crc32", "_src", "_k", f.alias("_f"), F.floor(f * BINS).cast("int").alias("_fbin"))
    per_f = _before(ranked.groupBy("_fbin").agg(F.count("*").alias("n")), [], "_fbin", "_foff")
    per_f = per_f.withColumn("_n", F.sum("n").over(W.partitionBy())).drop("n")
    order = W.partitionBy("_fbin").orderBy("_f", "_src", "_k", "doc_id", "text_crc32", "size")
    placed = ranked.join(per_f, "_fbin").withColumn("_pos", F.col("_foff") + F.row_number().over(order) - 1)
    shard = F.expr(f"cast((_pos * {shards}L) div _n as int)")
    first = F.expr(f"((shard * _n) + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# the check value of text_crc32, byte by byte: eight shifts for each, by the polynomial 0xEDB88320
_CRC_STEP = "case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end"
_CRC_TABLE = "select list(c order by b) as crc_table from (select b, c from crc where step = 8)"
ORACLE_SQL = f"""
with recursive crc as (select b, b::bigint as c, 0 as step from range(256) t(b) union all select b, {_CRC_STEP.format(c="c")}, step + 1 from crc where step < 8),
tab as ({_CRC_TABLE}),
d as (select doc_id, octet_length(encode(coalesce(text,'')))::bigint + 1 as size, case when source is null then '' else '=' || source end as src,
             md5('0:' || coalesce(doc_id::varchar, '')) as k,
             xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text,''))), '..'), lambda x: ('0x' || x)::bigint),
                 lambda a, x: xor(a >> 8, crc_table[xor(a & 255, x) + 1]), 4294967295::bigint)) as text_crc32
      from documents, tab),
r as (select *, (2*row_number() over (partition by src order by k, doc_id, text_crc32, size) - 1) / (2*count(*) over (partition by src))::double as f from d),
p as (select *, row_number() over (order by f, src, k, doc_id, text_crc32, size) - 1 as pos, count(*) over () as n from r),
z as (select *, (pos*16)//n as shard from p)
select doc_id, size, text_crc32::bigint as text_crc32, 'rows' as law, shard::int as shard, (pos - (shard*n + 15)//16)::bigint as slot, null::int as grown_shard from z
"""
