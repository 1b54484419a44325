"""Reads and positions derived from the driver's part and lineitem tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = ["s1", "s2", "s3", "s4", "s5", "s6"]
GROUPS = [1, 1, 1, 2, 2, 2]

#: Positions of each chromosome in clusters of 60, and behind a long gap some that only reads over the gap reach.
POSITIONS_SQL = """
select chr, pos, row_number() over (partition by chr order by pos) as ci from (
  select concat('chr', cast(1+p_partkey%4 as {text})) as chr,
         100 + 40*cast(floor(p_partkey/4) as bigint) + p_size%30 + 3000*cast(floor(floor(p_partkey/4)/60) as bigint) as pos from part
  union all
  select concat('chr', cast(1+p_partkey%4 as {text})) as chr,
         1000 + 23*(select count(*) from part) + 60*cast(floor(p_partkey/4) as bigint) + p_size%30 as pos from part where p_size > 40) p
"""
#: A read for each lineitem. In some zones of 20 positions only some samples have reads: the first group's alone (the zone's loci
#: aren't tested), all but s6 (its regions aren't complete), or one of each group (permuted labellings may have none in a group).
READS_SQL = """
select concat('s', cast(s as {text})) as sample, case when l_quantity=50 then 'chrMissing' else chr end as chr,
       cast(rs as double) as read_start, cast(re as double) as read_end,
       case when l_quantity=49 then '0X' when l_quantity=48 then repeat('0', cast(n+1 as int))
            when (s>3 and zone%6=2 and l_returnflag<>'A') or (s<=3 and zone%6=5 and l_returnflag<>'R') or l_tax>=0.08
                 then concat('1', repeat('0', cast(n-1 as int)))
            else repeat('0', cast(n as int)) end as hap,
       cast(1+l_quantity%5 as double) as cnt,
       case when l_quantity=47 then '*' when l_linestatus='F' then '+' else '-' end as strand
from (select z.*, case when chr='chr4' and zone%6=1 then 1+l_orderkey%3 when chr='chr3' and zone%6=2 then 1+l_orderkey%5
                       when chr='chr2' and zone%6=0 then 1+3*(l_orderkey%2) else 1+l_orderkey%6 end as s
      from (select l.*, ca.pos as rs, cb.pos as re, cb.ci-ca.ci+1 as n, floor(ca.ci/20) as zone
            from (select concat('chr', cast(1+l_partkey%4 as {text})) as chr, cast(floor(l_partkey/4) as bigint)+1 as a0, 1+l_linenumber%4 as len,
                         l_orderkey, l_returnflag, l_linestatus, l_tax, l_quantity from lineitem) l
            join {cpg} ca on ca.chr=l.chr and ca.ci=l.a0 join {cpg} cb on cb.chr=l.chr and cb.ci=l.a0+l.len-1) z) m
"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """reads and positions (chr, pos, ci)."""
    part, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    cpg = spark.sql(POSITIONS_SQL.format(text="string").replace("from part", "from {part}"), part=part)
    reads = spark.sql(READS_SQL.format(text="string", cpg="{cpg}").replace("from lineitem)", "from {line})"), cpg=cpg, line=line)
    return reads, cpg
