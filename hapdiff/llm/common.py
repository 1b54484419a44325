"""What several operators share: shared storage, row keys, white space."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line rules: blank and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. A temporary one only in local mode, where no other machine has to see it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hapdiff-checkpoints-")
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """A-Z only: other letters stay."""
    return F.translate(c, UPPER, LOWER)


def whole(c: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def words_of(c: Column) -> Column:
    """The runs of characters that aren't white space, unchanged."""
    return F.filter(F.split(c, SPACE_RUN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where a lambda of body uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first variant of it that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(df: DataFrame, text_col: str, bytes_each: int = 16 << 20) -> int:
    """How many partitions of about bytes_each of text df's whole rows make; one pass that returns a single number."""
    n = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(1, -(-n // bytes_each))


#: What a row counts for besides its text where blocks are sized, so that empty texts fill blocks too.
ROW_BYTES = 64


#: Copies of a row that are numbered together.
COPIES_EACH = 1024


def deal(df: DataFrame, text_col: str, bytes_each: int, block_col: str = "block") -> tuple[DataFrame, int]:
    """df with block_col, and the number of blocks: each holds rows and texts of about bytes_each.

    A row's block follows from its columns alone: a table that is read several times gives its rows in other partitions when executors
    come or go, and in any order behind a shuffle. Rows that are equal in all columns are one and the same wherever they stand, so where
    they would overfill a block one of each is counted, made anew as often as it is there, and its copies are dealt by their number.
    """
    key = F.xxhash64(*df.columns)
    own = F.lit(ROW_BYTES) + F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0))
    sizes = df.groupBy(key.alias("key")).agg(F.sum(own).alias("bytes"), F.count("*").alias("n"))
    # at most one key for each block
    many = F.collect_list(F.when((F.col("n") > 1) & (F.col("bytes") > bytes_each), F.col("key")))
    total, keys = sizes.agg(F.sum("bytes"), many).first()
    n = max(1, -(-(total or 0) // bytes_each))
    block = lambda *number: F.pmod(F.xxhash64(*df.columns, *number), F.lit(n)).cast("int")
    if not keys:
        return df.withColumn(block_col, block()), n
    count, at, number = fresh(df, "count"), fresh(df, "at"), fresh(df, "number")
    once = df.filter(key.isin(keys)).groupBy(*df.columns).agg(F.count("*").alias(count))
    parts = once.withColumn(at, F.explode(F.sequence(F.lit(0), F.col(count) - 1, F.lit(COPIES_EACH)))).repartition(*df.columns, at)
    last = F.least(F.col(at) + COPIES_EACH, F.col(count)) - 1
    copies = parts.withColumn(number, F.explode(F.sequence(F.col(at), last)))
    rest = df.filter(~key.isin(keys)).withColumn(block_col, block())
    return rest.unionByName(copies.select(*df.columns, block(F.col(number)).alias(block_col))), n
