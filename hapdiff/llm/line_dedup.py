"""Lines that many documents share, found by hash and dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import SPACES, ascii_lower, cut, fresh, whole

#: Hashes of common lines up to this many (16 bytes each) are broadcast; more are joined by a shuffle whose hot keys Spark splits.
BROADCAST_HASHES = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _hashed(line: Column) -> Column:
    """16 bytes for each key; null for keys that are too short, which stay whatever their count."""
    return F.unhex(F.md5(line_key(line)))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """line_hash, n_docs: the distinct documents (by id; null is one id) that hold each key of at least min_chars code points."""
    hashes = F.array_distinct(
        F.transform(F.filter(F.split(whole(F.col(text_col)), "\n"), lambda x: F.char_length(line_key(x)) >= min_chars), _hashed)
    )
    pairs = docs.select(F.struct(F.col(id_col)).alias("doc"), F.explode(hashes).alias("line_hash"))
    return pairs.groupBy("line_hash").agg(F.count_distinct("doc").alias("n_docs"))


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with text_col rid of lines whose key is in at least min_docs documents, plus n_lines and n_dropped.

    Lines are what \\n separates; a null or empty text is one empty line, and a null text comes back
    empty. Repeated rows each come back; rows with equal ids count as one document. Columns of docs named
    n_lines or n_dropped are replaced, all others stay.
    """
    docs = docs.drop("n_lines", "n_dropped")
    hashes = cut(line_counts(docs, id_col, text_col, min_chars).filter(F.col("n_docs") >= min_docs).select("line_hash"))
    side = F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes
    text = whole(F.col(text_col))
    names = {k: fresh(docs, f"lines_{k}") for k in ("row", "at", "gone", "all", "stay", "of")}
    row, at, gone, every, stay, of = names.values()
    key = F.struct(F.col(id_col), F.xxhash64(text))
    # only hashes and positions travel here; texts are shuffled once, in the last join
    placed = docs.select(key.alias(row), F.posexplode(F.transform(F.split(text, "\n"), _hashed)).alias(at, "line_hash"))
    found = placed.join(side, "line_hash", "left_semi").groupBy(F.col(row).alias(of)).agg(F.collect_set(at).alias(gone))
    joined = docs.withColumn(row, key).join(found, F.col(row).eqNullSafe(F.col(of)), "left").withColumn(every, F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(gone))
    joined = joined.withColumn(stay, F.when(F.col(gone).isNotNull(), left))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(F.col(stay), lambda i: F.get(F.col(every), i)), "\n"))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(every).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE_SQL = r"""
with l as (
  select doc_id, i, lines[i] as line,
         translate(trim(lines[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, lines, unnest(range(1, len(lines)+1)) as i
        from (select doc_id, string_split(coalesce(text,''), chr(10)) as lines from documents))),
f as (select k, count(distinct doc_id) as n from l where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
j as (select l.doc_id, l.i, l.line, f.k is not null as gone from l left join f on l.k = f.k)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by i), '')) as kept_sha256
from j group by doc_id
"""
