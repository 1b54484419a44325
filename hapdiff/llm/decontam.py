"""Benchmark passages in documents, found by spaced seeds that tolerate replaced words.

A seed is the hash of the words at the ones of a mask; the zeros are free, so a replaced word there costs
no hit. Every seed position of every document is joined with the seeds of the benchmark, and each diagonal
that was hit (document position minus item position) is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import ascii_lower, cut, fresh, let, whole, words_of

MASKS = ("11111", "1101011", "110010011")
#: Words in a row by which shorter items are found besides, by their number of words: whole items under 5 words; of 5 to 11
#: words a fifth may be replaced, which leaves a run of so many.
RUNS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 2} | {n: 3 for n in range(6, 12)}
#: A leak is a stretch of this many words of an item (all of a shorter item), four fifths of them equal.
STRETCH = 25
#: Seeds of a benchmark up to this many rows are broadcast (about 32 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
#: Hits of a document that are verified in one row, about.
HITS = 256


def _hashes(text: Column) -> Column:
    return F.transform(words_of(ascii_lower(whole(text))), lambda w: F.xxhash64(w))


def _seed_arrays(words: Column, runs: list[int], item: bool) -> Column:
    """For each mask and each length of run an array of the seeds of all positions; an item has only runs of the length for it."""

    def own(k: int, mask: str) -> Column:
        span, rest = len(mask), [j for j, c in enumerate(mask) if c == "1"][1:]
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (span - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in rest]))

    def run(n: int) -> Column:
        seeds = own(-n, "1" * n)
        return F.when(F.size(words).isin([k for k, v in RUNS.items() if v == n]), seeds) if item else seeds

    return F.array(*[own(k, m) for k, m in enumerate(MASKS)], *[run(n) for n in runs])


def _seeds(df: DataFrame, keys: list[str], words: Column, runs: list[int], item: bool = False) -> DataFrame:
    """keys, seed, at: a row for each mask or run and position. The outer explodes keep the optimizer from judging the arrays twice."""
    one = df.select(*keys, F.explode_outer(let(words, lambda w: _seed_arrays(w, runs, item))).alias("_one"))
    return one.select(*keys, F.posexplode_outer("_one").alias("at", "seed"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """row_key, item, first_word, matched: the diagonals on which a document holds a leak of an item.

    first_word may be negative: where the item would begin. Words are compared after lower-casing A-Z.
    Null texts have no words, and items without words are in no leak. row_key is
    leak_key() of the document.
    """
    items = benchmark.select(F.col(item_col).alias("item"), _hashes(F.col(item_text_col)).alias("_wh")).distinct()
    sizes = items.select(F.size("_wh").alias("n")).filter(F.col("n").isin(list(RUNS))).distinct().collect()
    runs = sorted({RUNS[r.n] for r in sizes})  # documents have no seeds for runs that no item needs
    seeds = _seeds(items, ["item"], F.col("_wh"), runs, item=True).filter("seed is not null").select("seed", "item", F.col("at").alias("item_at")).distinct()
    n_seeds = seeds.count()
    keyed = docs.select(leak_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("_text"))
    at = _seeds(keyed, ["row_key"], _hashes(F.col("_text")), runs)
    hits = at.join(F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds, "seed")
    # few rows beside the seeds, and read twice
    hits = cut(hits.select("row_key", "item", (F.col("at") - F.col("item_at")).alias("first_word")).distinct())
    # a document's hits meet its text HITS at a time, so that its words are hashed once for all of them and no row grows without bound
    many = hits.groupBy("row_key").agg(F.ceil(F.count("*") / HITS).alias("parts"))
    hits = hits.join(many, "row_key").withColumn("part", F.pmod(F.xxhash64("item", "first_word"), F.col("parts")))
    hits = hits.join(items.withColumnRenamed("_wh", "iw"), "item")
    pairs = hits.groupBy("row_key", "part").agg(F.collect_list(F.struct("item", "first_word", "iw")).alias("_hits")).join(keyed, "row_key")
    judged = let(_hashes(F.col("_text")), lambda wh: F.transform("_hits", lambda h: _matched(wh, h)))
    found = pairs.select("row_key", F.explode_outer(judged).alias("m")).select("row_key", "m.*")
    return found.filter(5 * F.col("matched") >= 4 * F.col("n")).select("row_key", "item", "first_word", "matched")


def _matched(words: Column, hit: Column) -> Column:
    """item, first_word, matched: the most equal words in a stretch of n words of the item on this diagonal."""
    n = F.least(F.size(hit["iw"]), F.lit(STRETCH))
    equal = F.transform(hit["iw"], lambda w, j: F.coalesce(F.get(words, hit["first_word"] + j) == w, F.lit(False)).cast("int"))

    def best(eq: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(eq) - n + 1)
        return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(eq, s, n), F.lit(0), lambda a, x: a + x)))

    return F.struct(hit["item"].alias("item"), hit["first_word"].alias("first_word"), let(equal, best).alias("matched"), n.alias("n"))


def leak_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes for a row's id and whole text; rows equal in both share it, and their result. The id's length keeps the two apart."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.char_length(key).cast("string"), key, whole(F.col(text_col)))))


def mark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """docs with leaked_items: the sorted ids of the items that a document holds, empty for clean ones. A column of that name is
    replaced, all others stay; equal rows have equal items."""
    docs = docs.drop("leaked_items")
    own, other, items = fresh(docs, "leak_row"), fresh(docs, "leak_found"), fresh(docs, "leak_items")
    found = find_leaks(docs, benchmark, id_col, text_col, **names).groupBy(F.col("row_key").alias(other)).agg(F.array_sort(F.collect_set("item")).alias(items))
    out = docs.withColumn(own, leak_key(id_col, text_col)).join(found, F.col(own) == F.col(other), "left")
    empty = F.array().cast(found.schema[items].dataType)
    return out.select(*docs.columns, F.coalesce(items, empty).alias("leaked_items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of docs that hold no leak."""
    return mark_leaks(docs, benchmark, **names).filter(F.size("leaked_items") == 0).select(*docs.columns)


def _sql_seeds(table: str, key: str) -> str:
    parts = []
    for k, mask in enumerate(MASKS):
        ones = [i for i, c in enumerate(mask) if c == "1"]
        seed = " || ' ' || ".join(f"w[i+{j}]" for j in ones)
        parts.append(f"select {key}, i as at, {k} as m, {seed} as s from (select {key}, w, unnest(range(1, len(w)-{len(mask) - 2})) as i from {table} where len(w) >= {len(mask)})")
    return " union all ".join(parts)


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x20\x09-\x0D]+'), lambda w: w <> '')"
)
ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
ds as ({_sql_seeds("d", "doc_id")}), bs as ({_sql_seeds("b", "item_id")}),
h as (select distinct doc_id, item_id, ds.at - bs.at as dg from ds join bs using (m, s)),
p as (select doc_id, item_id, dg, b.w as iw, list_transform(range(1, len(b.w)+1), lambda j: case when j+dg >= 1 and d.w[j+dg] = b.w[j] then 1 else 0 end) as eq
      from h join d using (doc_id) join b using (item_id)),
q as (select doc_id, item_id, list_max(list_transform(range(1, len(eq) - least(len(eq), {STRETCH}) + 2),
             lambda s: list_sum(eq[s:s + least(len(eq), {STRETCH}) - 1]))) as matched, least(len(eq), {STRETCH}) as n from p),
r as (select doc_id, list_sort(list(distinct item_id)) as items from q where 5*matched >= 4*n group by doc_id)
select d.doc_id, r.items is not null as contaminated, coalesce(len(r.items), 0)::bigint as n_items,
       coalesce(array_to_string(r.items, ','), '') as items
from d left join r using (doc_id)
"""
