"""How filters interact: every order of applying them, walked as a trie of prefixes whose states are shared.

What is left after some filters doesn't depend on their order, so the prefixes of all n! orders are 2^n states. The walk is
depth first: where a state is met for the first time, its parent's persisted survivors are filtered and persisted in turn, and the
survivors that each filter still to come removes are counted; where it is met again, what was persisted serves. Rows of documents
are never collected: a state is a DataFrame, an edge's figures are a row for each part.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hapdiff.llm.common import UPPER, cut, let, whole, words_of

#: Each filter's failure over n_words, n_distinct, n_upper, n_chars, marked and copy; a filter's place is its bit.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "marked",
    "E": "copy",
}
MARKS = r"[#$%&*|]"
#: Rows of one text that meet in a task at most when its first holder is sent to them; SPREAD parts at least.
ROWS_EACH, SPREAD = 1_000_000, 64
#: n! orders of n steps are a broadcast table.
MOST_FILTERS = 6


def _fails(bit: int) -> Column:
    return F.col("failures").bitwiseAND(F.lit(1 << bit)) != 0


def _measured(docs: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, part, text_key and the measurements of one pass over the texts."""
    text = whole(F.col(text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(part_col)).alias("part"), text.alias("text"))
    counts = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    return own.select(
        "doc_id", "part", F.unhex(F.md5("text")).alias("text_key"), counts.alias("w"), F.char_length("text").cast("long").alias("n_chars"),
        F.char_length(F.translate("text", UPPER, "")).alias("n_other"), F.col("text").rlike(MARKS).alias("marked"),
    ).select(
        "doc_id", "part", "text_key", F.col("w.n_words").cast("long").alias("n_words"), F.col("w.n_distinct").cast("long").alias("n_distinct"),
        (F.col("n_chars") - F.col("n_other")).alias("n_upper"), "n_chars", "marked",
    )


def _with_copies(own: DataFrame) -> DataFrame:
    """own and copy: a smaller doc_id has the same text. A text's rows are dealt over several tasks; each is told the text's first holder."""
    deals = max(SPREAD, -(-own.count() // ROWS_EACH))
    dealt = own.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(deals)))
    parts = dealt.groupBy("text_key", "deal").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    groups = parts.groupBy("text_key").agg(F.min("least").alias("first_holder"), F.sum("n").alias("n"), F.collect_list("deal").alias("deals"))
    told = groups.filter("n > 1").select("text_key", F.explode("deals").alias("deal"), "first_holder")
    copy = F.coalesce(F.col("doc_id") > F.col("first_holder"), F.lit(False))
    return dealt.join(told, ["text_key", "deal"], "left").withColumn("copy", copy)


def judged(
    docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """part, failures (the bits of filters that the document fails), good and toxic: a row for each document, persisted.

    Every filter is judged once, on the whole text; "identical to a smaller doc_id's" looks at the whole table. A null text is empty
    and a null part the empty string. A null id is no smaller than any other and has no labels. Rows with equal ids are documents of
    their own, neither a copy of the other. Of several labels of one id the highest counts. Other columns are not looked at.
    """
    own = _with_copies(cut(_measured(docs, part_col, id_col, text_col)))
    bits = sum((F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(filters.values())), F.lit(0))
    own = own.select("doc_id", "part", bits.alias("failures"))
    of = labels.select(F.col("doc_id").alias("label_id"), "quality", "toxic").filter("label_id is not null").groupBy("label_id")
    marks = of.agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    # ids that are null would all meet in one task of the join
    known = own.filter("doc_id is not null").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    unknown = own.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return cut(known.select("part", "failures", no("good"), no("toxic")).unionByName(unknown.select("part", "failures", "good", "toxic")))


class _Trie:
    """The states of a walk over all orders: an unordered prefix, as a mask of filters, to its persisted survivors."""

    def __init__(self, root: DataFrame, n: int):
        self.survivors, self.counts, self.n = {0: root}, {}, n

    def walk(self, state: int = 0) -> None:
        for bit in range(self.n):
            if not state >> bit & 1:
                self.edge(state, bit)
                self.walk(state | 1 << bit)

    def edge(self, state: int, bit: int) -> None:
        if state not in self.counts:
            self.counts[state] = self._removals(state)
        child = state | 1 << bit
        if child not in self.survivors and child != (1 << self.n) - 1:  # behind the last filter nothing is removed any more
            self.survivors[child] = cut(self.survivors[state].filter(~_fails(bit)))

    def _removals(self, state: int) -> DataFrame:
        """part, state, bit, alive, removed, good_lost, toxic_lost: what each filter still to come removes from the state's survivors."""
        own = self.survivors[state]
        figures = [
            F.struct(
                F.lit(bit).alias("bit"), F.count_if(_fails(bit)).alias("removed"), F.count_if(_fails(bit) & F.col("good")).alias("good_lost"),
                F.count_if(_fails(bit) & F.col("toxic")).alias("toxic_lost"),
            )
            for bit in range(self.n) if not state >> bit & 1
        ]
        counted = own.groupBy("part").agg(F.count("*").alias("alive"), F.array(*figures).alias("figures"))
        return counted.select("part", F.lit(state).alias("state"), "alive", F.inline("figures"))


def interactions(root: DataFrame, filters: Sequence[str] = tuple(FILTERS)) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley over judged()'s rows:
    one row for each part, order of all filters and step.

    redundant: documents that fail the step's filter but went before; unique_fails: those that fail no other filter; shapley: the
    filter's removals, summed over all orders. An empty table has no parts and gives no rows.
    """
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    trie = _Trie(root, n)
    trie.walk()
    edges = functools.reduce(DataFrame.unionByName, trie.counts.values())
    rows = [
        ("".join(filters[b] for b in order), step + 1, filters[order[step]], order[step], sum(1 << b for b in order[:step]))
        for order in permutations(range(n)) for step in range(n)
    ]
    steps = root.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, bit int, state int")
    totals = root.groupBy("part").agg(F.array(*[
        F.struct(F.lit(b).alias("bit"), F.count_if(_fails(b)).alias("failing"), F.count_if(F.col("failures") == 1 << b).alias("unique_fails")) for b in range(n)
    ]).alias("figures")).select("part", F.inline("figures"))
    out = totals.join(F.broadcast(steps), "bit").join(edges, ["part", "state", "bit"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "part", "filter_order", "step", "filter", (count("alive") - count("removed")).alias("kept"), count("removed").alias("removed"),
        (F.col("failing") - count("removed")).alias("redundant"), "unique_fails", count("good_lost").alias("good_lost"), count("toxic_lost").alias("toxic_lost"),
        F.sum(count("removed")).over(W.partitionBy("part", "bit")).alias("shapley"),
    )


_LETTERS = "(select unnest(range(5)) as k)"
ORACLE_SQL = rf"""
with m as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as least,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
l as (select doc_id, max(quality) as q, max(toxic) as x from labels group by doc_id),
f as (select part, (len(w) < 200)::int + 2 * (100*len(list_distinct(w)) < 50*len(w))::int
                   + 4 * (100*(length(t) - length(translate(t, '{UPPER}', ''))) > 3*length(t))::int
                   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask, q, x from m left join l using (doc_id)),
c as (select part, mask, count(*) as n, count(*) filter (q = 1) as good, count(*) filter (x = 1) as toxic from f group by all),
o as (select [a.k, b.k, c.k, d.k, e.k] as ks from {_LETTERS} a, {_LETTERS} b, {_LETTERS} c, {_LETTERS} d, {_LETTERS} e
      where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select ks, unnest(range(1, 6)) as step from o),
p as (select list_aggregate(list_transform(ks, lambda k: substr('ABCDE', (k+1)::int, 1)), 'string_agg', '') as filter_order, step, ks[step] as bit,
             (1 << ks[step])::int as own, coalesce(list_sum(list_transform(ks[1:step-1], lambda k: (1 << k)::int)), 0)::int as before from s),
r as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | own) = 0), 0) as kept,
             coalesce(sum(n) filter (mask & before = 0 and mask & own <> 0), 0) as removed, coalesce(sum(n) filter (mask & before <> 0 and mask & own <> 0), 0) as redundant,
             coalesce(sum(n) filter (mask = own), 0) as unique_fails, coalesce(sum(good) filter (mask & before = 0 and mask & own <> 0), 0) as good_lost,
             coalesce(sum(toxic) filter (mask & before = 0 and mask & own <> 0), 0) as toxic_lost from c, p group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""
