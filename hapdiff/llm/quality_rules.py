"""Quality rules as a ledger: each rule is judged once, policies are masks over the stored bits.

Everything is a projection of one row, so no stage shuffles and no document is ever split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import fresh, let, whole, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


#: Each rule's condition over the measurements; a rule's place is its bit and never changes.
CONDITIONS = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_upper > 60 * n_letters"),
    ("marks", "100 * n_marks > 60 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("no_letters", "100 * n_letters < 40 * word_chars"),
)
RULES = tuple(name for name, _ in CONDITIONS)


@dataclass(frozen=True)
class Policy:
    """A version of which rules count: a document goes when any of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_windows")),
        Policy("v1", ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "marks", "long_words", "no_letters")),
    )
}


def _repeated(hashes: Column) -> Column:
    """How many words are in windows of WINDOW words that the text holds twice or more; hashes: one for each word."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda _, i: F.xxhash64(F.slice(hashes, i + 1, WINDOW)))

    def places(s: Column) -> Column:
        """Ascending starts of the windows that stand beside an equal one in s, the sorted windows."""

        def same(x: Column, j: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(win: Column) -> Column:
        in_order = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), let(let(in_order, places), covered)).otherwise(F.lit(0).cast("long"))

    return let(windows, count)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES as long columns (columns of those names are replaced, all others stay). Null texts count as empty; equal
    rows have equal measures."""
    keep = [c for c in docs.columns if c.lower() not in MEASURES]
    t = whole(F.col(text_col))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    all_chars = F.char_length(t)
    of_words = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.char_length(F.array_join(w, "")).alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    made = F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        (all_chars - F.char_length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        (all_chars - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("n_upper"),
        (all_chars - F.char_length(F.regexp_replace(t, r"\p{L}+", ""))).alias("n_letters"),
        (all_chars - F.char_length(F.translate(t, "!?", ""))).alias("n_marks"),
    )
    # behind a generator no later filter makes Spark compute the measurements anew
    name = fresh(docs, "measured")
    df = docs.select(*keep, F.explode_outer(F.array(made)).alias(name))
    at = {"n_words": "w.", "word_chars": "w.", "n_repeat_words": "w.", "n_lines": "l.", "n_dup_lines": "l."}
    return df.select(*keep, *[F.col(f"{name}.{at.get(m, '')}{m}").cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """measure() and failures (long): the bits of the rules that failed, by their place in RULES. An empty text fails few_words."""
    bits = sum((F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, failed) in enumerate(CONDITIONS)), F.lit(0))
    df = measure(docs.drop("failures"), text_col)
    return df.withColumn("failures", bits.cast("long"))


def judge(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """ledger_df and kept, by one policy; texts aren't read again."""
    return ledger_df.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """version, rule, failed, failed_alone (only this rule rejects), kept_without it: a row for each rule of the policy.

    Rows are counted by what the policy's mask leaves of their bits, at most 2 ** rules values, which tasks add up before the
    shuffle; each rule's figures are read from the bits of those values. An empty table gives zeros.
    """
    masks = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = ledger_df.sparkSession.createDataFrame([(r, RULES.index(r)) for r in policy.rules], "rule string, bit int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    total = lambda counts: F.coalesce(F.sum(F.when(counts, F.col("n"))), F.lit(0)).cast("long")
    # a few rules by at most 2 ** rules masks
    return rules.join(F.broadcast(masks), F.lit(True), "left").groupBy(F.lit(policy.version).alias("version"), "rule").agg(
        total(F.col("mask").bitwiseAND(one) != 0).alias("failed"),
        total(F.col("mask") == one).alias("failed_alone"),
        total(F.col("mask").bitwiseAND(F.bitwise_not(one)) == 0).alias("kept_without"),
    )


_SQL = r"""
with d as (select doc_id, coalesce(text,'') as t,
                  list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w)-6)) as i from d where len(w) >= 8),
h as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i+7], ' ')) as c from p),
g as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from h where c > 1),
r as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from g group by doc_id),
m as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
             coalesce(r.n, 0) as n_repeat_words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
             length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) as n_upper,
             length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) as n_letters,
             length(t) - length(translate(t, '!?', '')) as n_marks
      from d left join r using (doc_id)),
q as (select *, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines from m),
b as (select *, (n_words < 20 or 100*n_repeat_words > 30*n_words) as base_failed,
             n_words < 20 as b0, 100*n_repeat_words > 30*n_words as b1, 100*n_symbols > 20*n_words as b2,
             n_dup_lines >= 3 and 100*n_dup_lines > 50*n_lines as b3, 100*n_upper > 60*n_letters as b4, 100*n_marks > 60*n_words as b5,
             word_chars > 40*n_words as b6, 100*n_letters < 40*word_chars as b7 from q),
f as (select *, b0::int + 2*b1::int + 4*b2::int + 8*b3::int + 16*b4::int + 32*b5::int + 64*b6::int + 128*b7::int as failures from b)
"""
ORACLE_SQL = _SQL + """
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, failures = 0 as kept,
       failures::bigint as failures
from f
"""
ABLATIONS_SQL = _SQL + "\nunion all\n".join(
    f"select 'v1' as version, '{rule}' as rule, count(*) filter (b{k}) as failed, count(*) filter (failures = {1 << k}) as failed_alone, "
    f"count(*) filter (failures in (0, {1 << k})) as kept_without from f"
    for k, rule in enumerate(RULES)
)
