"""Repeated passages, cut out by super-k-mer partitioning.

A window is WINDOW consecutive words of a document. Consecutive windows whose smallest MER-word hash (their
minimiser) is the same travel as one packed string to the bucket of that minimiser; equal windows have equal
minimisers, so a bucket sees all occurrences of its windows, and sorting counts them.

Documents are dealt into blocks. A block sends each distinct string once, with its count, so copies, however
many, put at most one row for each block into a bucket. Only minimisers that occur twice in the corpus send
strings at all: a window whose minimiser occurs once occurs once. Windows of minimisers with over HOT
occurrences travel one by one, dealt by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.llm.common import partitions
from hapdiff.llm.wordhash import run_hashes, split_words, word_hashes

WINDOW = 35
MER = 8
HOT = 4096
#: The most windows of one packed string: repeated words make no string longer than this and a window.
LONGEST = 64
BLOCK_BYTES = 4 << 20


class _Block:
    """The super-k-mers of a block's documents: first word, windows and minimiser of each, in document order."""

    def __init__(self, texts: list, window: int):
        self.window, mer = window, min(MER, window)
        self.words = [split_words(t) for t in texts]
        hashes, self.counts = word_hashes(texts, lower=False)
        self.starts = np.cumsum(self.counts) - self.counts
        mers = self.mers = run_hashes(hashes, mer)
        n = len(hashes) - window + 1
        if n <= 0:
            self.first = self.size = np.zeros(0, np.int64)
            self.least = np.zeros(0, np.uint64)
            return
        least, span = mers, 1  # smallest of a growing span of mers
        while span < window - mer + 1:
            step = min(span, window - mer + 1 - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        doc = np.repeat(np.arange(len(texts)), self.counts)
        inside = doc[:n] == doc[window - 1 : window - 1 + n]
        at = np.flatnonzero(inside)
        least = least[at]
        new = np.r_[True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
        runs = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
        runs = np.flatnonzero(new | (place % LONGEST == 0)) if len(at) else runs
        self.first, self.least = at[runs], least[runs]
        self.size = np.diff(np.r_[runs, len(at)])
        self.doc_of = doc

    def packed(self, k: int, skip: int = 0, windows: int | None = None) -> bytes:
        """The words of super-k-mer k (or of some of its windows), joined by a blank."""
        first = int(self.first[k]) + skip
        d = int(self.doc_of[first])
        at = first - int(self.starts[d])
        return b" ".join(self.words[d][at : at + (int(self.size[k]) if windows is None else windows) + self.window - 1])

    def strings(self, minimisers: np.ndarray, hot: np.ndarray):
        """(minimiser, packed, first word, windows, hot) of the super-k-mers with these minimisers; those of hot ones window by window."""
        order = np.argsort(minimisers)
        minimisers, hot = minimisers[order], hot[order]
        at = np.minimum(np.searchsorted(minimisers, self.least), max(len(minimisers) - 1, 0))
        for k in np.flatnonzero(minimisers[at] == self.least) if len(minimisers) else ():
            if hot[at[k]]:
                for j in range(int(self.size[k])):
                    yield int(self.least[k]), self.packed(k, j, 1), int(self.first[k]) + j, 1, True
            else:
                yield int(self.least[k]), self.packed(k), int(self.first[k]), int(self.size[k]), False


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


def _count_windows(strings: list[bytes], counts: np.ndarray, window: int) -> list[bytes]:
    """For each packed string a byte for each window: 1 where the window occurs twice or more in all strings together."""
    words = [s.split(b" ") for s in strings]
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    values = flat.dictionary.to_pylist()
    codes = np.asarray(flat.indices)
    prints = []
    for seed in (0, 1):  # 128 bits for each window
        table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in values), np.uint64, len(values))
        prints.append(run_hashes(table[codes], window))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    each = lengths - window + 1
    own = np.repeat(np.arange(len(words)), each)
    at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
    a, b = prints[0][at], prints[1][at]
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=counts[own[order]])
    flags = np.zeros(len(own), np.uint8)
    flags[order] = total[group] >= 2
    return [x.tobytes() for x in np.split(flags, np.cumsum(each)[:-1])]


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text: each row's words without those in windows that occur twice or more, joined by blanks.

    Words are runs of non-white space, unchanged; windows are judged on the input. A text with fewer words
    than a window stays whole, a null text is empty. Rows with equal ids are different documents; a row that
    is there twice repeats all its windows. Equal windows are told by 128-bit hashes.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_blocks = partitions(own, "text", BLOCK_BYTES)
    own = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text")
    id_type = own.schema["doc_id"].dataType.simpleString()

    def census(table: pa.Table) -> pa.Table:
        block = _Block(table.column("text").to_pylist(), window)
        found = np.unique(block.least)
        # every place of a minimiser's words counts, also one that is in the same super-k-mer as another
        at = np.minimum(np.searchsorted(found, block.mers), max(len(found) - 1, 0))
        n = np.bincount(at[found[at] == block.mers], minlength=len(found)) if len(found) else np.zeros(0)
        return pa.table({
            "block": pa.array(np.full(len(found), table.column("block")[0].as_py(), np.int32)),
            "least": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64)),
        })

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left.column("text").to_pylist(), window)
        found: dict[tuple, int] = {}
        for least, packed, _, _, hot in block.strings(_unsigned(right.column("least")), np.asarray(right.column("hot"))):
            key = (least, packed, hot)
            found[key] = found.get(key, 0) + 1
        deal = [_signed(xxhash.xxh3_64_intdigest(p) if hot else least) for least, p, hot in found]
        return pa.table({
            "block": pa.array(np.full(len(found), left.column("block")[0].as_py() if left.num_rows else 0, np.int32)),
            "least": pa.array([_signed(k[0]) for k in found], pa.int64()), "deal": pa.array(deal, pa.int64()),
            "packed": pa.array([k[1] for k in found], pa.binary()), "n": pa.array(list(found.values()), pa.int64()),
            "hot": pa.array([k[2] for k in found], pa.bool_()),
        })

    def judge(table: pa.Table) -> pa.Table:
        strings = table.column("packed").to_pylist()
        flags = _count_windows(strings, np.asarray(table.column("n")), window)
        keep = np.array([k for k, f in enumerate(flags) if 1 in f], np.int64)
        return pa.table({
            "block": table.column("block").take(keep), "least": table.column("least").take(keep),
            "sid": pa.array([_signed(xxhash.xxh3_64_intdigest(strings[k])) for k in keep.tolist()], pa.int64()),
            "flags": pa.array([flags[k] for k in keep.tolist()], pa.binary()), "hot": table.column("hot").take(keep),
        })

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        block = _Block(texts, window)
        hit = np.zeros(int(block.counts.sum()) + 1, np.int32)
        flags = dict(zip(right.column("sid").to_pylist(), right.column("flags").to_pylist(), strict=True))
        if flags:
            least, hot = _unsigned(right.column("least")), np.asarray(right.column("hot"))
            least, first = np.unique(least, return_index=True)
            for _, packed, start, windows, _ in block.strings(least, hot[first]):
                own = flags.get(_signed(xxhash.xxh3_64_intdigest(packed)))
                if own:
                    at = start + np.flatnonzero(np.frombuffer(own, np.uint8)[:windows])
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + window, -1)
        gone = np.cumsum(hit[:-1]) > 0
        out, removed = [], []
        for k, words in enumerate(block.words):
            own = gone[block.starts[k] : block.starts[k] + len(words)]
            removed.append(int(own.sum()))
            out.append((b" ".join(w for w, g in zip(words, own, strict=True) if not g) if removed[-1] else b" ".join(words)).decode())
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(block.counts), "n_removed": pa.array(removed, pa.int64()),
            "text": pa.array(out, pa.string()),
        })

    by_block = own.groupBy("block")
    seen = by_block.applyInArrow(census, "block int, least long, n long")
    total = F.sum("n").over(W.partitionBy("least"))
    twice = seen.withColumn("total", total).filter("total >= 2").select("block", "least", (F.col("total") > HOT).alias("hot"))
    sent = by_block.cogroup(twice.groupBy("block")).applyInArrow(send, "block int, least long, deal long, packed binary, n long, hot boolean")
    buckets = sent.withColumn("bucket", F.pmod(F.col("deal"), F.lit(2 * n_blocks)).cast("int"))
    judged = buckets.groupBy("bucket").applyInArrow(judge, "block int, least long, sid long, flags binary, hot boolean")
    return by_block.cogroup(judged.groupBy("block")).applyInArrow(rebuild, f"doc_id {id_type}, n_words long, n_removed long, text string")


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
p as (select r, i, md5(array_to_string(w[i:i+34], ' ')) as k from (select r, w, unnest(range(1, len(w)-33)) as i from d where len(w) >= 35)),
g as (select r, i from (select *, count(*) over (partition by k) as c from p) where c > 1),
c as (select distinct r, unnest(range(i, i+35)) as j from g),
x as (select r, unnest(w) as word, generate_subscripts(w, 1) as j from d),
k as (select r, count(c.j) as n_removed, string_agg(word, ' ' order by j) filter (c.j is null) as t from x left join c using (r, j) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join k using (r)
"""
