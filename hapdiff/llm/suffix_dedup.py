"""Repeated byte strings, cut out after sorting the suffixes that may repeat.

A window is WINDOW consecutive bytes of a document; its minimiser is the smallest hash of MER consecutive bytes in it. Equal windows
have equal minimisers, so only windows whose minimiser is in two places of the corpus can repeat. Consecutive ones with one minimiser
travel as one packed string, each string once from a block of documents; strings with one minimiser meet in one bucket, where the
windows' suffixes are put in order (see suffix_sort) and equal neighbours are the repeats.

A minimiser in over HOT places would bring too much into one bucket. Its windows are told apart by where the minimiser is in them,
in steps of STEP bytes, and by a hash of the bytes that all windows of a step share, which are all but STEP of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.llm.common import cut, deal
from hapdiff.llm.suffix_sort import equal_windows
from hapdiff.llm.wordhash import mix

WINDOW = 400
#: Bytes of a hash: a power of two.
MER = 64
HOT, STEP = 4096, 24
BLOCK_BYTES = 4 << 20
#: Windows whose hashes are looked at together, and suffixes that are sorted together.
CHUNK, SUFFIXES = 1 << 18, 1 << 18
#: A string comes from as many blocks as hold it: so many of them meet in one task at most.
BLOCKS_EACH = 4096
BASE = 0x9E3779B97F4A7C15


def mer_hashes(text: np.ndarray, mer: int) -> np.ndarray:
    """A hash above 0 of each `mer` consecutive bytes."""
    h, span, by = mix(np.arange(1, 257, dtype=np.uint64))[text], 1, BASE
    while span < mer:
        h = h[:-span] * np.uint64(by) + h[span:]
        span, by = 2 * span, by * by % (1 << 64)
    return np.maximum(mix(h), np.uint64(1))


def sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `span` consecutive values."""
    done = 1
    while done < span:
        step = min(done, span - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


class _Block:
    """The runs of windows with one minimiser in a block's documents: first window, how many and minimiser of each."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.mer = window, min(MER, 1 << (window.bit_length() - 1))
        self.raw = b"".join(texts)
        self.text = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        parts = [self._chunk(at) for at in range(0, max(len(self.text) - window + 1, 0), CHUNK)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        first, size, least, places, values = (np.concatenate(p) for p in zip(none, *parts, strict=True))
        # a run goes on over a chunk's end: where chunks end hangs on the order of the documents, which differs from pass to pass
        new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1] + size[:-1]) | (least[1:] != least[:-1])][: len(first)])
        self.first, self.least = first[new], least[new]
        self.size = np.add.reduceat(size, new) if len(new) else size
        self.places, at = np.unique(places, return_index=True)
        self.values = values[at]

    def _chunk(self, at: int) -> tuple[np.ndarray, ...]:
        """Runs of the windows at `at` and after, and the places and hashes of what is some window's minimiser."""
        span = self.window - self.mer + 1
        hashes = mer_hashes(self.text[at : at + CHUNK + self.window - 1], self.mer)
        least = sliding(hashes, span, np.minimum)
        docs = np.flatnonzero((self.ends > at) & (self.starts < at + len(least)))
        across = np.zeros(len(least) + 1, np.int64)  # windows that reach past their document's end
        np.add.at(across, np.clip(np.maximum(self.ends[docs] - self.window + 1, self.starts[docs]) - at, 0, len(least)), 1)
        np.add.at(across, np.clip(self.ends[docs] - at, 0, len(least)), -1)
        least = np.where(np.cumsum(across[:-1]) > 0, np.uint64(0), least)
        border = np.zeros(span - 1, np.uint64)
        chosen = np.flatnonzero(sliding(np.concatenate([border, least, border]), span, np.maximum) == hashes)
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        size = np.diff(np.r_[begin, len(least)])
        real = least[begin] > 0
        return begin[real] + at, size[real], least[begin][real], chosen + at, hashes[chosen]

    def strings(self, minimisers: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, bool, int, int]]:
        """(minimiser, deal, hot, first window, windows) of each packed string with one of these minimisers."""
        order = np.argsort(minimisers)
        minimisers, hot = minimisers[order], hot[order]
        if not len(minimisers):
            return
        at = np.minimum(np.searchsorted(minimisers, self.least), len(minimisers) - 1)
        longest = self.window - self.mer + 1
        for k in np.flatnonzero(minimisers[at] == self.least).tolist():
            least, first, size = int(self.least[k]), int(self.first[k]), int(self.size[k])
            if hot[at[k]]:
                yield from self._steps(least, first, size)
            else:
                for skip in range(0, size, longest):
                    yield least, least, False, first + skip, min(longest, size - skip)

    def _steps(self, least: int, first: int, size: int) -> Iterator[tuple[int, int, bool, int, int]]:
        """A run's windows by where their minimiser is, in steps; the deal is a hash of what all windows of a step share."""
        a, b = np.searchsorted(self.places, (first, first + size + self.window - self.mer))
        places = self.places[a:b][self.values[a:b] == np.uint64(least)]
        windows = np.arange(first, first + size)
        place = places[np.searchsorted(places, windows)]
        step = (place - windows) // STEP
        begin = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (place[1:] != place[:-1])])
        for i, n in zip(begin.tolist(), np.diff(np.r_[begin, size]).tolist(), strict=True):
            p, s = int(place[i]), int(step[i])
            core = self.raw[p - s * STEP : max(p + self.window - (s + 1) * STEP + 1, 0)]  # none where a window is shorter than a step
            yield least, xxhash.xxh3_64_intdigest(core, s), True, first + i, n

    def packed(self, first: int, windows: int) -> bytes:
        return self.raw[first : first + windows + self.window - 1]

    def alone(self, least: int, first: int, windows: int) -> bool:
        """The minimiser is in one place of the string, so that no two of its windows are equal."""
        a, b = np.searchsorted(self.places, (first, first + windows + self.window - self.mer))
        return int((self.values[a:b] == np.uint64(least)).sum()) == 1


def _signed(x: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


SENT = "block int, least long, deal long, hot boolean, sid long, packed binary, n long, alone boolean"


def _judge(strings: list[bytes], deals: list[int], counts: np.ndarray, alone: list[bool], window: int) -> list[bytes]:
    """For each string a bit for each window: 1 where the window begins twice or more in all strings together. Equal windows have equal deals."""
    groups: dict[int, dict[bytes, list[int]]] = {}
    for k, (deal_, s) in enumerate(zip(deals, strings, strict=True)):
        groups.setdefault(deal_, {}).setdefault(s, []).append(k)
    out: list[bytes] = [b""] * len(strings)

    def settle(batch: list[list[int]]) -> None:
        own = [strings[ks[0]] for ks in batch]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        each = sizes - window + 1
        of = np.repeat(np.arange(len(own)), each)
        first = np.cumsum(each) - each
        starts = np.arange(len(of)) + np.repeat(np.cumsum(sizes) - sizes - first, each)
        weight = np.array([counts[ks].sum() for ks in batch])
        order, begins = equal_windows(np.frombuffer(b"".join(own), np.uint8), starts, window)
        group = np.cumsum(begins) - 1
        place = np.searchsorted(starts, order)
        flags = np.zeros(len(of), np.uint8)
        flags[place] = np.bincount(group, weights=weight[of[place]])[group] >= 2
        for ks, bits in zip(batch, np.split(flags, first[1:]), strict=True):
            for k in ks:
                out[k] = np.packbits(bits).tobytes() if bits.any() else b""

    batch, suffixes = [], 0
    for group in groups.values():
        if len(group) == 1 and all(alone[k] for ks in group.values() for k in ks):
            (text, ks), = group.items()
            if counts[ks].sum() >= 2:
                for k in ks:
                    out[k] = np.packbits(np.ones(len(text) - window + 1, np.uint8)).tobytes()
            continue
        batch += group.values()
        suffixes += sum(len(s) - window + 1 for s in group)
        if suffixes >= SUFFIXES:
            settle(batch)
            batch, suffixes = [], 0
    if batch:
        settle(batch)
    return out


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start and end, maximal runs of removed bytes) and kept (binary) of each row.

    Texts are bytes of UTF-8. A byte goes where a `window`-byte string over it begins anywhere else too, in the same text or another;
    strings are judged on the input and never cross texts, and what is kept need not be UTF-8. A text shorter than a window stays
    whole, a null text is empty. Rows with equal ids are different texts, a row that is there twice repeats all its windows, an empty
    table gives no rows, and other columns aren't looked at.
    """
    if window < 2:
        raise ValueError("a window has two bytes at least")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    own, n_blocks = deal(own, "text", BLOCK_BYTES)

    def census(table: pa.Table) -> pa.Table:
        values, n = np.unique(_Block(table.column("text").to_pylist(), window).values, return_counts=True)
        return pa.table({"block": pa.array(np.full(len(values), table.column("block")[0].as_py(), np.int32)), "least": _signed(values), "n": pa.array(n, pa.int64())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left.column("text").to_pylist(), window)
        found: dict[tuple, list] = {}
        for least, to, hot, first, windows in block.strings(_unsigned(right.column("least")), np.asarray(right.column("hot"))):
            key = (least, to, hot, block.packed(first, windows))
            if key in found:
                found[key][0] += 1
            else:
                found[key] = [1, block.alone(least, first, windows)]
        at = left.column("block")[0].as_py() if left.num_rows else 0
        packed = [k[3] for k in found]
        return pa.table({
            "block": pa.array(np.full(len(found), at, np.int32)), "least": _signed([k[0] for k in found]), "deal": _signed([k[1] for k in found]),
            "hot": pa.array([k[2] for k in found], pa.bool_()), "sid": _signed([xxhash.xxh3_64_intdigest(p) for p in packed]),
            "packed": pa.array(packed, pa.binary()), "n": pa.array([v[0] for v in found.values()], pa.int64()),
            "alone": pa.array([v[1] for v in found.values()], pa.bool_()),
        })

    def judge(table: pa.Table) -> pa.Table:
        strings, deals, alone = (table.column(c).to_pylist() for c in ("packed", "deal", "alone"))
        flags = _judge(strings, deals, np.asarray(table.column("n")), alone, window)
        keep = pa.array([k for k, f in enumerate(flags) if f], pa.int64())
        return table.select(["block", "least", "hot", "sid"]).take(keep).append_column("flags", pa.array([f for f in flags if f], pa.binary()))

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left.column("text").to_pylist(), window)
        flags = dict(zip(zip(right.column("least").to_pylist(), right.column("sid").to_pylist(), strict=True), right.column("flags").to_pylist(), strict=True))
        least, at = np.unique(_unsigned(right.column("least")), return_index=True)
        repeats = [np.zeros(0, np.int64)]
        for value, _, _, first, windows in block.strings(least, np.asarray(right.column("hot"))[at]):
            sid = xxhash.xxh3_64_intdigest(block.packed(first, windows))
            bits = flags.get((value - (value >> 63 << 64), sid - (sid >> 63 << 64)))
            if bits:
                repeats.append(first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=windows)))
        at = np.concatenate(repeats)
        size = len(block.text)
        gone = np.cumsum(np.bincount(at, minlength=size + 1)[:size] - np.bincount(at + window, minlength=size + 1)[:size]) > 0
        kept, spans, removed = [], [], []
        for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            mine = gone[a:b]
            removed.append(int(mine.sum()))
            edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).tolist() if removed[-1] else []
            spans.append([{"start": i, "end": j} for i, j in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(block.text[a:b][~mine].tobytes() if removed[-1] else block.raw[a:b])
        return pa.table({
            "doc_id": left.column("doc_id"), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        })

    by_block, to_flags = own.groupBy("block"), "block int, least long, hot boolean, sid long, flags binary"

    def judged(sent: DataFrame) -> DataFrame:
        return sent.withColumn("bucket", F.pmod(F.col("deal"), F.lit(2 * n_blocks)).cast("int")).groupBy("bucket").applyInArrow(judge, to_flags)

    # a row for each block that has the minimiser
    w = W.partitionBy("least")
    seen = by_block.applyInArrow(census, "block int, least long, n long").withColumns({"total": F.sum("n").over(w), "blocks": F.count("*").over(w)})
    twice = cut(seen.filter("total >= 2").select("block", "least", (F.col("total") > HOT).alias("hot"), (F.col("blocks") > BLOCKS_EACH).alias("wide")))
    flags = judged(by_block.cogroup(twice.filter("not wide").groupBy("block")).applyInArrow(send, SENT))
    if not twice.filter("wide").isEmpty():
        # strings from so many blocks that not even one row of each may meet in a task: once from each part of the blocks
        sent = cut(by_block.cogroup(twice.filter("wide").groupBy("block")).applyInArrow(send, SENT).withColumn("part", F.floor(F.col("block") / BLOCKS_EACH).cast("int")))
        keys = ["least", "hot", "sid", "part"]
        once = sent.groupBy("deal", *keys).agg(F.first("packed").alias("packed"), F.sum("n").alias("n"), F.first("alone").alias("alone"))
        told = judged(once.withColumnRenamed("part", "block")).withColumnRenamed("block", "part")
        flags = flags.unionByName(sent.select("block", *keys).distinct().join(told, keys).select("block", "least", "hot", "sid", "flags"))
    return by_block.cogroup(flags.groupBy("block")).applyInArrow(
        rebuild, f"doc_id {id_type}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    )


ORACLE_SQL = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as t from documents),
p as (select r, i, md5(t[i:i+399]) as k from (select r, t, unnest(range(1, octet_length(t)-398)) as i from d where octet_length(t) >= 400)),
g as (select r, i from (select *, count(*) over (partition by k) as c from p) where c > 1),
s as (select r, i, coalesce(i - lag(i) over (partition by r order by i) > 400, true) as new from g),
u as (select r, i, sum(new::int) over (partition by r order by i) as s from s),
x as (select r, s, min(i) as a, max(i) + 399 as b from u group by r, s),
k as (select r, list(a order by a) as a, list(b order by a) as b, sum(b - a + 1) as n_removed, count(*) as n_spans from x group by r)
select doc_id, octet_length(t)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(case when n_spans is null then t else unhex(array_to_string(list_transform(range(1, (n_spans + 2)::bigint), lambda j: hex(t[(if(j = 1, 1, b[j-1] + 1)):(if(j > n_spans, octet_length(t), a[j] - 1))])), '')) end) as kept_sha256
from d left join k using (r)
"""
