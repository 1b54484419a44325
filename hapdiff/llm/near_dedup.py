"""Near-duplicate documents by HyperMinHash.

A signature has REGISTERS registers. A shingle's hash picks one by its first bits; the smallest rest of
each register is kept as its count of leading zeros and MANTISSA bits that follow. Bands of registers
propose pairs, the collision-corrected share of equal registers drops hopeless ones, and every link is
confirmed on the full shingle sets.

Group sizes are never squared: exact copies of a set are one class; in a band's bucket all members are
first compared with its smallest id, and after that only members of different components are compared,
in blocks of BLOCK members whose tasks send back no more links than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import cut, fresh
from hapdiff.llm.components import components
from hapdiff.llm.wordhash import run_hashes, slices, split_words, word_hashes

REGISTERS = 256
MANTISSA = 10
BLOCK = 1024
#: A pair at the threshold is in no common band with at most this probability.
MISS = 1e-5
#: Pairs are dropped before verification when their estimate is this many deviations under the threshold.
DEVIATIONS = 5.0


def band_width(similarity: float) -> int:
    """The most registers a band may have under MISS."""
    return max(r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= MISS)


def _borrow() -> np.ndarray:
    """For each register, the order in which an empty one looks for a filled one; the same for all documents."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_ORDER = _borrow()


def signature(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of a sorted array of distinct hashes."""
    bucket = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (shingles[first] & np.uint64((1 << 56) - 1)) | np.uint64(1)
    exponent = np.frexp(rest.astype(np.float64))[1] - 1
    zeros = 55 - exponent
    shift = np.maximum(exponent - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    at = bucket[first]
    out[at] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    filled[at] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = _ORDER[empty]
        out[empty] = out[tries[np.arange(len(empty)), np.argmax(filled[tries], axis=1)]]
    return out


def _rank_shares(n: np.ndarray) -> np.ndarray:
    """For documents of n shingles, the probability of each count of leading zeros in a register."""
    load = np.maximum(n / REGISTERS, 1.0)[:, None]
    edge = 0.5 ** np.arange(0, 57)
    return (1 - edge[None, 1:]) ** load - (1 - edge[None, :-1]) ** load


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of all pairs of signature rows: equal registers, less those that would be equal by chance."""
    chance = _rank_shares(na) @ _rank_shares(nb).T / (1 << MANTISSA)
    equal = np.empty((len(a), len(b)), np.float64)
    step = max(1, (8 << 20) // (len(b) * REGISTERS))
    for k in range(0, len(a), step):
        equal[k : k + step] = (a[k : k + step, None, :] == b[None, :, :]).mean(axis=2)
    return np.maximum(0.0, (equal - chance) / (1 - chance))


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, counts = word_hashes(part.column("text").to_pylist(), lower=True)
            ends = np.cumsum(counts)
            ids, sigs, sizes = [], [], []
            for end, count in zip(ends, counts, strict=True):
                own = hashes[end - count : end]
                runs = np.unique(run_hashes(own, k) if count >= k else run_hashes(own, int(count)) if count else own)
                sizes.append(len(runs))
                ids.append(blake2b(runs.tobytes(), digest_size=16).digest() if len(runs) else None)
                sigs.append(signature(runs).tobytes() if len(runs) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sig"],
            )


def _close(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs u, v with signatures: those whose estimate is high enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("su", "sv"))
        na, nb = (np.asarray(batch.column(c), np.float64) for c in ("nu", "nv"))
        chance = (_rank_shares(na) * _rank_shares(nb)).sum(axis=1) / (1 << MANTISSA)
        found = ((a == b).mean(axis=1) - chance) / (1 - chance) >= least
        yield batch.select(["u", "v"]).filter(pa.array(found))


def _across(table: pa.Table, least: float, width: int) -> pa.Table:
    """One row with the pairs between a block's two sides that are in different components and estimated close.

    Pairs that share an earlier band too are left to that band.
    """
    side, band = np.asarray(table.column("side")), table.column("index")[0].as_py()
    comp = np.asarray(table.column("comp"), np.int64)
    n = np.asarray(table.column("n_shingles"), np.float64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        left = right = left if len(left) else right
    i, j = np.nonzero((estimate(sig[left], sig[right], n[left], n[right]) >= least) & (comp[left][:, None] != comp[right][None, :]))
    u, v = left[i], right[j]
    if band and len(u):
        own = np.ones(len(u), bool)
        for k in range(0, len(u), 1 << 15):
            before = sig[u[k : k + (1 << 15)], : band * width] == sig[v[k : k + (1 << 15)], : band * width]
            own[k : k + (1 << 15)] = ~before.reshape(len(before), band, width).all(axis=2).any(axis=1)
        u, v = u[own], v[own]
    u, v = np.minimum(u, v), np.maximum(u, v)
    pairs = np.unique(u.astype(np.int64) << np.int64(32) | v)
    wanted, at = np.unique(np.r_[pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF)], return_inverse=True)
    if not len(pairs):
        return _groups(table, 0).append_column("nodes", pa.array([], pa.list_(pa.int64()))).append_column("pairs", pa.array([], pa.binary()))
    nodes = np.asarray(table.column("node"), np.int64)[wanted]
    ends = nodes[at].reshape(2, -1)
    return _groups(table, 1).append_column("nodes", pa.array([nodes], pa.list_(pa.int64()))).append_column("pairs", pa.array([ends.tobytes()], pa.binary()))


def _groups(table: pa.Table, rows: int) -> pa.Table:
    return table.select(GROUP).slice(0, rows)


GROUP = ["band", "kind", "i", "j"]


def _runs(text: str | None, k: int) -> np.ndarray:
    hashes, counts = word_hashes([text], lower=True)
    return np.unique(run_hashes(hashes, min(k, int(counts[0])))) if counts[0] else hashes


def _linked(pairs: pa.Table, texts: pa.Table, k: int, hundredths: int) -> pa.Table:
    """Of the pairs of a block those that are linked on full sets, but none whose ends others connect already."""
    sets: dict[int, list] = {}
    for node, text in zip(texts.column("node"), texts.column("text"), strict=True):
        sets.setdefault(node.as_py(), []).append(_runs(text.as_py(), k))
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out: list[tuple[int, int]] = []
    for raw in pairs.column("pairs"):
        for u, v in np.frombuffer(raw.as_py(), np.int64).reshape(2, -1).T.tolist():
            a, b = top(u), top(v)
            if a == b:
                continue
            for x in sets.get(u, ()):
                for y in sets.get(v, ()):
                    small, big = (x, y) if len(x) <= len(y) else (y, x)
                    if 100 * len(small) < hundredths * len(big):
                        continue
                    both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
                    if 100 * both >= hundredths * (len(x) + len(y) - both) and top(u) != top(v):
                        above[top(u)] = top(v)
                        out.append((u, v))
    return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})


def shingle_set(text: str | None, k: int) -> frozenset:
    """The distinct runs of k words; with fewer words the whole sequence; without words nothing."""
    w = split_words(text, lower=True)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[j:] for j in range(k)), strict=False))


def _confirm(batches: Iterator[pa.RecordBatch], k: int, hundredths: int) -> Iterator[pa.RecordBatch]:
    last: dict[str, tuple] = {}
    for batch in batches:
        found = []
        columns = [batch.column(c) for c in ("u", "v", "tu", "tv")]
        for u, v, tu, tv in zip(*columns, strict=True):
            sets = []
            for side, node, text in (("u", u.as_py(), tu), ("v", v.as_py(), tv)):
                if side not in last or last[side][0] != node:
                    last[side] = (node, shingle_set(text.as_py(), k))
                sets.append(last[side][1])
            both = len(sets[0] & sets[1])
            found.append(100 * both >= hundredths * (len(sets[0]) + len(sets[1]) - both))
        yield batch.select(["u", "v"]).filter(pa.array(found, pa.bool_()))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Words are runs of non-white space, A-Z lower-cased. Rows are linked when their sets' Jaccard similarity
    is at least `similarity` (in hundredths, on full sets); component_id is the smallest id reachable. Rows
    without words are linked with nothing. Rows with a null id are linked with nothing, have a null component
    and are kept. Rows with equal ids are one document: a link of any of them counts for all that have words.
    id_col must be an integer.
    """
    hundredths, least = round(100 * similarity), similarity - DEVIATIONS * (similarity * (1 - similarity) / REGISTERS) ** 0.5
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(own.mapInArrow(partial(_sign, k=shingle), "doc_id long, n_shingles long, set_id binary, sig binary"))
    live = signed.filter("doc_id is not null and set_id is not null")
    # one row for each set, made while rows are still in place: copies, however many, are never joined with their class here
    nodes = live.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = cut(nodes)
    classes = nodes.select("set_id", "node")
    several = live.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("a != b").select("doc_id")
    same_id = live.join(several, "doc_id", "left_semi").join(classes, "set_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    width = band_width(similarity)
    large = F.col("n_shingles") * (1 - similarity) >= similarity - 1e-9  # smaller sets are like no other set
    key = lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * width) + 1, F.lit(2 * width)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // width - 1)), key)
    bands = nodes.filter(large).select("node", F.posexplode(keys).alias("index", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1").drop("n")
    members = cut(bands.join(shared, "band"))
    sig = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    stars = members.filter("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    stars = stars.join(sig("v"), "v").join(sig("u"), "u").mapInArrow(partial(_close, least=least), "u long, v long")

    def texts_of(ids: DataFrame) -> DataFrame:
        found = own.join(ids.distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
        return found.dropDuplicates(["doc_id", "h"]).drop("h")

    stars = cut(stars)
    texts = texts_of(stars.select(F.explode(F.array("u", "v")).alias("doc_id")))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    # joined by u last, so that v, the leader of many, travels and u's set is made once
    found = stars.join(side("v"), "v").join(side("u"), "u").mapInArrow(partial(_confirm, k=shingle, hundredths=hundredths), "u long, v long")
    first = cut(found.distinct().unionByName(same_id))
    comp = components(first).withColumnRenamed("component", "comp")
    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band").agg(F.max_by("comp", "n").alias("top"), (F.sum("n") - F.max("n")).alias("others"), F.max("n").alias("most"))
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = sizes.filter("others > 0").select("band", "top", blocks_of("others").alias("q"), blocks_of("most").alias("p"))
    mixed = placed.join(sizes, "band")
    is_top = F.col("comp") == F.col("top")
    mixed = mixed.withColumn("b", F.pmod(F.xxhash64("node", F.lit(7)), F.when(is_top, F.col("p")).otherwise(F.col("q"))).cast("int"))
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    to = F.when(is_top, F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: block(0, F.col("b"), j, 0))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: block(0, i, F.col("b"), 1)),
            F.transform(F.sequence(F.col("b"), F.col("q") - 1), lambda j: block(1, F.col("b"), j, 0)),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("b")), lambda i: i < F.col("b")), lambda i: block(1, i, F.col("b"), 1)),
        )
    )
    blocks = mixed.select("band", "index", "node", "comp", F.explode(to).alias("t")).select("band", "index", "t.*", "node", "comp")
    blocks = blocks.join(nodes.select("node", "sig", "n_shingles"), "node")

    def propose(table: pa.Table) -> pa.Table:
        return _across(table, least, width)

    def confirm(pairs_of: pa.Table, texts_of: pa.Table) -> pa.Table:
        return _linked(pairs_of, texts_of, shingle, hundredths)

    group = "band long, kind int, i int, j int"
    proposed = cut(blocks.groupBy(*GROUP).applyInArrow(propose, f"{group}, nodes array<long>, pairs binary"))
    wanted = proposed.select(*[F.col(c).alias(c) for c in GROUP], F.explode("nodes").alias("node"))
    texts = texts_of(wanted.select(F.col("node").alias("doc_id"))).withColumnRenamed("doc_id", "node")
    sent = wanted.join(texts, "node").select(*GROUP, "node", "text")
    across = proposed.select(*GROUP, "pairs").groupBy(*GROUP).cogroup(sent.groupBy(*GROUP)).applyInArrow(confirm, "u long, v long")
    final = components(first.unionByName(across)).withColumnRenamed("component", "comp")

    out = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left").join(final, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept: of each group of near copies those with its smallest id."""
    name = fresh(docs, "dropped_id")
    gone = near_duplicates(docs, shingle, similarity, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")


ORACLE_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i+2], ' ')) as k from (
        select doc_id, w, unnest(range(1, greatest(len(w)-2, 1)+1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
e as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100*shared >= 85*(a.n + b.n - shared)),
c as (select doc_id, doc_id as c from d union select c.doc_id, e.v from c join e on e.u = c.c)
select doc_id, any_value(coalesce(n, 0))::bigint as n_shingles, min(c) as component_id, doc_id = min(c) as kept
from c left join n using (doc_id) group by doc_id
"""
