"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary choices; each of the 255 inner nodes of the byte's code tree has a context tree of its
own over the last DEPTH bytes. A node of such a tree holds how often the choice was 0 and 1 after its context
and has the Krichevsky-Trofimov estimate (b + 1/2) / (a + b + 1). With Pe the KT probability of the node's
training choices and Pw = (Pe + product of the children's Pw) / 2, a prediction mixes the estimates of all
depths of the context, each against what lies deeper by its ratio Pe : product of the children's Pw.

The model is a table of (DEPTH + 1)-byte strings. Strings are counted in blocks of documents and summed by a
shuffle. Only nodes that occur are kept, a row for each context and node: the levels down to TOP bytes are
weighted in tasks that hold all of a TOP-byte context's strings, those above by a hash aggregate each; what they
say of a prediction goes down the same way, and the code lengths go back to the blocks that asked for them. Blocks
send their distinct strings and words to buckets as packed arrays: a key that all texts hold is there once for
each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import cut, partitions
from hapdiff.llm.wordhash import mix, slices

DEPTH = 5
#: Contexts of this many bytes are weighted whole in one task.
TOP = 3
BLOCK_BYTES = 16 << 20
SLICE = 1 << 20
#: The end of a text: a byte that no word holds. It is also what stands before a text.
END = b"\n"
#: The word table's key of the end token.
END_KEY = 0
GRAM, WORD = 0, 1


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    back = np.ones_like(x)
    for k in range(8):
        back *= x + k
    z = 1.0 / (y * y)
    series = (1 / 12.0 - z * (1 / 360.0 - z * (1 / 1260.0 - z / 1680.0))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(back)


def kt_log_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log probability that the KT estimator gives to any order of a zeros and b ones."""
    out = np.zeros(a.shape)
    some = (a + b) > 0
    x, y = a[some], b[some]
    out[some] = _lgamma(x + 0.5) + _lgamma(y + 0.5) - _lgamma(x + y + 1.0) - np.log(np.pi)
    return out


def _paths() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the eight nodes on its way and the choices there."""
    symbol = np.arange(256)[:, None]
    level = np.arange(8)[None, :]
    return (1 << level) - 1 + (symbol >> (8 - level)), (symbol >> (7 - level)) & 1


NODES, BITS = _paths()


@dataclass
class Level:
    """The nodes of one depth's contexts that occur, ascending by key, context << 8 | node: their choices, their KT estimates of a
    one, the shares of these against what lies deeper, and their log Pw."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    estimate: np.ndarray
    share: np.ndarray
    log_pw: np.ndarray


def level(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
    """below: the sums of the children's log Pw (None at the deepest)."""
    estimate, log_pe = (ones + 0.5) / (zeros + ones + 1.0), kt_log_block(zeros, ones)
    if below is None:
        return Level(key, zeros, ones, estimate, np.ones(len(key)), log_pe)
    ratio = np.exp(np.clip(log_pe - below, -700, 700))
    return Level(key, zeros, ones, estimate, ratio / (1.0 + ratio), np.logaddexp(log_pe, below) - np.log(2.0))


def _parent(key: np.ndarray, depth: int) -> np.ndarray:
    """The keys of the same nodes at the contexts' last `depth` bytes."""
    return ((key >> 8) & ((1 << (8 * depth)) - 1)) << 8 | key & 255


def _tree(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels depth..top of the contexts of strings, each node's place in the next one, and the places of each string's eight nodes."""
    symbol = grams & 255
    keys, at = np.unique((grams >> 8 << 8)[:, None] | NODES[symbol], return_inverse=True)
    at = at.reshape(-1, 8)
    chosen = BITS[symbol] == 1
    count = lambda some: np.bincount(at[some], weights=np.broadcast_to(n[:, None], at.shape)[some], minlength=len(keys))
    levels, parents = [level(keys, count(~chosen), count(chosen), None)], []
    for d in range(depth - 1, top - 1, -1):
        low = levels[-1]
        keys, parent = np.unique(_parent(low.key, d), return_inverse=True)
        zeros, ones, below = (np.bincount(parent, weights=x, minlength=len(keys)) for x in (low.zeros, low.ones, low.log_pw))
        levels.append(level(keys, zeros, ones, below))
        parents.append(parent)
    return levels, parents, at


def _strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(table.column("key"), np.int64), np.asarray(table.column("n"), np.float64)


NODE_ROWS = "node long, zeros double, ones double, below double"


def _top_rows(table: pa.Table, depth: int, top: int) -> pa.Table:
    """A row for each node of the contexts of depth top - 1, for what is in this task: sums of choices and of the log Pw below."""
    last = _tree(*_strings(table), depth, top)[0][-1]
    keys, parent = np.unique(_parent(last.key, top - 1), return_inverse=True)
    sums = [np.bincount(parent, weights=x, minlength=len(keys)) for x in (last.zeros, last.ones, last.log_pw)]
    return pa.table(dict(zip(("node", "zeros", "ones", "below"), map(pa.array, [keys, *sums]), strict=True)))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the sums of their children: choices, estimate, share and log Pw."""
    for batch in batches:
        x = level(*(np.asarray(batch.column(c)) for c in ("node", "zeros", "ones", "below")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), *map(pa.array, (x.zeros, x.ones, x.estimate, x.share, x.log_pw))],
            names=["node", "zeros", "ones", "estimate", "share", "log_pw"],
        )


def _upper(tops: DataFrame, top: int) -> DataFrame:
    """node, plus, times for the contexts of depth top - 1: a prediction is plus + times * (that of the depth below)."""
    of_depth, sums = [], tops
    parent = lambda depth: F.expr(f"shiftleft(shiftright(node, 8) & {(1 << (8 * depth)) - 1}L, 8) | (node & 255)")
    for depth in range(top - 1, -1, -1):
        sums = sums.groupBy(parent(depth).alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
        own = cut(sums.mapInArrow(_weigh, "node long, zeros double, ones double, estimate double, share double, log_pw double"))
        of_depth.append(own)
        sums = own.withColumnRenamed("log_pw", "below")
    out = of_depth[-1].select("node", (F.col("share") * F.col("estimate")).alias("plus"), (1 - F.col("share")).alias("times"))
    for depth, own in enumerate(reversed(of_depth[:-1])):
        above = out.select(F.col("node").alias("up"), F.col("plus").alias("p"), F.col("times").alias("t"))
        # the root has 255 nodes and its children 65,280 at most: those sides are broadcast
        own = own.withColumn("up", parent(depth)).join(F.broadcast(above) if depth < 2 else above, "up")
        out = own.select("node", (F.col("p") + F.col("t") * F.col("share") * F.col("estimate")).alias("plus"), (F.col("t") * (1 - F.col("share"))).alias("times"))
    return out


def _lengths(table: pa.Table, upper: pa.Table, depth: int, top: int) -> pa.Table:
    """log10 of the probability of each string's last byte after the bytes before it."""
    grams, n = _strings(table)
    levels, parents, at = _tree(grams, n, depth, top)
    p = levels[0].estimate[at]
    for own, parent in zip(levels[1:], parents, strict=True):
        at = parent[at]
        p = own.share[at] * own.estimate[at] + (1.0 - own.share[at]) * p
    known = np.asarray(upper.column("node"), np.int64)
    order = np.argsort(known)
    up = order[np.searchsorted(known, _parent(levels[-1].key, top - 1), sorter=order)][at]
    p = np.asarray(upper.column("plus"))[up] + np.asarray(upper.column("times"))[up] * p
    chosen = np.where(BITS[grams & 255] == 1, p, 1.0 - p)
    return pa.table({"bucket": table.column("bucket"), "key": table.column("key"), "bits": pa.array(np.log10(chosen).sum(axis=1))})


class _Texts:
    """Texts as one array of bytes: each one's words with a blank after each, then END, behind DEPTH times END."""

    def __init__(self, texts: list, depth: int):
        words = [t.encode().lower().split() if t else [] for t in texts]
        self.n_words = np.fromiter(map(len, words), np.int64, len(words))
        flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
        self.word_codes = np.asarray(flat.indices)
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
        self.word_keys = keys.view(np.int64)
        parts = [END * depth + (b" ".join(own) + b" " if own else b"") + END for own in words]
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        grams = np.zeros(max(len(raw) - depth, 0), np.int64)
        for j in range(depth + 1):
            grams = grams << 8 | raw[j : len(raw) - depth + j]
        self.lengths = lengths - depth
        ends = np.cumsum(lengths)
        inside = np.ones(len(grams), bool)
        for e in range(depth):  # strings that end in the bytes before a text
            inside[ends[:-1] - depth + e] = False
        self.grams = grams[inside]


def pack(values: np.ndarray) -> bytes:
    """64-bit values as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


def _count(table: pa.Table, depth: int, buckets: int) -> pa.Table:
    """kind, bucket, block, keys, n: what the block's texts hold and how often its training texts hold it."""
    found = {GRAM: (np.zeros(0, np.int64),) * 2, WORD: (np.zeros(0, np.int64),) * 2}
    for batch in table.to_batches():
        for part in slices(batch, "text", SLICE):
            texts, train = _Texts(part.column("text").to_pylist(), depth), np.asarray(part.column("train")).astype(np.int64)
            of_words = np.bincount(texts.word_codes, weights=np.repeat(train, texts.n_words), minlength=len(texts.word_keys))
            new = {
                GRAM: _summed(texts.grams, np.repeat(train, texts.lengths)),
                WORD: (np.r_[texts.word_keys, END_KEY], np.r_[of_words.astype(np.int64), train.sum()]),
            }
            for kind, (keys, n) in new.items():
                found[kind] = _summed(np.r_[found[kind][0], keys], np.r_[found[kind][1], n])
    rows, block = [], table.column("block")[0].as_py()
    for kind, (keys, n) in found.items():
        bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            rows.append((kind, int(bucket[own[0]]), block, pack(np.diff(keys[own], prepend=0)), pack(n[own])))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "bucket", "block", "keys", "n"])


def _asked(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row, and all distinct keys with the sums of their counts."""
    keys = [np.cumsum(unpack(x, np.int64)) for x in table.column("keys").to_pylist()]
    n = [unpack(x, np.int64) for x in table.column("n").to_pylist()]
    return keys, *_summed(np.concatenate(keys), np.concatenate(n))


def _answer(table: pa.Table, keys: list[np.ndarray], known: np.ndarray, values: np.ndarray, v: int, n: int) -> pa.Table:
    """kind, block, keys, values, v, n: the values of each row's keys; v and n in the first row."""
    rest = [0] * (len(keys) - 1)
    return pa.table({
        "kind": table.column("kind"), "block": table.column("block"), "keys": table.column("keys"),
        "values": pa.array([pack(values[np.searchsorted(known, k)].astype(np.float64)) for k in keys], pa.binary()),
        "v": pa.array([v, *rest], pa.int64()), "n": pa.array([n, *rest], pa.int64()),
    })


def _table(answers: pa.Table, kind: int) -> tuple[pd.Index, np.ndarray]:
    own = answers.filter(pa.array(np.asarray(answers.column("kind")) == kind))
    keys = [np.cumsum(unpack(x, np.int64)) for x in own.column("keys").to_pylist()]
    values = [unpack(x, np.float64) for x in own.column("values").to_pylist()]
    return pd.Index(np.concatenate(keys)), np.concatenate(values)


def _score(docs: pa.Table, answers: pa.Table, depth: int) -> pa.Table:
    (gram_at, bits), (word_at, seen) = _table(answers, GRAM), _table(answers, WORD)
    end_c = seen[word_at.get_indexer(np.array([END_KEY]))][0]
    v, n = (int(np.asarray(answers.column(c)).sum()) for c in ("v", "n"))
    out = []
    for batch in docs.to_batches():
        for part in slices(batch, "text", SLICE):
            texts, train = _Texts(part.column("text").to_pylist(), depth), np.asarray(part.column("train"))
            total = np.add.reduceat(bits[gram_at.get_indexer(texts.grams)], np.cumsum(texts.lengths) - texts.lengths)
            c = seen[word_at.get_indexer(texts.word_keys)][texts.word_codes]
            some = texts.n_words > 0
            before = (np.cumsum(texts.n_words) - texts.n_words)[some]
            log_sum, n_known = np.zeros(len(some)), np.zeros(len(some), np.int64)
            if some.any():
                log_sum[some] = np.add.reduceat(np.log10(c + 1), before)
                n_known[some] = np.add.reduceat((c > 0).astype(np.int64), before)
            rest = np.zeros(len(some) - 1, np.int64)
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "held_out": pa.array(~train), "n_tokens": pa.array(texts.n_words + 1),
                "n_known": pa.array(n_known + int(end_c > 0)), "log_sum": pa.array(log_sum + np.log10(end_c + 1)),
                "score": pa.array(total), "n_bytes": pa.array(texts.lengths), "v": pa.array(np.r_[v, rest]), "n": pa.array(np.r_[n, rest]),
            }))
            v = n = 0
    return pa.concat_tables(out)


def score(docs: DataFrame, train: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows where train holds (null: no). A text is its words (runs of non-white space,
    A-Z lower-cased), a blank after each, and an end; a null text is the end alone. score is log10 of the
    model's probability of that byte string; bits_per_byte its code length by byte. base_score is that of
    add-one counts of words with the end as one. Words are told by 64-bit hashes. Without training rows every
    choice has probability 1/2. Rows with equal ids are scored each.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    n_blocks = partitions(own, "text", BLOCK_BYTES)
    own = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text", "train")

    # as many as Spark has tasks for, so that none is the only one; as input grows, as many as there are blocks
    n_buckets = max(n_blocks, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(table: pa.Table) -> pa.Table:
        return _count(table, depth, n_buckets)

    asked = cut(own.groupBy("block").applyInArrow(count, "kind int, bucket int, block int, keys binary, n binary"))
    grams = asked.filter(F.col("kind") == GRAM)

    def merge(table: pa.Table) -> pa.Table:
        _, keys, n = _asked(table)
        return pa.table({"key": pa.array(keys), "n": pa.array(n), "bucket": pa.array(np.full(len(keys), table.column("bucket")[0].as_py(), np.int32))})

    counts = cut(grams.groupBy("bucket").applyInArrow(merge, "key long, n long, bucket int"))
    top = min(TOP, depth)
    # a context of top bytes is in one deal; those that share top - 1 bytes are in several, more of them as input grows
    spread = max(4, n_buckets // 64)
    context = lambda size: F.expr(f"shiftright(key, 8) & {(1 << (8 * size)) - 1}L")
    deal = F.pmod(F.xxhash64(context(top - 1), F.pmod(F.xxhash64(context(top)), F.lit(spread))), F.lit(n_buckets)).cast("int")
    dealt = counts.withColumn("deal", deal)

    def top_rows(table: pa.Table) -> pa.Table:
        return _top_rows(table, depth, top)

    upper = _upper(dealt.groupBy("deal").applyInArrow(top_rows, NODE_ROWS), top)
    wanted = dealt.select(F.col("deal").alias("to"), context(top - 1).alias("context")).distinct()
    sent = upper.withColumn("context", F.shiftright("node", 8)).join(wanted, "context").select("to", "node", "plus", "times")

    def lengths(left: pa.Table, right: pa.Table) -> pa.Table:
        return _lengths(left, right, depth, top)

    bits = dealt.groupBy("deal").cogroup(sent.groupBy("to")).applyInArrow(lengths, "bucket int, key long, bits double")
    answer = "kind int, block int, keys binary, values binary, v long, n long"

    def answer_grams(left: pa.Table, right: pa.Table) -> pa.Table:
        known, order = np.asarray(right.column("key")), np.argsort(np.asarray(right.column("key")))
        return _answer(left, _asked(left)[0], known[order], np.asarray(right.column("bits"))[order], 0, 0)

    def answer_words(table: pa.Table) -> pa.Table:
        keys, known, n = _asked(table)
        return _answer(table, keys, known, n, int((n > 0).sum()), int(n.sum()))

    gram_answers = grams.groupBy("bucket").cogroup(bits.groupBy("bucket")).applyInArrow(answer_grams, answer)
    word_answers = asked.filter(F.col("kind") == WORD).groupBy("bucket").applyInArrow(answer_words, answer)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, depth)

    answers = gram_answers.unionByName(word_answers)
    id_type = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, log_sum double, score double, n_bytes long, v long, n long"
    scored = cut(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema))
    n, v = scored.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    base = F.col("log_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
