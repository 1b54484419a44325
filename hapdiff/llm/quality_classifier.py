"""Document quality from random-indexing word vectors and a small calibrated network.

Words, and the shapes of words, fall into SLOTS hashed slots. A slot's index vector is a few random signs; its
word vector is the sum of the index vectors around its occurrences in the training sample, scaled to length
one. A document is the mean and spread of the vectors of its words and shapes. The network has one hidden
layer; its probabilities are calibrated by a temperature on part of the sample that it didn't learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import whole
from hapdiff.llm.wordhash import slices

SLOTS, DIMS, SIGNS, REACH, HIDDEN = 1 << 15, 64, 6, 2, 32
#: The most labelled rows that are learned from: those with the smallest hashes of their ids. Bounds the driver's work.
SAMPLE = 20_000
EPOCHS = 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0x41, 0x61, 0x61, 0x30


def shapes(words: list[bytes]) -> list[bytes]:
    """Of each word, runs of capitals, other letters and digits as one A, a or 0, and runs of another character as two of it."""
    if not words:
        return []
    c = _CLASS[np.frombuffer(b"\n".join(words), np.uint8)]
    before = np.r_[np.uint8(0), c[:-1]]
    twice = (c == before) & (np.r_[np.uint8(0), before[:-1]] == c)
    kind = (c == 0x41) | (c == 0x61) | (c == 0x30)
    return c[~np.where(kind, c == before, twice)].tobytes().split(b"\n")


def index_vectors() -> np.ndarray:
    """SLOTS x DIMS: SIGNS random signs in each row; the same everywhere."""
    rng = np.random.default_rng(11)
    out = np.zeros((SLOTS, DIMS), np.float32)
    at = rng.integers(0, DIMS, (SLOTS, SIGNS))
    np.add.at(out, (np.arange(SLOTS)[:, None], at), rng.choice(np.float32([-1, 1]), (SLOTS, SIGNS)))
    return out


def _slots(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of all words and of their shapes, and each text's count of words."""
    words = [t.encode().split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    unique = flat.dictionary.to_pylist()
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) % SLOTS for w in unique), np.int64, len(unique))
    two = np.fromiter((xxhash.xxh3_64_intdigest(w, 1) % SLOTS for w in shapes(unique)), np.int64, len(unique))
    codes = np.asarray(flat.indices)
    return one[codes] if len(codes) else one, two[codes] if len(codes) else two, counts


def _contexts(texts: list, index: np.ndarray) -> np.ndarray:
    """What the texts add to the word vectors: for each slot the index vectors within REACH words."""
    one, two, counts = _slots(texts)
    out = np.zeros((SLOTS, DIMS), np.float32)
    doc = np.repeat(np.arange(len(counts)), counts)
    for d in range(1, REACH + 1):
        same = np.flatnonzero(doc[:-d] == doc[d:])
        for a, b in ((same, same + d), (same + d, same)):
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                seen = index[one[y]] + index[two[y]]
                for slots in (one[x], two[x]):
                    order = np.argsort(slots, kind="stable")
                    own = slots[order]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    out[own[first]] += np.add.reduceat(seen[order], first, axis=0)
    return out


def features(texts: list, vectors: np.ndarray) -> np.ndarray:
    """4 x DIMS + 4 for each text: mean and spread of its words' and shapes' vectors, its length, and how often a word's
    vector is that of the word before and that of any other word; zeros for no words."""
    one, two, counts = _slots(texts)
    out = np.zeros((len(texts), 4 * DIMS + 4), np.float32)
    starts = np.cumsum(counts) - counts
    some = np.flatnonzero(counts)
    for k in range(0, len(some), 64):
        own = some[k : k + 64]
        lo, hi = starts[own[0]], starts[own[-1]] + counts[own[-1]]
        n = counts[own][:, None]
        for j, slots in enumerate((one, two)):
            v = vectors[slots[lo:hi]]
            mean = np.add.reduceat(v, starts[own] - lo, axis=0) / n
            square = np.add.reduceat(v * v, starts[own] - lo, axis=0) / n
            out[own, 2 * j * DIMS : (2 * j + 1) * DIMS] = mean
            out[own, (2 * j + 1) * DIMS : (2 * j + 2) * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
    doc = np.repeat(np.arange(len(texts)), counts)
    again = np.bincount(doc[1:][(one[1:] == one[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    kinds = np.bincount(np.unique(doc * SLOTS + one) // SLOTS, minlength=len(texts))
    out[:, -4] = again / np.maximum(counts, 1)
    out[:, -3] = (counts - kinds) / np.maximum(counts, 1)
    out[:, -2] = np.log1p(counts)
    out[:, -1] = (counts == 0).astype(np.float32)
    return out


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """The network for rows x with labels y; every fifth row only sets the temperature. With one class or no rows: its constant share."""
    rng = np.random.default_rng(3)
    d = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    part = np.arange(len(y)) % 5 == 4
    cx, cy, x, y = x[part], y[part], x[~part], y[~part]
    net = Network(x.mean(0), x.std(0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    xs = (x - net.shift) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 256):
            own = order[k : k + 256]
            h = np.tanh(xs[own] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            g = (p - y[own]) / len(own)
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [xs[own].T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            t += 1
            for q, (p_, g_) in enumerate(zip(params, grads, strict=True)):
                m[q] = 0.9 * m[q] + 0.1 * g_
                v[q] = 0.999 * v[q] + 0.001 * g_ * g_
                p_ -= 0.003 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    z = net.logits(cx)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, z / c) - cy * z / c) for c in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors (SLOTS x DIMS) and network from at most SAMPLE of the labelled documents.

    An id with several labels counts as its highest; rows with a null id or label are left out. What reaches
    the driver: ids up to SAMPLE, their features, and SLOTS x DIMS sums.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    sample = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "_id").drop("_id")
    index = index_vectors()

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, DIMS), np.float32)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                total += _contexts(part.column("text").to_pylist(), index)
        for k in np.flatnonzero(total.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([total[k]], pa.list_(pa.float32()))], names=["slot", "v"])

    sums = sample.select("text").mapInArrow(accumulate, "slot int, v array<float>")
    sums = sums.groupBy("slot").agg(F.array(*[F.sum(F.col("v")[k]).cast("float") for k in range(DIMS)]).alias("v"))
    vectors = index / np.sqrt(np.float32(SIGNS)) * np.float32(0.1)
    for row in sums.toLocalIterator():
        own = np.array(row["v"], np.float32)
        vectors[row["slot"]] += own / max(float(np.linalg.norm(own)), 1e-9)

    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # SLOTS x DIMS floats, 8 MB

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = features(part.column("text").to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column("_y")], names=["x", "y"])

    rows = sample.mapInArrow(describe, "x binary, y int").toArrow().sort_by([("x", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, 4 * DIMS + 4).astype(np.float64)
    y = np.asarray(rows.column("y"), np.float64)
    order = np.random.default_rng(5).permutation(len(y))
    return vectors, fit(x[order], y[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs and score_col: the calibrated probability of label 1. A column of that name is replaced; null texts count as empty."""
    rest = docs.drop(score_col).withColumn(text_col, F.col(text_col).cast("string"))
    names, sent = rest.columns, docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                p = network.probability(features(part.column(text_col).to_pylist(), sent.value).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, `{score_col}` double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0
