"""Words of Arrow batches as 64-bit hashes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than blank and \\t..\\r; lower: A-Z only."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(texts: list, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and each text's count of words."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = split_words(t, lower)
        counts[k] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.uint64), counts
    coded = pa.array(words, pa.binary()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)], counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64; fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out
