"""Repeated byte strings against brute force: ordering, runs, hot and wide minimisers, odd texts."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hapdiff.llm import common, queries, suffix_dedup, suffix_sort
from tests.conftest import SMALL, rows
from tests.llm.test_operators import TEXTS, docs, empty  # noqa: F401


def plain(texts, window):
    """n_bytes, n_removed, spans and kept of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def got(df):
    return [(r.doc_id, (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept))) for r in df.collect()]


def same(df, texts, ids, window):
    assert sorted(got(df), key=repr) == sorted(zip(ids, plain(texts, window), strict=True), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 400), st.integers(2, 60), st.randoms(use_true_random=False))
def test_windows_in_order(alphabet, size, window, rng):
    text = np.array([rng.randrange(alphabet) for _ in range(size)], np.uint8)
    starts = np.arange(max(size - window + 1, 0))
    order, begins = suffix_sort.equal_windows(text, starts, window)
    raw = text.tobytes()
    own = [raw[i : i + window] for i in order]
    assert own == sorted(own) and sorted(order.tolist()) == starts.tolist()
    assert begins.tolist() == [k == 0 or own[k] != own[k - 1] for k in range(len(own))]


def test_long_common_prefixes_in_order():
    """Copies with few changes, whose windows are tied far beyond the depth of quicksort."""
    rng = np.random.default_rng(2)
    base = rng.integers(97, 123, 1500).astype(np.uint8)
    copies = [base.copy() for _ in range(20)]
    for k, own in enumerate(copies[1:]):
        own[rng.integers(0, 1500, k % 5)] = 65
    text = np.concatenate(copies)
    order, begins = suffix_sort.equal_windows(text, np.arange(len(text) - 399), 400)
    own = [text[i : i + 400].tobytes() for i in order]
    assert own == sorted(own) and begins.sum() == len(set(own))


@pytest.mark.parametrize("window", [5, 40, 400])
def test_runs_of_a_block(monkeypatch, window):
    """In chunks of a few hundred windows: every window in one run, with the smallest hash in it; the places are those of such hashes."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    texts = [(t or "").encode() for t in TEXTS[:60]] + [b"", b"ab" * 900]
    block = suffix_dedup._Block(texts, window)
    hashes = suffix_dedup.mer_hashes(block.text, block.mer)
    want, chosen = {}, set()
    for a, b in zip(block.starts, block.ends, strict=True):
        for i in range(a, b - window + 1):
            own = hashes[i : i + window - block.mer + 1]
            want[i] = own.min()
            chosen |= set((i + np.flatnonzero(own == own.min())).tolist())
    have = {}
    for first, size, least in zip(block.first, block.size, block.least, strict=True):
        have |= {i: least for i in range(first, first + size)}
    assert have == want and sorted(chosen) == block.places.tolist()
    assert (hashes[block.places] == block.values).all()


@pytest.mark.parametrize("hot, blocks_each", [(4096, 4096), (1, 4096), (3, 4096), (4096, 1), (2, 2)])
def test_cut_repeats(spark, monkeypatch, hot, blocks_each):
    """Small blocks; minimisers count as hot from `hot` places on, as wide from `blocks_each` blocks on."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCKS_EACH", blocks_each)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20000)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    line, passage = word(150), word(600)
    texts = [word(rng.randrange(900)) + rng.choice([line, passage, passage[100:], ""]) + word(rng.randrange(900)) for _ in range(90)]
    texts += [texts[3], texts[3], texts[5][7:], None, "", "a" * 399, "a" * 400, "b" * 400, "b" * 401, "xy" * 1500, passage, line * 5]
    own = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    same(suffix_dedup.cut_repeats(own), texts, range(len(texts)), 400)


@pytest.mark.parametrize("window", [2, 17, 64])
def test_other_windows(docs, window):  # noqa: F811
    own = docs.collect()
    same(suffix_dedup.cut_repeats(docs, window=window), [r.text for r in own], [r.doc_id for r in own], window)


def test_nothing(spark, empty):  # noqa: F811
    assert suffix_dedup.cut_repeats(empty).count() == 0
    none = spark.createDataFrame([(k, None) for k in range(50)] + [(None, "x" * 399)], "doc_id long, text string")
    assert {(r.n_removed, len(r.spans)) for r in suffix_dedup.cut_repeats(none).collect()} == {(0, 0)}
    with pytest.raises(ValueError):
        suffix_dedup.cut_repeats(empty, window=1)


def test_query(spark, duck):
    have, want = queries.op11_suffix_dedup(spark, SMALL).toPandas(), duck.sql(suffix_dedup.ORACLE_SQL).df()
    assert rows(have) == rows(want) and have.n_removed.sum() > 0


def test_rows_in_another_order_each_time(spark, monkeypatch):
    """A table whose rows stand elsewhere whenever it is read, one of them there more often than blocks hold."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20000)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passages = [word(450) for _ in range(40)]
    texts = [(k, word(rng.randrange(300)) + passages[k % 40] + word(rng.randrange(300))) for k in range(200)]
    texts += [(k, word(600)) for k in range(200, 260)] + [(300, word(700))] * 90 + [(301, None)] * 900 + [(None, "x" * 500)] * 2
    own = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    moved = own.mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), own.schema)
    same(suffix_dedup.cut_repeats(moved), [t for _, t in texts], [k for k, _ in texts], 400)


def test_blocks_follow_from_the_rows(spark, monkeypatch):
    """Whatever the partitions; rows that are equal are spread, and none is lost or made too often."""
    monkeypatch.setattr(common, "COPIES_EACH", 7)
    texts = [(k, f"text {k}") for k in range(500)] + [(None, "again")] * 700 + [(1, None)] * 3
    own = spark.createDataFrame(texts, "at long, count string")
    dealt = [common.deal(own.repartition(p), "count", 1000) for p in (1, 3, 8)]
    assert {n for _, n in dealt} == {-(-sum(64 + len(t or "") for _, t in texts) // 1000)}
    have = [Counter(map(tuple, d.collect())) for d, _ in dealt]
    assert have[0] == have[1] == have[2]
    assert Counter(r[:2] for r in have[0].elements()) == Counter(texts)
    assert len({b for k, t, b in have[0] if t == "again"}) > 20


@pytest.mark.parametrize("window", [5, 40, 400])
def test_strings_follow_from_the_texts(monkeypatch, window):
    """Documents in another order, so that chunks end elsewhere: the same strings are packed."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    texts = [(t or "").encode() for t in TEXTS[:60]] + [b"", b"ab" * 900, b"a line of a list, " * 150]

    def packed(own, hot):
        block = suffix_dedup._Block(own, window)
        least = np.unique(block.least)
        return Counter((*s[:3], block.packed(*s[3:]), block.alone(s[0], *s[3:])) for s in block.strings(least, np.full(len(least), hot)))

    for hot in (False, True):
        want = packed(texts, hot)
        assert want and all(packed(random.Random(k).sample(texts, len(texts)), hot) == want for k in range(5))


def test_chunks_end_elsewhere_each_time(spark):
    """Every text is there twice and all of it goes, in a block of several chunks whose rows are in another order whenever it is read."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    texts = [word(30) * rng.randrange(30, 200) for _ in range(60)] + [word(rng.randrange(400, 6000)) for _ in range(60)]
    rows_ = [(k, t) for k, t in enumerate(2 * texts)]
    assert 2 * suffix_dedup.CHUNK < sum(len(t) for _, t in rows_) < suffix_dedup.BLOCK_BYTES
    own = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    moved = own.mapInPandas(lambda parts: (p.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 32)) for p in parts), own.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")  # else passes of one job read the same files, in one order where there is one machine
    try:
        have = suffix_dedup.cut_repeats(moved).select("doc_id", "n_bytes", "n_removed", "kept").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r.doc_id, r.n_bytes) for r in have) == [(k, len(t)) for k, t in rows_]
    assert [r.doc_id for r in have if r.n_removed != r.n_bytes or r.kept] == []
