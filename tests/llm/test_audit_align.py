"""Filter audits and token alignment against plain Python, on a small table with nulls, ties, copies and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hapdiff.llm import filter_audit, queries, token_align
from tests.conftest import SMALL, rows
from tests.llm.test_operators import TEXTS, docs, empty  # noqa: F401

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def labels(spark):
    own = [(k, k % 2, int(k % 9 == 0), "x") for k in range(60)] + [(4, 1, 1, "y"), (None, 1, 1, "z")]
    return spark.createDataFrame(own, "doc_id long, quality int, toxic int, lang string")


def failing(text, doc_id, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
            doc_id is not None and doc_id > least[text],
        ), strict=True) if bad
    }


def test_filter_audit(docs, labels):  # noqa: F811
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(filter_audit.judged(docs, labels)).collect()}
    marks = defaultdict(lambda: (0, 0))
    for r in labels.filter("doc_id is not null").collect():
        marks[r.doc_id] = (max(marks[r.doc_id][0], r.quality), max(marks[r.doc_id][1], r.toxic))
    own, least = [(r.doc_id, r.lang or "", r.text or "") for r in docs.collect()], {}
    for k, _, t in own:
        if k is not None:
            least[t] = min(least.get(t, k), k)
    every = [(part, failing(t, k, least), marks[k] if k is not None else (0, 0)) for k, part, t in own]
    shapley, want = Counter(), {}
    for part in {p for p, _, _ in every}:
        mine = [(f, m) for p, f, m in every if p == part]
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                shapley[part, f] += len(gone)
                want[part, "".join(order), step] = (
                    f, len(alive), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine),
                    sum(x[1][0] == 1 for x in gone), sum(x[1][1] == 1 for x in gone),
                )
    assert {k: (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for k, r in got.items()} == want
    assert all(r.shapley == shapley[r.part, r.filter] for r in got.values())
    assert all(any(r.removed for r in got.values() if r.filter == f) for f in "ABCDE") and any(r.toxic_lost for r in got.values())


def test_filter_audit_states_are_shared(docs, labels):  # noqa: F811
    trie = filter_audit._Trie(filter_audit.judged(docs, labels), 5)
    trie.walk()
    assert len(trie.survivors) == len(trie.counts) == 31  # 32 prefixes without order, the last of which removes nothing


def test_filter_audit_of_nothing(empty, labels, spark):  # noqa: F811
    assert filter_audit.interactions(filter_audit.judged(empty, labels)).count() == 0
    one = spark.createDataFrame([(1, None, "one two")], "doc_id long, lang string, text string")
    none = labels.filter("doc_id < 0")
    got = filter_audit.interactions(filter_audit.judged(one, none)).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120
    with pytest.raises(ValueError):
        filter_audit.interactions(filter_audit.judged(one, none), "ABCDEFG")


def test_hot_text_is_dealt(spark):
    own = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.lit("same").alias("text"))
    measured = filter_audit._measured(own, "lang", "doc_id", "text")
    got = filter_audit._with_copies(measured)
    assert got.filter("copy").count() == 4999
    assert got.select("deal").distinct().count() == filter_audit.SPREAD


def test_filter_audit_query(spark, duck):
    got, want = queries.op13_filter_audit(spark, SMALL).toPandas(), duck.sql(filter_audit.ORACLE_SQL).df()
    assert rows(got) == rows(want) and len(got)


def spelled(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + size(i)))
        at += size(i)
    return out


def aligned(texts, link):
    """n_a, n_b, n_groups, links and groups of each text, by loops over intervals."""
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    a_bytes = lambda i: bytes(byte[c] for c in a_of.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = a_of.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_of.encode(t) if t else []
        if not t or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            out.append((0, 0, 0, [], ""))
            continue
        a, b = spelled(a, lambda i: len(a_bytes(i))), spelled(b, lambda i: len(b_bytes(i)))
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if before < e <= c) for side in (a, b)))
            before = c
        meet = (lambda x, y: x[2] == y[2]) if link == "ends" else (lambda x, y: x[1] < y[2] and y[1] < x[2])
        out.append((len(a), len(b), len(cuts), [(x[0], y[0]) for x in a for y in b if meet(x, y)], ";".join(groups)))
    return out


ODD = ["<|endoftext|> and <s> </s>", "a▁b", "ﬁne ½ ①", "two  blanks\t\n tabs ", " lead", "éé \U0001f600\U0001f600", "don't they'll", "x" * 3000, " ", "    ", "end   ", "a \n ", "\x00\x01"]


@pytest.mark.parametrize("link", ["ends", "overlaps"])
def test_token_align(spark, monkeypatch, link):
    monkeypatch.setattr(token_align, "SLICE_BYTES", 2000)
    texts = [None, "", *ODD, *[t for t in TEXTS if t is None or len(t) < 2500], ODD[0]]
    own = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    files = [open(p, "rb").read() for p in (BYTES, PIECES)]
    got = {r.doc_id: r for r in token_align.align(own, *files, link=link).collect()}
    want = aligned(texts, link)
    counts = Counter(pair for w in want for pair in w[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for k, (n_a, n_b, n_groups, links, groups) in enumerate(want):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, len(links)), texts[k]
        assert r.groups == groups
        assert (r.n_best, r.count_sum) == (sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links))
    assert len(got) == len(texts) and want[2][0] and not want[3][0]


def test_ids_of_pieces_are_the_whole_texts():
    """Any mix of blanks, parts of words, other white space and odd characters: the ids of its pieces are the libraries' for the whole text."""
    rng = random.Random(5)
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    first, second = token_align._vocabularies(*[open(p, "rb").read() for p in (BYTES, PIECES)])
    assert second.cuts
    parts = [" ", " ", "  ", "   ", "\n", "\t", "\r\n", "a", "the", "ing", "'s", "'", "é", "\u3000", "\xa0", "\x1c", "\x85", "\u2028", "0", "1", ".", "--", "\U0001f600", "ß", "<s>", "<0x41>", "<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        pieces = token_align.cut_text(text)
        assert "".join(" " + p for p in pieces) == " " + text
        assert sum(first.ids(pieces), []) == whole.encode(" " + text, add_special_tokens=False).ids, repr(text)
        own = second.ids(pieces)
        if None in own:  # the model turns a sign into another one: its bytes are not the text's
            assert b"".join(map(second.spelled.__getitem__, second.model.encode(text))) != (" " + text).encode()
        else:
            assert sum(own, []) == second.model.encode(text), repr(text)


@pytest.mark.parametrize("together", [1, 5, 64])
def test_ids_of_many_pieces_at_once(monkeypatch, together):
    """In a row and in few calls, they are those of each piece alone, whatever white space, odd signs and unspelled pieces lie between."""
    monkeypatch.setattr(token_align, "TOGETHER", together)
    rng = random.Random(8)
    sides = token_align._vocabularies(*[open(p, "rb").read() for p in (BYTES, PIECES)])
    parts = [" ", "\n", "\t", "a", "the", "ing", "'s", "é", "\u3000", "\xa0", "\x1c", "\x85", "0", ".", "--", "\U0001f600", "<s>", "<0x41>", "\u2581", "ﬁ", "\0"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) if rng.random() < 0.3 else rng.choice(["word", "der", "Ängste", "x1.5"]) for _ in range(40)]
        block = token_align._Block(texts, sides)
        pieces = sorted({p for t in texts if t for p in token_align.cut_text(t)}, key=lambda p: rng.random())
        for side in sides:
            each = side.ids(pieces)
            ids, n = side.flat(pieces)
            assert n.tolist() == [-1 if x is None else len(x) for x in each]
            assert ids.tolist() == [i for x in each if x is not None for i in x]
        for t, d in zip(texts, block.docs, strict=True):
            own = [side.ids(token_align.cut_text(t)) for side in sides] if t else [[None]] * 2
            assert (d is None) == (None in own[1])
            for k in range(2) if d is not None else ():
                ids, n = block._tokens(d, k)
                assert (ids.tolist(), n.tolist()) == (sum(own[k], []), list(map(len, own[k])))
    assert sides[1].flat([])[0].tolist() == sides[0].flat([])[0].tolist() == []


def test_words_are_encoded_together(monkeypatch):
    sides = token_align._vocabularies(*[open(p, "rb").read() for p in (BYTES, PIECES)])
    monkeypatch.setattr(token_align.ByteLevel, "ids", lambda *_: pytest.fail("one by one"))
    monkeypatch.setattr(token_align.Pieces, "ids", lambda *_: pytest.fail("one by one"))
    assert len(token_align._Block(["one two three"] * 3 + ["four\nfive six"], sides).docs) == 4


def test_token_align_in_many_blocks(spark, monkeypatch):
    """Blocks of a few documents and a join in several parts give what one block gives; so do repeated rows."""
    own = spark.createDataFrame([(k % 40, t) for k, t in enumerate(TEXTS[:60])] + [(7, "one two")] * 5, "doc_id long, text string")
    files = [open(p, "rb").read() for p in (BYTES, PIECES)]
    one = token_align.align(own, *files).toPandas()
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(token_align, "BLOCKS_EACH", 2)
    many = token_align.align(own, *files).toPandas()
    assert rows(one) == rows(many) and len(one) == 65


def test_token_align_of_nothing(spark, empty):  # noqa: F811
    files = [open(p, "rb").read() for p in (BYTES, PIECES)]
    assert token_align.align(empty, *files).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_a, r.groups) for r in token_align.align(nothing, *files).collect()] == [(0, ""), (0, "")]
    with pytest.raises(ValueError):
        token_align.align(nothing, *files, link="starts")


def test_token_align_query(spark):
    got = {r.doc_id: r for r in queries.op12_token_align(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    some = [k for k in texts if k % 10 == 0]
    for k, (n_a, n_b, n_groups, links, groups) in zip(some, aligned([texts[k] for k in some], "ends"), strict=True):
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (got[k].n_a, got[k].n_b, got[k].n_groups, got[k].n_links, got[k].groups_sha256) == (n_a, n_b, n_groups, len(links), sha)
    assert len(got) == len(texts)


def test_deal_spreads_empty_and_equal_rows(spark):
    from hapdiff.llm.common import deal

    own = spark.range(200000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    dealt, n = deal(own, "text", 1 << 20)
    counts = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert n == 13 and len(counts) == 13 and max(counts) < 2 * 200000 / 13
