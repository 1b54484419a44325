"""The corpus operators against brute force, on a small table with nulls, ties, copies and clashing names."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from hapdiff.llm import (
    components, ctw, decontam, line_dedup, near_dedup, quality_classifier, quality_rules, queries, sentencepiece_codec, sharding, substring_dedup, wrapper,
)
from tests.conftest import SMALL, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_words int, failures string, ids string, leaked_items string"


def _texts() -> list:
    rng = random.Random(4)
    word = lambda: rng.choice("stone river Lamp grass old winter seven é x Zwölf".split(" ")) + str(rng.randrange(300))
    passage = " ".join(word() for _ in range(60))
    out = [" ".join(word() for _ in range(rng.choice([1, 5, 40, 120]))) for _ in range(40)]
    base = [word() for _ in range(200)]
    for k in range(12):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(200)] = word()
        out.append(" ".join(own))
    out += [f"{' '.join(word() for _ in range(20))} {passage}\nShared line {k % 2}\n{word()}" for k in range(14)]
    out += [out[0], out[0], "a a a a " * 30, "", None, None, "  \n\t ", "one", "one", "!!! ??? ### $$$ " * 10, "UPPER CASE WORDS " * 20]
    out.append(" ".join(word() for _ in range(4000)) + "\n" + passage.upper())
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    own = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "hot" if k % 3 else "b", 1, 2, "x", "y", "z") for k, t in enumerate(TEXTS)]
    own += [(3, TEXTS[3], "en", "b", 1, 2, "x", "y", "z"), (None, TEXTS[50], "en", "b", 1, 2, "x", "y", "z")]
    return spark.createDataFrame(own, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in own] if lower else own


def test_substring_dedup(docs):
    own = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in own for i in range(len(w) - 34))
    want = []
    for k, w in own:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((str(k), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.cut_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


@pytest.mark.parametrize("k, similarity", [(3, 0.85), (5, 0.8)])
def test_near_dedup(docs, k, similarity):
    own = [(r.doc_id, near_dedup.shingle_set(r.text, k)) for r in docs.collect()]
    above = {}

    def top(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, x in own:
        for b, y in own:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= round(100 * similarity) * len(x | y) and top(a) != top(b):
                above[max(top(a), top(b))] = min(top(a), top(b))
    want = sorted((str(a), len(x), str(None if a is None else top(a)), a is None or top(a) == a) for a, x in own)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(docs, k, similarity).collect())
    assert got == want and len({x[2] for x in want}) < len(want) - 10


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for shared in (1000, 1700):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - shared : 4000 - shared])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = near_dedup.estimate(*(near_dedup.signature(x)[None] for x in (a, b)), np.array([len(a)]), np.array([len(b)]))[0, 0]
        assert abs(got - j) < 5 * math.sqrt(j * (1 - j) / near_dedup.REGISTERS)


def test_line_dedup(docs):
    own = [(r.doc_id, (r.text or "").split("\n")) for r in docs.collect()]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for k, ls in own:
        for x in ls:
            held[key(x)].add(k)
    for least in (5, 10):
        stay = lambda x: not (len(key(x)) >= 1 and len(held[key(x)]) >= least)  # noqa: B023,E731
        want = sorted((str(k), len(ls), sum(not stay(x) for x in ls), "\n".join(x for x in ls if stay(x))) for k, ls in own)
        got = line_dedup.drop_common_lines(docs, least)
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
        assert {"lang", "source", "failures"} <= set(got.columns)


def test_quality_measures(docs):
    for r in quality_rules.ledger(docs.drop("n_words").withColumn("n_words", F.lit("old"))).collect():
        w = words(r.text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_dup_lines, r.n_symbols) == (len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", r.text or "")))


def test_policies_and_ablations(docs):
    led = quality_rules.ledger(docs)
    policy = quality_rules.POLICIES["v1"]
    kept = quality_rules.judge(led, policy).filter("kept").count()
    for r in quality_rules.ablations(led, policy).collect():
        less = quality_rules.Policy("x", tuple(x for x in policy.rules if x != r.rule))
        assert r.kept_without == kept + r.failed_alone == quality_rules.judge(led, less).filter("kept").count()


def test_sharding(docs):
    got = sharding.interleave(docs, 4).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == [0, 1, 2, 3] and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {r.doc_id: r.source for r in docs.collect()}
    mix = Counter((r.shard, source[r.doc_id]) for r in got)
    for s in set(source.values()):
        own = [mix[(k, s)] for k in range(4)]
        assert max(own) - min(own) <= 2


def _brute_ctw(texts, train, depth):
    raw = [(b" ".join(t.encode().lower().split()) + b" " if t and t.split() else b"") + b"\n" for t in texts]
    padded = [b"\n" * depth + x for x in raw]
    counts = defaultdict(Counter)  # (context, code prefix) -> choices
    for x, use in zip(padded, train, strict=True):
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                for b in range(8):
                    counts[(x[i - d : i], x[i] >> (8 - b) | 1 << b)][x[i] >> (7 - b) & 1] += use
    below = defaultdict(list)
    for c, p in counts:
        if c:
            below[(c[1:], p)].append((c, p))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)
    pw, ratio = {}, {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        pe = kt(counts[k])
        if len(k[0]) == depth:
            pw[k] = pe
        else:
            deeper = sum(pw[c] for c in below[k])
            ratio[k] = pe - deeper
            pw[k] = np.logaddexp(pe, deeper) - math.log(2)
    out = []
    for x in padded:
        total = 0.0
        for i in range(depth, len(x)):
            for b in range(8):
                p = 0.0
                for d in range(depth, -1, -1):
                    k = (x[i - d : i], x[i] >> (8 - b) | 1 << b)
                    own = (counts[k][1] + 0.5) / (counts[k][0] + counts[k][1] + 1)
                    share = 1.0 if d == depth else 1 / (1 + math.exp(min(700, -ratio[k])))
                    p = share * own + (1 - share) * p
                total += math.log10(p if x[i] >> (7 - b) & 1 else 1 - p)
        out.append(total)
    return out


def test_ctw(spark):
    own = [(k, t) for k, t in enumerate([*TEXTS[:30], None, "", "zzz qqq", "  \t"])]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    train = [k % 3 != 0 for k, _ in own]
    want = _brute_ctw([t for _, t in own], train, ctw.DEPTH)
    got = {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") % 3 != 0).collect()}
    seen = Counter(w for (_, t), use in zip(own, train, strict=True) if use for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(seen.values()), len(seen)
    for (k, t), score in zip(own, want, strict=True):
        tokens = [*(t or "").encode().lower().split(), None]
        assert math.isclose(got[k].score, score, rel_tol=1e-7)
        assert math.isclose(got[k].base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens, got[k].held_out) == (len(tokens), sum(seen[w] > 0 for w in tokens), n, k % 3 == 0)


def test_decontamination_tolerates_replaced_words(spark):
    item = [f"w{k}" for k in range(40)]
    changed = ["X" if k % 6 == 5 else w for k, w in enumerate(item)]
    half = ["X" if k % 2 else w for k, w in enumerate(item)]
    texts = [" ".join(["a", *item, "b"]).upper(), " ".join(["a"] * 9 + changed), " ".join(half), "nothing here", None, "", "w0 w1 w2 w3 w4 w5"]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, leaked_items string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "a b"), (7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: list(r.leaked_items) for r in decontam.mark_leaks(docs, bench).collect()}
    assert got == {0: [7], 1: [7], 2: [], 3: [], 4: [], 5: [], 6: []}
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(texts)


def test_decontamination_finds_short_items_on_all_diagonals(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 12)}
    texts = []
    for n, item in items.items():
        for gone in [c for r in range(n // 5 + 2) for c in combinations(range(n), r)]:
            texts.append(["a", *("X" if k in gone else w for k, w in enumerate(item)), "b"])
    want = {}
    for k, t in enumerate(texts):
        for n, item in items.items():
            if any(5 * sum(0 <= d + j < len(t) and t[d + j] == w for j, w in enumerate(item)) >= 4 * n for d in range(-n, len(t))):
                want[k] = [n]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()] + [(99, ""), (98, None)], "item_id long, text string")
    got = {r.doc_id: list(r.leaked_items) for r in decontam.mark_leaks(docs, bench).collect() if r.leaked_items}
    assert got == want and len(want) < len(texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _best(v, s):
    """The score of the best segmentation, by plain dynamic programming."""
    pieces = {t: v.scores[k] for k, t in v.spelled.items()}
    best = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            if s[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[s[i:j]])
            if j == i + 1 and s[i:j] not in pieces:
                best[j] = max(best[j], best[i] + v.unknown)
    return best[-1]


def test_sentencepiece(spark, docs):
    model = sentencepiece_codec.read_model(spark, MODEL)
    encoded = sentencepiece_codec.encode(docs, model)
    assert encoded.schema["ids"].dataType.simpleString() == "array<int>"
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = sentencepiece_codec.decode(encoded, model).collect()
    assert sorted(map(str, docs.columns)) == sorted(c for c in encoded.columns if c != "ids" or "ids" in docs.columns)
    for r in found:
        assert r.decoded == (r.text or "") and r.ids == library.encode(r.text or "")
    empty = sentencepiece_codec.decode(sentencepiece_codec.encode(docs.limit(0), model), model)
    assert empty.count() == 0 and "decoded" in empty.columns
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 99_999_999, 22557]), (4, [28705, 242, 191])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in sentencepiece_codec.decode(odd, model).collect()} == {1: "", 2: "", 3: "Hello", 4: "\ufffd"}


@pytest.mark.parametrize("merges", [True, False])
def test_streaming_viterbi(merges):
    """Ids are the library's (merges) or the best-scoring path's (sums of scores), in whatever portions a text is fed."""
    with open(MODEL, "rb") as f:
        model = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    v = sentencepiece_codec.Vocabulary.load(model)
    assert v.merges
    if not merges:
        v = sentencepiece_codec.Vocabulary([(t, v.scores[k], k) for k, t in v.spelled.items()], v.byte_ids)
    score, alone = v.scores, set(v.spelled.values())
    codec = sentencepiece_codec.Codec(v)
    rng = random.Random(5)
    parts = ["a", "ab", "the", "ing", " ", "   ", "\n", "é", "中", "\U0001f600", "\x00", "0", "==", "-", "'s", "Über", " " * 37, "b" * 41]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for text in ["Hello  world, it was raining.", "naïve ▁ \U0001f600 tab\tend\n", "a" * 300, " lead and trail ", *texts]:
        ids = codec.encode(text)
        s = "▁" + text.replace("▁", sentencepiece_codec._OWN).replace(" ", "▁")
        if merges:
            assert "▁" in text or ids == library.encode(text)
        else:
            spelled = sum(c not in alone for c in s)
            assert math.isclose(sum(score.get(k, 0.0) for k in ids) + spelled * v.unknown, _best(v, s), rel_tol=1e-9)
        stream, fed = sentencepiece_codec.Stream(v), []
        for c in s:
            fed += stream.feed(c)
        fed += stream.feed("", last=True)
        assert fed == ids
        # paths over a run of one letter may never meet: only there does the window go on
        assert "aaa" in text or "bbb" in text or "    " in text or stream.most_kept <= 6 * v.longest + 2


def test_sentencepiece_long():
    """A text of some megabytes and a word of many portions: the library's ids, from a window that stays short."""
    with open(MODEL, "rb") as f:
        model = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(model))
    text = " ".join(f"word{k % 997} and more{k % 31}," for k in range(150_000))
    assert codec.encode(text) == library.encode(text)
    word = "".join(f"abc{k}" for k in range(20_000))
    assert codec.encode(word) == library.encode(word)
    stream, ids = sentencepiece_codec.Stream(codec.v), []
    for at in range(0, len(word), 50):
        ids += stream.feed(word[at : at + 50])
    assert stream.most_kept <= 6 * codec.v.longest + 50 and len(ids) > 10_000


def test_remembered_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED_BYTES", 20_000)
    with open(MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(f.read()))
    for k in range(300):
        codec.encode(f"number {k}")
        assert codec.held <= 11_000 and len(codec.earlier) < 100


def test_wrapper(spark):
    page = lambda k: f"""<html><head><title>T</title><style>p {{}}</style></head><body><div class="nav"><a href="/">Home {k}</a></div>
    <div id="box">Welcome to our fine site</div><article><h1>Head &amp; {k}</h1><p>First   text {k}<br>goes on.</p><!-- no --><p>Second &lt;{k}&gt; <b>bo</b>ld</p></article>
    <section class="comments"><p>Reader says {k}</p></section><script>var x = "<p>no</p>";</script><footer>Foot</footer></body></html>"""  # noqa: E731
    own = [(k, f"https://a.example/{k}", page(k)) for k in range(9)] + [(90, None, None), (91, "x", ""), (92, "http://[bad", "<p>Alone")]
    got = {r.page_id: (r.text, r.n_chars) for r in wrapper.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()}
    for k in range(9):
        text = f"Head & {k} First text {k} goes on. Second <{k}> bold"
        assert got[k] == (text, len(text))
    assert got[90] == got[91] == ("", 0) and got[92] == ("Alone", 5)


def test_wrapper_odd_pages(spark):
    """Pages that nest without end, tags that nothing closes, and repeated rows."""
    deep = lambda k: "<div>" * 3000 + f"<p>Own {k}</p>" + "</div>" * 3000 + f"<p>Tail {k}</p>"
    each = lambda k: "".join(f"<div>t{j}" for j in range(150)) + f"<b>{k}</b>"
    open_ = lambda k: f"<article><p>Word {k}</p></article>" + "<a " * 40_000
    own = [(k, "http://deep.example/", deep(k)) for k in range(6)] + [(10 + k, "http://each.example/", each(k)) for k in range(6)]
    own += [(20 + k, "http://open.example/", open_(k)) for k in range(6)] + [(30, "http://x.example/", "<p>a < b</p><!-- > no <p>no"), (0, "http://deep.example/", deep(0))]
    own += [(40, "http://y.example/", "<p>kept</p><script>if (a > b) {"), (41, "http://y2.example/", "<p>kept</p><a <!-- no")]
    began = time.time()
    found = wrapper.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(own) and time.time() - began < 60
    assert all(got[k].split() == ["Own", str(k), "Tail", str(k)] for k in range(6))
    assert all(got[10 + k].endswith(f"t149{k}") for k in range(6)) and all(got[20 + k].startswith(f"Word {k}") for k in range(6))
    assert (got[30], got[40]) == ("a < b", "kept") and got[41] == "kept <a"


def _extracted(spark, htmls, host="w.example"):
    own = [(k, f"http://{host}/{k}", x) for k, x in enumerate(htmls)]
    return {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(own, "page_id long, url string, html string").repartition(3)).collect()}


def test_wrapper_judges_bare_siblings(spark):
    notice = '<div class="x7"><p>We value your privacy</p></div>'
    body = lambda k: "".join(f"<p>Text {k} {j}.</p>" for j in range(1 + k % 4)) + "<p>Read more of us</p>" + "<p>Last.</p>" * (k == 3)
    got = _extracted(spark, [f"<body>{notice}<div><h2>Our site</h2><h2>Head {k}</h2>{body(k)}</div></body>" for k in range(12)])
    for k in range(12):
        assert got[k] == " ".join([f"Head {k}", *(f"Text {k} {j}." for j in range(1 + k % 4)), *["Last."] * (k == 3)])


@pytest.mark.parametrize("outer", ['class="layout has-sidebar"', 'class="no-ads"', 'class="side-by-side"', 'id="menu-page"', 'class="content ad"'])
def test_wrapper_keeps_articles_in_named_elements(outer):
    article = "<article><h1>Head</h1><figure><figcaption>Caption</figcaption></figure><p>Let <math><mi>x</mi></math> be <label>it</label>.</p></article>"
    teasers = "<div class='related-posts'><article>Other</article></div><p class='share'>Tell all</p>"
    page = f"<body><div {outer}><div class='ad'>Buy</div>{article}</div></body>"
    assert wrapper.main_text(page, None) == "Head Caption Let x be it."
    assert wrapper.main_text(f"<body><main>{article}{teasers}</main></body>", None) == "Head Caption Let x be it."
    text = "<p>Long text without an article element around it.</p>"
    assert wrapper.main_text(f"<body><div {outer}>{text}</div><div class='site-footer'>Foot</div></body>", None) == text[3:-4]


def test_wrapper_counts_copied_pages_once(spark):
    page = lambda a, k: f"<body><div>Outside {k}</div><article><h1>{a}</h1><div class='t'>Body {a}</div></article></body>"
    copies = [page("x", 0)] * 18 + [page("a", 1), page("b", 2), page("c", 3)]
    got = _extracted(spark, copies)
    assert got == {k: f"{a} Body {a}" for k, a in enumerate(["x"] * 18 + ["a", "b", "c"])}
    note = "<div class='t'>Please log in</div>"
    own = [f"<body><p>Outside {k}</p><article>{note}<p>Text {k}</p></article></body>" for k in range(9)]
    got = _extracted(spark, [*own, f"<body><p>Outside 9</p><article>{note}</article><div class='comments'><article>Reader</article></div></body>"])
    assert got == {k: f"Text {k}" for k in range(9)} | {9: ""}


def test_wrapper_counts_texts_exactly(spark):
    text = lambda k, share, name: name if k * 7 % 100 < share else f"Own {name} {k}"
    page = lambda k: f"<body><div class='x7'><p>{text(k, 81, 'A')}</p></div><div class='x8'><p>{text(k, 79, 'B')}</p></div><div>Text {k}</div></body>"
    got = _extracted(spark, [page(k) for k in range(1000)])
    for k in range(1000):
        assert got[k] == " ".join(x for x in (text(k, 81, "A"), text(k, 79, "B"), f"Text {k}") if x != "A")


def test_simple_tree_matching():
    node = lambda label, *children: [label, 1, {}, list(children)]
    a = [node("p"), node("div", node("p"), node("ul")), node("p")]
    b = [node("div", node("ul")), node("p"), node("div", node("p"), node("ul"))]
    assert wrapper.match(a, b) == [(0, 1), (1, 2)]
    assert wrapper.match(a, a) == [(0, 0), (1, 1), (2, 2)]


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, d).toPandas()
    both = spark.read.parquet(f"{d}/labels.parquet").toPandas().merge(got, on="doc_id")
    own = both[both["held_out"]].dropna(subset=["quality"])
    ranks, y = own["score"].rank(), own["quality"] == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.8 and got["score"].between(0, 1).all()


def test_classifier_features_against_plain_python():
    """Contexts, features and probabilities by loops over words."""
    qc = quality_classifier
    texts = ["one two Three two", None, "", "a a a a b1", "x", " ".join(TEXTS[3].split()[:60]), "one two Three two"]
    index = qc.index_vectors()
    slot = lambda w, k: xxhash.xxh3_64_intdigest(w, k) % qc.SLOTS
    want, vectors = np.zeros((qc.SLOTS, qc.DIMS)), np.random.default_rng(1).normal(size=(qc.SLOTS, qc.DIMS)).astype(np.float32)
    rows = []
    for t in texts:
        own = (t or "").encode().split()
        pairs = [(slot(w, 0), slot(qc.shapes([w])[0], 1)) for w in own]
        for i, (one, two) in enumerate(pairs):
            for j in range(max(0, i - qc.REACH), min(len(pairs), i + qc.REACH + 1)):
                if i != j:
                    for x in (one, two):
                        want[x] += index[pairs[j][0]] + index[pairs[j][1]]
        row = np.zeros(4 * qc.DIMS + 4)
        if pairs:
            for k in (0, 1):
                v = np.array([vectors[p[k]] for p in pairs], np.float64)
                row[2 * k * qc.DIMS : (2 * k + 2) * qc.DIMS] = np.r_[v.mean(0), v.std(0)]
            ones = [p[0] for p in pairs]
            row[-4:] = sum(a == b for a, b in zip(ones, ones[1:], strict=False)) / len(ones), 1 - len(set(ones)) / len(ones), math.log1p(len(ones)), 0
        else:
            row[-1] = 1  # all others are 0
        rows.append(row)
    assert np.allclose(qc._contexts(texts, index), want)
    got = qc.features(texts, vectors)
    assert np.allclose(got, rows, atol=1e-2)  # spreads are of squares of 32-bit numbers
    rng = np.random.default_rng(2)
    d = got.shape[1]
    net = qc.Network(rng.normal(size=d), rng.uniform(1, 2, d), rng.normal(size=(d, 3)), rng.normal(size=3), rng.normal(size=3), 0.3, 1.7)
    for x, p in zip(got, net.probability(got), strict=True):
        hidden = [math.tanh(sum((x[i] - net.shift[i]) / net.scale[i] * net.w1[i, h] for i in range(d)) + net.b1[h]) for h in range(3)]
        assert math.isclose(p, 1 / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, net.w2, strict=True)) + 0.3) / 1.7)), rel_tol=1e-6)


def test_extra_columns_of_any_name(spark):
    """Helper columns step aside for columns of the same names, which come back as they were."""
    names = [
        "row_key", "_items", "_gone", "_id", "_row", "_m", "Measured", "lines_row", "lines_at", "LINES_GONE", "lines_all", "lines_stay", "lines_of",
        "leak_row", "leak_found", "leak_items", "dropped_id", "comp", "node", "line_hash",
    ]
    own = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate([*TEXTS[:6], *TEXTS[40:60], None])]
    docs = spark.createDataFrame(own, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    bench = spark.createDataFrame([(1, " ".join(TEXTS[2].split()[:30]))], "item_id long, text string")
    plain = docs.select("doc_id", "text")
    made = {
        "leaks": lambda d: decontam.mark_leaks(d, bench), "lines": lambda d: line_dedup.drop_common_lines(d, min_docs=3),
        "near": near_dedup.keep_one, "rules": quality_rules.ledger,
    }
    for name, f in made.items():
        got, want = f(docs), f(plain)
        assert set(names) <= set(got.columns), name
        assert rows(got.select(want.columns).toPandas()) == rows(want.toPandas()), name
        assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names), name


def test_repeated_and_long_rows(spark):
    """Repeated rows and ids, null ids, and a text of 40,000 words with a passage twice, through the operators that score or rebuild rows."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(50)]
    long = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    long[100:150] = long[30_000:30_050] = passage
    own = [(1, " ".join(long), "s"), (2, "one two three", "s"), (2, "one two three", "s"), (2, "other words", None), (None, "one two three", ""), (3, None, ""), (4, "", "s")]
    docs = spark.createDataFrame(own, "doc_id long, text string, source string").repartition(3)
    cut = {(r.doc_id, r.n_words): (r.n_removed, len(r.text.split())) for r in substring_dedup.cut_repeats(docs).collect()}
    assert cut[1, 40_000] == (100, 39_900) and cut[2, 3] == (0, 3) and len(cut) == 6
    scored = ctw.score(docs, F.col("doc_id") != 3).collect()
    assert len(scored) == len(own) and len({r.score for r in scored if r.n_tokens == 4}) == 1 and all(r.score < 0 for r in scored)
    assert {r.doc_id: r.held_out for r in scored} == {1: False, 2: False, None: True, 3: True, 4: False}
    placed = sharding.interleave(docs, shards=4).collect()
    per = Counter(r.shard for r in placed)
    assert len(placed) == len(own) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in placed if r.shard == k) == list(range(n)) for k, n in per.items())
    vectors, network = quality_classifier.train(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (9, None)], "doc_id long, quality int"))
    extra = docs.withColumn("score", F.lit("old")).withColumn("_id", F.lit(7)).withColumn("x", F.lit(8))
    got = quality_classifier.score(extra, vectors, network).collect()
    assert len(got) == len(own) and all(0 <= r.score <= 1 and r["_id"] == 7 and r.x == 8 for r in got)
    assert len({r.score for r in got if r.text == "one two three"}) == 1


def test_components(spark):
    """Chains, stars, loops and repeated edges against a plain search."""
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(500, k) for k in range(501, 560)] + [(700 + k, 699) for k in range(30)] + [(520, 705), (9, 9), (800, 800), (5, 6)]
    edges += [(rng.randrange(900, 1000), rng.randrange(900, 1000)) for _ in range(70)]
    top = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(top)):
        for u, v in edges:
            if u != v:
                top[u] = top[v] = min(top[u], top[v])
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(top) and {r.node: r.component for r in got} == top
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hits_in_parts(spark, monkeypatch):
    """Repetitive texts and items, whose hits are verified in many rows, and ids that hold the separator."""
    item = ["la"] * 30 + ["end"]
    texts = [("1", "2|" + " ".join(item)), ("1|2", " ".join(item)), ("x", " ".join(["la"] * 90)), ("y", "la " * 19), ("z", " ".join(["di", "la"] * 40))]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "la la la la la la")], "item_id long, text string")
    want = {r.doc_id: list(r.leaked_items) for r in decontam.mark_leaks(docs, bench).collect()}
    assert want == {"1": [1, 2], "1|2": [1, 2], "x": [1, 2], "y": [2], "z": []}
    monkeypatch.setattr(decontam, "HITS", 2)
    assert {r.doc_id: list(r.leaked_items) for r in decontam.mark_leaks(docs, bench).collect()} == want


def test_network_without_two_classes():
    assert 0 < quality_classifier.fit(np.zeros((20, 3)), np.ones(20)).probability(np.zeros((1, 3)))[0] < 1


def test_empty_tables(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert substring_dedup.cut_repeats(empty).count() == 0
    assert line_dedup.drop_common_lines(empty).count() == 0
    assert sharding.interleave(empty).count() == 0
    assert quality_rules.ledger(empty).count() == 0
    assert ctw.score(empty, F.lit(True)).count() == 0
    assert decontam.mark_leaks(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    vectors, network = quality_classifier.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_classifier.score(empty, vectors, network).count() == 0


def test_kept_hash_is_of_utf8(spark):
    r = queries.op9_line_dedup(spark, SMALL).filter("n_dropped = 0").limit(1).collect()[0]
    text = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
