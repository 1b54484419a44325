"""All stages of the pipeline over a small folder of tables against plain Python."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from hapdiff.llm import near_dedup, quality_rules, sentencepiece_codec


def _words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in (text or "").split()]


def _documents():
    rng = random.Random(8)
    some = "the and of to that with have be is in stone river lamp grass old winter seven house water small".split()
    line = lambda n: " ".join(rng.choice(some) + (str(rng.randrange(99)) if rng.random() < 0.4 else "") for _ in range(n))
    text = lambda: "\n".join(line(rng.randrange(12, 25)) + "." for _ in range(6))
    item = line(40)
    out = [text() for _ in range(12)]
    out += [f"{text()}\nThis line is shared by many pages of the site." for _ in range(11)]
    near = out[0].split()
    near[50] = "changed"
    out += [out[0], out[0], out[13], " ".join(near)]
    out += [f"{text()}\n{item}\n{text()}", f"{text()}\n{item.upper()}", None, "", None, "short", "# $ % & " * 30]
    return out, item


def _in_words(words, item):
    n = min(25, len(item))
    for d in range(-len(item), len(words)):
        same = [0 <= d + j < len(words) and words[d + j] == w for j, w in enumerate(item)]
        if any(5 * sum(same[k : k + n]) >= 4 * n for k in range(len(item) - n + 1)):
            return True
    return False


def test_pipeline(spark, tmp_path):
    texts, item = _documents()
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    judged = quality_rules.judge(quality_rules.ledger(docs), corpus_pipeline.POLICY).filter("kept").collect()
    left = {r.doc_id: r.text for r in judged}  # the rules have their own brute force in test_operators
    assert {k for k, t in enumerate(texts) if len(_words(t)) < 2 or t.startswith("#")}.isdisjoint(left) and len(left) > 20

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for k, t in left.items():
        for x in t.split("\n"):
            held[key(x)].add(k)
    lined = {k: "\n".join(x for x in t.split("\n") if not key(x) or len(held[key(x)]) < 10) for k, t in left.items()}
    assert any(lined[k] != left[k] for k in left)

    sets = {k: near_dedup.shingle_set(t, 5) for k, t in lined.items()}
    top = {k: k for k in lined}
    for a in sorted(lined):
        for b in sorted(lined):
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {k: low if v == high else v for k, v in top.items()}
    alone = {k: t for k, t in lined.items() if top[k] == k}
    assert len(alone) < len(lined)
    want = {k: t for k, t in alone.items() if not _in_words(_words(t), _words(item))}
    assert len(want) == len(alone) - 2

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(sentencepiece_codec.read_model(spark, corpus_pipeline.VOCABULARY)))
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: (r.text, r.n_chars, list(r.ids), r.n_ids) for r in got} == {
        k: (t, len(t), list(codec.encode(t)), len(codec.encode(t))) for k, t in want.items()
    }
