from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import substring as S


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    kept = [" ".join(x for i, x in enumerate(w) if i not in g) for w, g in zip(words, gone, strict=True)]
    return [(len(w), len(g), hashlib.sha256(k.encode()).hexdigest()) for w, g, k in zip(words, gone, kept, strict=True)], kept


def corpus(seed, vocabulary=40):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "é", "日本", "x,", "😀"]) if r.random() < 0.1 else f"w{r.randrange(vocabulary)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(r.randint(5, 80)) for _ in range(6)]
    docs = []
    for _ in range(40):
        w = text(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        docs.append("".join(x + r.choice([" ", "  ", "\n", "\t\r"]) for x in w))
    docs += ["a " * 100, "b " * 34, "b " * 35, docs[0], docs[0], None, "", "   ", " ".join(["q"] * 36)]
    return docs


def test_against_brute_force(spark):
    for seed, window in ((1, 35), (2, 8), (3, 7), (4, 2)):
        texts = corpus(seed, 40 if window > 4 else 400)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.removal_digests(docs, window).collect()}
        want, _ = brute(texts, window)
        assert got == dict(enumerate(want))


def test_small_slices_and_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 300)
    monkeypatch.setattr(S, "GROUPS", (3, 1000, 1000))
    monkeypatch.setattr(S, "PARTS", (2, 100, 100))
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.removal_digests(docs, 9).collect()}
    assert got == dict(enumerate(brute(texts, 9)[0]))


def test_removed_texts(spark):
    texts = corpus(6)
    docs = spark.createDataFrame([(i, t, "s", None if t is None else len(t), 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int, tid int, repeats int")
    out = S.removed(docs, 35)
    assert out.columns == docs.columns
    want, kept = brute(texts, 35)
    for r in out.collect():
        i = r["doc_id"]
        assert r["text"] == (kept[i] if want[i][1] else texts[i])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert (r["tid"], r["repeats"], r["source"]) == (1, 2, "s")


def unlike(n, words=60):
    return [" ".join(f"d{i}w{k}" for k in range(words)) for i in range(n)]


@pytest.mark.parametrize(
    "texts",
    [unlike(2, 40), unlike(50), unlike(1), ["short text"], [None], ["", " "], unlike(20) + [unlike(1)[0]], [*unlike(2), "x " + unlike(1)[0] + " y"], unlike(8, 34) * 3],
)
def test_corpora_with_few_or_no_repeats(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.removal_digests(docs).collect()}
    want, kept = brute(texts, 35)
    assert got == dict(enumerate(want))
    assert {r["doc_id"]: r["text"] for r in S.removed(docs).collect()} == {i: k if want[i][1] else texts[i] for i, k in enumerate(kept)}


def test_a_passage_in_all_documents_is_sent_once_a_group(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    most = {}
    for n in (1000, 8000):
        docs = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(n)], "doc_id long, text string")
        own, parts = S.dealt(docs)
        probes = own.groupBy("_g").applyInArrow(S._probes(35, parts), S.PROBES)
        seen = Counter(k for r in probes.collect() for k in np.frombuffer(r["keys"], np.uint32).tolist())
        most[n] = max(seen.values())
        assert {r["n_removed"] for r in S.removal_digests(docs).collect()} == {40}
    assert most[1000] == most[8000] == S.GROUPS[0]


def test_collisions_of_the_rolling_hash_change_nothing(spark, monkeypatch):
    real = S._key
    monkeypatch.setattr(S, "_key", lambda h, parts: real(h & np.uint64(0x700000007), parts))
    texts = corpus(9)
    own, parts = S.dealt(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    group = pa.table({"text": pa.array(texts), "_row": pa.array(range(len(texts)))})
    probes = S._probes(9, parts)([pa.scalar(0)], group).to_pylist()
    hits = pa.concat_tables([S._hits(S._batch([tuple(p.values())], S.PROBES)) for p in probes])
    found = S._extended(9, parts)([pa.scalar(0)], group, hits).to_pylist()
    again = pa.concat_tables([S._repeated(S._batch([tuple(r.values())], S.DIGESTS)) for r in found])
    told = pa.concat_tables([hits, again], promote_options="default")
    gone = [int(x) for *_, words, covered, _, _ in S._edits(S._column(S._in_order(group), "text"), told, 9, parts) for x in np.bincount(words.doc[covered], minlength=words.docs)]
    assert gone == [n for _, n, _ in brute(texts, 9)[0]]
