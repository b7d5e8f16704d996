"""Segmentation by dictionary against searching all paths."""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import segment as S
from corpuscle.functions import text as T
from corpuscle.operators import bm25

COUNTS = {"中国": 50, "中国人": 10, "国人": 20, "人民": 60, "民": 5, "安全": 80, "安全生产": 40, "生产": 70, "生产法": 6, "法": 30, "产": 1, "全生": 2, "化学": 9, "危险化学品": 12, "危险": 33, "品": 8, "管理": 44, "管": 3, "理": 3, "𠀀字": 4, "a": 99}


def table(counts):
    total = sum(counts.values())
    cost = lambda n: round(1e6 * math.log(total / n))
    return {w: cost(n) for w, n in counts.items()}, cost(1)


def every_path(run, costs, unknown):
    """The least (cost, lengths from the left, longest first) of all divisions."""

    @functools.lru_cache(None)
    def best(i):
        if i == len(run):
            return 0, ()
        found = []
        for n in range(1, len(run) - i + 1):
            c = costs.get(run[i : i + n], unknown if n == 1 else None)
            if c is not None:
                rest = best(i + n)
                found.append((c + rest[0], (-n, *rest[1])))
        return min(found)

    lengths, out, at = [-n for n in best(0)[1]], [], 0
    for n in lengths:
        out.append(run[at : at + n])
        at += n
    return out


def brute(text, costs, unknown, letters=r"[一-鿿㐀-䶿𠀀-𪛟]"):
    out = []
    for run in re.findall(rf"{letters}+|(?:(?!{letters})[^\W_])+", text or ""):
        out += every_path(run, costs, unknown) if re.match(letters, run) else [run]
    return out


def of(counts):
    costs, unknown = table(counts)
    return S.Trie(list(costs), list(costs.values()), unknown), costs, unknown


def test_random_texts():
    trie, costs, unknown = of(COUNTS)
    rnd = random.Random(1)
    parts = [*COUNTS, *"人国民中安全生产法危险未知的", "，", "。", " ", "\n", "abc", "GB2014", "é", "_", "𠀀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12))) for _ in range(3000)] + [None, "", "  "]
    assert S.cut(pa.array(texts, pa.string()), trie).to_pylist() == [brute(t, costs, unknown) for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_random_dictionaries(seed):
    """Few letters and small counts: paths tie, words overlap everywhere."""
    rnd = random.Random(seed)
    counts = {"".join(rnd.choice("甲乙丙") for _ in range(rnd.randrange(1, 6))): rnd.randrange(1, 5) for _ in range(40)}
    trie, costs, unknown = of(counts)
    texts = ["".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randrange(0, 25))) for _ in range(500)]
    assert S.cut(pa.array(texts), trie).to_pylist() == [brute(t, costs, unknown) for t in texts]


def test_ties_take_the_longer_word_first():
    trie, *_ = of({"甲": 2, "乙": 2, "丙": 2, "甲乙": 2, "乙丙": 2})
    assert S.cut(pa.array(["甲乙丙"]), trie).to_pylist() == [["甲乙", "丙"]]


def test_signs_and_slices():
    trie, *_ = of(COUNTS)
    texts = pa.array(["x", "安全生产法，第1条。 ok?", "人民"])
    assert S.cut(texts.slice(1, 1), trie, signs=True).to_pylist() == [["安全生产", "法", "，", "第", "1", "条", "。", "ok", "?"]]
    assert S.cut(pa.array([], pa.string()), trie).to_pylist() == []


def test_long_runs_and_many_texts(monkeypatch):
    trie, costs, unknown = of(COUNTS)
    monkeypatch.setattr(S, "LETTERS_AT_ONCE", 1000)
    texts = ["安全生产管理" * 5000, *["中国人民"] * 700, ""]
    got = S.cut(pa.array(texts), trie).to_pylist()
    assert got == [["安全生产", "管理"] * 5000, *[brute("中国人民", costs, unknown)] * 700, []]


def test_empty_dictionary():
    assert S.cut(pa.array(["甲乙 ab"]), S.Trie([], [], 0)).to_pylist() == [["甲", "乙", "ab"]]


def test_dictionary_from_a_table(spark):
    rows = [*COUNTS.items(), ("安全", 0), (None, 3), ("", 4), ("民", 1)]
    trie = S.trie(spark.createDataFrame(rows, "word string, count long"))
    costs, unknown = table(Counter(COUNTS) + Counter({"民": 1}))
    assert trie.unknown == unknown
    texts = ["中国人民安全生产法", "危险化学品管理"]
    assert S.cut(pa.array(texts), trie).to_pylist() == [brute(t, costs, unknown) for t in texts]
    with pytest.raises(ValueError, match="more than 3 words"):
        S.trie(spark.createDataFrame(rows, "word string, count long"), most=3)


def test_given_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("安全 80 n\n生产 70\n法\n\n  管理   44 vn \nxy z\n", "utf-8")
    assert {tuple(r) for r in S.given(spark, f"file://{tmp_path}/words.txt").collect()} == {("安全", 80), ("生产", 70), ("法", None), ("管理", 44), ("xy", None)}


def plain_discovery(texts, longest, least, cohesion, freedom):
    counts, before, after = Counter(), {}, {}
    for t in texts:
        for run in re.findall("[一-鿿]+", t or ""):
            for i in range(len(run)):
                for n in range(1, min(longest, len(run) - i) + 1):
                    w = run[i : i + n]
                    counts[w] += 1
                    before.setdefault(w, set()).add(run[i - 1] if i else "")
                    after.setdefault(w, set()).add(run[i + n : i + n + 1])
    total = sum(n for w, n in counts.items() if len(w) == 1)
    bond = lambda w: min(math.log(counts[w] * total / (counts[w[:k]] * counts[w[k:]])) for k in range(1, len(w)))
    return {w: n for w, n in counts.items() if len(w) == 1 or (n >= least and len(before[w]) >= freedom and len(after[w]) >= freedom and bond(w) >= cohesion)}


def test_discovered_words(spark):
    rnd = random.Random(3)
    words = ["安全", "生产", "化学品", "管理", "人", "的", "不"]
    texts = ["".join(rnd.choice(words) + ("，" if rnd.random() < 0.1 else "") for _ in range(30)) for _ in range(60)] + [None, "", "abc"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["word"]: r["count"] for r in S.discovered(docs, least=20, cohesion=1.2).collect()}
    assert got == plain_discovery(texts, 4, 20, 1.2, 2)
    assert {"安全", "生产", "化学品", "管理"} <= set(got) and "全生" not in got
    cut = S.cut(pa.array(["安全管理的化学品生产"]), S.trie(S.discovered(docs, least=20, cohesion=1.2))).to_pylist()
    assert cut == [["安全", "管理", "的", "化学品", "生产"]]


def test_ranking_by_segmented_words(spark):
    """BM25 over segmented Chinese texts, against a plain implementation on words of the path search."""
    costs, unknown = table(COUNTS)
    texts = ["安全生产法管理危险化学品", "中国人民管理生产", "危险化学品安全管理", "人民的安全", "国人生产民品", None, "安全生产安全生产"]
    asked = ["危险化学品安全", "中国人民", "生产管理"]
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, corpus_pos long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    tokenizer = S.segmenter(S.trie(spark.createDataFrame(list(COUNTS.items()), "word string, count long")), spark)
    words = [brute(t, costs, unknown) for t in texts]
    mean, df = sum(map(len, words)) / len(words), Counter(w for d in words for w in set(d))
    raw = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = set()
    for q, text in enumerate(asked):
        score = []
        for d, own in enumerate(words):
            tf = Counter(own)
            score.append((-round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in brute(text, costs, unknown)), 5), d))
        want |= {(q, d, rank, -s) for rank, (s, d) in enumerate(sorted(score)[:4], 1)}
    assert {(r["query_id"], r["id"], r["rank"], r["score"]) for r in bm25.rank_batch(queries, corpus, 4, tokenizer=tokenizer).collect()} == want


def test_squeezed_documents_of_the_driver(spark, small):
    """Whole texts without their blanks, segmented by the corpus's words: on a part of them equal to the path search."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = {r["word"]: r["count"] for r in S.learnt(docs, T.words).collect()}
    trie, costs, unknown = of(counts)
    texts = [(t or "").lower().replace(" ", "")[:1500] for (t,) in docs.select("text").limit(40).collect()]
    got = S.cut(pa.array(texts), trie, letters=r"\p{L}").to_pylist()
    for t, words in zip(texts, got, strict=True):
        import regex

        want = []
        for run in regex.findall(r"\p{L}+|\p{N}+", t):
            want += dp(run, costs, unknown) if regex.match(r"\p{L}", run) else [run]
        assert words == want


def dp(run, costs, unknown):
    best = [(0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        options = [(costs.get(run[i : i + n], unknown if n == 1 else None), n) for n in range(1, min(63, len(run) - i) + 1)]
        best[i] = min((c + best[i + n][0], -n) for c, n in options if c is not None)
    out, i = [], 0
    while i < len(run):
        out.append(run[i : i - best[i][1]])
        i -= best[i][1]
    return out


def test_children_by_hash():
    words = [a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    t = S.Trie(words, [1] * len(words), 9)
    keys = t.keys[t.keys >= 0]
    assert len(keys) == 8 + 64 + 512 and len(set(t._children(keys).tolist())) == len(keys)
    assert not t._children(keys + (1 << 40)).any()


def test_words_of_a_run_beyond_16_bits():
    t = S.Trie(["ab", "aba"], [1, 1], 9)
    letters = np.frombuffer(("ab" * 40_000).encode("utf-32-le"), np.uint32).astype(np.int64)
    begins = t.words(letters, np.arange(80_000, 0, -1))
    assert np.flatnonzero(begins).tolist() == list(range(0, 80_000, 2))


def test_ranking_by_words_cut_before(spark):
    corpus = spark.createDataFrame([(1, 1, "a b"), (2, 2, "b c"), (3, 3, "d")], "id long, corpus_pos long, text string")
    queries = spark.createDataFrame([(1, "b d"), (2, "c")], "query_id long, text string")
    cut = corpus.select("id", "corpus_pos", T.words(F.col("text")).alias("tokens"))
    assert sorted(map(tuple, bm25.rank_batch(queries, cut, 2).collect())) == sorted(map(tuple, bm25.rank_batch(queries, corpus, 2).collect()))


def test_stored_slices_equal_one_trie(spark, monkeypatch):
    """A dictionary in many small slices, some of them empty, and parts of a few letters; the last text is one run."""
    rnd = random.Random(7)
    counts = Counter("".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randrange(1, 7))) for _ in range(400))
    trie, costs, unknown = of(counts)
    made = S.stored(spark.createDataFrame(list(counts.items()), "word string, count long"), words=20)
    assert made.count > 10 and made.unknown == unknown
    texts = ["".join(rnd.choice("甲乙丙丁戊 a") for _ in range(rnd.randrange(0, 40))) for _ in range(300)] + ["", None, "甲乙丙丁" * 200]
    monkeypatch.setattr(S, "LETTERS_AT_ONCE", 100)
    got = S.cut(pa.array(texts), made).to_pylist()
    assert got == S.cut(pa.array(texts), trie).to_pylist() == [brute(t, costs, unknown) for t in texts]
    assert S.cut(pa.array(["甲乙 ab"]), S.stored(spark.createDataFrame([], "word string, count long"))).to_pylist() == [["甲", "乙", "ab"]]


def test_every_word_of_the_documents_is_in_the_dictionary(spark, tmp_path, monkeypatch):
    """segmented_words with more words than the most frequent ones that segmented_queries takes."""
    from corpuscle.plans import search

    monkeypatch.setattr(search, "WORDS", 2)
    texts = ["abc def abc def abc def", "ghi jkl"]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["id"]: r["n"] for r in search.segmented_words(spark, f"file://{tmp_path}").collect()}
    assert got == {0: 6, 1: 2}
