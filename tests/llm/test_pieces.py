"""Encoding by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import pieces as P

PARTS = [" ", "  ", "   ", "▁", "▁▁", "\n", "\t", "\0", "a", "b", "the", "Ä", "日本語", "😀", "é", "<s>", "</s>", "<unk>", "<0x0A>", " ", "　", "ing", "1", ".", ",", "�", "\x1c", "﻿", "x" * 70]


@pytest.fixture(scope="module")
def own():
    return P.Pieces(P.default_model())


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]


def same(own, texts):
    ids = own.encode(pa.array(texts, pa.string()))
    want = [own.own.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert [i.tolist() for i in ids] == want
    assert own.decode(ids) == [own.own.decode(w) for w in want]


def test_random_texts(own):
    assert own.by_chunk
    for i in range(5):
        same(own, random_texts(3000, i))


def test_odd_texts(own):
    same(own, ["", None, " ", "  ", "▁", " ▁ ", "a", "\n", "word " * 50_000, "日本語" * 20_000, " " * 5000, "a" + " " * 5000 + "b"])
    same(own, [])
    same(own, [None])


def test_table_is_begun_anew():
    own = P.Pieces(P.default_model(), table_bytes=2000)
    most = 0
    for i in range(30):
        same(own, [f"word{i * 40 + k} and {k}" for k in range(40)])
        most = max(most, len(own.table))
    assert most < 200


def test_long_chunks_are_not_kept(own):
    before = len(own.table)
    same(own, ["y" * 500 + str(k) for k in range(20)])
    assert len(own.table) == before and len(own.pool) == int(own.sizes.sum())


def test_slices_of_arrays(own):
    texts = pa.array(random_texts(500, 9))
    got = own.encode(texts.slice(100, 50))
    assert [g.tolist() for g in got] == [own.own.encode(t, add_bos=True, add_eos=True) for t in texts.slice(100, 50).to_pylist()]


def test_models_without_chunks_get_whole_texts():
    own = P.Pieces(P.default_model())
    own.by_chunk = False
    same(own, random_texts(300, 5) + [None, ""])


def test_frames(spark, own):
    rows = list(enumerate(random_texts(200, 7))) + [(None, "a b"), (1, None), (1, None), (999, "z " * 100_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    ids = [own.own.encode(t or "", add_bos=True, add_eos=True) for _, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, len(i), sha(np.array(i, "<u4").tobytes()), sha(own.own.decode(i).encode())) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(map(tuple, P.digests(docs).collect())) == want
    coded = P.encoded(docs)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == Counter((d, tuple(i)) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(map(tuple, P.decoded(coded).collect())) == Counter((d, own.own.decode(i)) for (d, _), i in zip(rows, ids, strict=True))


def test_any_ids_decode(spark, own):
    rows = [(1, [5, 6, None, 300]), (2, None), (3, []), (4, [1, 28705, 28705, 2, 264])]
    got = {r["doc_id"]: r["decoded"] for r in P.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {d: own.own.decode([i for i in ids or [] if i is not None]) for d, ids in rows}
