from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import packing as P

ODD = ["a\x1cb c", "<|endoftext|> x", "<|ENDOFTEXT|>Hello", "don't they're I'M", "É é İstanbul ΣΑΣ éa", "A\xa0B　C d", "x1y2 10,000!!! ...", "ﬁne ǅ ß ẞ", "日本語 テスト。", "a😀b", "  ", "", "foo_bar-baz(qux)", "\x85 a\x0bb", "ÀB.C d.e,f"]


def corpus(n=400):
    r = random.Random(1)
    rows = []
    for i in range(n):
        words = ["".join(r.choice(["ba", "Ti", "re", "on", "é"]) for _ in range(r.randint(1, 4))) + r.choice(["", ",", ".", "'s"]) for _ in range(r.randint(0, 90) if i else 9000)]
        rows.append((i, " ".join(words), r.choice("aaaaab") if i % 9 else None))
    return rows + [(n + i, t, "odd") for i, t in enumerate(ODD)] + [(n, None, "odd"), (None, "null id", "b")]


def test_tokenizer_is_exact(monkeypatch):
    monkeypatch.setattr(P, "WORDS_KEPT", 300)
    monkeypatch.setattr(P, "CORES_KEPT", 50)
    own = P.Tokenizer(P.default_tokenizer())
    texts = [t or "" for _, t, _ in corpus()]
    for size in (7, 60, 1000):
        got = [np.frombuffer(b, own.kind).tolist() for i in range(0, len(texts), size) for b in own.encode(pa.array(texts[i : i + size]))]
        assert got == [e.ids for e in own.own.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, None: 0.2}])
def test_round_trip(spark, targets):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = P.pack(docs, targets, length=256, window_sequences=2, with_ids=True).cache()
    got = pieces.collect()
    reader = P.Tokenizer(P.default_tokenizer()).own
    want = Counter(tuple(reader.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows)
    by = defaultdict(list)
    for p in got:
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert p["length"] == len(ids) and zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        by[p["doc_id"], p["doc_tokens"], p["queue"]].append((p["start"], ids.tolist()))
    unique = {k: sorted(v) for k, v in by.items() if len([r for r in rows if r[0] == k[0]]) == 1}
    for (doc, n, _), parts in unique.items():
        whole = [x for _, ids in parts for x in ids]
        assert len(whole) == n and [s for s, _ in parts] == [0, *np.cumsum([len(i) for _, i in parts])[:-1]]
        assert want[tuple(whole)]
    assert sum(p["length"] for p in got) == sum(len(k) * v for k, v in want.items())
    places = defaultdict(list)
    for p in got:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    total = sum(p["length"] for p in got)
    assert sorted(places) == list(range(-(-total // 256)))
    for s, parts in places.items():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) == (256 if s < len(places) - 1 else total - 256 * (len(places) - 1))
    whole = P.assemble(pieces)
    assert all(len(r["ids"]) == 1024 for r in whole.filter("sequence_id = 0").collect())


def test_windows_have_the_target_mix(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(3)
    got = P.pack(docs, length=128, window_sequences=4).groupBy((P.F.col("sequence_id") / 4).cast("int").alias("w"), "queue").agg(P.F.sum("length").alias("n")).collect()
    total = Counter()
    for r in got:
        total[r["queue"]] += r["n"]
    every = sum(total.values())
    last = max(r["w"] for r in got)
    for r in got:
        if r["w"] < last:
            assert abs(r["n"] - 512 * total[r["queue"]] / every) < 2 + len(total)


def test_targets_of_more_sources_than_64(spark):
    names = [f"s{i:02}" for i in range(79)] + ["z"]
    docs = spark.createDataFrame([(100 * i + j, "the ab " * (20 if s == "z" else 30), s) for i, s in enumerate(names) for j in range(3 if s == "z" else 4)], "doc_id long, text string, source string")
    got = P.pack(docs, {s: 1.0 for s in names} | {"z": 79.0}, length=64, window_sequences=2).collect()
    assert len({r["queue"] for r in got}) == 80
    mine = [r for r in got if r["doc_id"] // 100 == 79]
    assert sum(r["length"] for r in mine if r["sequence_id"] < 2) > 50 and len({r["queue"] for r in mine}) == 1


def test_places_cover_every_token():
    r = random.Random(3)
    for _ in range(60):
        totals = [r.randint(0, 700) for _ in range(r.randint(1, 6))]
        targets = None if r.random() < 0.4 else [r.choice([0, 0.1, 1, 5]) for _ in totals]
        plan = P.Plan(P.stretches(totals, targets), 16, 48)
        seen = []
        for q, n in enumerate(totals):
            at = 0
            while at < n:
                size = min(r.randint(1, 90), n - at)
                run = list(plan.places(q, at, size))
                assert [x for x, _, _ in run] == [0, *np.cumsum([s for _, s, _ in run])[:-1]] and sum(s for _, s, _ in run) == size
                seen += [p + i for _, s, p in run for i in range(s)]
                at += size
        assert sorted(seen) == list(range(sum(totals)))
