"""Substring deduplication with fixed-block anchors.

A window is `window` consecutive words of one document; it is repeated if its words also start anywhere else.
1. Index: every document's non-overlapping blocks of `block` words, block = (window + 1) // 2, so that each window holds a
   whole block wherever it starts.  Probe: the rolling hashes of all its windows of `block` words.  A block whose hash is
   met at another place is a hit.
2. Extension: a hit is extended to the windows that hold it; no other window can be repeated.  Their digests (BLAKE2b of
   the window's words, 128 bits) are counted, and those met twice or more are repeated; neighbouring ones merge to maximal
   exact repeats.  Every place is compared with one digest, never with all its copies.
3. The words that repeated windows cover are removed from all copies.

Hash values of step 1 only choose what step 2 looks at; equal words have equal hashes, so nothing is lost by them.

Documents are dealt into groups of some megabytes by a hash of doc_id and text, so copies of one text under different ids are
spread; rows that are equal in both share a group, however many there are.  A group sends each hash or digest once to the part of the hash space it falls in, however often it holds it, with the mark "twice or more"; a part answers
each group with those that are repeated.  So a passage in all documents costs a part one entry a group, and never one a document.
The numbers of groups and of parts both follow the corpus.

Defined results: null and empty texts have no words; a text shorter than a window keeps all its words; very long texts are
worked on whole; ties, repeated rows and null doc_ids are documents like others; an empty table, or one without any
repeat, loses no word; other columns are kept by `removed`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import Words, aside, slices, trim

WINDOW = 35
GROUPS = (16, 4 << 20, 64 << 20)  # least number; least and most bytes a group: 6.4 times the root of the corpus between them
PARTS = (8, 1 << 21, 1 << 24)  # least number; least and most windows a part
SLICE_BYTES = 1 << 18  # worked on at a time
_LOW = np.uint64(0xFFFFFFFF)


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with `_row` (a hash of the row) and its group `_g`, and the number of parts: by the bytes of all texts, six to a word."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    grown = 6.4 * total**0.5
    group = int(min(max(GROUPS[1], grown), GROUPS[2]))
    part = int(min(max(PARTS[1], grown / 6), PARTS[2]))
    row = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    out = docs.withColumn("_row", row).withColumn("_g", F.pmod("_row", F.lit(max(GROUPS[0], -(-total // group)))))
    return out, max(PARTS[0], -(-total // (6 * part)))


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in a sorted array, and its length at the end; empty for an empty one."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


# ---------------------------------------------------------------------------- 1. hits

PROBES = "part int, g long, keys binary, flags binary"
HITS = "g long, part int, keys binary"


def _key(h: np.ndarray, parts: int) -> np.ndarray:
    """The part above 32 bits, a hash of 32 bits below."""
    return ((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (h & _LOW)


def _anchors(words: Words, window: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all windows of a block's length in texts of a window or more, whether each is an aligned block, and its first word."""
    block = (window + 1) // 2
    at, h = words.windows(block)
    doc = words.doc[at]
    long = words.count[doc] >= window
    at, h, doc = at[long], h[long], doc[long]
    return _key(h, parts), (at - words.first[doc]) % block == 0, at


def _probes(window: int, parts: int):
    """A group's distinct keys by part; flags: there twice or more, a block of the index."""

    def run(key, table):
        found = []
        for i, j in slices(texts := _column(table, "text"), SLICE_BYTES):
            k, aligned, _ = _anchors(Words(texts.slice(i, j - i)), window, parts)
            found.append((k, aligned))
        if not sum(len(k) for k, _ in found):
            return _batch([], PROBES)
        keys, aligned = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, aligned = keys[order], aligned[order]
        cut = _cuts(keys)
        flags = np.stack([np.diff(cut) > 1, np.maximum.reduceat(aligned, cut[:-1])], 1)
        keys = keys[cut[:-1]]
        part, low = (keys >> np.uint64(32)).astype(np.int32), (keys & _LOW).astype(np.uint32)
        ends = _cuts(part)
        trim()
        return _batch([(int(part[a]), key[0].as_py(), low[a:b].tobytes(), np.packbits(flags[a:b]).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], PROBES)

    return run


def _hits(table: pa.Table) -> pa.Table:
    """For each group of a part, its blocks that are met at another place."""
    part, groups = table.column("part")[0].as_py(), table.column("g").to_pylist()
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    flags = np.concatenate([_unpacked(x, 2 * len(k)) for x, k in zip(table.column("flags").to_pylist(), keys, strict=True)]).reshape(-1, 2)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    cut = _cuts(every[order])
    many = (np.diff(cut) > 1) | np.maximum.reduceat(flags[order, 0], cut[:-1])
    hit = np.empty(len(every), bool)
    hit[order] = np.repeat(many, np.diff(cut))
    hit &= flags[:, 1]
    ends = np.cumsum([0, *map(len, keys)])
    out = [(g, part, every[a:b][hit[a:b]].tobytes()) for g, a, b in zip(groups, ends[:-1], ends[1:], strict=True) if hit[a:b].any()]
    return _batch(out, HITS)


# ---------------------------------------------------------------------------- 2. extension

DIGESTS = "part int, g long, digests binary, many binary, nth binary"
REPEATS = "g long, nth binary"


def _in_order(table: pa.Table) -> pa.Table:
    """A group's rows in an order that does not depend on how they came; rows with one hash are equal."""
    return table.take(pa.array(np.argsort(_column(table, "_row").to_numpy(zero_copy_only=False), kind="stable")))


def _spaced(words: Words) -> tuple[bytes, np.ndarray]:
    """All words of a slice, each with one blank after it, and where each starts."""
    out, _ = _kept(words, np.zeros(len(words.start), bool))
    return out.tobytes(), np.concatenate([[0], np.cumsum(words.end - words.start + 1)])


def _candidates(texts: pa.Array, hits: pa.Table, window: int, parts: int):
    """Of a group's windows that hold a hit: their distinct digests in order, whether each is there twice or more; and the number of the digest and the place of every window."""
    block = (window + 1) // 2
    keys_of = [np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(p << 32) for p, k in zip(hits.column("part").to_pylist(), hits.column("keys").to_pylist(), strict=True)]
    known = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys_of]))
    base, digests, places = 0, [], [np.zeros(0, np.int64)]
    for i, j in slices(texts, SLICE_BYTES) if len(known) else ():
        words = Words(texts.slice(i, j - i))
        keys, aligned, at = _anchors(words, window, parts)
        keys, at = keys[aligned], at[aligned]
        at = at[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]
        marked = np.zeros(len(words.start) + 1, np.int64)
        doc = words.doc[at]
        lo = np.maximum(at + block - window, words.first[doc])
        hi = np.minimum(at, words.first[doc] + words.count[doc] - window) + 1
        np.add.at(marked, lo[lo < hi], 1)
        np.add.at(marked, hi[lo < hi], -1)
        some = np.flatnonzero(np.cumsum(marked)[:-1] > 0)
        if len(some):
            raw, start = _spaced(words)
            digests.append(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start[some].tolist(), (start[some + window] - 1).tolist(), strict=True)]))
            places.append(base + some)
        base += len(words.start)
    two = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    order = np.lexsort((two[:, 1], two[:, 0]))
    two = two[order]
    cut = _runs(two)
    return two[cut[:-1]], np.diff(cut) > 1, np.repeat(np.arange(len(cut) - 1), np.diff(cut)), np.concatenate(places)[order]


def _runs(two: np.ndarray) -> np.ndarray:
    """As _cuts, for rows."""
    return np.concatenate([[0], np.flatnonzero((two[1:] != two[:-1]).any(1)) + 1, [len(two)]]) if len(two) else np.zeros(1, np.int64)


def _extended(window: int, parts: int):
    """Digests of a group's windows that hold a hit, by part."""

    def run(key, texts, hits):
        if not texts.num_rows or not hits.num_rows:
            return _batch([], DIGESTS)
        one, many, _, _ = _candidates(_column(_in_order(texts), "text"), hits, window, parts)
        part = (one[:, 1] % np.uint64(parts)).astype(np.int32)
        by_part = np.argsort(part, kind="stable")
        ends, rows = _cuts(part[by_part]), []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = by_part[a:b]
            rows.append((int(part[own[0]]), key[0].as_py(), one[own].tobytes(), np.packbits(many[own]).tobytes(), own.astype(np.int32).tobytes()))
        trim()
        return _batch(rows, DIGESTS)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each group of a part, the numbers of its digests that are repeated."""
    groups = table.column("g").to_pylist()
    nth = [np.frombuffer(x, np.int32) for x in table.column("nth").to_pylist()]
    two = np.frombuffer(b"".join(table.column("digests").to_pylist()), np.uint64).reshape(-1, 2)
    many = np.concatenate([_unpacked(x, len(n)) for x, n in zip(table.column("many").to_pylist(), nth, strict=True)])
    order = np.lexsort((two[:, 1], two[:, 0]))
    cut = _runs(two[order])
    again = np.empty(len(two), bool)
    again[order] = np.repeat((np.diff(cut) > 1) | np.maximum.reduceat(many[order], cut[:-1]), np.diff(cut))
    ends = np.cumsum([0, *map(len, nth)])
    return _batch([(g, x[again[a:b]].tobytes()) for g, x, a, b in zip(groups, nth, ends[:-1], ends[1:], strict=True) if again[a:b].any()], REPEATS)


# ---------------------------------------------------------------------------- 3. removal


def _kept(words: Words, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all kept words, each with a blank after it, and where each document's start."""
    starts, ends = words.start[~covered], words.end[~covered]
    size = ends - starts + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    mask = np.zeros(len(words.raw) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1  # where the next document's first word starts, both cancel
    inside = np.cumsum(mask)[:-1] > 0
    target = np.ones(len(out), bool)
    target[np.cumsum(size) - 1] = False
    out[target] = words.raw[inside]
    kept_of = np.bincount(words.doc[~covered], size, minlength=words.docs).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(kept_of)])


def _edits(texts: pa.Array, told: pa.Table, window: int, parts: int):
    """Slices of a group's texts, in order: rows, words, covered words, kept bytes and their offsets.  told: a group's HITS and REPEATS."""
    raw, at, base = told.column("nth").to_pylist(), np.zeros(0, np.int64), 0
    if any(raw):
        one, _, nth, place = _candidates(texts, told.filter(pa.compute.is_valid(told.column("keys"))), window, parts)
        again = np.zeros(len(one), bool)
        again[np.concatenate([np.frombuffer(x, np.int32) for x in raw if x])] = True
        at = np.sort(place[again[nth]])
    for i, j in slices(texts, SLICE_BYTES):
        words = Words(texts.slice(i, j - i), hashed=False)
        n = len(words.start)
        here = at[np.searchsorted(at, base) : np.searchsorted(at, base + n)] - base
        marked = np.bincount(here, minlength=n + 1) - np.bincount(here + window, minlength=n + 1)
        covered = np.cumsum(marked)[:n] > 0
        base += n
        yield i, j, words, covered, *_kept(words, covered)


def edited(docs: DataFrame, window: int, edit, schema) -> DataFrame:
    """edit(texts in a group's order, slices of them) of every group, by the method above.

    The exchanges of the texts and of the hits are read again by later steps; digests are computed twice and never written.
    """
    own, parts = dealt(docs)
    probes = own.groupBy("_g").applyInArrow(_probes(window, parts), PROBES)
    hits = probes.groupBy("part").applyInArrow(_hits, HITS)
    found = own.groupBy("_g").cogroup(hits.groupBy("g")).applyInArrow(_extended(window, parts), DIGESTS)
    repeats = found.groupBy("part").applyInArrow(_repeated, REPEATS)
    told = hits.unionByName(repeats, allowMissingColumns=True)

    def run(key, rows, told):
        rows = _in_order(rows)
        out = edit(rows, _edits(_column(rows, "text"), told, window, parts))
        trim()
        return out

    return own.groupBy("_g").cogroup(told.groupBy("g")).applyInArrow(run, schema)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of docs (doc_id, text)."""

    def edit(rows: pa.Table, edits) -> pa.Table:
        words_of, gone_of, sha = [], [], []
        for _, _, words, covered, kept, off in edits:
            raw = kept.tobytes()
            words_of.append(words.count)
            gone_of.append(np.bincount(words.doc[covered], minlength=words.docs))
            sha += [hashlib.sha256(raw[off[k] : max(off[k], off[k + 1] - 1)]).hexdigest() for k in range(words.docs)]
        counts = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (words_of, gone_of)]
        return pa.table([_column(rows, "doc_id"), *map(pa.array, counts), pa.array(sha, pa.string())], [x.split()[0] for x in RESULT.split(", ")])

    return edited(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window, edit, RESULT)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words of repeated windows; a text that loses none is unchanged, others have one blank between words."""
    docs, back = aside(docs)
    names = docs.columns

    def edit(rows: pa.Table, edits) -> pa.Table:
        texts, new = _column(rows, "text"), []
        for i, _, words, covered, kept, off in edits:
            gone = np.bincount(words.doc[covered], minlength=words.docs)
            raw = kept.tobytes()
            new += [texts[i + k].as_py() if not gone[k] else raw[off[k] : max(off[k], off[k + 1] - 1)].decode() for k in range(words.docs)]
        out = {c: rows.column(c) for c in names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in names:
            out["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64())
        return pa.table(out)

    typed = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in names else docs
    return back(edited(typed, window, edit, typed.schema))


def op2_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) AS i FROM w WHERE len(words) >= 35)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r
), g AS (
  SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
         list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
