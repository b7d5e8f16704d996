"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length.

Every source is a queue of tokens.  A window of `window_sequences` sequences visits all queues in turn and serves each its
share of the window as its quantum; what it could not be served in whole tokens is its deficit, carried to the next window.
Served tokens may be cut anywhere, so after n windows of W tokens a queue of share s has been served floor(n W s) tokens:
the deficit is the fraction, and each piece's window, sequence and place follow from the place of its document in its
queue.  Windows and partitions are therefore independent of one another; a window has W tokens but for less than one a
queue, sequences run on over the ends of windows, and every sequence but the last is full.  Where a source ends before the others (targets other than the corpus's own shares), a new stretch
begins with the shares of those that are left.

Places in queues: tokenizing numbers each source's tokens within a partition and writes a table; sums over partitions
(a row for each partition and source) then give every partition its base.  No task ever holds a source or a window.

Defined results: a null text is the empty one and packs as its end id alone; null sources are a source of their own;
every source is a queue, however many there are; null or repeated doc_ids are packed like others, in the order in which
they are read, so there are no ties; very long texts are tokenized whole and cut anywhere; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import Words, materialize, slices
from corpuscle.llm.mixing import queue_sizes

LENGTH = 4096
WINDOW_SEQUENCES = 16
END = 2
WORDS_KEPT, CORES_KEPT = 1_500_000, 250_000  # of a worker's tables: some 40 and 200 bytes each
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN_TO = "\u0130"  # below it lower case and composition do not depend on neighbours
_LOADED: dict[str, "Tokenizer"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokenizer:
    """Ids of whole texts.

    Where a tokenizer treats words between blanks one by one, words are told apart by 64-bit hashes, and the ids of those
    met before come from a bounded table, sorted by hash; a batch is put together by array operations.  New words of
    letters with a tail of signs are learnt by parts, all others as they are.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Reader

        self.own = Reader.from_file(path)
        self.kind = np.dtype("<u2") if self.own.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        one = lambda t: self.own.encode(t, add_special_tokens=False).ids
        self.by_word = one("ab the\n\tThe. ,x") == one("ab") + one("the") + one("The.") + one(",x") and one("the") == one("The") == one("THE")
        ends = np.zeros(self.own.get_vocab_size(), bool)
        for token, i in self.own.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends, self.by_core = ends, self.by_word and bool(ends.any())
        self.cores: dict[str, bytes] = {"": b""}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words without blanks."""
        if len(self.cores) > CORES_KEPT:
            self.cores = {"": b""}
        cores, parts, other, missing = self.cores, [], [], set()
        for w in words:
            core = w.rstrip(_TAIL)
            if self.by_core and (not core or (core.isalpha() and (core.isascii() or max(core) < _PLAIN_TO))):
                tail = w[len(core) :]
                core = core.lower()
                parts.append((core, tail))
                if core not in cores:
                    missing.add(core)
                if tail not in cores:
                    missing.add(tail)
            else:
                parts.append((w, None))
                other.append(w)
        new = sorted(missing)
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = np.array(self.own.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                raw, at = ids.tobytes(), [0, *(cut * self.kind.itemsize).tolist()]
                cores.update(zip(some, [raw[x:y] for x, y in zip(at, at[1:], strict=False)], strict=True))
            else:
                cores.update(zip(some, self._raw(some), strict=True))
        whole = dict(zip(other, self._raw(other), strict=True)) if other else {}
        return [whole[core] if tail is None else cores[core] + cores[tail] for core, tail in parts]

    def _places(self, keys: np.ndarray, words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct hashes lie in the pool, and how many there are; first: a word of each."""
        if len(self.keys) + len(keys) > WORDS_KEPT:
            self._forget()
        order = np.argsort(keys)  # in order, searches stay in the cache
        keys, first = keys[order], first[order]
        k = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(k, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.raw.tobytes()
            got = self._learn([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
            sizes = np.array([len(g) for g in got], np.int64) // self.kind.itemsize
            at = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(got), self.kind)])
            self.keys, self.at, self.sizes = (np.insert(old, k[new], x) for old, x in ((self.keys, keys[new]), (self.at, at), (self.sizes, sizes)))
            k += np.cumsum(~known) - ~known  # each place moves up by the new ones before it
        back = np.empty_like(k)
        back[order] = k
        return self.at[back], self.sizes[back]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array; nulls are empty."""
        if not self.by_word:
            return self._raw([t or "" for t in texts.to_pylist()])
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
            texts = pc.ascii_lower(texts)
        words = Words(texts)
        code, keys = pd.factorize(words.hash)
        first = np.empty(len(keys), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        at, sizes = self._places(keys, words, first)
        own = sizes[code]
        ends = np.cumsum(own)
        ids = self.pool[np.repeat(at[code] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[words.first] * self.kind.itemsize
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False)]


def loaded(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


TOKENS = "doc_id long, part int, queue int, queue_offset long, doc_tokens long, ids binary"


def tokenize(docs: DataFrame, path: str, sources: list[str | None], end: int = END) -> DataFrame:
    """One row a document: its ids (16 bits each where the vocabulary allows), and where they start among its source's in this partition."""
    queue_of = {s: i for i, s in enumerate(sources)}

    def run(batches):
        own, part, at = loaded(path), TaskContext.get().partitionId(), {}
        last = np.array([end], own.kind).tobytes()
        for batch in batches:
            ids, texts, names = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i, j in slices(texts, 1 << 20):
                coded = own.encode(texts.slice(i, j - i))
                queues, offsets, sizes, raw = [], [], [], []
                for name, c in zip(names[i:j], coded, strict=True):
                    q = queue_of[name]
                    n = len(c) // own.kind.itemsize + 1
                    queues.append(q)
                    offsets.append(at.get(q, 0))
                    sizes.append(n)
                    raw.append(c + last)
                    at[q] = at.get(q, 0) + n
                columns = [ids.slice(i, j - i), pa.array([part] * (j - i), pa.int32()), pa.array(queues, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TOKENS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).mapInArrow(run, TOKENS)


def stretches(totals: list[int], targets: list[float] | None) -> list[tuple[int, list[int], list[int]]]:
    """(first token, tokens of each queue served before, tokens of each queue in the stretch)."""
    done, at, out = [0] * len(totals), 0, []
    if not targets:
        return [(0, done, list(totals))] if sum(totals) else []
    while any(d < t for d, t in zip(done, totals, strict=True)):
        live = [i for i, t in enumerate(totals) if done[i] < t]
        weight = {i: max(targets[i], 0.0) for i in live}
        if not any(weight.values()):
            weight = {i: float(totals[i]) for i in live}
        live = [i for i in live if weight[i] > 0]
        times = min((totals[i] - done[i]) / weight[i] for i in live)
        served = [0] * len(totals)
        for i in live:
            left = totals[i] - done[i]
            served[i] = left if left / weight[i] <= times else min(left, int(times * weight[i]))
        out.append((at, list(done), served))
        at += sum(served)
        done = [d + s for d, s in zip(done, served, strict=True)]
    return out


class Plan:
    """Where the tokens of a queue go."""

    def __init__(self, planned: list[tuple[int, list[int], list[int]]], length: int, window: int) -> None:
        self.planned, self.length, self.window = planned, length, window
        self.totals = [sum(served) for _, _, served in planned]
        self.starts = [[done[i] for _, done, _ in planned] for i in range(len(planned[0][1]))] if planned else []
        self.known: dict[tuple[int, int], list[int]] = {}

    def served(self, k: int, queue: int, n: int) -> int:
        """Tokens that a queue has been served after n windows of stretch k: whole ones of its share, never fewer later on."""
        total = self.totals[k]
        return min(n * self.window, total) * self.planned[k][2][queue] // total

    def layout(self, k: int, n: int) -> list[int]:
        """Where each queue's tokens of window n start in the whole."""
        if (k, n) not in self.known:
            if len(self.known) * len(self.planned[k][2]) > 640_000:
                self.known.clear()
            every = range(len(self.planned[k][2]))
            before = [self.served(k, q, n) for q in every]
            own = [self.served(k, q, n + 1) - x for q, x in zip(every, before, strict=True)]
            self.known[k, n] = list(accumulate(own, initial=self.planned[k][0] + sum(before)))
        return self.known[k, n]

    def places(self, queue: int, first: int, count: int):
        """(tokens before, tokens, place in the whole) of the runs of tokens [first, first + count) of a queue that stay together."""
        x, stop = first, first + count
        k = bisect.bisect_right(self.starts[queue], x) - 1
        while x < stop:
            _, done, served = self.planned[k]
            y, own = x - done[queue], served[queue]
            if y >= own:
                k += 1
                continue
            n = y * self.totals[k] // (own * self.window)
            while n and self.served(k, queue, n) > y:
                n -= 1
            while self.served(k, queue, n + 1) <= y:
                n += 1
            begin, end = self.served(k, queue, n), self.served(k, queue, n + 1)
            size = min(stop - x, end - y)
            yield x - first, size, self.layout(k, n)[queue] + (y - begin)
            x += size


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int, ids binary"


def cut(tokens: DataFrame, plan: Plan, with_ids: bool) -> DataFrame:
    """One row a piece."""

    def run(batches):
        n = plan.length
        for batch in batches:
            rows = []
            for doc, queue, first, count, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                size = len(raw) // count
                ids = np.frombuffer(raw, f"<u{size}").astype("<u4")
                for start, many, place in plan.places(queue, first, count):
                    while many:
                        here = min(many, n - place % n)
                        own = ids[start : start + here]
                        rows.append((doc, start, here, zlib.crc32(own.tobytes()), count, place // n, place % n, queue, own.tobytes() if with_ids else None))
                        start, many, place = start + here, many - here, place + here
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return tokens.select("doc_id", "queue", "first", "doc_tokens", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, *, path: str | None = None, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, with_ids: bool = False) -> DataFrame:
    """All documents in pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids.

    targets: wanted share of tokens of each source; by default the corpus's own shares, which all windows then have.
    """
    names = [s for s, _ in queue_sizes(docs)]
    tokens = materialize(tokenize(docs, path or default_tokenizer(), names), "tokens", rows=10_000)
    sums = tokens.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n"))
    up_to = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = materialize(sums.select("part", "queue", "n", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base")), "bases")
    totals = [0] * len(names)
    for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row a queue
        totals[r["queue"]] = r["n"]
    wanted = [targets.get(s, 0.0) for s in names] if targets else None
    plan = Plan(stretches(totals, wanted), length, length * window_sequences)
    placed = tokens.join(bases.select("part", "queue", "base"), ["part", "queue"]).withColumn("first", F.col("base") + F.col("queue_offset"))
    return cut(placed, plan, with_ids)


def assemble(pieces: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ids: (sequence_id, ids), little-endian 32-bit; a group has `length` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op8_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("ids")
