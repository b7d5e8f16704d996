"""Word segmentation by dictionary, for scripts that put no blanks between words.

A dictionary of words and counts becomes a trie.  In every run of letters the words of the trie that begin at each letter make
a graph, in which a lone letter is always a word; of its paths the most probable one is taken, by dynamic programming from
the end of the run.  A word's cost is the negative logarithm of its share of all counts, in whole millionths, so sums are
exact and equal everywhere; of equal paths the one whose earlier words are longer is taken.

All runs of an Arrow batch are worked on together: one step of the trie for all letters, one step from the end for all runs.

A dictionary that grows with a corpus is `stored` in slices by the first letters of its words: tasks make their tries, and a
task that segments reads them one after the other for many letters at once.  No task and no driver holds all of it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.store import new_folder

MILLIONTHS = 1_000_000
MOST_WORDS = 500_000  # of a dictionary, which every task holds: some 60 bytes a word, and some 500 on the driver while it is made
LONGEST = 63  # letters of a word
LETTERS_AT_ONCE = 1 << 19
SLICE_WORDS = 500_000  # some 60 MB as a trie
SLICES_KEPT = 2  # by a worker, which reads the others again for the next letters
SLICED_ROUNDS = 2  # LETTERS_AT_ONCE that are looked up in the slices before their paths are taken
PREFIX = 3  # letters that decide on a word's slice; shorter words are in all slices
HAN = r"\p{IsHan}"
PLAIN = r"[\p{L}\p{N}]"  # runs of these that are no graph's letters are words as they stand


class Trie:
    """Nodes are numbers; a child is found by its parent's number and a letter in one hashed array."""

    rounds = 1

    def __init__(self, words: list[str], costs: list[int], unknown: int) -> None:
        """unknown: the cost of a letter that is no word."""
        self.unknown = unknown
        some = [(w, c) for w, c in zip(words, costs, strict=True) if 0 < len(w) <= LONGEST]
        size = np.array([len(w) for w, _ in some], np.int64)
        letters = np.frombuffer("".join(w for w, _ in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.cumsum(size) - size
        node, known = np.zeros(len(some), np.int64), 1
        keys, ends, cost = [], [], {}
        own = np.array([c for _, c in some], np.int64)
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k)
            found, inverse = np.unique(node[live] << 21 | letters[at[live] + k], return_inverse=True)
            keys.append(found)
            ends.append(known + np.arange(len(found)))
            node[live] = known + inverse
            known += len(found)
            done = live[size[live] == k + 1]
            cost.update(zip(node[done].tolist(), own[done].tolist(), strict=True))
        self._hashed(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(ends) if keys else np.zeros(0, np.int64))
        self.cost = np.full(known, -1, np.int32)
        if cost:
            self.cost[list(cost)] = list(cost.values())
        self.depth = len(keys)

    def _hashed(self, keys: np.ndarray, ends: np.ndarray) -> None:
        """Each key in the first free slot from its hash on; at most half of the slots is taken."""
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.ends = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ends[slot[put]] = keys[put], ends[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """The nodes under keys, 0 where there is none."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ends[slot], 0)
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[other]]
            hit = found == keys[other]
            out[other[hit]] = self.ends[slot[other[hit]]]
            other = other[~hit & (found >= 0)]
        return out

    def found(self, letters: np.ndarray, left: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, length, costs) of the words that begin at places `at`, by length; left: letters from a place to the end of its run."""
        places, node, lone = at, np.zeros(len(at), np.int64), np.full(len(at), self.unknown, np.int32)
        own = np.arange(len(at))
        for k in range(self.depth):
            inside = left[at] > k
            at, node, own = at[inside], node[inside], own[inside]
            child = self._children(node << 21 | letters[at + k])
            hit = child > 0
            at, node, own = at[hit], child[hit].astype(np.int64), own[hit]
            if not len(at):
                break
            cost = self.cost[node]
            word = np.flatnonzero(cost >= 0)
            if k:
                yield at[word], k + 1, cost[word]
            else:
                lone[own[word]] = cost[word]
        yield places, 1, lone

    def words(self, letters: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Where words begin on the cheapest paths."""
        return _paths(list(self.found(letters, left, np.arange(len(letters)))), left)

    def save(self, out) -> None:
        for part in (np.array([self.depth, self.bits]), self.keys, self.ends, self.cost):
            np.save(out, part)

    @classmethod
    def load(cls, given, unknown: int) -> Trie:
        trie = cls.__new__(cls)
        trie.depth, trie.bits = map(int, np.load(given))
        trie.keys, trie.ends, trie.cost = (np.load(given) for _ in range(3))
        trie.unknown = unknown
        return trie


class Slices:
    """A dictionary in a folder of tries: a letter's words are all in the one that the letters from it on decide."""

    rounds = SLICED_ROUNDS

    def __init__(self, folder: str, count: int, there: set[int], unknown: int) -> None:
        """there: the slices of `count` that have words."""
        self.folder, self.count, self.there, self.unknown = folder, count, there, unknown
        self.turn = 1

    def words(self, letters: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Where words begin on the cheapest paths."""
        own = slice_of(letters, *(np.where(left > k, np.concatenate([letters[k:], letters[:k]]), 0) for k in (1, 2)), self.count)
        parts = []
        for k in range(self.count)[:: self.turn]:
            at = np.flatnonzero(own == k)
            if len(at):
                trie = _slice(self.folder, k, self.unknown) if k in self.there else Trie([], [], self.unknown)
                parts += [(places.astype(np.int32), length, costs) for places, length, costs in trie.found(letters, left, at)]
        self.turn = -self.turn  # the slices read last come first
        begins, first = np.zeros(len(letters), bool), 0
        ends = np.flatnonzero(left == 1) + 1  # of runs
        while first < len(letters):
            last = int(ends[min(np.searchsorted(ends, first + LETTERS_AT_ONCE), len(ends) - 1)])
            some = []
            for places, length, costs in parts:
                lo, hi = np.searchsorted(places, (first, last))
                some.append((places[lo:hi].astype(np.int64) - first, length, costs[lo:hi]))
            begins[first:last] = _paths(some, left[first:last])
            first = last
        return begins


def slice_of(first: np.ndarray, second: np.ndarray, third: np.ndarray, count: int) -> np.ndarray:
    """The slice of words by the code points of their first letters."""
    code = ((first.astype(np.uint64) << np.uint64(42)) | (second.astype(np.uint64) << np.uint64(21)) | third.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((code >> np.uint64(32)) % np.uint64(count)).astype(np.int32)


@functools.lru_cache(SLICES_KEPT)
def _slice(folder: str, number: int, unknown: int) -> Trie:
    import pyarrow.fs

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{number}.trie") as given:
        return Trie.load(given, unknown)


def _paths(parts: list[tuple[np.ndarray, int, np.ndarray]], left: np.ndarray) -> np.ndarray:
    """Where words begin on the cheapest paths; parts: (places, length, costs) of words, no place twice in one."""
    n = len(left)
    begins = np.zeros(n, bool)
    if not n:
        return begins
    # letters from the ends of the runs on, the words of a letter together
    order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    each = [rank[places] for places, _, _ in parts]
    count = np.zeros(n, np.int64)
    for own in each:
        count[own] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    at = first[:-1].copy()
    value, to = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    for own, (places, length, costs) in zip(each, parts, strict=True):
        slot = at[own]
        at[own] += 1
        value[slot] = costs.astype(np.int64) << 6 | (LONGEST - length)  # the cheapest, of these the longest
        to[slot] = np.where(length < left[places], rank[np.minimum(places + length, n - 1)], n)
    steps = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
    best = np.zeros(n + 1, np.int64)  # of the rest of the run, without its lowest bits; the last is that of a run's end
    taken = np.empty(n, np.int64)
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        lo, hi = first[a], first[b]
        taken[a:b] = least = np.minimum.reduceat(value[lo:hi] + best[to[lo:hi]], first[a:b] - lo)
        best[a:b] = least & ~63
    take = np.empty(n, np.int64)
    take[order] = LONGEST - (taken & 63)
    at = np.flatnonzero(np.concatenate([[True], left[:-1] == 1]))  # runs
    while len(at):
        begins[at] = True
        at = at[take[at] < left[at]] + take[at[take[at] < left[at]]]
    return begins


@functools.lru_cache(8)
def _kinds(letters: str, plain: str) -> np.ndarray:
    """Of every code point: 1 a graph's letter, 2 of a word as it stands, 4 white space, 0 any other sign."""
    import regex

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, codes = "".join(every), np.array([ord(c) for c in every])
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\s|[\x1c-\x1f]", 4), (plain, 2), (letters, 1)):
        for m in regex.finditer(f"(?:{pattern})+", text):
            out[codes[m.start() : m.end()]] = kind
    return out


def cut(texts: pa.Array, trie: Trie | Slices, letters: str = HAN, plain: str = PLAIN, signs: bool = False) -> pa.Array:
    """The words of each text, as lists; signs: with every other sign but white space as a word of its own."""
    texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    parts, first = [], 0
    ends = np.cumsum(sizes)
    while first < len(texts) or not parts:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + trie.rounds * LETTERS_AT_ONCE, "right"))) if len(texts) else 0
        parts.append(_cut(texts.slice(first, last - first), sizes[first:last], trie, _kinds(letters, plain), signs))
        first = max(last, 1)
    return pa.concat_arrays(parts)


def _cut(texts: pa.Array, sizes: np.ndarray, trie: Trie | Slices, kinds: np.ndarray, signs: bool) -> pa.Array:
    whole = "".join(texts.to_pylist())
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kind = kinds[code]
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, bool)
    begins = new & (kind == 2)
    if signs:
        begins |= kind == 0
    graph = np.flatnonzero(kind == 1)
    if len(graph):
        # letters to the end of each run
        start = np.flatnonzero(new[graph])
        stop = np.concatenate([start[1:], [len(graph)]])
        left = np.repeat(stop, stop - start) - np.arange(len(graph))
        begins[graph] = trie.words(code[graph], left)
    kept = (kind == 1) | (kind == 2) | (signs & (kind == 0))
    places = np.flatnonzero(kept)
    own = code[places]
    width = 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])
    word = np.flatnonzero(begins[places])
    offsets = np.concatenate([at[word], at[-1:]]).astype(np.int32)
    raw = own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    values = pa.Array.from_buffers(pa.string(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    lists = np.searchsorted(doc[places[word]], np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), values)


# ---------------------------------------------------------------------------- dictionaries


def costs(counts: DataFrame) -> DataFrame:
    """(word, count, cost, unknown) of (word, count); words without a positive count are left out."""
    kept = counts.filter("word IS NOT NULL AND word != '' AND count > 0").groupBy("word").agg(F.sum("count").alias("count"))
    total = kept.agg(F.sum("count").alias("total"))  # one row
    cost = lambda n: F.round(MILLIONTHS * F.ln(F.col("total") / n)).cast("long")
    return kept.crossJoin(F.broadcast(total)).select("word", "count", cost(F.col("count")).alias("cost"), cost(F.lit(1)).alias("unknown"))


def trie(counts: DataFrame, most: int = MOST_WORDS) -> Trie:
    """A dictionary of at most `most` words, given as (word, count); a larger one is refused."""
    rows = costs(counts).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} words: keep those of a higher count")
    return Trie(rows["word"].tolist(), rows["cost"].tolist(), int(rows["unknown"].iloc[0]) if len(rows) else 0)


def stored(counts: DataFrame, words: int = SLICE_WORDS) -> Slices:
    """A dictionary of any size, given as (word, count): one trie for about so many words, each made by a task."""
    spark = counts.sparkSession
    path, folder = new_folder(spark, "words"), new_folder(spark, "slices")
    counts.select("word", "count").write.parquet(path)  # the corpus is read once
    rows = costs(spark.read.schema("word string, count long").parquet(path))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("unknown").alias("unknown")).first()
    count, unknown = max(1, -(-size["n"] // words)), size["unknown"] or 0

    @F.arrow_udf("int")
    def own(begin: pa.Array) -> pa.Array:
        letters = np.frombuffer("".join(begin.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, PREFIX)
        return pa.array(slice_of(*letters.T, count), pa.int32())

    def made(given: pa.Table) -> pa.Table:
        import pyarrow.fs

        number = given["slice"][0].as_py()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{number}.trie", compression=None) as out:
            Trie(given["word"].to_pylist(), given["cost"].to_pylist(), unknown).save(out)
        return pa.table({"slice": [number]}, pa.schema([("slice", pa.int32())]))

    short = F.length("word") < PREFIX
    every = F.sequence(F.lit(0), F.lit(count - 1)).cast("array<int>")
    begin = F.substring(F.rpad("word", PREFIX, " "), 1, PREFIX)
    placed = rows.select("word", "cost", F.explode(F.when(short, every).otherwise(F.array(own(begin)))).alias("slice"))
    there = {r["slice"] for r in placed.groupBy("slice").applyInArrow(made, "slice int").collect()}  # a number a slice
    return Slices(folder, count, there, unknown)


def segmenter(words: Trie | Slices, spark, letters: str = HAN, plain: str = PLAIN, signs: bool = False) -> Callable[[Column], Column]:
    """A tokenizer: text to its words, in Arrow batches."""
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        return cut(texts, shared.value, letters, plain, signs)

    return tokens


def given(spark, path: str) -> DataFrame:
    """(word, count) of a dictionary file with a word, its count and maybe a tag on each line."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(part, 0).alias("word"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) AS long)").alias("count")).filter("word != ''")


def learnt(texts: DataFrame, tokenizer: Callable[[Column], Column], least: int = 1) -> DataFrame:
    """(word, count) of texts that have blanks between words."""
    counts = texts.select(F.explode(tokenizer(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") >= least) if least > 1 else counts


def discovered(texts: DataFrame, letters: str = HAN, longest: int = 4, least: int = 5, cohesion: float = 2.0, freedom: int = 2) -> DataFrame:
    """(word, count) found in texts without blanks: what is there more often than its parts would meet by chance.

    A run of 2 to `longest` letters is a word if it is there `least` times, if for its every division in two the logarithm of
    its count times all letters over the product of the parts' counts is `cohesion` or more, and if it has `freedom` different
    neighbours on either side (the end of a run is one).  Letters by themselves are words, with their counts.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?:{letters})+"), F.lit(0))).alias("run")
    runs = texts.select(run)
    place = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    sized = place.select("run", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1))).alias("n"))
    before = F.when(F.col("i") > 1, F.expr("substring(run, i - 1, 1)")).otherwise("")
    after = F.expr("substring(run, i + n, 1)")
    grams = sized.select(F.expr("substring(run, i, n)").alias("word"), before.alias("before"), after.alias("after"))
    counted = grams.groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.size(F.collect_set("before")).alias("befores"), F.size(F.collect_set("after")).alias("afters"))
    size = F.length("word")
    frequent = counted.filter((F.col("count") >= least) | (size == 1))
    letters_in_all = frequent.filter(size == 1).agg(F.sum("count").alias("total"))  # one row
    free = frequent.filter((size > 1) & (F.col("befores") >= freedom) & (F.col("afters") >= freedom))
    halves = free.select("word", "count", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("word", "count", F.expr("substring(word, 1, k)").alias("one"), F.expr("substring(word, k + 1)").alias("two"))
    # parts of a frequent word are as frequent, so none is missing
    part = lambda name: frequent.select(F.col("word").alias(name), F.col("count").alias(f"n_{name}"))
    tied = halves.join(part("one"), "one").join(part("two"), "two").crossJoin(F.broadcast(letters_in_all))
    bond = F.ln(F.col("count") * F.col("total") / (F.col("n_one") * F.col("n_two")))
    held = tied.groupBy("word", "count").agg(F.min(bond).alias("bond")).filter(F.col("bond") >= cohesion).select("word", "count")
    return held.unionByName(frequent.filter(size == 1).select("word", "count"))


