"""A stored inverted index: segments that never change, deletions beside them, a manifest a version, exact top-k by block bounds.

A segment holds for its documents
* `forward`: (doc, id, corpus_pos, source, len, terms, tfs), with Bloom filters of the sources;
* `postings`: (term, block, n, data, max_tf, min_len), a row for each term and block of at most BLOCK documents.  They are made
  and written where their documents are, without a shuffle, in runs of some BATCH_ROWS documents in the order of (term, block)
  and in pages of PAGE_ROWS, so that a scan for few terms skips the pages of others; data: 32-bit pairs of a document (after
  the block's first) and its tf;
* `terms`: (term, df).
An upsert writes one segment with the new documents and marks those that their sources had before as deleted; a delete only
marks.  Both name their sources to the scan, which skips row groups without them.  `merge` rewrites segments as one, without what is deleted.  Numbers of
documents and tokens and the mean idf are kept in the manifest, so scores are those of an index built anew.

A search takes the bound of each block first: no document of it can score more than the sum over the query's terms of the
part that the block's largest tf and shortest document give.  The blocks of the highest bounds are scored; the k-th best score
there is a threshold, and only blocks whose bound reaches it for some query are read besides.  Bounds come from narrow columns in
one pass, a row a block that holds those of all queries, and are written: the threshold and what it leaves are read from there.
Postings of other blocks are never taken apart.  More than FEW queries at once reach nearly every block together: they are scored
without bounds, in one pass, with the same result.  Rows of postings meet by groups of GROUP documents, bounded work that returns
the best of each query, as products of matrices: no row is made for a posting and a query.

Defined results: a null text has no tokens; documents of equal ids are different rows, each ranked; a null source is a
source; of equal scores (five digits) the lesser corpus_pos is first; where fewer than top_n documents have a score, others
follow in the order of corpus_pos with 0; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpuscle.functions import text as T
from corpuscle.operators.blocks import batches, written
from corpuscle.operators.bm25 import EPSILON, K1, B
from corpuscle.sources.store import Store

BLOCK = 16  # documents: larger blocks have wider bounds, smaller ones more rows
FIRST_BLOCKS = 4  # of a query that give its threshold
GROUP = 1024  # documents that a task scores at once
DOCUMENTS_AT_ONCE = 512
QUERIES_AT_ONCE = 256
FEW = 16  # queries for which bounds are worth their passes: those of many leave hardly a block out
MOST_NAMES = 10_000  # sources that are named to a scan
MOST_TERMS = 10  # that are named to a scan: of more a Parquet filter takes the least and the greatest alone
PAGE_ROWS = 4096
PAGES = {"parquet.page.row.count.limit": str(PAGE_ROWS)}
BLOOM = {"parquet.bloom.filter.enabled#source": "true", "parquet.bloom.filter.expected.ndv#source": "10000"}
DIGITS = 5
BATCH_ROWS = 1000  # documents of an Arrow batch while an index is written
_PART, _ROW = 1 << 20, 1 << 32  # a document's number: segment, partition and row

FORWARD = "doc long, id {id}, corpus_pos long, source string, len int, terms array<string>, tfs array<int>"
POSTINGS = "term string, block long, n int, data binary, max_tf int, min_len int"
TERMS = "term string, df long"
DELETED = "segment int, doc long"
DELETED_TERMS = "segment int, term string, df long"


@F.arrow_udf(StructType([StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))]))
def _counted(tokens: pa.Array) -> pa.Array:
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    sizes = np.asarray(tokens.value_lengths().fill_null(0))
    coded = tokens.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    cell, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    at = pa.array(np.searchsorted(cell, np.arange(len(sizes) + 1) * width), pa.int32())
    terms = coded.dictionary.take(pa.array(cell % width)) if len(cell) else pa.array([], pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], ["terms", "tfs"])


def _blocks(batches, size: int):
    """Rows of forward, in the order of doc, to rows of postings, those of a batch in the order of (term, block)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, length, terms, tfs = (batch.column(i) for i in range(4))
        order = np.argsort(doc.to_numpy(zero_copy_only=False), kind="stable")
        doc, length, terms, tfs = (c.take(pa.array(order)) for c in (doc, length, terms, tfs))
        ids = doc.to_numpy(zero_copy_only=False)
        sizes = np.asarray(terms.value_lengths())
        of = np.repeat(np.arange(len(ids)), sizes)
        # a block is named by the first of its documents that this batch has, so that blocks are disjoint whatever batches are
        start = np.flatnonzero(np.concatenate([[True], ids[1:] // size != ids[:-1] // size]))
        block = np.repeat(ids[start], np.diff(np.concatenate([start, [len(ids)]])))
        coded = terms.flatten().dictionary_encode()
        code, tf, lens = coded.indices.to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False)
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        by = np.argsort(place[code], kind="stable")  # of ascends, and so do the blocks of a term
        code, of, tf = code[by], of[by], tf[by]
        if not len(code):
            continue
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[of[1:]] != block[of[:-1]])]))
        at = np.concatenate([first, [len(code)]])
        pairs = np.column_stack([ids[of] - block[of], tf]).astype("<i4")
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(pairs.tobytes())])
        columns = [coded.dictionary.take(pa.array(code[first])), pa.array(block[of[first]]), pa.array(np.diff(at), pa.int32()), data, pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(lens[of], first), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in POSTINGS.split(", ")])


def _pairs(data: pa.Array) -> np.ndarray:
    """(document after the block's first, tf) of all rows of postings, as they lie in memory."""
    data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    at = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)
    return np.frombuffer(data.buffers()[2], "<i4", (at[-1] - at[0]) // 4, at[0]).reshape(-1, 2)


def _mean(m: dict) -> float:
    """The mean length; any number does where no document has a token."""
    return m["tokens"] / m["n"] if m["tokens"] else 1.0


def _matrix(rows: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary rows of `width` numbers each, in the order of the rows."""
    at = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, rows.offset * 4)
    return np.frombuffer(rows.buffers()[2], kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]).reshape(-1, width)


def _packed(rows: np.ndarray, kind: str) -> pa.Array:
    """The rows of a matrix as binary values."""
    own = np.ascontiguousarray(rows, kind)
    at = np.arange(len(own) + 1, dtype=np.int32) * (own.shape[1] * own.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at), pa.py_buffer(own.tobytes())])


def _reaches(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    # half a digit of rounding, and the last bits of sums in other orders
    return (bound >= least[None] - 10.0**-DIGITS) & (bound > 0)


class _Asked(NamedTuple):
    """Queries as a matrix: what a term's part of a score is multiplied by for each query."""

    ids: list
    terms: list[str]
    weights: np.ndarray


class Inverted:
    """An index in a folder.  corpus: (id, corpus_pos, source, text); ids are of the type `id_type`."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Callable[[Column], Column] = T.words, id_type: str = "long", block: int = BLOCK) -> None:
        self.store, self.tokenizer, self.forward, self.block = Store(spark, path), tokenizer, FORWARD.format(id=id_type), block

    def _docs(self, segments: list[dict]) -> DataFrame:
        return self.store.load([s["forward"] for s in segments], self.forward)

    # ------------------------------------------------------------------------ writing

    def _segment(self, counted: DataFrame, number: int) -> dict | None:
        """A segment of (id, corpus_pos, source, len, terms, tfs); None if there are no rows."""
        # documents of like lengths share blocks, which makes bounds tight
        numbered = counted.sortWithinPartitions("len").withColumn("_id", F.monotonically_increasing_id())
        doc = F.lit(number * _PART * _ROW) + F.shiftright("_id", 33) * _ROW + F.col("_id").bitwiseAND((1 << 33) - 1)
        with batches(self.store.spark, BATCH_ROWS):
            forward = self.store.write(numbered.select(doc.alias("doc"), "id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "source", "len", "terms", "tfs"), "forward", options=BLOOM)
        rows = self.store.load([forward], self.forward)
        n, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not n:
            return None
        blocks = rows.select("doc", "len", "terms", "tfs").mapInArrow(lambda batches, n=self.block: _blocks(batches, n), POSTINGS)
        with batches(self.store.spark, BATCH_ROWS):
            postings = self.store.write(blocks, "postings", options=PAGES)
        df = self.store.load([postings], POSTINGS).groupBy("term").agg(F.sum("n").alias("df"))
        return {"number": number, "forward": forward, "postings": postings, "terms": self.store.write(df, "terms"), "n": n, "tokens": tokens}

    def _counts(self, corpus: DataFrame) -> DataFrame:
        tokens = corpus.select("id", "corpus_pos", F.col("source").cast("string").alias("source"), self.tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
        return tokens.select("id", "corpus_pos", "source", F.size("tokens").alias("len"), _counted("tokens").alias("c")).select("id", "corpus_pos", "source", "len", "c.terms", "c.tfs")

    def _publish(self, base: dict, segments: list[dict], deleted: list[dict]) -> int:
        m = {"segments": segments, "deleted": deleted, "last": max([base.get("last", 0), *(s["number"] for s in segments)])}
        m["n"] = sum(s["n"] for s in segments) - sum(d["n"] for d in deleted)
        m["tokens"] = sum(s["tokens"] for s in segments) - sum(d["tokens"] for d in deleted)
        # terms alone are read for it, no postings
        raw = self._raw(m).agg(F.avg("raw")).first()[0] if m["n"] else None
        return self.store.publish(m | {"mean_idf": raw or 0.0}, base["version"])

    def _raw(self, m: dict) -> DataFrame:
        """(term, df, raw idf) of all terms that a document has."""
        df = self.store.load([s["terms"] for s in m["segments"]], TERMS)
        if m["deleted"]:
            gone = self.store.load([d["terms"] for d in m["deleted"]], DELETED_TERMS)
            df = df.unionByName(gone.select("term", (-F.col("df")).alias("df")))
        if m["deleted"] or len(m["segments"]) > 1:  # a segment has a row a term
            df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        n = F.lit(float(m["n"]))
        return df.withColumn("raw", F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))

    def _marked(self, m: dict, sources: DataFrame) -> list[dict]:
        """Deletions of all documents that sources (source) have in version m."""
        if not m["segments"]:
            return []
        asked = sources.select(F.col("source").cast("string").alias("source")).distinct()
        rows = self._docs(m["segments"])
        names = [r[0] for r in asked.limit(MOST_NAMES + 1).collect()]
        if len(names) <= MOST_NAMES and None not in names:
            rows = rows.filter(F.col("source").isin(names))
        rows = self._alive(m, rows)
        own = rows.join(asked.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")), "left_semi").select(F.shiftright("doc", 52).cast("int").alias("segment"), "doc", "len", "terms")
        part = self.store.write(own, "deleted")
        own = self.store.load([part], DELETED + ", len int, terms array<string>")
        n, tokens = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not n:
            return []
        df = own.select("segment", F.explode("terms").alias("term")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df"))
        return [{"docs": part, "terms": self.store.write(df, "deleted-terms"), "n": n, "tokens": tokens}]

    def _alive(self, m: dict, rows: DataFrame) -> DataFrame:
        if not m["deleted"]:
            return rows
        return rows.join(self.store.load([d["docs"] for d in m["deleted"]], DELETED).select("doc"), "doc", "left_anti")

    def _read(self, version: int | None = None) -> dict:
        return {"segments": [], "deleted": [], "n": 0, "tokens": 0, "mean_idf": 0.0} | self.store.read(version)

    def upsert(self, corpus: DataFrame) -> int:
        """Rows of corpus instead of all that their sources had; the new version."""
        m = self._read()
        segment = self._segment(self._counts(corpus), m.get("last", 0) + 1)
        if segment is None:
            return self._publish(m, m["segments"], m["deleted"])
        sources = self.store.load([segment["forward"]], self.forward).select("source")
        return self._publish(m, [*m["segments"], segment], [*m["deleted"], *self._marked(m, sources)])

    def delete(self, sources: DataFrame) -> int:
        """Without the documents of sources (source); the new version."""
        m = self._read()
        return self._publish(m, m["segments"], [*m["deleted"], *self._marked(m, sources)])

    def merge(self, most: int = 1) -> int:
        """At most `most` segments: the smallest ones become one, without what is deleted in them."""
        m = self._read()
        by_size = sorted(m["segments"], key=lambda s: s["n"])
        some = by_size[: len(by_size) - most + 1] if len(by_size) >= most else []
        if not some:
            return m["version"]
        numbers = [s["number"] for s in some]
        rows = self._alive(m, self._docs(some))
        one = self._segment(rows.select("id", "corpus_pos", "source", "len", "terms", "tfs"), m.get("last", 0) + 1)
        kept = []
        if m["deleted"]:
            docs = self.store.load([d["docs"] for d in m["deleted"]], DELETED + ", len int, terms array<string>").filter(~F.col("segment").isin(numbers))
            part = self.store.write(docs, "deleted")
            docs = self.store.load([part], DELETED + ", len int, terms array<string>")
            n, tokens = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            if n:
                terms = self.store.load([d["terms"] for d in m["deleted"]], DELETED_TERMS).filter(~F.col("segment").isin(numbers))
                kept = [{"docs": part, "terms": self.store.write(terms, "deleted-terms"), "n": n, "tokens": tokens}]
        return self._publish(m, [s for s in m["segments"] if s["number"] not in numbers] + ([one] if one else []), kept)

    def vacuum(self, keep: int = 2) -> list[str]:
        return self.store.vacuum(keep, lambda m: [s[k] for s in m.get("segments", []) for k in ("forward", "postings", "terms")] + [d[k] for d in m.get("deleted", []) for k in ("docs", "terms")])

    # ------------------------------------------------------------------------ searching

    def terms(self, version: int | None = None, epsilon: float = EPSILON) -> DataFrame:
        """(term, df, idf) of all terms."""
        m = self._read(version)
        raw = F.col("raw")
        return self._raw(m).select("term", "df", F.when(raw < 0, epsilon * m["mean_idf"]).otherwise(raw).alias("idf"))

    def _asked(self, m: dict, queries: DataFrame, k1: float, epsilon: float) -> list[_Asked]:
        """The queries (query_id, text), a stated set, as matrices of QUERIES_AT_ONCE."""
        rows = queries.select("query_id", F.explode(self.tokenizer(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).collect()
        names = sorted({r["term"] for r in rows})
        idf = {r["term"]: r["raw"] if r["raw"] >= 0 else epsilon * m["mean_idf"] for r in self._raw(m).join(F.broadcast(self._numbered(names)), "term").collect()}
        ids = sorted({r["query_id"] for r in rows})
        out = []
        for i in range(0, len(ids), QUERIES_AT_ONCE):
            some = {q: n for n, q in enumerate(ids[i : i + QUERIES_AT_ONCE])}
            own = [r for r in rows if r["query_id"] in some and r["term"] in idf]
            terms = sorted({r["term"] for r in own})
            at = {t: n for n, t in enumerate(terms)}
            weights = np.zeros((len(terms), len(some)))
            for r in own:
                weights[at[r["term"]], some[r["query_id"]]] = r["times"] * idf[r["term"]] * (k1 + 1)
            out.append(_Asked(list(some), terms, weights))
        return out

    def _numbered(self, terms: list[str]) -> DataFrame:
        """(term, t): of the queries, a stated set."""
        return self.store.spark.createDataFrame([(t, n) for n, t in enumerate(terms)], "term string, t int")

    def _postings(self, m: dict, asked: _Asked) -> DataFrame:
        """(group, t, block, n, data, max_tf, min_len) of the queries' terms, t being their place among these."""
        postings = self.store.load([s["postings"] for s in m["segments"]], POSTINGS)
        if len(asked.terms) <= MOST_TERMS:
            postings = postings.filter(F.col("term").isin(asked.terms))
        return postings.join(F.broadcast(self._numbered(asked.terms)), "term").drop("term").withColumn("group", F.floor(F.col("block") / GROUP))

    def _bounds(self, m: dict, asked: _Asked, k1: float, b: float) -> DataFrame:
        """(block, bounds, held): of all queries together, as binary rows of doubles and ints; held: postings of the query's terms."""
        mean = _mean(m)
        shared = self.store.spark.sparkContext.broadcast(asked)

        def run(table: pa.Table) -> pa.Table:
            own = shared.value
            blocks, row = np.unique(table["block"].to_numpy(), return_inverse=True)
            tf, short = table["max_tf"].to_numpy().astype(float), table["min_len"].to_numpy()
            used, column = np.unique(table["t"].to_numpy(), return_inverse=True)
            part, n = np.zeros((len(blocks), len(used))), np.zeros((len(blocks), len(used)))
            part[row, column] = tf / (tf + k1 * (1 - b + b * short / mean))
            n[row, column] = table["n"].to_numpy()
            bound, held = part @ np.maximum(own.weights[used], 0), n @ (own.weights[used] != 0)
            return pa.table({"block": blocks, "bounds": _packed(bound, "<f8"), "held": _packed(held, "<i4")})

        rows = self._postings(m, asked).select("group", "t", "block", "max_tf", "min_len", "n")
        return written(rows.groupBy("group").applyInArrow(run, "block long, bounds binary, held binary"))

    def _scores(self, m: dict, asked: _Asked, postings: DataFrame, top_n: int, k1: float, b: float, zeros: bool = False, groups: DataFrame | None = None) -> DataFrame:
        """(query_id, doc, id, corpus_pos, score): of each group of living documents in the given postings the best top_n for each query.

        zeros: documents without a score too; else those above 0 alone.  groups: (group) of the postings, if these are of few.
        """
        mean, digits = _mean(m), DIGITS
        shared = self.store.spark.sparkContext.broadcast(asked)
        docs = self._alive(m, self._docs(m["segments"]).select("doc", "id", "corpus_pos", "len")).withColumn("group", F.floor(F.col("doc") / GROUP))

        def run(hits: pa.Table, living: pa.Table) -> pa.Table:
            own = shared.value
            living = living.combine_chunks().sort_by("doc")
            doc = living["doc"].to_numpy()
            score = np.zeros((len(doc), len(own.ids)))
            if hits.num_rows and len(doc):
                hits = hits.combine_chunks()
                sizes = hits["n"].to_numpy()
                pairs = _pairs(hits["data"].combine_chunks())
                of, tf = np.repeat(hits["block"].to_numpy(), sizes) + pairs[:, 0], pairs[:, 1].astype(float)
                term = np.repeat(hits["t"].to_numpy(), sizes)
                row = np.minimum(np.searchsorted(doc, of), len(doc) - 1)
                alive = doc[row] == of
                size = living["len"].to_numpy()[row]
                used, column = np.unique(term[alive], return_inverse=True)
                for i in range(0, len(doc), DOCUMENTS_AT_ONCE):
                    here = (row[alive] >= i) & (row[alive] < i + DOCUMENTS_AT_ONCE)
                    dense = np.zeros((min(DOCUMENTS_AT_ONCE, len(doc) - i), len(used)))
                    dense[row[alive][here] - i, column[here]] = (tf / (tf + k1 * (1 - b + b * size / mean)))[alive][here]
                    score[i : i + len(dense)] = (dense @ own.weights[used]).round(digits)
            place = living["corpus_pos"].to_numpy()
            order = np.argsort(place, kind="stable")
            best = order[np.argsort(-score[order], 0, kind="stable")[:top_n]]
            query = np.tile(np.arange(score.shape[1]), len(best))
            best = best.ravel()
            kept = zeros | (score[best, query] > 0)
            best, query = best[kept], query[kept]
            at = pa.array(best)
            asked_ids = pa.array(own.ids, kind).take(pa.array(query))
            return pa.table({"query_id": asked_ids, "doc": living["doc"].take(at), "id": living["id"].take(at), "corpus_pos": living["corpus_pos"].take(at), "score": score[best, query] + 0.0})

        kind = pa.int64() if all(isinstance(q, int) for q in asked.ids) else pa.string()
        schema = f"query_id {'long' if kind == pa.int64() else 'string'}, doc long, id {dict(docs.dtypes)['id']}, corpus_pos long, score double"
        given = postings.select("group", "t", "block", "n", "data").groupBy("group")
        return given.cogroup((docs if groups is None else docs.join(groups, "group", "left_semi")).groupBy("group")).applyInArrow(lambda key, x, y: run(x.drop(["group"]), y.drop(["group"])), schema)

    def _least(self, m: dict, asked: _Asked, bounds: DataFrame, top_n: int, k1: float, b: float) -> np.ndarray:
        """Of each query a score that top_n documents reach, 0 where the first blocks hold fewer."""
        width, most = len(asked.ids), FIRST_BLOCKS

        def firsts(given):
            for batch in filter(len, given):
                blocks = batch.column(0).to_numpy()
                order = np.argsort(blocks)
                bound = _matrix(batch.column(1), "<f8", width)[order]
                best = np.argsort(-bound, 0, kind="stable")[:most]
                query = np.tile(np.arange(width), len(best))
                best = best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(blocks[order][best]), pa.array(bound[best, query])], ["query", "block", "bound"])

        best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        first = bounds.select("block", "bounds").mapInArrow(firsts, "query int, block long, bound double").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= FIRST_BLOCKS)
        named = self.store.spark.createDataFrame([(r[0],) for r in first.select("block").distinct().collect()], "block long")  # FIRST_BLOCKS a query
        by = Window.partitionBy("query_id").orderBy(F.desc("score"))
        postings = self._postings(m, asked).join(F.broadcast(named), "block", "left_semi")
        scored = self._scores(m, asked, postings, top_n, k1, b, groups=F.broadcast(named.select(F.floor(F.col("block") / GROUP).alias("group")).distinct()))
        known = {r["query_id"]: r["score"] for r in scored.withColumn("n", F.row_number().over(by)).filter(F.col("n") == top_n).collect()}  # a row a query
        return np.array([known.get(q, 0.0) for q in asked.ids])

    def _survivors(self, asked: _Asked, bounds: DataFrame, least: np.ndarray) -> DataFrame:
        """(block): those that reach `least` for any query."""
        width = len(asked.ids)

        def run(given):
            for batch in filter(len, given):
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(_reaches(_matrix(batch.column(1), "<f8", width), least).any(1)))], ["block"])

        return written(bounds.select("block", "bounds").mapInArrow(run, "block long"))

    def search(self, queries: DataFrame, top_n: int, version: int | None = None, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
        """(query_id, id, score, rank, corpus_pos): the best top_n documents of each query (query_id, text), a stated set."""
        m = self._read(version)
        docs = self._alive(m, self._docs(m["segments"]).select("doc", "id", "corpus_pos"))
        every = queries.select("query_id").distinct()
        if m["mean_idf"] < 0:  # the average term is in more than half of the documents: those without a score may be the best
            found = None
            for asked in self._asked(m, queries, k1, epsilon):
                one = self._scores(m, asked, self._postings(m, asked), top_n, k1, b, zeros=True)
                found = one if found is None else found.unionByName(one)
        else:
            found = None
            for asked in self._asked(m, queries, k1, epsilon):
                postings, groups = self._postings(m, asked), None
                if len(asked.ids) <= FEW:
                    bounds = self._bounds(m, asked, k1, b)
                    survivors = self._survivors(asked, bounds, self._least(m, asked, bounds, top_n, k1, b))
                    postings = postings.join(survivors, "block", "left_semi")
                    groups = survivors.select(F.floor(F.col("block") / GROUP).alias("group")).distinct()
                one = self._scores(m, asked, postings, top_n, k1, b, groups=groups)
                found = one if found is None else found.unionByName(one)
        first = docs.orderBy("corpus_pos").limit(top_n)
        if found is None:
            filler = every.crossJoin(F.broadcast(first))
            found = filler.withColumn("score", F.lit(0.0))
        else:
            # queries with fewer than top_n scores above 0: their next documents are among the first top_n of all
            found = written(found)
            enough = found.groupBy("query_id").count().filter(F.col("count") >= top_n)
            filler = every.join(enough, "query_id", "left_anti").crossJoin(F.broadcast(first)).join(found.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
            found = found.unionByName(filler.withColumn("score", F.lit(0.0)))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_pos")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n).select("query_id", "id", "score", "rank", "corpus_pos")

    def reading(self, queries: DataFrame, top_n: int, version: int | None = None) -> DataFrame:
        """(query_id, blocks, blocks_read, postings, postings_read): of what the terms of each query have, what a search for it takes apart by bounds."""
        m = self._read(version)
        kinds = dict(queries.dtypes)["query_id"]
        out = self.store.spark.createDataFrame([], f"query_id {kinds}, blocks long, blocks_read long, postings long, postings_read long")
        kept = ("blocks", "blocks_read", "postings", "postings_read")
        for asked in self._asked(m, queries, K1, EPSILON):
            bounds = self._bounds(m, asked, K1, B)
            least, width = self._least(m, asked, bounds, top_n, K1, B), len(asked.ids)

            def run(given, least=least, width=width):
                for batch in filter(len, given):
                    held = _matrix(batch.column(1), "<i4", width).astype(np.int64)
                    read = (held > 0) & _reaches(_matrix(batch.column(0), "<f8", width), least)
                    sums = [(held > 0).sum(0), read.sum(0), held.sum(0), (held * read).sum(0)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *(pa.array(x) for x in sums)], ["query", *kept])

            sums = bounds.select("bounds", "held").mapInArrow(run, "query int, " + ", ".join(f"{c} long" for c in kept)).groupBy("query").agg(*[F.sum(c).alias(c) for c in kept])
            names = self.store.spark.createDataFrame(list(enumerate(asked.ids)), f"query int, query_id {kinds}")
            out = out.unionByName(sums.join(F.broadcast(names), "query").drop("query"))  # QUERIES_AT_ONCE rows
        return out
