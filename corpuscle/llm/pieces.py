"""SentencePiece encoding and decoding by a table of distinct chunks.

In a model whose pieces hold the white-space marker at their beginning only, no merge crosses from a letter to a marker: a text
falls into chunks (markers and the letters after them) that are segmented independently of one another.  A slice of texts
is cut into chunks by array operations; its distinct chunks are looked up in the task's table, the new ones are segmented by
the library, once each, and the ids are joined back by the chunks' positions.  Decoding takes whole lists of ids to the library, which costs a sixth of
encoding and less than looking chunks up again.  Whether a model allows this is read from its pieces and tried on a sample
of its behaviour; one that does not, or normalizes texts, is applied to whole texts instead.

The table is a task's own, so nothing is shuffled or broadcast, a chunk that a third of all rows hold costs one look-up a slice,
and a lost task is simply run again.  It is bounded by the bytes in it and begun anew when it is full; chunks of more than LONG
bytes (texts without blanks) are segmented where they stand.

Defined results: null and empty texts have the begin and end ids alone and decode to the empty text; null or repeated
doc_ids and rows are encoded like others; very long texts are encoded whole; the marker itself in a text is taken for a
blank, as the library does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import slices, text_buffer, trimmed

MARK = "▁"
LONG = 64  # bytes of a chunk that is kept
TABLE_BYTES = 128 << 20
SLICE = 1 << 22
TOGETHER = 256  # chunks that the library gets as one text
_ENTRY = 180  # bytes that an entry takes beside its chunk
_LOADED: dict[str, "Pieces"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model, and the table of the chunks met so far."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = table_bytes
        self.kind = np.dtype("<u2") if self.own.get_piece_size() <= 1 << 16 else np.dtype("<u4")
        self.begin, self.end = self.own.bos_id(), self.own.eos_id()
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.bare = np.array([p.strip(MARK) == "" for p in pieces])
        leading = not any(MARK in p.lstrip(MARK) for p in pieces)
        probe = "a  ▁b\t\n cé ﬁ Ａ é " + MARK
        self.by_chunk = leading and self.own.decode(self.own.encode(probe)) == probe.replace(MARK, " ") and self._whole([probe])[0] == self._joined([probe])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1) if texts else []

    def _joined(self, texts: list[str]) -> list[int]:
        self.forget()
        return self.chunked(pa.array(texts, pa.string()))[0].tolist()

    def forget(self) -> None:
        self.table: dict[bytes, int] = {}
        self.at = self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)
        self.held = 0

    def _segmented(self, blanks: list[bytes], chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of blanks, then of chunks with letters, end to end, and how many each has.

        All begin with a blank, which the library puts before a text itself.  Chunks are segmented many to a text; the next
        begins at a piece with a marker after one with more than markers.
        """
        alone = [self.own.piece_to_id(MARK)]
        ids = [self._whole([" " * (len(c) - 1)])[0] if len(c) > 1 else alone for c in blanks]
        texts = [b"".join(chunks[i : i + TOGETHER])[1:].decode("utf-8", "surrogatepass") for i in range(0, len(chunks), TOGETHER)]
        of_chunks = self._whole(texts)
        flat = np.fromiter(chain.from_iterable(of_chunks), self.kind, sum(map(len, of_chunks)))
        cut = np.flatnonzero(self.marked[flat] & np.concatenate([[True], ~self.bare[flat[:-1]]])) if len(flat) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([cut, [len(flat)]]))
        if len(cut) != len(chunks):
            raise ValueError("pieces do not begin where chunks do")
        return np.concatenate([np.array([x for i in ids for x in i], self.kind), flat]), np.concatenate([np.array([len(i) for i in ids], np.int64), sizes])

    def _places(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and the first of each text."""
        marked = pc.replace_substring(texts.fill_null(""), MARK, " ")
        spaced = pc.if_else(pc.equal(pc.binary_length(marked), 0), "", pc.binary_join_element_wise(" ", marked, ""))
        raw, off = text_buffer(spaced)
        blank = raw == 0x20
        first = np.zeros(len(raw) + 1, bool)
        first[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(blank & (first[:-1] | ~np.concatenate([[False], blank[:-1]])))
        offsets = np.concatenate([start, [len(raw)]]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return chunks, np.searchsorted(start, off)

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (and the last's end)."""
        chunks, first = self._places(texts)
        coded = chunks.dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if self.held > self.most:
            self.forget()
        place = np.fromiter((self.table.get(c, -1) for c in distinct), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            # runs of blanks, short chunks, long ones
            new = new[np.argsort([len(distinct[k]) if distinct[k].strip(b" ") else 0 for k in new.tolist()], kind="stable")]
            named = [distinct[k] for k in new.tolist()]
            blanks = bisect.bisect_left(named, 1, key=lambda c: len(c.strip(b" ")))
            kept = bisect.bisect_right(named, LONG, lo=blanks, key=len)
            ids, sizes = self._segmented(named[:blanks], named[blanks:])
            place[new] = len(self.sizes) + np.arange(len(new))
            self.table.update(zip(named[:kept], place[new[:kept]].tolist(), strict=True))
            self.held += sum(map(len, named[:kept])) + kept * _ENTRY
            at, sizes = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes) - sizes]), np.concatenate([self.sizes, sizes])
            pool = np.concatenate([self.pool, ids])
            short = len(self.sizes) + kept
            self.at, self.sizes, self.pool = at[:short], sizes[:short], pool[: at[short] if short < len(at) else len(pool)]
        else:
            at, sizes, pool = self.at, self.sizes, self.pool
        at, sizes = at[place][code], sizes[place][code]
        ends = np.cumsum(sizes)
        out = pool[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[first]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, the begin and end ids around them."""
        if not self.by_chunk:
            return [np.array([self.begin, *ids, self.end], self.kind) for ids in self._whole([t or "" for t in texts.to_pylist()])]
        ids, cuts = self.chunked(texts)
        begin, end = np.array([self.begin], self.kind), np.array([self.end], self.kind)
        return [np.concatenate([begin, ids[a:b], end]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.own.decode([i.tolist() for i in ids], num_threads=1) if ids else []


def loaded(path: str) -> Pieces:
    """A worker's own copy of a model."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids): begin id, pieces and end id of each text of docs (doc_id, text)."""
    return _over(docs, model, "doc_id long, ids array<int>", lambda own, ids: [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))])


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, decoded) of any lists of ids (doc_id, ids); null lists and null ids in them decode to nothing."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            texts = [loaded(path).own.decode([i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(trimmed(run), "doc_id long, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs (doc_id, text)."""

    def columns(own: Pieces, ids: list[np.ndarray]) -> list[pa.Array]:
        texts = own.decode(ids)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(i.astype("<u4").tobytes()) for i in ids], pa.string()), pa.array([sha(t.encode("utf-8", "surrogatepass")) for t in texts], pa.string())]

    return _over(docs, model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _over(docs: DataFrame, model: str | None, schema: str, columns) -> DataFrame:
    path = model or default_model()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE):
                own = loaded(path)
                ids = own.encode(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns(own, ids)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def op11_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
