"""Media columns: interleaved sequences of text and media, with payloads resolved through digests.

A page is parsed into one ordered array of structs: text items and media references, each with its place, a reference
with its caption.  Payloads lie once for each digest and written partition in a media table, as 8-bit grey PGM images 64
samples wide; references are resolved by a join on the digest, which moves features of fixed size, never payloads.

Defined results: a null text is the empty one; an empty text is stored as 64 zero bytes; equal texts share digest and
features; a null doc_id is kept; other columns are ignored; empty tables give empty results.  A reference to a digest that
is not stored keeps its place and caption, with null features; repeated rows and references get a row each; very long texts
are stored whole; items keep the order of the page, so there are no ties.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import CRC_TABLE_SQL, crc_sql, materialize, slices, text_buffer

WIDTH = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_SOURCE = re.compile(r"\bsrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "figure", "section", "article", "table", "tr", "td", "th", "blockquote", "pre", "body", "head", "html", "title", "ul", "ol", "figcaption"}
_MEDIA = {"img", "video", "audio", "source"}


def parse_sequence(html: str | None) -> list[dict]:
    """Text blocks and media references of a page in its order; a figure's caption, or else the alt text, goes with its media."""
    out: list[dict] = []
    words: list[str] = []
    figure: list[int] | None = None
    caption: list[str] | None = None

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    for m in _TOKEN.finditer(html or ""):
        _, close, tag, attributes, text = m.groups()
        if text is not None:
            (words if caption is None else caption).append(text)
        elif tag:
            tag = tag.lower()
            if tag == "figcaption" and figure is not None:
                if not close:
                    flush()
                    caption = []
                elif caption is not None:
                    said = " ".join(unescape("".join(caption)).split())
                    for i in figure:
                        out[i]["caption"] = said
                    caption = None
            elif tag in _MEDIA and not close:
                flush()
                source, alt = _SOURCE.search(attributes), _ALT.search(attributes)
                ref = unescape(next((x for x in source.groups() if x is not None), "")) if source else ""
                said = unescape(next((x for x in alt.groups() if x is not None), "")) if alt else None
                if figure is not None:
                    figure.append(len(out))
                out.append({"position": len(out), "kind": "media", "text": None, "digest": ref.rpartition(":")[2], "caption": said})
            elif tag in _BLOCKS:
                flush()
                if tag == "figure":
                    figure, caption = (None if close else []), None
    if caption is not None and figure:
        for i in figure:
            out[i]["caption"] = " ".join(unescape("".join(caption)).split())
    flush()
    return out


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def encode_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_pgm(media: bytes) -> bytes:
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if not m:
        raise ValueError("not an 8-bit PGM")
    n = int(m[1]) * int(m[2])
    payload = media[m.end() : m.end() + n]
    if len(payload) != n:
        raise ValueError("a PGM is cut short")
    return payload


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the shares of 8 bands in thousandths."""
    h = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(float)
    n, v = h.sum(), np.arange(256)
    mean = (h * v).sum() / n
    p = h[h > 0] / n
    bands = (1000 * h.reshape(8, 32).sum(1) / n).round().astype(int)
    return f"mean={mean:.4f};std={np.sqrt((h * (v - mean) ** 2).sum() / n):.4f};entropy={abs((p * np.log2(p)).sum()):.4f};bands={','.join(map(str, bands))}"


def _store(batches):
    """One media row for each digest of a task's batch."""
    for batch in batches:
        texts = batch.column(0)
        for i, j in slices(texts, 1 << 22):
            raw, off = text_buffer(texts.slice(i, j - i))
            seen, digests, sizes, media = set(), [], [], []
            for k in range(j - i):
                own = raw[off[k] : off[k + 1]].tobytes()
                digest = hashlib.sha256(own).hexdigest()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    sizes.append(len(own))
                    media.append(encode_pgm(padded(own)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["digest", "n_bytes", "media"])


def store_media(texts: DataFrame) -> DataFrame:
    """The media table of a column `text`, stored as Parquet."""
    return materialize(texts.select("text").mapInArrow(_store, "digest string, n_bytes long, media binary"), "media")


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    for batch in batches:
        rows = []
        for digest, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            form = media.as_py()
            payload = decode_pgm(form)
            rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """Features of the stored bytes, one row for each digest."""
    read = media.select("digest", "n_bytes", "media").mapInArrow(_features, FEATURES)
    return one_per_digest(read)


def one_per_digest(read: DataFrame) -> DataFrame:
    """Equal digests have equal features; hashed on (digest, a function of it), so that a later join can be split."""
    names = [c for c in read.columns if c != "digest"]
    return read.groupBy("digest", F.substring("digest", 1, 1).alias("_half")).agg(*[F.max(c).alias(c) for c in names]).drop("_half")


def page_of(text: Column, doc_id: Column) -> Column:
    """A page for a document: a lead, a cover that all pages share, a line, its own media by reference, and an end."""
    name = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    figure = lambda d, said: F.concat(F.lit('<figure><img src="sha256:'), d, F.lit('"><figcaption>'), said, F.lit("</figcaption></figure>"))
    own = F.concat(name, F.lit(" as samples"))
    return F.concat(F.lit("<article><p>"), name, F.lit("</p>"), figure(F.sha2(F.lit("").cast("binary"), 256), F.lit("cover")), F.lit("<p>its text</p>"), figure(digest, own), F.lit("<p>end</p></article>"))


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `sequence` for the column html."""
    names = pages.columns
    at = names.index(html)
    schema = pages.select("*", F.lit(None).cast(SEQUENCE).alias("sequence")).schema

    def parsed(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parse_sequence(x.as_py()) for x in batch.column(at)], kind)], [*names, "sequence"])

    return pages.mapInArrow(parsed, schema)


def resolve(sequenced: DataFrame, features: DataFrame, wanted: Column | str = "true") -> DataFrame:
    """One row for each media reference that `wanted` lets through, with its place and caption, joined to the features of its digest."""
    refs = sequenced.select("*", F.explode("sequence").alias("_item")).drop("sequence").filter(F.col("_item.kind") == "media").filter(wanted)
    refs = refs.select("*", "_item.digest", "_item.position", "_item.caption").drop("_item")
    return refs.join(features, "digest", "left")


def op10_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = media_features(store_media(docs))
    pages = docs.select("doc_id", page_of(F.col("text"), F.col("doc_id")).alias("html"))
    out = resolve(sequences(pages).drop("html"), features, F.col("_item.caption") != "cover")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


ORACLE = f"""
WITH t AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS tab),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS raw FROM documents),
p AS MATERIALIZED (SELECT doc_id, n_bytes, greatest({WIDTH}, (n_bytes + {WIDTH - 1}) // {WIDTH} * {WIDTH}) AS size, raw || repeat('00', CAST(greatest({WIDTH}, (n_bytes + {WIDTH - 1}) // {WIDTH} * {WIDTH}) - n_bytes AS BIGINT)) AS hex FROM d),
m AS (SELECT *, encode('P5' || chr(10) || '{WIDTH} ' || (size // {WIDTH}) || chr(10) || '255' || chr(10)) || unhex(hex) AS media FROM p),
b AS (SELECT doc_id, size, CAST('0x' || unnest(list_transform(range(size), lambda i: substr(hex, CAST(2 * i + 1 AS INT), 2))) AS INT) AS v FROM p),
c AS (SELECT doc_id, size, v, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT doc_id, size, sum(n * v) / size::DOUBLE AS mean, abs(sum(n / size::DOUBLE * log2(n / size::DOUBLE))) AS entropy FROM c GROUP BY doc_id, size),
f AS (SELECT c.doc_id, any_value(mean) AS mean, any_value(entropy) AS entropy, sqrt(sum(n * (v - mean) * (v - mean)) / any_value(c.size)) AS std, {", ".join(f"CAST(round_even(1000 * coalesce(sum(n) FILTER (v // 32 = {k}), 0)::DOUBLE / any_value(c.size), 0) AS INT) AS b{k}" for k in range(8))} FROM c JOIN e USING (doc_id) GROUP BY c.doc_id)
SELECT m.doc_id, n_bytes, size AS payload_bytes, sha256(unhex(hex)) AS payload_sha256, CAST({crc_sql("right(hex, 128)", "tab")} AS BIGINT) AS tail_crc32, octet_length(media) AS media_bytes, sha256(media) AS media_sha256,
  'mean=' || printf('%.4f', mean) || ';std=' || printf('%.4f', std) || ';entropy=' || printf('%.4f', entropy) || ';bands=' || concat_ws(',', {", ".join(f"b{k}" for k in range(8))}) AS feature, 3 AS position, 'document ' || m.doc_id || ' as samples' AS caption
FROM m JOIN f USING (doc_id), t
"""
