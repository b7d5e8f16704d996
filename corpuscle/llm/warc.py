"""WARC archives: written by tasks, and read back by byte ranges.

Writing: each task writes one file of gzip members, a record a member, into the shared folder under a name of its own;
the names of the attempts that succeeded are kept in a table, so a lost or repeated task leaves no record twice.
Reading: files are dealt out as byte ranges.  A task looks for gzip magic in its range, takes a place as a member's start
only where the header decoded from there is a WARC header, owns the records that start inside its range, and reads past
its end to finish the last one.

Defined results: a null html is the empty payload; among equal payloads all rows with the least page_id are responses and
the others revisit it; rows with a null page_id are revisits of it if there is one, else responses; a null url has no
target; repeated rows get a record each; very long payloads are written and read whole; an empty table gives no archive and
an empty result; other columns are ignored.  Archives of other tools are read too, with records of all types.  Folders are
opened through Arrow's file systems (local, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import materialize, new_path

LEAST_BYTES = 0
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 18
MOST_TASKS = 100_000  # beyond, a task has several ranges
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def decide(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with their digest and, for a revisit, the page it refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("sha1", F.sha1(payload))
    long_enough = F.octet_length(payload) >= least
    owners = keyed.filter(long_enough).groupBy("sha1").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "owner")
    joined = keyed.join(materialize(owners, "warc-owners"), "sha1", "left")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit's block has the headers alone."""
    digest, revisit = digest32(payload), refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{p}/{digest}')}>"
    headers = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        headers.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        block += payload
    headers += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_warc(decided: DataFrame, folder: str) -> DataFrame:
    """Archives of all rows; returns the table (path, bytes, records) of the files that count."""

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        path, out, records = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    out.write(gzip_member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py())))
                    records += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([fs.get_file_info(path).size], pa.int64()), "records": pa.array([records], pa.int64())})

    return materialize(decided.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Range:
    """Bytes of a file from any place on, read in steps."""

    def __init__(self, stream, start: int) -> None:
        self.stream, self.at, self.data, self.done = stream, start, b"", False
        stream.seek(start)

    def more(self) -> bool:
        got = self.stream.read(READ_BYTES)
        self.data += got
        self.done = not got
        return not self.done

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def need(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n


def header_at(data: bytes) -> bool:
    """Whether a gzip member starts here whose content starts as a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(stream, start: int, stop: int):
    """The decoded records that start in [start, stop)."""
    own = _Range(stream, start)
    while own.at < stop:
        found = own.data.find(MAGIC)
        if found < 0:
            keep = min(len(own.data), len(MAGIC) - 1)
            own.drop(len(own.data) - keep)
            if own.at >= stop or not own.more():
                return
            continue
        own.drop(found)
        if own.at >= stop:
            return
        own.need(4096)
        if not header_at(own.data[:4096]):
            own.drop(1)
            continue
        z, parts = zlib.decompressobj(31), []
        first, ended = own.at, False
        try:
            while not ended:
                if not own.data and not own.more():
                    raise zlib.error("a member is cut short")
                parts.append(z.decompress(own.data))
                ended = z.eof
                own.drop(len(own.data) - len(z.unused_data) if ended else len(own.data))
        except zlib.error as e:
            raise ValueError(f"the record at byte {first} can't be read: {e}") from e
        yield first, b"".join(parts)


def _fields(head: bytes, encoding: str) -> dict[str, str]:
    """Header fields below a first line; a line that starts with a blank goes on from the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode(encoding, "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """Headers and payload of a record of any type: of an HTTP message what is below its headers, else the whole block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _fields(head, "utf-8")
    size = headers.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    http, payload = {}, block
    if headers.get("content-type", "").lower().startswith("application/http"):
        message, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(message, "latin-1")
    return {"headers": headers, "http": http, "payload": payload}


def described(r: dict, place: str) -> tuple:
    """(type, url, page_id, refers_to, size, digest) of a parsed record.

    A revisit tells size and digest of what it refers to.  Records of other tools may lack any header; the digest is then
    computed.  A record of our own whose payload is not what its digest says is an error; others may have digested other bytes.
    """
    h, kind = r["headers"], r["headers"].get("warc-type", "")
    page, other = h.get("x-page") or None, h.get("x-refers-to-page") or None
    said = h.get("warc-payload-digest", "")
    size, digest = len(r["payload"]), digest32(r["payload"])
    if kind == "revisit":
        told = r["http"].get("content-length", "")
        size, digest = (int(told) if told.isdigit() else None), said.removeprefix("sha1:") or None
    elif "x-page" in h and said.removeprefix("sha1:") != digest:
        raise ValueError(f"{place}: the payload is not what its digest says")
    return kind, h.get("warc-target-uri"), page and int(page), other and int(other), size, digest


READ = "path string, offset long, record_type string, url string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """One row a record of the files (path, bytes), in ranges of range_bytes."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("bytes")))
    # a task a range: a given number of partitions is not put together again, however small their rows are
    many = files.agg(F.sum(F.ceil(F.greatest("bytes", F.lit(1)) / range_bytes))).first()[0] or 1
    tasks = ranges.repartition(min(int(many), MOST_TASKS), F.col("path"), F.col("start"))

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, start, stop in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                rows = []
                with fs.open_input_file(path) as stream:
                    for offset, raw in members(stream, start, stop):
                        r = parse_record(raw)
                        rows.append((path, offset, *described(r, f"{path}, byte {offset}"), r["payload"] if with_payload else None))
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return tasks.mapInArrow(run, READ)


def op4_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    files = write_warc(decide(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), folder)
    return read_warc(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, min(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(p.h, 1 + 5 * CAST(g AS INT), 5))::BIGINT >> s) & 31) + 1 AS INT), 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON p.h = o.h
"""
