"""Chat completions over HTTP as a source: plain answers and event streams as rows.

`completions` asks for each row of a frame; the data source `chat` (after `register`) reads requests from a file of JSON lines,
in partitions as a batch, or as a stream whose offset is the number of lines that have been read.  Rows of an answer:

    kind    n       role        content     finish
    role    0       assistant
    delta   1...                a part
    finish  last-1                          why it ended (stop, length, ...)
    end     last

A plain answer has one delta.  Rows are given out only when the whole answer is there: a connection that breaks, is refused,
times out, or answers 5xx or 429 is tried again from the start, `tries` times in all, so no part comes twice.  What fails for
good is one row of the kind error, with why in `content`; it stops no other request.

Defined results: a request without messages, or one that is no JSON, is an error row; lines of a stream that are no data
(comments, blanks, events' names) are skipped; data that is no JSON, or an answer without an end or a finish, is a broken
connection; null contents say nothing; repeated ids are asked for each.
"""

from __future__ import annotations

import http.client
import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PATH = "/v1/chat/completions"
DONE = "[DONE]"
EVENTS = "id string, n int, kind string, role string, content string, finish string"
NAMES = [c.split()[0] for c in EVENTS.split(", ")]
MOST_ERROR = 300  # characters of an answer that an error tells


class Refused(RuntimeError):
    """An answer that asking again does not change."""


class Broken(RuntimeError):
    """A failure that may pass."""


@dataclass
class Client:
    """What is asked where.  timeout: seconds for connecting and for each read; pause: seconds before another try, doubled each time."""

    url: str
    model: str = "default"
    stream: bool = True
    max_tokens: int = 1024
    timeout: float = 60.0
    tries: int = 3
    pause: float = 0.5

    def ask(self, key: str | None, messages: list[dict] | None) -> list[tuple]:
        """All rows of one answer, or its error row."""
        if not messages:
            return [(key, 0, "error", None, "no messages", None)]
        why = ""
        for attempt in range(max(self.tries, 1)):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1))
            try:
                return [(key, n, *rest) for n, rest in enumerate(self._events(messages))]
            except Refused as e:
                return [(key, 0, "error", None, str(e), None)]
            except (Broken, OSError, http.client.HTTPException) as e:
                why = str(e) or type(e).__name__
        return [(key, 0, "error", None, why, None)]

    def _events(self, messages: list[dict]) -> Iterator[tuple]:
        """(kind, role, content, finish)"""
        parts = urlsplit(self.url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        link = kind(parts.hostname, parts.port, timeout=self.timeout)
        try:
            body = json.dumps({"model": self.model, "messages": messages, "stream": self.stream, "max_tokens": self.max_tokens})
            link.request("POST", parts.path.rstrip("/") + PATH, body.encode(), {"Content-Type": "application/json"})
            answer = link.getresponse()
            if answer.status != 200:
                said = answer.read(4 * MOST_ERROR).decode("utf-8", "replace")[:MOST_ERROR]
                raise (Broken if answer.status >= 500 or answer.status == 429 else Refused)(f"HTTP {answer.status}: {said}")
            yield from self._streamed(answer) if self.stream else self._plain(answer)
        finally:
            link.close()

    def _plain(self, answer) -> Iterator[tuple]:
        raw = answer.read()
        try:
            one = json.loads(raw)["choices"][0]
            message = one["message"]
        except (ValueError, LookupError, TypeError):
            raise Refused(f"no answer in {raw.decode('utf-8', 'replace')[:MOST_ERROR]}") from None
        yield "role", message.get("role") or "assistant", None, None
        if message.get("content"):
            yield "delta", None, message["content"], None
        yield "finish", None, None, one.get("finish_reason") or "stop"
        yield "end", None, None, None

    def _streamed(self, answer) -> Iterator[tuple]:
        finished = False
        for raw in answer:  # lines
            line = raw.decode("utf-8", "replace").strip()
            if not line.startswith("data:"):
                continue
            data = line[5:].strip()
            if data == DONE:
                if not finished:
                    yield "finish", None, None, None
                yield "end", None, None, None
                return
            try:
                chunk = json.loads(data)
                one = (chunk.get("choices") or [{}])[0]
                delta = one.get("delta") or {}
            except (ValueError, AttributeError):
                raise Broken(f"no chunk: {data[:MOST_ERROR]}") from None
            if chunk.get("error"):
                raise Refused(str(chunk["error"])[:MOST_ERROR])
            if delta.get("role"):
                yield "role", delta["role"], None, None
            if delta.get("content"):
                yield "delta", None, delta["content"], None
            if one.get("finish_reason"):
                finished = True
                yield "finish", None, None, one["finish_reason"]
        raise Broken("the stream ended without an end")


def _arrays(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], NAMES)


def completions(jobs: DataFrame, client: Client) -> DataFrame:
    """EVENTS of jobs (id, messages array<struct<role, content>>), asked one after another in each partition.

    Other than pure functions, a request may be repeated when a task is; write the rows down before they are used twice.
    """

    def run(batches):
        for batch in batches:
            for key, messages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _arrays(client.ask(key, messages))

    return jobs.select(F.col("id").cast("string").alias("id"), "messages").mapInArrow(run, EVENTS)


def answers(events: DataFrame) -> DataFrame:
    """(id, answer, finish, error) of EVENTS with different ids."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("n", "content")))), lambda x: x["content"]), "")
    error = F.max(F.when(F.col("kind") == "error", F.col("content")))
    return events.groupBy("id").agg(F.when(error.isNull(), said).alias("answer"), F.max("finish").alias("finish"), error.alias("error"))


# ---------------------------------------------------------------------------- the data source


def _lines(path: str, first: int, last: int | None) -> Iterator[tuple[int, bytes]]:
    """Whole lines of a file, by number."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as stream:
        held, n = b"", 0
        while chunk := stream.read(1 << 20):
            *whole, held = (held + chunk).split(b"\n")
            for line in whole:
                if last is not None and n >= last:
                    return
                if n >= first:
                    yield n, line
                n += 1


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Requests:
    def __init__(self, options: dict) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.parts = given["path"], int(given.get("partitions", "4"))
        kinds = {k: type(v) for k, v in asdict(Client("")).items()}
        own = {k: given[k.replace("_", "")] if k.replace("_", "") in given else given[k] for k in kinds if k in given or k.replace("_", "") in given}
        self.client = Client(**{k: v.lower() == "true" if kinds[k] is bool else kinds[k](v) for k, v in own.items()})

    def ranges(self, first: int, last: int) -> list[_Range]:
        step = max(1, -(-(last - first) // self.parts))
        return [_Range(i, min(i + step, last)) for i in range(first, last, step)]

    def count(self) -> int:
        return sum(1 for _ in _lines(self.path, 0, None))

    def read(self, partition: _Range):
        for n, line in _lines(self.path, partition.first, partition.last):
            if not line.strip():
                continue
            try:
                asked = json.loads(line)
                key, messages = str(asked.get("id", n)), asked.get("messages")
            except (ValueError, AttributeError):
                yield (str(n), 0, "error", None, "no request in this line", None)
                continue
            yield from self.client.ask(key, messages)


class _Reader(_Requests, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return self.ranges(0, self.count()) or [_Range(0, 0)]


class _StreamReader(_Requests, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"lines": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"lines": self.count()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.ranges(start["lines"], end["lines"])

    def commit(self, end: dict) -> None:
        pass


class ChatSource(DataSource):
    """Options: path (a file of lines {"id": ..., "messages": [...]}, to which lines are only added), partitions, and the fields of Client."""

    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatSource)
