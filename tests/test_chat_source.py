"""Chat completions as a source, against a server that breaks, stalls and refuses."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corpuscle.sources import chat as C

SEEN: Counter = Counter()
LOCK = threading.Lock()


class Stub(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.0"

    def log_message(self, *_):
        pass

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = asked["messages"][-1]["content"]
        with LOCK:
            SEEN[text] += 1
            first = SEEN[text] == 1
        if text == "forbidden" or (text == "overloaded" and first) or text == "down":
            self.send_response(403 if text == "forbidden" else 503)
            self.end_headers()
            self.wfile.write("no: é".encode())
            return
        self.send_response(200)
        self.end_headers()
        if not asked["stream"]:
            body = {"choices": [{"message": {"role": "assistant", "content": f"plain {text}"}, "finish_reason": "length"}]}
            self.wfile.write(json.dumps({} if text == "odd" else body).encode())
            return
        say = lambda x: (self.wfile.write(f"data: {x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)}\n\n".encode()), self.wfile.flush())
        say({"choices": [{"delta": {"role": "assistant"}}]})
        self.wfile.write(b": keep alive\n\nevent: x\n")
        say({"choices": [{"delta": {"content": "Grüße "}}]})
        if first and text == "breaks":
            return
        if first and text == "garbled":
            say("{not json")
            return
        if first and text == "stalls":
            time.sleep(3)
        say({"choices": [{"delta": {"content": None}}]})
        say({"choices": [{"delta": {"content": text + " 安全"}}]})
        say({"choices": [{"delta": {}, "finish_reason": "stop"}]})
        say("[DONE]")


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def whole(key, text):
    return [(key, 0, "role", "assistant", None, None), (key, 1, "delta", None, "Grüße ", None), (key, 2, "delta", None, f"{text} 安全", None), (key, 3, "finish", None, None, "stop"), (key, 4, "end", None, None, None)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def jobs(spark, texts):
    return spark.createDataFrame([(i, [("user", t)] if t is not None else None) for i, t in enumerate(texts)], "id long, messages array<struct<role:string,content:string>>").repartition(3)


def test_streams_with_failures(spark, url):
    SEEN.clear()
    texts = ["hello", "breaks", "garbled", "stalls", "overloaded", "forbidden", "down", None]
    client = C.Client(url, timeout=1.0, tries=2, pause=0.05)
    got = rows(C.completions(jobs(spark, texts), client))
    want = [r for i, t in enumerate(texts[:5]) for r in whole(str(i), t)]
    errors = [("5", 0, "error", None, "HTTP 403: no: é", None), ("6", 0, "error", None, "HTTP 503: no: é", None), ("7", 0, "error", None, "no messages", None)]
    assert got == sorted(want + errors)
    assert SEEN["breaks"] == SEEN["stalls"] == SEEN["overloaded"] == SEEN["down"] == 2 and SEEN["forbidden"] == SEEN["hello"] == 1
    SEEN.clear()
    told = {r["id"]: tuple(r)[1:] for r in C.answers(spark.createDataFrame(got, C.EVENTS)).collect()}
    assert told["1"] == ("Grüße breaks 安全", "stop", None) and told["6"] == (None, None, "HTTP 503: no: é")


def test_plain_answers(spark, url):
    got = rows(C.completions(jobs(spark, ["hello", "odd"]), C.Client(url, stream=False, pause=0.05)))
    assert got == [("0", 0, "role", "assistant", None, None), ("0", 1, "delta", None, "plain hello", None), ("0", 2, "finish", None, None, "length"), ("0", 3, "end", None, None, None), ("1", 0, "error", None, "no answer in {}", None)]


def test_no_server():
    (row,) = C.Client("http://127.0.0.1:9", tries=2, pause=0.01).ask("a", [{"role": "user", "content": "x"}])
    assert row[2] == "error" and "refused" in row[4]


def line(key, text):
    return json.dumps({"id": key, "messages": [{"role": "user", "content": text}]})


def test_data_source(spark, url, tmp_path):
    C.register(spark)
    SEEN.clear()
    (tmp_path / "asked.jsonl").write_text("\n".join([line("a", "one"), "not json", "", line("b", "breaks"), line("c", "two")]) + "\n" + line("d", "unfinished line"))
    df = spark.read.format("chat").option("url", url).option("pause", "0.01").option("partitions", "3").load(f"file://{tmp_path}/asked.jsonl")
    assert rows(df) == sorted([*whole("a", "one"), *whole("b", "breaks"), *whole("c", "two"), ("1", 0, "error", None, "no request in this line", None)])


def test_stream_of_requests(spark, url, tmp_path):
    """Lines that are added later are asked in a later batch, and none twice, over a restart too."""
    C.register(spark)
    SEEN.clear()
    asked = tmp_path / "asked.jsonl"

    def run():
        stream = spark.readStream.format("chat").option("url", url).option("pause", "0.01").load(f"file://{asked}")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
        return q

    asked.write_text(line("a", "first") + "\n")
    q = run()
    try:
        q.processAllAvailable()
        with asked.open("a") as f:
            f.write(line("b", "second") + "\n")
        q.processAllAvailable()
    finally:
        q.stop()
    with asked.open("a") as f:
        f.write(line("c", "third") + "\n")
    q = run()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.read.schema(C.EVENTS).parquet(str(tmp_path / "out"))) == sorted(whole("a", "first") + whole("b", "second") + whole("c", "third"))
    assert SEEN == {"first": 1, "second": 1, "third": 1}
