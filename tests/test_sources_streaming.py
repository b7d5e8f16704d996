"""Files as tables, and streams that give what a batch gives."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import chunking, parser
from corpuscle.sources import files
from corpuscle.streaming import jobs


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_decode():
    assert files.decode_text("消防".encode()) == "消防"
    assert files.decode_text("消防".encode("gbk")) == "消防"
    assert files.decode_text("𠀀".encode("gb18030")) == "𠀀"
    with pytest.raises(ValueError):
        files.decode_text(b"\xff\xff\xff")


def test_extract(spark, tmp_path):
    for name, content in (("a.txt", "消防".encode("gbk")), ("b.TXT", "plain".encode()), ("c.docx", docx(" 标题 ", "", "第一条 正文")), ("d.csv", b"x"), ("e.pdf", b"scan"), ("f.docx", b"broken")):
        (tmp_path / name).write_bytes(content)
    extractors = files.EXTRACTORS | {"pdf": lambda c: files.pdf_text(c, lambda b: ["short"])}
    got = {r["filename"]: r for r in files.extract_text(files.read_binary(spark, str(tmp_path)), extractors).collect()}
    assert {n: got[n]["text"] for n in ("a.txt", "b.TXT", "c.docx")} == {"a.txt": "消防", "b.TXT": "plain", "c.docx": "标题\n第一条 正文"}
    assert all(got[n]["text"] is None and got[n]["error"] for n in ("d.csv", "e.pdf", "f.docx"))
    good, bad = files.accepted(files.read_binary(spark, str(tmp_path)))
    assert good.count() == 5 and bad.first()["reason"] == "suffix"


def test_query_sets_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("q", ["a"], "short", ["t"], [], ["c"], "a")], "q string, gold array<string>, kind string, file_types array<string>, provinces array<string>, cities array<string>, doc string")
    (tmp_path / "q.json").write_text('[{"q": "问", "gold": ["a"], "kind": "short", "provinces": []}]', "utf-8")
    assert files.read_queries(spark, str(tmp_path / "q.json")).first()["q"] == "问"
    files.write_queries(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    for _ in range(2):
        files.write_report(spark.createDataFrame([("line",)], "value string"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 2


def test_host_metrics(spark):
    mem = spark.createDataFrame([("MemTotal:  2048 kB",), ("junk",)], "value string")
    assert files.meminfo(mem).collect() == [("MemTotal", 2.0)]
    cpu = spark.createDataFrame([("cpu 10 0 10 80 0", "cpu 30 0 20 150 0")], "a string, b string")
    assert cpu.select(files.cpu_percent(F.col("a"), F.col("b")).alias("p")).first()["p"] == pytest.approx(30.0)
    assert files.healthy(mem)


def test_ingest_stream(spark, tmp_path):
    land, out = tmp_path / "land", tmp_path / "out"
    land.mkdir()
    (land / "a.txt").write_text("第一行。\n第二行。", "utf-8")
    (land / "bad.txt").write_bytes(b"\xff\xff\xff")

    def process(batch):
        texts = files.extract_text(batch)
        states = texts.select("filename", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), "error")
        rows = texts.filter("text IS NOT NULL").select("filename", "text", *[F.lit("").alias(c) for c in ("file_type", "region", "city")])
        return chunking.chunk_articles(parser.parse(rows)), states

    def run():
        q = jobs.ingest(jobs.file_stream(spark, str(land)), process, str(out), str(tmp_path / "cp"))
        q.awaitTermination(120)

    run()
    assert spark.read.parquet(f"{out}/chunks").count() == 1
    assert {r["filename"]: r["status"] for r in spark.read.parquet(f"{out}/states").collect()} == {"a.txt": "ready", "bad.txt": "failed"}
    run()  # nothing new
    assert spark.read.parquet(f"{out}/states").count() == 2
    (land / "c.txt").write_text("新文件。", "utf-8")
    run()
    assert spark.read.parquet(f"{out}/chunks").count() == 2


def test_event_windows_on_a_stream(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), rows.schema)
    q = jobs.event_windows(stream, late="1 day").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = sorted(map(tuple, jobs.event_windows(rows).collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == batch


def test_queue(spark):
    rows = spark.createDataFrame([(1, 5, "queued"), (2, 3, "queued"), (3, 1, "processing"), (4, 2, "failed")], "id long, created_at int, status string")
    assert jobs.claim(rows).first()["id"] == 2
    assert jobs.claim(jobs.recover(rows)).first()["id"] == 3
    again = jobs.retry(rows, spark.createDataFrame([(4,), (3,)], "id long"))
    assert {r["id"]: r["status"] for r in again.collect()} == {1: "queued", 2: "queued", 3: "processing", 4: "queued"}


def test_run_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "x"), (2, 3, "y")], "id long, created_at int, body string")
    rows.write.parquet(str(tmp_path / "in"))
    work = lambda df: df.select("id", F.upper("body").alias("answer"))
    jobs.run_jobs(jobs.table_stream(spark, str(tmp_path / "in"), "id long, created_at int, body string"), work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "answer").collect())) == [(1, "X"), (2, "Y")]
