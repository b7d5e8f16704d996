"""Files as tables: bytes to text by format, query sets, reports, and landed uploads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T

SUFFIXES = ["txt", "docx", "pdf"]
MOST_BYTES = 20 << 20
LEAST_PDF_CHARS = 30
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_text(content: bytes) -> str:
    """UTF-8, else GBK, else GB18030, else an error."""
    for encoding in ("utf-8", "gbk", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("the text is in no known encoding")


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, stripped, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip() for p in root.iter(f"{_WORD}p"))
    out = "\n".join(p for p in paragraphs if p)
    if not out:
        raise ValueError("the document has no text")
    return out


def pdf_pages(content: bytes) -> list[str]:
    """A page's text through pypdf where that is installed."""
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def pdf_text(content: bytes, pages: Callable[[bytes], list[str]] = pdf_pages) -> str:
    out = "\n".join(pages(content)).strip()
    if len(out) < LEAST_PDF_CHARS:
        raise ValueError("the pdf has no text layer")
    return out


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": decode_text, "docx": docx_text, "pdf": pdf_text}


def register_extractor(suffix: str, extractor: Callable[[bytes], str]) -> None:
    EXTRACTORS[suffix] = extractor


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of all files under a path."""
    return spark.read.format("binaryFile").load(path).select(T.basename(F.col("path")).alias("filename"), "content", F.col("length").alias("size"))


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files (filename, content) with text and error; a file that can't be read has a null text and says why.

    Plain UTF-8 is decoded by the engine itself; only other bytes go through Python, in Arrow batches.
    """
    own = dict(extractors or EXTRACTORS)

    @F.pandas_udf("text string, error string")
    def run(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for s, c in zip(suffix, content, strict=True):
            try:
                if s not in own:
                    raise ValueError(f"files of type {s or 'none'} are not supported")
                rows.append((own[s](bytes(c)), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "error"])

    marked = files.withColumn("_suffix", T.suffix(F.col("filename")))
    native = (F.col("_suffix") == "txt") & F.is_valid_utf8(F.col("content").cast("string"))
    plain = marked.filter(native).withColumn("text", F.col("content").cast("string")).withColumn("error", F.lit(None).cast("string"))
    other = marked.filter(~F.coalesce(native, F.lit(False))).withColumn("_r", run("_suffix", "content")).select("*", "_r.text", "_r.error").drop("_r")
    return plain.unionByName(other).drop("_suffix")


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) uploads, by suffix and size."""
    reason = F.when(~T.suffix(F.col("filename")).isin(SUFFIXES), "suffix").when(F.octet_length("content") > MOST_BYTES, "size")
    marked = files.withColumn("filename", T.basename(F.col("filename"))).withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set from a JSON array."""
    schema = "q string, gold array<string>, kind string, file_types array<string>, provinces array<string>, cities array<string>, doc string"
    return spark.read.schema(schema).json(path, multiLine=True)


def write_queries(queries: DataFrame, path: str) -> None:
    queries.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Append text lines (value)."""
    lines.select("value").write.mode("append").text(path)


def land(files: DataFrame, folder: str, when: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted uploads (filename, content, ...) written to a folder under their own names: (registry rows, rejected, written).

    Registry rows are queued for ingestion; written: (filename, bytes) of what was stored.  A name that is there is replaced.
    """
    good, bad = accepted(files)
    rows = good.select("filename", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in good.columns else F.lit("").alias(c) for c in ("file_type", "region", "city")], F.octet_length("content").cast("long").alias("size"), F.lit(0).alias("chunk_count"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("message"), (F.current_timestamp() if when is None else when).alias("updated_at"))
    return rows, bad, write_files(good, folder)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(filename, bytes) of files (filename, content) after each is a file of the folder; opened through Arrow's file systems."""

    def run(batches):
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py() or b""
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["filename", "bytes"])

    return files.select("filename", F.col("content").cast("binary")).mapInArrow(run, "filename string, bytes long")


def write_reports(jobs: DataFrame, folder: str) -> DataFrame:
    """A Markdown file for each job (id, report_content) that has a report."""
    named = jobs.filter(F.col("report_content").isNotNull()).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("filename"), F.col("report_content").alias("content"))
    return write_files(named, folder)


def read_reports(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    """(id, report_content) of the reports in a folder; an empty file is none."""
    rows = read_binary(spark, f"{folder}/*.md")
    return rows.select(F.regexp_extract("filename", r"^(.*)\.md$", 1).cast(kind).alias("id"), F.col("content").cast("string").alias("report_content"))


def docx_bytes(text: str) -> bytes:
    """A Word document with a paragraph for each line; lines that start with # are headings."""
    from xml.sax.saxutils import escape

    paragraphs = []
    for line in text.splitlines():
        mark = len(line) - len(line.lstrip("#"))
        style = f'<w:pPr><w:pStyle w:val="Heading{min(mark, 6)}"/></w:pPr>' if mark else ""
        paragraphs.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line[mark:].lstrip() if mark else line)}</w:t></w:r></w:p>')
    space = _WORD[1:-1]
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{"".join(paragraphs)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


def docx(text: Column) -> Column:
    """Reports as Word documents."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else docx_bytes(t))

    return run(text)


def from_data_uri(uri: Column) -> Column:
    """The bytes of a base64 data URI."""
    return F.unbase64(F.regexp_extract(uri, r"^data:[^,]*;base64,(.*)$", 1))


def meminfo(lines: DataFrame) -> DataFrame:
    """(name, mb) of /proc/meminfo's lines (value)."""
    return lines.select(F.regexp_extract("value", r"^(\w+):", 1).alias("name"), (F.regexp_extract("value", r":\s+(\d+)\s+kB", 1).cast("double") / 1024).alias("mb")).filter("name != ''")


PAIR = r"(\d+)MB/\s*(\d+)"


def accelerator(text: Column) -> Column:
    """Figures out of a status tool's output: temperature, mean utilisation, clocks, and the pair of used and total memory with the largest total."""
    plain = T.without_ansi(text)
    first = lambda pattern, group=1: F.nullif(F.regexp_extract(plain, pattern, group), F.lit("")).cast("int")
    shares = F.regexp_extract_all(plain, F.lit(r"(\d+)%"), F.lit(1))
    mean = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(shares)
    pairs = F.transform(F.regexp_extract_all(plain, F.lit(PAIR), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, PAIR, 2).cast("int").alias("total"), F.regexp_extract(x, PAIR, 1).cast("int").alias("used")))
    largest = F.aggregate(pairs, F.lit(None).cast("struct<total:int,used:int>"), lambda a, x: F.when(a.isNull() | (x["total"] > a["total"]), x).otherwise(a))  # of equal totals the first
    return F.struct(
        first(r"(\d+)C").alias("temperature_c"), F.when(F.size(shares) > 0, F.round(mean, 1)).alias("util_percent"), first(r"(\d+)M\s+(\d+)M").alias("clock_mhz_min"), first(r"(\d+)M\s+(\d+)M", 2).alias("clock_mhz_max"),
        first(r"Active\s+(\d+)M").alias("clock_mhz_cur"), largest["used"].alias("memory_used_mb"), largest["total"].alias("memory_total_mb"),
    )


def processes(rows: DataFrame, page_kb: int = 4) -> DataFrame:
    """(pid, name, rss_mb) of /proc rows (pid, cmdline, statm): name is the command's first word, null sizes stay."""
    pages = F.get(F.split("statm", " "), F.lit(1)).try_cast("long")
    return rows.select("pid", F.get(F.split("cmdline", "[\\x00 ]"), F.lit(0)).alias("name"), F.bround(pages * page_kb / 1024).cast("int").alias("rss_mb"))


def cpu_percent(before: Column, after: Column) -> Column:
    """Busy share between two 'cpu ...' lines of /proc/stat, in percent."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("double"))
    spent = F.zip_with(numbers(after), numbers(before), lambda a, b: a - b)
    total = F.aggregate(spent, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, 100 * (1 - (F.get(spent, F.lit(3)) + F.coalesce(F.get(spent, F.lit(4)), F.lit(0.0))) / total)).otherwise(0.0)


def healthy(table: DataFrame) -> bool:
    try:
        table.limit(1).count()
    except Exception:  # noqa: BLE001
        return False
    return True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
