"""Text as Column expressions.  White space is Unicode's, lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\u0085  ]"
SENTENCE_END = "(?<=[。！？；])"
WORD = r"\p{L}+"


def squeeze(c: Column) -> Column:
    """Without any white space, U+3000 and NBSP included."""
    return F.regexp_replace(c, f"(?U){SPACE}+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    return squeeze(c) == ""


def lines(c: Column) -> Column:
    """Lines as they are, blank ones included."""
    return F.split(c, LINE_END)


def solid_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def sentences(c: Column, end: str = SENTENCE_END) -> Column:
    return F.filter(F.transform(F.split(c, end), strip), lambda x: x != "")


def fingerprint(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def words(c: Column) -> Column:
    """Runs of letters, lower case: the default tokenizer."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def cjk_bigrams(c: Column) -> Column:
    """Letters by words, except Han runs by overlapping pairs (or the lone sign): a tokenizer without a dictionary."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(r"^\p{IsHan}"), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, pieces))


def pack(pieces: Column, most: int, trim: Callable[[Column], Column] = strip) -> Column:
    """Greedy packing of sentences into texts of at most `most` characters; a longer sentence is cut by characters.

    A fold over the array, so each document is packed by itself and in one expression.  trim: of the texts packed.
    """
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def hard(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))

    def step(acc: Column, s: Column) -> Column:
        flushed = F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"])))
        long = F.struct(F.concat(flushed, hard(s)).alias("out"), F.lit("").alias("buf"))
        full = F.struct(flushed.alias("out"), s.alias("buf"))
        fits = F.struct(acc["out"].alias("out"), F.concat(acc["buf"], s).alias("buf"))
        return F.when(F.length(s) > most, long).when((acc["buf"] != "") & (F.length(acc["buf"]) + F.length(s) > most), full).otherwise(fits)

    folded = F.aggregate(pieces, zero, step, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))
    return F.filter(F.transform(folded, lambda x: trim(x)), lambda x: x != "")


def bounded_pieces(c: Column, most: int = 400, end: str = SENTENCE_END, trim: Callable[[Column], Column] = strip) -> Column:
    return pack(sentences(c, end), most, trim)


def csv_list(c: Column) -> Column:
    """'a, b,,c' as an array without empty items; null is the empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def without_thoughts(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", "")


def without_ansi(c: Column) -> Column:
    """Without terminal control sequences."""
    return F.regexp_replace(c, "\x1b(?:\\[[0-9;?]*[A-Za-z]|[0-9]|[=<>(A-Z])", "")


def message_summary(c: Column, most: int = 80) -> Column:
    """'text(120): first characters…' for logs."""
    flat = strip(c)
    head = F.concat(F.lit("text("), F.length(flat).cast("string"), F.lit(")"))
    return F.when(F.length(flat) > most, F.concat(head, F.lit(": "), F.substring(flat, 1, most), F.lit("…"))).when(flat != "", F.concat(head, F.lit(": "), flat)).otherwise(head)


def summary(c: Column, most: int = 80) -> Column:
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def fill(template: Column | str, **values: Column) -> Column:
    """{name} replaced by values, in one pass over distinct names."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def content_text(content: Column) -> Column:
    """Text of a message's content items (type, text): text items joined by a blank."""
    return F.array_join(F.transform(F.filter(content, lambda x: x["type"] == "text"), lambda x: x["text"]), " ")


def has_image(content: Column) -> Column:
    return F.exists(content, lambda x: x["type"] == "image_url")
