"""Document trees from text: legal documents by their 章 / 节 / 条, others by headings, blank lines and length.

Lines become rows numbered within their file; what a line belongs to follows from windows over the file.  A file is the
unit of every window, so files are parsed in parallel and none is gathered outside its own partition.

The flat form of a tree is a row for each article: (filename, node, chapter_no, chapter_title, section_no,
section_title, article_no, body).  `to_tree` nests it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T

# fixed values: the numerals of headings, the longest heading, the signs that end a sentence
NUMERAL = "[一二三四五六七八九十百千万0-9]+"
HAN_NUMERAL = "[一二三四五六七八九十百千万]+"
HEADING_MOST = 50
TERMINAL = "[。！？；]$"
LEGAL_LEAST = 3
NODE = ["chapter_no", "chapter_title", "section_no", "section_title", "article_no"]


def _head(kind: str) -> str:
    return f"^(第{NUMERAL}{kind})(.*)$"


def is_legal(text: Column) -> Column:
    """At least three lines start with a chapter, section or article number."""
    heads = F.size(F.filter(T.solid_lines(text), lambda x: T.squeeze(x).rlike(f"^第{NUMERAL}[章节条]")))
    return F.when(F.contains(text, F.lit("第")), heads >= LEGAL_LEAST).otherwise(False)  # most other texts need no lines


def _rows(files: DataFrame, lines: Column) -> DataFrame:
    return files.select("filename", F.posexplode(lines).alias("n", "raw"))


def _file() -> Window:
    return Window.partitionBy("filename").orderBy("n")


def _upto() -> Window:
    return _file().rowsBetween(Window.unboundedPreceding, 0)


def legal_lines(files: DataFrame) -> DataFrame:
    """Lines of legal files with their kind, number, title, and where the body starts."""
    rows = _rows(files, T.solid_lines(F.col("text"))).withColumn("sq", T.squeeze(F.col("raw")))
    kind = F.when(F.col("sq").rlike(_head("章")), "chapter").when(F.col("sq").rlike(_head("节")), "section").when(F.col("sq").rlike(_head("条")), "article")
    rows = rows.withColumn("kind", kind)
    for name, group in (("no", 1), ("title", 2)):
        parts = [F.when(F.col("kind") == k, F.regexp_extract("sq", _head(s), group)) for k, s in (("chapter", "章"), ("section", "节"), ("article", "条"))]
        rows = rows.withColumn(name, F.coalesce(*parts))
    whole = Window.partitionBy("filename")
    meta = F.max(F.when((F.col("n") == 1) & F.col("raw").startswith("（") & F.col("raw").endswith("）"), F.col("raw"))).over(whole)
    rows = rows.withColumn("meta", meta).withColumn("first", F.when(F.col("meta").isNull(), 1).otherwise(2))
    rows = rows.withColumn("contents", F.min(F.when((F.col("n") >= F.col("first")) & (F.col("sq") == "目录"), F.col("n"))).over(whole))
    listed = (F.col("kind") == "chapter") & (F.col("n") > F.col("contents"))
    again = F.row_number().over(Window.partitionBy("filename", F.when(listed, F.col("no"))).orderBy("n"))
    rows = rows.withColumn("_again", again)
    rows = rows.withColumn("repeat", F.min(F.when(listed & (F.col("_again") > 1), F.col("n"))).over(whole))
    start = F.when(F.col("contents").isNull(), F.col("first")).otherwise(F.coalesce("repeat", F.col("contents") + 1))
    in_contents = listed & (F.col("n") < F.coalesce("repeat", F.lit(1 << 30)))
    return rows.withColumn("start", start).withColumn("in_contents", F.coalesce(in_contents, F.lit(False))).drop("_again")


def legal_articles(files: DataFrame) -> DataFrame:
    """The flat tree of legal files."""
    body = legal_lines(files).filter(F.col("n") >= F.col("start"))
    body = body.withColumn("heads", F.count("kind").over(_upto())).withColumn("chapters", F.count(F.when(F.col("kind") == "chapter", 1)).over(_upto()))
    for part, window in (("chapter", _upto()), ("section", Window.partitionBy("filename", "chapters").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))):
        for field in ("no", "title"):
            body = body.withColumn(f"{part}_{field}", F.last(F.when(F.col("kind") == part, F.col(field)), ignorenulls=True).over(window))
    line = F.when(F.col("kind") == "article", F.col("title")).otherwise(F.col("raw"))
    # a group starts at a heading; only articles hold text that is kept
    ordered = F.array_sort(F.collect_list(F.struct("n", "kind", "no", F.struct("chapter_no", "chapter_title", "section_no", "section_title").alias("at"), line.alias("line"))))
    groups = body.filter("heads > 0").groupBy("filename", "heads").agg(ordered.alias("rows")).filter(F.col("rows")[0]["kind"] == "article")
    text = F.array_join(F.filter(F.transform("rows", lambda r: r["line"]), lambda x: x != ""), "\n")
    first = F.col("rows")[0]
    return groups.select(
        "filename", F.col("heads").cast("int").alias("node"), F.coalesce(first["at"]["chapter_no"], F.lit("")).alias("chapter_no"), F.coalesce(first["at"]["chapter_title"], F.lit("")).alias("chapter_title"), first["at"]["section_no"].alias("section_no"), first["at"]["section_title"].alias("section_title"), first["no"].alias("article_no"), T.strip(text).alias("body")
    )


def legal_documents(files: DataFrame) -> DataFrame:
    """(filename, title, meta, toc) of legal files; toc: (no, title) of the chapters listed."""
    listed = F.array_sort(F.collect_list(F.when(F.col("in_contents"), F.struct("n", "no", "title"))))
    rows = legal_lines(files).groupBy("filename").agg(F.max(F.when(F.col("n") == 0, F.col("raw"))).alias("title"), F.first("meta").alias("meta"), listed.alias("toc"))
    return rows.withColumn("toc", F.transform("toc", lambda x: F.struct(F.lit("chapter").alias("level"), x["no"].alias("no"), F.nullif(x["title"], F.lit("")).alias("title"))))


# fixed values: the forms of headings and the order they are tried in; digits are those of any script
HEADINGS: list[tuple[str, str, int]] = [
    # pattern on the squeezed line, form of the number, level; the first that matches counts
    (r"^(\p{Nd}+(?:\.\p{Nd}+)+)(.*)$", "%s", 2),
    (_head("章"), "%s", 1),
    (_head("节"), "%s", 2),
    (f"^({HAN_NUMERAL})[、．.](.*)$", "%s、", 1),
    (f"^[（(]({HAN_NUMERAL})[)）](.*)$", "（%s）", 2),
    (r"^(\p{Nd}+)[、．.](.*)$", "%s", 1),
]
MARKDOWN = r"^(#{1,6})\s+(.*)$"


STARTS = r"^[#\p{Nd}一二三四五六七八九十百千万第（(]"


def heading(sq: Column, stripped: Column) -> Column:
    """(no, title, level) of a line that looks like a heading, else null; sq: squeezed, stripped: without outer blanks."""
    md_title = T.strip(F.regexp_extract(stripped, MARKDOWN, 2))
    md = F.struct(F.lit("").alias("no"), md_title.alias("title"), F.when(F.length(F.regexp_extract(stripped, MARKDOWN, 1)) == 1, 1).otherwise(2).alias("level"))
    out = F.when(stripped.rlike(MARKDOWN) & (md_title != "") & (F.length(md_title) <= HEADING_MOST), md)
    for pattern, shown, level in HEADINGS:
        no = F.format_string(shown, F.regexp_extract(sq, pattern, 1))
        out = out.when(sq.rlike(pattern), F.struct(no.alias("no"), F.regexp_extract(sq, pattern, 2).alias("title"), F.lit(level).alias("level")))
    return F.when((F.length(sq) <= HEADING_MOST) & sq.rlike(STARTS) & ~sq.rlike(TERMINAL), out)


def plain_lines(files: DataFrame) -> DataFrame:
    """Lines of plain files; a heading counts only if a line follows that is no heading of its level or above."""
    rows = _rows(files, T.lines(F.col("text"))).withColumn("sq", T.squeeze(F.col("raw"))).withColumn("blank", F.col("sq") == "")
    rows = rows.withColumn("h", heading(F.col("sq"), T.strip(F.col("raw"))))
    later = Window.partitionBy("filename").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(~F.col("blank"), F.struct(F.lit(True).alias("there"), F.col("h"))), ignorenulls=True).over(later)
    rows = rows.withColumn("after", after)
    kept = F.when(F.col("after").isNotNull() & (F.col("after.h").isNull() | (F.col("after.h.level") > F.col("h.level"))), F.col("h"))
    return rows.select("filename", "n", "raw", "blank", kept.alias("heading"))


def _articles(nodes: DataFrame, node: Column, *more: Column) -> DataFrame:
    """The flat tree out of (filename, heading columns, body), in their order, and more columns; what is lacking is null or ''."""
    own = {c: F.col(c) if c in nodes.columns else F.lit(None).cast("string") for c in NODE[:4]}
    chapter = [F.coalesce(own[c], F.lit("")).alias(c) for c in NODE[:2]]
    return nodes.select("filename", node.cast("int").alias("node"), *chapter, *[own[c].alias(c) for c in NODE[2:4]], F.lit("").alias("article_no"), "body", *more)


def _packed(lines: Column, most: int) -> Column:
    """Lines put together into texts of at most `most` characters without their line breaks; blank ones end a text.  A fold, so a file stays in its row."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size"))

    def step(a: Column, line: Column) -> Column:
        size, done = F.length(line), F.when(a["buf"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))
        ended = F.struct(done.alias("out"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size"))
        close = F.struct(done.alias("out"), line.alias("buf"), size.alias("size"))
        grow = F.struct(a["out"].alias("out"), F.concat_ws("\n", a["buf"], line).alias("buf"), (a["size"] + size).alias("size"))
        return F.when(T.blank(line), ended).when(a["buf"].isNotNull() & (a["size"] + size > most), close).otherwise(grow)

    texts = F.aggregate(lines, zero, step, lambda a: F.when(a["buf"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))
    return F.filter(F.transform(texts, T.strip), lambda x: x != "")


def length_articles(files: DataFrame, most: int = 400) -> DataFrame:
    """Articles as `parse` gives them, by blank lines and length alone: for prose, whose lines may start like headings (an address 1.2.3.4) and are none."""
    facets = [F.coalesce(c, F.lit("")).alias(c) for c in ("file_type", "region", "city")]
    texts = files.select("filename", *facets, F.posexplode(_packed(T.lines(F.col("text")), most)).alias("_k", "body"))
    return _articles(texts, F.col("_k") + 1, *[F.col(c) for c in ("file_type", "region", "city")], F.lit("").alias("doc_title"))


def plain_articles(files: DataFrame, most: int = 400) -> DataFrame:
    """The flat tree of plain files.  Files without a line that looks like a heading are parsed in their rows; only others are taken apart."""
    headed = F.coalesce(F.exists(T.lines(F.col("text")), lambda x: heading(T.squeeze(x), T.strip(x)).isNotNull()), F.lit(False))
    flat = files.filter(~headed).select("filename", F.posexplode(_packed(T.lines(F.col("text")), most)).alias("_k", "body"))
    return _articles(flat, F.col("_k") + 1).unionByName(headed_articles(files.filter(headed), most))


def headed_articles(files: DataFrame, most: int = 400) -> DataFrame:
    """The flat tree of plain files with headings."""
    rows = plain_lines(files)
    breaks = F.col("blank") | F.col("heading").isNotNull()
    rows = rows.withColumn("segment", F.sum(F.when(breaks, 1).otherwise(0)).over(_upto())).withColumn("chapters", F.count(F.when(F.col("heading")["level"] == 1, 1)).over(_upto()))
    in_chapter = Window.partitionBy("filename", "chapters").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    for part, level, window in (("chapter", 1, _upto()), ("section", 2, in_chapter)):
        for field in ("no", "title"):
            rows = rows.withColumn(f"{part}_{field}", F.last(F.when(F.col("heading")["level"] == level, F.col("heading")[field]), ignorenulls=True).over(window))
    bodies = rows.filter(~breaks).groupBy("filename", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "raw"))).alias("rows"), *[F.first(c).alias(c) for c in NODE[:4]])
    texts = _packed(F.transform("rows", lambda r: r["raw"]), most)
    nodes = bodies.select("filename", "segment", *NODE[:4], F.posexplode(texts).alias("k", "body"))
    found = _articles(nodes, F.row_number().over(Window.partitionBy("filename").orderBy("segment", "k")))
    whole = files.join(found.select("filename").distinct(), "filename", "left_anti").filter(~T.blank(F.col("text")))
    return found.unionByName(_articles(whole.select("filename", T.strip(F.col("text")).alias("body")), F.lit(1)))


def parse(files: DataFrame, most: int = 400, headings: bool = True) -> DataFrame:
    """Articles of files (filename, text, file_type, region, city), legal or plain, with the file's title and facets.

    Blank files have no articles; the caller reports them (see chunking.rebuild_plan).  headings: False for files that are
    known to be prose, see `length_articles`.
    """
    if not headings:
        return length_articles(files, most)
    marked = files.withColumn("legal", is_legal(F.col("text")))
    legal, plain = marked.filter("legal"), marked.filter("NOT legal")
    titles = legal_documents(legal).select("filename", F.col("title").alias("doc_title"))
    articles = legal_articles(legal).unionByName(plain_articles(plain, most))
    facets = files.select("filename", *[F.coalesce(c, F.lit("")).alias(c) for c in ("file_type", "region", "city")])
    return articles.join(facets, "filename").join(titles, "filename", "left").withColumn("doc_title", F.coalesce("doc_title", F.lit("")))


ARTICLE = "struct<level:string,no:string,title:string,text:string>"


def to_tree(articles: DataFrame) -> DataFrame:
    """(filename, tree_json): articles nested under sections and chapters, in order."""
    item = F.struct(F.lit("article").alias("level"), F.col("article_no").alias("no"), F.lit("").alias("title"), F.col("body").alias("text"))
    by_section = articles.groupBy("filename", "doc_title", "file_type", "region", "city", *NODE[:4]).agg(F.min("node").alias("node"), F.array_sort(F.collect_list(F.struct("node", item.alias("a")))).alias("items"))
    section = F.struct("node", F.col("section_no").alias("no"), F.col("section_title").alias("title"), F.transform("items", lambda x: x["a"]).alias("children"))
    by_chapter = by_section.groupBy("filename", "doc_title", "file_type", "region", "city", *NODE[:2]).agg(F.min("node").alias("node"), F.array_sort(F.collect_list(section)).alias("sections"))
    chapter = F.struct("node", F.col("chapter_no").alias("no"), F.col("chapter_title").alias("title"), F.transform("sections", lambda s: s.dropFields("node")).alias("sections"))
    whole = by_chapter.groupBy("filename", "doc_title", "file_type", "region", "city").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    doc = F.struct(F.col("doc_title").alias("title"), "file_type", "region", "city", F.col("filename").alias("source"))
    return whole.select("filename", F.to_json(F.struct(doc.alias("doc"), F.transform("chapters", lambda c: c.dropFields("node")).alias("tree"))).alias("tree_json"))


TREE = f"struct<doc:struct<title:string,file_type:string,region:string,city:string,source:string>,tree:array<struct<no:string,title:string,sections:array<struct<no:string,title:string,children:array<{ARTICLE}>>>>>>"


def from_tree(trees: DataFrame) -> DataFrame:
    """Articles back from (filename, tree_json)."""
    t = trees.select("filename", F.from_json("tree_json", TREE).alias("t"))
    c = t.select("filename", "t.doc", F.posexplode("t.tree").alias("i", "c"))
    s = c.select("filename", "doc", "i", "c.no", "c.title", F.posexplode("c.sections").alias("j", "s"))
    a = s.select("filename", "doc", "i", "j", F.col("no").alias("chapter_no"), F.col("title").alias("chapter_title"), F.col("s.no").alias("section_no"), F.col("s.title").alias("section_title"), F.posexplode("s.children").alias("k", "a"))
    node = F.row_number().over(Window.partitionBy("filename").orderBy("i", "j", "k"))
    return a.select("filename", node.alias("node"), *NODE[:4], F.col("a.no").alias("article_no"), F.col("a.text").alias("body"), F.col("doc.file_type").alias("file_type"), F.col("doc.region").alias("region"), F.col("doc.city").alias("city"), F.col("doc.title").alias("doc_title"))
