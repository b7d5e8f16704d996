"""Trees and chunks from text: the behaviours of both parsers, one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import chunking, parser

LEGAL = """测试安全条例
（2020年1月1日通过）
目　　录
第一章 总　　则
第二章 监督
第三章 附则
第一章 总　　则
第一条 为了测试，制定 本条例。
继续 的一行。
第二条 适用范围。
第二章 监督
第一节 检查
第三条 应当检查。
第二节 处理
第四条 应当处理。
第三章 附则
说明文字不入块。
第五条 自公布之日起施行。"""


def files(spark, **texts):
    return spark.createDataFrame([(n + ".txt", t, "地方法规", "某省", "某市") for n, t in texts.items()], "filename string, text string, file_type string, region string, city string")


def nodes(spark, text, **options):
    return [r.asDict() for r in parser.parse(files(spark, f=text), **options).orderBy("node").collect()]


def test_legal_document(spark):
    docs = parser.legal_documents(files(spark, f=LEGAL)).collect()[0]
    assert docs["title"] == "测试安全条例"
    assert docs["meta"] == "（2020年1月1日通过）"
    assert [t["no"] for t in docs["toc"]] == ["第一章", "第二章", "第三章"]
    got = nodes(spark, LEGAL)
    assert [(n["chapter_no"], n["section_no"], n["article_no"]) for n in got] == [("第一章", None, "第一条"), ("第一章", None, "第二条"), ("第二章", "第一节", "第三条"), ("第二章", "第二节", "第四条"), ("第三章", None, "第五条")]
    assert got[0]["body"] == "为了测试，制定本条例。\n继续 的一行。"  # first lines are squeezed, others are not
    assert got[0]["chapter_title"] == "总则"
    assert got[0]["doc_title"] == "测试安全条例"


def test_contents_without_repeat(spark):
    got = nodes(spark, "标题\n目录\n第一章 甲\n第一条 一。\n第二条 二。")
    assert [(n["chapter_no"], n["article_no"]) for n in got] == [("第一章", "第一条"), ("第一章", "第二条")]


def test_no_contents_line(spark):
    got = nodes(spark, "标题\n第一条 一。\n第一节 节\n第二条 二。\n第三条 三。")
    assert [(n["chapter_no"], n["section_no"], n["article_no"]) for n in got] == [("", None, "第一条"), ("", "第一节", "第二条"), ("", "第一节", "第三条")]
    docs = parser.legal_documents(files(spark, f="标题\n第一条 一。\n第二条 二。\n第三条 三。")).collect()[0]
    assert docs["toc"] == [] and docs["meta"] is None


def test_text_under_headings_is_not_kept(spark):
    got = nodes(spark, "标题\n前言\n第一章 甲\n章下文字\n第一条 一。\n第二条 二。")
    assert [n["body"] for n in got] == ["一。", "二。"]


def test_plain_short(spark):
    got = nodes(spark, "第一行文字。\n第二行文字。")
    assert [(n["article_no"], n["body"], n["region"]) for n in got] == [("", "第一行文字。\n第二行文字。", "某省")]
    assert got[0]["doc_title"] == ""


def test_han_headings(spark):
    got = nodes(spark, "一、概述\n概述正文。\n二、要求\n（一）人员\n人员正文。\n（二）设备\n设备正文。\n三、附件\n附件正文。")
    assert [(n["chapter_no"], n["chapter_title"], n["section_no"]) for n in got] == [("一、", "概述", None), ("二、", "要求", "（一）"), ("二、", "要求", "（二）"), ("三、", "附件", None)]


def test_numeric_and_markdown_headings(spark):
    got = nodes(spark, "1. 概述\n1.1 范围\n范围正文。\n2. 方法\n方法正文。")
    assert [(n["chapter_no"], n["section_no"]) for n in got] == [("1", "1.1"), ("2", None)]
    got = nodes(spark, "前言。\n\n# 甲\n正文一。\n## 乙\n正文二。")
    assert [(n["chapter_title"], n["section_title"], n["body"]) for n in got] == [("", None, "前言。"), ("甲", None, "正文一。"), ("甲", "乙", "正文二。")]


@pytest.mark.parametrize("text", ["1. 第一句完整的话。\n2. 第二句完整的话。\n3. 第三句。", "1. 苹果\n2. 香蕉\n3. 橙子"])
def test_numbered_lists_are_no_headings(spark, text):
    got = nodes(spark, text)
    assert len(got) == 1 and got[0]["chapter_no"] == "" and got[0]["body"] == text


def test_section_before_chapter_opens_one(spark):
    got = nodes(spark, "1.1 小节\n正文。\n结尾。")
    assert [(n["chapter_no"], n["chapter_title"], n["section_no"]) for n in got] == [("", "", "1.1")]


def test_blank_lines_and_length_end_articles(spark):
    got = nodes(spark, "甲" * 240 + "\n\n" + "乙" * 240 + "\n" + "丙" * 240)
    assert [len(n["body"]) for n in got] == [240, 240, 240]
    got = nodes(spark, "\n".join(["丁" * 100] * 6))
    assert [len(n["body"]) for n in got] == [403, 201]  # line ends do not count towards 400


def test_all_headings_is_one_article(spark):
    got = nodes(spark, "# 只有标题")
    assert [(n["chapter_no"], n["body"]) for n in got] == [("", "# 只有标题")]


def test_blank_file_has_no_articles(spark):
    assert nodes(spark, " \n　\n") == []


def test_chunks(spark):
    rows = chunking.chunk_articles(parser.parse(files(spark, f=LEGAL))).orderBy("chunk").collect()
    assert [r["id"] for r in rows] == [f"f.txt#{i:03d}" for i in range(1, 6)]
    assert rows[2]["text"] == "某省 某市 测试安全条例 第二章 监督 第一节 检查\n第三条 应当检查。"
    assert rows[0]["section_no"] is None and rows[2]["section_no"] == "第一节"


def test_long_article_restarts_numbers(spark):
    text = "标题\n第一条 " + ("字" * 180 + "。") * 4 + "\n第二条 短。\n第三条 短。"
    rows = chunking.chunk_articles(parser.parse(files(spark, f=text))).orderBy("chunk").collect()
    assert [(r["article_no"], r["article_chunk"]) for r in rows] == [("第一条", 1), ("第一条", 2), ("第二条", 1), ("第三条", 1)]


def test_tree_round_trip(spark):
    articles = parser.parse(files(spark, f=LEGAL, g="一、甲\n正文。\n（一）乙\n正文二。"))
    back = parser.from_tree(parser.to_tree(articles))
    one, two = (sorted(map(tuple, chunking.chunk_articles(a).collect()), key=str) for a in (articles, back))
    assert one == two and one


def pieces(spark, text, most=400):
    return spark.createDataFrame([(text,)], "t string").select(T.bounded_pieces(F.col("t"), most).alias("p")).first()["p"]


def test_packing_bounds(spark):
    assert [len(p) for p in pieces(spark, "a" * 250 + "。" + "b" * 200 + "。" + "c" * 60 + "。")] == [251, 262]
    assert [len(p) for p in pieces(spark, "x" * 800)] == [400, 400]
    got = pieces(spark, "a" * 180 + "。" + "b" * 300 + "。" + "c" * 30 + "。")
    assert len(got) >= 2 and max(map(len, got)) <= 400 and "".join(got) == "a" * 180 + "。" + "b" * 300 + "。" + "c" * 30 + "。"
    assert pieces(spark, "x" * 900 + "。短。") == ["x" * 400, "x" * 400, "x" * 100 + "。", "短。"]
    assert pieces(spark, "") == []


def test_white_space(spark):
    row = spark.createDataFrame([("　第 一 章\t",)], "t string").select(T.squeeze(F.col("t")).alias("a"), T.strip(F.col("t")).alias("b")).first()
    assert row["a"] == "第一章" and row["b"] == "第 一 章"
    assert spark.createDataFrame([("😀😀",)], "t string").select(T.bounded_pieces(F.col("t"), 1).alias("p")).first()["p"] == ["😀", "😀"]


def test_cjk_bigrams(spark):
    row = spark.createDataFrame([("消防安全 Fire 2 检",)], "t string").select(T.cjk_bigrams(F.col("t")).alias("a")).first()
    assert row["a"] == ["消防", "防安", "安全", "fire", "2", "检"]


def test_rebuild_plan(spark):
    registry = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z"), ("d", "w")], "filename string, md5 string")
    there = spark.createDataFrame([("a", "text"), ("b", " "), ("c", "text")], "filename string, text string")
    there = there.union(spark.createDataFrame([("e", "unregistered")], there.schema))
    registry = registry.withColumn("md5", F.when(F.col("filename") == "a", F.md5(F.lit("text"))).otherwise(F.col("md5")))
    indexed = spark.createDataFrame([("a",), ("old",)], "source string")
    got = {r["filename"]: r["outcome"] for r in chunking.rebuild_plan(registry, there, indexed).collect()}
    assert got == {"a": "skipped", "b": "empty", "c": "updated", "d": "missing", "old": "orphan"}
    forced = {r["filename"]: r["outcome"] for r in chunking.rebuild_plan(registry, there, indexed, force=True).collect()}
    assert forced["a"] == "updated"


def test_index_sink(spark):
    index = spark.createDataFrame([("a#001", "a", 1), ("b#001", "b", 1)], "id string, source string, chunk int")
    new = spark.createDataFrame([("a#001", "a"), ("a#002", "a")], "id string, source string")
    got = sorted(map(tuple, chunking.replace_sources(index, new).collect()))
    assert got == [("a#001", "a", None), ("a#002", "a", None), ("b#001", "b", 1)]
    assert chunking.delete_source(index, "b").count() == 1
