"""Registry changes, pages, governance, chat, evaluation sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import chat, evalset, governance, joins, registry


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upsert(spark):
    old = table(spark, [("a", "m1", True), ("b", "m2", True)], "filename string, md5 string, sensitive boolean")
    new = table(spark, [("a", None), ("c", "m3")], "filename string, md5 string")
    once = registry.upsert(old, new, "filename", keep=["sensitive"])
    assert rows_of(once) == [("a", None, True), ("b", "m2", True), ("c", "m3", None)]
    assert rows_of(registry.upsert(once, new, "filename", keep=["sensitive"])) == rows_of(once)
    twice = table(spark, [("a", "x", 1), ("a", "y", 2)], "filename string, md5 string, at int")
    assert rows_of(registry.upsert(old, twice, "filename", order="at").select("filename", "md5")) == [("a", "y"), ("b", "m2")]


def test_changes(spark):
    t = table(spark, [("a", "x", 1), ("b", "y", 2)], "k string, v string, n int")
    assert rows_of(registry.partial_update(t, table(spark, [("a", None, 5)], "k string, v string, n int"), "k")) == [("a", "x", 5), ("b", "y", 2)]
    assert rows_of(registry.delete(t, table(spark, [("a",)], "k string"), "k")) == [("b", "y", 2)]
    assert rows_of(registry.set_flag(t.withColumn("s", F.lit(False)), "k", "a", "s", True).select("k", "s")) == [("a", True), ("b", False)]
    assert rows_of(registry.seed(t, table(spark, [("a", "z", 9), ("c", "w", 3)], "k string, v string, n int"), "k")) == [("a", "x", 1), ("b", "y", 2), ("c", "w", 3)]
    assert rows_of(registry.insert(t, table(spark, [("c",)], "k string")), "k")[-1] == ("c", None, None)


def test_like(spark):
    t = table(spark, [("Ab_c.txt",), ("abXc.txt",), ("É.txt",), ("é.txt",)], "filename string")
    assert rows_of(registry.list_files(t, keyword="AB_C")) == [("Ab_c.txt",), ("abXc.txt",)]  # _ matches any character
    assert rows_of(registry.list_files(t, keyword="é")) == [("é.txt",)]  # only ASCII folds
    assert registry.list_files(t, keyword="").count() == 4


def test_audit_log(spark):
    log = table(spark, [(i, f"2024-01-01 00:00:0{i // 2}", "Alice" if i % 2 else "bob", "login", i % 3 % 2) for i in range(6)], "id long, ts string, username string, action string, success int")
    one, total = registry.log_page(log, 1, 2)
    two, _ = registry.log_page(log, 2, 2)
    assert [r["id"] for r in one.collect()] == [5, 4] and [r["id"] for r in two.collect()] == [3, 2]
    assert total.first()["total"] == 6
    assert registry.list_log(log, username="ALI").count() == 3
    assert registry.list_log(log, username="ali", action="login", success=0).count() == sum(1 for i in range(6) if i % 2 and not i % 3 % 2)
    assert len(registry.log_page(log, 0, 500)[0].collect()) == 6  # size out of bounds is the default


@pytest.mark.parametrize(("number", "size", "want"), [(0, 0, list(range(20))), (1, 5, list(range(5))), (2, 100, []), (9, 50, []), (1, 1000, list(range(60)))])
def test_pages(spark, number, size, want):
    got = registry.page(spark.range(60), [F.col("id")], number, size).collect()
    assert [r["id"] for r in got] == want


def test_statistics(spark):
    t = table(spark, [("ready", 5, 1), ("odd", None, 2)], "status string, size long, chunk_count int")
    assert rows_of(registry.status_counts(t, registry.FILE_STATES)) == [("building", 0), ("failed", 0), ("odd", 1), ("ready", 1)]
    assert tuple(registry.totals(t).first()) == (2, 5, 3)
    assert tuple(registry.totals(t.limit(0)).first()) == (0, 0, 0)


def test_backfill_and_meta(spark):
    t = table(spark, [("中华人民共和国某法.txt", "", "", ""), ("x.txt", None, "r", ""), ("y.txt", "t", "r", "c")], "filename string, file_type string, region string, city string")
    meta = table(spark, [("x.txt", "行政法规", "甲", "乙", 2), ("x.txt", "z", "z", "z", 3)], "source string, file_type string, region string, city string, chunk int")
    got = rows_of(registry.backfill(t, registry.first_meta(meta)))
    assert got == [("x.txt", "行政法规", "甲", "乙"), ("y.txt", "t", "r", "c"), ("中华人民共和国某法.txt", "国家法律", "", "")]


def test_validators(spark):
    t = table(spark, [("", "x" * 65)], "filename string, username string")
    assert t.select(registry.invalid(t).alias("i")).first()["i"] == ["filename", "username"]
    assert registry.check_status("queued") == "queued"
    with pytest.raises(ValueError):
        registry.check_status("nope")


def test_roles(spark):
    users = table(spark, [(r, r, True) for r in governance.ROLES] + [("gone", "secadmin", False)], "username string, role string, is_active boolean")
    for permission, roles in governance.MATRIX.items():
        assert {r["username"] for r in governance.allowed(users, permission).collect()} == set(roles)
    asked = table(spark, [("user", "secadmin"), ("gone", "secadmin"), ("nobody", "x")], "username string, role string")
    assert rows_of(governance.effective_roles(asked, users)) == [("user", "user")]
    files = table(spark, [("a", True), ("b", False), ("c", None)], "filename string, sensitive boolean")
    assert [r["filename"] for r in governance.visible(files, "user").orderBy("filename").collect()] == ["b", "c"]
    assert governance.visible(files, "secadmin").count() == 3
    assert dict(rows_of(governance.may_touch(files, "sysadmin"))) == {"a": False, "b": True, "c": True}


def test_audit_rows(spark, tmp_path):
    events = table(spark, [(None, "login", None, None, None, False), ("u", "login", "t", "d", "i", True)], "username string, action string, target string, detail string, ip string, ok boolean")
    rows = governance.audit_rows(events, table(spark, [("u", "user")], "username string, role string"))
    assert rows_of(rows.drop("ts")) == [("", "", "login", "", "", "", 0), ("u", "user", "login", "t", "d", "i", 1)]
    assert governance.append_audit(rows, str(tmp_path / "log")) and governance.append_audit(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    (tmp_path / "file").write_text("x")
    assert not governance.append_audit(rows, str(tmp_path / "file" / "log"))


def test_status_columns(spark):
    t = table(spark, [(True, True, True, "loading"), (True, False, True, "ok"), (True, True, True, "failed")], "a boolean, b boolean, c boolean, i string")
    assert [r[0] for r in t.select(governance.health(*[F.col(c) for c in "abci"])).collect()] == ["ok", "degraded", "degraded"]
    assert len({r[0] for r in spark.sql("SELECT * FROM VALUES (true, true), (true, false), (false, true), (false, false) t(a, b)").select(governance.engine_status(F.col("a"), F.col("b"))).collect()}) == 4


def test_chat(spark):
    messages = table(spark, [(1, 0, "system", "S"), (1, 1, "user", "Q"), (2, 0, "user", "Q2"), (3, 0, "user", "Q3")], "conv_id long, turn long, role string, text string")
    assert rows_of(chat.last_questions(messages)) == [(1, "Q"), (2, "Q2"), (3, "Q3")]
    contexts = table(spark, [(1, "C"), (2, "C2"), (3, "")], "conv_id long, context string")
    got = rows_of(chat.inject_context(messages, contexts), "conv_id", "turn")
    assert got == [(1, 0, "system", "S\n\nC"), (1, 1, "user", "Q"), (2, -1, "system", "C2"), (2, 0, "user", "Q2"), (3, 0, "user", "Q3")]
    jobs = table(spark, [(1, "k", "T {x}", "R", "C")], "id long, task_type string, original_text string, requirements string, context string")
    templates = table(spark, [("k", "SYS", "{original_text}|{requirements}|{context}")], "key string, system_prompt string, user_template string")
    assert rows_of(chat.prompts(jobs, templates)) == [(1, "SYS", "T {x}|R|C")]

    def model(pairs):
        if pairs[0][1].startswith("T"):
            return ["<think>no</think> yes"]
        raise RuntimeError("busy")

    asked = table(spark, [(1, "s", "T"), (2, "s", "U")], "id long, system string, user string")
    assert rows_of(chat.generate(asked, model)) == [(1, "yes", None), (2, None, "busy")]


def test_sse(spark):
    lines = table(spark, [(1, 0, ": ping"), (1, 1, "data: a"), (1, 2, "data: [DONE]"), (1, 3, "data: late"), (2, 0, "data: x")], "stream long, n long, line string")
    rows = chat.sse_data(lines).select("stream", "n", "data")
    assert rows_of(rows) == [(1, 1, "a"), (1, 2, "[DONE]"), (2, 0, "x")]
    payloads = table(spark, [(1, "P"), (2, "P2")], "stream long, payload string")
    assert rows_of(chat.sse_inject(rows, payloads)) == [(1, 1, 0, "a"), (1, 2, 0, "P"), (1, 2, 1, "[DONE]"), (2, 0, 0, "x")]


def test_evaluation_set(spark):
    files = table(spark, [("三亚市消防管理条例.docx", "海南省", "三亚市", "地方法规", "ready"), ("某省某办法.txt", "某省", "", "地方法规", "ready"), ("《国家建筑法》.doc", "", "", "国家法律", "ready"), ("燃气.txt", "", "", "x", "failed")], "filename string, region string, city string, file_type string, status string")
    got = evalset.generate(files, long_count=2).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r["doc"], {})[r["kind"]] = r
    assert set(kinds) == {"三亚市消防管理条例.docx", "某省某办法.txt", "《国家建筑法》.doc"}
    assert set(kinds["某省某办法.txt"]) == {"short"} and set(kinds["三亚市消防管理条例.docx"]) == {"short", "news", "long"}
    assert kinds["三亚市消防管理条例.docx"]["short"]["q"] == "三亚的消防有哪些要求？"
    assert kinds["《国家建筑法》.doc"]["short"]["q"].startswith("本地的国家建筑法")
    assert len(kinds["《国家建筑法》.doc"]["long"]["q"]) >= 500
    assert kinds["《国家建筑法》.doc"]["long"]["file_types"] == ["国家法律"]
    assert sorted(map(tuple, evalset.generate(files, long_count=2).select("q").collect())) == sorted((r["q"],) for r in got)


def test_even_sample(spark):
    got = [r["id"] for r in registry.even_sample(spark.range(10), 4, "id").orderBy("id").collect()]
    assert got == [0, 3, 6, 9]
    assert registry.even_sample(spark.range(10), 1, "id").count() == 1


def test_scalars(spark):
    row = table(spark, [("a, b,,c ", "\x1b[31mred\x1b[0m", "x" * 90)], "c string, a string, s string").select(T.csv_list(F.col("c")).alias("c"), T.without_ansi(F.col("a")).alias("a"), T.summary(F.col("s")).alias("s")).first()
    assert row["c"] == ["a", "b", "c"] and row["a"] == "red" and row["s"] == "x" * 80 + "..."
    items = spark.sql("SELECT array(named_struct('type', 'text', 'text', 'a'), named_struct('type', 'image_url', 'text', null), named_struct('type', 'text', 'text', 'b')) AS c")
    assert items.select(T.content_text(F.col("c")).alias("t"), T.has_image(F.col("c")).alias("i")).first() == ("a b", True)


def test_joins(spark):
    left = table(spark, [("k", 5), ("k", 1), ("j", 3)], "key string, at int")
    right = table(spark, [("k", 2, "x"), ("k", 5, "y"), ("k", 9, "z")], "key string, at int, v string")
    assert rows_of(joins.as_of(left, right, ["key"], "at", ["v"])) == [("j", 3, None), ("k", 1, None), ("k", 5, "y")]
    points = table(spark, [(1, 10), (2, 25), (3, 31)], "p int, at int")
    ranges = table(spark, [(1, 5, 30), (2, 31, 31)], "r int, low int, high int")
    assert rows_of(joins.range_join(points, ranges, "at", "low", "high", 10).select("p", "r")) == [(1, 1), (2, 1), (3, 2)]


def test_templates(spark):
    rows = chat.templates(spark).collect()
    assert [r["key"] for r in rows] == ["accident_analysis", "hazard_inspection", "emergency_plan"]
    for r in rows:
        assert all("{" + p + "}" in r["user_template"] for p in ("original_text", "requirements", "context"))
    assert chat.templates(spark, "emergency_plan").count() == 1
    with pytest.raises(KeyError):
        chat.templates(spark, "nope")
