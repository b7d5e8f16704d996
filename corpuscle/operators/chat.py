"""Conversations: the question, injected context, prompts, and streams of server-sent events as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T

DONE = "[DONE]"
# keys are fixed values; the wording is this engine's own
TEMPLATES = [
    ("accident_analysis", "事故分析", "分析事故经过与责任", "你是安全生产分析人员，只依据所给条文作答。", "事故材料：\n{original_text}\n\n要求：{requirements}\n\n条文：\n{context}\n\n请写出事故经过、原因、责任与依据。"),
    ("hazard_inspection", "隐患排查", "列出隐患与整改", "你是隐患排查人员，只依据所给条文作答。", "现场情况：\n{original_text}\n\n要求：{requirements}\n\n条文：\n{context}\n\n请逐项列出隐患、依据与整改期限。"),
    ("emergency_plan", "应急预案", "起草应急预案", "你是应急预案编制人员，只依据所给条文作答。", "单位概况：\n{original_text}\n\n要求：{requirements}\n\n条文：\n{context}\n\n请起草预案：组织、预警、响应、恢复。"),
]


def last_questions(messages: DataFrame) -> DataFrame:
    """(conv_id, text) of each conversation's last message; messages (conv_id, turn, role, text)."""
    return messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def inject_context(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """Messages with the context in the leading system message, or in a new one before all.

    contexts: (conv_id, context); conversations without or with a blank one stay as they are.
    """
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    rows = messages.join(contexts, "conv_id", "left").withColumn("_first", first)
    has = F.coalesce(F.col("context"), F.lit("")) != ""
    leads = (F.col("turn") == F.col("_first")) & (F.col("role") == "system")
    merged = F.when(has & leads, F.concat_ws("\n\n", "text", "context")).otherwise(F.col("text"))
    kept = rows.select("conv_id", "turn", "role", merged.alias("text"))
    new = rows.filter(has & (F.col("turn") == F.col("_first")) & (F.col("role") != "system")).select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), F.col("context").alias("text"))
    return kept.unionByName(new)


def templates(spark: SparkSession, key: str | None = None) -> DataFrame:
    """(key, name, description, system_prompt, user_template); an unknown key is an error."""
    if key is not None and key not in {t[0] for t in TEMPLATES}:
        raise KeyError(key)
    rows = [t for t in TEMPLATES if key in (None, t[0])]
    return spark.createDataFrame(rows, "key string, name string, description string, system_prompt string, user_template string")


def prompts(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, system, user) of jobs (id, task_type, original_text, requirements, context) by their template; templates are few."""
    t = templates.select(F.col("key").alias("task_type"), "system_prompt", "user_template")
    user = T.fill(F.col("user_template"), original_text=F.col("original_text"), requirements=F.col("requirements"), context=F.col("context"))
    return jobs.join(t, "task_type").select("id", F.col("system_prompt").alias("system"), user.alias("user"))


def append_sources(report: Column, sources: Column, title: str = "References") -> Column:
    """The report, a rule, a heading and the sources, apart by blank lines; without sources the report alone."""
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.concat(report, F.lit(f"\n\n---\n\n## {title}\n\n"), F.array_join(sources, "\n\n"))).otherwise(report)


def sse_data(rows: DataFrame) -> DataFrame:
    """Of stream lines (stream, n, line): the data lines up to the first [DONE], with `data` as their payload."""
    data = rows.filter(F.col("line").startswith("data:")).withColumn("data", T.strip(F.substring("line", 6, 1 << 30)))
    stop = F.min(F.when(F.col("data") == DONE, F.col("n"))).over(Window.partitionBy("stream"))
    return data.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("n") <= F.col("_stop"))).drop("_stop")


def sse_inject(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Stream rows (stream, n, data) with a payload row just before each [DONE]; payloads: (stream, payload), null for none.

    Rows get the number `part`: 0 for what was there and 0 before 1 where a payload goes first.
    """
    joined = rows.join(payloads, "stream", "left")
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("payload").alias("data")), F.struct(F.lit(1).alias("part"), F.col("data").alias("data")))
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("data").alias("data")))
    out = joined.select("stream", "n", F.explode(F.when((F.col("data") == DONE) & F.col("payload").isNotNull(), both).otherwise(one)).alias("_r"))
    return out.select("stream", "n", "_r.part", "_r.data")


def sse_chunk(text: Column) -> Column:
    """The JSON of a delta."""
    return F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices")))


def sources_chunk(sources: Column) -> Column:
    return F.to_json(F.struct(sources.alias("sources")))


# fixed values: the marks of a turn
TURN, TURN_END = "<|im_start|>", "<|im_end|>"


def chat_texts(messages: DataFrame) -> DataFrame:
    """(conv_id, text): turns (conv_id, turn, role, text) as marked text, in order, with the assistant's turn begun."""
    one = F.concat(F.lit(TURN), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_END + "\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", one.alias("text"))))
    whole = F.array_join(F.transform(turns, lambda x: x["text"]), "")
    return messages.groupBy("conv_id").agg(F.concat(whole, F.lit(f"{TURN}assistant\n")).alias("text"))


def substitute_paths(prompts: DataFrame, files: DataFrame, text: str = r"(?i)\.(txt|md)$") -> DataFrame:
    """(id, prompt, media, ignored) of prompts (id, prompt): words between blanks, @name of a text file as its text.

    The first @name of another kind is the medium and leaves the prompt, as do further ones, which are counted; text files
    that are not there stay as they are written.  files: (filename, text).
    """
    words = prompts.select("id", F.posexplode(F.filter(F.split(F.coalesce("prompt", F.lit("")), r"\s+"), lambda x: x != "")).alias("n", "word"))
    named = words.withColumn("name", F.when(F.col("word").startswith("@") & (F.length("word") > 1), F.substring("word", 2, 1 << 30)))
    is_text = F.col("name").rlike(text)
    read = named.withColumn("_text", F.when(is_text, F.col("name"))).join(files.select(F.col("filename").alias("_text"), F.col("text").alias("_body")), "_text", "left")
    media = F.col("name").isNotNull() & ~is_text
    rows = read.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(~F.coalesce(media, F.lit(False)), F.struct("n", F.coalesce("_body", "word").alias("w"))))).alias("kept"),
        F.min(F.when(media, F.struct("n", "name"))).alias("first"),
        F.count_if(media).alias("media"),
    )
    return rows.select("id", F.array_join(F.transform("kept", lambda x: x["w"]), " ").alias("prompt"), F.col("first.name").alias("media"), F.greatest(F.col("media") - 1, F.lit(0)).alias("ignored"))


def assemble(tokens: DataFrame) -> DataFrame:
    """(stream, words) of a stream's byte tokens (stream, n, token): tokens are held until they are whole characters.

    What is never whole comes last, with replacement characters.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(b"").alias("held"))

    def step(a: Column, token: Column) -> Column:
        both = F.concat(a["held"], token)
        whole = F.struct(F.concat(a["out"], F.array(both.cast("string"))).alias("out"), F.lit(b"").alias("held"))
        return F.when(F.is_valid_utf8(both.cast("string")), whole).otherwise(F.struct(a["out"].alias("out"), both.alias("held")))

    def end(a: Column) -> Column:
        return F.when(F.octet_length(a["held"]) > 0, F.concat(a["out"], F.array(F.make_valid_utf8(a["held"].cast("string"))))).otherwise(a["out"])

    return tokens.groupBy("stream").agg(ordered.alias("t")).select("stream", F.aggregate("t", zero, step, end).alias("words"))


CHUNK = "choices array<struct<delta:struct<content:string>,message:struct<content:string>>>"


def sse_answers(rows: DataFrame) -> DataFrame:
    """(stream, answer): the contents of all deltas of a stream's data rows (stream, n, data), in order; other rows say nothing."""
    said = F.from_json("data", CHUNK)["choices"]
    one = F.get(said, F.lit(0))
    parts = rows.filter(F.col("data") != DONE).select("stream", "n", F.coalesce(one["delta"]["content"], one["message"]["content"]).alias("text"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("n", "text"))))
    return parts.groupBy("stream").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("answer"))


def generate(jobs: DataFrame, model, batch: int = 32) -> DataFrame:
    """(id, answer, error) of prompts (id, system, user) from a pluggable model(list of (system, user)) -> list of str.

    The model is called once for `batch` jobs, and again for each of them where that fails.

    A job that fails is a row with an error; it does not stop the others.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                asked, ids, rows = list(zip(some["system"], some["user"], strict=True)), some["id"].tolist(), []
                try:
                    rows = [(i, plain_answer(a), None) for i, a in zip(ids, model(asked), strict=True)]
                except Exception:  # noqa: BLE001  one of the batch fails: each by itself
                    for i, one in zip(ids, asked, strict=True):
                        try:
                            rows.append((i, plain_answer(model([one])[0]), None))
                        except Exception as e:  # noqa: BLE001
                            rows.append((i, None, str(e)))
                yield pd.DataFrame(rows, columns=["id", "answer", "error"])

    kind = dict(jobs.dtypes)["id"]
    return jobs.select("id", "system", "user").mapInPandas(run, f"id {kind}, answer string, error string")


def plain_answer(answer: str) -> str:
    import re

    return re.sub(r"(?s)<think>.*?</think>\s*", "", answer)
