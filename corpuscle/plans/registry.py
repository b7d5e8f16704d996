"""Registry, governance, chat and log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import auth, chat, chunking, evalset, evaluate, governance, parser, registry
from corpuscle.plans import tables
from corpuscle.plans.tables import CORPUS_SQL, FILES_SQL, LOG_SQL
from corpuscle.sources import files
from corpuscle.sources.files import load
from corpuscle.streaming import jobs

WORDS = ["the ", "und ", "tion", "que ", "ea"]  # stand-ins for field keywords on the driver's texts


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.status_counts(tables.files(spark, sf_dir), registry.FILE_STATES + ["archived"])


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = registry.FILE_STATES
    return tables.files(spark, sf_dir).groupBy().pivot("status", states).count().na.fill(0).select(*states)


def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.totals(tables.files(spark, sf_dir).withColumn("chunk_count", F.lit(None).cast("int")))


def file_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).filter("status = 'ready'").groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("documents"))


def list_files_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.list_files(tables.files(spark, sf_dir), keyword="DOC1", file_type="国家法律", status="ready").select("filename", "file_type", "status", "size")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.point(tables.files(spark, sf_dir), "filename", "doc7.txt").select("filename", "md5", "status")


def sensitive_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.visible(tables.files(spark, sf_dir), "user").select("filename", "sensitive")


def may_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.may_touch(tables.files(spark, sf_dir), "sysadmin")


def role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.matrix(spark)


def effective_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of known, active users with the roles of a registry made of the user numbers."""
    number = F.col("user_id")
    users = load(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("user"), number.cast("string")).alias("username"), F.element_at(F.array(*map(F.lit, governance.ROLES)), (number % 4 + 1).cast("int")).alias("role"), (number % 5 != 0).alias("is_active"))
    return governance.effective_roles(tables.log(spark, sf_dir).select("id", "username"), users).select("id", "username", "role")


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = registry.log_page(tables.log(spark, sf_dir), 2, 25, username="USER1", success=1)
    return rows.select("id", "ts", "username", "action", "success")


def audit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.log_page(tables.log(spark, sf_dir), username="USER1", success=1)[1]


def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return registry.page(rows, [F.desc("created_at"), F.desc("id")], 3, 500)


def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", "queued").otherwise("completed").alias("status"))
    return jobs.claim(rows)


def _next_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.files(spark, sf_dir)
    old = rows.filter("doc_id % 7 <> 0").select("filename", "md5", "size", "status", "sensitive")
    new = rows.filter("doc_id % 3 = 0").select("filename", F.when(F.col("doc_id") % 6 == 0, F.col("md5")).alias("md5"), (F.col("size") + 1).alias("size"), F.lit("queued").alias("status"))
    return old, new


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _next_versions(spark, sf_dir)
    return registry.upsert(old, new, "filename", keep=["sensitive"])


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _next_versions(spark, sf_dir)
    return registry.partial_update(old.select("filename", "md5", "status"), new.select("filename", "md5", "status"), "filename")


def seed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _next_versions(spark, sf_dir)
    return registry.seed(old.select("filename", "status"), new.select("filename", "status"), "filename")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.files(spark, sf_dir)
    gone = rows.filter("status = 'failed'").select("filename")
    left = registry.cascade_delete({"files": (rows.select("filename"), "filename"), "corpus": (tables.corpus(spark, sf_dir).select("source"), "source")}, gone, "filename")
    return left["files"].withColumn("part", F.lit("files")).unionByName(left["corpus"].select(F.col("source").alias("filename"), F.lit("corpus").alias("part")))


def md5_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.files(spark, sf_dir)
    old = rows.filter("doc_id % 7 <> 0").select("filename", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("md5")).alias("md5"))
    return registry.changed(old, rows.select("filename", "md5"))


def orphan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.orphans(tables.corpus(spark, sf_dir), tables.files(spark, sf_dir).filter("status <> 'building'"))


def _chunk_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.corpus(spark, sf_dir).withColumn("source", F.concat(F.lit("group"), (F.col("id") % 50).cast("string")))
    return rows.withColumn("chunk", F.col("id"))


def first_meta_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.first_meta(_chunk_meta(spark, sf_dir))


def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.files(spark, sf_dir)
    bare = rows.select("filename", F.when(F.col("doc_id") % 2 == 0, F.col("file_type")).otherwise("").alias("file_type"), "region", "city")
    meta = rows.filter("doc_id % 3 <> 0").select(F.col("filename").alias("source"), "file_type", "region", "city")
    return registry.backfill(bare, meta)


def richest_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.richest(load(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), "source"))


def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("filename"))
    return evalset.match_domain(names, evalset.domains(spark, WORDS)).select("doc_id", "domain")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.even_sample(load(spark, sf_dir, "documents").select("doc_id"), 37, "doc_id")


def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sample(tables.queries(spark, sf_dir), 15)


def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    contexts = chat.last_questions(messages).select("conv_id", F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("CONTEXT "), F.col("text"))).alias("context"))
    return chat.inject_context(messages, contexts)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("n"), "role", "text")
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("data: "), "text")).when((F.col("role") == "user") & (F.col("n") > 2), F.lit("data: [DONE]")).otherwise(F.lit(": keep-alive"))
    return rows.select("stream", "n", line.alias("line"))


def sse_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.sse_data(_stream(spark, sf_dir)).select("stream", "n", "data")


def sse_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.sse_data(_stream(spark, sf_dir)).select("stream", "n", "data")
    payloads = rows.select("stream").distinct().withColumn("payload", F.when(F.col("stream") % 3 != 0, F.concat(F.lit("sources of "), F.col("stream").cast("string"))))
    return chat.sse_inject(rows, payloads)


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original_text"), F.col("source").alias("task_type"), F.repeat("source", 30).alias("filename"))
    return rows.select("doc_id", F.array_join(registry.invalid(rows), ",").alias("invalid"))


def claim_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs after the next one was claimed: their states, and which is in processing."""
    _, after = jobs.claim_next(_jobs(spark, sf_dir))
    return after.select("id", "status")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.col("event_type")
    status = F.when(kinds == "click", "queued").when(kinds == "error", "failed").when(kinds == "view", "processing").otherwise("completed")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"))


def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restart, with every third job asked for again."""
    rows = jobs.recover(_jobs(spark, sf_dir))
    return jobs.retry(rows, rows.filter("id % 3 = 0")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def jobs_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the report of those that have one."""
    rows = _jobs(spark, sf_dir)
    reports = rows.filter("status = 'completed' AND id % 2 = 0").select("id", F.concat(F.lit("# Report "), F.col("id").cast("string")).alias("report_content"))
    return registry.with_reports(rows, reports).select("id", "status", "report_content")


def users_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return registry.list_users(rows).withColumn("n", F.monotonically_increasing_id() >= 0)


def accelerator_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures read out of status lines made of events."""
    n = F.col("event_id")
    said = lambda c: c.cast("string")
    line = F.concat(F.lit("\x1b[32m"), said(n % 90 + 5), F.lit("C\x1b[0m "), said(n % 100), F.lit("% "), said(n % 37), F.lit("% 25M 900M Active "), said(n % 901), F.lit("M 12MB/40MB "), said(n % 8000), F.lit("MB/ 8192"))
    rows = load(spark, sf_dir, "events").select(n.alias("id"), files.accelerator(F.when(n % 10 != 0, line).otherwise("")).alias("a"))
    return rows.select("id", "a.*")


def process_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    statm = F.when(n % 9 != 0, F.concat(F.lit("9 "), (n * 13).cast("string"), F.lit(" 1"))).otherwise("")
    rows = load(spark, sf_dir, "events").select(n.alias("pid"), F.concat(F.lit("proc"), (n % 5).cast("string"), F.lit("\x00--x")).alias("cmdline"), statm.alias("statm"))
    return files.processes(rows)


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, governance.ROLES)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), role.alias("role"), (F.col("c_custkey") % 5 != 0).alias("is_active"), F.col("c_custkey").alias("key"))


SECRET = "a key for the tables of the driver"


def issued_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all accounts, and what they say when they are read: expired and forged ones say nothing."""
    rows = _accounts(spark, sf_dir).withColumn("token", auth.token(F.col("username"), F.col("role"), F.lit(1_700_000_000) + F.col("key"), 60, SECRET))
    forged = F.when(F.col("key") % 3 == 0, F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    said = auth.claims(forged, F.when(F.col("key") % 4 == 0, F.lit(1_800_000_000)).otherwise(F.lit(1_700_000_000)), SECRET)
    return rows.select("username", "token", said["sub"].alias("sub"), said["role"].alias("role"), said["exp"].alias("exp"))


def login_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins of known, inactive and unknown users, with right and wrong passwords, as the log tells them."""
    accounts = _accounts(spark, sf_dir)
    attempts = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("Customer#%09d", F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 10_000_000).otherwise(0)).alias("username"), (F.col("o_orderkey") % 4 != 0).alias("right"))
    return auth.logins(attempts, accounts.drop("key"), F.col("right")).select("id", "username", "role", "ok", "detail")


def audit_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with the roles of users that are known."""
    events = load(spark, sf_dir, "orders").select(F.format_string("Customer#%09d", F.col("o_custkey") * 2).alias("username"), F.lit("login").alias("action"), F.col("o_orderkey").cast("string").alias("target"), F.when(F.col("o_orderkey") % 2 == 0, "x").alias("detail"), F.lit(None).cast("string").alias("ip"), (F.col("o_orderkey") % 3 == 0).alias("ok"))
    return governance.audit_rows(events, _accounts(spark, sf_dir)).select("username", "role", "action", "target", "detail", "ip", "success")


def unaudited_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged actions that are not among those to be audited."""
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "login", F.col("event_type")).when(F.col("event_id") % 2 == 0, "delete_document").otherwise(F.col("event_type")).alias("action"))
    return governance.unknown_actions(rows)


def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of all probes, one set a row."""
    n = F.col("event_id")
    up, chat_up, report_up = n % 7 != 0, n % 3 != 0, n % 2 == 0
    index = F.element_at(F.array(F.lit("ok"), F.lit("loading"), F.lit("error")), (n % 5 % 3 + 1).cast("int"))
    return load(spark, sf_dir, "events").select(n.alias("id"), governance.health(up, chat_up, report_up, index).alias("health"), governance.engine_status(chat_up, report_up).alias("engines"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of jobs by their template."""
    key = F.element_at(F.array(*[F.lit(t[0]) for t in chat.TEMPLATES]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), key.alias("task_type"), F.col("text").alias("original_text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("requirements"), F.col("source").alias("context"))
    return chat.prompts(rows, chat.templates(spark)).select("id", F.md5("system").alias("system"), F.md5("user").alias("user"))


def reports_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the list of their sources below, where there are any."""
    sources = F.when(F.col("doc_id") % 3 != 0, F.array(F.col("source"), F.col("lang")))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(chat.append_sources(F.col("text"), sources)).alias("md5"))


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together from the deltas of streams."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("n"), F.concat(F.lit("data: "), F.when(F.col("role") == "system", F.lit("not json")).otherwise(chat.sse_chunk(F.col("text")))).alias("line"))
    return chat.sse_answers(chat.sse_data(rows)).select("stream", F.md5("answer").alias("answer"))


def written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text functions on every document: list of a string, suffix and name of a path, summary of a message, text without thoughts."""
    path = F.concat(F.lit("a\\b/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    listed = T.csv_list(F.when(F.col("doc_id") % 4 != 0, F.concat("lang", F.lit(", ,"), "source", F.lit(",,"))))
    return load(spark, sf_dir, "documents").select("doc_id", T.basename(path).alias("name"), T.suffix(path).alias("suffix"), F.array_join(listed, "|").alias("listed"), T.message_summary(F.col("text")).alias("summary"), F.md5(T.without_thoughts(F.concat(F.lit("<think>"), "text", F.lit("</think>\n"), "source"))).alias("plain"))


def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with new rows that lack a column."""
    old, new = _next_versions(spark, sf_dir)
    return registry.insert(old.select("filename", "md5", "size"), new.select("filename", "size")).select("filename", "md5", "size")


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.set_flag(tables.files(spark, sf_dir), "filename", "doc7.txt", "sensitive", True).select("filename", "sensitive")


def allowed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users for each permission."""
    accounts = _accounts(spark, sf_dir)
    out = None
    for permission in governance.MATRIX:
        one = governance.allowed(accounts, permission).select(F.lit(permission).alias("permission"), "username")
        out = one if out is None else out.unionByName(one)
    return out


def known_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by whether their status is one of those there are."""
    rows = _jobs(spark, sf_dir).withColumn("status", F.when(F.col("id") % 5 == 0, F.upper("status")).otherwise(F.col("status")))
    return rows.select("id", registry.known_status(F.col("status")).alias("known"))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in which one source of three was written anew, and one was deleted."""
    index = tables.corpus(spark, sf_dir).select(F.col("id"), "source", F.lit("old").alias("state"))
    new = index.filter("id % 3 = 0").withColumn("state", F.lit("new"))
    return chunking.delete_source(chunking.replace_sources(index, new), "doc7.txt")


def legal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are legal ones: documents with two or three lines in front that start as articles do."""
    heads = F.when(F.col("doc_id") % 2 == 0, "第一条 a\n第 2 条 b\n 第三章 c\n").otherwise("第一条 a\n第二节 b\n")
    return load(spark, sf_dir, "documents").select("doc_id", parser.is_legal(F.concat(heads, "text")).alias("legal"))


def places_and_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases for the place and topic of files with names as laws have them."""
    k = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    region, city, ending = pick(["", "广东省", "北京市", "广西壮族自治区"], k), pick(["", "", "深圳市"], k), pick(["管理条例", "实施细则", "规定", "办法", "通知"], k)
    name = F.concat(pick(["《", ""], k), region, F.lit("消防"), k.cast("string"), ending, pick([".docx", ".DOC", ".txt"], k))
    return load(spark, sf_dir, "customer").select("c_custkey", evalset.place_phrase(region, city).alias("place"), evalset.topic_phrase(name).alias("topic"))


def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries out of the registry: how many of each kind, and what they are about."""
    fields = F.element_at(F.array(F.lit("消防"), F.lit("电梯"), F.lit("其他")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = tables.files(spark, sf_dir).withColumn("filename", F.concat(fields, "filename"))
    made = evalset.generate(rows, 10)
    return made.select("kind", "doc", F.element_at("gold", 1).alias("gold"), F.array_join("file_types", ",").alias("types"), F.array_join("provinces", ",").alias("provinces"), F.array_join("cities", ",").alias("cities"), (F.length("q") >= 500).alias("long"))


def change_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    return rows.select("c_custkey", governance.change_text({"full_name": name, "nation": F.col("c_nationkey")}).alias("change"))


QUERIES = {
    f.__name__: f
    for f in (
        status_counts, status_pivot, registry_stats, file_type_counts, distinct_sources, list_files_filtered, point_lookup, sensitive_hidden, may_delete, role_matrix, effective_roles, audit_page, audit_total, jobs_page, fifo_claim, registry_upsert, partial_update, seed_missing,
        cascade_delete, md5_changed, orphan_sources, first_meta_per_source, metadata_backfill, richest_collection, domain_lookup, even_sample, sample_by_hash, chat_context, sse_pass, sse_inject, validators, change_texts,
        inserted_rows, flagged_rows, allowed_users, known_statuses, index_upsert, legal_files, places_and_topics, generated_queries, claim_marked, recovered_jobs, jobs_with_reports, users_in_order, accelerator_figures, process_sizes, issued_tokens, login_outcomes, audit_of_users, unaudited_actions, health_states, prompt_texts, reports_with_sources, stream_answers, written_forms,
    )
}

_FILES = f"WITH files AS ({FILES_SQL})"
_LOG = f"WITH log AS ({LOG_SQL})"
_NEXT = f"""{_FILES}, o AS (SELECT filename, md5, size, status, sensitive FROM files WHERE doc_id % 7 <> 0),
n AS (SELECT filename, CASE WHEN doc_id % 6 = 0 THEN md5 END AS md5, size + 1 AS size, 'queued' AS status FROM files WHERE doc_id % 3 = 0)"""
_JOBS = "WITH j AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status FROM events)"
_ACCOUNTS = f"WITH a AS (SELECT c_name AS username, {governance.ROLES}[c_custkey % 4 + 1] AS role, c_custkey % 5 <> 0 AS active, c_custkey AS key FROM customer)"
_URL = "rtrim(replace(replace(base64({0}), '+', '-'), '/', '_'), '=')"
_PADS = ["unhex('" + bytes(b ^ x for b in SECRET.encode().ljust(64, bytes(1))).hex() + "')" for x in (0x36, 0x5C)]
_TOKENS = f"""{_ACCOUNTS}, b AS (SELECT *, 1700000000 + key + 3600 AS exp, {_URL.format(f"encode('{auth.HEADER}')")} || '.' || {_URL.format("""encode('{"sub":"' || username || '","role":"' || role || '","iat":' || (1700000000 + key) || ',"exp":' || (1700000000 + key + 3600) || '}')""")} AS body FROM a),
t AS (SELECT *, body || '.' || {_URL.format(f"unhex(sha256({_PADS[1]} || unhex(sha256({_PADS[0]} || encode(body)))))")} AS token FROM b)"""
_SSE = """WITH lines AS (SELECT conv_id AS stream, turn AS n, CASE WHEN role = 'assistant' THEN concat('data: ', text) WHEN role = 'user' AND turn > 2 THEN 'data: [DONE]' ELSE ': keep-alive' END AS line FROM conversations),
d AS (SELECT stream, n, regexp_replace(substr(line, 6), '^\\s+|\\s+$', '', 'g') AS data FROM lines WHERE line LIKE 'data:%'),
s AS (SELECT stream, min(n) AS stop FROM d WHERE data = '[DONE]' GROUP BY stream),
kept AS (SELECT d.stream, n, data FROM d LEFT JOIN s ON d.stream = s.stream WHERE stop IS NULL OR n <= stop)"""
_MATRIX = ", ".join(f"('{p}', '{r}')" for p, roles in governance.MATRIX.items() for r in roles)
ORACLE_SQL = {
    "status_counts": f"{_FILES}, s AS (SELECT unnest(['ready', 'failed', 'building', 'archived']) AS status) SELECT status, coalesce(n, 0) AS n FROM s FULL JOIN (SELECT status, count(*) AS n FROM files GROUP BY status) c USING (status)",
    "status_pivot": f"{_FILES} SELECT count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'building') AS building FROM files",
    "registry_stats": f"{_FILES} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS chunks FROM files",
    "file_type_counts": f"{_FILES} SELECT file_type, count(*) AS n FROM files WHERE status = 'ready' GROUP BY file_type",
    "distinct_sources": "SELECT count(DISTINCT source) AS sources, count(*) AS documents FROM documents",
    "list_files_filtered": f"{_FILES} SELECT filename, file_type, status, size FROM files WHERE filename ILIKE '%doc1%' AND file_type = '国家法律' AND status = 'ready'",
    "point_lookup": f"{_FILES} SELECT filename, md5, status FROM files WHERE filename = 'doc7.txt'",
    "sensitive_hidden": f"{_FILES} SELECT filename, sensitive FROM files WHERE NOT sensitive",
    "may_delete": f"{_FILES} SELECT filename, NOT sensitive AS permitted FROM files",
    "role_matrix": f"SELECT * FROM (VALUES {_MATRIX}) t(permission, role)",
    "effective_roles": f"{_LOG}, u AS (SELECT DISTINCT concat('user', CAST(user_id AS varchar)) AS username, ['user', 'sysadmin', 'secadmin', 'audadmin'][user_id % 4 + 1] AS role FROM events WHERE user_id % 5 <> 0) SELECT id, username, role FROM log JOIN u USING (username)",
    "audit_page": f"{_LOG} SELECT id, ts, username, action, success FROM log WHERE username ILIKE '%user1%' AND success = 1 ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 25",
    "audit_total": f"{_LOG} SELECT count(*) AS total FROM log WHERE username ILIKE '%user1%' AND success = 1",
    "jobs_page": "SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 200",
    "fifo_claim": "SELECT event_id AS id, ts AS created_at, 'queued' AS status FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1",
    "registry_upsert": f"{_NEXT} SELECT coalesce(o.filename, n.filename) AS filename, CASE WHEN n.filename IS NULL THEN o.md5 ELSE n.md5 END AS md5, coalesce(n.size, o.size) AS size, coalesce(n.status, o.status) AS status, sensitive FROM o FULL JOIN n ON o.filename = n.filename",
    "partial_update": f"{_NEXT} SELECT o.filename, coalesce(n.md5, o.md5) AS md5, coalesce(n.status, o.status) AS status FROM o LEFT JOIN n ON o.filename = n.filename",
    "seed_missing": f"{_NEXT} SELECT filename, status FROM o UNION ALL SELECT filename, status FROM n WHERE filename NOT IN (SELECT filename FROM o)",
    "cascade_delete": f"{_FILES} SELECT filename, unnest(['files', 'corpus']) AS part FROM files WHERE status <> 'failed'",
    "md5_changed": f"{_FILES} SELECT filename, md5 FROM files WHERE doc_id % 7 = 0 OR doc_id % 5 = 0",
    "orphan_sources": f"{_FILES} SELECT filename AS source FROM files WHERE status = 'building'",
    "first_meta_per_source": f"SELECT source, file_type, region, city FROM (SELECT concat('group', CAST(id % 50 AS varchar)) AS source, id, file_type, region, city FROM ({CORPUS_SQL})) QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) = 1",
    "metadata_backfill": f"""{_FILES}, b AS (SELECT filename, doc_id, CASE WHEN doc_id % 2 = 0 THEN file_type ELSE '' END AS bare, file_type, region, city FROM files),
l AS (SELECT *, bare = '' OR region = '' OR city = '' AS lacks FROM b)
SELECT filename, CASE WHEN NOT lacks THEN bare WHEN doc_id % 3 <> 0 THEN file_type ELSE '地方法规' END AS file_type, CASE WHEN NOT lacks OR doc_id % 3 <> 0 THEN region ELSE '' END AS region, CASE WHEN NOT lacks OR doc_id % 3 <> 0 THEN city ELSE '' END AS city FROM l""",
    "richest_collection": "SELECT lang AS collection, count(DISTINCT source) AS sources FROM documents GROUP BY lang ORDER BY 2 DESC, 1 LIMIT 1",
    "domain_lookup": f"WITH w AS (SELECT unnest({WORDS}) AS k, unnest(range({len(WORDS)})) AS i), t AS (SELECT doc_id, text AS f FROM documents) SELECT t.doc_id, min_by(k, i) AS domain FROM t LEFT JOIN w ON contains(f, k) GROUP BY t.doc_id",
    "inserted_rows": f"{_NEXT} SELECT filename, md5, size FROM o UNION ALL SELECT filename, NULL, size FROM n",
    "flagged_rows": f"{_FILES} SELECT filename, sensitive OR filename = 'doc7.txt' AS sensitive FROM files",
    "allowed_users": f"{_ACCOUNTS}, m(permission, role) AS (VALUES {', '.join(f"('{p}', '{r}')" for p, roles in governance.MATRIX.items() for r in roles)}) SELECT permission, username FROM a JOIN m USING (role) WHERE active",
    "known_statuses": f"{_JOBS} SELECT id, id % 5 <> 0 AS known FROM j",
    "index_upsert": f"SELECT id, source, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM ({CORPUS_SQL}) WHERE source <> 'doc7.txt'",
    "legal_files": "SELECT doc_id, doc_id % 2 = 0 AS legal FROM documents",
    "places_and_topics": """WITH n AS (SELECT c_custkey, ['', '广东省', '北京市', '广西壮族自治区'][c_custkey % 4 + 1] AS region, ['', '', '深圳市'][c_custkey % 3 + 1] AS city, ['管理条例', '实施细则', '规定', '办法', '通知'][c_custkey % 5 + 1] AS ending, ['.docx', '.DOC', '.txt'][c_custkey % 3 + 1] AS suffix FROM customer)
SELECT c_custkey, CASE WHEN city <> '' THEN '深圳' WHEN region = '' THEN '本地' ELSE ['', '广东', '北京', '广西'][c_custkey % 4 + 1] END AS place,
  CASE WHEN region = '广西壮族自治区' THEN '' ELSE '' END || '消防' || c_custkey || CASE WHEN suffix = '.txt' THEN ending || suffix WHEN ending = '通知' THEN ending ELSE '' END AS topic FROM n""",
    "generated_queries": f"""{_FILES}, r AS (SELECT *, ['消防', '电梯', '其他'][doc_id % 3 + 1] || filename AS name, doc_id % 3 < 2 AS fielded FROM files WHERE status = 'ready'),
s AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS n FROM r WHERE fielded),
w AS (SELECT CAST(round_even(i * ((SELECT count(*) FROM s) - 1) / 9::DOUBLE, 0) AS BIGINT) AS n FROM range(10) t(i)),
k AS (SELECT 'short' AS kind, * FROM r UNION ALL SELECT 'news', * FROM r WHERE fielded UNION ALL SELECT 'long', * FROM r WHERE name IN (SELECT name FROM s JOIN w USING (n)))
SELECT kind, name AS doc, name AS gold, file_type AS types, region AS provinces, city AS cities, kind = 'long' AS long FROM k""",
    "claim_marked": f"{_JOBS} SELECT id, CASE WHEN id = (SELECT id FROM j WHERE status = 'queued' ORDER BY created_at, id LIMIT 1) THEN 'processing' ELSE status END AS status FROM j",
    "recovered_jobs": f"{_JOBS} SELECT CASE WHEN status = 'processing' OR (status = 'failed' AND id % 3 = 0) THEN 'queued' ELSE status END AS status, count(*) AS n FROM j GROUP BY 1",
    "jobs_with_reports": f"{_JOBS} SELECT id, status, CASE WHEN status = 'completed' AND id % 2 = 0 THEN '# Report ' || id END AS report_content FROM j",
    "users_in_order": "SELECT c_custkey AS id, c_name AS username, true AS n FROM customer ORDER BY c_custkey",
    "accelerator_figures": """SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 90 + 5 AS INT) END AS temperature_c, CASE WHEN event_id % 10 <> 0 THEN round((event_id % 100 + event_id % 37) / 2.0::DOUBLE, 1) END AS util_percent,
  CASE WHEN event_id % 10 <> 0 THEN 25 END AS clock_mhz_min, CASE WHEN event_id % 10 <> 0 THEN 900 END AS clock_mhz_max, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 901 AS INT) END AS clock_mhz_cur, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 8000 AS INT) END AS memory_used_mb, CASE WHEN event_id % 10 <> 0 THEN 8192 END AS memory_total_mb FROM events""",
    "process_sizes": "SELECT event_id AS pid, 'proc' || (event_id % 5) AS name, CASE WHEN event_id % 9 <> 0 THEN CAST(round_even(event_id * 13 * 4 / 1024::DOUBLE, 0) AS INT) END AS rss_mb FROM events",
    "issued_tokens": f"""{_TOKENS} SELECT username, token, CASE WHEN key % 3 <> 0 AND key % 4 <> 0 THEN username END AS sub, CASE WHEN key % 3 <> 0 AND key % 4 <> 0 THEN role END AS role, CASE WHEN key % 3 <> 0 AND key % 4 <> 0 THEN exp END AS exp FROM t""",
    "login_outcomes": f"""{_ACCOUNTS}, p AS (SELECT o_orderkey AS id, printf('Customer#%09d', o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END) AS username, o_orderkey % 4 <> 0 AS fine FROM orders)
SELECT id, p.username, CASE WHEN active THEN a.role ELSE '' END AS role, coalesce(active AND fine, false) AS ok, CASE WHEN coalesce(active AND fine, false) THEN '' ELSE 'wrong name or password' END AS detail FROM p LEFT JOIN a ON a.username = p.username""",
    "audit_of_users": f"""{_ACCOUNTS} SELECT printf('Customer#%09d', o_custkey * 2) AS username, coalesce(a.role, '') AS role, 'login' AS action, CAST(o_orderkey AS VARCHAR) AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS detail, '' AS ip, CAST(o_orderkey % 3 = 0 AS INT) AS success
FROM orders LEFT JOIN a ON a.username = printf('Customer#%09d', o_custkey * 2)""",
    "unaudited_actions": "SELECT event_id, event_type AS action FROM events WHERE event_type <> 'login' AND event_id % 2 <> 0",
    "health_states": """SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 0 AND event_id % 5 % 3 < 2 THEN 'ok' ELSE 'degraded' END AS health,
  CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 'both engines are ready' WHEN event_id % 3 <> 0 THEN 'only chat is ready' WHEN event_id % 2 = 0 THEN 'only reports are ready' ELSE 'no engine is reachable' END AS engines FROM events""",
    "prompt_texts": f"""WITH t(k, system, body) AS (VALUES {", ".join("(" + str(i) + ", " + ", ".join("'" + x + "'" for x in t[3:]) + ")" for i, t in enumerate(chat.TEMPLATES))})
SELECT doc_id AS id, md5(system) AS system, md5(replace(replace(replace(body, '{{original_text}}', text), '{{requirements}}', CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END), '{{context}}', source)) AS user FROM documents JOIN t ON k = doc_id % 3""",
    "reports_with_sources": "SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 THEN text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || source || chr(10) || chr(10) || lang ELSE text END) AS md5 FROM documents",
    "stream_answers": "SELECT conv_id AS stream, md5(coalesce(string_agg(CASE WHEN role <> 'system' THEN text END, '' ORDER BY turn), '')) AS answer FROM conversations GROUP BY conv_id",
    "written_forms": """SELECT doc_id, doc_id || '.TXT' AS name, 'txt' AS suffix, CASE WHEN doc_id % 4 <> 0 THEN lang || '|' || source ELSE '' END AS listed,
  'text(' || length(trim(text, ' ' || chr(10))) || ')' || CASE WHEN length(trim(text, ' ' || chr(10))) > 80 THEN ': ' || substr(trim(text, ' ' || chr(10)), 1, 80) || '…' WHEN trim(text, ' ' || chr(10)) <> '' THEN ': ' || trim(text, ' ' || chr(10)) ELSE '' END AS summary, md5(source) AS plain FROM documents""",
    "sample_by_hash": "SELECT item_id AS query_id, text, ['short', 'news', 'long'][item_id % 3 + 1] AS kind FROM benchmark ORDER BY md5('42/' || CAST(item_id AS varchar)), item_id LIMIT 15",
    "even_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) SELECT doc_id FROM r WHERE n IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM documents) - 1) / 36::DOUBLE, 0) AS BIGINT) FROM range(37) t(i))",
    "chat_context": """WITH l AS (SELECT conv_id, max_by(text, turn) AS text, min(turn) AS first FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, first, CASE WHEN conv_id % 4 <> 0 THEN concat('CONTEXT ', text) END AS context FROM l)
SELECT m.conv_id, turn, role, CASE WHEN context IS NOT NULL AND turn = first AND role = 'system' THEN m.text || chr(10) || chr(10) || context ELSE m.text END AS text FROM conversations m JOIN c ON m.conv_id = c.conv_id
UNION ALL SELECT m.conv_id, turn - 1, 'system', context FROM conversations m JOIN c ON m.conv_id = c.conv_id WHERE context IS NOT NULL AND turn = first AND role <> 'system'""",
    "sse_pass": f"{_SSE} SELECT stream, n, data FROM kept",
    "sse_inject": f"{_SSE} SELECT stream, n, CASE WHEN data = '[DONE]' AND stream % 3 <> 0 THEN 1 ELSE 0 END AS part, data FROM kept UNION ALL SELECT stream, n, 0, concat('sources of ', CAST(stream AS varchar)) FROM kept WHERE data = '[DONE]' AND stream % 3 <> 0",
    "validators": "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 4000 THEN 'original_text' END, CASE WHEN length(source) > 50 THEN 'task_type' END, CASE WHEN length(repeat(source, 30)) NOT BETWEEN 1 AND 100 THEN 'filename' END], lambda x: x IS NOT NULL), ',') AS invalid FROM documents",
    "change_texts": "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 <> 0 THEN 'full_name=' || c_name END, 'nation=' || CAST(c_nationkey AS varchar)) AS change FROM customer",
}
