"""Evaluation queries out of a registry: short questions, incident reports, and long reports on a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.registry import even_sample

# fixed values: suffixes of administrative units, of places at the start of a name, and of laws in the order they are tried
UNIT = "(省|市|自治区|壮族自治区|回族自治区|维吾尔自治区|特别行政区)$"
LEADING_PLACE = "^[一-龥]{2,8}?(省|市|自治区|自治州|地区|盟)"
LAW_SUFFIXES = ["管理办法", "管理条例", "管理规定", "管理暂行办法", "实施细则", "暂行规定", "若干规定", "规定", "条例", "办法", "细则", "规程", "规章"]
# fixed values: the words that tell a field, in the order they are tried
DOMAINS = ["消防", "危险化学", "危险废物", "建筑", "矿山", "特种设备", "电梯", "烟花爆竹", "食品", "燃气", "道路", "电力", "水利", "渔业", "出租屋", "学校", "运输", "疫苗", "森林", "林业", "农业", "农机", "劳动保护", "职业健康", "通信"]
# where something happens in a field, and what: this engine's own wording
SCENES = {
    "消防": ("商场地下车库", "充电车辆起火"), "危险化学": ("化工厂罐区", "储罐阀门泄漏"), "危险废物": ("废液中转库", "废液桶破裂渗漏"), "建筑": ("在建住宅楼", "脚手架局部坍塌"), "矿山": ("井下巷道", "顶板冒落"), "特种设备": ("厂房锅炉间", "锅炉超压爆裂"), "电梯": ("写字楼", "电梯轿厢突然下坠"),
    "烟花爆竹": ("零售仓库", "库存成品燃爆"), "食品": ("中央厨房", "制冷系统漏氨"), "燃气": ("沿街餐馆", "燃气管接口泄漏爆燃"), "道路": ("国道弯道", "货车与客车相撞"), "电力": ("变电站", "检修人员触电"), "水利": ("水库闸房", "泄洪闸门失灵"), "渔业": ("近海渔船", "渔船进水侧翻"), "出租屋": ("城中村出租楼", "电线短路起火"),
    "学校": ("学校实验楼", "实验药品起火"), "运输": ("高速服务区", "槽罐车侧翻泄漏"), "疫苗": ("冷链仓库", "冷库断电超温"), "森林": ("林场边缘", "野外用火引发山火"), "林业": ("采伐作业点", "伐木砸伤工人"), "农业": ("粮食烘干房", "粉尘爆炸"), "农机": ("农机合作社", "收割机侧翻"), "劳动保护": ("铸造车间", "工人中暑昏倒"), "职业健康": ("石材加工厂", "多人确诊尘肺"), "通信": ("通信铁塔", "登塔人员坠落"),
}
ANY_SCENE = ("生产现场", "发生人员受伤事故")
DEFAULT_PLACE, DEFAULT_TOPIC = "本地", "安全生产"


def place_phrase(region: Column, city: Column) -> Column:
    """City, else region, without its administrative suffix, else a word for 'here'."""
    name = F.coalesce(F.nullif(city, F.lit("")), F.nullif(region, F.lit("")))
    return F.coalesce(F.regexp_replace(F.trim(name), UNIT, ""), F.lit(DEFAULT_PLACE))


def topic_phrase(filename: Column) -> Column:
    """A file's name without suffix, title marks, leading place and the first law suffix that fits."""
    name = F.regexp_replace(F.regexp_replace(filename, r"(?i)\.docx?$", ""), "^[《》]+|[《》]+$", "")
    name = F.regexp_replace(name, LEADING_PLACE, "")
    cut = F.when(F.lit(False), name)
    for suffix in LAW_SUFFIXES:
        cut = cut.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix)))
    return F.coalesce(F.nullif(cut.otherwise(name), F.lit("")), F.lit(DEFAULT_TOPIC))


def domains(spark: SparkSession, words: list[str] = DOMAINS) -> DataFrame:
    """(ordinal, keyword): a small lookup table."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, words))).alias("ordinal", "keyword"))


def match_domain(files: DataFrame, table: DataFrame) -> DataFrame:
    """files with `domain`: the first keyword that the name holds, or null.  table: (ordinal, keyword), a few dozen rows.

    The table becomes one array, so files are matched in one pass and no pairs are made.
    """
    listed = table.agg(F.array_sort(F.collect_list(F.struct("ordinal", "keyword"))).alias("_words"))
    held = F.transform(F.filter("_words", lambda w: F.contains(F.col("filename"), w["keyword"])), lambda w: w["keyword"])
    return files.crossJoin(F.broadcast(listed)).withColumn("domain", F.try_element_at(held, F.lit(1))).drop("_words")


def _number(low: int, high: int, seed: int, salt: str) -> Column:
    """A number in [low, high] that the file's name and the seed decide."""
    return F.pmod(F.xxhash64("filename", F.lit(seed), F.lit(salt)), F.lit(high - low + 1)) + low


def date_phrase(seed: int) -> Column:
    part = F.element_at(F.array(*map(F.lit, ["清晨", "中午", "下午", "晚上"])), _number(1, 4, seed, "part").cast("int"))
    return F.format_string("%d年%d月%d日%s", _number(2020, 2027, seed, "year"), _number(1, 12, seed, "month"), _number(1, 28, seed, "day"), part)


def scene(domain: Column) -> tuple[Column, Column]:
    """(place in it, incident) of a field."""
    known = [F.create_map(*(F.lit(x) for k, v in SCENES.items() for x in (k, v[i]))) for i in (0, 1)]
    return tuple(F.coalesce(m[domain], F.lit(ANY_SCENE[i])) for i, m in enumerate(known))


def news_text(place: Column, domain: Column, seed: int) -> Column:
    where, what = scene(domain)
    hurt = _number(2, 15, seed, "hurt")
    body = F.format_string("，%s%s%s，%d人受伤，损失约%d万元。有关部门已到场。请说明应适用的规定与责任认定。", place, where, what, hurt, _number(20, 900, seed, "loss"))
    return F.concat(date_phrase(seed), body)


def long_text(place: Column, domain: Column, seed: int, least: int = 500) -> Column:
    """The news text with as many filler sentences as it takes to reach `least` characters."""
    fillers = ["现场风力较大，人员撤离用时较长。", "邻近单位协助转移了物资与设备。", "设备的检验记录正在核对。", "值班人员的处置过程被逐项复盘。", "周边道路实行临时管制。", "受伤人员情况总体平稳。", "同类场所随即开展自查。", "监控资料已经封存备查。"]
    many = F.flatten(F.array_repeat(F.shuffle(F.array(*map(F.lit, fillers)), seed), 12))
    return F.aggregate(many, news_text(place, domain, seed), lambda acc, s: F.when(F.length(acc) >= least, acc).otherwise(F.concat(acc, s)))


def generate(files: DataFrame, long_count: int = 40, seed: int = 42, file_types: list[str] | None = None) -> DataFrame:
    """Queries (q, gold, kind, file_types, provinces, cities, doc) for ready files: short always, news for a known field, long for an even sample of those.

    file_types: a fixed list for all queries; by default each file's own type.
    """
    ready = match_domain(files.filter(F.col("status") == "ready"), domains(files.sparkSession))
    sampled = even_sample(ready.filter(F.col("domain").isNotNull()).select("filename"), long_count, "filename").withColumn("_long", F.lit(True))
    rows = ready.join(sampled, "filename", "left").withColumn("place", place_phrase(F.col("region"), F.col("city")))
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("short").alias("kind"), F.concat("place", F.lit("的"), topic_phrase(F.col("filename")), F.lit("有哪些要求？")).alias("q")),
            F.when(F.col("domain").isNotNull(), F.struct(F.lit("news").alias("kind"), news_text(F.col("place"), F.col("domain"), seed).alias("q"))),
            F.when(F.col("_long"), F.struct(F.lit("long").alias("kind"), long_text(F.col("place"), F.col("domain"), seed).alias("q"))),
        )
    )
    one = lambda c: F.filter(F.array(F.coalesce(F.col(c), F.lit(""))), lambda x: x != "")
    types = F.array(*map(F.lit, file_types)) if file_types is not None else one("file_type")
    return rows.select(F.explode(kinds).alias("_q"), F.array("filename").alias("gold"), types.alias("file_types"), one("region").alias("provinces"), one("city").alias("cities"), F.col("filename").alias("doc")).select("_q.q", "gold", "_q.kind", "file_types", "provinces", "cities", "doc")


def long_chunks(chunks: DataFrame, tokenizer, most: int = 510) -> DataFrame:
    """Chunks of more than `most` tokens, with their number."""
    return chunks.withColumn("tokens", F.size(tokenizer(F.col("text")))).filter(F.col("tokens") > most)
