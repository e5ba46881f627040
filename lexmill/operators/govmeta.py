"""Metadata of official documents: title, number, authority, date, type, topics, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import contains_any, file_stem, is_blank, trimmed, trimmed_start

#: Keyword lists in the order in which they are tried.
AUTHORITIES = ["党委组织部", "人力资源部", "人力资源", "人资部", "纪检监察", "纪检组", "纪委", "公司办公室", "综合管理部", "综合部", "办公室", "集团党委", "党委", "党组", "董事会", "总经理办公室", "财务部", "审计部", "风控部", "法务部", "合规部", "工会", "团委", "妇联", "组织部"]
TYPES = (
    ("notice", ["通知"]),
    ("plan", ["方案", "实施方案", "工作方案"]),
    ("measure", ["办法", "实施办法", "管理办法"]),
    ("policy", ["制度", "管理制度"]),
    ("regulation", ["规定", "暂行规定"]),
    ("request", ["请示"]),
    ("report", ["报告", "情况报告", "自查报告"]),
    ("training", ["培训", "培训材料", "培训方案"]),
    ("checklist", ["清单", "问题清单", "明细表"]),
    ("opinion", ["意见", "指导意见", "实施意见"]),
    ("decision", ["决定", "决议"]),
    ("letter", ["函", "复函", "公函"]),
    ("minutes", ["纪要", "会议纪要"]),
    ("bulletin", ["通报", "通报批评", "通报表扬"]),
    ("approval", ["批复"]),
)
TOPICS = (
    ("hr", ["人事", "人员", "员工", "招聘", "入职", "离职", "退休", "调动", "编制", "用工"]),
    ("salary", ["薪酬", "工资", "薪资", "奖金", "绩效", "收入分配", "待遇", "补贴", "津贴"]),
    ("cadre", ["干部", "任免", "选拔", "考察", "提拔", "晋升", "任职", "选人用人"]),
    ("inspection", ["整改", "监督", "专项检查", "回头看"]),
    ("regulation", ["制度", "规定", "办法", "规则", "流程", "规范", "标准"]),
    ("training", ["培训", "培训班", "培训方案", "培训计划", "技能鉴定"]),
    ("assessment", ["考核", "评价", "评议", "测评", "KPI", "考评", "绩效考核"]),
    ("labor", ["劳动合同", "用工", "社保", "保险", "公积金", "工伤"]),
    ("organization", ["组织架构", "机构设置", "职责分工", "职能调整", "部门调整"]),
    ("discipline", ["纪委", "廉洁", "廉政", "纪律", "作风", "问责", "处分"]),
    ("strategy", ["战略协议", "战略合作", "战略规划", "行动计划", "转型方案", "行动方案"]),
    ("digital", ["数字化转型", "数字化", "信息化", "AI转型", "智慧化", "数智化"]),
    ("enterprise", ["政企", "政企合作", "政企客户", "商企", "企业客户", "大客户"]),
    ("reform", ["改革", "深化改革", "企业改革", "机制改革", "体制机制"]),
)
INVALID_TITLES = ["目录", "前言", "扫描件", "封面", "空白", "无标题", "untitled"]
BRACKETED = r"[〔\[（(]\s*\d{4}\s*[〕\]）)]\s*\d{1,4}\s*号"
NUMBER = r"(?U)(?<![a-zA-Z\x{4E00}-\x{9FFF}])[a-zA-Z\x{4E00}-\x{9FFF}]{2,10}" + BRACKETED
CHINESE_DATE = r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
ISO_DATE = r"(\d{4})[-.](\d{1,2})[-.](\d{1,2})"
EARLIEST = 1980


def _valid(title: Column) -> Column:
    return ~(is_blank(title) | (F.length(title) < 2) | contains_any(F.lower(title), [w.lower() for w in INVALID_TITLES]))


def _cleaned(title: Column) -> Column:
    new = trimmed(F.regexp_replace(title, r"(?U)^\d+[.、\s]+", ""))
    return F.when(new == "", title).otherwise(new)


def first_heading(md: Column) -> Column:
    """The text of the first line that is a heading of level one, or null."""
    line = F.get(F.filter(F.split(md, "\n"), lambda x: trimmed_start(x).startswith("# ")), F.lit(0))
    return trimmed(F.substring(trimmed_start(line), 3, 1 << 30))


def title(first: Column, stem: Column) -> Column:
    return F.when(F.coalesce(_valid(first), F.lit(False)), _cleaned(first)).when(_valid(stem), _cleaned(stem))


def document_number(md: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(md, NUMBER, 0), F.lit("")), F.regexp_extract(md, "(?U)" + BRACKETED, 0))
    return F.nullif(found, F.lit(""))


def issuing_authority(md: Column) -> Column:
    """The longest keyword (first of equals) in the head, else further down, else in the tail of a long text."""
    ranked = F.array(*[F.lit(w) for w in sorted(AUTHORITIES, key=lambda w: -len(w))])

    def best(area: Column) -> Column:
        # the area is cut once, not for each keyword
        return F.get(F.transform(F.array(area), lambda a: F.get(F.filter(ranked, lambda k: F.contains(a, k)), F.lit(0))), F.lit(0))

    tail = F.when(F.length(md) > 2000, best(F.substring(md, -1000, 1000)))
    return F.coalesce(best(F.substring(md, 1, 500)), best(F.substring(md, 1, 2000)), tail)


def publish_date(md: Column, latest: int) -> Column:
    """yyyy-mm-dd as text, valid in the calendar or not; years from 1980 to ``latest``."""
    body = F.regexp_replace(md, r"(?sd)\A---\s*\n.*?\n---\s*\n", "")

    def plausible(year: Column) -> Column:
        return year.try_cast("int").between(EARLIEST, latest)

    def padded(date: Column, pattern: str) -> Column:
        parts = [F.regexp_extract(date, pattern, i) for i in (1, 2, 3)]
        return F.concat_ws("-", parts[0], *[F.lpad(p, 2, "0") for p in parts[1:]])

    chinese = F.regexp_extract(body, CHINESE_DATE, 0)
    dates = F.regexp_extract_all(body, F.lit(ISO_DATE), F.lit(0))
    gaps = F.split(body, ISO_DATE, -1)
    state = F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("found"))

    def step(s: Column, x: Column) -> Column:
        prefix = F.lower(F.right(F.concat(s["before"], x["g"]), F.lit(30)))
        good = ~prefix.contains("created_at") & ~prefix.contains("updated_at") & plausible(F.substring(x["d"], 1, 4))
        before = F.right(F.concat(s["before"], x["g"], x["d"]), F.lit(30))
        return F.struct(before.alias("before"), F.coalesce(s["found"], F.when(good, x["d"])).alias("found"))

    pairs = F.arrays_zip(dates.alias("d"), F.slice(gaps, F.lit(1), F.size(dates)).alias("g"))
    iso = F.aggregate(pairs, state, step, lambda s: s["found"])
    use_chinese = F.coalesce(plausible(F.substring(chinese, 1, 4)), F.lit(False))
    return F.when(use_chinese, padded(chinese, CHINESE_DATE)).when(iso.isNotNull(), padded(iso, ISO_DATE))


def document_type(name: Column) -> Column:
    out = reduce(lambda rest, t: F.when(contains_any(name, t[1]), F.lit(t[0])).otherwise(rest), reversed(TYPES), F.lit("other"))
    return F.when(name.isNotNull(), out)


def subject_topics(area: Column) -> Column:
    return F.filter(F.array(*[F.when(contains_any(area, words), F.lit(t)) for t, words in TOPICS]), lambda x: x.isNotNull())


def extract(df: DataFrame, md: str = "md", name: str = "file_name", latest: int = 2100) -> DataFrame:
    """``df`` with the gov_* columns; ``latest``: the last plausible year (the current one in a live run)."""
    text = F.coalesce(F.col(md), F.lit(""))
    df = df.withColumn("_first", first_heading(text)).withColumn("_stem", file_stem(F.coalesce(F.col(name), F.lit(""))))
    df = df.withColumn("gov_title", title(F.col("_first"), F.col("_stem"))).drop("_first", "_stem")
    df = df.withColumn("_area", F.concat(F.coalesce("gov_title", F.lit("")), F.lit("\n"), F.substring(text, 1, 3000)))
    df = df.withColumn("gov_number", document_number(text))
    df = df.withColumn("gov_authority", issuing_authority(text)).withColumn("gov_date", publish_date(text, latest))
    df = df.withColumn("gov_type", document_type(F.col("gov_title"))).withColumn("gov_topics", subject_topics(F.col("_area"))).drop("_area")
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    score = one(F.col("gov_title").isNotNull(), 0.3) + one(F.col("gov_number").isNotNull(), 0.25) + one(F.col("gov_authority").isNotNull(), 0.2)
    score = score + one(F.col("gov_date").isNotNull(), 0.1) + one(F.coalesce(F.col("gov_type") != "other", F.lit(False)), 0.1) + one(F.size("gov_topics") > 0, 0.05)
    df = df.withColumn("gov_confidence", F.bround(F.least(score, F.lit(1.0)), 2))
    return df.withColumn("gov_document", F.col("gov_title").isNotNull() & (F.col("gov_number").isNotNull() | F.col("gov_authority").isNotNull()))
