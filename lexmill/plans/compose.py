"""Markdown documents made from the tables at hand: one SQL expression, the same in Spark and DuckDB."""

TITLES = [
    "关于年度培训工作的通知",
    "深化改革实施方案",
    "差旅管理办法",
    "目录",
    "关于员工薪酬的请示",
    "安全检查情况报告",
    "1. 数字化转型会议纪要",
    "Quarterly review",
    "关于干部任免的决定",
    "批复",
    "x",
]
AUTHORITIES = ["公司办公室 纪委", "集团党委", "人力资源部", "nobody", "审计部与财务部", "董事会"]
NUMBERS = ["巡办发〔2022〕8号", "参见[2024]12号文", "人资（2023） 105 号", "none", "第7号"]
DATES = ["2024年3月15日", "created_at: 2020-01-01 and 2024-06-20", "1900年1月1日", "2023.7.9", "no date", "updated_at: 2021-02-03"]
ITEMS = ["- first\n- second", "1. one\n2. two\n\n3. three", "* star\n+ plus", "> quoted\n> more", "---", "text\n<!-- note -->\nmore text"]
TABLES = ["| a | b |\n|---|---|\n| 1 | 2 |", "| x |\n| --- |\n| y |\n\n| z |", "<!-- IMAGE_PLACEHOLDER 1 -->", "![pic](a.png)", "<!-- TABLE_TRUNCATED -->"]
MARKS = [
    "AIGC:\n  ContentProducer: abc\n  Label: 1\n",
    "AIGC: 12345678-1234-1234-1234-123456789abc\n",
    "ContentProducer: 'abc'\n",
    "AIGC标识：generated\n\n\n\n",
    "  12345678-1234-1234-1234-123456789abc\n",
    "---\nAIGC: yes\n  ProduceID: 4\n---\n",
    "clean\n",
    "AIGC:\nProduceID = 9\n  '12345678-1234-1234-1234-123456789abc'\n",
]


def literal(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def pick(values: list[str], key: str = "doc_id") -> str:
    """CASE over the key: the value of its remainder."""
    whens = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {whens} END"


def compose(text: str = "text") -> str:
    """A document of title, number, authority, date, marks, list, table and the row's own text."""
    nl = " || chr(10) || "
    return nl.join(
        [
            f"'# ' || {pick(TITLES)}",
            pick(NUMBERS),
            pick(AUTHORITIES),
            pick(DATES),
            f"{pick(MARKS)} || {pick(ITEMS)}",
            "'## part'",
            pick(TABLES),
            f"coalesce({text}, '')",
        ]
    )
