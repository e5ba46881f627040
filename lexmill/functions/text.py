"""Column functions on strings: trimming, escaping, names, numerals, encodings of cells and sizes.

Every function is a Catalyst expression: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\n"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def trimmed_start(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*\z")


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


# ---- files and names -------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


#: File extensions and the types they stand for.
TYPE_OF_EXTENSION = {
    ".doc": "Word",
    ".docx": "Word",
    ".xls": "Excel",
    ".xlsx": "Excel",
    ".ppt": "PowerPoint",
    ".pptx": "PowerPoint",
    ".txt": "Text",
    ".pdf": "PDF",
    ".md": "Markdown",
    ".markdown": "Markdown",
}


def file_type(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_OF_EXTENSION.items() for x in kv]), extension(path)), F.lit("Unknown"))


#: Characters that Windows does not allow in a file name.
FORBIDDEN = '<>:"/\\|?*'


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.translate(name, FORBIDDEN, "_" * len(FORBIDDEN)), r"[\x00-\x1f]", "_")


#: Device names that no file may have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]


def sanitised_file_name(path: Column) -> Column:
    """The file name without outer blanks and dots; ``_`` before a reserved device name."""
    name = F.regexp_replace(trimmed(file_name(path)), r"^\.+|\.+\z", "")
    stem = F.upper(F.regexp_replace(name, r"\.[^.]*\z", ""))
    return F.when(stem.isin(RESERVED), F.concat(F.lit("_"), name)).otherwise(name)


# ---- sheets ----------------------------------------------------------------------------------


def column_index(ref: Column) -> Column:
    """``AB12`` -> 27; without letters 0."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(ref, r"^([A-Za-z]*)", 1)), ""), lambda c: c != "")
    return F.greatest(F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1, F.lit(0))


def md_cell(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\\n\\r]'), quoted).otherwise(value)


def is_date_format(code: Column) -> Column:
    """A custom number format is a date's: by the letters it contains, as spreadsheets' codes go."""
    low = F.lower(code)
    time = contains_any(low, ["h", "s", "时", "秒"])
    year, day = contains_any(low, ["y", "年"]), contains_any(low, ["d", "日"])
    month = contains_any(low, ["m", "月"]) & ~time
    return F.when(is_blank(code), F.lit(False)).when(time & ~year & ~day, F.lit(False)).otherwise(year | day | month)


def is_date_style(format_id: Column, code: Column) -> Column:
    built_in = format_id.between(14, 22) | format_id.between(27, 36) | format_id.between(45, 47) | format_id.between(50, 58)
    return F.coalesce(built_in, F.lit(False)) | (F.coalesce(format_id >= 164, F.lit(False)) & is_date_format(F.coalesce(code, F.lit(""))))


def serial_date(value: Column) -> Column:
    """A spreadsheet's day number as yyyy-MM-dd; the time of day is dropped."""
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value.cast("double")).cast("int")), "yyyy-MM-dd")


# ---- page text -------------------------------------------------------------------------------

#: Patterns of page furniture, deleted in this order.
PAGE_ARTIFACTS = (
    r"(?U)—\s*\d+\s*—",
    r"(?U)第\s*\d+\s*页\s*—\s*\d+\s*—",
    r"(?U)第\s*\d+\s*页",
    r"(?U)共\s*\d+\s*页",
    r"(?Umd)^\s*\d{1,3}\s*$",
    r"(?Umd)^[\s\d—\-–]+$",
    "[­​-‏﻿]",
)


def without_page_artifacts(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), PAGE_ARTIFACTS, text)


def normal_spaces(text: Column) -> Column:
    squeezed = F.regexp_replace(text, r"(?U)\s+", " ")
    return trimmed(F.regexp_replace(squeezed, r"(?U)\s+([，。、；：！？）】》」』,.;:!?)\]])", "$1"))


CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{FF00}-\x{FFEF}\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"


def starts_cjk(text: Column) -> Column:
    return text.rlike("^" + CJK)


def ends_cjk(text: Column) -> Column:
    return text.rlike(CJK + r"\z")


def ends_paragraph(text: Column) -> Column:
    return text.rlike(r"[。！？.?!」』】…；;]\z")


def chinese_number(text: Column) -> Column:
    """一 to 九十九; other digit strings are read digit by digit; 0 counts as 1."""
    digits = F.translate(text, "零〇一二三四五六七八九", "00123456789")
    tens, units = F.split(digits, "十")[0], F.split(digits, "十")[1]
    value = F.when(
        text.contains("十"),
        F.when(tens == "", F.lit(1)).otherwise(F.expr("1") * tens.try_cast("int")) * 10 + F.when(units == "", F.lit(0)).otherwise(units.try_cast("int")),
    ).otherwise(F.regexp_replace(digits, "[^0-9]", "").try_cast("int"))
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(1)).otherwise(value)


def image_mime(data: Column) -> Column:
    """By the first bytes; PNG if too short or unknown."""
    head = F.hex(F.substring(data, 1, 4))
    out = F.when(F.length(data) < 4, F.lit("image/png")).when(head.startswith("FFD8"), F.lit("image/jpeg"))
    out = out.when(head == "89504E47", F.lit("image/png")).when(head.startswith("474946"), F.lit("image/gif"))
    return out.when(head.startswith("424D"), F.lit("image/bmp")).when(head.isin("49492A00", "4D4D002A"), F.lit("image/tiff")).otherwise(F.lit("image/png"))


# ---- sizes and versions ----------------------------------------------------------------------


def indent_twips(chars: Column, points: Column) -> Column:
    return F.bround(chars.cast("double") * points.cast("double") * 20, 0).cast("int")


def centimetre_twips(cm: Column) -> Column:
    """Cut, not rounded."""
    return (cm * 567).cast("int")


#: Names of Chinese type sizes in points.
TYPE_SIZES = (
    ("初号", 42.0),
    ("小初", 36.0),
    ("一号", 26.0),
    ("小一", 24.0),
    ("二号", 22.0),
    ("小二", 18.0),
    ("三号", 16.0),
    ("小三", 15.0),
    ("四号", 14.0),
    ("小四", 12.0),
    ("五号", 10.5),
    ("小五", 9.0),
    ("六号", 7.5),
    ("小六", 6.5),
    ("七号", 5.5),
    ("八号", 5.0),
)


def type_size_name(points: Column) -> Column:
    """The size's name, or the nearest one's with the points; the larger of two equally near."""
    near = F.array_min(F.array(*[F.struct(F.abs(points - p).alias("off"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (n, p) in enumerate(TYPE_SIZES)]))
    return F.when(near["off"] == 0, near["name"]).otherwise(F.concat(near["name"], F.lit("(≈"), F.format_string("%.1f", points), F.lit("pt)")))


def version_parts(tag: Column) -> Column:
    """The first d.d, d.d.d or d.d.d.d of a tag as four numbers (missing: -1), or null."""
    found = F.regexp_extract(F.coalesce(tag, F.lit("")), r"(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)", 1)
    parts = F.split(found, r"\.")
    return F.when(found != "", F.array(*[F.coalesce(F.get(parts, F.lit(i)).cast("int"), F.lit(-1)) for i in range(4)]))


def is_newer(remote: Column, local: Column) -> Column:
    r, o = version_parts(remote), version_parts(local)
    return F.coalesce(F.array_max(F.array(F.struct(r.alias("v"), F.lit(1)), F.struct(o.alias("v"), F.lit(2))))["v"] != o, F.lit(False)) & r.isNotNull() & o.isNotNull()
