"""Removal of provenance marks from Markdown: key blocks, label lines, residual ids, zero-width characters.

The steps follow each other; each counts on what the one before left.  All are Catalyst expressions
on one row, so a document is never moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, squeeze_newlines, trimmed

#: Keys of the marks and patterns built from them.
KEYS = ["ContentProducer", "ContentPropagator", "ProduceID", "PropagateID", "ReservedCode", "Label"]
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ZERO_WIDTH = "​‌‍‎‏﻿⁠⁡⁢⁣᠎"
LEAST_ZERO_WIDTH, LEAST_DENSITY = 10, 0.005

_any_key = "|".join(KEYS)
_body_key = "|".join(KEYS).replace("ReservedCode", r"ReservedCode\d*")
_meta_key = r"ContentProducer|ContentPropagator|ProduceID|PropagateID|ReservedCode\d*"

FRONT = r"(?sd)\A---\s*\n(.*?)\n---"
RESIDUAL = r"ContentProducer|ContentPropagator|ProduceID|PropagateID|ReservedCode"
#: (type, Java pattern) of the body's steps in order; None: newlines are squeezed there.
STEPS: tuple[tuple[str, str] | None, ...] = (
    ("aigc_body_frontmatter", rf"(?md)^[ \t]*---\s*\n[ \t]*AIGC:[^\n]*\n(?:[ \t]+(?:{_body_key})[^\n]*\n)*[ \t]*---"),
    None,
    ("aigc_block", rf"(?md)^[ \t]*AIGC:[ \t]*\n(?:[ \t]+(?:{_any_key})[^\n]*\n)*"),
    ("aigc_standalone", rf"(?md)^[ \t]*AIGC:[ \t]*(?:{UUID})?[ \t]*$"),
    None,
    ("aigc_meta_line", rf"(?md)^[ \t]*(?:{_meta_key})[ \t]*[:=]"),
    None,
    ("aigc_label_line", r"(?md)^[ \t]*AIGC标识[：:][ \t]*.*$"),
    None,
)
UUID_LINE = rf"(?md)^[ \t]*'?{UUID}'?[ \t]*$"


def zero_width_counts(text: Column) -> tuple[Column, Column]:
    """(zero-width characters, visible characters)."""
    bare = F.translate(text, ZERO_WIDTH, "")
    return F.length(text) - F.length(bare), F.length(F.regexp_replace(bare, r"(?U)\s", ""))


def is_zero_width_mark(text: Column) -> Column:
    n, visible = zero_width_counts(text)
    return (n >= LEAST_ZERO_WIDTH) & (n.cast("double") / F.greatest(n + visible, F.lit(1)) >= LEAST_DENSITY)


def zero_width_breakdown(text: Column) -> Column:
    """map: character -> times, of those that occur."""
    each = F.transform(
        F.array(*[F.lit(c) for c in ZERO_WIDTH]), lambda c: F.struct(c.alias("k"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("v"))
    )
    return F.map_from_entries(F.filter(each, lambda e: e["v"] > 0))


def _front_pass(md: Column, earlier: Column) -> Column:
    """One look at the front matter: struct(md, types); ``earlier``: something was found before."""
    body = F.regexp_extract(md, FRONT, 1)
    rest = F.regexp_replace(md, FRONT, "")
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("types"))

    def step(s: Column, line: Column) -> Column:
        t = trimmed(line)
        opens = t.startswith("AIGC:") | (t == "AIGC")
        follower = s["inside"] & (line.startswith("  ") | line.startswith("\t") | (t == ""))
        key = F.coalesce(*[F.when(t.startswith(k + ":") | t.startswith(k + " ="), F.lit("frontmatter_" + k.lower())) for k in KEYS])
        keep = ~opens & ~follower & key.isNull()
        found = F.when(opens, F.lit("frontmatter_aigc_block")).when(~follower, key)
        return F.struct(
            F.when(opens, F.lit(True)).otherwise(follower & (t != "")).alias("inside"),
            F.when(keep, F.concat(s["kept"], F.array(line))).otherwise(s["kept"]).alias("kept"),
            F.when(found.isNotNull(), F.concat(s["types"], F.array(found))).otherwise(s["types"]).alias("types"),
        )

    looks = md.rlike(FRONT) & (body.contains("AIGC:") | body.rlike(RESIDUAL))

    def result(folded: Column) -> Column:
        new = trimmed(F.array_join(folded["kept"], "\n"))
        made = F.when(new == "", F.regexp_replace(rest, r"\A\n", "")).otherwise(F.concat(F.lit("---\n"), new, F.lit("\n---"), rest))
        acts = looks & ((F.size(folded["types"]) > 0) | earlier)
        return F.struct(
            F.when(acts, made).otherwise(md).alias("md"), F.when(looks, folded["types"]).otherwise(F.array().cast("array<string>")).alias("types"), acts.alias("acts")
        )

    return _let(F.aggregate(F.split(body, "\n", -1), state, step), result)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written, and computed, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _front_passes(md: Column, passes: int) -> Column:
    """struct(md, n, types) after looking again while the length changes, ``passes`` times at most."""
    state = F.struct(md.alias("md"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("types"), F.lit(True).alias("go"))

    def again(s: Column, _: Column) -> Column:
        def taken(f: Column) -> Column:
            return F.struct(
                f["md"].alias("md"), (s["n"] + f["acts"].cast("int")).alias("n"), F.concat(s["types"], f["types"]).alias("types"), (F.length(f["md"]) != F.length(s["md"])).alias("go")
            )

        return F.when(s["go"], _let(_front_pass(s["md"], F.size(s["types"]) > 0), taken)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), state, again)


def clean(df: DataFrame, md: str = "md", passes: int = 5) -> DataFrame:
    """``df`` with clean_md, has_watermark, removed_blocks and detected_types (repeats kept)."""
    df = df.withColumn("_in", F.coalesce(F.col(md), F.lit("")))
    untouched = F.struct(F.col("_in").alias("md"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("types"), F.lit(True).alias("go"))
    df = df.withColumn("_f", F.when(F.col("_in").startswith("---"), _front_passes(F.col("_in"), passes)).otherwise(untouched))
    df = df.withColumn("_md", F.col("_f.md")).withColumn("_n", F.col("_f.n")).withColumn("_types", F.col("_f.types")).drop("_f")
    for step in STEPS:
        if step is None:
            df = df.withColumn("_md", squeeze_newlines(F.col("_md")))
            continue
        kind, pattern = step
        df = _remove(df, kind, pattern, F.lit(True))
    df = _remove(df, "aigc_uuid_line", UUID_LINE, F.size("_types") > 0, squeeze=True)
    mark = is_zero_width_mark(F.col("_md"))
    df = df.withColumn("_zw", mark)
    df = df.withColumn("_md", F.when(F.col("_zw"), F.translate("_md", ZERO_WIDTH, "")).otherwise(F.col("_md")))
    df = df.withColumn("_n", F.col("_n") + F.col("_zw").cast("int"))
    df = df.withColumn("_types", F.when(F.col("_zw"), F.concat("_types", F.array(F.lit("aigc_zero_width_chars")))).otherwise(F.col("_types")))
    blank = is_blank(F.col("_in"))
    df = df.withColumn("clean_md", F.when(blank, F.col(md)).otherwise(F.col("_md")))
    df = df.withColumn("removed_blocks", F.when(blank, F.lit(0)).otherwise(F.col("_n"))).withColumn("has_watermark", F.col("removed_blocks") > 0)
    df = df.withColumn("detected_types", F.when(blank, F.array().cast("array<string>")).otherwise(F.col("_types")))
    return df.drop("_in", "_md", "_n", "_types", "_zw")


def _remove(df: DataFrame, kind: str, pattern: str, where: Column, squeeze: bool = False) -> DataFrame:
    df = df.withColumn("_k", F.when(where, F.regexp_count("_md", F.lit(pattern))).otherwise(F.lit(0))).withColumn("_w", where)
    cut = F.regexp_replace("_md", pattern, "")
    df = df.withColumn("_md", F.when(F.col("_w"), squeeze_newlines(cut) if squeeze else cut).otherwise(F.col("_md")))
    df = df.withColumn("_n", F.col("_n") + F.col("_k")).withColumn("_types", F.concat("_types", F.array_repeat(F.lit(kind), F.col("_k"))))
    return df.drop("_k", "_w")


def has_residual(md: Column) -> Column:
    """Marks are left: zero-width ones, a key in the front matter, or a key or label on a line that is no comment."""
    front = F.regexp_extract(md, FRONT, 1)
    lines = F.exists(
        F.split(md, "\n"), lambda x: ~F.startswith(trimmed(x), F.lit("<!--")) & (x.rlike(RESIDUAL) | trimmed(x).startswith("AIGC:") | x.contains("AIGC标识"))
    )
    return is_zero_width_mark(md) | front.rlike(RESIDUAL) | lines
