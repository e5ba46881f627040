"""Chat formatting: preference pairs with one shared prompt and two masked completions.

A pair is a chosen and a rejected conversation.  The longest common prefix of their turns (role and
text) is rendered once, as the prompt; what follows in each is its completion.  A completion comes with
its mask: the code-point spans of assistant texts and their end marks, which alone count in the loss.

Prefixes are found on rows, not on whole conversations: turns of the two sides meet by pair and
position and the first difference is a minimum per pair, so no conversation is gathered to compare it.
A rendered side is one row, put together from its turns' pieces.

``pair_up`` makes pairs where a table has no preference of its own: conversations with the same opening
turn compete.  They are ranked by their whole content (which puts long common prefixes side by side)
through a global sort, neighbours are paired, and of a pair the one with more assistant characters, then
the smaller id, is chosen.  A group of any size is spread over the sort's ranges; the number of pairs is
linear in it.  The odd one of a group is paired with the group's first; a conversation alone has no rival
and gives a row without a rejected side.

Edge cases: null roles and texts count as empty; turns are ordered by number, then role and text (null
numbers first); repeated turns stay; equal sides give two empty completions; if one side is a prefix
of the other its completion is empty; an empty table gives an empty result; rows without a conv_id are
left out, as they belong to no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import settle

#: The template: how a turn is rendered, and what ends it.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "<|end|>\n"


def turns_of(table: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns numbered from 0 in each conversation."""
    rows = table.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def pair_up(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id) over all conversations of ``turns``; rejected_id null for one alone."""
    opening = F.min_by(F.md5(F.concat_ws("\x1f", "role", "text").cast("binary")), "place")
    content = F.sort_array(F.collect_list(F.struct("place", F.md5(F.concat_ws("\x1f", "role", "text").cast("binary")).alias("h"))))
    said = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(F.lit(0)))
    whole = turns.groupBy("conv_id").agg(opening.alias("opening"), content.alias("content"), said.alias("said"))
    key = F.array_join(F.transform("content", lambda x: F.substring(x["h"], 1, 16)), "")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = whole.select("conv_id", "opening", key.alias("key"), "said").repartitionByRange(n, "opening", "key", "conv_id").sortWithinPartitions("opening", "key", "conv_id")
    # the number is the partition's in the high bits and the row's in the low ones: it follows the sort
    numbered = settle(ranked.select("conv_id", "opening", "said", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    counts = numbered.groupBy(part.alias("part")).count()
    starts = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))  # a row for each partition
    placed = settle(numbered.withColumn("part", part).join(F.broadcast(starts), "part").select("conv_id", "opening", "said", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at")))
    groups = placed.groupBy("opening").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    inside = placed.join(groups, "opening").withColumn("k", F.col("at") - F.col("first"))
    last = (F.col("k") == F.col("size") - 1) & (F.col("size") % 2 == 1)
    pairs = F.when(last, F.array(F.floor(F.col("k") / 2))).otherwise(
        F.when((F.col("k") == 0) & (F.col("size") % 2 == 1), F.array(F.lit(0), F.floor(F.col("size") / 2))).otherwise(F.array(F.floor(F.col("k") / 2)))
    )
    member = F.struct((-F.col("said")).alias("less"), F.col("conv_id").alias("id"))
    sides = inside.select("opening", F.explode(F.array_distinct(pairs)).alias("pair"), member.alias("side"))
    both = sides.groupBy("opening", "pair").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.count("*").alias("n"))
    rejected = F.when(F.col("n") > 1, F.col("b.id"))
    return both.select(F.concat_ws("-", "opening", F.col("pair").cast("string")).alias("pair_id"), F.col("a.id").alias("chosen_id"), rejected.alias("rejected_id"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEFORE), role, F.lit(BETWEEN), text, F.lit(AFTER))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: ids, n_prompt_turns, prompt, chosen, rejected and the masks (arrays of start, stop).

    A pair without a rejected side has the turns before its last assistant turn as prompt.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("c").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("r").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("x"))
    sides = sides.select("pair_id", "x.*").where("conv_id is not null")
    rows = settle(sides.join(turns, "conv_id").select("pair_id", "side", "place", "role", "text"))
    met = rows.groupBy("pair_id", "place").agg(F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("a"), F.max(F.struct("role", "text")).alias("b"))
    differs = (F.col("n") == 1) | (F.col("a") != F.col("b"))
    alone = F.max(F.when(F.col("a.role") == "assistant", F.col("place")))
    cuts = met.groupBy("pair_id").agg(
        F.min(F.when(differs, F.col("place"))).alias("cut"), (F.max("place") + 1).alias("end"), alone.alias("answer"), F.max("n").alias("sides")
    )
    cuts = cuts.select("pair_id", F.when(F.col("sides") > 1, F.coalesce("cut", "end")).otherwise(F.coalesce("answer", "end")).alias("n_prompt_turns"))
    kind = F.when(F.col("place") < F.col("n_prompt_turns"), F.lit("p")).otherwise(F.col("side"))
    single = (F.col("place") >= F.col("n_prompt_turns")) | (F.col("side") == "c")  # the prompt once, from the chosen side
    placed = rows.join(cuts, "pair_id").where(single).withColumn("kind", kind).withColumn("body", rendered(F.col("role"), F.col("text")))
    # where each piece ends is a running sum over rows, so a mask is linear in the turns
    stop = F.sum(F.length("body")).over(Window.partitionBy("pair_id", "n_prompt_turns", "kind").orderBy("place")).cast("int")
    placed = placed.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("body") + F.length(F.concat(F.lit(BEFORE), "role", F.lit(BETWEEN))))
    piece = F.struct("place", "start", "stop", "body", (F.col("role") == "assistant").alias("counts"))
    parts = placed.groupBy("pair_id", "n_prompt_turns", "kind").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    mask = F.transform(F.filter("pieces", lambda x: x["counts"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    body = F.array_join(F.transform("pieces", lambda x: x["body"]), "")
    made = parts.select("pair_id", "n_prompt_turns", "kind", body.alias("body"), mask.alias("mask"))
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    text = lambda k: F.coalesce(pick(k, "body"), F.lit(""))
    spans = lambda k: F.coalesce(F.first(F.when(F.col("kind") == k, F.col("mask")), ignorenulls=True), none)
    out = made.groupBy("pair_id", "n_prompt_turns").agg(
        text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), spans("c").alias("chosen_mask"), spans("r").alias("rejected_mask")
    )
    out = pairs.join(out, "pair_id")
    two = F.col("rejected_id").isNotNull()
    return out.withColumn("rejected", F.when(two, F.col("rejected"))).withColumn("rejected_mask", F.when(two, F.col("rejected_mask")))


def format_conversations(table: DataFrame) -> DataFrame:
    """The formatted pairs of a table of turns that names no preference."""
    turns = settle(turns_of(table))
    return format_pairs(turns, settle(pair_up(turns)))


def digest(pairs: DataFrame) -> DataFrame:
    """What the query returns: ids, sizes and hashes of the rendered texts, masks as start:stop lists."""
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return pairs.select(
        "chosen_id",
        "rejected_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")],
        *[spans(f"{c}_mask").alias(f"{c}_mask") for c in ("chosen", "rejected")],
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT conv_id, min_by(md5(role || chr(31) || text), place) AS opening, string_agg(substr(md5(role || chr(31) || text), 1, 16), '' ORDER BY place) AS key,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said FROM t GROUP BY conv_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY opening ORDER BY key, conv_id) - 1 AS k, count(*) OVER (PARTITION BY opening) AS size FROM h
), m AS (
  SELECT opening, k // 2 AS pair, said, conv_id, size FROM k
  UNION ALL SELECT opening, size // 2, said, conv_id, size FROM k WHERE k = 0 AND size % 2 = 1 AND size > 1
), o AS (
  SELECT *, row_number() OVER (PARTITION BY opening, pair ORDER BY said DESC, conv_id) AS r FROM m
), p AS (
  SELECT opening || '-' || pair AS pair_id, max(CASE WHEN r = 1 THEN conv_id END) AS chosen_id, max(CASE WHEN r = 2 THEN conv_id END) AS rejected_id FROM o GROUP BY opening, pair
), s AS (
  SELECT pair_id, 'c' AS side, place, role, text FROM p JOIN t ON conv_id = chosen_id
  UNION ALL SELECT pair_id, 'r', place, role, text FROM p JOIN t ON conv_id = rejected_id
), x AS (
  SELECT pair_id, place, count(*) AS n, count(DISTINCT role || chr(31) || text) AS d, max(role) AS role FROM s GROUP BY pair_id, place
), c AS (
  SELECT pair_id, CASE WHEN max(n) > 1 THEN coalesce(min(CASE WHEN n = 1 OR d > 1 THEN place END), max(place) + 1)
    ELSE coalesce(max(CASE WHEN role = 'assistant' THEN place END), max(place) + 1) END AS cut FROM x GROUP BY pair_id
), b AS (
  SELECT s.pair_id, CASE WHEN place < cut THEN 'p' ELSE side END AS kind, place, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body
  FROM s JOIN c ON s.pair_id = c.pair_id WHERE place >= cut OR side = 'c'
), w AS (
  SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, kind ORDER BY place) AS stop FROM b
), g AS (
  SELECT pair_id, kind, string_agg(body, '' ORDER BY place) AS body,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(stop - length(body) + length(role) + 5 AS BIGINT) || ':' || CAST(stop AS BIGINT) END, ',' ORDER BY place), '') AS mask
  FROM w GROUP BY pair_id, kind
)
SELECT p.chosen_id, p.rejected_id, CAST(c.cut AS BIGINT) AS n_prompt_turns, md5(coalesce(gp.body, '')) AS prompt_md5, md5(coalesce(gc.body, '')) AS chosen_md5,
  CASE WHEN p.rejected_id IS NOT NULL THEN md5(coalesce(gr.body, '')) END AS rejected_md5, coalesce(gc.mask, '') AS chosen_mask,
  CASE WHEN p.rejected_id IS NOT NULL THEN coalesce(gr.mask, '') END AS rejected_mask
FROM p JOIN c ON p.pair_id = c.pair_id
LEFT JOIN g gp ON gp.pair_id = p.pair_id AND gp.kind = 'p'
LEFT JOIN g gc ON gc.pair_id = p.pair_id AND gc.kind = 'c'
LEFT JOIN g gr ON gr.pair_id = p.pair_id AND gr.kind = 'r'
"""
