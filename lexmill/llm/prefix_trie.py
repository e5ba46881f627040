"""Conversation prefix trie: the Cartesian tree over the sorted conversations' LCP array.

Conversations are sorted by the digests of their turns (role and text), so conversations with a common prefix stand
together; LCP[i] is the number of turns that the i-th shares with the one before.  All nearest smaller values of that
array give, for every i, the interval of conversations around it that share LCP[i] turns.  They are found in
parallel: blocks are solved on their own, and of a block only what its minima leave open goes on (what has nothing
smaller before it or behind it in the block, one element for each value), to blocks of blocks, until one is
left.  What an interval holds is summed up along the way.  Equal values of one interval are one node; depths between
a node and its parent, which have the same members, are expanded at the end.

No conversation and no group of conversations is gathered: turns are numbered by a global sort (``ordering``), sort
keys hold ``KEY`` turns at first and only conversations that tie on a full key look further, in keys of ``LONGEST_KEY``
turns at most, and the ids that end in a node are hashed as a stream of sorted pieces.

Saved tokens: over a subtree each node's (members - 1) times the words of its last turn; in the sorted array that is
the words of the first LCP[i] turns of all members but the first, less what stands above the node.

Edge cases: null roles and texts count as empty; turns are ordered by number (null first), then by digest, so repeated
turns stay; rows without a conv_id are left out, as they belong to no conversation; conversations without a turn
end in the root; an empty table gives an empty result, without a root; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, scratch, settle, whole_text
from lexmill.llm.ordering import in_groups, in_order
from lexmill.llm.sharding import CRC_SQL, crc_sql

#: Turns of the first sort key, and of the longest; each round's is four times the one before.
KEY, LONGEST_KEY = 64, 65536
#: Elements of a block, blocks of a block of blocks, ids of a hashed piece.
BLOCK, FAN, PIECE = 1024, 64, 4096


def turn_rows(table: DataFrame) -> DataFrame:
    """(conv_id, turn, dig, words) of a table of turns; dig names role and text; a written table."""
    role, text = whole_text("role"), whole_text("text")
    dig = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return settle(table.where("conv_id is not null").select("conv_id", "turn", dig.alias("dig"), words.alias("words")))


def as_they_are(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, len), and their turns (conv_id, place, dig, words, words_before)."""
    turns = in_groups(turn_rows(table), "conv_id", ["turn", "dig"], ["words"])
    return settle(turns.groupBy("conv_id").agg(F.max("many").alias("len"))), turns


def rebuilt(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: the first h turns of conversation c - c % 20, then c's own after its first h; h = crc32(c) % 4."""
    own = in_groups(turn_rows(table), "conv_id", ["turn", "dig"])
    sizes = own.groupBy("conv_id").agg(F.max("many").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).alias("h")
    convs = settle(sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % 20).alias("base")))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = settle(convs.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    rest = own.join(convs.select("conv_id", "h", "head"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("nth"), "dig", "words")
    first = own.where("place < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "place", "dig", "words")
    first = first.join(convs.select("base", "conv_id", "h"), "base").where("place < h").select("conv_id", F.col("place").alias("nth"), "dig", "words")
    return convs.select("conv_id", "len"), in_groups(rest.unionByName(first), "conv_id", ["nth"], ["words"])


def _shared(x: str, y: str) -> Column:
    """How many first elements two arrays have in common."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(x))


def sorted_conversations(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, len, pos, lcp): places in the order of turns (then ids), and turns shared with the one before (-1 for the first); a written table."""
    tied = convs.select("conv_id", "len", F.lit(0).cast("long").alias("rank"), F.lit(-1).cast("long").alias("lcp"))
    done: list[DataFrame] = []
    at, width = 0, KEY
    while True:
        part = turns.where((F.col("place") >= at) & (F.col("place") < at + width))
        part = part.join(tied.select("conv_id"), "conv_id", "left_semi") if at else part
        keys = part.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "dig"))), lambda x: x["dig"]).alias("key"))
        rows = tied.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", F.array().cast("array<binary>")))
        seen = in_order(rows, ["rank", "key", "conv_id"], prev=["rank", "key"])
        firsts = seen.groupBy("rank").agg(F.min("at").alias("first"))
        again = F.coalesce(F.col("prev.rank") == F.col("rank"), F.lit(False))
        lcp = F.when(again, at + _shared("key", "prev.key")).otherwise(F.col("lcp")).cast("long")
        seen = settle(seen.withColumn("lcp", lcp).drop("prev").join(firsts, "rank").withColumn("pos", F.col("rank") + F.col("at") - F.col("first")).drop("at", "first"))
        full = seen.where(F.size("key") == width).groupBy("rank", "key").agg(F.min("pos").alias("new"), F.min_by("lcp", "pos").alias("new_lcp"), F.count("*").alias("n"))
        full = settle(full.where("n > 1").drop("n"))
        if full.isEmpty():
            done.append(seen)
            return settle(reduce(DataFrame.union, [d.select("conv_id", "len", "pos", "lcp") for d in done]))
        more = settle(seen.join(full, ["rank", "key"], "left"))
        done.append(more.where("new is null"))
        tied = more.where("new is not null").select("conv_id", "len", F.col("new").alias("rank"), F.col("new_lcp").alias("lcp"))
        at, width = at + width, min(4 * width, LONGEST_KEY)


#: An element of the LCP array: its place, value and conversation's length; ``a``: words of the shared turns; g: least id, words and
#: leaves from here to the next element that is kept; ``kids``: children that begin here; then the nearest smaller values (place -1:
#: not found yet) with what lies between; ``kind``: found both, goes on, or stands for the same node as ``alias``.
ELEMENT = ["pos", "v", "len", "a", "g_id", "g_a", "g_leaf", "kids", "l", "lv", "llen", "l_id", "l_a", "l_leaf", "r", "rv", "r_id", "r_a", "r_leaf", "kind", "alias"]
FOUND, OPEN, SAME = 0, 1, 2


def solve(rows: dict[str, list[int]], end: int | None) -> None:
    """Find nearest smaller values in one block, in place; ``end``: the array's length if the block is all that is left."""
    pos, v, g = rows["pos"], rows["v"], list(zip(rows["g_id"], rows["g_a"], rows["g_leaf"]))
    n = len(pos)
    plus = lambda x, y: (min(x[0], y[0]), x[1] + y[1], x[2] + y[2])
    held, stack = list(g), []  # what lies from an element to the next one on the stack
    for i in range(n):
        between = None
        while stack and v[stack[-1]] >= v[i]:
            popped = held[stack.pop()]
            between = popped if between is None else plus(between, popped)
        if stack:
            j = stack[-1]
            held[j] = held[j] if between is None else plus(held[j], between)
            if rows["l"][i] < 0:
                rows["l"][i], rows["lv"][i], rows["llen"][i] = pos[j], v[j], rows["len"][j]
                rows["l_id"][i], rows["l_a"][i], rows["l_leaf"][i] = held[j][0], held[j][1] - rows["a"][j], held[j][2]
        stack.append(i)
    held, stack = list(g), []
    for i in reversed(range(n)):
        while stack and v[stack[-1]] >= v[i]:
            held[i] = plus(held[i], held[stack.pop()])
        if rows["r"][i] < 0 and (stack or end is not None):
            rows["r"][i], rows["rv"][i] = (pos[stack[-1]], v[stack[-1]]) if stack else (end, -1)
            rows["r_id"][i], rows["r_a"][i], rows["r_leaf"][i] = held[i]
        stack.append(i)
    for i in range(n):
        rows["kind"][i] = FOUND if rows["r"][i] >= 0 and (rows["l"][i] >= 0 or end is not None) else OPEN
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i in range(n):
        if rows["kind"][i] == OPEN:
            if rows["l"][i] < 0:
                first.setdefault(v[i], i)
            if rows["r"][i] < 0:
                last[v[i]] = i
    kept = -1
    for i in range(n):
        if rows["kind"][i] == OPEN and i not in (first.get(v[i]), last.get(v[i])):
            same = first[v[i]] if rows["l"][i] < 0 else last[v[i]]
            rows["kind"][i], rows["alias"][i] = SAME, pos[same]
            rows["kids"][same] += rows["kids"][i]
        if rows["kind"][i] == OPEN:
            kept = i
        elif kept >= 0:  # what lies here is the last kept element's from now on
            rows["g_id"][kept], rows["g_a"][kept], rows["g_leaf"][kept] = plus((rows["g_id"][kept], rows["g_a"][kept], rows["g_leaf"][kept]), g[i])


def _solver(end: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos")[ELEMENT].to_dict("list")
        solve(rows, end)
        return pd.DataFrame(rows, columns=ELEMENT)

    return work


def nearest_smaller(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements with both nearest smaller values found, and (pos, alias): those that another of their node stands for."""
    many, span, level = elements.count(), BLOCK, elements
    found, same = [], []
    schema = ", ".join(f"{c} bigint" for c in ELEMENT)
    while True:
        end = many if many <= span else None
        done = settle(level.groupBy(F.floor(F.col("pos") / span).alias("block")).applyInPandas(_solver(end), schema))
        found.append(done.where((F.col("kind") == FOUND) & (F.col("v") >= 0)))
        same.append(done.where(F.col("kind") == SAME).select("pos", "alias"))
        if end is not None:
            break
        level, span = done.where(F.col("kind") == OPEN), span * FAN
    names = same[0]
    for later in same[1:]:  # those that stood for others may have been stood for themselves
        after = later.select(F.col("pos").alias("alias"), F.col("alias").alias("then"))
        names = names.join(after, "alias", "left").select("pos", F.coalesce("then", "alias").alias("alias")).union(later)
    return settle(reduce(DataFrame.union, found)), settle(names)


def ends(places: DataFrame) -> DataFrame:
    """(l, ends_sha256): the ids of each run of equal conversations, by the place where it begins; a written table."""
    opens = (F.col("v") < F.col("len")).cast("long").alias("opens")
    runs = in_order(places.select("pos", "conv_id", opens), ["pos"], ["opens"])
    runs = runs.select((F.col("opens_before") + F.col("opens")).alias("run"), "pos", "conv_id")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "conv_id"))), lambda x: x["conv_id"].cast("string")), ",")
    pieces = runs.groupBy("run", F.floor(F.col("pos") / PIECE).alias("nth")).agg(F.min("pos").alias("pos"), ids.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begin, sha = None, None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, str]] = []
            for run, pos, piece in zip(*[c.to_pylist() for c in batch.columns]):
                if run != now:
                    out += [(begin, sha.hexdigest())] if now is not None else []
                    now, begin, sha = run, pos, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["l", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int64()), pa.array([sha.hexdigest()])], ["l", "ends_sha256"])

    streams = pieces.select("run", "pos", "ids").repartition("run").sortWithinPartitions("run", "pos")
    return settle(streams.mapInArrow(work, "l bigint, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; a written table."""
    with scratch(convs.sparkSession):
        order = sorted_conversations(convs, turns)
        shared = turns.select("conv_id", (F.col("place") + 1).alias("lcp"), (F.col("words_before") + F.col("words")).alias("a"))
        after = order.select((F.col("pos") - 1).alias("pos"), F.col("lcp").alias("after"))
        places = order.join(shared, ["conv_id", "lcp"], "left").join(after, "pos", "left")
        places = settle(places.select("pos", "conv_id", "len", F.col("lcp").alias("v"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("after", F.lit(-1)).alias("after")))
        leaf, child = (F.col("after") < F.col("len")).cast("long"), (F.col("len") > F.col("v")).cast("long")
        given = {"g_id": F.col("conv_id"), "g_a": F.col("a"), "g_leaf": leaf, "kids": child, "l": F.lit(-1), "r": F.lit(-1)}
        element = places.select([given.get(c, F.col(c) if c in places.columns else F.lit(0)).cast("long").alias(c) for c in ELEMENT])
        found, names = nearest_smaller(element)

        above = F.when(F.col("lv") >= F.col("rv"), F.col("l")).otherwise(F.col("r"))
        inner = found.select(
            "pos", "l", "v", F.greatest("lv", "rv").alias("u"), (F.col("r") - F.col("l")).alias("n"), F.least("l_id", "r_id").alias("conv_id"),
            (F.col("l_a") + F.col("r_a")).alias("a"), (F.col("l_leaf") + F.col("r_leaf")).alias("n_leaves"), "kids", "llen", above.alias("above"),
        )
        inner = settle(inner)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        nearer = F.when(F.col("v") >= F.col("after"), F.col("pos")).otherwise(F.col("pos") + 1)
        alone = places.where(F.col("len") > F.greatest("v", "after")).select(
            "pos", F.col("pos").alias("l"), F.col("len").alias("v"), F.greatest("v", "after").alias("u"), one.alias("n"), "conv_id", none.alias("a"), one.alias("n_leaves"), none.alias("kids"), none.alias("llen"), nearer.alias("above")
        )
        least = inner.select(F.col("pos").alias("above"), F.col("conv_id").alias("parent"))
        both = inner.unionByName(alone)
        both = both.join(names.select(F.col("pos").alias("above"), "alias"), "above", "left").withColumn("above", F.coalesce("alias", "above")).join(least, "above", "left")
        nodes = both.groupBy("l", "v").agg(*[F.max(c).alias(c) for c in ("u", "n", "conv_id", "a", "n_leaves", "parent", "llen")], F.sum("kids").alias("kids"))
        nodes = nodes.withColumn("kids", F.when(F.col("n") > 1, F.col("kids") + (F.col("llen") > F.col("v")).cast("long")).otherwise(F.col("kids")))
        rows = nodes.withColumn("depth", F.explode(F.sequence(F.col("u") + 1, F.col("v"))))
        before = turns.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("words_before").alias("q"))
        rows = rows.join(before, ["conv_id", "depth"], "left").withColumn("end", F.when(F.col("depth") == F.col("v"), F.col("l")))
        own = places.select(F.col("pos").alias("l"), F.col("len").alias("depth"))  # where the first member ends in the node
        last = ends(places).join(own, "l").select(F.col("l").alias("end"), "depth", "ends_sha256")
        rows = rows.join(last, ["end", "depth"], "left")
        parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("u") + 1, F.col("parent")).otherwise(F.col("conv_id"))
        return settle(
            rows.select(
                "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(F.col("depth") == F.col("v"), F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
                (F.col("a") - (F.col("n") - 1) * F.coalesce("q", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
            ),
            outer=True,
        )


def prefix_trie(table: DataFrame) -> DataFrame:
    """The trie of the conversations of a table of turns (conv_id, turn, role, text)."""
    with scratch(table.sparkSession):
        return settle(trie(*as_they_are(table)), outer=True)


def rebuilt_trie(table: DataFrame) -> DataFrame:
    """The trie of the query's rebuilt conversations."""
    with scratch(table.sparkSession):
        return settle(trie(*rebuilt(table)), outer=True)


SQL = f"""
WITH RECURSIVE {CRC_SQL}, t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) - 1 AS place, dig, words FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words FROM conversations WHERE conv_id IS NOT NULL
  )
), c AS (
  SELECT conv_id, n, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc_table
), k AS (
  SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base
), s AS (
  SELECT t.conv_id, place - h + head AS place, dig, words FROM t JOIN k ON t.conv_id = k.conv_id WHERE place >= h
  UNION ALL SELECT k.conv_id, place, dig, words FROM t JOIN k ON t.conv_id = k.base WHERE place < h
), p AS (
  SELECT conv_id, 0 AS depth, '' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS words FROM k
  UNION ALL SELECT conv_id, place + 1, string_agg(dig, '') OVER w, coalesce(string_agg(dig, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), e AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM p) WHERE depth = deepest GROUP BY node
), n AS (
  SELECT node, max(parent) AS parent, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM p GROUP BY node
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT p.node, sum(n.saved) AS saved_tokens, sum(CASE WHEN kids.node IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM n LEFT JOIN kids ON n.node = kids.node JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n up ON n.parent = up.node LEFT JOIN kids ON n.node = kids.node LEFT JOIN e ON n.node = e.node JOIN below ON n.node = below.node
"""
