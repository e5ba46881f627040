"""Near copies by word shingles: candidates from the SimHash index and from MinHash bands, then an exact check.

Two documents are near copies if the Jaccard similarity of their sets of ``WORDS``-word shingles (XXH64,
seed 42) is ``SIMILARITY`` or more.  At that similarity fingerprints differ in about 10 of 64 bits, which the
Gray index of ``simhash`` can't search without comparing nearly all pairs; it gives the pairs within
``DISTANCE`` bits, and ``BANDS`` bands of ``ROWS`` minima each give the others: a pair at 0.8 shares no
band once in some 4,500 times.  Candidates whose sets' sizes rule the similarity out go, and those that have fewer than ``ALIKE`` of the
``BANDS * ROWS`` minima in common by their last bytes: a pair at 0.8 has so few once in some 230,000 times, far
below what the bands miss, and the check, which sends whole sets, is left with pairs that are mostly copies.
It is exact and goes in two rounds: first each member of a band's or the index's group with the group's first;
then the other candidates, but only between documents that the first round has not joined, as those within a
component add nothing to it.

In a band, a group of up to ``FEW`` documents is compared pair by pair; a larger one with a head drawn anew
for every fourth band, so rows are linear in a group's size.  Where that leaves a large group in more than one
component, its members are searched exactly, by prefixes: with shingles in order of how many of these documents hold them, two
sets at 0.8 share one of their rarest fifths.  Documents that share a rare one (``RARE`` at most) are paired, if what stands
behind it in both sets suffices; for the others heads are drawn from a shingle's documents, after the first rounds outside their largest component, and
compared with all of them, round after round, until its documents are one component or none is left to be drawn.  What a template has in common
stands at the ends of the sets, so documents that share nothing else aren't compared.

Edge cases: null text counts as empty; texts without a word share one shingle, so they are alike; fewer
words than a shingle make one shingle; ids may repeat or be null (a row with an id is kept before one without; of
one id the longer text, then the one with the least XXH64); rows that agree in all that are told apart by their
place in the table's files; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import numbered, scratch, settle, whole_text, without
from lexmill.llm.components import connected_components
from lexmill.llm.simhash import Bits, group_prints, shingle_hashes

WORDS, SIMILARITY, DISTANCE = 5, 0.8, 2
BANDS, ROWS, FEW, HEADS = 16, 4, 8, 4
#: Documents of a rare shingle; about so many heads of a frequent one's documents are drawn in a round; first rounds, in which a
#: quarter of them comes from all its documents, so that most that are similar join the largest component early.
RARE, DRAWN, MIXED = 128, 128, 2
#: Hashes of one side's sets that are broadcast at most (16 MB), as counted.
SENT = 2_000_000
ALIKE = 36
#: Shingles whose minima numpy takes at once, and texts whose results are held at once.
BLOCK, TEXTS = 4096, 256

_random = np.random.default_rng(5)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def look(text: bytes) -> tuple[int, np.ndarray]:
    """The fingerprint of a UTF-8 text, and the distinct hashes of its shingles, sorted."""
    bits, parts = Bits(), []
    for hashes in shingle_hashes(text, WORDS):
        bits.add(hashes)
        parts.append(np.unique(hashes))
    return bits.fingerprint(), np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of ``BANDS * ROWS`` permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[at : at + BLOCK, None] * _TIMES + _PLUS).min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A hash for each band of minima, as signed numbers."""
    from xxhash import xxh64_intdigest

    found = [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(found, np.uint64).view(np.int64).tolist()


def last_bytes(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum."""
    return ((least ^ (least >> np.uint64(32))) & np.uint64(255)).astype(np.uint8).view(np.int8)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``TEXTS``."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def looked(rows: DataFrame) -> DataFrame:
    """(n, rid, fp, bands, many, minima) of the texts (rid, text), numbered; many: distinct shingles; a written table."""
    kind = rows.schema["rid"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            found = [(f, len(h), minima(h)) for f, h in (look(t.as_buffer().to_pybytes()) for t in batch.column(1))]
            columns = [
                batch.column(0),
                pa.array(np.array([f for f, _, _ in found], np.uint64).view(np.int64)),
                pa.array([bands(m) for _, _, m in found], pa.list_(pa.int64())),
                pa.array([n for _, n, _ in found], pa.int64()),
                pa.array([last_bytes(m) for _, _, m in found], pa.list_(pa.int8())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "fp", "bands", "many", "minima"])

    made = rows.select("rid", whole_text("text").cast("binary").alias("text")).mapInArrow(work, f"rid {kind}, fp bigint, bands array<bigint>, many bigint, minima array<tinyint>")
    return settle(made.select(F.monotonically_increasing_id().alias("n"), "rid", "fp", "bands", "many", "minima"))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(n, s): the shingle hashes of the texts (n, text); a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            found = [look(t.as_buffer().to_pybytes())[1].view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["n", "s"])

    return settle(rows.select("n", whole_text("text").cast("binary").alias("text")).mapInArrow(work, "n bigint, s array<bigint>"))


def _pairs(*parts: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct pairs of the parts' first two columns; a written table."""
    both = reduce(DataFrame.union, [p.select(*[F.col(c).alias(k) for c, k in zip(p.columns, "xy", strict=True)]) for p in parts]).where("x <> y")
    return settle(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def candidates(seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs of the first round, those of the second, and (h, n) of the large groups, of ``seen`` (n, fp, bands)."""
    held = settle(seen.select("n", F.posexplode("bands").alias("band", "h")))
    head = F.min_by("n", F.xxhash64("n", F.col("band") % HEADS))
    groups = held.groupBy("h").agg(F.min("n").alias("first"), head.alias("head"), F.count("*").alias("size"))
    placed = settle(held.select("h", "n").join(groups.where("size > 1"), "h"))
    index = group_prints(seen.select("n", "fp"), "n", DISTANCE)
    stars = _pairs(placed.select("first", "n"), index.select("component_id", "n"))
    few = placed.where(F.col("size") <= FEW)
    each = few.select("h", F.col("n").alias("x")).join(few.select("h", F.col("n").alias("y")), "h").where("x < y").select("x", "y")
    large = placed.where(F.col("size") > FEW)
    return stars, _pairs(each, large.select("head", "n")), large.select("h", "n")


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "n") -> DataFrame:
    """``rows`` with the ``root`` of their node; a node without links is its own."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(known, node, "left").withColumn("root", F.coalesce("_root", node)).drop("_root")


def crowd_of(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(n): the members of large groups that are in more than one component; a written table."""
    placed = settle(_rooted(large, roots))
    apart = placed.groupBy("h").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("h")
    return settle(placed.join(apart, "h").select("n").distinct())


def prefixes(sets: DataFrame) -> DataFrame:
    """(tok, df, n, size, at): each set's rarest shingles, as many as two sets at ``SIMILARITY`` must share one of; a written table."""
    each = sets.select("n", F.size("s").alias("size"), F.explode("s").alias("tok"))
    ranked = each.join(each.groupBy("tok").agg(F.count("*").alias("df")), "tok").groupBy("n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("s"))
    many = (F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1).cast("int")
    first = ranked.select("n", "size", F.posexplode(F.slice("s", F.lit(1), many)).alias("at", "x"))
    return settle(first.select("x.tok", "x.df", "n", "size", "at").where("df > 1"))


def _enough(left: Column, sizes: Column) -> Column:
    """Whether ``left`` common shingles at most can make two sets of together ``sizes`` similar."""
    return left >= sizes * (SIMILARITY / (1 + SIMILARITY)) - 1e-9


def prefix_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b), a of ``x``, of the entries (tok, n, size, at, root) of one shingle whose sets can be similar if it is their first common one; a written table."""
    both = x.select("tok", *[F.col(c).alias(f"x_{c}") for c in ("n", "size", "at", "root")]).join(y.select("tok", *[F.col(c).alias(f"y_{c}") for c in ("n", "size", "at", "root")]), "tok")
    left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    can = (F.col("x_root") != F.col("y_root")) & _enough(left, F.col("x_size") + F.col("y_size"))
    return settle(both.where(can).select(F.col("x_n").alias("a"), F.col("y_n").alias("b")).distinct())


def _moved(rows: DataFrame, live: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (root, ...) with the roots that new links between documents of ``live`` (n, root, ...) give."""
    if links.isEmpty():
        return rows
    nodes = links.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    held = settle(live.select("n", "root").join(nodes, "n", "left_semi").distinct())
    side = lambda k: held.select(F.col("n").alias(k), F.col("root").alias(f"{k}_root"))
    edges = links.join(side("u"), "u").join(side("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    moved = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return rows.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def prefix_links(entries: DataFrame, seen: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """The links that join components ``roots`` of the sets that ``entries`` are prefixes of, until no similar pair is apart."""
    live = settle(_rooted(entries, roots))
    rare = live.where(F.col("df") <= RARE)
    found, turn = [similar(plausible(prefix_pairs(rare, rare).where("a < b"), seen), sets)], 0
    live = _moved(live, live, found[0]).where(F.col("df") > RARE)
    while True:
        roots_of = live.groupBy("tok", "root").agg(F.count("*").alias("c"), F.min("size").alias("least"))
        lists = roots_of.groupBy("tok").agg(F.max_by("root", "c").alias("main"), F.sum("c").alias("c"), F.max("c").alias("in_main"), F.min("least").alias("least")).where("c > in_main")
        near = F.greatest("least", F.ceil(F.col("size") * SIMILARITY - 1e-9))
        entry = ["tok", "df", "n", "size", "at", "root"]
        live = live.join(lists, "tok").where(_enough(F.col("size") - F.col("at"), F.col("size") + near))
        live = settle(live.select(*entry, (F.col("root") != F.col("main")).alias("other"), "c", (F.col("c") - F.col("in_main")).alias("others")))
        if live.isEmpty():
            return reduce(DataFrame.union, found)
        many = F.col("c") if turn < MIXED else F.col("others")
        drawn = (F.pmod(F.xxhash64("n", F.lit(turn)), F.ceil(many / (max(1, DRAWN // 4) if turn < MIXED else DRAWN))) == 0) & (F.col("other") | F.lit(turn < MIXED))
        heads = live.where(drawn).select(*entry)
        with scratch(seen.sparkSession):
            found.append(similar(plausible(prefix_pairs(heads, live.select(*entry)), seen), sets, outer=True))
            left = live.where(~drawn).select(*entry)
            live, turn = settle(_moved(left, live, found[-1]).select(*entry), outer=True), turn + 1


def plausible(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither the sizes of their sets nor their minima rule out; a written table."""
    side = lambda k: seen.select(F.col("n").alias(k), F.struct("many", "minima").alias(f"{k}_side"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("a_side.many", "b_side.many") >= F.greatest("a_side.many", "b_side.many") * SIMILARITY
    same = F.aggregate(F.zip_with("a_side.minima", "b_side.minima", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return settle(both.where(sizes & (same >= ALIKE)).select("a", "b"))


def similar(pairs: DataFrame, sets: DataFrame, outer: bool = False) -> DataFrame:
    """(u, v): the pairs (a, b) whose shingle sets are as similar as ``SIMILARITY``; a written table (``outer``: of the block around)."""
    first = sets.join(pairs.select(F.col("a").alias("n")).distinct(), "n", "left_semi")
    few = (first.agg(F.sum(F.size("s"))).first()[0] or 0) <= SENT
    first = first.select(F.col("n").alias("a"), F.col("s").alias("x"))
    both = pairs.join(sets.select(F.col("n").alias("b"), F.col("s").alias("y")), "b").join(F.broadcast(first) if few else first, "a")
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    return settle(both.where(common >= (small + large - common) * SIMILARITY).select(F.col("a").alias("u"), F.col("b").alias("v")), outer)


def near_roots(rows: DataFrame) -> DataFrame:
    """(rid, root) of the texts (rid, text) that have a near copy; root names their component; a written table."""
    with scratch(rows.sparkSession):
        seen = looked(rows)
        stars, rest, large = candidates(seen)
        stars, rest = plausible(stars, seen), plausible(rest, seen)
        wanted = stars.union(rest).select(F.explode(F.array("a", "b")).alias("n")).distinct()
        names = settle(seen.select("n", "rid").join(wanted, "n", "left_semi"))
        sets = shingle_sets(rows.join(names, "rid").select("n", "text"))
        links = similar(stars, sets)
        known = connected_components(links)
        root = lambda k: known.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
        apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
        rest = settle(rest.join(root("a"), "a", "left").join(root("b"), "b", "left").where(apart).select("a", "b"))
        needed = rest.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        links = links.union(similar(rest, sets.join(needed, "n", "left_semi")))
        roots = connected_components(links)
        crowd = crowd_of(large, roots)
        if not crowd.isEmpty():
            crowd = settle(seen.select("n", "rid").join(crowd, "n"))
            sets = shingle_sets(rows.join(crowd, "rid").select("n", "text"))
            roots = connected_components(links.union(prefix_links(prefixes(sets), seen, sets, roots)))
        found = roots.select("root", F.col("node").alias("n")).join(seen.select("n", "rid"), "n")
        return settle(found.select("rid", "root"), outer=True)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies stays, the one with the smallest doc_id (null last); columns as in ``docs``."""
    rows = numbered(docs, "near_doc")
    with scratch(docs.sparkSession):
        roots = near_roots(rows.select("rid", F.col("near_doc.text").alias("text")))
        text = whole_text("near_doc.text")
        ids = rows.select("rid", F.col("near_doc.doc_id").alias("doc_id"), (-F.length(text)).alias("less"), F.xxhash64(text).alias("mark"))
        named = settle(roots.join(ids, "rid").select("root", "rid", F.struct(F.col("doc_id").isNull(), "doc_id", "less", "mark", "rid").alias("place")))
        first = named.groupBy("root").agg(F.min("place").alias("first"))
        gone = settle(named.join(first, "root").where(F.col("rid") != F.col("first.rid")).select("rid"), outer=True)
    return without(rows, gone).select("near_doc.*")
