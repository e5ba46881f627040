"""Periodic runs of words: Crochemore's partition refinement over whole texts.

Positions are in one class at level L if the L words from there on are the same.  From one level to the next a
class is split by the classes of its members' successors; of the parts into which a class falls the largest
is left out of the next level's splitting (the smaller half), so a text of n words costs n log n.  Classes keep
their members linked in order of position; where a neighbour in the class at level q stands q words on, a square
of period q begins, and q is its smallest period.  Squares of one period at consecutive positions make a run.

Many texts are refined at once, as numpy arrays: each ends in a mark of its own, so nothing crosses texts.  A
task holds some ``BATCH_BYTES`` of texts at a time, or one longer text; Spark deals the rows, no row is shuffled.

A run is a stretch with smallest period q, of ``LEAST`` words and of 2q words at least, that can't be extended.
``collapsed`` is the text without the words that stand in any run after its first q words.

Edge cases: null text counts as empty; a text without words has no runs and collapses to the empty text; repeated
rows give a row each; a null id counts as the empty text where a rule takes the id's digits; an empty table gives an
empty result; other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import whole_text

LEAST = 12
BATCH_BYTES = 8 << 20

#: From an id's digits and the number of words to the words to take instead (their numbers), or None for all in order.
Choice = Callable[[bytes, int], np.ndarray | None]


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where groups of equal, sorted keys begin."""
    opens = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=opens[1:])
    return opens.nonzero()[0]


def _widths(firsts: np.ndarray, end: int) -> np.ndarray:
    """How far it is from each group's begin to the next one's, the last ending at ``end``."""
    ends = np.full(len(firsts), end)
    ends[:-1] = firsts[1:]
    return ends - firsts


def _slots(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each segment, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - (ends - sizes - starts).repeat(sizes)


class Classes:
    """The classes of equal factors over an array of symbols, refined level by level."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.level = 1
        self.members = np.argsort(symbols, kind="stable")  # by class; each class has a segment
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        firsts = _firsts(symbols[self.members])
        self.count = len(firsts)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: self.count] = firsts
        self.size[: self.count] = _widths(firsts, n)
        self.of = np.empty(n, np.int64)
        self.of[self.members] = np.repeat(np.arange(self.count), self.size[: self.count])
        self.next, self.last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.waiting: dict[int, list[np.ndarray]] = defaultdict(list)  # by distance, positions whose neighbour stands so far on
        self._link(self.members, self.size[: self.count])
        self.small = np.arange(n)

    def _wait(self, at: np.ndarray) -> None:
        gap = self.next[at] - at
        late = (self.next[at] >= 0) & (gap >= self.level)
        at, gap = at[late], gap[late]
        by = np.argsort(gap, kind="stable")
        at, gap = at[by], gap[by]
        cut = _firsts(gap)
        for g, part in zip(gap[cut].tolist(), np.split(at, cut[1:]) if len(cut) else ()):
            self.waiting[g].append(part)

    def _link(self, members: np.ndarray, sizes: np.ndarray) -> None:
        """Link groups of members, ascending in each."""
        ends = np.cumsum(sizes)
        ahead, behind = np.full(len(members), -1), np.full(len(members), -1)
        ahead[:-1], behind[1:] = members[1:], members[:-1]
        ahead[ends - 1] = -1
        behind[ends - sizes] = -1
        self.next[members], self.last[members] = ahead, behind
        self._wait(members)

    def squares(self) -> np.ndarray:
        """Ascending positions where a square of period ``level`` begins."""
        held = self.waiting.pop(self.level, None)
        if held is None:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(held))
        return at[self.next[at] - at == self.level]

    def _unlink(self, gone: np.ndarray) -> None:
        """Take members, ascending in each class, out of their classes' lists."""
        opens, closes = np.ones(len(gone), bool), np.ones(len(gone), bool)
        np.not_equal(self.next[gone[:-1]], gone[1:], out=opens[1:])  # those that follow each other in a list go as one
        closes[:-1] = opens[1:]
        before, after = self.last[gone[opens]], self.next[gone[closes]]
        some, none = before >= 0, after >= 0
        self.next[before[some]] = after[some]
        self.last[after[none]] = before[none]
        self._wait(before[some])

    def refine(self) -> bool:
        """Go on to the next level; False if no class can be split any more."""
        self.level += 1
        at = self.small - 1
        own = self.of[at]
        keep = (at >= 0) & (self.size[own] > 1)
        at, own, by = at[keep], own[keep], self.of[self.small[keep]]
        self.small = at[:0]
        if not len(at):
            return False
        key = own * len(self.of) + by
        order = np.argsort(key, kind="stable")
        at, own, key = at[order], own[order], key[order]
        groups = _firsts(key)  # parts of classes, by the class of the successor
        sizes, group_of = _widths(groups, len(key)), own[groups]
        classes = _firsts(group_of)
        ids, parts = group_of[classes], _widths(classes, len(group_of))
        rest = self.size[ids] - np.add.reduceat(sizes, classes)
        largest = np.maximum.reduceat(sizes, classes)
        number = np.arange(len(ids)).repeat(parts)
        top = np.flatnonzero(sizes == largest[number])
        top = top[_firsts(number[top])]  # the first largest part of each class
        leaves = np.ones(len(groups), bool)
        leaves[top[rest == 0]] = False  # where nothing else is left, the largest part keeps the class
        small = leaves.copy()
        small[top[rest < largest]] = False
        goes = leaves.repeat(sizes)
        gone, gone_of = at[goes], own[goes]
        if len(gone):
            self._unlink(gone[np.lexsort((gone, gone_of))])
            new = sizes[leaves]
            self._link(gone, new)
            self._move(gone, gone_of)
            fresh = np.arange(self.count, self.count + len(new))
            self.count += len(new)
            self.of[gone] = fresh.repeat(new)
            self.start[fresh], self.size[fresh] = self.place[gone[np.cumsum(new) - new]], new
        over = ids[(rest > 0) & (rest < largest)]  # what is left of a class is small itself
        left = self.members[_slots(self.start[over], self.size[over])]
        self.small = np.sort(np.concatenate([at[(small & leaves).repeat(sizes)], left]))
        return True

    def _move(self, gone: np.ndarray, gone_of: np.ndarray) -> None:
        """Put the members that leave at the ends of their classes' segments, and shorten these."""
        firsts = _firsts(gone_of)
        ids, many = gone_of[firsts], _widths(firsts, len(gone))
        self.size[ids] -= many
        tail = _slots(self.start[ids] + self.size[ids], many)
        stood = self.place[gone]
        empty = stood[stood < (self.start[ids] + self.size[ids]).repeat(many)]
        held = self.members[tail]
        self.place[gone] = -1
        held = held[self.place[held] >= 0]  # members that stay go where others have left
        self.members[tail], self.place[gone] = gone, tail
        self.members[empty], self.place[held] = held, empty


def runs_of(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in symbols whose texts have ``longest`` words at most and end in marks of their own."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    classes = Classes(symbols)
    while True:
        q, at = classes.level, classes.squares()
        if len(at):
            first = np.r_[True, np.diff(at) != 1]
            start, end = at[first], at[np.r_[first[1:], True]] + 2 * q
            long = end - start >= LEAST
            found.append((start[long], end[long], np.full(int(long.sum()), q)))
        if 2 * (q + 1) > longest or not classes.refine():
            break
    start, end, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def look(ids: Sequence[bytes], texts: Sequence[bytes], choice: Choice | None = None) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Of a few texts: the numbers of words, the runs as an array of lists, and the collapsed texts."""
    words = [t.split() for t in texts]  # at the six ASCII blanks
    if choice is not None:
        for k, (name, own) in enumerate(zip(ids, words)):
            taken = choice(name, len(own)) if own else None
            if taken is not None:
                words[k] = [own[i] for i in taken.tolist()]
    many = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(many + 1) - many - 1
    numbers: dict[bytes, int] = {}
    symbols = np.empty(int(many.sum()) + len(many), np.int64)
    number = numbers.setdefault
    for at, own in zip(begin.tolist(), words):
        symbols[at : at + len(own)] = [number(w, len(numbers)) for w in own]
    symbols[begin + many] = len(numbers)
    text_of = np.repeat(np.arange(len(many)), many + 1)
    start, end, period = runs_of(text_of * (len(numbers) + 1) + symbols, int(many.max(initial=0)))
    owner = text_of[start]
    covered = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, end, -1)
    kept = np.cumsum(covered) == 0
    for k in np.unique(owner).tolist():
        words[k] = [w for w, stays in zip(words[k], kept[begin[k] : begin[k] + many[k]].tolist()) if stays]
    columns = [pa.array(start - begin[owner]), pa.array(end - start), pa.array(period)]
    offsets = pa.array(np.searchsorted(owner, np.arange(len(many) + 1)).astype(np.int32))
    return many, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "length", "period"])), [b" ".join(w) for w in words]


def find_runs(docs: DataFrame, choice: Choice | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
                part = batch.slice(at, upto - at)
                ids, texts = ([x.as_buffer().to_pybytes() for x in part.column(k)] for k in (1, 3))
                many, runs, collapsed = look(ids, texts, choice)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many), runs, pa.array([c.decode() for c in collapsed], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                at = upto

    text = whole_text()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("name"), F.octet_length(text).alias("size"), text.cast("binary").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(name: bytes, n: int) -> np.ndarray | None:
    """The query's rule: where the crc32 h of the id's digits ends in 0, words from a on repeat with period p."""
    h = zlib.crc32(name)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    taken = np.arange(n)
    taken[a:] = a + (taken[a:] - a) % p
    return taken


def digest(found: DataFrame) -> DataFrame:
    """What the query returns: the longest run, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    period = -F.col("top.period")
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        period.alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
