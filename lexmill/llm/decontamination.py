"""Benchmark decontamination: BM25 over the test items with block-max WAND, then a check of overlap.

Index: each item is cut into units of at most ``UNIT`` words; BM25 weights use statistics over all
items and are divided by the unit's score for itself, so one threshold fits all units.  Units lie in
blocks of ``BLOCK``; each term has its largest weight (WAND's bound of a list) and its largest weight
in each block (the block-max bound).

Query: every passage of every document, that is every window of 2 * ``UNIT`` words at a step of
``UNIT``, so that each unit lies whole in some window.  WAND's steps are taken for many passages at once.
A passage's lists are ordered by their bounds and summed; the list at which the sum reaches the
threshold is the pivot (a passage without one ends).  No unit that stands only in lists before the pivot
can reach the threshold, so only the blocks in the lists from the pivot on are opened, all others are
skipped; of the opened ones those stay whose summed block maxima reach the threshold, and only their
units are scored.  All units above the threshold are retrieved, without a limit on their number.

Check: around each hit, the item's question (all but its last sentence) and answer (the last sentence,
or the last fifth of the words) must both share enough of their word trigrams with the document.

The index is built and sent to the workers in shards of about ``SHARD_UNITS`` / 2 units, dealt by hash of
unit, so that a long item's units are spread; ``SHARDS_AT_ONCE`` in a pass over the documents.  More items
mean more passes, never a larger broadcast, and one pass's index is alive at a time.  A pass holds the whole
texts of the items of which it has units.  Documents are not shuffled at all; with more than one pass
``drop_contaminated`` writes those left after each.

Edge cases: null texts count as empty; items without a word never match; items of less than three
words match where the whole item occurs; repeated items are reported under each id; items that share an
id but differ in text are items of their own, each reported; an item without an id is searched like others
and reported with null; ids may be of any type; an empty table on either side gives an empty result; texts
of any length are handled in pieces of some megabytes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm.common import scratch, settle, whole_text

UNIT, BLOCK = 64, 4
K1, B = 1.2, 0.75
#: Least BM25 score of a passage for a unit, as a share of the unit's score for itself.
THRESHOLD = 0.6
QUESTION, ANSWER = 0.6, 0.5
SHARD_UNITS, SHARDS_AT_ONCE = 1024, 8
#: Characters of documents, and (passage, term) pairs, held in arrays at once.
HELD_CHARS, HELD_PAIRS = 4_000_000, 100_000

_SENTENCE = re.compile(r"(?<=[.?!])\s+")
#: Latin-1 signs, general and CJK punctuation, full-width signs: none of them is part of a word.
_SIGNS = re.compile("[\u0080-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")
_LEADS = (b"\xc2", b"\xc3\x97", b"\xc3\xb7", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbc")
_ASCII = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of anything but ASCII signs, blanks and the signs above, as UTF-8."""
    raw = text.lower().encode("utf-8", "replace")
    if any(lead in raw for lead in _LEADS):
        raw = _SIGNS.sub(" ", raw.decode("utf-8")).encode("utf-8")
    return raw.translate(_ASCII).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer."""
    sentences = [s for s in _SENTENCE.split(text) if words_of(s)]
    if len(sentences) > 1:
        return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])
    words = words_of(text)
    cut = max(1, len(words) - max(1, len(words) // 5))
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(n)), strict=False))


def share(part: list[bytes], region: dict[int, set[tuple[bytes, ...]]]) -> float:
    """The share of a part's word n-grams (n: 3, or its length) found in a region."""
    if not part:
        return 1.0
    own = grams(part, n := min(3, len(part)))
    return len(own & region[n]) / len(own)


class Shard:
    """The postings of a bounded number of units, with the block maxima of every term."""

    def __init__(self, postings: Iterable[tuple[tuple[int, int], int, int, float]]):
        """``postings``: (unit, item, term, weight); terms are numbers of the pass's vocabulary."""
        rows = sorted(postings)
        units = {u: i for i, u in enumerate(dict.fromkeys(r[0] for r in rows))}
        self.item = [0] * len(units)
        self.terms = np.array(sorted({r[2] for r in rows}), np.int64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.maxima = np.zeros((len(place), -(-len(units) // BLOCK)), np.float32)
        self.inside: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for unit, item, term, weight in rows:
            u, t = units[unit], place[term]
            self.item[u] = item
            self.maxima[t, u // BLOCK] = max(self.maxima[t, u // BLOCK], np.float32(weight))
            self.inside[t, u // BLOCK].append((u, weight))
        self.list_max = self.maxima.max(axis=1) if len(place) else np.zeros(0, np.float32)
        at, self.blocks = np.nonzero(self.maxima)  # of each term in order
        self.first_block = np.searchsorted(at, np.arange(len(place) + 1))

    def search(self, window: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) of all units that reach the threshold; pairs come sorted by window, each once."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        window, term = window[known], at[known]
        if not len(window):
            return
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        floor = np.float32(threshold * 0.9999)  # sums of float32 may fall short by a rounding
        reaches = np.add.reduceat(self.list_max[term], starts) >= floor
        keep = np.repeat(reaches, np.diff(np.r_[starts, len(window)]))
        window, term = window[keep], term[keep]
        if not len(window):
            return
        order = np.lexsort((self.list_max[term], window))  # a passage's lists by their bounds
        window, term = window[order], term[order]
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        ends = np.r_[starts[1:], len(window)]
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + HELD_PAIRS, side="right")))
            yield from self._opened(window, term, starts[first:last], ends[first:last], floor, threshold)
            first = last

    def _opened(self, window: np.ndarray, term: np.ndarray, starts: np.ndarray, ends: np.ndarray, floor: np.float32, threshold: float) -> Iterator[tuple[int, int, float]]:
        low, sizes = starts[0], ends - starts
        own = term[low : ends[-1]]
        sums = np.cumsum(self.list_max[own], dtype=np.float64)
        before = np.repeat(np.r_[0.0, sums][starts - low], sizes)
        passage = np.repeat(np.arange(len(starts)), sizes)
        from_pivot = sums - before >= floor
        lists, passage = own[from_pivot], passage[from_pivot]
        counts = self.first_block[lists + 1] - self.first_block[lists]
        places = np.repeat(self.first_block[lists] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        width = self.maxima.shape[1]
        opened = np.unique(np.repeat(passage, counts) * width + self.blocks[places])
        passage, block, n = opened // width, opened % width, sizes[opened // width]
        ends_at = np.cumsum(n)
        at = 0
        while at < len(opened):  # so many at once that their lists are a bounded array
            to = max(at + 1, int(np.searchsorted(ends_at, (ends_at[at - 1] if at else 0) + 8 * HELD_PAIRS, side="right")))
            part = slice(at, to)
            first = np.r_[0, np.cumsum(n[part])[:-1]]
            places = np.repeat(starts[passage[part]] - low - first, n[part]) + np.arange(n[part].sum())
            bounds = np.add.reduceat(self.maxima[own[places], np.repeat(block[part], n[part])], first)
            for k in (at + np.flatnonzero(bounds >= floor)).tolist():
                q, b = int(passage[k]), int(block[k])
                scores: dict[int, float] = defaultdict(float)
                for t in term[starts[q] : ends[q]].tolist():
                    for unit, weight in self.inside.get((t, b), ()):
                        scores[unit] += weight
                for unit, value in scores.items():
                    if value >= threshold - 1e-9:
                        yield int(window[starts[q]]), self.item[unit], value
            at = to


class Index:
    """The shards of one pass and their common vocabulary."""

    def __init__(self, rows: list, items: dict[int, tuple[object, str]]):
        """``rows``: (shard, unit, item, term, weight); ``items``: an item's id and text."""
        self.vocabulary: dict[bytes, int] = {}
        by: dict[int, list[tuple[tuple[int, int], int, int, float]]] = defaultdict(list)
        for shard, unit, item, term, weight in rows:
            by[shard].append((unit, item, self.vocabulary.setdefault(term, len(self.vocabulary)), weight))
        self.shards = [Shard(p) for p in by.values()]
        self.ids = {k: i for k, (i, _) in items.items()}
        self.parts = {k: question_and_answer(text) for k, (_, text) in items.items()}

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's words in order; -1 outside the vocabulary."""
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def find(self, texts: list[str], threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each text: item -> (score, question overlap, answer overlap, first word of the passage)."""
        size = len(self.vocabulary)
        numbers = [self.numbers(t) for t in texts]
        counts = [max(1, -(-len(w) // UNIT) - 1) for w in numbers]  # windows of each text
        base = np.concatenate([[0], np.cumsum(counts)])
        keys = []
        for i, ids in enumerate(numbers):
            place = np.flatnonzero(ids >= 0)
            step, ids = place // UNIT, ids[place]
            for w in (step - 1, step):
                inside = (w >= 0) & (w < counts[i])
                keys.append((base[i] + w[inside]) * size + ids[inside])
        found: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        pairs = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(pairs):
            return found
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        window, term = pairs // size, pairs % size
        for shard in self.shards:
            cut, words = -1, []  # hits come in the texts' order: each text with a hit is cut into words once
            for w, item, value in shard.search(window, term, threshold):
                i = int(np.searchsorted(base, w, side="right")) - 1
                if i != cut:
                    cut, words = i, words_of(texts[i])
                first = (w - int(base[i])) * UNIT
                parts = self.parts[item]
                reach = sum(map(len, parts))
                near = words[max(0, first - reach) : first + 2 * UNIT + reach]
                region = {n: grams(near, n) for n in (1, 2, 3)}
                q, a = (share(p, region) for p in parts)
                if q >= question and a >= answer and (item not in found[i] or value > found[i][item][0]):
                    found[i][item] = (value, q, a, first)
        return found


def numbered_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text) of the distinct items, numbered in a written table."""
    rows = benchmark.select("item_id", whole_text().alias("text")).dropDuplicates()
    return settle(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))


def postings(items: DataFrame) -> DataFrame:
    """(item, part, term, weight) of all items; a written table.  Weights of a unit sum to one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = defaultdict(list)
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = max(1, -(-len(words) // UNIT))
                for k in range(n):
                    own = words[k * len(words) // n : (k + 1) * len(words) // n]
                    for term in set(own):
                        for name, value in (("item", item), ("part", k), ("term", term), ("tf", own.count(term)), ("len", len(own))):
                            out[name].append(value)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=pa.schema([("item", pa.int64()), ("part", pa.int32()), ("term", pa.binary()), ("tf", pa.int32()), ("len", pa.int32())]))

    terms = settle(items.select("item", "text").mapInArrow(cut, "item long, part int, term binary, tf int, len int"))
    units = terms.select("item", "part", "len").distinct()
    n, mean = units.agg(F.count("*"), F.avg("len")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    weighed = terms.join(df, "term").withColumn("raw", idf * tf)
    self_score = F.sum("raw").over(Window.partitionBy("item", "part"))  # at most UNIT rows
    return settle(weighed.select("item", "part", "term", (F.col("raw") / self_score).alias("weight")))


def passes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The index, a bounded number of shards at a time, and whether it is the only pass."""
    with scratch(benchmark.sparkSession):
        items = numbered_items(benchmark)
        weights = postings(items)
        n = weights.select("item", "part").distinct().count()
        shards = -(-n // (SHARD_UNITS // 2))  # hashing is uneven; half full on average keeps shards below the bound
        weights = weights.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(max(1, shards))).cast("int"))
        for first in range(0, shards, SHARDS_AT_ONCE):
            held = weights.where(F.col("shard").between(first, first + SHARDS_AT_ONCE - 1))
            rows = [(r["shard"], (r["item"], r["part"]), r["item"], bytes(r["term"]), r["weight"]) for r in held.toLocalIterator()]
            texts = items.join(held.select("item").distinct(), "item", "left_semi")
            yield Index(rows, {r["item"]: (r["item_id"], r["text"]) for r in texts.toLocalIterator()}), shards <= SHARDS_AT_ONCE


def _pieces(texts: Iterable[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= HELD_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of every leak; clean documents give no row."""
    spark = docs.sparkSession
    kinds = [t.schema[c].dataType for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double, question_overlap double, answer_overlap double, first_word bigint"
    item_type = to_arrow_type(kinds[1])
    rows = docs.select("doc_id", whole_text().alias("text"))
    out = spark.createDataFrame([], schema)
    for index, only in passes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [f for part in _pieces(batch.column(1).to_pylist()) for f in sent.value.find(part, threshold)]
                hits = [(i, sent.value.ids[item], *values) for i, f in enumerate(found) for item, values in sorted(f.items())]
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                columns = [pa.array([h[k] for h in hits], t) for k, t in ((1, item_type), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        found = rows.mapInArrow(work, schema)
        if only:
            return found
        out = out.union(settle(found, outer=True))
        sent.destroy()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns; rows are judged where they stand."""
    spark = docs.sparkSession
    for index, only in passes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = (t or "" for t in batch.column("text").to_pylist())
                clean = [not f for part in _pieces(texts) for f in sent.value.find(part, threshold)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        left = docs.mapInArrow(work, docs.schema)
        if only:
            return left
        docs = settle(left, outer=True)
        sent.destroy()
    return docs
