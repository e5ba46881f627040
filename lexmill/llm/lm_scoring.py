"""LM scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Vocabulary: the most frequent words and the end mark are units of their own; every other word belongs
to one of ``CLASSES`` units by the crc32 of its last three bytes.  The model predicts the unit from the
two units before it: prediction = r(h1) C1 + r(h2) C2, score = prediction . q(unit) + b(unit).  The
probability of a word is the model's of its unit times the word's smoothed share in the unit, so all
words, unseen ones too, share a total of one.  Contexts are pairs of units, so the normalisers of all
contexts are one table, made once by batched matrix products; token log-probabilities are normalised.

Training covers every token of every training document, ``ROUNDS`` times: word counts are aggregated in
Spark (a row for each word and Arrow batch before the shuffle) and texts are written as units once; in
each round every partition trains on all its own tokens from the round's common start, and parameters and
Adagrad sums are averaged with the partitions' token counts as weights, pre-aggregated, as the next
round's start.  The first start is drawn with a fixed seed, without data.

Counts of all words never meet in one place: the most frequent words (``HEAD`` at most, of at most
``LONG`` bytes, so the size is bounded) go to the workers, the others are joined by word.

Edge cases: null text counts as empty, which is one end token; without training documents base and
score are those of the uniform start (0); repeated rows are scored each; an empty table gives an empty
result; words of any length and texts of any length are handled whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import id_remainder, settle, whole_text

SINGLES, CLASSES, WIDTH = 400, 367, 16
UNITS = SINGLES + CLASSES + 1
END = UNITS - 1
HEAD, LONG = 131_072, 256
#: Steps of count per doubling; the head ends at a step, so that it is found without sorting all words.
STEPS = 64
NOISE, BATCH, RATE = 20, 2048, 0.1
ROUNDS = 3
#: Words of text counted or scored at once, and units learned at once.
HELD_BYTES, HELD_UNITS = 8 << 20, 1 << 20

Parameters = dict[str, np.ndarray]


def unit_of(word: bytes) -> int:
    """The unit of a word that has none of its own."""
    return SINGLES + crc32(word[-3:]) % CLASSES


class Lexicon:
    """The head of the vocabulary, with counts, units and what smoothing needs."""

    def __init__(self, head: list[tuple[bytes, int]], words: int, types: int, documents: int, class_words: np.ndarray, class_types: np.ndarray):
        """``words``, ``types``: of the training texts without end marks; class totals are without the singles."""
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([n for _, n in head] + [documents], np.float64)
        self.unit = np.array([i if i < SINGLES else unit_of(w) for i, (w, _) in enumerate(head)] + [END], np.int32)
        self.total, self.types = words + documents, types + (documents > 0)
        self.class_words, self.class_types = class_words, class_types
        self.base = np.log10((self.count + 0.5) / (self.total + 0.5 * (self.types + 1)))
        inside = self.unit[SINGLES:-1] - SINGLES
        self.inner = np.zeros(len(self.count))
        if len(inside):
            self.inner[SINGLES:-1] = np.log10((self.count[SINGLES:-1] + 0.5) / (class_words[inside] + 0.5 * (class_types[inside] + 1)))
        mass = np.concatenate([np.pad(self.count[:-1][:SINGLES], (0, max(0, SINGLES - len(head)))), class_words, [documents]]) + 0.5
        self.share = mass / mass.sum()

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(head numbers or -1, units, tail words in order) of a text's words and its end."""
        words = text.lower().split()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        units = self.unit[at]
        places = np.flatnonzero(at < 0)
        tail = [words[p] for p in places.tolist()]
        units[places] = np.fromiter(map(unit_of, tail), np.int32, len(tail))
        return np.append(at, len(self.count) - 1), np.append(units, np.int32(END)), tail


def start(share: np.ndarray) -> Parameters:
    random = np.random.default_rng(7)
    draw = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
    eye = np.eye(WIDTH, dtype=np.float32)
    return {"r": draw(UNITS, WIDTH), "q": draw(UNITS, WIDTH) * 0.3, "c1": eye * 0.5, "c2": eye * 0.3, "b": np.log(share).astype(np.float32)}


def _scatter(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sums of their rows."""
    order = np.argsort(at.astype(np.int16), kind="stable")  # a radix sort
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation by Adagrad over batches of (h2, h1, target) units."""

    def __init__(self, p: Parameters, share: np.ndarray, rate: float = RATE, seed: int = 11, seen: Parameters | None = None):
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: seen[k].copy() if seen else np.full(v.shape, 0.1, np.float32) for k, v in p.items()}
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.edges = np.cumsum(share)
        self.random, self.rate, self.tokens = np.random.default_rng(seed), rate, 0

    def _step(self, name: str, gradient: np.ndarray, at=slice(None)) -> None:
        held = self.seen[name]
        held[at] += gradient * gradient
        self.p[name][at] += self.rate * gradient / np.sqrt(held[at])

    def _learn_batch(self, h2: np.ndarray, h1: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        noise = np.minimum(np.searchsorted(self.edges, self.random.random(NOISE)), UNITS - 1)
        r1, r2 = p["r"][h1], p["r"][h2]
        guess = r1 @ p["c1"] + r2 @ p["c2"]
        q, qn = p["q"][target], p["q"][noise]
        own = np.einsum("ij,ij->i", guess, q) + p["b"][target] - self.log_noise[target]
        other = guess @ qn.T + (p["b"][noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.minimum(own, 30)))
        down = -1 / (1 + np.exp(np.minimum(-other, 30)))
        d_guess = up[:, None] * q + down @ qn
        scale = np.float32(1 / np.sqrt(n))
        units, rows = _scatter(target, np.hstack([up[:, None] * guess, up[:, None]]))
        self._step("q", rows[:, :-1] * scale, units)
        self._step("b", rows[:, -1] * scale, units)
        units, rows = _scatter(noise, np.hstack([down.T @ guess, down.sum(axis=0)[:, None]]))
        self._step("q", rows[:, :-1] * scale, units)
        self._step("b", rows[:, -1] * scale, units)
        units, rows = _scatter(np.concatenate([h1, h2]), np.concatenate([d_guess @ p["c1"].T, d_guess @ p["c2"].T]))
        c1, c2 = r1.T @ d_guess, r2.T @ d_guess
        self._step("r", rows * scale, units)
        self._step("c1", c1 * scale)
        self._step("c2", c2 * scale)
        self.tokens += n

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over the texts' units, in a shuffled order of their places."""
        if not texts:
            return
        units = np.concatenate([np.concatenate([[END, END], t]) for t in texts]).astype(np.int64)
        fresh = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        inside = np.ones(len(units), bool)
        inside[fresh], inside[fresh + 1] = False, False
        places = np.flatnonzero(inside)
        self.random.shuffle(places)
        for i in range(0, len(places), BATCH):
            at = places[i : i + BATCH]
            self._learn_batch(units[at - 2], units[at - 1], units[at])


class Model:
    """The trained parameters with the normalisers of all contexts."""

    def __init__(self, lexicon: Lexicon, p: Parameters):
        self.lexicon = lexicon
        self.near, self.far = p["r"] @ p["c1"], p["r"] @ p["c2"]
        self.q, self.b = p["q"], p["b"]
        self.norm = np.empty((UNITS, UNITS), np.float32)  # [h1, h2]
        for h1 in range(UNITS):
            scores = (self.near[h1] + self.far) @ self.q.T + self.b
            top = scores.max(axis=1)
            self.norm[h1] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))

    def unit_logs(self, units: np.ndarray) -> np.ndarray:
        """log10 of the model's probability of each unit after the two before it."""
        h1, h2 = np.append(END, units[:-1]), np.concatenate([[END, END], units[:-2]])[: len(units)]
        score = np.einsum("ij,ij->i", self.near[h1] + self.far[h2], self.q[units]) + self.b[units] - self.norm[h1, h2]
        return score.astype(np.float64) / np.log(10)

    def text(self, text: bytes) -> tuple[int, int, float, float, list[bytes]]:
        """(tokens, known head tokens, base, score, tail words); base and score lack the tail words' own shares."""
        at, units, tail = self.lexicon.encode(text)
        logs = self.unit_logs(units).sum()
        own = at[at >= 0]
        known = int((self.lexicon.count[own] > 0).sum())
        return len(at), known, float(self.lexicon.base[own].sum()), float(logs + self.lexicon.inner[own].sum()), tail


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (text binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in _texts(batch, 0):
                held.update(text.lower().split())
                size += len(text)
                if size >= HELD_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.mapInArrow(work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _class(word: Column) -> Column:
    return (F.pmod(F.crc32(F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)), F.lit(CLASSES))).cast("int")


def build_lexicon(counts: DataFrame, documents: int) -> Lexicon:
    short = counts.where(F.length("word") <= LONG).withColumn("step", F.floor(F.log2("n") * STEPS))
    held, cut = 0, 0
    for r in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 64 * STEPS rows
        if (held := held + r["count"]) > HEAD:
            cut = r["step"] + 1
            break
    head = [(bytes(r["word"]), r["n"]) for r in short.where(F.col("step") >= cut).select("word", "n").collect()]
    head.sort(key=lambda x: (-x[1], x[0]))
    totals = counts.groupBy(_class(F.col("word")).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    words, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        words[r["k"]], types[r["k"]] = r["n"], r["types"]
    everything, kinds = int(words.sum()), int(types.sum())
    for word, n in head[:SINGLES]:
        k = unit_of(word) - SINGLES
        words[k] -= n
        types[k] -= 1
    return Lexicon(head, everything, kinds, documents, words, types)


_ORDER = ("r", "q", "c1", "c2", "b")


def encoded(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(units) of every row of ``texts`` (text binary); a written table."""
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.encode(t)[1].astype(np.int16) for t in _texts(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int16()))], ["units"])

    return settle(texts.select("text").mapInArrow(work, "units array<smallint>"))


def train_round(units: DataFrame, share: np.ndarray, p: Parameters, seen: Parameters | None, seed: int) -> tuple[Parameters, Parameters]:
    """Parameters and Adagrad sums averaged over the partitions' own, each trained on all tokens of its rows."""
    sent = units.sparkSession.sparkContext.broadcast((share, p, seen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, p, seen = sent.value
        own, held, size = Trainer(p, share, RATE, seed, seen), [], 0
        for batch in batches:
            column = batch.column(0)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for first, last in zip(ends[:-1], ends[1:], strict=True):
                held.append(flat[first:last])
                size += last - first
                if size >= HELD_UNITS:
                    own.learn(held)
                    held, size = [], 0
        own.learn(held)
        if own.tokens:
            flat = np.concatenate([part[k].ravel() for part in (own.p, own.seen) for k in _ORDER] + [np.ones(1, np.float32)]).astype(np.float64) * own.tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    sums = units.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # twice the model's size
    flat = np.empty(len(sums))
    flat[sums["at"]] = sums["value"]
    flat, out, place = (flat / flat[-1]).astype(np.float32), [], 0
    for _ in range(2):
        part = {}
        for k in _ORDER:
            part[k] = flat[place : place + p[k].size].reshape(p[k].shape)
            place += p[k].size
        out.append(part)
    return out[0], out[1]


def train(texts: DataFrame, lexicon: Lexicon) -> Parameters:
    """The parameters after ``ROUNDS`` averaged rounds over all tokens of ``texts`` (text)."""
    units, p, seen = encoded(texts, lexicon), start(lexicon.share), None
    for k in range(ROUNDS):
        p, seen = train_round(units, lexicon.share, p, seen, 11 + k)
    return p


def score_documents(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, learns (negated as held_out), counts, base_score and score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), learns.alias("learns"), whole_text(text_col).cast("binary").alias("text"))
    texts = rows.where("learns").select("text")
    counts = settle(word_counts(texts))
    documents = texts.count()
    lexicon = build_lexicon(counts, documents)
    model = Model(lexicon, train(texts, lexicon) if documents else start(lexicon.share))
    sent = spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tails = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            found = [model.text(t) for t in _texts(batch, 2)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            tail = pa.array([[{"word": w, "n": n} for w, n in Counter(f[4]).items()] for f in found], tails)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, tail], ["id", "learns", "n_tokens", "n_known", "base", "score", "tail"])

    scored = rows.mapInArrow(work, f"id {kind}, learns boolean, n_tokens bigint, n_known bigint, base double, score double, tail array<struct<word:binary,n:bigint>>")
    scored = settle(scored.withColumn("rid", F.monotonically_increasing_id()))
    each = scored.where(F.size("tail") > 0).select("rid", F.explode("tail").alias("x")).select("rid", "x.word", F.col("x.n").alias("times"))
    known = each.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    room = F.lit(float(lexicon.total + 0.5 * (lexicon.types + 1)))
    in_class = F.element_at(F.array(*[F.lit(float(w + 0.5 * (t + 1))) for w, t in zip(lexicon.class_words, lexicon.class_types, strict=True)]), _class(F.col("word")) + 1)
    sums = known.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / room)).alias("base_more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / in_class)).alias("score_more"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0 if b != "more" else 0))
    return scored.drop("tail").join(sums, "rid", "left").select(
        F.col("id").alias(id_col),
        (~F.col("learns")).alias("held_out"),
        "n_tokens",
        plus("n_known", "more").alias("n_known"),
        F.lit(int(lexicon.total)).cast("long").alias("train_tokens"),
        plus("base", "base_more").alias("base_score"),
        plus("score", "score_more").alias("score"),
    )


def score_fold(docs: DataFrame) -> DataFrame:
    """``score_documents`` where documents of fold 1 of 5 are held out."""
    return score_documents(docs, id_remainder() != 1)
