"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

DataFrame functions only.  Fixed kinds: assignments, access keys and hexadecimal runs.  The battery
adds runs of ``CANDIDATE`` characters that look drawn at random:

* the encoding is inferred from the characters (decimal, hexadecimal, base 32, one-case or two-case
  alphanumeric, base 64) and gives the alphabet's size;
* uniformity: chi-squared of the characters' counts over the alphabet (Wilson-Hilferty);
* runs: the number of changes between lower case, upper case, digits and signs, against its expected
  number for random characters;
* serial correlation of neighbouring characters' codes (Fisher's z);
* a run passes if no test rejects randomness (Bonferroni at ``REJECT``).

Ordinary text passes by chance more easily the shorter it is, so each of the three statistics also gets its
place in ordinary text of the run's length: so even (it repeats letters so rarely), so many changes of class, so
little correlation.  The three are one probability (Stouffer, in proportion to what each tells), that of
ordinary text looking as random by the battery.  Those that
pass are discoveries if these probabilities, divided by weights in proportion to length, pass
Benjamini-Hochberg at ``FDR`` over all candidates of the corpus.  The probabilities are rounded up to
``BINS`` a decade, so the procedure needs only a bounded histogram, whatever the input.

Spans are code points, end exclusive.  A run that overlaps a fixed span isn't reported again.

Edge cases: null text counts as empty and has no spans; without candidates nothing is discovered;
repeated rows are reported each; an empty table gives an empty result; positions come from a fold
over chunks of a text's matches, so very long texts are whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import settle, whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
#: No letter or digit of another script may touch a candidate: those are words.
CANDIDATE = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![\p{L}\p{N}])"
#: Matches folded at once.
CHUNK = 128
REJECT, FDR, BINS, LOWEST = 0.001, 0.01, 20, -6000
#: Ordinary text: changes of class a character, and the chance that two letters are equal.
USUAL_CHANGE, USUAL_REPEAT, USUAL_SPREAD = 0.05, 0.066, 0.35
#: Ordinary text: mean and deviation of the size of the serial correlation, times the root of the length (a normal variable's size).
USUAL_SERIAL, SERIAL_SPREAD = 0.798, 0.603
#: What changes, evenness and correlation tell.
TELLS = (2.0, 1.0, 0.25)
KINDS = ("assign", "access", "hex", "random")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once; an expression inside a lambda is computed at every call."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _placed(pairs: Column) -> Column:
    """(start, stop, match) of (gap before, match) pairs.

    A fold copies what it has made at every step, so it goes over chunks, each from the sum of those before.
    """
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def add(held: Column, x: Column) -> Column:
        stop = held["at"] + x["g"] + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(held["out"], F.array(F.struct((held["at"] + x["g"]).alias("start"), stop.alias("stop"), x["m"].alias("match")))).alias("out"))

    def folded(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["g"] + F.length(x["m"])))
        firsts = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda held, n: F.struct((held["at"] + n).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out")),
            lambda held: held["out"],
        )
        return F.zip_with(chunks, firsts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), add, lambda held: held["out"]))

    number = F.floor((F.size(pairs) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), number), lambda k: F.slice(pairs, k * CHUNK + 1, CHUNK))
    return F.flatten(let(chunks, folded))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(g.alias("g"), m.alias("m")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())  # the text after the last match is no gap
    return F.when(text.rlike(pattern), let(pairs, _placed)).otherwise(none)


def fixed_spans(text: Column) -> dict[str, Column]:
    long_value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6
    return {
        "assign": F.filter(spans(text, ASSIGN), long_value),
        "access": F.filter(spans(text, ACCESS), lambda x: x["stop"] - x["start"] >= 20),
        "hex": spans(text, HEX),
    }


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a normal variable, from above by at most a few per cent in the tail."""
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2)
    tail = F.exp(-x * x) / (math.sqrt(math.pi) * (x + F.sqrt(x * x + 4 / math.pi)))
    return F.when(z > 0, tail).otherwise(F.lit(1.0))


def alphabet(word: Column) -> Column:
    """The size of the inferred encoding's alphabet."""
    sizes = ((r"^[0-9]+$", 10), (r"^([0-9a-f]+|[0-9A-F]+)$", 16), (r"^[A-Z2-7]+$", 32), (r"^([a-z0-9]+|[A-Z0-9]+)$", 36), (r"^[A-Za-z0-9]+$", 62))
    out = F.lit(64)
    for pattern, size in reversed(sizes):
        out = F.when(word.rlike(pattern), F.lit(size)).otherwise(out)
    return out.cast("double")


def classes(k: Column) -> Column:
    """The chance that two random characters of an encoding are of different classes."""
    shares = {10: (10,), 16: (10, 6), 32: (26, 6), 36: (26, 10), 62: (26, 26, 10), 64: (26, 26, 10, 2)}
    out = F.lit(0.0)
    for size, parts in shares.items():
        out = F.when(k == size, F.lit(1 - sum((p / size) ** 2 for p in parts))).otherwise(out)
    return out


def battery(found: DataFrame) -> DataFrame:
    """``found`` (word, ...) with n, passes and usual: the chance that ordinary text looks so random."""
    body = F.regexp_replace("word", "=+$", "")
    df = found.withColumn("body", body).withColumn("n", F.length("body").cast("double")).withColumn("k", alphabet(F.col("body")))
    letters = F.split("body", "")
    df = df.withColumn("letters", F.filter(letters, lambda c: c != ""))
    squares = F.aggregate(
        F.array_distinct("letters"),
        F.lit(0.0),
        lambda a, c: a + F.pow(F.col("n") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)),
    )
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", "[a-z]+", "l"), "[A-Z]+", "u"), "[0-9]+", "d"), "[+/_-]+", "s")
    df = df.withColumn("squares", squares).withColumn("changes", F.length(kinds) - 1.0)
    codes = F.transform("letters", lambda c: F.ascii(c).cast("double"))
    df = df.withColumn("codes", codes)
    mean = F.aggregate("codes", F.lit(0.0), lambda a, c: a + c) / F.col("n")
    df = df.withColumn("mean", mean)
    spread = F.aggregate("codes", F.lit(0.0), lambda a, c: a + (c - F.col("mean")) * (c - F.col("mean")))
    product = F.zip_with(
        F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda x, y: (x - F.col("mean")) * (y - F.col("mean"))
    )
    df = df.withColumn("serial", F.aggregate(product, F.lit(0.0), lambda a, c: a + c) / F.greatest(spread, F.lit(1e-9)))
    n, k, pairs = F.col("n"), F.col("k"), F.col("n") - 1
    chi, free = k / n * F.col("squares") - n, k - 1
    z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    rate = classes(k)
    z_runs = F.abs(F.col("changes") - pairs * rate) / F.sqrt(F.greatest(pairs * rate * (1 - rate), F.lit(1e-9)))
    held = F.greatest(F.least(F.col("serial"), F.lit(0.999)), F.lit(-0.999))
    z_serial = F.abs(F.log((1 + held) / (1 - held)) / 2) * F.sqrt(n - 3)
    least = F.least(upper_tail(z_chi), F.least(F.lit(1.0), 2 * upper_tail(z_runs)), F.least(F.lit(1.0), 2 * upper_tail(z_serial)))
    repeats = (F.col("squares") - n) / (n * (n - 1))
    z_change = (F.col("changes") - pairs * USUAL_CHANGE - 0.5) / F.sqrt(pairs * USUAL_CHANGE * (1 - USUAL_CHANGE))
    z_repeat = (USUAL_REPEAT - repeats) / (USUAL_SPREAD / F.sqrt(n * 10))
    z_flat = (USUAL_SERIAL - F.abs("serial") * F.sqrt(n)) / SERIAL_SPREAD
    usual = upper_tail((TELLS[0] * z_change + TELLS[1] * z_repeat + TELLS[2] * z_flat) / math.hypot(*TELLS))
    return df.withColumn("passes", (least * 3 >= REJECT) & (z_change > 0)).withColumn("usual", usual)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fixed spans and candidates of each row; a written table of spans, without texts."""
    t = whole_text(text)
    base = fixed_spans(t)
    cut = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return settle(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[cut(base[k]).alias(k) for k in KINDS[:3]], spans(t, CANDIDATE).alias("found"))
    )


def discovered(rows: DataFrame) -> DataFrame:
    """(rid, start, stop) of the runs that the battery and the false-discovery control let through."""
    each = rows.where(F.size("found") > 0).select("rid", F.explode("found").alias("x")).select("rid", "x.start", "x.stop", F.col("x.match").alias("word"))
    tested = settle(battery(each).select("rid", "start", "stop", "n", "passes", "usual"))
    m, mean = tested.agg(F.count("*"), F.avg("n")).first()
    if not m:
        return tested.select("rid", "start", "stop")
    weighed = F.greatest(F.least(F.col("usual") * F.lit(mean) / F.col("n"), F.lit(1.0)), F.lit(10.0 ** (LOWEST / BINS)))
    binned = tested.where("passes").withColumn("bin", F.ceil(F.log10(weighed) * BINS).cast("int"))
    counts = binned.groupBy("bin").count()  # at most -LOWEST rows
    total = F.sum("count").over(Window.orderBy("bin"))
    passed = counts.withColumn("total", total).where(F.pow(F.lit(10.0), F.col("bin") / BINS) * F.lit(m) <= F.lit(FDR) * F.col("total"))
    limit = passed.agg(F.max("bin")).first()[0]
    return binned.where(F.col("bin") <= F.lit(LOWEST - 1 if limit is None else limit)).select("rid", "start", "stop")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, assign, access, hex and random (arrays of start and stop)."""
    rows = candidates(docs, text)
    more = fresh(rows, settle(discovered(rows))).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("more"))  # the runs of one text
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return rows.join(more, "rid", "left").select("doc_id", *KINDS[:3], F.coalesce("more", none).alias("random"))


def fresh(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The ``runs`` (rid, start, stop) that overlap no fixed span of their text.

    In each text the fixed spans, at their start, and the runs, at their stop, go by place: a run is overlapped if a
    span that starts before the run's stop stops after the run's start.
    """
    fixed = rows.join(runs.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(F.concat(*[F.col(k) for k in KINDS[:3]])).alias("x"))
    nothing = F.lit(None).cast("int")
    events = fixed.select("rid", F.col("x.start").alias("at"), F.lit(1).alias("late"), F.col("x.stop").alias("reach"), nothing.alias("start"), nothing.alias("stop"))
    events = events.union(runs.select("rid", F.col("stop"), F.lit(0), nothing, "start", "stop"))
    before = Window.partitionBy("rid").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = events.withColumn("reached", F.coalesce(F.max("reach").over(before), F.lit(0)))
    return reached.where("start is not null and reached <= start").select("rid", "start", "stop")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:stop of all spans by start, then kind as listed, comma-joined."""

    def tag(number: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["stop"].alias("stop"))

    tagged = [F.transform(k, tag(i)) for i, k in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(F.sort_array(F.concat(*tagged)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
