"""Mixing sources to target weights, in DataFrame operations only.

Sources in code-point order (null last) take the weights in turn.  All sources together get
``share`` times their words; a source's target stops at ``cap`` times its size and what is over is
reshared by weight.  That is water filling: with sources ordered by cap/weight, the level is the
largest of (total - caps before) / (weights from here on).

Each document is emitted floor(rate) times, plus one copy if its hash-seeded draw is below the
fraction, so its probability is the fraction.  The draws are 32-bit parts of md5(seed:doc_id).  Each
source uses the one of ``SEEDS`` seeds whose draws come nearest its target; sums for all seeds are
taken in one pre-aggregated pass, so a source of any size is never gathered in a task.

Edge cases: null text has size 0 (and is copied like any other row: zero words); null source is a
source of its own, last in order; a source without words has target 0 and its documents are not
taken; rows with one doc_id draw alike; an empty table gives an empty result; columns of ``docs``
may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, settle, whole_text

#: Seeds from which each source takes the one nearest its target; four per md5.
SEEDS = 32


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1): part ``seed`` mod 4 of the md5 of the seed's block and the id."""
    digest = F.md5(F.concat(F.lit(f"{seed // 4}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 8 * (seed % 4) + 1, 8), 16, 10).cast("double") / 4294967296.0


def source_rates(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source_size, target, base, frac) of each source of ``sizes`` (key, source, size)."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    at = (total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("at", at).withColumn("level", F.max("at").over(everything))
    per = per.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    return per.select("key", "source_size", "target", "base", (F.col("rate") - F.col("base")).alias("frac"))


def choose_seeds(sizes: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with ``seed``: the first of those whose draws come nearest the source's target."""
    drawn = [
        F.sum(F.when(_draw(F.col("doc_id"), k) < F.col("frac"), F.col("size")).otherwise(F.lit(0))).alias(f"s{k}") for k in range(SEEDS)
    ]
    sums = sizes.join(rates.select("key", "frac"), "key").groupBy("key").agg(*drawn)
    off = F.array(*[F.abs(F.col("base") * F.col("source_size") + F.col(f"s{k}") - F.col("target")) for k in range(SEEDS)])
    return (
        rates.join(sums, "key")
        .withColumn("off", off)
        .withColumn("seed", (F.array_position("off", F.array_min("off")) - 1).cast("int"))
        .select("key", "source_size", "target", "base", "frac", "seed")
    )


def copies(doc_id: Column, rate: str = "") -> Column:
    """Copies of a row: its source's base, and one more if its draw is below the fraction."""
    draw = reduce(lambda rest, k: F.when(F.col(f"{rate}seed") == k, _draw(doc_id, k)).otherwise(rest), reversed(range(SEEDS)), F.lit(1.0))
    return F.col(f"{rate}base") + F.when(draw < F.col(f"{rate}frac"), F.lit(1)).otherwise(F.lit(0))


def document_sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        _key(source).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("size"),
    )


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The sizes of the documents, and the sources' rates and seeds; both are written tables."""
    sizes = settle(document_sizes(docs))
    rates = settle(source_rates(sizes, weights, share, cap))
    return sizes, settle(choose_seeds(sizes, rates))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sizes, rates = plan_mix(docs, weights, share, cap)
    out = sizes.join(rates, "key").withColumn("copies", copies(F.col("doc_id")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns and the copy's number from 1.

    That column is ``copy``, or ``copy_2``, ``copy_3`` and so on where ``docs`` has such a column already.
    """
    names = {c.lower() for c in docs.columns}
    number = next(c for c in (f"copy_{k}" if k > 1 else "copy" for k in count(1)) if c not in names)
    _, rates = plan_mix(docs, weights, share, cap)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"))
    keyed = whole.withColumn("mix_key", _key("mix_doc.source"))
    rates = rates.select(F.col("key").alias("mix_key"), F.struct("base", "frac", "seed").alias("mix_rate"))
    taken = keyed.join(rates, "mix_key").withColumn("mix_n", copies(F.col("mix_doc.doc_id"), "mix_rate.").cast("int"))
    kept = [F.col(f"mix_doc.`{c}`") for c in docs.columns]
    return taken.where("mix_n > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias(number))


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_at
  FROM weighed
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level_at) OVER () * weight) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), split AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS base, rate - floor(rate) AS frac FROM rates
), draws AS (
  SELECT s.doc_id, s.source, s.size, k.seed, p.frac, p.base, p.source_size, p.target,
    CAST(('0x' || substr(md5((k.seed // 4) || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')), CAST(8 * (k.seed % 4) + 1 AS INT), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sizes s JOIN split p ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT unnest(range({SEEDS})) AS seed) k
), near AS (
  SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS place FROM (
    SELECT source, seed, abs(max(base) * max(source_size) + sum(CASE WHEN u < frac THEN size ELSE 0 END) - max(target)) AS off FROM draws GROUP BY source, seed)
)
SELECT d.doc_id, d.size, d.source_size, d.target,
  CAST((d.base + CASE WHEN d.u < d.frac THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken,
  CAST(d.base + CASE WHEN d.u < d.frac THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM draws d JOIN near n ON d.source IS NOT DISTINCT FROM n.source AND d.seed = n.seed AND n.place = 1
"""
