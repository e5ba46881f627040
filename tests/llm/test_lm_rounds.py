"""The language model's rounds over many small partitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import lm_scoring as L


def test_training_goes_on_over_many_partitions(spark):
    """Many small partitions: rounds go on from the average and reach the tail of long texts, not a sample's prefix."""
    rng = random.Random(8)
    # the first 12,000 characters of each text say nothing about what follows "p" and "q"
    rows = [(i, "z " * 6200 + " ".join(rng.choice(("p r", "q s")) for _ in range(1500))) for i in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    lex = L.build_lexicon(L.word_counts(texts), len(rows))
    model = L.Model(lex, L.train(texts, lex))
    unit = {w: lex.index[w.encode()] for w in "pqrs"}
    logs = lambda a, b: model.unit_logs(np.array([unit["r"], unit[a], unit[b]]))[-1]
    assert logs("p", "r") > np.log10(0.6) and logs("q", "s") > np.log10(0.6)
    one = L.train_round(L.encoded(texts, lex), lex.share, L.start(lex.share), None, 11)
    two = L.train_round(L.encoded(texts, lex), lex.share, *one, 12)
    assert all((two[1][k] >= one[1][k] - 1e-3).all() for k in one[1])  # Adagrad sums are carried
