"""The whole corpus pipeline on odd rows, against a version in plain Python from its own first stage on."""

import random
import re

import corpus_pipeline
from lexmill.llm import decontamination as D


def prose(rng, n):
    return " ".join(rng.choice("river stone walking under bright morning light carries small boats home again").upper().lower() + str(rng.randint(0, 40)) for _ in range(n)) + "."


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(40, 120)) for _ in range(60)]
    item = "which of the seven lanterns did the keeper light before the storm came over the hills. It was the third one."
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", None, 1), (3, texts[5], "en", "s0", 1), (3, prose(rng, 50), "en", "s0", 1), (7, texts[7] + " tail", "en", "s1", 1)]
    rows += [(None, prose(rng, 60), None, None, None), (None, prose(rng, 60), None, None, None), (90, None, "en", "s1", 0), (91, "", "en", "s1", 0), (92, " ", "en", "s1", 0)]
    rows += [(93, prose(rng, 30) + " " + item + " " + prose(rng, 30), "en", "s2", 1), (94, prose(rng, 30000), "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, rid int"
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (200, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality_classifier(spark, read, str(tmp_path)).collect()]
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert mixed.columns == [*docs.columns, "copy_2"]
    got = mixed.collect()

    groups = {}
    for d, t in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, t))
    left = [(None if g[1] else g[2], g[3] or "") for g in (min(v) for v in groups.values())]
    sets = [shingles(t) for _, t in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    kept = []
    for k in set(root):
        kept.append(min((left[i] for i in range(len(left)) if root[i] == k), key=lambda x: (x[0] is None, x[0] or 0, -len(x[1]))))  # of one id the longer text
    kept = [(d, t) for d, t in kept if item not in t]
    assert {(r["doc_id"], r["text"] or "") for r in got} <= set(kept)
    size = lambda t: len(D.re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(size(t) for _, t in kept)
    assert abs(sum(size(r["text"] or "") for r in got) - 1.5 * total) < 0.5 * total  # one long text holds most words
