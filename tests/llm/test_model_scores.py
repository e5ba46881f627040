"""Scores of the quality classifier and of the language model, computed again from the same rows and parameters in plain numpy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from lexmill.llm import lm_scoring as L
from lexmill.llm import quality as Q

B = r"\x20\x09-\x0D"
TEXTS = [
    None, "", " \n\t ", "One. Two, three!", "THE the the THE\nline\nline\n", "a ## b $$$ c!! (d) e?! \x0b f", "中文 текст ÉÉ 12,5 x_y @z", "word " * 300, "l\n" * 40, "- - -- ... #", "a!!b c!!\nd..e",
]


def statistics(text):
    n = lambda p: len(regex.findall(p, text))
    words, lines = n(rf"[^{B}]+"), text.split("\n")
    rate = lambda part, whole, usual=0.0, weight=20.0: math.asinh(20 * (part + usual * weight) / (whole + weight))
    distinct = len(set(regex.split(r"[\x20\x09-\x0d]+", text)))
    return [
        math.log1p(words), math.log1p((len(text) + 100) / (words + 20)),
        rate(n(r"\p{Lu}"), len(text), 0.03, 100), rate(n(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'\"()+=@/_-]"), len(text), 0, 100),
        rate(n(rf"(?<![^{B}])[^\p{{L}}\p{{N}}{B}]++(?![^{B}])"), words), rate(n(r"[.?]"), words, 0.1), rate(n(","), words, 0.05), rate(n("[!|#$%&*]"), words),
        rate(n(rf"(?<![^\p{{L}}\p{{N}} \t\n\x0b\f\r.,;:])[^\p{{L}}\p{{N}} \t\n\x0b\f\r.,;:]{{2,}}+(?![^{B}])"), words),
        rate(n(rf"(?<![^{B}])([^{B}]++)\x20\1(?![^{B}])"), words), rate(n(rf"(?<![^{B}])[^{B}]{{1,3}}(?![^{B}])"), words, 0.4),
        math.log1p((words + 2) / (distinct + 2)), rate(len(lines) - len(set(lines)), len(lines), 0, 5), rate(len(lines) - 1, words, 0.03),
    ]


def test_statistics_are_those_of_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in Q.features(df).collect():
        assert np.allclose(r["x"], statistics(TEXTS[r["doc_id"]] or "")), TEXTS[r["doc_id"]]


def test_quality_scores_are_density_ratios_of_shrunken_covariances(spark):
    rng = random.Random(5)
    word = lambda good: rng.choice(["stone", "river", "Light", "tree,", "path."] if good else ["##", "BUY", "now!!", "x", "$$$"])
    docs = [(i, " ".join(word(rng.random() < (0.9 if i % 3 else 0.4)) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(None, "no id"), (500, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(2, 1), (4, None), (None, 1), (900, 0)]
    got = {r["doc_id"]: r for r in Q.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    x = {i: np.array(statistics(t or "")) for i, t in docs}
    known = [(x[i], y) for i, y in labels if i in x and i is not None and y is not None and fold(i) != 0]
    own = {k: np.array([v for v, y in known if y == k]) for k in (0, 1)}
    width, total = len(x[0]), len(known)
    cov = {k: np.cov(own[k].T, bias=True) for k in own}
    pooled = sum(len(own[k]) * cov[k] for k in own) / total
    logs = {}
    for k in own:
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.trace(c) / width * np.eye(width)
        logs[k] = lambda v, c=c, m=own[k].mean(axis=0): -0.5 * (v - m) @ np.linalg.solve(c, v - m) - 0.5 * np.linalg.slogdet(c)[1]
    for i, _ in docs:
        margin = logs[1](x[i]) - logs[0](x[i]) + math.log(len(own[1]) / len(own[0]))
        want = 1 / (1 + math.exp(-max(-500, min(500, margin))))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert (got[i]["held_out"], got[i]["predicted"]) == (fold(i) == 0, int(got[i]["score"] >= 0.3))


def test_language_scores_are_softmax_logs_and_shares(spark, monkeypatch):
    """Every token's probability from the parameters, word for word: its unit after the two before it, times its share of the unit."""
    monkeypatch.setattr(L, "HEAD", 450)  # so that some words are not of the head
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(380)] + [f"rare{i}" for i in range(200)]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))).title()) for i in range(60)] + [(100, None), (101, "never seen words"), (102, "x" * 300 + " w1")]
    held = {}

    def parameters(texts, lexicon):
        p = L.start(lexicon.share)
        noise = np.random.default_rng(3)
        held.update({k: v + noise.normal(0, 0.05, v.shape).astype(np.float32) for k, v in p.items()})
        return held

    monkeypatch.setattr(L, "train", parameters)
    got = {r["doc_id"]: r for r in L.score_fold(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    learned = [(t or "").encode().lower().split() for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in learned for w in t)
    singles = {w: k for k, (w, _) in enumerate(sorted(((w, c) for w, c in count.items() if len(w) <= L.LONG), key=lambda x: (-x[1], x[0]))[: L.SINGLES])}
    unit = lambda w: singles.get(w, L.unit_of(w))
    words, types = Counter(), Counter()
    for w, c in count.items():
        if w not in singles:
            words[unit(w)] += c
            types[unit(w)] += 1
    p = {k: v.astype(np.float64) for k, v in held.items()}
    for i, t in docs:
        total, h1, h2 = 0.0, L.END, L.END
        for w in [*(t or "").encode().lower().split(), None]:
            u = L.END if w is None else unit(w)
            logits = (p["r"][h1] @ p["c1"] + p["r"][h2] @ p["c2"]) @ p["q"].T + p["b"]
            total += (logits[u] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if w is not None and w not in singles:
                total += math.log10((count[w] + 0.5) / (words[u] + 0.5 * (types[u] + 1)))
            h1, h2 = u, h1
        assert got[i]["score"] == pytest.approx(total, rel=2e-5, abs=1e-4), i
