"""Quality, language model and leaks: held-out accuracy, normalisation, brute force and edge cases."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import decontamination as D
from lexmill.llm import lm_scoring as L
from lexmill.llm import quality as Q

WORDS = [f"w{i}{'aeiou'[i % 5]}n" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)).capitalize()


def junk(rng, n):
    return " ".join(rng.choice(WORDS).upper() + rng.choice(["!!", "###", "$$$"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        rows.append((i, (prose if good else junk)(rng, rng.randint(5, 200)), "x", 1.0))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000, None, None, None), (1001, "", "x", 1.0), (1002, "w " * 50000, "x", 1.0), (1003, "twice", "x", 1.0), (1003, "twice", "x", 1.0)]
    labels += [(0, None, None), (5000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    got = Q.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got.held_out].merge(labels.toPandas().dropna(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3).astype(int)).all()


def test_quality_stage_keeps_columns(corpus):
    docs, labels = corpus
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def test_runs_of_signs_take_linear_time(spark):
    from pyspark.sql import functions as F

    texts = ["#" * 1_000_000 + "a", "#$ " * 300_000, "ab!! c?!x !!", "x" * 1_000_000]
    began = time.time()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array(*Q.statistics(F.col("t"))).alias("x")).collect()
    assert time.time() - began < 60
    tails = lambda n, words: np.arcsinh(20 * n / (words + 20))
    assert [r["x"][8] for r in got] == pytest.approx([tails(0, 1), tails(300_000, 300_000), tails(2, 3), tails(0, 1)])


def test_quality_without_labels(corpus, spark):
    docs, labels = corpus
    assert {r["score"] for r in Q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    assert {r["score"] for r in Q.classify(docs, one).collect()} == {1.0}


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    cov = [np.diag([1.0, 2.0, 3.0]), np.eye(3) * 0.5]
    model = Q.Discriminant((np.zeros(3), np.ones(3)), tuple(np.linalg.cholesky(c) for c in cov), 0.3)

    def log_density(mean, c):
        d = x - mean
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * math.log(np.linalg.det(c))

    want = log_density(np.ones(3), cov[1]) - log_density(np.zeros(3), cov[0]) + 0.3
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-want)))


def test_language_model_base_and_gain(corpus):
    docs, _ = corpus
    got = L.score_fold(docs).toPandas()
    rows = docs.toPandas()
    tokens = [(t or "").encode().lower().split() + [b""] for t in rows["text"]]
    trained = [zlib.crc32(str(int(i)).encode()) % 5 != 1 for i in rows["doc_id"]]
    count = Counter(w for ws, t in zip(tokens, trained, strict=True) if t for w in ws)
    n, v = sum(count.values()), len(count)
    want = {}
    for i, ws, t in zip(rows["doc_id"], tokens, trained, strict=True):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[int(i)] = (not t, len(ws), sum(count[w] > 0 for w in ws), n, base)
    assert len(got) == len(rows)
    for r in got.itertuples():
        held, m, known, total, base = want[int(r.doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, m, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 or r.n_tokens == 0


def small_lexicon(words, head=None):
    count = Counter(words)
    cut = sorted(count.items(), key=lambda x: (-x[1], x[0]))[: head or len(count)]
    cw, ct = np.zeros(L.CLASSES), np.zeros(L.CLASSES)
    for w, c in count.items():
        cw[L.unit_of(w) - L.SINGLES] += c
        ct[L.unit_of(w) - L.SINGLES] += 1
    for w, c in cut[: L.SINGLES]:
        cw[L.unit_of(w) - L.SINGLES] -= c
        ct[L.unit_of(w) - L.SINGLES] -= 1
    return L.Lexicon(cut, sum(count.values()), len(count), 10, cw, ct), count


def test_probabilities_are_normalised():
    rng = random.Random(4)
    words = [w.encode() for w in rng.choices(WORDS, k=4000)] + [f"rare{i}".encode() for i in range(300)]
    lex, count = small_lexicon(words)
    model = L.Model(lex, L.start(lex.share))
    for context in ([L.END, L.END], [3, 7], [L.SINGLES + 5, L.END]):
        units = np.array([[*context, u] for u in range(L.UNITS)])
        logs = np.array([model.unit_logs(row)[2] for row in units])
        assert (10.0**logs).sum() == pytest.approx(1.0, abs=1e-4)
    inside = Counter()  # within a class the words' shares and one unseen share add up to one
    for w, i in lex.index.items():
        if i >= L.SINGLES:
            inside[int(lex.unit[i])] += 10.0 ** lex.inner[i]
    for u, total in inside.items():
        unseen = 0.5 / (lex.class_words[u - L.SINGLES] + 0.5 * (lex.class_types[u - L.SINGLES] + 1))
        assert total + unseen == pytest.approx(1.0, abs=1e-9)


def test_training_learns_contexts():
    rng = random.Random(6)
    text = []
    for _ in range(30000):
        text.append(WORDS[rng.randrange(50)].encode() if not text or text[-1] >= b"x" else b"x%d" % rng.randrange(50))
    lex, _ = small_lexicon(text)
    units = lex.encode(b" ".join(text))[1]
    trainer = L.Trainer(L.start(lex.share), lex.share)
    for _ in range(12):
        trainer.learn([units[:25000]])
    before = L.Model(lex, L.start(lex.share)).unit_logs(units[25000:]).mean()
    after = L.Model(lex, trainer.p).unit_logs(units[25000:]).mean()
    assert after > before + 0.1


def test_language_model_without_training_rows(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = L.score_fold(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0 and got[0]["n_tokens"] == 3
    assert L.score_fold(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- leaks ------------------------------------------------------------------------------------


def leaks_by_brute_force(docs, items):
    found = set()
    for d, text in docs:
        words = D.words_of(text or "")
        for i, item in items:
            want = D.words_of(item or "")
            if want and any(words[k : k + len(want)] == want for k in range(len(words) - len(want) + 1)):
                found.add((d, i))
    return found


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([4, 12, 30, 60, 64, 65, 150, 300])) + " So it is.") for i in range(40)]
    items += [(40, None), (41, ""), (42, "one"), (43, items[0][1]), (44, "?! ..")]
    docs = []
    for d in range(120):
        text = prose(rng, rng.randint(0, 400))
        if d % 4 == 0:
            text += " " + items[rng.randrange(40)][1].upper() + " | " + prose(rng, rng.randint(0, 300))
        docs.append((d, text, "x"))
    docs += [(500, None, None), (501, "", "x"), (502, "w " * 100000 + items[5][1].replace(" ", " | ") + " w" * 1000, "x"), (503, items[7][1], "y"), (503, items[7][1], "y")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


def test_leaks_are_found_and_clean_documents_left_alone(leaky):
    docs, items, d, b = leaky
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()}
    want = leaks_by_brute_force([r[:2] for r in docs], items)
    assert want <= got
    assert {x[0] for x in got} == {x[0] for x in want}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in docs if r[0] not in {x[0] for x in want})


def test_leaks_over_several_passes(leaky, monkeypatch):
    docs, items, d, b = leaky
    whole = {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()}
    monkeypatch.setattr(D, "SHARD_UNITS", 16)
    monkeypatch.setattr(D, "SHARDS_AT_ONCE", 2)
    monkeypatch.setattr(D, "HELD_PAIRS", 50)
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()} == whole


def test_pruning_loses_no_unit_above_the_threshold():
    """Block-max search against the plain sum over all postings."""
    rng = random.Random(10)
    postings, units = [], {}
    for u in range(37):
        terms = rng.sample(range(300), 20)
        raw = [rng.random() for _ in terms]
        units[u] = {t: w / sum(raw) for t, w in zip(terms, raw, strict=True)}
        postings += [(u, u, t, w) for t, w in units[u].items()]
    shard = D.Shard(postings)
    pairs = sorted({(q, t) for q in range(60) for t in rng.sample(range(320), rng.randint(1, 200))})
    window, term = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    got = {(q, u) for q, u, _ in shard.search(window, term, 0.5)}
    want = {(q, u) for q in range(60) for u, w in units.items() if sum(w.get(t, 0) for p, t in pairs if p == q) >= 0.5}
    assert got == want and want


def test_leaks_of_empty_tables(leaky):
    _, _, d, b = leaky
    assert D.contaminated(d, b.limit(0)).count() == 0
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == d.count()


def test_items_of_any_id(spark):
    """Ids that are text, repeated with other texts, or missing; a long item's units lie in several shards."""
    rng = random.Random(4)
    items = [("set/1", prose(rng, 40)), ("set/1", prose(rng, 50)), (None, prose(rng, 30)), ("long", prose(rng, 900)), ("clash", None)]
    docs = [(i, prose(rng, 80) + " " + (text or "") + " " + prose(rng, 80)) for i, (_, text) in enumerate(items)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect())
    assert got == [(0, "set/1"), (1, "set/1"), (2, None), (3, "long")]
    assert [r["doc_id"] for r in D.drop_contaminated(d, b).collect()] == [4]
