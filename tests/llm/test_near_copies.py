"""The pipeline's near-copy stage: edited copies against brute force over every pair."""

import random

import pytest

import corpus_pipeline
from lexmill.llm import near_copies as N
from lexmill.llm import simhash


def jaccard(a: str, b: str) -> float:
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def texts():
    """Thirty texts, each with edited copies on both sides of 0.8; one group of 60 copies of one text."""
    rng = random.Random(3)
    out = []
    for k in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(100, 400))]
        out.append(" ".join(words))
        for edits in (1, 3, 5, 12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{k}"
            out.append(" ".join(copy))
    hot = [f"h{i}" for i in range(300)]
    out += [" ".join(hot[:i] + ["edit"] + hot[i + 1 :]) for i in range(0, 300, 5)]
    return out


def test_stage_drops_edited_copies_and_nothing_else(spark, texts):
    n, root = len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    for i in range(n):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                far += (prints[i] ^ prints[j]).bit_count() > 2
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert far > 100  # pairs that two bits of 64 don't reach
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s")], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_copies(spark, df, "")
    assert kept.columns == df.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == [i for i in range(n) if find(i) == i] and left.count(None) == 0


def test_edge_texts_and_empty_tables(spark):
    rows = [(1, None), (2, " \n"), (3, "a b"), (4, "A  B"), (5, "a b c"), (6, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.drop_near_copies(df).collect()) == [1, 3, 5, 6]
    assert N.drop_near_copies(df.where("doc_id > 9")).count() == 0


def test_rows_that_share_an_id_are_rows_of_their_own(spark, tmp_path):
    t, u, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuv")
    rows = [(3, t, "a"), (7, t, "b"), (7, u, "c"), (9, v, "d"), (None, u, "e"), (None, v + " x", "f"), (9, v, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        kept = N.drop_near_copies(docs)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, t), (7, u), (9, v)]


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    from lexmill.sources import staging

    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    df = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(20)], "doc_id long, text string")
    assert N.drop_near_copies(df).count() == 3
    assert len(list(tmp_path.glob("*/*"))) == 2  # the numbered rows and those that go


@pytest.mark.parametrize("order", [1, -1])
def test_ties_follow_the_text_not_the_place(spark, tmp_path, order):
    t, u = (" ".join(f"{c}{i}" for i in range(80)) for c in "tu")
    rows = [(7, t), (7, t + " tail"), (7, t + " rest"), (8, u + " b"), (8, u + " a")]
    spark.createDataFrame(rows[::order], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    kept = {r["doc_id"]: r["text"] for r in N.drop_near_copies(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    marks = {r["text"]: r["m"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) as m").collect()}
    assert kept == {7: min((t + " tail", t + " rest"), key=marks.get), 8: min((u + " b", u + " a"), key=marks.get)}


@pytest.mark.parametrize("apart", [True, False])
def test_pairs_within_a_template_are_found(spark, monkeypatch, apart):
    """600 documents share a template: two of them are at 0.79 (or, over the template alone, at 0.75), those of a pair above 0.8."""
    rng = random.Random(12)
    template, texts = [f"t{i}" for i in range(400)], []
    for k in range(300):
        for half in range(2):
            extra = [f"p{k}x{i}" for i in range(10 if apart else 18)] + [f"q{k}h{half}x{i}" for i in range(43 if apart else 48)]
            texts.append(" ".join(template + extra))
    rng.shuffle(texts)
    assert jaccard(*[t for t in texts if "p0x0 " in t]) >= 0.8 > jaccard(next(t for t in texts if "p0x0 " in t), next(t for t in texts if "p1x0 " in t))
    kept = N.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(kept) == 300 and len({r["text"].split("p")[1].split("x")[0] for r in kept}) == 300


def test_frequent_shingles_in_prefixes_are_searched_in_rounds(spark, monkeypatch):
    """Documents of different sizes that consist of shared passages: prefixes hold frequent shingles, and heads are drawn."""
    monkeypatch.setattr(N, "RARE", 1)
    monkeypatch.setattr(N, "DRAWN", 2)
    monkeypatch.setattr(N, "FEW", 2)
    rng = random.Random(13)
    passages = [" ".join(f"g{p}w{i}" for i in range(60)) for p in range(8)]
    texts = [" ".join(rng.choice(passages) for _ in range(rng.randint(2, 6))) + f" own{i} " + " ".join(f"o{i}n{j}" for j in range(rng.choice([0, 3, 20]))) for i in range(70)]
    root = list(range(70))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(70):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = N.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i in range(70) if find(i) == i]
