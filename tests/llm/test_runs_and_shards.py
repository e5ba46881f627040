"""Periodic runs and shards: brute force, edge cases, files."""

import hashlib
import random
import re
import zlib

import pytest

from lexmill.llm import runs as R
from lexmill.llm import sharding as S
from lexmill.llm.ordering import in_groups, in_order

# ---- runs -------------------------------------------------------------------------------------


def brute_runs(w):
    """Every stretch by its definition: for each period the maximal ones, those with a smaller period left out."""
    n, found = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(12, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                found.add((s, e - s, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def wanted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rng, letters, n):
    w = [rng.choice(letters) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_the_brute_force_ones(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [periodic(rng, [f"w{k}" for k in range(rng.choice([1, 2, 3, 5, 40]))], rng.randint(0, 80)) for _ in range(rng.randint(1, 6))]
        many, found, _ = R.look([b""] * len(texts), [" ".join(w).encode() for w in texts])
        assert many.tolist() == [len(w) for w in texts]
        assert [[(r["start"], r["length"], r["period"]) for r in rows] for rows in found.to_pylist()] == [brute_runs(w) for w in texts]


def test_runs_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH_BYTES", 600)
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "\x0ba\x0c" * 13, "x\x85y z  " * 9, "é ß " * 30, "the same the same the same " * 4 + "end"]
    texts += [" ".join(periodic(rng, ["a", "b", "c"], rng.randint(1, 70))) for _ in range(60)]
    texts += [" ".join(f"n{k}" for k in range(60)) + " tail " + " ".join(f"n{k}" for k in range(60))]  # a repeat that isn't a square
    rows = [(i if i != 5 else None, t, 1, 2) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, start int")
    got = sorted(R.digest(R.find_runs(docs, R.planted)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == wanted(r["doc_id"], texts[5 if r["doc_id"] is None else r["doc_id"]]), r


def test_a_long_text_with_a_long_period(spark):
    text = " ".join(["lead"] + [f"n{k}" for k in range(4000)] * 4)
    (r,) = R.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r["runs"]] == [(1, 16000, 4000)] and r["collapsed"] == " ".join(["lead"] + [f"n{k}" for k in range(4000)])


def test_runs_of_no_documents(spark):
    assert R.digest(R.find_runs(spark.createDataFrame([], "doc_id long, text string"), R.planted)).count() == 0


# ---- orders and shards ------------------------------------------------------------------------


def test_places_and_sums_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c"] if i % 3 else ["hot"]), rng.choice([None, *range(40)]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, i int, v long").repartition(7)
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    got = sorted(in_order(df, ["k", "x", "i"], ["v"], ["i"]).collect(), key=lambda r: r["at"])
    want = sorted(rows, key=key)
    assert [tuple(r)[:4] for r in got] == want and [r["at"] for r in got] == list(range(500))
    assert [r["v_before"] for r in got] == [sum(w[3] for w in want[:k]) for k in range(500)]
    assert [r["prev"] and r["prev"]["i"] for r in got] == [None, *[w[2] for w in want[:-1]]]
    for r in in_groups(df, "k", ["x", "i"], ["v"]).collect():
        own = [w for w in want if w[0] == r["k"]]
        k = [w[2] for w in own].index(r["i"])
        assert (r["place"], r["many"], r["v_before"]) == (k, len(own), sum(w[3] for w in own[:k]))


def brute_shards(rows, n):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]), crc(r[1])))
    total, before, slots, out = sum(size(r[1]) for r in rows), 0, {}, []
    for d, t in rows:
        k = (2 * before + size(t)) * n // (2 * total)
        before += size(t)
        slots[k] = slots.get(k, -1) + 1
        out.append((d, size(t), crc(t), "bytes", k, slots[k], None))
    return out


@pytest.mark.parametrize("shards", [1, 16, 1000])
def test_shards_are_the_sequential_ones(spark, tmp_path, shards):
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, *range(100)]) if i % 3 else None, rng.choice([None, "", "é" * rng.randint(0, 50), "same text"])) for i in range(300)] + [(50, "x" * 3000)]
    spark.createDataFrame([(*r, 1, 2, "q") for r in rows], "doc_id long, text string, shard int, rid int, size string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    order = lambda r: tuple((x is not None, x or 0) for x in (r[0], r[1], r[2], r[4], r[5]))
    assert sorted(map(tuple, S.assign(docs, shards).collect()), key=order) == sorted(brute_shards(rows, shards), key=order)
    whole = S.sharded(docs, shards)
    assert whole.columns == ["doc_id", "text", "shard", "rid", "size", "shard_2", "slot"] and whole.count() == len(rows)


def test_written_shards_are_whole_and_even(spark, tmp_path):
    rows = [(i, "w" * (i % 40)) for i in range(500)]
    S.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), 8, 16)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == rows
    held = {}
    for r in got.collect():
        held.setdefault(r["shard"], []).append(r)
    ends = [(min(x["doc_id"] for x in held[k]), max(x["doc_id"] for x in held[k])) for k in range(8)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # contiguous
    sizes = [sum(len(x["text"]) + 1 for x in held[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 41


def test_shards_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.assign(empty).count() == 0 and S.sharded(empty).count() == 0
