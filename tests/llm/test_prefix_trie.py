"""The prefix trie against a plain trie in Python: small keys and blocks, so every round and level is met."""

import hashlib
import random
import re
import zlib

import pytest

from lexmill.llm import prefix_trie as T


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        parts = [below(k) for k in kids.get(p, ())]
        return sum(x[0] for x in parts) if parts else 1, sum(x[1] for x in parts) + (len(nodes[p]) - 1) * words(p)

    out = []
    for p, members in nodes.items():
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[7]))


def made(rng, many, letters, longest):
    """Conversations that copy the beginnings of others."""
    convs = {}
    for c in rng.sample(range(many * 3), many):
        near = list(rng.choice(list(convs.values()))) if convs and rng.random() < 0.7 else []
        near = near[: rng.randint(0, len(near))] if rng.random() < 0.7 else near
        convs[c] = near + [(rng.choice(["user", "assistant", ""]), rng.choice(letters)) for _ in range(rng.choice([0, 0, 1, 2, longest]))]
    return {c: t for c, t in convs.items() if t}


def rows_of(rng, convs):
    rows = [(c, k if k else None, r or None, t or None, 1, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth int, dig string"


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0], r[7]))


@pytest.mark.parametrize("seed, small", [(1, True), (2, True), (3, False)])
def test_tries_are_the_plain_ones(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(T, "KEY", 1)
        monkeypatch.setattr(T, "LONGEST_KEY", 2)
        monkeypatch.setattr(T, "BLOCK", 4)
        monkeypatch.setattr(T, "FAN", 2)
        monkeypatch.setattr(T, "PIECE", 3)
    rng = random.Random(seed)
    convs = made(rng, 60, ["", "a", "b c", "d\te  f"], 6)
    convs |= {1000 + k: [("user", "hot")] * 3 for k in range(15)}  # copies
    df = spark.createDataFrame(rows_of(rng, convs) + [(None, 1, "user", "lost", 1, "x")], SCHEMA).repartition(3)
    assert sorted_rows(T.rebuilt_trie(df)) == brute(rebuild(convs))
    if seed == 3:
        assert sorted_rows(T.prefix_trie(df)) == brute(convs)


def test_one_conversation_and_none(spark):
    one = spark.createDataFrame([(20, 0, "user", "a b", 1, "x")], SCHEMA)
    assert sorted_rows(T.prefix_trie(one)) == brute({20: [("user", "a b")]})
    assert T.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_without_a_turn_left(spark):
    convs = {c: [("u", "x")] for c in range(21, 39)}  # their base is absent: those with h > 0 are left turnless
    rows = [(c, 0, r, t, 1, "x") for c, turns in convs.items() for r, t in turns]
    assert sorted_rows(T.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuild(convs))


def test_solve_finds_nearest_smaller_values():
    rng = random.Random(8)
    for _ in range(200):
        v = [-1] + [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        ids = rng.sample(range(1000), len(v))
        rows = {c: [0] * len(v) for c in T.ELEMENT} | {"pos": list(range(len(v))), "v": v, "g_id": ids, "g_a": [1] * len(v), "a": [1] * len(v), "l": [-1] * len(v), "r": [-1] * len(v)}
        T.solve(rows, len(v))
        for i in range(1, len(v)):
            left = max(j for j in range(i) if v[j] < v[i])
            right = next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v))
            assert (rows["l"][i], rows["r"][i]) == (left, right)
            assert min(rows["l_id"][i], rows["r_id"][i]) == min(ids[left:right]) and rows["l_a"][i] + rows["r_a"][i] == right - left - 1
