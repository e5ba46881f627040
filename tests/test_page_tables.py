"""Rows, columns and tables of pages: plans against the sequential rules on random pages, and cases."""

import random

import page_model as M
import pytest
from pyspark.sql import functions as F

from lexmill.operators import layout
from lexmill.operators import page_tables as P
from lexmill.operators.ranges import range_join

SCHEMA = "doc_id long, page int, text string, left double, right double, top double, height double, font_size double, font_name string, paths int"


def random_page(rng):
    step, columns = rng.choice([4, 7, 9, 12, 16, 20, 30]), rng.sample(range(30, 560, 10), rng.randint(1, 5))
    words = []
    for k in range(rng.randint(1, 30)):
        y = 780.0 - step * k - rng.choice([0, 0, 0, 1, 3, 0.5])
        several = rng.random() < 0.7
        for x in sorted(columns) if several else [rng.choice(columns)]:
            for n in range(rng.choice([1, 1, 2, 3])):
                text = rng.choice(["a", "bb", "中文", "x中", "long word", "end.", "42", "9", " ", "第一章"])
                left = x + 35.0 * n + rng.choice([0, 1, 2, 5, 9])
                words.append((text, left, left + 6.0 * len(text), y + rng.choice([0, 0, 0, 0.25, 2])))
    rng.shuffle(words)
    return [(t, a, b, y, 12.0, rng.choice([12.0] * 5 + [18.0, 4.0])) for t, a, b, y in words]


def model_words(rows):
    return [{"text": t, "left": a, "right": b, "top": y, "size": f if f >= 5 else h} for t, a, b, y, h, f in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_are_the_sequential_ones(spark, seed):
    rng = random.Random(seed)
    pages = {(d, p): (random_page(rng), rng.choice([0, 9])) for d in range(30) for p in (1, 2)}
    rows = [(d, p, *w, "X", paths) for (d, p), (words, paths) in pages.items() for w in words]
    df = layout.font_facts(spark.createDataFrame(rows, SCHEMA).repartition(5))
    own = P.numbered_words(df).cache()
    loose = {}
    for r in P.loose_rows(own).collect():
        loose.setdefault((r["doc_id"], r["page"]), {})[r["row_no"]] = (r["y"], r["n_words"], r["clusters"])
    regions = {}
    for r in P.table_regions(P.loose_rows(own)).orderBy("region").collect():
        regions.setdefault((r["doc_id"], r["page"]), []).append(r["columns"])
    lines = {}
    for r in P.page_lines(df).orderBy("line_no").collect():
        lines.setdefault((r["doc_id"], r["page"]), []).append(r)
    tables = 0
    for key, (words, paths) in pages.items():
        want_lines, want_rows, want_regions = M.page(model_words(words), paths)
        assert [loose.get(key, {})[k][1:] for k in sorted(loose.get(key, {}))] == [(len(r), len(M.clusters(r))) for r in want_rows]
        assert [[round(c, 6) for c in r] for r in regions.get(key, [])] == [[round(c, 6) for c in r] for r in want_regions]
        got = [(r["text"], r["kind"], r["merged"], [tuple(c) for c in r["cells"]] if r["cells"] is not None else None) for r in lines.get(key, [])]
        assert got == [(x["text"], x["kind"], x["merged"], x["cells"]) for x in want_lines], key
        tables += sum(x["kind"] == "table" for x in want_lines)
    assert tables > 20


def test_single_words_between_rows_of_a_table_dont_part_it(spark):
    rows = []
    for k, y in enumerate((700.0, 670.0, 640.0)):
        rows += [(1, 1, f"a{k}", 50.0, 70.0, y, 12.0, 12.0, "X", 0), (1, 1, f"b{k}", 300.0, 320.0, y, 12.0, 12.0, "X", 0)]
    rows += [(1, 1, "one", 50.0, 70.0, y, 12.0, 12.0, "X", 0) for y in (685.0, 655.0)]
    got = P.page_lines(layout.font_facts(spark.createDataFrame(rows, SCHEMA))).orderBy("line_no").collect()
    assert [r["kind"] for r in got] == ["table"] * 5 and [tuple(c) for c in got[0]["cells"]] == [(0, "a0"), (1, "b0")]


def test_more_ruling_lines_allow_wider_gaps(spark):
    rows = [(d, 1, t, x, x + 20.0, 700.0 - 60.0 * k, 12.0, 12.0, "X", paths) for d, paths in ((1, 0), (2, 6), (3, None)) for k in range(3) for t, x in (("a", 50.0), ("b", 300.0))]
    got = P.page_lines(layout.font_facts(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(1, "body"), (2, "table"), (3, "body")}


def test_equal_words_stay_together_in_any_order_of_rows(spark):
    """Up to eight equal words after a gap: one order of them serves gaps, clusters, blanks and cells, so none is parted from the others."""
    rng = random.Random(7)
    page = [(t, x, x + 20.0, 700.0 - 12.0 * k, 12.0, 12.0) for k in range(12) for x in (50.0, 200.0, 350.0) for t in ("AO7", "RF3") for _ in range(rng.randint(1, 8))]
    want = M.page(model_words(page), 0)
    for partitions in (1, 7):
        rng.shuffle(page)
        df = layout.font_facts(spark.createDataFrame([(1, 1, *w, "X", 0) for w in page], SCHEMA).repartition(partitions))
        got = P.page_lines(df).orderBy("line_no").collect()
        assert [(r["text"], r["kind"], [tuple(c) for c in r["cells"]]) for r in got if r["cells"] is not None] == [(x["text"], x["kind"], x["cells"]) for x in want[0] if x["cells"] is not None]
        lines = P.text_lines(P.numbered_words(df)).orderBy("line_no").collect()
        assert [r["text"] for r in lines] == [M.joined(r) for r in M.rows_by_anchor(model_words(page), 7.2)]
        cells = layout.cell_gaps(df, ["doc_id", "page", "top"]).orderBy("top", "cluster").collect()
        left = {(t, x): [w for w in page if w[3] == t and w[1] == x] for t in {w[3] for w in page} for x in (50.0, 200.0, 350.0)}
        assert [(r["top"], r["left"], r["text"]) for r in cells] == [(t, x, "".join(sorted(w[0] for w in left[t, x]))) for t, x in sorted(left)]
    assert any(x["cells"] for x in want[0])


def test_odd_words(spark):
    rows = [(1, 1, None, 1.0, 2.0, 3.0, 1.0, 12.0, "X", 0), (1, 1, "x", None, 2.0, 3.0, 1.0, 12.0, "X", 0), (1, 1, "y", 1.0, 9.0, None, 1.0, 12.0, "X", 0), (1, 2, "z", 1.0, 1.0, 3.0, None, None, None, 0)]
    got = P.page_lines(layout.font_facts(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["page"], r["text"], r["kind"]) for r in got] == [(2, "z", "body")]
    assert P.page_lines(layout.font_facts(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_range_join_is_the_plain_one(spark, width):
    rng = random.Random(int(width))
    points = [(rng.randint(0, 2), i, rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-9, 9))])) for i in range(200)]
    ranges = [(rng.randint(0, 2), i, float(rng.randint(-20, 20)), rng.uniform(-10, 30)) for i in range(60)]
    ranges = [(k, i, a, a + d) for k, i, a, d in ranges]
    got = range_join(spark.createDataFrame(points, "k int, p int, v double"), spark.createDataFrame(ranges, "k int, r int, a double, b double"), ["k"], "v", "a", "b", width)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted((r["p"], r["r"]) for r in got.collect()) == sorted((p, r) for k, p, v in points for q, r, a, b in ranges if k == q and v is not None and a <= v <= b)


def test_columns_are_running_means(spark):
    rng = random.Random(5)
    cases = [[float(rng.randint(0, 90)) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, c in enumerate(cases) for x in c], "i int, left double").groupBy("i", "left").agg(F.count("*").alias("n"))
    got = df.groupBy("i").agg(P.columns_of(F.sort_array(F.collect_list(F.struct("left", "n")))).alias("c"))
    for r in got.collect():
        assert [round(x, 6) for x in r["c"]] == [round(x, 6) for x in M.positions(cases[r["i"]])]
