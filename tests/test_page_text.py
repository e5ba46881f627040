"""Kinds, headings, tables and paragraphs of pages: plans against the sequential rules on random documents."""

import random

import page_model as M
import pytest

from lexmill.operators import page_text as P

SCHEMA = "doc_id long, page int, line_no int, text string, left double, top double, size double, bold boolean, kind string, merged boolean, cells array<struct<column:int,text:string>>"
TEXTS = ["plain words", "ends here.", "第一章 总则", "第三条 内容", "二、事项", "（三）项目", "（12）item", "3. point", "3.5 of it", "7、 item", "• dot", "中文一句", "中文完。", "goes on 第三条 again",
         "see 第二章", "第三条 第三条", "text 五、mark", "short", "long " * 9 + "text", "１２. wide", "12345678901. big"]


def random_document(rng):
    """(page, [(text, left, size, bold, kind, merged, cells)]) of a document with some pages missing."""
    pages, weights = [], [rng.random() for _ in TEXTS]
    for page in sorted(rng.sample(range(1, 7), rng.randint(1, 4))):
        lines = []
        for _ in range(rng.randint(1, 14)):
            size, bold, left = rng.choice([12.0, 12.0, 12.0, 13.0, 18.0, 0.0]), rng.random() < 0.15, rng.choice([50.0, 50.0, 50.4, 80.0, 49.5])
            roll = rng.random()
            if roll < 0.15:
                lines.append(("", 0.0, 0.0, False, "empty", False, None))
            elif roll < 0.3:
                for _ in range(rng.choice([1, 2, 3, 4])):
                    cells = [(c, rng.choice(["a", "b c", "", "12"])) for c in sorted(rng.choices(range(3), k=rng.randint(1, 4)))]
                    lines.append((" ".join(t for _, t in cells if t), left, size, bold, "table", False, cells))
            else:
                lines.append((rng.choices(TEXTS, weights)[0].strip(), left, size, bold, "body", rng.random() < 0.05, None))
        pages.append((page, lines))
    return pages


def model(pages):
    lines, began = [], 0
    for page, own in pages:
        lines += [M.Line("", 0.0, 0.0, 0.0, False, k, "empty", breaks=True) for k in range(began + 1, page + 1)]
        began = page
        lines += [M.Line(t, left, 0.0, size, bold, page, kind, merged=merged, cells=cells or []) for t, left, size, bold, kind, merged, cells in own]
    return M.document(lines)


def frame(spark, documents):
    rows = [(d, page, n, t, left, 0.0, size, bold, kind, merged, cells) for d, pages in documents.items() for page, own in pages for n, (t, left, size, bold, kind, merged, cells) in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plans(lines):
    """(kinds by document, Markdown by document) of the plans."""
    joined = P.with_headings_joined(P.settle(P.classified(P.with_page_marks(lines))))
    joined = P.settle(joined)
    kinds, texts = {}, {}
    for r in joined.orderBy("page", "line_no").collect():
        kinds.setdefault(r["doc_id"], []).append((r["text"], r["kind"], r["level"], r["number"], r["merged"], r["breaks"]))
    for r in sorted(P.pieces(joined).collect(), key=lambda r: (r["page"], r["line_no"])):
        texts.setdefault(r["doc_id"], []).append(r)
    return kinds, texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_are_the_sequential_ones(spark, seed):
    rng = random.Random(seed)
    documents = {d: random_document(rng) for d in range(80)}
    kinds, texts = plans(frame(spark, documents))
    for d, pages in documents.items():
        lines, text, degraded = model(pages)
        assert kinds[d] == [(x.text, x.kind, x.level, x.number, x.merged, x.breaks) for x in lines], d
        got = M.re.sub(r"\n{3,}", "\n\n", "".join(r["piece"] for r in texts[d])).strip() + "\n"
        assert got == text, d
        assert sum(r["degraded"] for r in texts[d]) == degraded


def test_size_before_is_that_of_a_merged_line_too(spark):
    lines = [("one", 50.0, 12.0, False, "body", False, None), ("big", 50.0, 18.0, False, "body", True, None), ("also big", 50.0, 18.0, False, "body", False, None)]
    kinds, _ = plans(frame(spark, {1: [(1, lines)]}))
    assert [k[1] for k in kinds[1]] == ["empty", "body", "heading", "body"]


def test_the_cases_of_the_rules(spark):
    body = lambda t, left=50.0: (t, left, 12.0, False, "body", False, None)
    blank = ("", 0.0, 0.0, False, "empty", False, None)
    one = [("第一章 Head", 50.0, 12.0, False, "body", False, None), blank, body("一 句"), body("goes on."), body("next"), blank, body("still"), blank, blank, body("apart"), body("（1）2. both"), body("• dot")]
    two = [body("over the page"), blank]
    three = [body("unmarked", 80.0)]
    _, texts = plans(frame(spark, {1: [(1, one), (2, two), (3, three)]}))
    got = "".join(r["piece"] for r in texts[1])
    want = "<!-- PAGE_START: 1 -->\n\n### 第一章 Head一 句goes on. next\nstill\n\napart\n\n1. both\n\n- dot\n\n<!-- PAGE_START: 2 -->\nover the page\n\nunmarked\n"
    assert M.re.sub(r"\n{3,}", "\n\n", got).strip() + "\n" == model([(1, one), (2, two), (3, three)])[1]
    assert M.re.sub(r"\n{3,}", "\n\n", got).strip() + "\n" == want


def test_tables_in_markdown(spark):
    row = lambda *cells: (" ".join(c for c in cells if c), 50.0, 12.0, False, "table", False, [(i, c) for i, c in enumerate(cells) if c])
    tables = {
        1: [row("a", "b", "c"), row("x", "", "y"), row("1", "2", "3"), row("4", "", "6")],
        2: [row("a", "b"), row("1", "2")],
        3: [row("a", "", ""), row("", "", "z")],
        4: [row("a"), row("b")],
    }
    lines = P.settle(P.classified(P.with_page_marks(frame(spark, {d: [(1, own)] for d, own in tables.items()}))))
    got = {r["doc_id"]: (r["table"], r["degraded"]) for r in P.rendered_tables(lines).collect()}
    assert got[1] == ("| ax | b | cy |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 |  | 6 |\n\n", False)
    assert got[2] == ("| a1 | b2 |\n| --- | --- |\n\n", False)  # half of two columns and one more are both
    assert got[3][1] and got[3][0].startswith("<!-- TABLE_DEGRADED: 空单元格超过40%，退化为纯文本 -->\na") and got[4][1]
    for d, own in tables.items():
        assert got[d] == M.render_table([M.Line(t, left, 0.0, size, bold, 1, kind, cells=cells) for t, left, size, bold, kind, _, cells in own])


def test_no_words(spark):
    words = spark.createDataFrame([], "doc_id long, page int, text string, left double, right double, top double, height double, font_size double, font_name string")
    assert P.page_lines(words).count() == 0 and P.page_markdown(words).count() == 0
