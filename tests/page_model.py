"""The rules of pages, one page and one line at a time: what the plans of ``page_tables`` and ``page_text`` are held against."""

import re
from collections import Counter
from dataclasses import dataclass, field
from statistics import fmean

HAN = "一二三四五六七八九十"

WIDE = re.compile("[一-鿿㐀-䶿＀-￯　-〿぀-ゟ゠-ヿ]")
END_MARKS = "。！？.?!」』】…；;"


def upper_median(values):
    return sorted(values)[len(values) // 2]


def rows_by_anchor(words, limit):
    rows = []
    for w in sorted(words, key=lambda w: (-w["top"], w["left"], w["right"], w["text"])):
        if rows and abs(rows[-1][0]["top"] - w["top"]) <= limit:
            rows[-1].append(w)
        else:
            rows.append([w])
    return [sorted(r, key=lambda w: (w["left"], w["right"], w["text"])) for r in rows]


def joined(row):
    out = row[0]["text"]
    for a, b in zip(row, row[1:]):
        wide = WIDE.search(a["text"]) and WIDE.search(b["text"])
        mean = (a["right"] - a["left"]) / len(a["text"])
        near = mean > 0 and (b["left"] - a["right"]) / mean <= 0.5
        out += b["text"] if wide or near else " " + b["text"]
    return out


def clusters(row):
    if len(row) < 2:
        return []
    limit = max(15.0, 3 * fmean((w["right"] - w["left"]) / len(w["text"]) for w in row))
    out = [row[0]["left"]]
    for a, b in zip(row, row[1:]):
        if b["left"] - a["right"] > limit:
            out.append(b["left"])
    return out


def positions(lefts, tolerance=20.0):
    groups = []
    for x in sorted(lefts):
        if groups and abs(x - fmean(groups[-1])) <= tolerance:
            groups[-1].append(x)
        else:
            groups.append([x])
    return sorted(fmean(g) for g in groups)


def cells_of(row, columns):
    splits = [(a + b) / 2 for a, b in zip(columns, columns[1:])]
    out = []
    for w in row:
        column = sum((w["left"] + w["right"]) / 2 > s for s in splits)
        if out and out[-1][0] == column:
            out[-1] = (column, out[-1][1] + w["text"])
        else:
            out.append((column, w["text"]))
    return [(c, t.strip()) for c, t in out]


def page(words, paths=0):
    """Of a page's words: (lines, loose rows, regions); a line is a dict of text, kind, merged and cells."""
    words = [w for w in words if w["text"] and w["text"].strip()]
    if not words:
        return [], [], []
    median = upper_median([w["size"] for w in words])
    lines = []
    for row in rows_by_anchor(words, max(3.0, 0.6 * median)):
        text = re.sub(r"\s+", " ", joined(row)).strip()
        text = "" if re.fullmatch(r"[\s\d—–-]+", text) else text  # of the furniture of pages the model knows numbers alone
        lines.append({"text": text, "top": fmean(w["top"] for w in row), "kind": "body" if text else "empty", "merged": False, "cells": None})
    loose = rows_by_anchor(words, max(median, 10.0))
    ys = [fmean(w["top"] for w in r) for r in loose]
    regions = []
    for row, y in zip(loose, ys):
        if len(clusters(row)) > 1:
            if regions and regions[-1][-1][0] - y <= 1.5 * median * (4.0 if paths > 5 else 2.5):
                regions[-1].append((y, clusters(row)))
            else:
                regions.append([(y, clusters(row))])
    found = []
    for region in regions:
        columns = positions([x for _, lefts in region for x in lefts])
        if len(region) < 3 or len(columns) < 2:
            continue
        found.append(columns)
        high, low = max(y for y, _ in region) + median, min(y for y, _ in region) - median
        rows = [(y, cells_of(r, columns)) for y, r in zip(ys, loose) if low <= y <= high]
        if len(rows) < 2 or sum(sum(bool(t) for _, t in c) >= 2 for _, c in rows) / len(rows) < 0.4:
            continue
        used = set()
        for y, cells in rows:
            hits = [i for i, x in enumerate(lines) if i not in used and not x["merged"] and x["kind"] != "empty" and y - 0.6 * median <= x["top"] <= y + 0.6 * median]
            used.update(hits)
            for n, i in enumerate(hits):
                if n:
                    lines[i]["merged"] = True
                else:
                    lines[i] |= {"kind": "table", "cells": cells, "text": " ".join(t for _, t in cells if t)}
        for i, x in enumerate(lines):
            if low <= x["top"] <= high and i not in used and not x["merged"] and x["kind"] == "body" and len(x["text"]) < 60 and x["text"][-1:] not in END_MARKS:
                x |= {"kind": "table", "cells": [(0, x["text"])]}
    return lines, loose, found


# ---- lines to Markdown ------------------------------------------------------------------------


@dataclass
class Line:
    text: str
    left: float
    top: float
    size: float
    bold: bool
    page: int
    kind: str = "body"
    level: int = 0
    number: int = -1
    merged: bool = False
    breaks: bool = False
    cells: list[tuple[int, str]] = field(default_factory=list)


def han_number(text: str) -> int:
    digit = {c: i for i, c in enumerate("零一二三四五六七八九")}
    if "十" in text:
        tens, _, units = text.partition("十")
        return digit.get(tens, 1) * 10 + digit.get(units, 0)
    return int("".join(str(digit[c]) for c in text if c in digit) or 0) or 1


def decimal_number(digits: str) -> int:
    """A list number; 1 where it is no 32-bit number in ASCII digits."""
    found = int(digits) if digits.isascii() and len(digits) <= 10 else 1
    return found if found < 1 << 31 else 1


#: (pattern, kind, level): the first that matches a line's beginning decides.
_RULES = (
    (re.compile(rf"第[{HAN}百千零\d]+[章节]"), "heading", 3),
    (re.compile(rf"第[{HAN}百千零\d]+条"), "heading", 4),
    (re.compile(rf"[{HAN}]+、"), "heading", 4),
    (re.compile(rf"（([{HAN}零]+)）"), "ordered", 0),
    (re.compile(r"（(\d+)）"), "ordered", 0),
    (re.compile(r"(\d+)[.．、](?!(?<=[.．])\d)"), "ordered", 0),
    (re.compile(r"[•●○◆▪]"), "bullet", 0),
)


def classify(line: Line, size_before: float | None) -> None:
    text = line.text.strip()
    if not text:
        line.kind = "empty"
        return
    for pattern, kind, level in _RULES:
        if m := pattern.match(text):
            line.kind, line.level = kind, level
            if kind == "ordered":
                line.number = decimal_number(m[1]) if m[1].isdecimal() else han_number(m[1])
            return
    larger = size_before is not None and len(text) < 30 and line.size > size_before * 1.3
    if (line.bold and len(text) <= 30) or larger:
        line.kind, line.level = "heading", 4


_PREFIX = re.compile(rf"第[{HAN}百千零\d]+[章节条]|[{HAN}]+、")
_SECTION = re.compile(rf"第[{HAN}百千零\d]+[章节条]")
_STARTS = re.compile(rf"第[{HAN}百千零\d]+|[{HAN}]+、|（[{HAN}零\d]+）|\d+[.．、]\s")


def _new_mark(text: str, prefix: str) -> bool:
    return any(m != prefix for m in _SECTION.findall(text)) or bool(re.search(rf"[{HAN}]+、", text))


def absorb_headings(lines: list[Line]) -> None:
    """A heading takes the lines that go on with it; blanks are passed only before the first."""
    for at, head in enumerate(lines):
        if head.kind != "heading" or head.merged:
            continue
        m = _PREFIX.match(head.text)
        prefix, taken = m[0] if m else "", False
        for line in lines[at + 1 :]:
            if line.kind == "empty" and not taken:
                continue
            same_level = line.kind == "heading" and not _PREFIX.match(line.text) and line.level == head.level
            off = abs(head.size - line.size) / head.size if head.size > 0 and line.size > 0 else 0
            goes_on = line.kind == "body" and line.text and not _STARTS.match(line.text.lstrip()) and off <= 0.15
            if not (same_level or goes_on) or _new_mark(line.text, prefix):
                break
            wide = WIDE.match(head.text[-1:]) or WIDE.match(line.text[:1])
            head.text += line.text if wide else " " + line.text
            line.merged = taken = True


def render_table(rows: list[Line]) -> tuple[str, bool]:
    """(Markdown, degraded): too few columns or over 40 % empty cells give plain text."""
    width = 1 + max((c for r in rows for c, _ in r.cells), default=0)
    grid = []
    for r in rows:
        out = [""] * width
        for c, t in r.cells:
            out[c] = f"{out[c]} {t}" if out[c] else t
        grid.append([t.strip() for t in out])
    empty = sum(not x for r in grid for x in r)
    if width < 2 or empty > 0.4 * width * len(grid):
        why = "表格列数不足2列" if width < 2 else "空单元格超过40%"
        return "\n".join([f"<!-- TABLE_DEGRADED: {why}，退化为纯文本 -->", *[r.text for r in rows if r.text.strip()], ""]) + "\n", True
    head, body = grid[0], grid[1:]
    while body and 0 < sum(map(bool, body[0])) <= width // 2 + 1:  # a sparse row goes on with the header
        head = [a + b for a, b in zip(head, body.pop(0), strict=True)]
    row = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([row(head), row(["---"] * width), *map(row, body), ""]) + "\n", False


_MARKS = {"ordered": [re.compile(p) for p in (rf"^（[{HAN}零\d]+）\s*", r"^\d+[.．、]\s*")], "bullet": [re.compile(r"^[•●○◆▪]\s*")]}


class Pages:
    """What the lines of a document have given so far: finished text, and the paragraph that may go on."""

    def __init__(self, base: float):
        self.base, self.out, self.held, self.page, self.degraded = base, "", "", 0, 0

    def flush(self) -> None:
        self.out += f"{self.held}\n\n" if self.held else ""
        self.held = ""

    def begin_page(self) -> None:
        self.page += 1
        if self.page > 1:
            self.flush()
            self.out += "\n"
        self.out += f"<!-- PAGE_START: {self.page} -->\n"

    def block(self, text: str) -> None:
        """Something of its own: after a blank line, unless it is the first."""
        fresh = not self.out and not self.held
        self.flush()
        self.out += text if fresh else "\n" + text

    def body(self, line: Line) -> None:
        if self.held and (self.held.rstrip()[-1:] in END_MARKS or line.left > self.base + 10):
            self.flush()
        wide = WIDE.match(self.held.rstrip()[-1:]) and WIDE.match(line.text.lstrip()[:1])
        self.held = line.text if not self.held else self.held + line.text if wide else f"{self.held} {line.text}"


def to_markdown(lines: list[Line]) -> tuple[str, int]:
    """(Markdown, degraded tables) of a document's lines, page breaks among them.

    Two empty lines or a page's mark end a paragraph.  A run of empty lines that begins before a page break
    takes the break with it, so that page has no mark.
    """
    margins = Counter(round(x.left) for x in lines if not x.merged and x.kind == "body" and x.text.strip())
    made = Pages(max(margins, key=margins.get) if margins else 0)  # the first seen of equally frequent ones
    at = 0
    while at < len(lines):
        line, at = lines[at], at + 1
        if line.merged:
            continue
        if line.kind == "empty":
            if line.breaks:
                made.begin_page()
                continue
            blank = 1
            while at < len(lines) and (lines[at].merged or lines[at].kind == "empty"):
                blank += not lines[at].merged
                at += 1
            if blank > 1:
                made.flush()
        elif line.kind == "body":
            made.body(line)
        elif line.kind == "table":
            end = at
            while end < len(lines) and lines[end].kind == "table":
                end += 1
            text, bad = render_table(lines[at - 1 : end])
            made.block(text)
            made.degraded += bad
            at = end
        elif line.kind == "heading":
            made.block(f"{'#' * line.level} {line.text}\n")
        else:
            text = line.text
            for mark in _MARKS[line.kind]:
                text = mark.sub("", text)
            made.block(f"{line.number}. {text}\n" if line.kind == "ordered" else f"- {text}\n")
    made.flush()
    return re.sub(r"\n{3,}", "\n\n", made.out).strip() + "\n", made.degraded


def document(lines):
    """Classify, join headings and write: (lines, Markdown, degraded tables) of a document's lines with their page marks."""
    before = None
    for x in lines:
        if x.kind not in ("empty", "table"):
            classify(x, before)
            before = x.size
    absorb_headings(lines)
    return lines, *to_markdown(lines)
