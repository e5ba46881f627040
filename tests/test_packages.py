"""Packages of files: names, commit and repeated runs."""

import pytest
from pyspark.sql import functions as F

from lexmill.config import Limits
from lexmill.plans import conversion
from lexmill.sources import sinks

SCHEMA = "path string, folder string, stem string, markdown string, meta_json string, quality_json string, assets array<struct<name:string,data:binary>>, tables array<struct<name:string,csv:string>>"


def docs(spark, rows):
    return spark.createDataFrame([(p, f, s, f"of {p}", "{}", "{}", [(n, bytearray(f"{p}:{n}".encode())) for n in a], [(n, f"{p}:{n}") for n in t]) for p, f, s, a, t in rows], SCHEMA)


def test_names_are_free(spark):
    stems = ["x", "x", "X", "x_1", "x_3", "x_3", "y", "x_0", "z_01", "z", "z"]
    rows = [(f"/in/{i:02}", "", s, [], []) for i, s in enumerate(stems)] + [("/in/other", "d", "x", [], []), (None, "", "y", [], [])]
    got = {r["path"]: r["out_name"] for r in sinks.package_names(docs(spark, rows)).collect()}
    assert [got[f"/in/{i:02}"] for i in range(11)] == ["x", "x_2", "X_4", "x_1", "x_3", "x_3_1", "y", "x_0", "z_01", "z", "z_1"]
    assert got["/in/other"] == "x" and got[None] == "y_1"


@pytest.mark.parametrize("mode", sinks.MODES)
def test_equal_stems_lose_nothing(spark, tmp_path, mode):
    rows = [("/in/a/x.docx", "", "x", ["image_001.png"], ["S.csv"]), ("/in/b/x.docx", "", "x", ["image_001.png"], ["S.csv", "T.csv"]), ("/in/a/x.txt", "", "x", [], []), ("/in/c/y.docx", "c", "y", ["IMAGE_001.png"], [])]
    df = docs(spark, rows).withColumn("markdown", F.concat("markdown", F.lit(" ![图片 1](assets/image_001.png)")))
    written = {r["path"]: r["bytes"] for r in sinks.write_packages(df, f"file://{tmp_path}", mode).collect()}
    files = {str(p.relative_to(tmp_path)): p for p in tmp_path.rglob("*") if p.is_file() and not str(p.relative_to(tmp_path)).startswith(".runs/")}
    assert set(files) == set(written) and all(p.stat().st_size == written[n] for n, p in files.items())
    texts = {n: p.read_text("utf-8-sig") for n, p in files.items() if n.endswith(".md")}
    assert sorted(t.split(" ![")[0] for t in texts.values()) == sorted(f"of {r[0]}" for r in rows)
    assert sorted(p.read_text() for n, p in files.items() if n.endswith(".png")) == sorted(f"{p}:{n}" for p, _, _, a, _ in rows for n in a)
    assert sum(n.endswith(".csv") for n in files) == 3
    if mode == "SingleMd":
        assert "](assets/x_2/image_001.png)" in texts["x_2.md"] and "](assets/image_001.png)" in texts["x.md"] and "assets/x_2/image_001.png" in files
    assert not (tmp_path / ".staging").exists() or not any((tmp_path / ".staging").iterdir())


def test_what_failed_attempts_wrote_goes(spark, tmp_path):
    files = sinks.package_files(docs(spark, [(f"/in/{i}", "", f"d{i}", [], []) for i in range(20)]).repartition(4))
    sinks.stage_files(files, str(tmp_path), "r").count()  # attempts whose rows were never committed
    left = [p for p in (tmp_path / ".staging/r").rglob("*") if p.is_file()]
    assert len(left) == 20
    written = sinks.write_packages(docs(spark, [(f"/in/{i}", "", f"d{i}", [], []) for i in range(20)]), str(tmp_path), run="r")
    assert written.count() == 20 and len(list(tmp_path.glob("*.md"))) == 20 and not (tmp_path / ".staging/r").exists()


def test_a_run_is_taken_up_and_not_done_twice(spark, tmp_path):
    df = docs(spark, [(f"/in/{i}", "", f"d{i}", [], []) for i in range(6)])
    sinks.stage_files(sinks.package_files(df), str(tmp_path), "r").write.parquet(str(tmp_path / ".runs/r/manifest"))
    sinks.place_files(spark.read.parquet(str(tmp_path / ".runs/r/manifest")).where("path < 'd3'"), str(tmp_path)).count()  # it broke off half-way
    assert len(list(tmp_path.glob("*.md"))) == 3
    assert sinks.write_packages(df, str(tmp_path), run="r").count() == 6
    stamps = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("*.md")}
    assert len(stamps) == 6
    other = docs(spark, [("/in/0", "", "other", [], [])])
    assert sinks.write_packages(other, str(tmp_path), run="r").count() == 6  # committed: nothing is written again
    assert {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("*.md")} == stamps


def test_a_repeated_path_is_one_document(spark, tmp_path):
    rows = spark.createDataFrame([("/in/a/x.txt", bytearray(b"two")), ("/in/a/x.txt", bytearray(b"one")), ("/in/a/x.txt", None), ("/in/b/x.txt", bytearray(b"three")), (None, bytearray(b"none")), (None, None)], "path string, content binary")
    state, written = conversion.run(rows, str(tmp_path), Limits(), at="2024-01-01T00:00:00+00:00")
    got = sorted((str(r["path"]), r["status"]) for r in state.collect())
    assert got == [("/in/a/x.txt", "Done"), ("/in/b/x.txt", "Done"), ("None", "Failed")]
    texts = {p.name: p.read_text("utf-8-sig") for p in tmp_path.glob("*.md")}
    assert set(texts) == {"x.md", "x_1.md"} == {r["path"] for r in written.collect()}
    assert sum("three" in t for t in texts.values()) == 1 and sum("one" in t for t in texts.values()) + sum("two" in t for t in texts.values()) == 1


def test_names_of_other_runs_are_not_free(spark, tmp_path):
    one = docs(spark, [("/in/1/x.txt", "f", "x", ["i.png"], [])])
    for k in range(3):
        sinks.write_packages(one.withColumn("markdown", F.lit(f"run {k} [i](assets/i.png)")), str(tmp_path), run=f"r{k}").count()
    got = {p.name: p.read_text("utf-8-sig") for p in (tmp_path / "f").glob("*.md")}
    assert got == {"x.md": "run 0 [i](assets/i.png)", "x_1.md": "run 1 [i](assets/x_1/i.png)", "x_2.md": "run 2 [i](assets/x_2/i.png)"}
    assert (tmp_path / "f/assets/x_2/i.png").exists()
    for k in range(2):
        sinks.write_packages(one, str(tmp_path / "h"), "HybridPackage", run=f"r{k}").count()
    assert {p.name for p in (tmp_path / "h/f").iterdir()} == {"x", "x_1"}


def text_files(spark, names):
    return spark.createDataFrame([(f"/in/{n}", bytearray(f"text of {n}".encode()) if not n.endswith(".zip") else bytearray(b"x")) for n in names], "path string, content binary")


def test_the_first_error_ends_the_waves(spark, tmp_path):
    names = [f"{i}.txt" for i in range(12)] + ["bad.zip"]
    state = conversion.run_in_waves(text_files(spark, names), str(tmp_path), "w", Limits(continue_on_error=False), files_at_once=3)
    got = {r["path"]: r["status"] for r in state.collect()}
    assert len(got) == 13 and got["/in/bad.zip"] == "Failed"
    done = sum(s == "Done" for s in got.values())
    assert len(list(tmp_path.glob("*.md"))) == done and done + sum(s == "Pending" for s in got.values()) == 12
    whole = conversion.run_in_waves(text_files(spark, names), str(tmp_path), "w", files_at_once=3)  # goes on
    assert sorted(r["status"] for r in whole.collect()) == ["Done"] * 12 + ["Failed"] and len(list(tmp_path.glob("*.md"))) == 12


def test_a_cancelled_run_leaves_the_rest_pending(spark, tmp_path):
    conversion.cancel(spark, str(tmp_path), "c")
    state = conversion.run_in_waves(text_files(spark, ["a.txt", "b.txt"]), str(tmp_path), "c")
    assert [r["status"] for r in state.collect()] == ["Pending", "Pending"] and not list(tmp_path.glob("*.md"))


def test_arrivals_are_written_once(spark, tmp_path):
    from lexmill.streaming.arrivals import package_stream

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    out.mkdir()
    (src / "x.txt").write_text("one")
    (src / "y.txt").write_text("two")
    run = lambda check: package_stream(spark, str(src), str(out), str(tmp_path / check), once=True).awaitTermination()
    run("c")
    stamps = {p.name: p.stat().st_mtime_ns for p in out.glob("*.md")}
    assert set(stamps) == {"x.md", "y.md"}
    (src / "sub").mkdir()
    (src / "sub/x.txt").write_text("three")
    run("c")
    assert {p.name for p in out.glob("*.md")} == {"x.md", "y.md", "x_1.md"} and "three" in (out / "x_1.md").read_text("utf-8-sig")
    last = max((tmp_path / "c/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # the batch was written, but the stream had not said so before it broke off
    run("c")
    assert {p.name for p in out.glob("*.md")} == {"x.md", "y.md", "x_1.md"} and all((out / n).stat().st_mtime_ns == t for n, t in stamps.items())
