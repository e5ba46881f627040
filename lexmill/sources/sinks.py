"""Results out: tables by default, packages of files on request.

Packages are committed like tables.  Names are settled before anything is written, so no two documents share a file.  Each task
attempt writes into a folder of its own and says what it wrote; Spark commits what the successful attempts said, the manifest.
Only files of the manifest are moved to their places, by tasks that may run again; then the attempts' folders go.  A run that has
its manifest and its mark isn't written a second time.

Files go through Arrow's file systems: local folders that all executors share, HDFS (by libhdfs), S3 and others, named by URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("SingleMd", "HybridPackage")


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet under Spark's commit protocol."""
    df.write.mode(mode).parquet(path)


# ---- names ------------------------------------------------------------------------------------


def _folder(df: DataFrame) -> Column:
    return F.lower(F.coalesce("folder", F.lit(""))) if "folder" in df.columns else F.lit("")


def package_names(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``out_name``: the stem, or the stem and the first free number where others of its folder have it, whatever the case.

    The first by path, else by its text's digest, keeps the stem; a number that makes another document's stem is not free, nor is a name in ``held`` (folder, stem).
    """
    by = F.col("path") if "path" in docs.columns else F.lit(None).cast("string")
    keyed = docs.withColumns({"_folder": _folder(docs), "_low": F.lower("stem"), "_held": F.lit(False), "_by": F.struct(by.isNull(), by, F.md5(F.col("markdown").cast("binary")))})
    if held is not None:
        keyed = keyed.unionByName(held.select(F.lower("folder").alias("_folder"), F.lower("stem").alias("_low"), F.lit(True).alias("_held")).distinct(), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy("_folder", "_low").orderBy(F.col("_held").desc(), "_by")) - 1
    ends = keyed.select("_folder", "_low").distinct().where(F.col("_low").rlike(r"_[1-9][0-9]{0,8}\z"))
    taken = ends.select("_folder", F.regexp_extract("_low", r"^(?s:(.*))_[0-9]+\z", 1).alias("_low"), F.regexp_extract("_low", r"_([0-9]+)\z", 1).cast("int").alias("k"))
    taken = taken.groupBy("_folder", "_low").agg(F.sort_array(F.collect_set("k")).alias("_taken"))
    keyed = keyed.withColumn("_nth", nth).join(taken, ["_folder", "_low"], "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_nth"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    named = F.when(F.col("_nth") == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", free.cast("string")))
    return keyed.withColumn("out_name", named).where("not _held").drop("_folder", "_low", "_nth", "_taken", "_held", "_by")


def _shared(docs: DataFrame, column: str, written: DataFrame | None) -> DataFrame:
    """(_folder, out_name, _apart_<column>): documents of which a file would have the name of another's in the folder."""
    names = docs.select(_folder(docs).alias("_folder"), "out_name", F.lit(False).alias("held"), F.explode(column).alias("x")).withColumn("low", F.lower("x.name")).drop("x")
    if written is not None:
        at = F.regexp_extract(F.lower("path"), rf"^(?s:(.*?))/?{column}/([^/]+)\z", 1)
        low = F.regexp_extract(F.lower("path"), rf"^(?s:.*?)/?{column}/([^/]+)\z", 1)
        names = names.union(written.where(F.lower("path").rlike(rf"(?s)^(.*/)?{column}/[^/]+\z")).select(at, F.lit(""), F.lit(True), low))
    nth = F.row_number().over(Window.partitionBy("_folder", "low").orderBy(F.col("held").desc(), "out_name"))
    return names.withColumn("nth", nth).where("nth > 1 and not held").select("_folder", "out_name", F.lit(True).alias(f"_apart_{column}")).distinct()


def package_files(docs: DataFrame, mode: str = "SingleMd", written: DataFrame | None = None) -> DataFrame:
    """(path, data) of every file of the packages; no path comes twice.

    ``written``: paths of files that stand there already, whose names are not free.  ``docs``: path (of the source, if known), stem, markdown, meta_json, quality_json, assets (array of name, data), tables (array of name, csv), and
    perhaps folder, in which the package lies.  In single files' mode the documents of a folder share ``assets`` and ``tables``; one
    whose files there would have the names of another's has a folder of its own in them, and its links lead there.
    """
    if mode not in MODES:
        raise ValueError(mode)
    single = mode == "SingleMd"
    last = r"\.md" if single else "/document\\.md"
    held = None if written is None else written.where(F.col("path").rlike(rf"(?s){last}\z") & ~F.col("path").rlike("(^|/)(assets|tables)/")).select(
        F.regexp_extract("path", rf"^(?s:(.*?))/?[^/]+{last}\z", 1).alias("folder"), F.regexp_extract("path", rf"([^/]+){last}\z", 1).alias("stem")
    )
    named = package_names(docs, held)
    own: dict[str, Column] = {c: F.lit("") for c in ("assets", "tables")}
    if single:
        named = named.withColumn("_folder", _folder(docs))
        for c in own:
            named = named.join(_shared(named, c, written), ["_folder", "out_name"], "left")
            own[c] = F.when(F.col(f"_apart_{c}"), F.concat("out_name", F.lit("/"))).otherwise(F.lit(""))
    folder = F.when(F.coalesce("folder", F.lit("")) != "", F.concat("folder", F.lit("/"))).otherwise(F.lit("")) if "folder" in docs.columns else F.lit("")
    base = folder if single else F.concat(folder, "out_name", F.lit("/"))
    one = lambda name, data: F.struct(F.concat(base, name).alias("path"), data.alias("data"))
    text = F.col("markdown")
    for c, at in own.items() if single else ():
        text = F.when(at != "", F.replace(text, F.lit(f"]({c}/"), F.concat(F.lit(f"]({c}/"), at))).otherwise(text)
    bom = F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))
    files = [one(F.concat("out_name", F.lit(".md")), bom)] if single else [
        one(F.lit("document.md"), bom),
        one(F.lit(".meta.json"), F.col("meta_json").cast("binary")),
        one(F.lit(".quality_report.json"), F.col("quality_json").cast("binary")),
    ]
    none = lambda c: F.coalesce(c, F.array().cast(dict(docs.dtypes)[c]))
    assets = F.transform(none("assets"), lambda a: F.struct(F.concat(base, F.lit("assets/"), own["assets"], a["name"]).alias("path"), a["data"].alias("data")))
    tables = F.transform(none("tables"), lambda t: F.struct(F.concat(base, F.lit("tables/"), own["tables"], t["name"]).alias("path"), t["csv"].cast("binary").alias("data")))
    return named.select(F.explode(F.concat(F.array(*files), assets, tables)).alias("f")).select("f.path", "f.data")


# ---- files ------------------------------------------------------------------------------------


def file_system(uri: str):
    """Arrow's file system of a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def stage_files(files: DataFrame, folder: str, run: str) -> DataFrame:
    """(path, staged, bytes) of ``files`` (path, data), each written in the folder of the attempt that wrote it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        task = TaskContext.get()
        own = f".staging/{run}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{own}", recursive=True)
        at = 0
        for pdf in batches:
            staged = [f"{own}/{k}" for k in range(at, at + len(pdf))]
            at += len(pdf)
            for name, data in zip(staged, pdf["data"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(data or b""))
            yield pd.DataFrame({"path": pdf["path"], "staged": staged, "bytes": [len(d or b"") for d in pdf["data"]]})

    return files.mapInPandas(work, "path string, staged string, bytes bigint")


def place_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, bytes): the staged files of a manifest moved to their places; a move that was done before is passed over."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        made: set[str] = set()
        for pdf in batches:
            for path, staged in zip(pdf["path"], pdf["staged"], strict=True):
                target = f"{root}/{path}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                if store.get_file_info(f"{root}/{staged}").is_file:
                    store.move(f"{root}/{staged}", target)
                elif not store.get_file_info(target).is_file:
                    raise FileNotFoundError(target)
            yield pdf[["path", "bytes"]]

    return manifest.mapInPandas(work, "path string, bytes bigint")


def _others(docs: DataFrame, folder: str, run: str) -> DataFrame | None:
    """(path) of what other runs have written under ``folder``."""
    store, root = file_system(folder)
    if store.get_file_info(f"{root}/.runs").type.name != "Directory":
        return None
    from pyarrow import fs

    found = [i.base_name for i in store.get_file_info(fs.FileSelector(f"{root}/.runs")) if i.base_name != run]
    held = [f"{folder.rstrip('/')}/.runs/{r}/manifest" for r in found if store.get_file_info(f"{root}/.runs/{r}/manifest/_SUCCESS").is_file]
    return docs.sparkSession.read.schema("path string").parquet(*held) if held else None


def write_packages(docs: DataFrame, folder: str, mode: str = "SingleMd", run: str | None = None) -> DataFrame:
    """Write the packages under ``folder`` and return (path, bytes) of their files, read from the manifest.

    Names that other runs have used are not free.  ``run`` names the run: one that was committed under this name before is only read.  A run that broke off before its mark is taken
    up again: from its manifest, if that stands, else from the start.
    """
    run = run or uuid.uuid4().hex
    held = f"{folder.rstrip('/')}/.runs/{run}"
    store, root = file_system(folder)
    at = f"{root}/.runs/{run}"
    store.create_dir(at, recursive=True)
    is_file = lambda p: store.get_file_info(p).is_file
    if not is_file(f"{at}/done"):
        if not is_file(f"{at}/manifest/_SUCCESS"):
            stage_files(package_files(docs, mode, _others(docs, folder, run)), folder, run).write.mode("overwrite").parquet(f"{held}/manifest")
        place_files(docs.sparkSession.read.parquet(f"{held}/manifest"), folder).write.mode("overwrite").format("noop").save()
        if store.get_file_info(f"{root}/.staging/{run}").type.name == "Directory":
            store.delete_dir(f"{root}/.staging/{run}")
        with store.open_output_stream(f"{at}/done") as out:
            out.write(b"")
    return docs.sparkSession.read.parquet(f"{held}/manifest").select("path", "bytes")
