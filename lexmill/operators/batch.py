"""Batches of files: output names and folders, status, history, security predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import Limits
from lexmill.functions.text import extension, sanitised_file_name


def common_root(folders: DataFrame, folder: str = "folder") -> DataFrame:
    """(root): the longest common run of path segments, whatever their case, spelt as in the smallest folder.

    Segments are compared by their place: one row per folder and place, pre-aggregated.
    """
    each = folders.select(F.posexplode(F.split(F.regexp_replace(F.col(folder), r"\\", "/"), "/")).alias("at", "part"))
    n = folders.select(F.count("*").alias("n"))
    by = each.groupBy("at").agg(F.count("*").alias("here"), F.countDistinct(F.lower("part")).alias("kinds"), F.min("part").alias("part")).crossJoin(n)  # one row more
    good = by.withColumn("ok", (F.col("here") == F.col("n")) & (F.col("kinds") == 1))
    first_bad = good.agg(F.min(F.when(~F.col("ok"), F.col("at"))).alias("stop"))
    kept = good.crossJoin(first_bad).where("ok and at < coalesce(stop, 1 << 30)")
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "/").alias("root"))


def output_folder(folder: Column, root: Column, out: Column) -> Column:
    """The folder's place under the root, kept under ``out``; ``out`` itself for folders elsewhere."""
    inside = F.startswith(F.lower(folder), F.lower(root))
    rest = F.regexp_replace(F.substring(folder, F.length(root) + 1, F.lit(1 << 20)), "^/+", "")
    return F.when(inside & (rest != ""), F.concat_ws("/", out, rest)).otherwise(out)


def suffixed_names(files: DataFrame, name: str = "name", order: str = "file_id") -> DataFrame:
    """``files`` with out_name: the second of a name gets _1 and so on."""
    n = F.row_number().over(Window.partitionBy(F.lower(F.col(name))).orderBy(order)) - 1
    return files.withColumn("out_name", F.when(n > 0, F.concat_ws("_", F.col(name), n.cast("string"))).otherwise(F.col(name)))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n"))


def history(runs: DataFrame, at: str = "ts", most: int = 20) -> DataFrame:
    """The latest runs."""
    return runs.orderBy(F.desc(at), *[c for c in runs.columns if c != at]).limit(most)


def recent(paths: DataFrame, path: str = "path", at: str = "ts", most: int = 10) -> DataFrame:
    """The latest distinct paths, each at its last time."""
    return paths.groupBy(path).agg(F.max(at).alias(at)).orderBy(F.desc(at), path).limit(most)


def isolated(source: Column, out: Column) -> Column:
    """Neither path lies inside the other, whatever the case."""
    end = lambda p: F.lower(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/")))
    return ~F.startswith(F.lower(out), end(source)) & ~F.startswith(F.lower(source), end(out))


def allowed(files: DataFrame, limits: Limits, path: str = "path", size: str = "length", out: str | None = None) -> DataFrame:
    """``files`` with in_allowed_directory, type_allowed, size_allowed, isolated, safe_name and allowed."""
    p = F.lower(F.col(path))
    folder = F.lit(True)
    if limits.allowed_directories:
        folder = F.greatest(*[F.startswith(p, F.lit(d.rstrip("/").lower() + "/")) for d in limits.allowed_directories], F.lit(False))
    kind = extension(F.col(path)).isin(*[t.lower() for t in limits.allowed_types]) if limits.allowed_types else F.lit(True)
    fits = F.coalesce(F.col(size) <= limits.max_bytes, F.lit(False)) if limits.max_bytes > 0 else F.lit(True)
    apart = isolated(F.col(path), F.col(out)) if out and limits.isolate_output else F.lit(True)
    df = files.withColumn("in_allowed_directory", folder).withColumn("type_allowed", kind).withColumn("size_allowed", fits).withColumn("isolated", apart)
    df = df.withColumn("safe_name", sanitised_file_name(F.col(path)))
    return df.withColumn("allowed", F.col("in_allowed_directory") & F.col("type_allowed") & F.col("size_allowed") & F.col("isolated"))


def log_lines(events: DataFrame, at: str = "ts", level: str = "level", message: str = "message") -> DataFrame:
    """(day, line): one log line per event."""
    line = F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.upper(F.col(level)), F.lit("] "), F.col(message))
    return events.select(F.date_format(at, "yyyyMMdd").alias("day"), line.alias("line"))
