"""Settings files of any version as rows: read by schema, brought forward step by step, put in range.

Version 0 is the flat file of old; version 1 has sections, but doesn't say whether the introduction was seen; version 2 says it.
A file is of one version, and goes through the steps from there on.  A file that can't be read, or has a value of another type, gives the
defaults and ``corrupted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLD = "OutputDirectory string, IncludeSubfolders boolean, OpenOutputFolder boolean, PreserveStructure boolean"
SECTIONS = {
    "General": "DefaultOutputDir string, KeepOriginalFileName boolean, OverwriteExistingFile boolean, AutoOpenOutputDir boolean, Language string, HasCompletedOnboarding boolean",
    "Conversion": "RecursiveScan boolean, IgnoreHiddenFiles boolean, MaxConcurrentTasks int, ContinueOnError boolean, PreserveFolderStructure boolean, OutputPackageMode string, MaxScanFileCount int",
}
#: What a setting is where a file says nothing.
DEFAULTS = {
    "General": {"DefaultOutputDir": "", "KeepOriginalFileName": True, "OverwriteExistingFile": False, "AutoOpenOutputDir": False, "Language": "zh-CN", "HasCompletedOnboarding": False},
    "Conversion": {"RecursiveScan": True, "IgnoreHiddenFiles": True, "MaxConcurrentTasks": 2, "ContinueOnError": True, "PreserveFolderStructure": True, "OutputPackageMode": "SingleMd", "MaxScanFileCount": 5000},
}
#: Where the old file's settings stand now.
MOVED = {
    "OutputDirectory": ("General", "DefaultOutputDir"),
    "OpenOutputFolder": ("General", "AutoOpenOutputDir"),
    "IncludeSubfolders": ("Conversion", "RecursiveScan"),
    "PreserveStructure": ("Conversion", "PreserveFolderStructure"),
}
MODES = ("SingleMd", "HybridPackage")


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def moved(held: dict[str, Column]) -> dict[str, Column]:
    """Version 0 to 1: settings of the flat file in their sections."""
    old = F.col("version") == 0
    return held | {f"{s}.{n}": F.when(old, F.col("old")[name]).otherwise(held[f"{s}.{n}"]) for name, (s, n) in MOVED.items()}


def introduced(held: dict[str, Column]) -> dict[str, Column]:
    """Version 1 to 2: who has settings but no word on the introduction isn't new."""
    seen = "General.HasCompletedOnboarding"
    return held | {seen: F.when(F.col("version") == 1, F.lit(True)).otherwise(held[seen])}


def in_range(held: dict[str, Column]) -> dict[str, Column]:
    """Defaults for what is missing, and for what is out of range its nearest sense."""
    out = {k: F.coalesce(c, F.lit(DEFAULTS[k.split(".")[0]][k.split(".")[1]])) for k, c in held.items()}
    tasks, scans, mode = "Conversion.MaxConcurrentTasks", "Conversion.MaxScanFileCount", "Conversion.OutputPackageMode"
    return out | {tasks: F.greatest(out[tasks], F.lit(1)), scans: F.when(out[scans] < 1, 5000).otherwise(out[scans]), mode: F.when(out[mode].isin(*MODES), out[mode]).otherwise(F.lit(MODES[0]))}


STEPS = (moved, introduced, in_range)


def migrated(files: DataFrame) -> DataFrame:
    """``files`` (path, content as text): path, version, corrupted, and every setting of ``SECTIONS`` under its name."""
    text = F.col("content")
    schema = ", ".join(f"{s} struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>" for s, fields in SECTIONS.items())
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    read = files.withColumns({"old": F.from_json(text, OLD), "now": F.from_json(text, schema), "keys": keys, "good": F.json_object_keys(text).isNotNull()})
    flat = F.arrays_overlap("keys", F.array(*[F.lit(k) for k in _names(OLD)])) & ~F.arrays_overlap("keys", F.array(*[F.lit(s) for s in (*SECTIONS, "Appearance", "Templates", "Preview", "Recent")]))
    said = F.get_json_object(text, "$.General.HasCompletedOnboarding").isNotNull()
    version = F.when(~F.col("good"), F.lit(2)).when(flat, 0).when(said, 2).otherwise(1)
    places = {f"$.{s}.{n}": F.col("now")[s][n] for s, fields in SECTIONS.items() for n in _names(fields)} | {f"$.{n}": F.col("old")[n] for n in _names(OLD)}
    odd = F.greatest(*[(F.get_json_object(text, p).isNotNull() & c.isNull()).cast("int") for p, c in places.items()]) == 1
    read = read.withColumn("corrupted", ~F.col("good") | odd).withColumn("version", F.when(F.col("corrupted"), 2).otherwise(version))
    held = {f"{s}.{n}": F.when(~F.col("corrupted"), F.col("now")[s][n]) for s, fields in SECTIONS.items() for n in _names(fields)}
    for step in STEPS:
        held = step(held)
    return read.select("path", "version", "corrupted", *[c.alias(k.split(".")[1]) for k, c in held.items()])
