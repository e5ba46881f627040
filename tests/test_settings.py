"""Profiles and settings: round trips, old files, broken ones."""

import json

from lexmill import config as C
from lexmill.operators import settings


def test_profiles_round_trip():
    made = C.applied({k: f"font {i}" if k.endswith("Font") else 1.5 + i for i, k in enumerate(C.PROFILE_FIELDS)}, C.OFFICIAL)
    fields = C.extracted(made)
    assert len(fields) == 18 and len(set(fields.values())) == 18
    name, held = C.load_profile(C.profile_json(made, "mine"))
    assert name == "mine" and held == fields and C.applied(held, C.OFFICIAL) == made
    assert json.loads(C.profile_json(made))["options"]["pageMarginTopCm"] == made.margin_top
    for preset in C.PRESETS.values():  # what a profile has no field for stays
        back = C.applied(C.extracted(preset), C.OFFICIAL)
        assert C.extracted(back) == C.extracted(preset) and back.page_number_size == C.OFFICIAL.page_number_size


def test_profiles_that_cant_be_read():
    assert C.load_profile(None) is C.load_profile("") is C.load_profile("[1]") is C.load_profile('{"options": {"titleFontSizePt": "x"}}') is None
    assert C.load_profile('{"name": " ", "other": 1}') == (C.CUSTOM, {}) and C.load_profile('{"name": "n", "options": {"bodyFont": "f", "titleFont": null, "more": 1}}') == ("n", {"bodyFont": "f"})


def test_settings_of_all_versions(spark):
    files = {
        "old": '{"OutputDirectory": "/o", "OpenOutputFolder": true, "PreserveStructure": false}',
        "one": '{"General": {"DefaultOutputDir": "d"}, "Conversion": {"MaxConcurrentTasks": 0, "MaxScanFileCount": 0, "OutputPackageMode": "Odd"}}',
        "two": '{"General": {"HasCompletedOnboarding": false, "Language": null}, "Conversion": {"MaxConcurrentTasks": 9, "OutputPackageMode": "HybridPackage"}, "Recent": {}}',
        "empty": "{}", "none": None, "blank": "", "broken": '{"General": ', "array": "[]", "typed": '{"Conversion": {"ContinueOnError": "maybe"}}',
    }
    got = {r["path"]: r for r in settings.migrated(spark.createDataFrame(list(files.items()), "path string, content string")).collect()}
    assert len(got) == len(files)
    old, one, two = got["old"], got["one"], got["two"]
    assert (old["version"], old["DefaultOutputDir"], old["AutoOpenOutputDir"], old["RecursiveScan"], old["PreserveFolderStructure"], old["HasCompletedOnboarding"]) == (0, "/o", True, True, False, False)
    assert (one["version"], one["DefaultOutputDir"], one["MaxConcurrentTasks"], one["MaxScanFileCount"], one["OutputPackageMode"], one["HasCompletedOnboarding"]) == (1, "d", 1, 5000, "SingleMd", True)
    assert (two["version"], two["Language"], two["MaxConcurrentTasks"], two["OutputPackageMode"], two["HasCompletedOnboarding"]) == (2, "zh-CN", 9, "HybridPackage", False)
    assert got["empty"]["version"] == 1 and not got["empty"]["corrupted"]
    for name in ("none", "blank", "broken", "array", "typed"):
        r = got[name]
        assert r["corrupted"] and {n: r[n] for s in settings.DEFAULTS.values() for n in s} == {n: v for s in settings.DEFAULTS.values() for n, v in s.items()}, name
