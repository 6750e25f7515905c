"""Reports of runs on files with odd contents, and the volumes that they tell."""

import json

from pyspark.sql import functions as F

from corvane.sources import reports


def put(top, folder, **files):
    (top / folder).mkdir(parents=True, exist_ok=True)
    for kind, value in files.items():
        (top / folder / reports.KINDS[kind]).write_text(value if isinstance(value, str) else json.dumps(value))


def test_later_folders_win_for_each_kind(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    put(one, "a", manifest={"rom": "set_a", "n": 1}, boot={"n": 2})
    put(one, "b", manifest={"n": 3}, boot={"rom": "not_this", "n": 4})
    put(one, "c", boot={"rom": "set_c", "n": 5})
    put(one, "d", manifest="{broken", boot={"rom": "set_d", "n": 6})
    put(one, "e", manifest="no json")
    put(one, "x1", manifest={"rom": "same", "n": 7})
    put(one, "x2", manifest={"rom": "same", "n": 8})
    put(two, "a_again", boot={"rom": "set_a", "n": 9})
    put(two, "c", manifest={"rom": "set_c", "n": 10}, boot="]")
    (two / "loose").mkdir()
    (two / "loose" / "other.json").write_text("{}")
    (two / "manifest.json").write_text('{"rom": "too high"}')
    found = reports.runs(reports.report_files(spark, [str(one), str(two)])).collect()
    n = lambda v: json.loads(v)["n"] if v is not None else None
    got = {r["set"]: (n(r["manifest"]), n(r["boot"]), r["bad"]) for r in found}
    assert got == {
        "set_a": (1, 9, []), "b": (3, 4, []), "set_c": (10, 5, ["1/c/boot"]), "set_d": (None, 6, ["0/d/manifest"]), "e": (None, None, ["0/e/manifest"]), "same": (8, None, []),
    }


def test_volumes_in_three_shapes(spark):
    master = lambda **x: {"kind": "master", **x}
    given = {
        "offset": {"factory_offset": {"factory_volume": "E8 E8"}, "factory_volume": {"commands": []}},
        "sides": {"factory_volume": {"attenuation": {"left": "E8", "right": "E0"}}},
        "side": {"factory_volume": {"attenuation": {"right": "E0"}}, "boards": ["SAM1"]},
        "no sides": {"factory_volume": {"attenuation": {}}},
        "silent": {"boards": ["x", "SAM rev"], "factory_volume": {"commands": [master(board=1)]}},
        "commands": {"boards": ["DCS"], "factory_volume": {"commands": [master(board=1, family="D", bytes="55AA", level=7, level_max=31), {"kind": "mixer", "board": 3}, master(board=0, level=-2, level_max=2.5), master(board=1, family="E", bytes="55AB", level=9), master(family="F")]}},
        "none": {"factory_volume": {"commands": [{"kind": "mixer"}]}},
        "unsaid": {"factory_volume": {}},
        "null": None,
    }
    df = spark.createDataFrame([(k, json.dumps(v) if v is not None else None) for k, v in given.items()], "k string, v string")
    got = {r["k"]: None if r["x"] is None else [tuple(x) for x in r["x"]] for r in df.select("k", reports.factory_volumes(F.col("v")).alias("x")).collect()}
    assert got == {
        "offset": [(0, "SAM", "E8E8", None, None)], "sides": [(0, "SAM", "E8E0", None, None)], "side": [(0, "SAM", "E0", None, None)], "no sides": [], "silent": None,
        "commands": [(0, "F", "", None, None), (1, "E", "55AB", 9, None)], "none": [], "unsaid": None, "null": None,
    }
