"""Files of a pack by hand: names with comments, line edits, saved base rows, the catalogue as one document."""

import json

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.sources import sinks, texts


def test_kept_names_and_ids(spark):
    rows = [("a/b\\..new, \"take\" #2.wav",), ("  .hidden .wav ",), ("x" * 90,), ("é-ß_(1)+.ogg",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(X.kept_name(F.col("n"))).collect()]
    assert got == ["new_ _take_ _2.wav", "hidden .wav", "x" * 80, "é-ß_(1)+.ogg", "", None]
    got = [r[0] for r in spark.createDataFrame([(" 0x2a",), ("FFFFF",), (" zz ",), (None,)], "i string").select(X.normal_id(F.col("i"))).collect()]
    assert got == ["0x002A", "0xFFFFF", "zz", None]


def test_line_edits(spark):
    schema = "id int, ord int, kind string, state string, fname string, gain double, source string"
    rows = [(10, 1, "base", "off", None, None, None), (10, 2, "extra", "on", "replace/a.wav", 80.5, "a.wav"), (10, 3, "extra", "off", "b.wav", 200.0, "x/b,c.wav"), (11, 1, "base", "off", None, None, None), (11, 2, "base", "on", None, None, None), (12, 1, "extra", "on", "c.wav", -3.0, None)]
    of = lambda rows: [r["value"] for r in sinks.line_edit_lines(spark.createDataFrame(rows, schema)).orderBy("id", "ord").collect()]
    head = "ID,KIND,STATE,FNAME,GAIN,SOURCE"
    assert of(rows) == [head, "0x000A,base,off,,,", "0x000A,extra,on,replace/a.wav,81,a.wav", "0x000A,extra,off,b.wav,100,b_c.wav", "0x000C,extra,on,c.wav,0,"]
    assert of([]) == [head]


def test_saved_bases(spark, tmp_path):
    rows = [("altsound.csv", 10, '0x000A,"Say ""hi""",1'), ("g-sound.csv", 10, "0x000A"), ("altsound.csv", 0x12345, "")]
    bases = spark.createDataFrame(rows, "file string, id long, row string")
    path = str(tmp_path / "bases")
    sinks.write_lines(sinks.base_lines(bases).withColumn("f", F.lit("b")), path, "f", ["file", "id"], "\r\n")
    read = texts.saved_bases(texts.lines(spark, path)).select("file", "id", "row")
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    assert sinks.base_lines(bases.where("false")).count() == 0
    lines = ["FILE,ID,ROW", "a,0x1,first", 'a,1,"last"', "a,zz,no id", "short", 'b,2,"', "c,3,x,y"]
    numbered = spark.createDataFrame([("p", i, v) for i, v in enumerate(lines, 1)], "path string, line int, value string")
    assert sorted((r["file"], r["id"], r["row"]) for r in texts.saved_bases(numbered).collect()) == [("a", 1, "last"), ("b", 2, '"'), ("c", 3, "x,y")]


def test_names_file(spark):
    packs = spark.createDataFrame([("p", "afm", None, "2"), ("q", None, "AB", "2")], "pack string, rom string, sound_rom_id string, version string")
    sounds = spark.createDataFrame([("p", 2, "0x2", 'x,"y"'), ("p", 1, "1", "one"), ("p", 3, "3", ""), ("p", 4, "4", None)], "pack string, ord int, id string, name string")
    got = {}
    for r in sinks.names_lines(packs, sounds, "tool").orderBy("pack", "place", "ord").collect():
        got.setdefault(r["pack"], []).append(r["value"])
    assert got == {"p": ["# tool names", "# rom: afm", "# tool: 2", "ID,NAME", "0x0001,one", '0x0002,"x,""y"""'], "q": ["# tool names", "# sound_rom_id: AB", "# tool: 2", "ID,NAME"]}


def test_catalogue_is_one_document(spark):
    entries = spark.createDataFrame([(2, "b", None), (1, "a", [7])], "k int, label string, sets array<int>")
    text = lambda e, head: "\n".join(r["value"] for r in sinks.catalogue_file(e, "k", ["label", "sets"], head).orderBy("place", "k").collect())
    assert json.loads(text(entries, F.struct(F.lit(1).alias("format")))) == {"format": 1, "entries": [{"label": "a", "sets": [7]}, {"label": "b", "sets": []}]}
    assert json.loads(text(entries.where("false"), F.struct(F.lit(None).cast("int").alias("format")))) == {"entries": []}


def test_manifest(spark):
    packs = spark.createDataFrame([("p", "afm", None, True, "67"), ("q", "mm", "m", False, None)], "pack string, rom string, parent string, factory boolean, volume string")
    boards = spark.createDataFrame([("p", 1, "B"), ("p", 0, "A")], "pack string, board int, family string")
    sounds = spark.createDataFrame([("p", 2, 20, "two", 1.5), ("p", 1, 10, None, 2.0)], "pack string, ord int, id int, name string, seconds double")
    rows = spark.createDataFrame([("p", 1, 10, "old", "body", False, 1, 50, False), ("p", 2, 10, "new", "body", True, -1, 100, True)], "pack string, ord int, id int, file string, kind string, loop boolean, channel int, duck int, stop boolean")
    twins = spark.createDataFrame([("p", 20, 10, -70.126, 0.5, 0.00049)], "pack string, id int, of int, residual_db double, lag double, lufs_diff double")
    got = {r["pack"]: json.loads(r["value"]) for r in sinks.manifests(packs, boards, sounds, rows, twins).collect()}
    one = {"id": 10, "seconds": 2.0, "pack": {"file": "new", "kind": "body", "loop": 100, "channel": -1, "duck": 100, "stop": 1}}
    two = {"id": 20, "name": "two", "seconds": 1.5, "twin_of": 10, "twin": {"residual_db": -70.13, "lag_samples": 0.5, "lufs_diff": 0.0}}
    assert got["p"] == {"rom": "afm", "mode": "factory", "boards": [{"board": 0, "family": "A"}, {"board": 1, "family": "B"}], "factory_volume": "67", "sounds": [one, two]}
    assert got["q"] == {"rom": "mm", "parent": "m", "mode": "normal", "boards": [], "sounds": []}


def test_named_members(spark, tmp_path):
    import io
    import zipfile

    def archive(*members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, content in members:
                z.writestr(name, content)
        return buffer.getvalue()

    from corvane.sources import archives

    held = [("a.zip", archive(("x/Boot.BIN", b"one"), ("boot.bin", b"two"), ("z", b""))), ("b.zip", archive(("other", b"x"))), ("c.zip", b"no archive"), ("d.zip", archive(("boot.bin", b"x")))]
    names = spark.createDataFrame([("a.zip", "bOOT.bin"), ("b.zip", "boot.bin"), ("c.zip", "boot.bin")], "path string, name string")
    got = archives.named_members(spark.createDataFrame(held, "path string, content binary"), names).collect()
    assert [(r["path"], r["member_path"], bytes(r["content"])) for r in got] == [("a.zip", "x/Boot.BIN", b"one")]


def test_volumes_by_family(spark):
    from corvane.functions import rules as R

    rows = spark.createDataFrame([("WMSS11J",), ("BYSNT",), ("DCS",), ("zz",), (None,)], "f string").select(R.full_scale(F.col("f")), R.no_volume_reason(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [(R.NO_STAGE, R.SYSTEM_11_SILENT), (R.NOT_EMULATED, R.SILENT_ON_VOLUME["BYSNT"]), (None, R.SILENT_ON_VOLUME["DCS"]), (None, R.UNKNOWN_SILENT), (None, R.UNKNOWN_SILENT)]
