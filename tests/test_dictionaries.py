"""Exact reading of dictionaries against a plain walk, and text that is read back whole."""

import random

from pyspark.sql import functions as F

from corvane.sources import dictionaries as D
from corvane.sources import texts


def walk_lines(text):
    out = []
    body = text[:-1] if text.endswith("\n") else text
    for line in body.split("\n"):
        line = line.removesuffix("\r").encode()
        while len(line) >= 100:
            cut = 100
            while cut < len(line) and line[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(line[:cut].decode())
            line = line[cut:]
        out.append(line.decode())
    return out


def walk_listed(text, game, parent):
    lines, out = walk_lines(text), {}
    heads = [i for i, x in enumerate(lines) if x[:1] not in tuple(":;# ") or x == ""]
    for k, i in enumerate(heads):
        if not (lines[i].startswith(game) or parent and lines[i].startswith(parent)):
            continue
        for at in range(i + 1, heads[k + 1] if k + 1 < len(heads) else len(lines)):
            if lines[at].startswith(":"):
                rest = lines[at][1:]
                n = next((j for j, c in enumerate(rest) if c not in "0123456789abcdef"), len(rest))
                key, name = rest[: n // 2 * 2], rest[n:][1:][:29]
                out[key] = (out[key][0] if key in out else at, name, lines[i])
    return {k: v for k, v in out.items()}


def read(spark, texts_, games):
    df = spark.createDataFrame(list(texts_.items()), "path string, text string")
    found = D.listed(D.exact_entries(D.buffered_lines(df)), spark.createDataFrame(games, "game string, parent string")).collect()
    out = {}
    for r in found:
        out.setdefault((r["path"], r["game"]), {})[r["key"]] = (r["ord"], r["name"], r["heading"])
    return out


def test_lines_of_any_length_as_the_buffer_gets_them(spark):
    lines = [p + "x" * (n - len(p.encode())) for n in (0, 1, 97, 98, 99, 100, 101, 102, 199, 200, 201, 350) for p in ("", ":01:" if n > 4 else "")] + ["é" * 49 + "a", "é" * 50, "a" + "é" * 50, "漢" * 67, "a" * 99 + "é", "a" * 98 + "漢" + "b" * 99]
    text = {"lf": "\n".join(lines) + "\n", "crlf": "\r\n".join(lines), "empty": "", "one": "\n", "two": "\n\n"}
    df = spark.createDataFrame([*text.items(), ("null", None)], "path string, text string")
    got = {}
    for r in D.buffered_lines(df).orderBy("path", "line").collect():
        got.setdefault(r["path"], []).append(r["value"])
    assert got == {k: walk_lines(v) for k, v in text.items()}


def test_the_reader_against_a_walk(spark):
    r = random.Random(1)
    names = ["afm", "afm_113", "afm_113b", "mm_10", "mm", "zz"]
    files = {}
    for i in range(6):
        parts = []
        for _ in range(120):
            kind = r.random()
            parts.append(
                r.choice(names) + r.choice([":", "", " :"]) if kind < 0.15 else "" if kind < 0.2 else r.choice(["; c", "# c", " indented"]) if kind < 0.3
                else ":" + "".join(r.choice("0123456789abcdefAF"[: 16 + i]) for _ in range(r.choice([0, 1, 2, 3, 4]))) + r.choice([":", " ", "", "::"]) + "Näme " * r.randrange(0, 25)
            )
        files[str(i)] = r.choice(["\n", "\r\n"]).join(parts) + "\n"
    games = [("afm_113b", "afm_113"), ("afm", None), ("mm_10", "mm"), ("nothing", None), ("zz", "")]
    got = read(spark, files, games)
    for path, text in files.items():
        for game, parent in games:
            assert got.get((path, game), {}) == walk_listed(text, game, parent)


def test_what_only_the_exact_reader_sees(spark, tmp_path):
    text = "; comment\n\nafm_113:\n:0001:Music\n:0A01:Upper\n:0001:Renamed\n\n:0002:After an empty line\nafm_113b:\n:0003:" + "n" * 40 + "\n:0004:" + "m" * 100 + "\n:0005:Lost behind a long line\n"
    (tmp_path / "d.dat").write_text(text)
    got = read(spark, {"d": text}, [("afm_113b", "afm_113")])[("d", "afm_113b")]
    assert "0002" not in got and "0005" not in got and got["0001"][1] == "Renamed" and got["0003"][1] == "n" * 29
    loose = {(r["heading"], r["key"]): r["name"] for r in texts.dictionary(texts.lines(spark, str(tmp_path / "d.dat"))).collect()}
    assert loose[("afm_113:", "0002")] == "After an empty line" and ("afm_113b:", "0005") in loose and ("afm_113:", "0a01") in loose


def test_text_is_read_back_whole(spark):
    r = random.Random(2)
    sections = [(f"set_{i}", " ".join("word" * r.randrange(1, 9) for _ in range(r.randrange(0, 60))) + r.choice(["", " " + "x" * 150])) for i in range(8)] + [("unused", "c")]
    entries = [(h, f"{k:04X}", r.choice(["Short", "é" * 60, "A name of more than twenty-nine characters", "n" * 120, ""])) for h, _ in sections[:8] for k in range(r.randrange(1, 30))]
    lines = D.dictionary_text(spark.createDataFrame(sections, "heading string, comment string"), spark.createDataFrame(entries, "heading string, key string, name string")).orderBy("heading", "part", "ord").collect()
    assert all(len(x["value"].encode()) <= 98 for x in lines)
    text = "\n".join(x["value"] for x in lines) + "\n"
    got = read(spark, {"t": text}, [(h + ":", None) for h, _ in sections])
    want = {}
    for h, k, n in entries:
        whole = f":{k.lower()}:{n}".encode()[:98].decode(errors="ignore")
        want.setdefault(("t", h + ":"), {})[k.lower()] = whole[6:][:29]
    assert {g: {k: v[1] for k, v in e.items()} for g, e in got.items()} == want
    comments = [x["value"] for x in lines if x["value"].startswith(";")]
    for h, c in sections[:8]:
        own = " ".join(x["value"][2:] for x in lines if x["heading"] == h and x["value"].startswith(";"))
        assert own == " ".join(w[:96] for w in c.split())
    assert len(comments) > 20


def test_lines_that_fit(spark):
    df = spark.createDataFrame([("a" * 98,), ("a" * 99,), ("é" * 50,), ("a" * 97 + " b",), ("",), (None,)], "v string")
    assert [x[0] for x in df.select(D.fitted(F.col("v"))).collect()] == ["a" * 98, "a" * 98, "é" * 49, "a" * 97, "", None]
