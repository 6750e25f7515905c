"""Licenses are found however a copy is wrapped, indented, commented or spelled."""

import os
import textwrap

import pytest

from corvane.llm import licenses
from corvane.llm.license_texts import DIGESTS, LICENSES


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs).collect()}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_every_width(spark):
    forms = [(name, wrapped(text, width)) for name, text in LICENSES for width in range(60, 101)]
    got = found(spark, [t for _, t in forms])
    assert [got[i] for i in range(len(forms))] == [n for n, _ in forms]


@pytest.mark.parametrize("mark", ["    ", "# ", " * ", "// ", "; ", "\t"])
def test_indented_and_commented(spark, mark):
    forms = [(name, textwrap.indent(wrapped(text, width), mark, lambda _: True)) for name, text in LICENSES for width in (64, 78)]
    got = found(spark, [t for _, t in forms])
    assert [got[i] for i in range(len(forms))] == [n for n, _ in forms]


def test_notices_spellings_and_others(spark):
    name, text = LICENSES[0]
    notice = "Copyright (c) <year> <copyright holders>"
    same = [text.replace(notice, x) for x in ("Copyright 2019-2024 A. Person", "(c) 2001 by B", "© C Ltd.\nCopyright (C) 1999, D. All rights reserved.", "Portions copyright 2003 E", "")]
    same += [text.replace("sublicense", "sub-licence"), text.replace("Software", "  SOFTWARE,"), text.upper().replace(notice.upper(), notice)]
    other = [text + " more", text.replace("without limitation", ""), "copyright", "", None]
    got = found(spark, same + other)
    assert [got[i] for i in range(len(same))] == [name] * len(same)
    assert [got[len(same) + i] for i in range(len(other))] == [None] * len(other)


def test_listed_clause_c_is_no_notice(spark):
    licensed = [("X", "You may (a) run it,\n(b) copy it,\n(c) you must retain all notices\nand no more.")]
    known = spark.createDataFrame(licensed, "license_id string, text string")
    docs = spark.createDataFrame([(1, "You may (a) run it, (b) copy it, (c) you must retain all notices and no more."), (2, "You may (a) run it, (b) copy it,\n and no more.")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs, known).collect()} == {1: "X", 2: None}
    few = licenses.scan_licenses(docs.selectExpr("doc_id", "text", "1 as license_id"), known, broadcast_rows=0)
    assert {r["doc_id"]: r["license_id"] for r in few.collect()} == {1: "X", 2: None}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license texts on this machine")
def test_long_texts(spark):
    paths = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0"}
    texts = [open(f"/usr/share/common-licenses/{x}", encoding="utf8").read() for x in paths.values()]
    if all(map(os.path.isfile, (f"/usr/share/common-licenses/{x}" for x in paths.values()))):
        assert list(found(spark, texts).values()) == list(paths)
    assert len({d for _, d in DIGESTS}) == len(DIGESTS)
