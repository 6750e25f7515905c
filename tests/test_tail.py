"""Growing files as a stream, against the lines that a plain read of them gives."""

import random

from corvane.streaming import tail


def run(spark, folder, out, part=tail.PART):
    """What has come since the last run, from the checkpoint that it left."""
    stream = tail.tail(spark, str(folder), part)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{out}/rows").collect()
    return sorted((r["path"].rsplit("/", 1)[1], r["at"], r["line"]) for r in rows)


def plain(folder):
    out = []
    for file in sorted(folder.iterdir()):
        data, at = file.read_bytes(), 0
        for piece in data.split(b"\n")[:-1]:
            out.append((file.name, at, piece.rstrip(b"\r").decode("utf-8", "replace")))
            at += len(piece) + 1
    return sorted(x for x in out if x[0][0] not in "._")


def test_half_lines_wait_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    r = random.Random(1)
    (folder / "a.log").write_bytes(b"one\ntwo\r\nhal")
    (folder / ".hidden").write_bytes(b"no\n")
    assert run(spark, folder, out) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert len(run(spark, folder, out)) == 2
    with (folder / "a.log").open("ab") as f:
        f.write(b"f")
    (folder / "b.log").write_bytes(b"")
    assert len(run(spark, folder, out)) == 2
    for _ in range(2):
        for name in ("a.log", "b.log", f"c{r.randrange(3)}.log"):
            text = "".join(r.choice(["x", "é", "\n", "\r", "long" * 20]) for _ in range(r.randrange(400))).encode()
            with (folder / name).open("ab") as f:
                f.write(text[: r.randrange(len(text) + 1)])
        assert run(spark, folder, out, part=97) == plain(folder)
    (folder / "a.log").write_bytes((folder / "a.log").read_bytes() + b"\xff\xfe\nlast\n")
    got = run(spark, folder, out)
    assert got == plain(folder) and any("�" in x[2] for x in got)


def test_a_batch_read_and_ranges_of_any_size(spark, tmp_path):
    r = random.Random(2)
    data = "".join("w" * r.randrange(0, 60) + r.choice(["\n", "\r\n", "\n\n"]) for _ in range(500)).encode() + b"tail"
    (tmp_path / "x.txt").write_bytes(data)
    spark.dataSource.register(tail.Tail)
    for part in (1, 7, 1000, 1 << 20):
        if part == 1:
            found = [x for p in tail.ranges({}, {str(tmp_path / "x.txt"): 300}, 1) for b in tail._lines(str(tmp_path), p) for x in b.column("at").to_pylist()]
            assert found == [x[1] for x in plain(tmp_path) if x[1] < 300]
            continue
        rows = spark.read.format("tail").option("partBytes", str(part)).load(str(tmp_path)).collect()
        assert sorted((x["path"].rsplit("/", 1)[1], x["at"], x["line"]) for x in rows) == plain(tmp_path)


def test_a_file_that_was_cut_goes_on_from_its_new_end(tmp_path):
    (tmp_path / "a").write_bytes(b"1\n2\n3\n")
    stream = tail.TailStream({"path": str(tmp_path)})
    name = str(tmp_path / "a")
    assert stream.latestOffset() == {name: 6}
    (tmp_path / "a").write_bytes(b"1\n")
    cut = dict(stream.latestOffset())
    assert cut == {name: 2} and stream.partitions({name: 6}, cut) == []
    (tmp_path / "a").write_bytes(b"1\nx\ny")
    now = stream.latestOffset()
    assert [x for p in stream.partitions(cut, now) for b in stream.read(p) for x in b.column("line").to_pylist()] == ["x"]
