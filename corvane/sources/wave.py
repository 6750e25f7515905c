"""Sound files: WAVE bytes of rows, loop chunks, bodies and extensions, and a sink that commits a job's files at once."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Columns of the rows that are written, by name.
COLUMNS = ("name", "rate", "channels", "pcm", "loop_start", "loop_end")


def wave_bytes(pcm: bytes, rate: int, channels: int = 1) -> bytes:
    """A WAVE file of 16-bit samples."""
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(pcm)) + pcm


def chunks(wave: bytes) -> list[tuple[bytes, bytes]]:
    """(name, content) of each chunk of a RIFF file."""
    if len(wave) < 12 or wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, out = 12, []
    while at + 8 <= len(wave):
        name, size = wave[at : at + 4], int.from_bytes(wave[at + 4 : at + 8], "little")
        if at + 8 + size > len(wave):
            raise ValueError("truncated chunk")
        out.append((name, wave[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def with_loop(wave: bytes, start: int, end: int) -> bytes:
    """The file with one endless forward loop from frame `start` to `end`, the last of it, in place of any it had: its
    other chunks stay as they are, so a second call changes nothing."""
    kept = [(n, c) for n, c in chunks(wave) if n != b"smpl"]
    form = next((c for n, c in kept if n == b"fmt "), None)
    if form is None:
        raise ValueError("no fmt chunk")
    rate = struct.unpack("<I", form[4:8])[0]
    # Nanoseconds of a sample, middle C, no offset, one loop of type forward that never ends.
    loop = struct.pack("<9I", 0, 0, round(1e9 / rate), 60, 0, 0, 0, 1, 0) + struct.pack("<6I", 0, 0, start, end, 0, 0)
    body = b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in [*kept, (b"smpl", loop)])
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def loop_points(wave: bytes) -> tuple[int, int] | None:
    """The first loop's first and last frame, or None."""
    for name, content in chunks(wave):
        if name == b"smpl" and len(content) >= 60 and struct.unpack("<I", content[28:32])[0]:
            return struct.unpack("<II", content[44:52])
    return None


def loops(found: DataFrame) -> DataFrame:
    """(path, loop_start, loop_end): the loop of each file (path, content); nulls for none and for what is no WAVE file."""

    @F.udf("struct<loop_start: long, loop_end: long>", useArrow=True)
    def of(raw):
        try:
            return loop_points(bytes(raw)) if raw is not None else None
        except ValueError:
            return None

    return found.select("path", of("content").alias("l")).select("path", "l.loop_start", "l.loop_end")


def cycles_for(target: Column, intro: Column, period: Column) -> Column:
    """How many bodies fill `target` frames after the intro; one at least."""
    return F.greatest(F.lit(1), F.ceil((target - intro) / F.greatest(period, F.lit(1)))).cast("int")


def extended(sounds: DataFrame, target: Column, pcm: str = "pcm", intro: str = "intro", period: str = "period", channels: str = "channels") -> DataFrame:
    """`sounds` whose loops play for `target` frames at least: `pcm` is the intro and then whole bodies, with cycles,
    loop_start and loop_end (the first body's). A sound without a loop, or too short for it, stays as it is, with nulls."""
    width = F.col(channels) * 2
    fits = (F.col(period) > 0) & ((F.col(intro) + F.col(period)) * width <= F.length(pcm))
    cycles = F.when(fits, cycles_for(target, F.col(intro), F.col(period)))
    body = F.substring(pcm, (F.col(intro) * width + 1).cast("int"), (F.col(period) * width).cast("int"))
    longer = F.concat(F.substring(pcm, F.lit(1), (F.col(intro) * width).cast("int")), F.unhex(F.repeat(F.hex(body), F.col("cycles"))))
    out = sounds.withColumn("cycles", cycles)
    points = {"loop_start": F.when(F.col("cycles").isNotNull(), F.col(intro)), "loop_end": F.when(F.col("cycles").isNotNull(), F.col(intro) + F.col(period) - 1)}
    return out.withColumns({pcm: F.when(F.col("cycles").isNotNull(), longer).otherwise(F.col(pcm)), **points})


def body_cut(sounds: DataFrame, pcm: str = "pcm", intro: str = "intro", period: str = "period", channels: str = "channels") -> DataFrame:
    """`sounds` with the loop's body alone as `pcm`; those without a loop, or too short for it, as they are."""
    width = F.col(channels) * 2
    fits = (F.col(period) > 0) & ((F.col(intro) + F.col(period)) * width <= F.length(pcm))
    body = F.substring(pcm, (F.col(intro) * width + 1).cast("int"), (F.col(period) * width).cast("int"))
    return sounds.withColumn(pcm, F.when(fits, body).otherwise(F.col(pcm)))


@dataclass
class Written(WriterCommitMessage):
    """(temporary, final) paths of a task's files; final ones that are there already with the same bytes are left out."""

    files: list[tuple[str, str]]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    fs.create_dir(root)
    return fs, root


class WaveWriter(DataSourceWriter):
    """Tasks write under hidden names of their own; only the commit gives files their names, so a job that fails leaves
    no file behind and a task that runs twice leaves one."""

    def __init__(self, root: str, names: list[str]):
        self.root, self.at = root, {c: names.index(c) for c in COLUMNS if c in names}
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = _open(self.root)
        made = []
        for row in iterator:
            of = {c: row[i] for c, i in self.at.items()}
            if of["name"] is None or of["pcm"] is None:
                continue
            if not (name := of["name"]) or name[0] == "." or "/" in name or "\\" in name:
                raise ValueError(f"not a plain file name: {name!r}")
            data = wave_bytes(bytes(of["pcm"]), of.get("rate") or 44_100, of.get("channels") or 1)
            if of.get("loop_start") is not None and of.get("loop_end") is not None:
                data = with_loop(data, of["loop_start"], of["loop_end"])
            final = f"{root}/{name}"
            there = fs.get_file_info(final)
            if there.size == len(data):
                with fs.open_input_file(final) as file:
                    if file.read() == data:
                        continue
            hidden = f"{root}/.{self.job}-{hashlib.sha256(name.encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
            with fs.open_output_stream(hidden) as file:
                file.write(data)
            made.append((hidden, final))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        for hidden, final in files:
            fs.move(hidden, final)
        self.clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(_open(self.root)[0])

    def clear(self, fs: pafs.FileSystem) -> None:
        """Deletes what attempts of this job left, those that were lost before they could tell included."""
        _, root = _open(self.root)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)


class WaveFiles(DataSource):
    """`df.write.format("waves").mode("append").save(folder)`: a WAVE file for each row (name, rate, channels, pcm,
    loop_start, loop_end), rate and channels being 44100 and 1 by default; other columns are ignored, rows without a name
    or sound leave none. Files of the same bytes are left alone, others of the same name replaced."""

    @classmethod
    def name(cls) -> str:
        return "waves"

    def schema(self) -> str:
        return "name string, rate int, channels int, pcm binary, loop_start long, loop_end long"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"name", "pcm"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows of sound files need {sorted(missing)}")
        return WaveWriter(self.options["path"], schema.fieldNames())


def write_waves(sounds: DataFrame, folder: str) -> None:
    sounds.sparkSession.dataSource.register(WaveFiles)
    sounds.write.format("waves").mode("append").save(folder)
