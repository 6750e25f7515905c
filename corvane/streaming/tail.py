"""Growing text files as a stream of lines: a data source of Spark's whose offsets are the ends of whole lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that a task reads, and that are looked through at once for the last end of a line.
PART, BACK = 32 << 20, 1 << 16
SCHEMA = "path string, at long, line string"


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at `start` or later and before `end`; `whole`: a line begins at `start`."""

    path: str
    start: int
    end: int
    whole: bool


def _files(path: str) -> tuple[pafs.FileSystem, dict[str, int]]:
    """The files at `path` with their sizes: itself or those of the folder that it is, hidden ones aside."""
    fs, at = pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    info = fs.get_file_info(at)
    found = fs.get_file_info(pafs.FileSelector(at)) if info.type == pafs.FileType.Directory else [info]
    return fs, {f.path: f.size for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"}


def whole_lines(fs: pafs.FileSystem, path: str, size: int, least: int = 0) -> int:
    """The place after the last end of a line in the first `size` bytes, not looked for before `least`."""
    with fs.open_input_file(path) as file:
        end = size
        while end > least:
            begin = max(least, end - BACK)
            if (found := file.read_at(end - begin, begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            end = begin
    return least


def ranges(start: dict[str, int], end: dict[str, int], part: int = PART) -> list[Range]:
    """What lies between two offsets, no task reading much more than `part` bytes."""
    out = []
    for path, stop in sorted(end.items()):
        first = start.get(path, 0)
        out += [Range(path, at, min(at + part, stop), at == first) for at in range(first, stop, part)]
    return out


def _lines(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    fs, _ = _files(root)
    with fs.open_input_file(part.path) as file:
        # The line that reaches into the range is the range's before; the last one is read beyond the range's end.
        at = part.start if part.whole else part.start - 1
        held, place = b"", at
        skip, done = not part.whole, False
        while not done:
            block = file.read_at(1 << 20, place)
            place += len(block)
            pieces = (held + block).split(b"\n")
            held = pieces.pop()
            places, lines = [], []
            for piece in pieces:
                if at >= part.end:
                    done = True
                    break
                if not skip:
                    places.append(at)
                    lines.append(piece.rstrip(b"\r").decode("utf-8", "replace"))
                skip = False
                at += len(piece) + 1
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["path", "at", "line"])
            done = done or not block or at >= part.end


class Tail(DataSource):
    """`spark.readStream.format("tail").load(path)`: (path, at, line) of each whole line of the files of a folder, `at`
    being the byte that it begins at. A last line without an end waits until that is written; bytes that are no UTF-8
    become U+FFFD; carriage returns at the end of a line go. New files are found at each trigger, in any file system that
    Arrow opens and all executors reach. A file that was cut is read on from its new end.
    `spark.read.format("tail")` reads the whole lines that there are now."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailStream(self.options)


class TailReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.part = options["path"], int(options.get("partBytes", PART))

    def ends(self, least: dict[str, int] | None = None) -> dict[str, int]:
        fs, sizes = _files(self.root)
        return {p: whole_lines(fs, p, n, min(n, (least or {}).get(p, 0))) for p, n in sizes.items()}

    def partitions(self) -> list[Range]:
        return ranges({}, self.ends(), self.part)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.root, partition)


class TailStream(DataSourceStreamReader):
    def __init__(self, options):
        self.now = TailReader(options)
        #: Only spares looking through bytes again; offsets are what Spark keeps.
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = self.now.ends(self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.now.part)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.now.read(partition)

    def commit(self, end: dict) -> None:
        pass


def tail(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """The lines of the growing files of `path` as a stream."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("partBytes", str(part)).load(path)
