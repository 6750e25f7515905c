"""Archives and folders of files as tables, read as whole files by Spark wherever they are stored."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs as X


def files(spark: SparkSession, path: str, glob: str = "*", content: bool = True) -> DataFrame:
    """(path, size, content) of the files under `path`, folders included."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), *(["content"] if content else []))


def zip_members(archives: DataFrame, inflate: bool = False) -> DataFrame:
    """(path, ord, member_path, size, crc, content, error): a row for each member of each archive (path, content), in
    the order of its directory. Contents are inflated, and checked by size and crc, only on request; an archive that
    cannot be read is one row with an error."""

    def read(batches):
        columns = ["path", "ord", "member_path", "size", "crc", "content", "error"]
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for i, m in enumerate(m for m in z.infolist() if not m.is_dir()):
                            rows.append((path, i, m.filename, m.file_size, m.CRC, z.read(m) if inflate else None, None))
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, struct.error) as bad:
                    rows = [(path, None, None, None, None, None, str(bad) or type(bad).__name__)]
                yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(read, "path string, ord int, member_path string, size long, crc long, content binary, error string")


def named_members(archives: DataFrame, names: DataFrame) -> DataFrame:
    """`zip_members` with their contents, of each archive (path, content) the first whose last piece is its wanted name in
    any case of A-Z. Names: path, name. An archive without such a member, or that cannot be read, has no row."""
    found = zip_members(archives.join(names.select("path").distinct(), "path", "left_semi"), inflate=True).where("error is null")
    wanted = names.select("path", X.ascii_lower(F.col("name")).alias("__n")).distinct()
    same = found.withColumn("__n", X.ascii_lower(X.base_name(F.col("member_path")))).join(wanted, ["path", "__n"])
    columns = [c for c in found.columns if c not in ("path", "ord")]
    first = same.groupBy("path", "__n").agg(F.min("ord").alias("ord"))
    return same.join(first, ["path", "__n", "ord"]).select("path", "ord", *columns)


def folder_members(loose: DataFrame) -> DataFrame:
    """(path, ord, member_path, size, crc): loose files (path, size, content) as members of their folder, by name."""
    from pyspark.sql import Window as W

    folder = F.regexp_replace("path", "/[^/]*$", "")
    found = loose.select(folder.alias("folder"), X.base_name(F.col("path")).alias("member_path"), "size", F.crc32("content").alias("crc"))
    place = F.row_number().over(W.partitionBy("folder").orderBy("member_path")) - 1
    return found.select(F.col("folder").alias("path"), place.alias("ord"), "member_path", "size", "crc")


def units(found: DataFrame) -> DataFrame:
    """(path, stem, kind): inputs among files (path): an archive, or a folder of loose files that has no archive."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    marked = found.select("path", folder.alias("folder"), X.ascii_lower(F.col("path")).endswith(".zip").alias("is_zip"))
    zips = marked.where("is_zip").select("path", X.stem(F.col("path")).alias("stem"), F.lit("zip").alias("kind"))
    loose = marked.groupBy("folder").agg(F.bool_or("is_zip").alias("z")).where("not z")
    return zips.unionByName(loose.select(F.col("folder").alias("path"), X.base_name(F.col("folder")).alias("stem"), F.lit("folder").alias("kind")))


def wav_sounds(found: DataFrame) -> DataFrame:
    """(path, rate, channels, bits, frames, pcm, error): RIFF files (path, content), their sound as 16-bit mono."""
    import numpy as np

    def parse(raw: bytes) -> tuple:
        if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
            raise ValueError("not a WAVE file")
        at, form, data = 12, None, None
        while at + 8 <= len(raw):
            name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
            if name == b"fmt ":
                form = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            elif name == b"data":
                data = raw[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
        if form is None or data is None:
            raise ValueError("no format or data")
        kind, channels, rate, _, _, bits = form
        width = bits // 8
        data = data[: len(data) // (width * channels) * width * channels]
        if kind == 3:
            x = np.frombuffer(data, f"<f{width}").astype(float) * 32768
        elif bits == 8:
            x = (np.frombuffer(data, np.uint8).astype(float) - 128) * 256
        elif bits == 24:
            b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 256
        else:
            x = np.frombuffer(data, f"<i{width}").astype(float) / 2 ** (bits - 16)
        mono = x.reshape(-1, channels).mean(1)
        return rate, channels, bits, len(mono), np.clip(np.round(mono), -32768, 32767).astype("<i2").tobytes(), None

    def read(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, *parse(raw)))
                except (ValueError, struct.error, TypeError) as bad:
                    rows.append((path, None, None, None, None, None, str(bad)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "bits", "frames", "pcm", "error"])

    return found.select("path", "content").mapInPandas(read, "path string, rate int, channels int, bits int, frames long, pcm binary, error string")
