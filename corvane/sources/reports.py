"""Reports of runs: JSON files of two kinds in a folder for each set, and the volumes that they tell in three shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files of the two kinds, and the label of boards whose volume is an attenuation.
KINDS = {"manifest": "manifest.json", "boot": "factory-boot.json"}
ATTENUATED = "SAM"
VOLUMES = "array<struct<board:bigint,family:string,bytes:string,level:bigint,level_max:bigint>>"


def report_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(place, folder, kind, value): the reports in the folders under each of `folders`, by the place of that one. An empty
    file has no row."""
    found, bare = [], lambda path: F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    for place, top in enumerate(folders):
        deep = F.size(F.split(bare(F.lit(top.rstrip("/"))), "/")) + 2
        for kind, name in KINDS.items():
            texts = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "false").text(f"{top}/*", wholetext=True)
            # A file beside the folders matches too, and is none of theirs.
            texts = texts.where(F.size(F.split(bare(F.col("_metadata.file_path")), "/")) == deep)
            found.append(texts.select(F.lit(place).alias("place"), F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1).alias("folder"), F.lit(kind).alias("kind"), "value"))
    return reduce(DataFrame.unionByName, found)


def runs(reports: DataFrame) -> DataFrame:
    """(set, manifest, boot, bad): the reports (place, folder, kind, value) of each set, the last of each kind by place and
    folder; a kind that a later run lacks stays. A set's name is what its run's manifest says as `rom`, else its boot
    report where it has no manifest, else the folder's. bad lists what is no JSON, as place/folder/kind; such a text is none.
    A run of only bad texts has a row of its folder's name, so that they are told.
    """
    good = F.expr("try_parse_json(value)").isNotNull() & F.col("value").isNotNull()
    marked = reports.withColumn("__v", F.when(good, F.col("value")))
    # A manifest and a boot report of one run meet by place and folder.
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("__v")))
    bad = F.array_sort(F.collect_set(F.when(F.col("__v").isNull(), F.concat_ws("/", F.col("place").cast("string"), "folder", "kind"))))
    run = marked.groupBy("place", "folder").agg(of("manifest").alias("m"), of("boot").alias("b"), bad.alias("bad"))
    named = F.coalesce(F.get_json_object(F.coalesce("m", "b"), "$.rom"), F.col("folder"))
    run = run.withColumns({"set": named, "at": F.struct("place", "folder")})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return run.groupBy("set").agg(last("m").alias("manifest"), last("b").alias("boot"), F.array_sort(F.flatten(F.collect_list("bad"))).alias("bad"))


def factory_volumes(report: Column) -> Column:
    """The master volumes that a report says its game set, an array by board, or null if it doesn't say.

    Three shapes: the attenuation that a manifest has under factory_offset, its bytes without blanks; the one of a boot
    report with a left and a right side, none of which is no volume; and the list of commands, of which each board's last
    master counts. A report of boards with an attenuation that has neither of the first two doesn't say. Levels are whole
    numbers from zero on, others null.
    """
    kind, path = F.lit(ATTENUATED), lambda p: F.get_json_object(report, p)
    one = lambda data: F.array(F.struct(F.lit(0).cast("long").alias("board"), kind.alias("family"), data.alias("bytes"), F.lit(None).cast("long").alias("level"), F.lit(None).cast("long").alias("level_max"))).cast(VOLUMES)
    offset = path("$.factory_offset.factory_volume")
    sides = F.concat(F.coalesce(path("$.factory_volume.attenuation.left"), F.lit("")), F.coalesce(path("$.factory_volume.attenuation.right"), F.lit("")))
    two_sided = path("$.factory_volume.attenuation").startswith("{")
    attenuated = F.exists(F.coalesce(F.from_json(path("$.boards"), "array<string>"), F.array().cast("array<string>")), lambda b: F.coalesce(b.startswith(ATTENUATED), F.lit(False)))
    schema = "array<struct<kind:string,board:bigint,family:string,bytes:string,level:string,level_max:string>>"
    listed = F.from_json(path("$.factory_volume.commands"), schema)
    masters = F.filter(listed, lambda c: c["kind"] == "master")
    whole = lambda x: F.when(F.regexp_like(x, F.lit(r"^\d+$")), x.cast("long"))
    board = lambda c: F.coalesce(c["board"], F.lit(0).cast("long"))

    def volume(b: Column) -> Column:
        c = F.element_at(F.filter(masters, lambda x: board(x) == b), -1)
        return F.struct(b.alias("board"), F.coalesce(c["family"], F.lit("")).alias("family"), F.coalesce(c["bytes"], F.lit("")).alias("bytes"), whole(c["level"]).alias("level"), whole(c["level_max"]).alias("level_max"))

    commands = F.transform(F.array_sort(F.array_distinct(F.transform(masters, board))), volume).cast(VOLUMES)
    none = F.array().cast(VOLUMES)
    shaped = F.when(offset.isNotNull(), one(F.replace(offset, F.lit(" "), F.lit(""))))
    shaped = shaped.when(F.coalesce(two_sided, F.lit(False)), F.when(sides == "", none).otherwise(one(sides)))
    return shaped.when(attenuated, F.lit(None)).when(listed.isNotNull(), commands)
