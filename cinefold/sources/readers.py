"""Readers of the text formats: track tables, meshes, descriptor files, matrices and session logs.

All of them go through Spark's own sources, so any store works. Files are read whole where a format says something about
the whole file (line order, a header, validity), by the number of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.operators.tracks import last_wins, reassigned
from cinefold.session import ranked, settled


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of every file under the path that aren't blank, numbered from 0 with those that are.

    A large file is read in splits by many tasks. A line's number is its place in its split, in the order in which the
    task reads it, after the lines of the file's earlier splits, which are counted first.
    """
    source = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    read = settled(spark.read.text(path).select(*source, F.monotonically_increasing_id().alias("seen"), F.col("value").alias("text")))
    counts = read.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", (before - F.col("first")).alias("shift"))
    numbered = read.join(starts, ["file", "split"]).select("file", (F.col("seen") + F.col("shift")).alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))
    return numbered.where(F.trim("text") != "")


def mot_tracks(spark: SparkSession, path: str, threshold: float = 0.1) -> DataFrame:
    """(object, frame, x, y, w, h, score) from frame,id,left,top,w,h,score lines; frames count from 0.

    Files named det.txt keep the scores that reach the threshold and number their objects in each frame by arrival;
    others trust the ids and ignore it. Of several lines for an object in a frame the last holds.
    """
    parts = F.split("text", ",")
    number = lambda k: parts[k].try_cast("double")
    rows = lines(spark, path).select("file", "line", (number(0) - 1).cast("long").alias("frame"), number(1).cast("long").alias("object"), *[number(k).alias(n) for k, n in enumerate("x y w h score".split(), 2)])
    found = F.endswith("file", F.lit("det.txt"))
    detected = reassigned(rows.where(found), threshold)
    return last_wins(rows.where(~found).unionByName(detected), ["file", "object", "frame"], "line").drop("line")


def space_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, x, y) from ``x y frame`` lines; a file with any other line gives nothing; the last line of a frame holds."""
    parts = F.split(F.trim("text"), r"\s+")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    rows = lines(spark, path).select("file", "line", number(0).alias("x"), number(1).alias("y"), number(2).cast("long").alias("frame"), F.size(parts).alias("n"))
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("frame").isNull() | (F.col("n") != 3)
    fine = rows.groupBy("file").agg(F.count_if(bad).alias("bad")).where("bad = 0").select("file")
    return last_wins(rows.join(fine, "file", "left_semi").drop("n"), ["file", "frame"], "line").drop("line")


def obj_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """v, vt and vn as (file, n, values) and f as (file, face, corner, v, vt, vn), numbers as in the file, corners from 1."""
    parts = F.split(F.trim("text"), r"\s+")
    tagged = lines(spark, path).select("file", "line", parts[0].alias("tag"), F.slice(parts, F.lit(2), F.size(parts)).alias("rest"))
    order = lambda: F.row_number().over(W.partitionBy("file").orderBy("line"))
    out = {tag: tagged.where(F.col("tag") == tag).select("file", order().alias("n"), F.transform("rest", lambda x: x.try_cast("double")).alias("values")) for tag in ("v", "vt", "vn")}
    faces = tagged.where("tag = 'f'").select("file", order().alias("face"), "rest").select("file", "face", F.posexplode("rest").alias("corner", "token"))
    index = lambda k: F.get(F.split("token", "/"), F.lit(k)).try_cast("int")
    out["f"] = faces.select("file", "face", (F.col("corner") + 1).alias("corner"), index(0).alias("v"), index(1).alias("vt"), index(2).alias("vn"))
    return out


def descriptors(spark: SparkSession, path: str, length: int = 128) -> DataFrame:
    """(file, n, row, col, scale, orientation, pixels): key files with a header ``count length``; another length is an error.

    Descriptors come at unit length; a zero one stays zero.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double")).alias("all"))
    whole = whole.withColumn("all", F.when(F.col("all")[1] == length, F.col("all")).otherwise(F.raise_error(F.lit(f"descriptor length is not {length}")).cast("array<double>")))
    each = whole.select("file", "all", F.explode(F.sequence(F.lit(0), F.col("all")[0].cast("int") - 1)).alias("n")).where(F.col("all")[0] > 0)
    at = F.lit(3) + F.col("n") * (length + 4)
    own = each.select("file", "n", *[F.element_at("all", (at + k).cast("int")).alias(c) for k, c in enumerate(("row", "col", "scale", "orientation"))], F.slice("all", (at + 4).cast("int"), F.lit(length)).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    return own.withColumn("norm", norm).select("file", "n", "row", "col", "scale", "orientation", F.transform("raw", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("pixels"))


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, value) of white-space or comma separated numbers."""
    rows = lines(spark, path)
    i = F.row_number().over(W.partitionBy("file").orderBy("line")) - 1
    cells = rows.select("file", i.alias("i"), "text").select("file", "i", F.posexplode(F.split(F.trim("text"), r"[\s,]+")).alias("j", "cell"))
    return cells.select("file", "i", "j", F.col("cell").try_cast("double").alias("value"))


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, action, ts) of ``ACTION-&-TIMESTAMP`` lines; a line without the mark or with another time has a null ts."""
    parts = F.split("text", "-&-")
    return lines(spark, path).select("file", F.col("line").alias("id"), parts[0].alias("action"), F.get(parts, F.lit(1)).try_cast("timestamp").alias("ts"))


def frame_listing(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(file, frame, position): image files by the number in their names, and their places in the order of names.

    Contents aren't read. The number is taken from the name, so frames over 9999 aren't lost to a pattern.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"))
    return ranked(found, "file", "position").select("file", F.regexp_extract("file", r"(\d+)\.[^./]+$", 1).try_cast("long").alias("frame"), F.col("position").cast("int").alias("position"))


def downsampled(frames: DataFrame, bytes_each: float, budget: float = 2e9) -> DataFrame:
    """Every k-th frame, k the first of 2..5 that comes nearest the budget, once all frames together exceed it.

    Taking fewer frames is what this operator is for; ``budget=float("inf")`` keeps all.
    """
    size = frames.count() * bytes_each
    if size <= budget:
        return frames
    k = 2 + min(range(4), key=lambda n: abs(2 - size / 1e9 / (n + 2)))
    return frames.where(F.pmod(F.col("frame"), F.lit(k)) == 0)


def repaired(catalog: DataFrame, frames: Column, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A catalog with missing class counts and names filled in, and its labelled frames without those out of range.

    ``catalog`` has (sequence, n_classes, names) and labelled (sequence, class, frame); the class count falls back to
    the highest labelled class, names to action{n}.
    """
    highest = labelled.groupBy("sequence").agg((F.max("class") + 1).alias("_seen"))
    full = catalog.join(highest, "sequence", "left").withColumn("n_classes", F.coalesce("n_classes", "_seen", F.lit(1)))
    default = F.transform(F.sequence(F.lit(0), F.col("n_classes") - 1), lambda n: F.concat(F.lit("action"), n.cast("string")))
    full = full.withColumn("names", F.coalesce("names", default)).drop("_seen")
    kept = labelled.join(catalog.select("sequence", frames.alias("_frames")), "sequence").where((F.col("frame") >= 0) & (F.col("frame") < F.col("_frames"))).drop("_frames")
    return full, kept
