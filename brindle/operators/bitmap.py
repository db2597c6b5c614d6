"""Binary images against the majority image of their label: differences as ranges of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binary(elements: DataFrame, threshold: int = 0) -> DataFrame:
    """Pixels above a threshold as 1."""
    return elements.withColumn("px", F.transform("px", lambda x: (x > threshold).cast("int")))


def majority(elements: DataFrame) -> DataFrame:
    """Majority pixel of each label (A4), ties 0: ``label, k, v``."""
    cells = elements.select("label", F.posexplode("px").alias("k", "x"))
    return cells.groupBy("label", "k").agg((F.sum("x") * 2 > F.count("*")).cast("int").alias("v"))


def flips(elements: DataFrame) -> DataFrame:
    """Places where an image differs from its label's majority (J13): ``elem, label, k``.

    The majority image becomes one array a label, so the join carries images, not pixels.
    """
    image = majority(elements).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_m"))
    joined = elements.join(image, "label").select("elem", "label", F.zip_with("px", F.transform("_m", lambda m: m["v"]), lambda a, b: a != b).alias("d"))
    return joined.select("elem", "label", F.posexplode("d").alias("k", "on")).filter("on").drop("on")


def ranges(flipped: DataFrame, cols: int) -> DataFrame:
    """Half-open column ranges of flipped pixels in a row (W7): ``elem, row, lo, hi``; a window holds one row of one image."""
    cells = flipped.select("elem", F.floor(F.col("k") / cols).cast("int").alias("row"), F.pmod("k", F.lit(cols)).cast("int").alias("col"))
    island = F.col("col") - F.row_number().over(Window.partitionBy("elem", "row").orderBy("col"))
    return cells.withColumn("g", island).groupBy("elem", "row", "g").agg(F.min("col").alias("lo"), (F.max("col") + 1).alias("hi")).drop("g")


def range_bits(elements: DataFrame, found: DataFrame, width: int = 5) -> DataFrame:
    """Bits of each image in range code (C18): a mark, then for each row that has ranges a mark, its number and two ends each."""
    per = found.groupBy("elem").agg(F.count("*").alias("n"), F.countDistinct("row").alias("rows"))
    return elements.select("elem").join(per, "elem", "left").select("elem", ((1 + 2 * F.coalesce("rows", F.lit(0)) + 2 * F.coalesce("n", F.lit(0))) * width).cast("long").alias("n_bits"))


def unflipped(elements_label: DataFrame, found: DataFrame, image: DataFrame, cols: int) -> DataFrame:
    """Images back from ranges and majority images: ``elem, px``."""
    spots = found.select("elem", F.explode(F.sequence(F.col("row") * cols + F.col("lo"), F.col("row") * cols + F.col("hi") - 1)).alias("k"), F.lit(1).alias("on"))
    cells = elements_label.select("elem", "label").join(image, "label").join(spots, ["elem", "k"], "left")
    return cells.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("k", F.col("v").bitwiseXOR(F.coalesce("on", F.lit(0))).alias("v")))).alias("s")).select("elem", F.transform("s", lambda x: x["v"]).alias("px"))
