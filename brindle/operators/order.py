"""Global order without a one-task window: dense positions, and neighbours by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import parallelism, stored


def positions(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Adds the position of each row in a global order, from 0.

    Ranges of the order are sorted apart and numbered inside; the counts of the ranges
    (one row each) give each range its first position.
    """
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    held = stored(ranged.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_m", 33).alias("_part")
    base = held.groupBy(part).agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    numbered = held.withColumn("_part", part).join(F.broadcast(base), "_part")
    return numbered.withColumn(name, F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_part", "_m", "_base")


def with_previous(df: DataFrame, columns: list[str], back: int = 1, pos: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<column>_<back>``: the values ``back`` positions before (null where there are none).

    A join on the position, so the order may be as long as the data.
    """
    before = df.select(*by, (F.col(pos) + back).alias(pos), *(F.col(c).alias(f"{c}_{back}") for c in columns))
    return df.join(before, [*by, pos], "left")


def running_sums(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), pos: str = "pos", size: int = 4096) -> DataFrame:
    """Adds ``<column>_sum``: sums up to and with each position, in each group of ``by``.

    Two levels: ranges of ``size`` positions have their sums, ranges before a range are
    added up over those, and rows are only added up inside their range.
    """
    rows = df.withColumn("_r", F.floor(F.col(pos) / size))
    total = rows.groupBy(*by, "_r").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.partitionBy(*by).orderBy("_r") if by else Window.orderBy("_r")  # a row a range
    total = total.select(*by, "_r", *((F.sum(f"_{c}").over(before) - F.col(f"_{c}")).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy(*by, "_r").orderBy(pos)
    rows = rows.withColumns({f"{c}_sum": F.sum(c).over(inside) for c in columns}).join(total, [*by, "_r"])
    return rows.withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"_{c}") for c in columns}).drop("_r", *(f"_{c}" for c in columns))
