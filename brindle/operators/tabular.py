"""Tables column by column: value counts, codes, Lloyd-Max quantization, Huffman codes and their decoding.

A coded value is a symbol: ``=`` and the value as text, ``~`` for null, ``!`` for a value that
is too rare for a column's alphabet and kept in full, ``.`` for the end of a column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import codes
from brindle.operators.codes import bit_total, codebook
from brindle.operators.order import positions
from brindle.storage import stored

NULL, RARE, END = "~", "!", "."
#: Bins of a quantizer, and starts of which the best is taken.
BINS, STARTS = 16, 64
#: Values of a histogram that one task may work on alone.
ALONE = 1_000_000
#: Fixed: a multiplicative hash of 32 bits.
_MIX = 2654435761


def symbol_of(x: Column) -> Column:
    """A value as a symbol; a null and the text 'None' are two."""
    return F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit(NULL))


def column_values(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """One row a value: ``keep..., column, symbol``."""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), symbol_of(F.col(c)).alias("symbol")) for c in columns))))


def column_value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of every column in one pass (A2): ``column, symbol, n``."""
    return column_values(df, columns).groupBy("column", "symbol").agg(F.count("*").alias("n"))


def categorical(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Codes of values in their order (W9); the values are few and numbered by themselves, not row by row."""
    values = positions(df.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").distinct(), "_v", name=name)
    return df.join(values.withColumn(name, F.col(name).cast("int")), F.col(column) == F.col("_v"), "left").drop("_v")


def huffman_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Symbols, values and code bits of each column."""
    return bit_total(codebook(column_value_counts(df, columns), "column"), "column")


def midpoints(a: list[float]) -> list[float]:
    """Bounds between centroids (L3)."""
    return [(x + y) / 2 for x, y in zip(a, a[1:])]


def bin_of(x: Column, bounds: list[float]) -> Column:
    """Number of the bin: bounds[j - 1] < x <= bounds[j]."""
    out = F.lit(0)
    for b in bounds:
        out = out + (x > F.lit(float(b))).cast("int")
    return out


def lloyd_step(histogram: DataFrame, a: list[float]) -> DataFrame:
    """One round on ``value, n`` (L1): ``j, a, n, total, new_a, sq``; new_a is the mean rounded half to even."""
    j = bin_of(F.col("value"), midpoints(a))
    at = F.array(*(F.lit(float(x)) for x in a))
    rows = histogram.withColumn("j", j).withColumn("a", at[F.col("j")])
    d = F.col("value") - F.col("a")
    return rows.groupBy("j", "a").agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total"), F.bround(F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("new_a"), F.sum(d * d * F.col("n")).alias("sq"))


def starts(histogram: DataFrame, m: int, many: int = STARTS) -> list[list[float]]:
    """For each start m distinct values, ascending: one of each m-th of the ranks, by a hash of start and place.

    With fewer than m values, all of them.  Ranks are looked up in Spark, so no more than
    ``many * m`` values come to the driver.
    """
    ranked = stored(positions(histogram.select("value").distinct(), "value", name="rank"), "ranked")
    n = ranked.count()
    m = min(m, n)
    at = [[(i * (1 << 32) + (s * m + i + 1) * _MIX % (1 << 32)) * n // (m << 32) for i in range(m)] for s in range(many)]
    wanted = histogram.sparkSession.createDataFrame([(r,) for r in sorted({r for x in at for r in x})], "rank long")
    value = {r["rank"]: r["value"] for r in ranked.join(F.broadcast(wanted), "rank").collect()}  # many * m rows
    return [[float(value[r]) for r in x] for x in at]


def _sums(value: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Counts, totals and squared errors of each bin of centroids a."""
    j = np.searchsorted((a[:-1] + a[1:]) / 2, value, side="left")
    d = value - a[j]
    return np.array([np.bincount(j, w, len(a)) for w in (n, value * n, d * d * n)])


def _round(a: np.ndarray, sums: np.ndarray, best: float, gain: float) -> tuple[np.ndarray, float, bool]:
    """Centroids and error after a round, and whether the run is over; -1 where a bin runs empty."""
    n, total, sq = sums
    if (n == 0).any():
        return a, -1.0, True
    mse = sq.sum() / n.sum()
    if best - mse < gain:
        return a, mse, True
    return np.sort(np.round(total / n)), mse, False  # half to even


def lloyd_max(histogram: DataFrame, first: list[list[float]], gain: float = 1e-5) -> list[tuple[list[float], float]]:
    """Centroids and mean squared error of a run from each start (L1), all runs at once; an error of -1 where a bin runs empty.

    Runs depend on the histogram (``value, n``) alone.  One with at most ``ALONE`` values goes
    to one task for all rounds; beyond that a round of all runs is one aggregate over it.
    """
    spark = histogram.sparkSession
    rows = histogram.select(F.col("value").cast("double"), F.col("n").cast("double"))
    if histogram.count() <= ALONE:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            out = []
            if both:
                value, n = (np.concatenate(x) for x in zip(*both, strict=True))
                order = np.argsort(value, kind="stable")
                value, n = value[order], n[order]
                for k, start in enumerate(first):
                    a, best, over = np.array(start), float("inf"), False
                    while not over:
                        a, best, over = _round(a, _sums(value, n, a), best, gain)
                    out.append({"run": k, "a": a.tolist(), "mse": best})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("run", pa.int32()), ("a", pa.list_(pa.float64())), ("mse", pa.float64())]))

        found = rows.coalesce(1).mapInArrow(alone, "run int, a array<double>, mse double").collect()  # a row a start
        return [(r["a"], r["mse"]) for r in sorted(found, key=lambda r: r["run"])]
    state = {k: (np.array(a), float("inf")) for k, a in enumerate(first)}
    done: dict[int, tuple[list[float], float]] = {}
    while state:
        held = {k: a for k, (a, _) in state.items()}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((3, len(a))) for k, a in held.items()}
            for b in batches:
                for k, a in held.items():
                    total[k] += _sums(b.column(0).to_numpy(), b.column(1).to_numpy(), a)
            yield pa.RecordBatch.from_pylist([{"run": k, "j": j, "n": x[0], "total": x[1], "sq": x[2]} for k, t in total.items() for j, x in enumerate(t.T.tolist())], pa.schema([("run", pa.int32()), ("j", pa.int32()), ("n", pa.float64()), ("total", pa.float64()), ("sq", pa.float64())]))

        found = {k: np.zeros((3, len(a))) for k, a in held.items()}
        for r in rows.mapInArrow(sums, "run int, j int, n double, total double, sq double").groupBy("run", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("sq").alias("sq")).collect():  # centroids of all runs
            found[r["run"]][:, r["j"]] = r["n"], r["total"], r["sq"]
        for k, t in found.items():
            a, mse, over = _round(state[k][0], t, state[k][1], gain)
            if over:
                done[k] = a.tolist(), mse
                del state[k]
            else:
                state[k] = a, mse
    return [done[k] for k in range(len(first))]


def best_of(histogram: DataFrame, m: int = BINS, many: int = STARTS) -> tuple[list[float], float]:
    """The least error of several starts, ties to the first start (L4); where every run has an empty bin, fewer bins."""
    histogram = stored(histogram, "histogram")
    while m:
        found = [r for r in lloyd_max(histogram, starts(histogram, m, many)) if r[1] >= 0]
        if found:
            return min(found, key=lambda r: r[1])
        m -= 1
    return [], 0.0


# -- containers

def compress_table(df: DataFrame, path: str, quantized: list[str] | tuple[str, ...] = (), bins: int = BINS, many: int = STARTS) -> None:
    """Writes a table's columns as Huffman streams (C17, S12): ``meta, book, blocks`` and ``rare``.

    Rows keep their order.  Columns in ``quantized`` are numbers, of which only the nearest of
    ``bins`` centroids is kept (L1 to L4), counts of equal centroids merged; nulls stay null.
    All other columns come back exactly, so they must be of types that a text gives back.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for c, k in kinds.items():
        if any(x in k for x in ("array", "map", "struct", "binary")):
            raise ValueError(f"column {c!r} of type {k} is not a text's")
    spark = df.sparkSession
    columns = list(kinds)
    rows = stored(positions(df.withColumn("_row", F.monotonically_increasing_id()), "_row", name="_pos").drop("_row"), "rows")
    centroids = {}
    for c in quantized:
        histogram = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("value")).agg(F.count("*").alias("n"))
        centroids[c], _ = best_of(histogram, bins, many)
        if centroids[c]:
            at = F.array(*(F.lit(x) for x in centroids[c]))[bin_of(F.col(c).cast("double"), midpoints(centroids[c]))]
            rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), at.cast(kinds[c])))
    values = stored(column_values(rows, columns, "_pos"), "values")
    freqs = stored(values.groupBy("column", "symbol").agg(F.count("*").alias("n")), "freqs")
    # the least count of which, and above, an alphabet holds all symbols
    above = F.sum("s").over(Window.partitionBy("column").orderBy(F.desc("n")))
    least = freqs.groupBy("column", "n").agg(F.count("*").alias("s")).withColumn("above", above)  # a row a column and count
    least = least.groupBy("column").agg(F.min(F.when(F.col("above") <= codes.ALPHABET - 2, F.col("n"))).alias("least"))
    known = freqs.join(F.broadcast(least), "column").select("column", F.when(F.col("n") >= F.coalesce("least", F.col("n") + 1), F.col("symbol")).otherwise(RARE).alias("symbol"), "n")
    ends = spark.createDataFrame([(c, END, 0) for c in columns], "column string, symbol string, n long")
    book = codebook(known.groupBy("column", "symbol").agg(F.sum("n").alias("n")).unionByName(ends), "column")
    coded = values.join(F.broadcast(book.select("column", "symbol", "len", "code")), ["column", "symbol"], "left")
    rare = F.broadcast(book.filter(F.col("symbol") == RARE).select("column", F.col("len").alias("rare_len"), F.col("code").alias("rare_code")))
    words = coded.join(rare, "column", "left").select("column", F.col("_pos").alias("pos"), F.coalesce("len", "rare_len").alias("len"), F.coalesce("code", "rare_code").alias("code"))
    coded.filter("len IS NULL").select("column", F.col("_pos").alias("pos"), "symbol").write.parquet(f"{path}/rare")
    n = rows.count()
    last = book.filter(F.col("symbol") == END).select("column", F.lit(n).cast("long").alias("pos"), "len", "code")
    codes.packed(words.unionByName(last), "pos", 4096, "column").write.parquet(f"{path}/blocks")
    book.write.parquet(f"{path}/book")
    meta = {"columns": kinds, "centroids": centroids, "rows": n}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")


def decompress_table(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """The table of a container, in columns of their types; ``position`` adds each row's position.

    A column's stream ends with its end symbol; one that does not is refused.
    """
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    values = codes.decoded(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/book"), "column")
    ended = {r["column"] for r in values.filter((F.col("symbol") == END) & (F.col("pos") == meta["rows"])).select("column").collect()}  # a row a column
    if ended != set(meta["columns"]):
        raise ValueError(f"no end of {', '.join(sorted(set(meta['columns']) - ended))}")
    rare = spark.read.parquet(f"{path}/rare").select("column", "pos", F.col("symbol").alias("full"))
    values = values.filter(F.col("symbol") != END).join(rare, ["column", "pos"], "left").select("column", "pos", F.coalesce("full", "symbol").alias("symbol"))
    value = F.when(F.col("symbol") != NULL, F.substring("symbol", F.lit(2), F.length("symbol")))
    rows = values.groupBy("pos").agg(*(F.max(F.when(F.col("column") == c, value)).cast(k).alias(c) for c, k in meta["columns"].items()))
    return rows.select(*meta["columns"], *([F.col("pos").alias(position)] if position else []))
