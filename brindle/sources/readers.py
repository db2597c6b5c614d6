"""Readers that turn array files, tables and generators into element tables, and the sinks beside them.

Array files are read as ``binaryFile`` rows (a task a file) and cut into elements by
Arrow batches; nothing is unpickled.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELEMENT = "layer int, elem long, px array<int>"
#: Elements of an Arrow batch.
BATCH = 2000


def npy_array(raw: bytes) -> np.ndarray:
    """An array of the .npy format, versions 1 to 3; object arrays are refused."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = raw[6] > 1
    size = struct.unpack("<I" if wide else "<H", raw[8 : 12 if wide else 10])[0]
    start = (12 if wide else 10) + size
    head = ast.literal_eval(raw[start - size : start].decode("utf-8" if raw[6] == 3 else "latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("object arrays are not read")
    return np.frombuffer(raw, kind, offset=start, count=int(np.prod(head["shape"], dtype=np.int64))).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def idx_array(raw: bytes) -> np.ndarray:
    """An array of the IDX format (unsigned bytes)."""
    if raw[:3] != b"\0\0\x08":
        raise ValueError("not an IDX file of unsigned bytes")
    n = raw[3]
    shape = struct.unpack(f">{n}I", raw[4 : 4 + 4 * n])
    return np.frombuffer(raw, np.uint8, offset=4 + 4 * n).reshape(shape)


def cifar_array(raw: bytes) -> np.ndarray:
    """Images of the binary CIFAR-10 layout, channels last; labels are the records' first bytes."""
    records = np.frombuffer(raw, np.uint8).reshape(-1, 3073)
    return records[:, 1:].reshape(-1, 3, 32, 32).transpose(0, 2, 3, 1)


def _elements(spark: SparkSession, path: str, read: Callable[[bytes], np.ndarray]) -> DataFrame:
    """``file, elem, px``: elements numbered in each file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = read(content.as_py())
                a = a.reshape(len(a), -1)
                for k in range(0, len(a), BATCH):
                    part = a[k : k + BATCH].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(list(part), pa.list_(pa.int32()))], ["file", "elem", "px"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, elem long, px array<int>")


def _one_layer(df: DataFrame) -> DataFrame:
    """Numbers elements over all files by (file, element)."""
    sizes = df.groupBy("file").agg(F.count("*").alias("n"))
    base = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))  # a row a file
    return df.join(F.broadcast(base), "file").select(F.lit(0).alias("layer"), (F.col("base") + F.col("elem")).alias("elem"), "px")


def npy(spark: SparkSession, path: str) -> DataFrame:
    """Elements of .npy files."""
    return _one_layer(_elements(spark, path, npy_array))


def idx(spark: SparkSession, path: str) -> DataFrame:
    """Elements of IDX files (S3); a label file gives arrays of one value."""
    return _one_layer(_elements(spark, path, idx_array))


def cifar(spark: SparkSession, path: str) -> DataFrame:
    """Images of CIFAR-10 batches in the binary layout."""
    return _one_layer(_elements(spark, path, cifar_array))


# The columns of the census table, in order.
CENSUS = "age INT, workclass STRING, fnlwgt INT, education STRING, education_num INT, marital_status STRING, occupation STRING, relationship STRING, race STRING, sex STRING, capital_gain INT, capital_loss INT, hours_per_week INT, native_country STRING, label STRING"
CONTINUOUS = ("age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week")


def census(spark: SparkSession, path: str) -> DataFrame:
    """The census CSV without header (S5, S6); ``?`` is a category like any other."""
    return spark.read.csv(path, schema=CENSUS, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).filter("age IS NOT NULL")


def census_elements(df: DataFrame) -> DataFrame:
    """The census as numbers (S5, W9): categories by their order."""
    from brindle.operators.order import positions
    from brindle.operators.tabular import categorical

    names = [c.split()[0] for c in CENSUS.split(", ")]
    df = positions(df.withColumn("_at", F.monotonically_increasing_id()), "_at", name="elem").drop("_at")
    for c in names:
        if c not in CONTINUOUS:
            df = categorical(df, c, f"_{c}")
    return df.select(F.lit(0).alias("layer"), "elem", F.array(*(F.col(c if c in CONTINUOUS else f"_{c}") for c in names)).alias("px"))


def synthetic(spark: SparkSession, rows: int, alphabet: int, seed: int = 42) -> DataFrame:
    """Draws from a categorical law that is itself drawn from Dirichlet(1)."""
    w = np.random.default_rng(seed).exponential(size=alphabet)
    ends = np.cumsum(w / w.sum())[:-1].tolist()
    symbol = F.size(F.filter(F.array(*map(F.lit, ends)) if ends else F.array().cast("array<double>"), lambda e: e <= F.col("u")))
    return spark.range(rows).withColumn("u", F.rand(seed)).select(F.lit(0).alias("layer"), F.col("id").alias("elem"), F.array(symbol).alias("px"))


# The literal test images.
GREY = [
    [0, 5, 1, 1, 0, 0, 1, 1, 3, 4, 3, 3, 3, 3, 3, 3],
    [0, 0, 2, 2, 0, 0, 2, 6, 2, 2, 3, 3, 2, 2, 3, 3],
    [1, 1, 1, 1, 1, 1, 1, 1, 3, 3, 9, 9, 3, 3, 9, 9],
    [2, 2, 3, 3, 2, 2, 3, 3, 2, 2, 9, 9, 2, 2, 9, 9],
]


def grey_fixture(spark: SparkSession) -> DataFrame:
    """Four 4 x 4 images."""
    return spark.createDataFrame([(0, k, p) for k, p in enumerate(GREY)], ELEMENT)


def colour_fixture(spark: SparkSession) -> DataFrame:
    """Two images of three constant 4 x 4 planes, 0 to 5."""
    return spark.createDataFrame([(0, k, [3 * k + c for c in range(3) for _ in range(16)]) for k in range(2)], ELEMENT)


def load(spark: SparkSession, dataset: str, path: str | None = None, **options) -> DataFrame:
    """Elements of a data set by name."""
    known: dict[str, Callable[[], DataFrame]] = {
        "test": lambda: grey_fixture(spark), "test-rgb": lambda: colour_fixture(spark), "synthetic": lambda: synthetic(spark, **options),
        "npy": lambda: npy(spark, path), "mnist": lambda: idx(spark, path), "cifar-10": lambda: cifar(spark, path), "adult": lambda: census_elements(census(spark, path)),
    }
    if dataset not in known:
        raise ValueError(f"no data set {dataset!r}; there are {', '.join(known)}")
    return known[dataset]()


def write_rows(df: DataFrame, path: str) -> None:
    """Text rows with ', ' between values."""
    df.select(F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))).write.text(path)


def entropy_log(spark: SparkSession, path: str) -> DataFrame:
    """Entropy logs as a table (S22): ``file, color, patch, mst, random``; a COLOR or PATCH line holds for the lines after it."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    value = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    log = Window.partitionBy("file").orderBy("at")
    held = lines.withColumns({"color": F.last(value(r"^COLOR (\d+)"), True).over(log), "patch": F.last(value(r"^PATCH (\d+)"), True).over(log), "mst": value(r"^MST Entropy: (\S+)"), "random": value(r"^Random Entropy: (\S+)")})
    found = held.filter("mst IS NOT NULL OR random IS NOT NULL").groupBy("file", F.coalesce("color", F.lit("0")).cast("int").alias("color"), F.col("patch").cast("int").alias("patch"))
    return found.agg(F.max("mst").cast("double").alias("mst"), F.max("random").cast("double").alias("random"))


def log_averages(log: DataFrame) -> DataFrame:
    """Mean entropies of each colour."""
    return log.groupBy("color").agg(F.avg("mst").alias("mst"), F.avg("random").alias("random"))
