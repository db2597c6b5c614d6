"""Predictive coding: linear, rule and logistic models on causal contexts, errors and their decoding.

Fits reduce to exact integer sums, which Spark aggregates; encoder and decoder apply
the same expression order, so a prediction never differs between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.pixels import clipped, wrapped


def gram(features: DataFrame, d: int, *by: str) -> DataFrame:
    """Entries of X'X and X'y as exact integers (M2): ``by..., i, j, v``; place d is the constant 1 and d + 1 is y."""
    z = F.concat(F.col("x"), F.array(F.lit(1), F.col("y")))
    sums = features.select(*by, *(z[i].cast("long").alias(f"z{i}") for i in range(d + 2)))
    cells = [(i, j) for i in range(d + 2) for j in range(i, d + 2)]
    one = sums.groupBy(*by).agg(*(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in cells))
    return one.select(*by, F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(F.col(f"s{i}_{j}"), F.lit(0)).alias("v")) for i, j in cells))))


def linear_models(features: DataFrame, d: int, by: str) -> dict[object, list[float]]:
    """A least-squares model (coefficients, then intercept) for each value of a column of few values (M1)."""
    sums: dict[object, np.ndarray] = {}
    for r in gram(features, d, by).collect():  # (d + 2)(d + 3) / 2 rows a value
        m = sums.setdefault(r[by], np.zeros((d + 2, d + 2)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return {k: np.linalg.lstsq(m[: d + 1, : d + 1], m[: d + 1, d + 1], rcond=None)[0].tolist() for k, m in sums.items()}


def linear_model(features: DataFrame, d: int) -> list[float]:
    """Least-squares coefficients and intercept, from the sums (minimum norm where they are singular)."""
    found = linear_models(features.withColumn("_all", F.lit(0)), d, "_all")
    return found.get(0, [0.0] * (d + 1))


def linear(x: Column, model: list[float]) -> Column:
    """The model's value, summed from the first feature to the intercept."""
    total = F.lit(0.0)
    for k, w in enumerate(model[:-1]):
        total = total + x[k] * F.lit(float(w))
    return total + F.lit(float(model[-1]))


def linear_values(model: list[float], x: np.ndarray) -> np.ndarray:
    """The same of rows of features, in the same order."""
    total = np.zeros(len(x))
    for k, w in enumerate(model[:-1]):
        total = total + x[:, k] * float(w)
    return total + float(model[-1])


def errors(features: DataFrame, value: Column) -> DataFrame:
    """Clipped and truncated predictions and wrapped errors (M5)."""
    return features.withColumn("p", clipped(value)).withColumn("e", wrapped(F.col("y") - F.col("p")))


def rules_value(x: Column, rules: list[tuple[list[tuple[int, str, float]], list[float]]]) -> Column:
    """Mean of the linear models whose conditions hold (M6, J14); none: 0.

    rules: ([(feature, '<=' or '>', threshold), ...], coefficients and intercept).
    """
    total, count = F.lit(0.0), F.lit(0)
    for conditions, model in rules:
        holds = F.lit(True)
        for k, op, t in conditions:
            if op not in ("<=", ">"):
                raise ValueError(f"no comparison {op!r}")
            holds = holds & (x[k] <= F.lit(t) if op == "<=" else x[k] > F.lit(t))
        total = total + F.when(holds, linear(x, model)).otherwise(0.0)
        count = count + holds.cast("int")
    return F.when(count > 0, total / count).otherwise(0.0)


def model_tree(features: DataFrame, d: int, depth: int = 2) -> list:
    """Rules from a regression tree's splits with a least-squares model in each leaf (M4, published M5 scheme)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    flat = features.select(*(F.col("x")[k].cast("double").alias(f"f{k}") for k in range(d)), F.col("y").cast("double").alias("label"), "x", "y")
    data = VectorAssembler(inputCols=[f"f{k}" for k in range(d)], outputCol="features").transform(flat)
    tree = DecisionTreeRegressor(maxDepth=depth, seed=1).fit(data)
    rules: list = []

    def walk(node, conditions: list) -> None:
        if node.numDescendants() == 0:
            part = features
            for k, op, t in conditions:
                part = part.filter(F.col("x")[k] <= t if op == "<=" else F.col("x")[k] > t)
            rules.append((conditions, linear_model(part, d)))
            return
        k, t = node.split().featureIndex(), node.split().threshold()
        walk(node.leftChild(), [*conditions, (k, "<=", t)])
        walk(node.rightChild(), [*conditions, (k, ">", t)])

    walk(tree._call_java("rootNode"), [])
    return rules


def logistic_model(features: DataFrame, d: int, iterations: int = 20) -> dict:
    """A multinomial logistic model of one class a pixel value (M3; deterministic, unlike stochastic descent): ``coef, intercept``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = features.withColumns({"features": array_to_vector(F.transform("x", lambda v: v / 255.0)), "label": F.col("y").cast("double")})
    model = LogisticRegression(maxIter=iterations, regParam=0.001, family="multinomial").fit(data)
    return {"coef": model.coefficientMatrix.toArray().tolist(), "intercept": model.interceptVector.toArray().tolist()}


def logistic_values(model: dict, x: np.ndarray) -> np.ndarray:
    """The likeliest class of rows of features, ties to the least; sums go in a fixed order, so they do not depend on the rows beside."""
    coef, margin = np.array(model["coef"]), np.tile(np.array(model["intercept"]), (len(x), 1))
    for k in range(coef.shape[1]):
        margin = margin + (x[:, k, None] / 255.0) * coef[None, :, k]
    return margin.argmax(axis=1).astype(np.int32)


def logistic_predictions(features: DataFrame, d: int, iterations: int = 20) -> DataFrame:
    """Adds ``p``: the class that the logistic model of these features gives them."""
    model = logistic_model(features, d, iterations)
    kinds = features.schema
    names = [f.name for f in kinds]
    at = names.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logistic_values(model, x))], [*names, "p"])

    return features.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("p", T.IntegerType())]))


def decode_linear(first: DataFrame, coded: DataFrame, edges: DataFrame, rows: int, cols: int, current: list, previous: list, n_previous: int, model: list[float]) -> DataFrame:
    """Replays predictions pixel by pixel (M8, M10): ``pos, px``.

    first: ``pos, px`` of images kept whole; coded: ``pos, r, c, e``; edges: ``pos, r, c, v``.  Each image
    needs the ones before it, so a chain has one task; shorter chains (a restart every so many
    images) run side by side by a ``chain`` column in all three.
    """
    rows_in = coded.select("chain", "pos", "r", "c", F.col("e").alias("v"), F.lit(1).alias("kind"))
    rows_in = rows_in.unionByName(edges.select("chain", "pos", "r", "c", "v", F.lit(0).alias("kind")))
    rows_in = rows_in.unionByName(first.select("chain", "pos", F.posexplode("px").alias("k", "v")).select("chain", "pos", F.floor(F.col("k") / cols).cast("int").alias("r"), F.pmod("k", F.lit(cols)).alias("c"), "v", F.lit(0).alias("kind")))

    def replay(g: pd.DataFrame) -> pd.DataFrame:
        images: dict[int, np.ndarray] = {}
        for pos, part in g.groupby("pos"):
            img, code = np.zeros((rows, cols), int), {}
            for r, c, v, kind in zip(part["r"], part["c"], part["v"], part["kind"]):
                if kind:
                    code[r, c] = v
                else:
                    img[r, c] = v
            for (r, c), e in sorted(code.items()):
                x = [img[r + i, c + j] for i, j in current] + [images[pos - a][r + i, c + j] for a in range(1, n_previous + 1) for i, j in previous]
                total = 0.0
                for value, w in zip(x, model):
                    total = total + float(value) * w
                p = int(max(min(total + model[-1], 255), 0))
                img[r, c] = (e + p) % 256
            images[pos] = img
        return pd.DataFrame({"pos": list(images), "px": [i.ravel().tolist() for i in images.values()]})

    return rows_in.groupBy("chain").applyInPandas(replay, "pos long, px array<int>")


def accuracy(predicted: DataFrame) -> DataFrame:
    """Share of exact hits."""
    return predicted.agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def compressed_size(df: DataFrame, column: str, level: int = 9) -> DataFrame:
    """Adds gzip (level 9), bz2 (9) and xz (preset 6) sizes of a text column's values (S20); a null counts as empty."""
    import bz2
    import gzip
    import lzma

    names = [f.name for f in df.schema if f.name != column]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column), "raw long, gz long, bz2 long, xz long"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(len(names)).to_pylist()]
            cols = [[len(r) for r in raw], [len(gzip.compress(r, level, mtime=0)) for r in raw], [len(bz2.compress(r)) for r in raw], [len(lzma.compress(r, preset=6)) for r in raw]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, pa.int64()) for c in cols)], [*names, "raw", "gz", "bz2", "xz"])

    return df.select(*names, column).mapInArrow(sizes, ddl)


def med_errors(px: Column, cols: int) -> Column:
    """Errors of the median edge detector, as non-negative numbers (S21): 0, -1, 1, -2, ... become 0, 1, 2, 3, ...

    A neighbour outside the image is 0; errors wrap to -128 to 127.
    """

    def error(v: Column, i: Column) -> Column:
        left, up = F.pmod(i, F.lit(cols)) > 0, i >= cols
        a = F.when(left, F.get(px, i - 1)).otherwise(0)
        b = F.when(up, F.get(px, i - cols)).otherwise(0)
        c = F.when(left & up, F.get(px, i - cols - 1)).otherwise(0)
        p = F.when(c >= F.greatest(a, b), F.least(a, b)).when(c <= F.least(a, b), F.greatest(a, b)).otherwise(a + b - c)
        e = F.pmod(v - p + 128, F.lit(256)) - 128
        return F.when(e < 0, -2 * e - 1).otherwise(2 * e).cast("int")

    return F.transform(px, error)


def rice_bits(values: Column, most: int = 7) -> Column:
    """The fewest bits of non-negative numbers under Golomb codes of 2 ** j for j up to ``most``, three bits for j among them."""

    def bits(j: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda t, x: t + F.shiftright(x, j) + 1 + j)

    return F.least(*map(bits, range(most + 1))) + 3
