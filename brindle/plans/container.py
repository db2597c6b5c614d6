"""Compressing element tables into a container and back: preprocessing, order, deltas or predictions, codes.

A container is a directory of Parquet tables: ``meta`` (a row), ``order``, ``first`` (elements kept
whole), ``book`` and ``blocks`` (Huffman), or ``coo``; all of them plain columns, read by any tool.
Predictive containers are described in ``predictive``.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.pixels import wrapped, wrapped_difference
from brindle.operators import codes, graph, shape, transforms
from brindle.operators.order import positions, running_sums, with_previous
from brindle.plans import predictive
from brindle.storage import stored

ORDERS = ("mst", "diameter", "chain", "id")
ENCODERS = ("delta-huff", "delta-coo", *predictive.ENCODERS)
PREPROCESSORS = ("none", "sqpatch", "rgb", "rgb-sqpatch", "dict")


def preprocess(elements: DataFrame, how: str = "none", side: int = 28, patch: int = 4, words: int = 12) -> tuple[DataFrame, dict]:
    """Elements as a preprocessor makes them, and what undoes it (P1); ``side`` is an image's, or a channel's.

    ``dict`` keeps integer codes of a learned dictionary: a loss, as in the published scheme.
    """
    if how not in PREPROCESSORS:
        raise ValueError(f"no preprocessor {how!r}; there are {', '.join(PREPROCESSORS)}")
    state = {"how": how, "side": side, "patch": patch}
    if how in ("rgb", "rgb-sqpatch"):
        elements = shape.channels(elements, side * side)
    if how in ("sqpatch", "rgb-sqpatch"):
        elements = shape.patches(elements, side, patch)
    if how == "dict":
        learned = transforms.learned_dictionary(elements, words)
        coded = transforms.dictionary_code(elements, learned, whole_codes=True)
        elements = coded.select(F.lit(0).alias("layer"), "elem", F.transform("code", lambda x: F.least(x, F.lit(255.0)).cast("int")).alias("px"))
        state["words"] = learned.tolist()
    return elements.select("layer", "elem", "px"), state


def postprocess(elements: DataFrame, state: dict) -> DataFrame:
    """The elements before ``preprocess`` (for ``dict``: the product of codes and words)."""
    if state["how"] in ("sqpatch", "rgb-sqpatch"):
        elements = shape.whole(elements, state["side"], state["patch"])
    if state["how"] in ("rgb", "rgb-sqpatch"):
        elements = shape.merged_channels(elements)
    if state["how"] == "dict":
        coded = elements.withColumn("code", F.transform("px", lambda x: x.cast("double")))
        elements = transforms.reconstructed(coded, np.array(state["words"])).select("layer", "elem", F.col("back").alias("px"))
    return elements.select("layer", "elem", "px")


def order_elements(elements: DataFrame, how: str = "mst", metric: str = "l2") -> DataFrame:
    """``layer, pos, elem`` for every element; equal elements stand together."""
    if how not in ORDERS:
        raise ValueError(f"no order {how!r}; there are {', '.join(ORDERS)}")
    if how == "id":
        numbered = positions(elements.select("layer", "elem"), "layer", "elem", name="all")
        first = numbered.groupBy("layer").agg(F.min("all").alias("first"))
        return numbered.join(F.broadcast(first), "layer").select("layer", (F.col("all") - F.col("first")).alias("pos"), "elem")
    out = None
    for layer in sorted(r["layer"] for r in elements.select("layer").distinct().collect()):  # layers are few
        own = elements.filter(F.col("layer") == layer)
        reps = stored(own.groupBy("layer", "px").agg(F.min("elem").alias("elem")), "reps")
        n = reps.count()
        if n < 3:
            order = reps.select("layer", F.row_number().over(Window.partitionBy("layer").orderBy("elem")).cast("long").alias("p"), "elem").select("layer", (F.col("p") - 1).alias("pos"), "elem")
        else:
            edges, _ = graph.escalated_knn(reps, metric=metric, n=n)
            if how == "chain":
                order = graph.greedy_chain(edges)
            else:
                tree = graph.spanning_forest(edges).withColumn("layer", F.lit(layer))
                order = graph.ordered_by_tree(tree, "depth_first" if how == "mst" else "diameter").select("layer", "pos", "elem")
        placed = graph.padded(stored(order, "order"), own)
        out = placed if out is None else out.unionByName(placed)
    return out


def compress(elements: DataFrame, path: str, order: str = "mst", encoder: str = "delta-huff", metric: str = "l2", settings: predictive.Settings | None = None, family: str = "linear", model: dict | None = None, features: DataFrame | None = None) -> None:
    """Writes the container of an element table.

    Predictive encoders need ``settings``, and take one layer of whole images; see ``predictive.compress``
    for ``family``, ``model`` and ``features``.
    """
    if encoder not in ENCODERS:
        raise ValueError(f"no encoder {encoder!r}; there are {', '.join(ENCODERS)}")
    spark = elements.sparkSession
    elements = stored(elements.select("layer", "elem", "px"), "elements")
    place = stored(order_elements(elements, order, metric), "order")
    if encoder in predictive.ENCODERS:
        if settings is None:
            raise ValueError(f"{encoder} needs settings")
        if not elements.filter("layer <> 0").isEmpty():
            raise ValueError(f"{encoder} takes one layer")
        placed = stored(place.join(elements, ["layer", "elem"]).select("pos", "elem", "px"), "placed")
        predictive.compress(placed, path, settings, encoder, family, model, features)
        return
    d = elements.select(F.size("px").alias("d")).first()
    points = d["d"] if d else 0
    placed = place.join(elements, ["layer", "elem"]).select("layer", "pos", "px")
    place.write.parquet(f"{path}/order")
    placed.filter("pos = 0").write.parquet(f"{path}/first")
    delta = with_previous(placed, ["px"], 1, "pos", ("layer",)).filter("pos > 0").select("layer", "pos", wrapped_difference(F.col("px"), F.col("px_1")).alias("d"))
    cells = delta.select("layer", "pos", F.posexplode("d").alias("k", "symbol"))
    if encoder == "delta-coo":
        cells.filter("symbol <> 0").write.parquet(f"{path}/coo")
    else:
        symbols = stored(cells.select("layer", ((F.col("pos") - 1) * points + F.col("k")).alias("pos"), "symbol"), "symbols")
        book = codes.codebook(codes.frequencies(symbols, "layer"), "layer")
        book.write.parquet(f"{path}/book")
        codes.packed(codes.encoded(symbols, book, "layer"), "pos", 4096, "layer").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps({"points": points, "order": order, "encoder": encoder, "metric": metric}),)], "meta string").write.parquet(f"{path}/meta")


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """The element table of a container."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if meta.get("kind") == "predictive":
        return predictive.decompress(spark, path).select(F.lit(0).alias("layer"), "elem", "px")
    points = meta["points"]
    place = spark.read.parquet(f"{path}/order")
    first = spark.read.parquet(f"{path}/first").select("layer", "pos", F.posexplode("px").alias("k", "d"))
    if meta["encoder"] == "delta-coo":
        d = spark.read.parquet(f"{path}/coo").select("layer", "pos", "k", F.col("symbol").alias("d"))
        # places without a change are not in the table
        cells = place.filter("pos > 0").select("layer", "pos", F.explode(F.sequence(F.lit(0), F.lit(max(points - 1, 0)))).alias("k"))
        d = cells.join(d, ["layer", "pos", "k"], "left").fillna(0, ["d"])
    else:
        symbols = codes.decoded(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/book"), "layer")
        d = symbols.select("layer", (1 + F.floor(F.col("pos") / points)).alias("pos"), F.pmod("pos", F.lit(points)).cast("int").alias("k"), F.col("symbol").alias("d"))
    cells = running_sums(first.unionByName(d), ["d"], ("layer", "k"))
    rows = cells.withColumn("v", wrapped(F.col("d_sum"))).groupBy("layer", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))
    return rows.join(place, ["layer", "pos"]).select("layer", "elem", F.transform("s", lambda x: x["v"]).alias("px"))


def recode(spark: SparkSession, path: str, to: str, encoder: str) -> None:
    """Decodes a container and writes it with another encoder in the same kind of order; predictive streams stay predictive."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if meta.get("kind") == "predictive":
        predictive.recode(spark, path, to, encoder)
        return
    compress(decompress(spark, path), to, meta["order"], encoder, meta["metric"])


def differences(a: DataFrame, b: DataFrame) -> int:
    """Rows that two element tables do not share, as multisets."""
    columns = ["layer", "elem", "px"]
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).count() + b.exceptAll(a).count()
