"""Reshapes of elements: patches, channels, scans, contexts.

``elements(layer INT, elem BIGINT, px ARRAY<INT>)``, arrays row-major.  Everything here is
an array expression on the row, so no reshape shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.pixels import pixel

# Offsets (row, column) of the causal neighbours, in order.
CONTEXTS = {
    "DAB": [(0, -1), (-1, -1), (-1, 0)],
    "DABC": [(0, -1), (-1, -1), (-1, 0), (-1, 1)],
    "DABX": [(0, -1), (-1, -1), (-1, 0), (0, 0)],
}


def images(embeddings: DataFrame) -> DataFrame:
    """Embeddings as grey images: ``layer, elem, label, px``; null vectors are left out."""
    return embeddings.filter("embedding IS NOT NULL").select(F.lit(0).alias("layer"), F.col("vec_id").alias("elem"), "label", F.transform("embedding", pixel).alias("px"))


def gather(px: Column, at: list[int]) -> Column:
    """Array of the values at fixed places."""
    return F.array(*(px[i] for i in at))


def patches(elements: DataFrame, side: int, patch: int) -> DataFrame:
    """Square images to square patches, a layer each."""
    if side % patch:
        raise ValueError(f"{patch} does not divide {side}")
    n = side // patch
    cut = [gather(F.col("px"), [(r * patch + i) * side + c * patch + j for i in range(patch) for j in range(patch)]) for r in range(n) for c in range(n)]
    return elements.select("*", F.posexplode(F.array(*cut)).alias("_k", "_p")).withColumns({"layer": F.col("layer") * (n * n) + F.col("_k"), "px": F.col("_p")}).drop("_k", "_p")


def whole(elements: DataFrame, side: int, patch: int) -> DataFrame:
    """Patches back to images (P3): ``layer, elem, px``."""
    n = side // patch
    place = [((r % patch) * patch + c % patch, (r // patch) * n + c // patch) for r in range(side) for c in range(side)]
    rows = elements.groupBy(F.floor(F.col("layer") / (n * n)).cast("int").alias("layer"), "elem").agg(F.array_sort(F.collect_list(F.struct(F.pmod("layer", F.lit(n * n)).alias("k"), "px"))).alias("_p"))
    return rows.select("layer", "elem", F.array(*(F.col("_p")[k]["px"][i] for i, k in place)).alias("px"))


def channels(elements: DataFrame, size: int, n: int = 3) -> DataFrame:
    """Planes of ``size`` values each to a layer each."""
    return elements.select("*", F.posexplode(F.array(*(F.slice("px", c * size + 1, size) for c in range(n)))).alias("_k", "_p")).withColumns({"layer": F.col("layer") * n + F.col("_k"), "px": F.col("_p")}).drop("_k", "_p")


def merged_channels(elements: DataFrame, n: int = 3) -> DataFrame:
    """Layers back to planes of one array (P5)."""
    rows = elements.groupBy(F.floor(F.col("layer") / n).cast("int").alias("layer"), "elem").agg(F.array_sort(F.collect_list(F.struct(F.pmod("layer", F.lit(n)).alias("k"), "px"))).alias("_p"))
    return rows.select("layer", "elem", F.flatten(F.transform("_p", lambda p: p["px"])).alias("px"))


def zigzag(rows: int, cols: int) -> list[int]:
    """Row-major places in zig-zag order: diagonals in turn, even ones upwards."""
    return [r * cols + c for r, c in sorted(((r, c) for r in range(rows) for c in range(cols)), key=lambda p: (p[0] + p[1], -p[0] if (p[0] + p[1]) % 2 == 0 else p[0]))]


def valid(rows: int, cols: int, *contexts: str) -> tuple[range, range]:
    """Rows and columns at which all contexts lie inside the image."""
    offsets = [o for c in contexts for o in CONTEXTS[c]]
    return range(max(0, *(-r for r, _ in offsets)), rows - max(0, *(r for r, _ in offsets))), range(max(0, *(-c for _, c in offsets)), cols - max(0, *(c for _, c in offsets)))


def features(ordered: DataFrame, rows: int, cols: int, current: str, previous: str, n_previous: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Context features of every valid pixel (P17): ``by..., pos, r, c, x, y``.

    ordered: ``by..., pos, px`` with dense positions in each group of ``by``.  Previous images come by a join on the position.
    """
    from brindle.operators.order import with_previous

    df = ordered.select(*by, "pos", "px")
    held = df
    for a in range(1, n_previous + 1):
        df = df.join(with_previous(held, ["px"], a, "pos", by).select(*by, "pos", f"px_{a}"), [*by, "pos"])
    used = [current] + [previous] * bool(n_previous)
    rs, cs = valid(rows, cols, *used)
    cells = []
    for r in rs:
        for c in cs:
            x = [F.col("px")[(r + i) * cols + c + j] for i, j in CONTEXTS[current]] + [F.col(f"px_{a}")[(r + i) * cols + c + j] for a in range(1, n_previous + 1) for i, j in CONTEXTS[previous]]
            cells.append(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.array(*x).alias("x"), F.col("px")[r * cols + c].alias("y")))
    return df.filter(F.col("pos") >= n_previous).select(*by, "pos", F.inline(F.array(*cells)))


def border(ordered: DataFrame, rows: int, cols: int, current: str, previous: str, n_previous: int) -> DataFrame:
    """Residual pixels in their order (M7): ``pos, band, r, c, v``: the first images whole, then top, left, bottom, right."""
    rs, cs = valid(rows, cols, current, *[previous] * bool(n_previous))
    cells = []
    for r in range(rows):
        for c in range(cols):
            band = 1 if r < rs.start else 3 if r >= rs.stop else 2 if c < cs.start else 4 if c >= cs.stop else None
            cells.append((r, c, band))
    all_cells = F.array(*(F.struct(F.lit(b).cast("int").alias("band"), F.lit(r).alias("r"), F.lit(c).alias("c"), F.col("px")[r * cols + c].alias("v")) for r, c, b in cells))
    out = ordered.select("pos", F.inline(all_cells))
    first = F.col("pos") < n_previous
    return out.filter(first | F.col("band").isNotNull()).withColumn("band", F.when(first, 0).otherwise(F.col("band")))
