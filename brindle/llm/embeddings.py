"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned to their principal axes, largest variance first, so the first
few dimensions tell most of a product.  Two tiles are compared by the product of the
leading dimensions; what the others can add is at most the product of the two suffix
norms, and pairs for which even that cannot reach the threshold stop there.  Then
come the next dimensions, for the pairs that are left, and at the end the cosine itself
of the vectors as given.

A cosine of c means a distance of sqrt(2 - 2 c) at most, and no more along any axis.
So vectors lie in cells of that width along the first ``AXES`` axes, and only tiles of one
cell or of neighbouring cells meet.  A tile has about ``TILE`` vectors however many a cell
has.  Vectors are scaled by a power of two first, so squares neither vanish nor overflow.
Equal vectors are one vector with a count, so copies cost nothing; a pair of tiles
gives counts and a forest of its links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.components import connected_components
from brindle.storage import stored

NEAR = 0.98
#: Vectors of a tile, about.
TILE = 512
#: Axes along which vectors lie in cells.
AXES = 3
#: Leading dimensions of each stage.
STAGES = (8, 24)
#: Rounding that bounds allow for.
SLACK = 1e-9
#: Share of a block's pairs above which products are cheaper for all than for a list.
DENSE = 0.05


def principal_axes(moment: np.ndarray) -> np.ndarray:
    """Columns are the axes of a second-moment matrix, largest variance first."""
    _, axes = np.linalg.eigh(moment)
    return np.ascontiguousarray(axes[:, ::-1])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that each one's largest component is from 1/2 to 1; exact but for what is 2^1000 times smaller."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


class _Side:
    """A tile's vectors: as given, as unit vectors, turned to the axes, and the suffix norms."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x = x = scaled(x)
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.turned = (x / self.norm[:, None]) @ axes
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = {k: np.sqrt(squares[:, k]) for k in STAGES if k < x.shape[1]}


def linked(a: _Side, b: _Side, near: float = NEAR) -> np.ndarray:
    """Which rows of a and b have a cosine of ``near`` at least, in double precision."""
    out = np.zeros((len(a.x), len(b.x)), bool)
    stages = [*a.suffix, a.x.shape[1]]
    for lo in range(0, len(a.x), 256):
        at = slice(lo, lo + 256)
        k = stages[0]
        dot = a.turned[at, :k] @ b.turned[:, :k].T
        if len(stages) > 1:
            i, j = np.nonzero(dot + a.suffix[k][at, None] * b.suffix[k][None, :] >= near - SLACK)
        else:
            i, j = np.nonzero(dot >= near - SLACK)
        if len(i) > DENSE * dot.size:
            dot += a.turned[at, k:] @ b.turned[:, k:].T
            i, j = np.nonzero(dot >= near - SLACK)
            sure = dot[i, j] >= near + SLACK
            out[lo + i[sure], j[sure]] = True
            i, j = i[~sure], j[~sure]
        else:
            part = dot[i, j]
            for k, after in zip(stages, stages[1:]):
                part = part + np.einsum("nd,nd->n", a.turned[lo + i, k:after], b.turned[j, k:after])
                rest = a.suffix[after][lo + i] * b.suffix[after][j] if after in a.suffix else 0.0
                on = part + rest >= near - SLACK
                i, j, part = i[on], j[on], part[on]
        if len(i):
            cosine = np.einsum("nd,nd->n", a.x[lo + i], b.x[j]) / (a.norm[lo + i] * b.norm[j])
            on = cosine >= near
            out[lo + i[on], j[on]] = True
    return out


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a matrix of links joins, at most one a node."""
    i, j = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    if not len(i):
        return []
    links = links[np.ix_(i, j)]
    a = left[i].copy()
    top = np.iinfo(np.int64).max
    while True:
        b = np.minimum(right[j], np.where(links, a[:, None], top).min(axis=0))
        new = np.minimum(a, np.where(links, b[None, :], top).min(axis=1))
        if (new == a).all():
            break
        a = new
    return [(int(x), int(y)) for x, y in [*zip(left[i], a), *zip(right[j], b)] if x != y]


def near_vectors(vectors: DataFrame, near: float = NEAR, tile: int = TILE) -> DataFrame:
    """Links vectors of equal label by cosine: ``vec_id, n_links, component_id, kept``.

    vectors: has ``vec_id, embedding`` (floats or doubles) and ``label``; other columns are not
    read.  A null label, a null or zero vector, one with null or non-finite components and
    one without components link with nothing; vectors of different lengths do not
    link.  A row's n_links are the other rows linked with it, equal vectors among
    them.  component_id is the smallest vec_id reachable (null only where no
    other is); repeated rows count as rows.  An empty table gives no rows.  The axes come from all vectors of
    the most frequent length; others are compared along the axes they have.
    """
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    zero = F.lit(0.0)
    good = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != zero), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding", good.alias("good"))
    keys = [F.when(F.col("good"), F.xxhash64("label", e)) for e in (F.col("embedding"), F.reverse("embedding"))]
    rows = stored(rows.withColumns({"key1": keys[0], "key2": keys[1], "row": F.monotonically_increasing_id()}), "vectors")
    own = rows.filter("good").groupBy("key1", "key2").agg(F.min("row").alias("node"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = stored(own.join(rows.select("row", "label", "embedding"), F.col("row") == F.col("node")).drop("row"), "nodes")

    length = nodes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = length["d"] if length else 0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = scaled(batch.column(0).flatten().to_numpy().astype(float).reshape(-1, d))
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            total += x.T @ x
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    axes = np.eye(d)
    if d:
        moment = np.zeros((d, d))
        for r in nodes.filter(F.size("embedding") == d).select("embedding").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d * d rows
            moment[r["i"], r["j"]] = r["v"]
        axes = principal_axes((moment + moment.T) / 2)
    turn = lambda n: axes if n == d else np.eye(n)
    width = math.sqrt(2 - 2 * near) + 1e-6
    reach = math.ceil(1 / width) + 2  # cells on either side of 0 along an axis
    base = 2 * reach + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, raw = [], []
            for e in batch.column(2):
                x = np.array(e.values, float)
                raw.append(x.astype(kind).tobytes())
                x = scaled(x[None, :])[0]
                along = (x / np.sqrt((x * x).sum())) @ turn(len(x))[:, :AXES]
                cell.append(sum((int(v // width) + reach) * base**k for k, v in enumerate(along)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(cell, pa.int64()), pa.array(raw, pa.binary())], ["node", "grp", "copies", "cell", "x"])

    grp = F.concat_ws(":", "label", F.size("embedding").cast("string")).alias("grp")
    placed = stored(nodes.select("node", grp, "embedding", "copies").mapInArrow(place, "node long, grp string, copies long, cell long, x binary"), "placed")
    tiles = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    # up to 3 ** AXES neighbours of a cell, itself among them
    steps = F.explode(F.array(*(F.lit(sum(o * base**k for k, o in enumerate(offset))).cast("long") for offset in product((-1, 0, 1), repeat=AXES))))
    tiles = stored(tiles, "tiles")
    around = tiles.select("grp", "cell", "n", steps.alias("step")).withColumn("to", F.col("cell") + F.col("step"))
    around = around.join(tiles.select("grp", F.col("cell").alias("to"), F.col("n").alias("m")), ["grp", "to"])
    around = stored(around.groupBy("grp", "cell", "n").agg(F.collect_list(F.struct("to", "m")).alias("around")), "around")
    t = placed.join(around, ["grp", "cell"]).withColumn("t", F.pmod(F.xxhash64("node"), "n").cast("int"))
    c, own_t = F.col("cell"), F.col("t")

    def met_in(to: Column, j: Column) -> Column:
        """The pair of tiles, the lower cell's (or the lower tile's) first, and the side of this one."""
        after = (to > c) | (to == c) & (j >= own_t)
        return F.struct(F.least(c, to).alias("cell"), F.when(after, own_t).otherwise(j).alias("a"), F.greatest(c, to).alias("cell2"), F.when(after, j).otherwise(own_t).alias("b"), F.when(after, 0).otherwise(1).alias("side"))

    places = F.flatten(F.transform("around", lambda o: F.transform(F.sequence(F.lit(0), o["m"] - 1), lambda j: met_in(o["to"], j))))
    key = ["grp", "cell", "a", "cell2", "b"]
    met = t.select("grp", "node", "copies", "x", F.explode(places).alias("p")).select("grp", "p.*", "node", "copies", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch | None:
            left = [h for h in held if h[0] == 0]
            right = left if now[1] == now[3] and now[2] == now[4] else [h for h in held if h[0] == 1]
            if not left or not right:
                return None
            sides = [_Side((v := np.frombuffer(b"".join(h[3] for h in s), kind).astype(float).reshape(len(s), -1)), turn(v.shape[1])) for s in ([left, right] if right is not left else [left])]
            a, b = sides[0], sides[-1]
            links = linked(a, b, near)
            if right is left:
                np.fill_diagonal(links, False)
            names = [np.array([h[1] for h in s]) for s in (left, right)]
            many = [np.array([h[2] for h in s]) for s in (left, right)]
            counts = [(links @ many[1], names[0])] + ([] if right is left else [(many[0] @ links, names[1])])
            out = [(int(n), int(k), None) for c, ns in counts for n, k in zip(ns, c) if k]
            out += [(x, None, y) for x, y in forest(links, *names)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["node", "links", "with"]) if out else None

        for batch in batches:
            for *k, side, node, copies, x in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if held and k != now:
                    if (done := close()) is not None:
                        yield done
                    held = []
                now = k
                held.append((side, node, copies, x))
        if held and (done := close()) is not None:
            yield done

    met = met.repartition(*key).sortWithinPartitions(*key, "side", "node").select(*key, "side", "node", "copies", "x")
    found = stored(met.mapInArrow(compare, "node long, links long, with long"), "found")
    links = found.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    comps = stored(connected_components(found.filter("with IS NOT NULL").select(F.col("node").alias("src"), F.col("with").alias("dst"))), "components")
    all_nodes = nodes.select("node", "key1", "key2", "copies", "least_id").join(links, "node", "left").join(comps, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = all_nodes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_key = all_nodes.join(least, "label").select("key1", "key2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    some = rows.filter("good").select("vec_id", "key1", "key2").join(of_key, ["key1", "key2"]).select("vec_id", "n_links", "component_id")
    none = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def sql(near: float = NEAR) -> str:
    """The same in SQL for a table of different vec_ids: all pairs of a label, and all that each vector reaches."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE c >= {near!r} AND NOT isnan(c)),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, least.y AS component_id, vec_id = least.y AS kept FROM embeddings JOIN least ON least.x = vec_id"""
