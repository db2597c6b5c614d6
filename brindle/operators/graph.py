"""kNN graphs, spanning trees and orders of elements.

Distances are exact integers (squared l2, l1, count of differing places), so results do
not depend on summation order, and ties go by id.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.components import connected_components
from brindle.operators.order import positions
from brindle.storage import stored

#: Elements of a block of the matrix of distances.
BLOCK = 2048
#: Edges that one task may finish alone.
LAST = 200_000
ROUNDS = 60
#: Edges of a tree that one task may order.
ALONE = 2_000_000


def _tile(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += np.abs(d) if metric == "l1" else d != 0
    return out


def _blocks(elements: DataFrame, block: int) -> DataFrame:
    """Elements by blocks of about ``block``: ``layer, b, ids, m`` (the matrix as int32 bytes)."""

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("elem")
        m = np.array(g["px"].tolist(), "<i4")
        return pd.DataFrame({"layer": [g["layer"].iloc[0]], "b": [g["b"].iloc[0]], "ids": [g["elem"].tolist()], "m": [m.tobytes()]})

    n = elements.groupBy("layer").count().agg(F.max("count")).first()[0] or 0
    rows = elements.select("layer", "elem", "px").withColumn("b", F.pmod(F.xxhash64("elem"), F.lit(max(1, math.ceil(n / block)))).cast("int"))
    return stored(rows.groupBy("layer", "b").applyInPandas(gather, "layer int, b int, ids array<long>, m binary"), "blocks")


def _compared(elements: DataFrame, keep, metric: str, block: int) -> DataFrame:
    """All pairs of blocks of a layer, each pair once; ``keep(distances, ids, ids2)`` says which entries of a row of distances stay.

    A block goes to every pair that it is in, and a pair is the key, so a task never has more
    than two blocks at once, and no key has more than a pair.
    """
    blocks = _blocks(elements, block)
    n = (blocks.agg(F.max("b")).first()[0] or 0) + 1
    pair = blocks.select("layer", "b", "ids", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    pair = pair.select("layer", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") > F.col("o")).cast("int").alias("side"), "ids", "m")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None

        def rows(layer: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            src, dst, w = found
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(src), layer, np.int32)), pa.array(src), pa.array(dst), pa.array(w)], ["layer", "src", "dst", "w"])

        for batch in batches:
            for layer, lo, hi, side, ids, m in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                ids = np.array(ids, np.int64)
                m = np.frombuffer(m, "<i4").reshape(len(ids), -1).astype(np.int64)
                if lo == hi:
                    yield rows(layer, keep(_tile(m, m, metric), ids, ids))
                elif not side:
                    first = (layer, lo, hi), ids, m
                elif first and first[0] == (layer, lo, hi):  # a block without elements has no rows
                    d = _tile(first[2], m, metric)
                    yield rows(layer, keep(d, first[1], ids))
                    yield rows(layer, keep(d.T, ids, first[1]))

    pair = pair.repartition("layer", "lo", "hi").sortWithinPartitions("layer", "lo", "hi", "side")
    return pair.mapInArrow(compare, "layer int, src long, dst long, w long")


def knn(elements: DataFrame, k: int, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """The k nearest other elements of each (J1, O1): ``layer, src, dst, w, rank``, ties by dst.

    The matrix of distances goes block by block; a block gives its k best of each row,
    and the best of those are the result.
    """

    def best(d: np.ndarray, ids: np.ndarray, ids2: np.ndarray) -> tuple[np.ndarray, ...]:
        top = np.iinfo(np.int64).max
        if ids is ids2:
            d = d.copy()
            np.fill_diagonal(d, top)
        n = min(k, d.shape[1])
        if 4 * n < d.shape[1]:
            # nothing beyond a row's n-th distance is in; ties at it are cut below
            keep = d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero(keep)
        else:
            i, j = (x.ravel() for x in np.indices(d.shape))
        w = d[i, j]
        order = np.lexsort((ids2[j], w, i))
        i, j, w = i[order], j[order], w[order]
        at = np.arange(len(i)) - np.searchsorted(i, i)
        on = (at < n) & (w < top)
        return ids[i[on]], ids2[j[on]], w[on]

    rank = F.row_number().over(Window.partitionBy("layer", "src").orderBy("w", "dst"))
    return _compared(elements, best, metric, block).withColumn("rank", rank).filter(F.col("rank") <= k)


def within(elements: DataFrame, radius: int, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """Pairs no further apart than a radius (J3): ``layer, src, dst, w`` with src < dst."""

    def near(d: np.ndarray, ids: np.ndarray, ids2: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero((d <= radius) & (ids[:, None] < ids2[None, :]))
        return ids[i], ids2[j], d[i, j]

    return _compared(elements, near, metric, block)


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, with src < dst and its least weight."""
    return edges.groupBy("layer", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w")).select("layer", F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def escalated_knn(elements: DataFrame, alpha: int = 1, metric: str = "l2", n: int | None = None) -> tuple[DataFrame, int]:
    """A connected kNN graph (G2): k = floor(ln n) * alpha, alpha tenfold until it is connected."""
    n = n or elements.count()
    while True:
        k = max(1, min(n - 1, int(math.log(max(n, 1))) * alpha))
        edges = stored(knn(elements, k, metric), "knn")
        labels = connected_components(edges).agg(F.countDistinct("label").alias("c"), F.count("*").alias("n")).first()
        if n <= 1 or labels["c"] == 1 and labels["n"] == n or k == n - 1:
            return edges, k
        alpha *= 10




def spanning_forest(edges: DataFrame, last: int = LAST) -> DataFrame:
    """The minimum spanning forest by the total order (w, src, dst) (G3): ``src, dst, w``.

    Borůvka rounds over written tables: the least edge of each component is in the forest,
    and components contract; when at most ``last`` edges remain, one task ends the work.
    """
    e = stored(undirected(edges.withColumn("layer", F.lit(0))).select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")), "edges")
    found: list[DataFrame] = []
    while e.count() > last:
        if len(found) >= ROUNDS:
            raise RuntimeError(f"no forest after {ROUNDS} rounds")
        both = e.select("w", "src", "dst", F.explode(F.array("a", "b")).alias("c"))
        least = both.groupBy("c").agg(F.min(F.struct("w", "src", "dst")).alias("e")).select("e.*").distinct()
        found.append(stored(least.select("src", "dst", "w"), "forest"))
        comps = stored(connected_components(e.join(found[-1].select("src", "dst"), ["src", "dst"], "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")
        moved = e.join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left")
        moved = moved.select("src", "dst", "w", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
        near = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "src", "dst")).alias("e"))
        e = stored(near.select("e.src", "e.dst", "e.w", "a", "b"), "edges")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)]
        ends = {(w, s, d): (a, b) for s, d, w, a, b in rows}
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for (w, s, d), (a, b) in sorted(ends.items()):
            a, b = find(a), find(b)
            if a != b:
                up[a] = b
                out.append((s, d, w))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["src", "dst", "w"])

    out = e.coalesce(1).mapInArrow(alone, "src long, dst long, w long")
    for f in found:
        out = out.unionByName(f)
    return out


def neighbours(tree: list[tuple[int, int]]) -> dict[int, list[int]]:
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in tree:
        near[a].append(b)
        near[b].append(a)
    return {k: sorted(v) for k, v in near.items()}


def depth_first(tree: list[tuple[int, int]]) -> list[tuple[int, int | None]]:
    """Nodes and their parents in depth-first order, from the lowest id of each tree, children ascending."""
    near, seen, out = neighbours(tree), set(), []
    for root in sorted(near):
        todo: list[tuple[int, int | None]] = [] if root in seen else [(root, None)]
        while todo:
            x, parent = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            out.append((x, parent))
            todo += [(y, x) for y in reversed(near[x]) if y not in seen]
    return out


def farthest(near: dict[int, list[int]], start: int, allowed: set[int]) -> tuple[int, dict[int, int | None]]:
    """The node most hops away (ties: least id) and the parents of a breadth-first search."""
    parent: dict[int, int | None] = {start: None}
    level = last = [start]
    while level:
        last = level
        level = sorted({y for x in level for y in near.get(x, ()) if y in allowed and y not in parent})
        for y in level:
            parent[y] = min(x for x in last if y in near[x])
    return min(last), parent


def diameter_order(tree: list[tuple[int, int]]) -> list[int]:
    """Longest path first, then the subtrees that hang on it, each in the same way."""
    near, out = neighbours(tree), []
    todo = [set(near)]
    while todo:
        left = todo.pop()
        if not left:
            continue
        a, _ = farthest(near, min(left), left)
        b, parent = farthest(near, a, left)
        reached, path, x = set(parent), [], b
        while x is not None:
            path.append(x)
            x = parent[x]
        out += path
        rest, parts = reached - set(path), []
        for x in path:  # every subtree hangs on the path
            for y in near[x]:
                if y in rest:
                    part, more = {y}, [y]
                    while more:
                        more = [z for v in more for z in near[v] if z in rest and z not in part and not part.add(z)]
                    parts.append(part)
                    rest -= part
        todo += [left - reached, *reversed(sorted(parts, key=min))]
    return out


def _to_end(links: DataFrame) -> DataFrame:
    """``id, far``: how many links lie between an item and the end of its list.  links: ``id, next`` (null at an end).

    Every round doubles how far a link reaches, so rounds are logarithmic in the longest list.
    """
    d = stored(links.select("id", "next", F.col("next").isNotNull().cast("long").alias("far")), "links")
    for _ in range(64):
        if d.filter("next IS NOT NULL").isEmpty():
            return d.select("id", "far")
        ahead = d.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("far").alias("more"))
        d = stored(d.join(ahead, "next", "left").select("id", F.col("after").alias("next"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "links")
    raise RuntimeError("lists do not end")


def _tour(arcs: DataFrame, order: list, root: DataFrame) -> DataFrame:
    """``layer, src, dst, at``: the places of a tree's arcs, both ways of each edge, in a tour from its root.

    At each node the tour goes on from one neighbour to the next in the given order, and from
    the last to the first; it begins and ends at the root (``layer, root, elem``; a row a node).
    """
    at = Window.partitionBy("layer", "src").orderBy(*order)
    rows = positions(arcs.withColumns({"k": F.row_number().over(at), "n": F.count("*").over(Window.partitionBy("layer", "src"))}), "layer", "src", "k", name="id")
    rows = stored(rows, "arcs")
    # after u -> v comes v -> w, w next to u at v
    back = rows.select("layer", F.col("src").alias("v"), F.col("dst").alias("u"), (F.col("k") % F.col("n") + 1).alias("k"))
    goes = rows.select("layer", F.col("src").alias("v"), "k", F.col("id").alias("next"), F.col("k").alias("place"))
    follow = back.join(goes, ["layer", "v", "k"]).select("layer", F.col("u").alias("src"), F.col("v").alias("dst"), "next", "place")
    here = rows.select("layer", "src", "dst", "id").join(follow, ["layer", "src", "dst"]).join(root.select("layer", F.col("elem").alias("dst"), (F.col("root") == F.col("elem")).alias("top")), ["layer", "dst"])
    links = stored(here.select("layer", "src", "dst", "id", F.when(~(F.col("top") & (F.col("place") == 1)), F.col("next")).alias("next")), "follow")
    return links.drop("next").join(_to_end(links), "id").select("layer", "src", "dst", (-F.col("far")).alias("at"))


def toured(tree: DataFrame) -> DataFrame:
    """``layer, pos, elem, parent`` in depth-first order, children ascending, of trees that no task could hold.

    A tour finds each node's parent; a second one, which takes the children in order and the
    parent last, has its nodes in the order of their first visit.  Both are lists, whose places
    come in a logarithmic number of joins.
    """
    edges = stored(tree.select("layer", "src", "dst"), "tree")
    nodes = positions(edges.select("layer", F.explode(F.array("src", "dst")).alias("elem")).distinct(), "layer", "elem", name="id")
    nodes = stored(nodes, "nodes")
    number = lambda c: nodes.select("layer", F.col("elem").alias(c), F.col("id").alias(f"{c}_id"))
    found = connected_components(edges.join(number("src"), ["layer", "src"]).join(number("dst"), ["layer", "dst"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    first = nodes.select(F.col("id").alias("label"), F.col("elem").alias("root"))
    root = stored(nodes.join(found.withColumnRenamed("node", "id"), "id").join(first, "label").select("layer", "root", "elem"), "roots")
    arcs = stored(edges.unionByName(edges.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    one = stored(_tour(arcs, ["dst"], root), "tour")
    other = one.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("at").alias("back"))
    down = one.join(other, ["layer", "src", "dst"])
    arcs = stored(down.select("layer", "src", "dst", (F.col("at") > F.col("back")).alias("up")), "directed")
    two = _tour(arcs, ["up", "dst"], root).join(arcs.filter("NOT up").drop("up"), ["layer", "src", "dst"])
    visits = two.select("layer", F.col("dst").alias("elem"), F.col("src").alias("parent"), "at").join(root, ["layer", "elem"])
    visits = visits.unionByName(root.filter("root = elem").select("layer", "elem", F.lit(None).cast("long").alias("parent"), F.lit(-(1 << 62)).alias("at"), "root"))
    numbered = positions(visits, "layer", "root", "at", name="all")
    before = numbered.groupBy("layer").agg(F.min("all").alias("first"))
    return numbered.join(F.broadcast(before), "layer").select("layer", (F.col("all") - F.col("first")).alias("pos"), "elem", "parent")


def ordered_by_tree(tree: DataFrame, how: str = "depth_first", alone: int = ALONE) -> DataFrame:
    """``layer, pos, elem, parent`` of each layer's tree.

    Trees of at most ``alone`` edges have a task each, and layers run side by side; larger ones
    are toured by joins.  The diameter order is only for the former.
    """
    largest = tree.groupBy("layer").count().agg(F.max("count")).first()[0] or 0
    if largest > alone:
        if how != "depth_first":
            raise ValueError(f"the {how} order is for trees of at most {alone} edges")
        return toured(tree)

    def order(g: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(g["src"].tolist(), g["dst"].tolist(), strict=True))
        rows = depth_first(pairs) if how == "depth_first" else [(x, None) for x in diameter_order(pairs)]
        return pd.DataFrame({"layer": g["layer"].iloc[0], "pos": range(len(rows)), "elem": [x for x, _ in rows], "parent": pd.array([p for _, p in rows], dtype="Int64")})

    return tree.groupBy("layer").applyInPandas(order, "layer int, pos long, elem long, parent long")


def greedy_chain(near: DataFrame) -> DataFrame:
    """Nearest unvisited of the k neighbours, else the lowest unvisited id (G11): ``layer, pos, elem``."""

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        to = {s: d["dst"].tolist() for s, d in g.sort_values(["src", "rank"]).groupby("src")}
        left = sorted(to, reverse=True)
        seen, out, x = set(), [], None
        while True:
            if x is None:
                while left and left[-1] in seen:
                    left.pop()
                if not left:
                    break
                x = left.pop()
            seen.add(x)
            out.append(x)
            x = next((y for y in to.get(x, ()) if y not in seen), None)
        return pd.DataFrame({"layer": g["layer"].iloc[0], "pos": range(len(out)), "elem": out})

    return near.groupBy("layer").applyInPandas(chain, "layer int, pos long, elem long")


def padded(order: DataFrame, elements: DataFrame) -> DataFrame:
    """Puts duplicates right before their representative, by id (G5): ``layer, pos, elem``.

    order: ``layer, pos, elem`` of the representatives (least id of equal elements).
    """
    least = elements.groupBy("layer", "px").agg(F.min("elem").alias("rep"))
    rows = elements.select("layer", "elem", "px").join(least, ["layer", "px"]).join(order.select("layer", F.col("elem").alias("rep"), F.col("pos").alias("at")), ["layer", "rep"])
    numbered = positions(rows.select("layer", "at", (F.col("elem") == F.col("rep")).alias("own"), "elem"), "layer", "at", "own", "elem", name="all")
    first = numbered.groupBy("layer").agg(F.min("all").alias("first"))
    return numbered.join(F.broadcast(first), "layer").select("layer", (F.col("all") - F.col("first")).alias("pos"), "elem")


def tree_measures(tree: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """For each node: nodes of its tree, the sum of its hop distances, and its largest (G9, G10), in linear time.

    Sums move from a node to its child by (nodes outside the child's subtree) minus (inside);
    the largest distance is that to one of the two ends of a longest path.
    """
    near, seen, out = neighbours(tree), set(), []

    def hops(start: int) -> dict[int, int]:
        d, level = {start: 0}, [start]
        while level:
            level = [y for x in level for y in near[x] if y not in d and not d.update({y: d[x] + 1})]
        return d

    for root in sorted(near):
        if root in seen:
            continue
        from_root = hops(root)
        seen |= set(from_root)
        order = sorted(from_root, key=from_root.get)
        parent = {y: x for x in order for y in near[x] if from_root[y] == from_root[x] + 1}
        size = dict.fromkeys(order, 1)
        for x in reversed(order[1:]):
            size[parent[x]] += size[x]
        total = {root: sum(from_root.values())}
        for x in order[1:]:
            total[x] = total[parent[x]] + len(order) - 2 * size[x]
        a = hops(order[-1])
        b = hops(max(a, key=a.get))
        out += [(x, len(order), total[x], max(a[x], b[x])) for x in order]
    return out


def centrality(tree: DataFrame) -> DataFrame:
    """``layer, node, n, total, farthest`` of each layer's trees; closeness is (n - 1) / total."""

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        rows = tree_measures(list(zip(g["src"].tolist(), g["dst"].tolist(), strict=True)))
        return pd.DataFrame([(g["layer"].iloc[0], *r) for r in rows], columns=["layer", "node", "n", "total", "farthest"])

    return tree.groupBy("layer").applyInPandas(measure, "layer int, node long, n long, total long, farthest long")


def paths(tree: DataFrame) -> DataFrame:
    """``layer, root, node, path``: the nodes from the least node of each tree to every other one (G10), predecessor by predecessor."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        out, above = [], {}
        for x, parent in depth_first(list(zip(g["src"].tolist(), g["dst"].tolist(), strict=True))):
            above[x] = [*above[parent], x] if parent is not None else [x]
            out.append((g["layer"].iloc[0], above[x][0], x, above[x]))
        return pd.DataFrame(out, columns=["layer", "root", "node", "path"])

    return tree.groupBy("layer").applyInPandas(walk, "layer int, root long, node long, path array<long>")
