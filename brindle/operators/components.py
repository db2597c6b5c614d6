"""Connected components of an edge table, each labelled by its least node."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import stored

#: Edges that one task may finish alone; above it, rounds of contraction shrink the graph first.
LAST = 15_000
ROUNDS = 60


def roots(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Least node of each node's component, by union-find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    if pairs:
        found = roots(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["node", "label"])


def connected_components(edges: DataFrame, last: int = LAST) -> DataFrame:
    """``node, label`` for every node that has an edge to another one.

    edges: ``src, dst`` longs, in any direction, repeated or not; self-loops and nulls link
    nothing.  Each round hooks every node to its least neighbour, follows the hooks one
    step further and contracts; the graph shrinks by half at least, so rounds are
    logarithmic, and a round is a few aggregations and joins whose result is written to the
    shared folder.  When at most ``last`` edges remain, one task ends the work.
    """
    edge = lambda e: e.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    e = stored(edge(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))), "edges")
    steps: list[DataFrame] = []
    while e.count() > last:
        if len(steps) >= ROUNDS:
            raise RuntimeError(f"components are not found after {ROUNDS} rounds")
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = both.groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("node"), F.least("src", "dst").alias("up"))
        hook = stored(hook, "hooks")
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("above"))
        step = stored(hook.join(above, "up").select("node", F.col("above").alias("label")), "step")
        steps.append(step)
        e = stored(edge(e.join(step.toDF("src", "a"), "src").join(step.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "edges")
    found = e.coalesce(1).mapInArrow(_alone, "node long, label long")
    for step in reversed(steps):
        then = found.toDF("label", "further")
        found = step.join(then, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return found
