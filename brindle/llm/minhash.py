"""MinHash near-dedup by a chosen-path similarity join.

A document is the set of its five-word shingles.  Its minwise tokens are the least
hashes of the set under ``COORDINATES`` functions; two documents share each with
the probability of their Jaccard similarity.  In each of ``TREES`` independent trees a
document goes down from the root: at every node some coordinates are chosen (one,
and a second in a third of the nodes, 4/3 = 1/threshold on average), and the document
branches by its tokens there.  What meets in a small node is compared exhaustively by the
sketches; a large node branches on, ``DEPTH`` levels at most.  Pairs that look similar become links only by an exact
comparison of the full sets.

Work is kept from growing with the square of a group:

* documents with equal sets are one document from the start;
* in every node all documents are first compared with one centre only, and a node
  whose documents are one component by then is done;
* of those pairs, the best of each component is confirmed; what the others would join is
  found in the nodes;
* in small nodes the documents that look similar to one of another component are compared
  by their full sets there, and only a forest of their links goes on;
* in nodes that are still large at the last depth, only documents outside the largest
  component are compared with the others, by their full sets, in blocks.

Texts are read again once, for the documents that look similar to another one or are in a large
node at the first depth: all that any level may have to confirm.

A tree node is one key of the joins that follow.  Nodes with more than a task's share of
the rows, of which there are fewer than tasks, are joined by broadcast where their rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.workers import releasing
from brindle.operators.components import connected_components
from brindle.storage import parallelism, stored

WORDS = 5
#: Similarity of a link: 100 * intersection >= 75 * union.
NEAR = 75
COORDINATES = 128
#: A pair at the threshold misses all trees with probability 2e-9 at depth 1, 8e-7 at depth 2, 2e-5 at depth 3 (see ``miss``).
TREES = 12
DEPTH = 3
#: Documents of a node that is compared exhaustively.
SMALL = 256
#: Sketch similarity (in 128ths) from which a pair is confirmed: 0.75 less four standard deviations.  All trees
#: share the sketch, so a pair at exactly 0.75 is not confirmed with probability 7.5e-5, one at 0.8 with 3e-9.
SKETCH = 77
#: Narrow rows (a few longs each) that are broadcast at most; beyond it, both sides of a join are shuffled.
LIGHT = 250_000
#: Strays of a block, about, and members of a large node that they are compared with at once.
STRAYS = 256

_M = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


_WORD = _odd(WORDS, 11)
_HASH = _odd(COORDINATES, 12)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; with fewer words the whole sequence is one.

    A-Z are lower-cased; words are what white space of ASCII leaves.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxh3_64_intdigest, words)), np.uint64)
    if len(h) < WORDS:
        return _mix((h * _WORD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    s = h[:n] * _WORD[0]
    for k in range(1, WORDS):
        s += h[k : k + n] * _WORD[k]
    return np.unique(_mix(s))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least hash of a set under each coordinate's function."""
    least = np.full(COORDINATES, _M, np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(least, (s[k : k + 1024, None] * _HASH).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """16 bits of each minwise token, from where the least of even many hashes still varies."""
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _chosen(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates of nodes: the first, the second, and whether the second is used (in a third of the nodes)."""
    r = _mix(node ^ np.uint64(0x9E3779B97F4A7C15))
    first = r % np.uint64(COORDINATES)
    second = (first + np.uint64(1) + (r >> np.uint64(20)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    return first, second, (r >> np.uint64(40)) % np.uint64(3) == 0


def children(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes and their documents' tokens (a row each): rows and child nodes."""
    first, second, both = _chosen(node)
    at = np.arange(len(node))
    one = _mix(node + np.uint64(1) + _mix(first + (tokens[at, first].astype(np.uint64) << np.uint64(8))))
    two = _mix(node + np.uint64(1) + _mix(second + (tokens[at, second].astype(np.uint64) << np.uint64(8))))
    return np.concatenate([at, at[both]]), np.concatenate([one, two[both]])


_ROOTS = _mix(np.arange(1, TREES + 1, dtype=np.uint64))


def miss(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that no tree brings a pair together at a depth."""
    meet = 1.0
    for _ in range(depth):
        apart = 1 - similarity * meet
        meet = 1 - (2 * apart + apart * apart) / 3
    return (1 - meet) ** trees


_FEATURES = "doc_id long, h long, n_shingles long, key1 long, key2 long, paths array<long>, sketch binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text in batch.column(2):
            s = shingles(text.as_py())
            key = xxhash.xxh3_128_digest(s.tobytes())
            out[0].append(len(s))
            out[1].append(int.from_bytes(key[:8], "little", signed=True))
            out[2].append(int.from_bytes(key[8:], "little", signed=True))
            if len(s):
                least = minwise(s)
                _, paths = children(_ROOTS, np.broadcast_to(_mix(least), (TREES, COORDINATES)))
                out[3].append(np.unique(paths).view(np.int64))
                out[4].append(sketch(least))
            else:
                out[3].append([])
                out[4].append(b"")
        kinds = [*[pa.int64()] * 3, pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "h", "n_shingles", "key1", "key2", "paths", "sketch"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of rows (path, node, comp, sketch) sorted by path: path, documents, components, sketches."""
    path, nodes, comps, sketches = None, [], [], []
    for batch in batches:
        for p, n, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if p != path and nodes:
                yield path, np.array(nodes), np.array(comps), np.frombuffer(b"".join(sketches), "<u2").reshape(len(nodes), COORDINATES)
                nodes, comps, sketches = [], [], []
            path = p
            nodes.append(n)
            comps.append(c)
            sketches.append(s)
    if nodes:
        yield path, np.array(nodes), np.array(comps), np.frombuffer(b"".join(sketches), "<u2").reshape(len(nodes), COORDINATES)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that look similar to one of another component in their node: (path, node, comp)."""
    out: list[list] = [[], [], []]
    for path, nodes, comps, s in _runs(batches):
        some = np.zeros(len(nodes), bool)
        for i in range(len(nodes) - 1):
            near = ((s[i + 1 :] == s[i]).sum(axis=1) >= SKETCH) & (comps[i + 1 :] != comps[i])
            some[i + 1 :] |= near
            some[i] |= near.any()
        out[0] += [path] * int(some.sum())
        out[1] += nodes[some].tolist()
        out[2] += comps[some].tolist()
        if len(out[0]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["path", "node", "comp"])
            out = [[], [], []]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["path", "node", "comp"])


def intersections(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets: products of their incidence matrix, ``chunk`` columns at a time."""
    out = np.zeros((len(sets), len(sets)))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), chunk):
        a, b = np.searchsorted(column, [lo, lo + chunk])
        m = np.zeros((len(sets), chunk), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, node, comp, set) sorted by path: edges that join what the links of each node join across components."""

    def close() -> None:
        if len(held) < 2:
            return
        nodes, comps = np.array([h[0] for h in held]), [h[1] for h in held]
        sets = [np.frombuffer(h[2], "<u8") for h in held]
        size = np.array([len(s) for s in sets])
        both = intersections(sets)
        links = 100 * both >= NEAR * (size[:, None] + size[None, :] - both)
        label = np.arange(len(held))
        while True:
            new = np.minimum(label, np.where(links, label[None, :], len(held)).min(axis=1))
            if (new == label).all():
                break
            label = new
        for k, top in enumerate(label.tolist()):
            if comps[k] != comps[top]:
                out[0].append(int(nodes[k]))
                out[1].append(int(nodes[top]))

    now, held, out = None, [], [[], []]
    for batch in batches:
        for path, node, comp, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if path != now:
                close()
                held = []
            now = path
            held.append((node, comp, s.as_py()))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["src", "dst"])
            out[0].clear(), out[1].clear()
    close()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["src", "dst"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, block, member, node, comp, set), strays of a block before the node's members: a link for each stray and component it meets."""
    now, strays, members, met = None, [], [], set()
    out: list[list[int]] = [[], []]

    def compare() -> None:
        if not strays or not members:
            return
        sets = [np.frombuffer(x[2], "<u8") for x in (*strays, *members)]
        size, n = np.array([len(s) for s in sets]), len(strays)
        both = intersections(sets)[:n, n:]
        for i, j in zip(*np.nonzero(100 * both >= NEAR * (size[:n, None] + size[None, n:] - both)), strict=True):
            (a, ca, _), (b, cb, _) = strays[i], members[j]
            if ca != cb and (a, cb) not in met:
                met.add((a, cb))
                out[0].append(a)
                out[1].append(b)

    for batch in batches:
        for *key, member, node, comp, s in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
            if key != now:
                compare()
                now, strays, members, met = key, [], [], set()
            (members if member else strays).append((node, comp, s.as_py()))
            if len(members) >= STRAYS:
                compare()
                members = []
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["src", "dst"])
            out = [[], []]
    compare()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["src", "dst"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            path = batch.column(0).to_numpy().view(np.uint64)
            nodes = batch.column(1).to_numpy()
            s = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(len(path), COORDINATES)
            rows, child = children(path, s)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(nodes[rows])], ["path", "node"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, dst = [], []
        for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= NEAR * (len(x) + len(y) - both):
                src.append(a.as_py())
                dst.append(b.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def light(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has no more than ``LIGHT`` rows."""
    return F.broadcast(df) if df.count() <= LIGHT else df


class _Join:
    """The state of one run: documents of different sets (nodes), their sketches, components and links."""

    def __init__(self, docs: DataFrame):
        # h tells rows of one doc_id apart, and finds a text again
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        self.tasks = parallelism(docs.sparkSession)
        rows = self.docs.mapInArrow(releasing(_features), _FEATURES).withColumn("row", F.monotonically_increasing_id())
        self.rows = stored(rows, "features")
        own = self.rows.filter("n_shingles > 0").groupBy("key1", "key2").agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least"))
        own = own.select(F.col("row").alias("node"), "least")
        # row is a row's own number, so this join has no hot key
        self.nodes = stored(self.rows.join(own, self.rows["row"] == own["node"]).select("node", "least", "key1", "key2", "doc_id", "h", "paths", "sketch"), "nodes")
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.sets: DataFrame | None = None

    def by_path(self, rows: DataFrame, about: DataFrame, total: int) -> DataFrame:
        """Joins rows (path, ...), ``total`` of them, with a row a tree node (path, n, ...), n the number of its rows.

        Fewer nodes than there are tasks have more than a task's share of the rows; these go to
        where the rows are, so that no task gets one node's rows.
        """
        hot = [r["path"] for r in about.filter(F.col("n") > total / self.tasks).select("path").collect()]  # fewer than tasks
        if not hot:
            return rows.join(about, "path")
        here = F.col("path").isin(hot)
        return rows.filter(here).join(F.broadcast(about.filter(here)), "path").unionByName(rows.filter(~here).join(about.filter(~here), "path"))

    def with_comp(self, df: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
        if self.comps is None:
            return df.withColumn(name, F.col(node))
        return df.join(self.comps.toDF(node, "_label"), node, "left").withColumn(name, F.coalesce("_label", node)).drop("_label")

    def take(self, candidates: DataFrame) -> None:
        """Of candidates (a, b, alike) that join two components, confirms the best of each component.

        What is left comes again from its tree nodes, as they stay mixed.
        """
        left = self.with_comp(self.with_comp(candidates, "a", "ca"), "b", "cb").filter("ca <> cb")
        # the best of each component by an aggregate, so that no component is gathered in one task
        both = left.select("a", "b", "alike", F.explode(F.array("ca", "cb")).alias("c"))
        picked = stored(both.groupBy("c").agg(F.max(F.struct("alike", "a", "b")).alias("m")).select("m.a", "m.b").distinct(), "picked")
        self.link(self.confirm(picked))

    def link(self, edges: DataFrame) -> None:
        edges = stored(edges, "links")
        self.links = edges if self.links is None else self.links.unionByName(edges)
        self.comps = stored(connected_components(self.links), "components")

    def near(self, small: DataFrame) -> DataFrame:
        """Of small nodes (path, node, comp, sketch), the documents (path, node, comp) that look similar to one of another component."""
        return small.repartition("path").sortWithinPartitions("path").select("path", "node", "comp", "sketch").mapInArrow(_candidates, "path long, node long, comp long")

    def settle(self, small: DataFrame) -> None:
        """Compares small nodes (path, node, comp, sketch) exhaustively: by sketch, then the documents that are left by their full sets."""
        rows = self.sets.join(light(stored(self.near(small), "near")), "node").select("path", "node", "comp", "s").repartition("path").sortWithinPartitions("path")
        self.link(rows.mapInArrow(releasing(_exact), "src long, dst long"))

    def gather_sets(self, wanted: DataFrame) -> None:
        """Writes the full sets of documents (node)."""
        wanted = stored(self.nodes.select("node", F.col("doc_id").alias("id"), F.col("h").alias("ih"), "key1").join(wanted.distinct(), "node"), "wanted")

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part, node, out = batch.slice(lo, 1000), [], []
                    for n, k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                        raw = shingles(text.as_py()).tobytes()
                        if int.from_bytes(xxhash.xxh3_128_digest(raw)[:8], "little", signed=True) == k:
                            node.append(n)
                            out.append(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "s"])

        # (doc_id, h) is one text, and one wanted row: rows multiply with nothing, however often a doc_id is there
        texts = self.docs.join(light(wanted), (F.col("h") == F.col("ih")) & F.col("doc_id").eqNullSafe(F.col("id")))
        new = stored(texts.select("node", "key1", "text").mapInArrow(releasing(full), "node long, s binary"), "sets")
        if new.count() > wanted.count():  # rows of one doc_id and text
            new = stored(new.dropDuplicates(["node"]), "sets")
        self.sets = new

    def confirm(self, pairs: DataFrame) -> DataFrame:
        ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        held = self.sets.join(light(ends), "node", "left_semi")
        a, b = held.toDF("a", "x"), held.toDF("b", "y")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(releasing(_confirmed), "src long, dst long")

    def run(self) -> None:
        paths = self.nodes.select(F.explode("paths").alias("path"), "node")
        sketches = self.nodes.select("node", "sketch")
        for depth in range(1, DEPTH + 1):
            paths = stored(self.with_comp(paths), "paths")
            size = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.min(F.struct(F.xxhash64("node", "path").alias("h"), "node")).alias("any"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
            # small nodes of a group mostly have one centre, so few pairs; large nodes have different ones, so that most documents meet one that is near
            size = stored(size.filter("n > 1 AND c1 <> c2").select("path", "n", F.when(F.col("n") > SMALL, F.col("any.node")).otherwise(F.col("least")).alias("centre")), "sizes")
            about = size.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
            if not about["total"]:
                return
            met = stored(self.by_path(paths, size, about["total"]), "met")
            if depth == 1:
                large = met.filter(F.col("n") > SMALL).select("node")
                self.gather_sets(self.near(met.filter(F.col("n") <= SMALL).join(sketches, "node")).select("node").unionByName(large))
            self.take(self.compared(met.filter("node <> centre").select("node", "centre"), sketches))
            met = self.mixed(met, about["total"])
            self.settle(met.filter(F.col("n") <= SMALL).join(sketches, "node"))
            if about["most"] <= SMALL:
                return
            large = met.filter(F.col("n") > SMALL)
            if depth < DEPTH:
                rows = large.join(sketches, "node").select("path", "node", "sketch")
                paths = rows.mapInArrow(_branch, "path long, node long").distinct()
                # the next level has no other documents
                sketches = stored(sketches.join(large.select("node").distinct(), "node", "left_semi"), "sketches")
            else:
                self.strays(self.mixed(large, about["total"]))

    def mixed(self, met: DataFrame, total: int) -> DataFrame:
        """Rows (path, node, n, comp) of the tree nodes that are not one component yet."""
        now = self.with_comp(met.select("path", "node"))
        several = now.groupBy("path").agg(F.count("*").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("path", "n")
        return stored(self.by_path(now, stored(several, "several"), total), "mixed")

    def compared(self, pairs: DataFrame, sketch: DataFrame) -> DataFrame:
        """Sketch similarity of different (node, centre) pairs, those near enough."""
        pairs = pairs.repartition("node").dropDuplicates(["node", "centre"])
        rows = pairs.join(sketch, "node").join(sketch.toDF("centre", "other"), "centre")

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    n, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, COORDINATES) for k in (2, 3))
                    same = (x == y).sum(axis=1)
                    at = same >= SKETCH
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(n, c)[at]), pa.array(np.maximum(n, c)[at]), pa.array(same[at].astype(np.int32))], ["a", "b", "alike"])

        return rows.select("node", "centre", "sketch", "other").mapInArrow(alike, "a long, b long, alike int")

    def strays(self, rest: DataFrame) -> None:
        """Large nodes at the last depth: all documents outside a node's largest component, in blocks, against the node by their full sets."""
        counts = rest.groupBy("path", "comp").agg(F.count("*").alias("n")).groupBy("path").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"))
        main = counts.select("path", "n", F.col("m.comp").alias("main"), (1 + F.floor((F.col("n") - F.col("m.n")) / STRAYS)).alias("blocks"))
        main = stored(main, "main")
        rows = self.by_path(rest.select("path", "node", "comp"), main, main.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).join(self.sets, "node")
        own = F.when(F.col("comp") != F.col("main"), F.struct(F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.lit(0).alias("member")))
        places = F.array_compact(F.concat(F.array(own), F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.lit(1).alias("member")))))
        dealt = rows.select("path", F.inline(places), "node", "comp", "s")
        dealt = dealt.repartition("path", "block").sortWithinPartitions("path", "block", "member", "node")
        self.link(dealt.mapInArrow(releasing(_against), "src long, dst long"))


def _joined(docs: DataFrame) -> tuple[_Join, DataFrame]:
    """A run over documents, and its classes: each set's (key1, key2) with the least document of its class."""
    run = _Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    run.run()
    nodes = run.with_comp(run.nodes.select("node", "least", "key1", "key2"))
    least = nodes.groupBy("comp").agg(F.min("least").alias("first"))
    return run, nodes.join(least, "comp").select("key1", "key2", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups: ``doc_id, n_shingles, component_id, kept``, a row a document.

    docs: has ``doc_id`` and ``text``; other columns are not read.  Documents whose full
    shingle sets have 100 * intersection >= 75 * union are linked; component_id is the
    smallest doc_id reachable, kept says that it is the document's own.  Null and blank texts
    have no shingles and are linked with nothing, not even each other.  A null doc_id is a
    document like any other, but never a component_id where there is one that is not null.
    Repeated rows are equal documents with one doc_id, so all of them are kept or none.  An
    empty table gives no rows.
    """
    run, of_key = _joined(docs)
    rows = run.rows.select("doc_id", "n_shingles", "key1", "key2")
    some = rows.filter("n_shingles > 0").join(of_key, ["key1", "key2"]).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each near-duplicate group: the one of least doc_id (null last).

    Of rows of one doc_id that are in one group, that of the least text hash stays; of rows
    of one doc_id and text, blank ones too, any one.  Other blank texts are groups of their own.
    """
    run, of_key = _joined(docs)
    first = of_key.select("first.doc_id", "first.h").unionByName(run.rows.filter("n_shingles = 0").select("doc_id", "h")).distinct()
    first = stored(first.toDF("_id", "_ih"), "first")
    own = docs.withColumns({"_d": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})
    own = own.join(first, (F.col("_h") == F.col("_ih")) & F.col("_d").eqNullSafe(F.col("_id")), "left_semi")
    return own.dropDuplicates(["_d", "_h"]).select(*docs.columns)
