import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.cli import main
from brindle.operators import graph, shape
from brindle.plans import container
from brindle.sources import readers
from brindle.streaming.online import windowed_frequencies


def rows(df):
    return [(r["elem"], r["px"]) for r in df.orderBy("layer", "elem").collect()]


def test_npy(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(3, 2, 4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(a.astype(np.int64)))
    assert rows(readers.npy(spark, str(tmp_path))) == [(k, a[k % 3].ravel().tolist()) for k in range(6)]
    raw = io.BytesIO()
    np.save(raw, np.array([{}], object), allow_pickle=True)
    with pytest.raises(ValueError):
        readers.npy_array(raw.getvalue())


def test_idx_and_cifar(spark, tmp_path):
    a = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "i.idx").write_bytes(b"\0\0\x08\x03" + struct.pack(">3I", 2, 3, 3) + a.tobytes())
    assert rows(readers.idx(spark, str(tmp_path / "i.idx"))) == [(0, list(range(9))), (1, list(range(9, 18)))]
    planes = np.random.default_rng(1).integers(0, 256, (2, 3, 32, 32), np.uint8)
    (tmp_path / "c.bin").write_bytes(b"".join(b"\7" + p.tobytes() for p in planes))
    assert rows(readers.cifar(spark, str(tmp_path / "c.bin")))[1][1] == planes[1].transpose(1, 2, 0).ravel().tolist()


def test_census_and_rows(spark, tmp_path):
    line = "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K"
    (tmp_path / "adult.data").write_text(line + "\n" + line.replace("State-gov", "?").replace("39", "40") + "\n\n")
    df = readers.census(spark, str(tmp_path / "adult.data"))
    assert df.count() == 2 and {r["workclass"] for r in df.collect()} == {"?", "State-gov"}
    got = rows(readers.census_elements(df))
    assert [p[:3] for _, p in got] == [[39, 1, 77516], [40, 0, 77516]]
    readers.write_rows(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())[0] == line


def test_synthetic(spark):
    df = readers.synthetic(spark, 5000, 8)
    got = {r["s"]: r["count"] for r in df.groupBy(F.col("px")[0].alias("s")).count().collect()}
    w = np.random.default_rng(42).exponential(size=8)
    assert all(abs(got.get(k, 0) / 5000 - p) < 0.03 for k, p in enumerate(w / w.sum()))


def test_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("COLOR 0\nPATCH 0\nMST Entropy: 5.5\nRandom Entropy: 6.5\nPATCH 1\nMST Entropy: 4.5\nRandom Entropy: 6.0\nCOLOR 1\nPATCH 0\nMST Entropy: 3\nRandom Entropy: 4\n")
    got = {r["color"]: (r["mst"], r["random"]) for r in readers.log_averages(readers.entropy_log(spark, str(tmp_path / "log.txt"))).collect()}
    assert got == {0: (5.0, 6.25), 1: (3.0, 4.0)}


@pytest.mark.parametrize("order", container.ORDERS)
@pytest.mark.parametrize("encoder", ["delta-huff", "delta-coo"])
def test_container_round_trip(spark, tmp_path, order, encoder):
    df = shape.patches(readers.grey_fixture(spark), 4, 2) if order in ("mst", "id") else readers.grey_fixture(spark)
    container.compress(df, str(tmp_path / "c"), order, encoder)
    assert container.differences(container.decompress(spark, str(tmp_path / "c")), df) == 0


def test_command_line(spark, tmp_path):
    main(["compress", "test-rgb", str(tmp_path / "c"), "--pre", "rgb"])
    main(["recode", str(tmp_path / "c"), str(tmp_path / "d"), "--enc", "delta-coo"])
    main(["decompress", str(tmp_path / "d"), str(tmp_path / "e")])
    assert container.differences(spark.read.parquet(str(tmp_path / "e")), shape.channels(readers.colour_fixture(spark), 16)) == 0


@pytest.mark.parametrize("last", [0, 10_000])
def test_forest_has_least_weight(spark, last):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(r.integers(0, 40, 150), r.integers(0, 40, 150), r.integers(1, 9, 150)) if a != b]
    got = [tuple(x) for x in graph.spanning_forest(spark.createDataFrame(edges, "src long, dst long, w long"), last).collect()]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            up[x] = y
            want.append((a, b, w))
    assert sorted(got) == sorted(want)


def test_diameter_order():
    path = [(k, k + 1) for k in range(6)] + [(3, 10), (10, 11)]
    assert graph.diameter_order(path) == [6, 5, 4, 3, 2, 1, 0, 11, 10] or graph.diameter_order(path)[:7] in ([0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0])


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "event_type").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.select("ts", "event_type").schema).parquet(str(tmp_path / "in"))
    q = windowed_frequencies(stream, "event_type", "ts").writeStream.format("memory").queryName("freqs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM freqs").first()[0] == events.count()


def test_toured_order_is_depth_first(spark):
    r = np.random.default_rng(4)
    edges, want = [], []
    for layer, n in ((0, 40), (1, 2), (3, 25)):
        names = [int(x) for x in r.permutation(1000)[: n + 8]]
        own = [(names[k], names[int(r.integers(0, k))]) for k in range(1, n)]
        own += [(names[n + k], names[n + k - 1]) for k in range(1, 8)] if layer == 3 else []  # a second tree
        edges += [(layer, a, b) for a, b in own]
        want += [(layer, k, x, p) for k, (x, p) in enumerate(graph.depth_first(own))]
    tree = spark.createDataFrame(edges, "layer int, src long, dst long")
    got = graph.ordered_by_tree(tree, alone=0).select("layer", "pos", "elem", "parent").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert sorted(tuple(x) for x in graph.ordered_by_tree(tree).select("layer", "pos", "elem", "parent").collect()) == sorted(want)


def test_diameter_order_of_a_star_is_fast():
    star = [(0, k) for k in range(1, 20_000)]
    order = graph.diameter_order(star)
    assert sorted(order) == list(range(20_000)) and set(order[:3]) >= {0}
