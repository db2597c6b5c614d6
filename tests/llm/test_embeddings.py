import numpy as np
import pytest

from brindle.llm import embeddings
from brindle.llm.queries import table
from brindle.operators.components import roots


def brute(rows):
    def good(e, lab):
        return lab is not None and bool(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)

    n, links, pairs = len(rows), [0] * len(rows), []
    by = {}
    for k, (_, e, lab) in enumerate(rows):
        if good(e, lab):
            by.setdefault((lab, len(e)), []).append(k)
    for ks in by.values():
        x = np.array([np.float32(rows[k][1]) for k in ks], float)
        norm = np.sqrt((x * x).sum(axis=1))
        cos = np.array([[(a * b).sum() for b in x] for a in x]) / np.outer(norm, norm)
        for i, j in zip(*np.nonzero(cos >= 0.98)):
            if i != j:
                links[ks[i]] += 1
                pairs.append((ks[i], ks[j]))
    root, least = roots(pairs), {}
    for k in range(n):
        if rows[k][0] is not None:
            r = root.get(k, k)
            least[r] = min(rows[k][0], least.get(r, rows[k][0]))
    return sorted(((i, links[k], c := least.get(root.get(k, k)), i == c) for k, (i, *_) in enumerate(rows)), key=str)


def found(df, **kw):
    return sorted(map(tuple, embeddings.near_vectors(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert found(df, tile=20) == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


@pytest.mark.parametrize("tile", [3, 1024])
def test_groups_and_odd_rows(spark, tile):
    r = np.random.default_rng(8)
    unit = lambda: [float(np.float32(v)) for v in r.normal(size=12)]
    centre = [unit() for _ in range(4)]
    rows = [(k, [float(np.float32(a + b)) for a, b in zip(centre[k % 4], r.normal(size=12) * 0.12)], k % 3) for k in range(120)]
    rows += [(200 + k, centre[0], 0) for k in range(15)] + [(300, None, 1), (301, [0.0] * 12, 1), (302, [float("nan")] * 12, 1), (303, [float("inf")] + [0.0] * 11, 1), (304, [None] + [1.0] * 11, 1), (305, centre[0], None), (306, [], 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (309, [1.0], 1), (None, centre[0], 0), (200, centre[0], 0), (310, [-1.0, -2.0], 1)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "vec_id long, embedding array<float>, label int, node int").repartition(4)
    assert found(df, tile=tile) == brute(rows)


def test_dense_block_is_exact():
    r = np.random.default_rng(3)
    x = r.normal(size=20) + r.normal(size=(300, 20)) * 0.13
    y = r.normal(size=20) + r.normal(size=(50, 20))
    a, b = (embeddings._Side(v, np.eye(20)) for v in (x, np.concatenate([x[:100], y])))
    cos = (a.x @ b.x.T) / np.outer(a.norm, b.norm)
    assert (embeddings.linked(a, b) == (cos >= 0.98)).all()


def test_empty(spark):
    assert found(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")) == []


def test_tiny_and_huge_vectors(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [5e-324, 1e-323]), (5, [1.7e308, -1.7e308]), (6, [1e-160, -1e-160]), (7, [0.0, 1e-310]), (8, [0.0, 3.0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, label int")
    assert found(df, tile=2) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (8, 1, 7, False)]


def test_links_across_cells(spark):
    r = np.random.default_rng(11)
    rows = []
    for k in range(60):  # pairs just under and over the threshold, anywhere on the sphere
        x = r.normal(size=5)
        y = r.normal(size=5)
        y -= x * (x @ y) / (x @ x)
        for c in (0.9805, 0.9795):
            z = c * x / np.linalg.norm(x) + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)
            rows.append((len(rows), [float(np.float32(v)) for v in z], 0))
        rows.append((len(rows), [float(np.float32(v)) for v in x], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert found(df, tile=4) == brute(rows)


def test_like_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embeddings.sql()})").fetchall()
    assert found(table(spark, "/root/testdata/sf0.01", "embeddings")) == sorted(want, key=str)
