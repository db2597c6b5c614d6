import numpy as np
import pytest

from brindle.llm import minhash
from brindle.llm.queries import table
from brindle.operators.components import roots


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Exact: all pairs that share a shingle."""
    sets = [plain_set(t) for _, t in rows]
    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(linked)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root.get(k, k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(sets[k]), c := least.get(root.get(k, k)), i == c) for k, (i, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_miss_probability():
    assert minhash.miss(0.75, 1) < 3e-9 and minhash.miss(0.75, minhash.DEPTH) < 2e-5


def test_sketch_estimates():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = x[:3000], x[600:3600]
    s, t = (np.frombuffer(minhash.sketch(minhash.minwise(v)), "<u2") for v in (a, b))
    assert abs((s == t).mean() - 2400 / 3600) < 0.17


def test_documents_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("small", [4, 64])
def test_planted_groups(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    r = np.random.default_rng(5)
    word = lambda: f"w{r.integers(0, 50000)}"
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows, k = [], 0
    for g, n in zip(base, (2, 3, 8, 40, 90, 1), strict=True):
        for _ in range(n):
            t = list(g)
            for _ in range(int(r.integers(0, 4))):
                t[int(r.integers(0, len(t)))] = word()
            rows.append((k := k + 3, " ".join(t)))
    rows += [(1000 + j, " ".join([word() for _ in range(40)] + base[4][:60])) for j in range(80)]  # a shared passage
    rows += [(None, rows[0][1]), (2000, None), (2001, " \t\n"), (2002, "One two"), (2003, "one TWO "), (2004, "É x"), (2005, "é x"), (2002, "One two"), (2006, "z " * 50000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    assert found(df) == brute(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_intersections():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = minhash.intersections(sets, chunk=64)
    assert all(got[i][j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_group_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 30)
    r = np.random.default_rng(9)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(int(r.integers(1, 9))):
            t[int(r.integers(0, len(t)))] = f"x{r.integers(0, 10**6)}"
        rows.append((k, " ".join(t)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_null_ids(spark):
    rows = [(None, f"one two three four {k // 2} six seven") for k in range(2000)] + [(None, "one text of many rows")] * 500 + [(3, "one two three four 7 six seven")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert len(got) == len(rows) and got.count((None, 3, 3, False)) == 2 and got.count((3, 3, 3, True)) == 1
    assert sum(k for *_, k in got) == len(rows) - 2


def test_a_passage_shared_by_many(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 64)
    compared = []
    strays = minhash._Join.strays
    monkeypatch.setattr(minhash._Join, "strays", lambda self, rest: compared.append(rest.select("node").distinct().count()) or strays(self, rest))
    r = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(50)]
    rows = [(k, " ".join([f"w{x}" for x in r.integers(0, 10**6, 70)] + passage)) for k in range(1500)]
    rows += [(2000 + k, rows[k][1] + " more") for k in range(0, 60, 2)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert got == brute(rows) and sum(compared) < 500  # branching leaves few to compare at the end


def test_deduplicated_rows(spark):
    rows = [(5, "a b c", "x"), (5, "a b c", "y"), (5, "d e f", "x"), (7, "a b c", "x"), (7, "d e f g", "x"), (None, "d e f", "x"), (9, None, "x"), (9, " ", "x"), (9, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = minhash.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "-") for r in got.collect()) == [(5, "a b c"), (5, "d e f"), (7, "d e f g"), (9, " "), (9, "-")]
