import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing
from brindle.llm.queries import op2_mixing, table


def test_rake_meets_marginals():
    cells = {(a, b): v for a, b, v in [("x", "p", 10.0), ("x", "q", 5.0), ("y", "p", 1.0), ("y", "q", 30.0), ("z", "p", 7.0)]}
    shares, error = mixing.rake(cells, [{"x": 0.2, "y": 0.7, "gone": 0.5, "z": 0}, {"p": 0.3, "q": 0.7}])
    assert error < 1e-9
    assert sum(v for (a, _), v in shares.items() if a == "x") == pytest.approx(0.2 / 0.9)
    assert sum(v for (_, b), v in shares.items() if b == "q") == pytest.approx(0.7)
    odds = lambda w: w["x", "p"] * w["y", "q"] / w["x", "q"] / w["y", "p"]
    assert odds(shares) == pytest.approx(odds(cells))  # raking keeps the interaction


def test_probabilities_spend_the_budget():
    cells = {("a",): 100.0, ("b",): 10.0, ("c",): 50.0}
    p = mixing.probabilities(cells, {("a",): 0.3, ("b",): 0.5, ("c",): 0.2}, 80.0)
    assert p["b",] == 1 and sum(p[c] * cells[c] for c in cells) == pytest.approx(80) and p["a",] / p["c",] == pytest.approx(0.3 / 100 / (0.2 / 50))


def test_sample_has_the_targets(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = mixing.mix(docs).cache()
    total, kept = got.agg(F.sum("tokens")).first()[0], got.filter("sampled")
    assert abs(kept.agg(F.sum("tokens")).first()[0] / total - mixing.BUDGET) < 0.02
    values = got.groupBy("source", "topic").agg(F.sum("tokens").alias("n")).cache()
    targets = {d: mixing.TARGETS[d] if d == "lang" else mixing.tempered(values.groupBy(d).agg(F.sum("n").alias("n")), d, mixing.TARGETS[d]) for d in mixing.DIMS}
    for d, target in targets.items():
        scale = 1 - target.get(mixing.REST, 0) * (got.filter(~F.coalesce(F.col(d).isin([*target]), F.lit(False)) & (F.col("tokens") > 0)).isEmpty())
        for k, v in target.items():
            if k != mixing.REST:
                share = kept.filter(F.col(d) == k).agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0] / total
                assert abs(share - v / scale) < 0.03, (d, k)
    assert got.filter("tokens > 0 AND probability = 0").isEmpty()
    assert got.select("topic").distinct().count() > 5


def test_targets_that_cannot_hold(spark):
    rows = [(k, "a b c", "s", "en" if k % 2 else "de") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    shares, error = mixing.rake({("x", "p"): 1.0, ("y", "q"): 1.0}, [{"x": 0.9, "y": 0.1}, {"p": 0.2, "q": 0.8}])
    assert error > 0.5 and sum(shares.values()) == pytest.approx(1)
    two = {"source": {"s": 1.0, "*": 0.1}, "lang": {"en": 0.5, "*": 0.5}, "topic": 0.5}
    assert {r["probability"] for r in mixing.mix(df, two).collect()} == {0.5}
    with pytest.raises(ValueError, match="no share"):
        mixing.mix(df, two | {"lang": {"en": 1.0}})
    other = spark.createDataFrame([(1, "a b c", "x", "en"), (2, "a b c", "y", "de")], df.schema)
    with pytest.warns(UserWarning, match="cannot hold"):
        mixing.mix(other, {"source": {"x": 0.9, "*": 0.1}, "lang": {"en": 0.2, "*": 0.8}, "topic": 0.5})


def test_words_are_counted_like_plain():
    texts = ["", None, " a  bb\tccc\n", "été x", "a\x0bb\x0cc\rd", "漢字 😀 w", "  ", "end"]
    want = []
    for t in texts:
        n = [0] * mixing.BUCKETS
        for w in (t or "").encode().split():
            n[(w[0] + 5 * len(w)) % mixing.BUCKETS] += 1
        want.append(n)
    assert mixing.word_counts(pa.array(texts)).tolist() == want
    assert mixing.word_counts(pa.array(["zz", *texts])[1:]).tolist() == want
    assert mixing.word_counts(pa.array([], pa.string())).tolist() == []


def test_like_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT doc_id, source, lang, topic, tokens, probability, weight, sampled FROM ({mixing.sql()})").fetchall())
    got = sorted(map(tuple, op2_mixing(spark, "/root/testdata/sf0.01").collect()))
    assert len(got) == len(want) == 1000
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:7], abs=2e-6) and g[7] == w[7]


def test_odd_rows(spark):
    rows = [(1, "a b c", None, None, 3), (None, "a b c", "src0", "en", 3), (2, None, "src0", "en", 3), (3, "", "src1", "en", 3), (4, "x | y | z", "src0", "en", 3), (4, "x | y | z", "src0", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    got = mixing.mix(df, budget=1.0).collect()
    assert len(got) == 6 and {g["topic"] for g in got} == {"none"} | {g["topic"] for g in got if g["tokens"]} and {g["tokens"] for g in got} == {0, 3, 5} and all(0 <= g["probability"] <= 1 for g in got)
    assert not any(g["sampled"] for g in got if not g["text"])
    assert mixing.mix(df.limit(0)).count() == 0
