import numpy as np
import pytest

from brindle.operators import codes, tabular


def same(a, b):
    return a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_round_trip(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else "None" if k % 5 == 0 else f"v{k % 3}", k / 3 if k % 4 else None, ["!", "~", ".", "", "=x", None][k % 6]) for k in range(200)] + [(0, None, None, None)] * 3
    df = spark.createDataFrame(rows, "id long, s string, x double, marks string").repartition(5)
    tabular.compress_table(df, str(tmp_path / "c"))
    back = tabular.decompress_table(spark, str(tmp_path / "c"), "pos")
    assert back.schema.simpleString() == "struct<id:bigint,s:string,x:double,marks:string,pos:bigint>"
    assert same(back.drop("pos"), df) and back.select("pos").distinct().count() == len(rows)
    tabular.compress_table(df.limit(0), str(tmp_path / "e"))
    assert tabular.decompress_table(spark, str(tmp_path / "e")).count() == 0


def test_rare_values_are_kept_in_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "ALPHABET", 10)
    df = spark.createDataFrame([(k, f"c{k % 3}", k % 40) for k in range(100)], "id long, s string, n int")
    tabular.compress_table(df, str(tmp_path / "c"))
    rare = {r["column"]: r["count"] for r in spark.read.parquet(str(tmp_path / "c" / "rare")).groupBy("column").count().collect()}
    assert rare == {"id": 100, "n": 100} and same(tabular.decompress_table(spark, str(tmp_path / "c")), df)


def test_quantized_columns(spark, tmp_path):
    df = spark.createDataFrame([(k, [1, 2, 50, 51, 52, 90][k % 6] if k % 11 else None) for k in range(300)], "id long, n int")
    tabular.compress_table(df, str(tmp_path / "c"), ["n"], bins=3, many=8)
    got = {r["id"]: r["n"] for r in tabular.decompress_table(spark, str(tmp_path / "c")).collect()}
    want = {1: 2, 2: 2, 50: 51, 51: 51, 52: 51, 90: 90}
    assert all(got[r["id"]] == (None if r["n"] is None else want[r["n"]]) for r in df.collect())


def test_a_stream_without_its_end(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    tabular.compress_table(df, str(tmp_path / "c"))
    for t in ("book", "rare"):
        spark.read.parquet(str(tmp_path / "c" / t)).write.parquet(str(tmp_path / "d" / t))
    spark.read.parquet(str(tmp_path / "c" / "meta")).write.parquet(str(tmp_path / "d" / "meta"))
    spark.read.parquet(str(tmp_path / "c" / "blocks")).filter("column = 's'").write.parquet(str(tmp_path / "d" / "blocks"))
    with pytest.raises(ValueError, match="no end of id"):
        tabular.decompress_table(spark, str(tmp_path / "d"))


def plain_lloyd(values, n, a):
    best = float("inf")
    while True:
        j = [sum(x > (p + q) / 2 for p, q in zip(a, a[1:])) for x in values]
        if len(set(j)) < len(a):
            return a, -1.0
        mse = sum(c * (x - a[k]) ** 2 for x, c, k in zip(values, n, j)) / sum(n)
        if best - mse < 1e-5:
            return a, mse
        best = mse
        a = sorted(float(round(sum(x * c for x, c, q in zip(values, n, j) if q == k) / sum(c for c, q in zip(n, j) if q == k))) for k in range(len(a)))


@pytest.mark.parametrize("alone", [10**6, 0])
def test_runs_like_plain_ones(spark, monkeypatch, alone):
    monkeypatch.setattr(tabular, "ALONE", alone)
    r = np.random.default_rng(7)
    values = sorted({float(x) for x in r.integers(0, 5000, 400)})
    n = [int(x) for x in r.integers(1, 30, len(values))]
    h = spark.createDataFrame(list(zip(values, n)), "value double, n long")
    first = tabular.starts(h, 8, 6)
    assert len(first) == 6 and all(len(set(a)) == 8 and a == sorted(a) and set(a) <= set(values) for a in first) and len({tuple(a) for a in first}) == 6
    for (a, mse), start in zip(tabular.lloyd_max(h, first), first, strict=True):
        want, error = plain_lloyd(values, n, start)
        assert a == want and mse == pytest.approx(error)


def test_few_values(spark):
    h = spark.createDataFrame([(3.0, 5), (9.0, 1)], "value double, n long")
    assert tabular.best_of(h, 16) == ([3.0, 9.0], 0.0)
    assert tabular.best_of(h.limit(0), 16) == ([], 0.0)


def test_alphabets_are_checked_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(codes, "ALPHABET", 8)
    many = spark.createDataFrame([(g, s, 1) for g in range(9) for s in range(8)], "g int, symbol int, n long")
    assert codes.codebook(many, "g").count() == 72
    with pytest.raises(ValueError, match="more than 8"):
        codes.codebook(many.drop("g").withColumn("symbol", many["symbol"] + 8).unionByName(many.drop("g")))


def test_long_words():
    n = {k: 2**k for k in range(30)}
    lengths = codes.code_lengths([*n.items()])
    words = codes.canonical(lengths)
    assert max(lengths.values()) > codes.WINDOW
    symbols = [29, 0, 1, 28, 5, 0, 29, 29]
    bits = "".join(format(words[s], f"0{lengths[s]}b") for s in symbols)
    payload = np.packbits(np.array([*map(int, bits)], np.uint8)).tobytes()
    assert codes.decode_bits(payload, len(symbols), {(lengths[s], words[s]): s for s in n}) == symbols


@pytest.mark.parametrize("k", [1, 3, 8, 10])
def test_golomb_words(spark, k):
    from pyspark.sql import functions as F

    from brindle.functions.pixels import golomb

    df = spark.range(300).select(F.col("id").alias("pos"), (F.col("id") * 37 % 256).alias("v")).withColumn("word", golomb(F.col("v"), k))
    rows = df.select("v", "word", *codes.golomb_words(F.col("v"), k)).collect()
    assert all(r["len"] == len(r["word"]) and r["code"] == int(r["word"], 2) for r in rows)
    back = codes.golomb_decoded(codes.packed(df.select("pos", *codes.golomb_words(F.col("v"), k)), block=64), k, block=64)
    assert {r["pos"]: r["symbol"] for r in back.collect()} == {r["pos"]: r["v"] for r in df.collect()}
