import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brindle.llm import fingerprint


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(rows):
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
    return out


def test_gamma_quantiles():
    x = np.array(fingerprint.gamma_quantiles())
    assert abs(x.mean() - 2) < 0.01 and abs(x.var() - 2) < 0.05 and (np.diff(x) > 0).all()


def test_documents(spark):
    r = np.random.default_rng(4)
    words = np.array([f"wö{k}" for k in range(300)])
    rows = [(3 * i, " ".join(words[r.zipf(1.3, r.integers(1, 200)) % 300])) for i in range(100)]
    rows[10:13] = [(30, rows[10][1]), (33, rows[10][1]), (36, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, term string").repartition(7)
    got = {g["doc_id"]: g for g in fingerprint.fingerprint_documents(df).collect()}
    assert len(got) == len(rows)
    want, text = edited(rows), dict(rows)
    error = []
    for k, (i, t) in enumerate(rows):
        g, after = got[i], rows[(k + 1) % len(rows)][1]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        if t and after:
            error += [g["near_edited"] - jaccard(t, want[i]), g["near_next"] - jaccard(t, after)]
    # documents share the hashes, so their errors do not average out
    assert abs(np.mean(error)) < 0.5 / fingerprint.SAMPLES**0.5 and np.std(error) < 1.3 * 0.5 / fingerprint.SAMPLES**0.5
    assert got[30]["fingerprint"] == got[33]["fingerprint"] and got[30]["near_next"] == 1 and text[36] == ""


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprint.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    (one,) = fingerprint.fingerprint_documents(spark.createDataFrame([(5, "abc d")], schema)).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcab").hexdigest() and one["near_next"] == 1
    rows = [(None, "a b c d"), (1, None), (1, "x y"), (1, "x y"), (2, "q " * 40000)]
    got = fingerprint.fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted(g["n_chars"] for g in got) == [0, 3, 3, 7, 80000]
    assert all(0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 for g in got)


def test_draws_are_gamma(spark):
    r, c, b = np.array(spark.range(200_000).select(*fingerprint.draws(F.xxhash64("id"), 3)).collect()).T
    want = np.array(fingerprint.gamma_quantiles())
    at = (np.arange(len(want)) + 0.5) / len(want)
    for x in (r, c):
        assert abs(np.searchsorted(np.sort(x), want) / len(x) - at).max() < 0.005 and len(np.unique(x)) > 199_000
    assert c.min() < 0.01 and abs(np.corrcoef([r, c, b]) - np.eye(3)).max() < 0.01


def test_many_terms_are_sampled_by_weight(spark):
    # one term has 30 % of the weight of 100,001 distinct ones
    terms = spark.range(100_001).select("id", F.xxhash64("id").alias("term"), F.log(F.when(F.col("id") == 0, 42_857.0).otherwise(1.0)).alias("lw")).cache()
    columns, chosen = fingerprint.sample_columns(F.col("term"), F.col("lw"), 256), 0
    for k in range(0, 256, 32):
        least = terms.agg(*(F.min(c) for c in columns[k : k + 32])).first()
        own = terms.filter("id = 0").select(*columns[k : k + 32]).first()
        chosen += sum(x == y for x, y in zip(least, own, strict=True))
    assert abs(chosen / 256 - 0.3) < 0.09


def plain_print(text, samples=fingerprint.SAMPLES):
    """Consistent weighted sampling of one text, term by term."""

    def least(k, terms):
        best = None
        for term, n in terms.items():
            h = xxhash.xxh64_intdigest(term.encode(), 42)
            u = [((xxhash.xxh64_intdigest((5 * k + j).to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)) >> 12) + 0.5) * 2.0**-52 for j in range(5)]
            r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            t = math.floor(math.log(n) / r + u[4])
            log_a = math.log(c) - r * (t - u[4] + 1)
            at = int((log_a + 1024) * (1 << 20)), (h ^ ((t & 0x7FFFFFFF) * 2654435769)) & 0xFFFFFFFF
            best = at if best is None else min(best, at)
        return f"{best[1]:08x}"

    terms = Counter(w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w) or {"": 1}
    return "".join(least(k, terms) for k in range(samples))


def test_like_plain_sampling(spark):
    rows = [(1, " a b b  c "), (2, "a b b c"), (3, None), (4, "\n\t "), (5, " ".join(f"w{k % 37}" for k in range(500))), (6, "ü x " * 100)]
    got = {g["doc_id"]: g for g in fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["fingerprint"] for i, _ in rows} == {i: plain_print(t or "") for i, t in rows}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1
    assert {i: got[i]["edited_fingerprint"] for i, _ in rows} == {i: plain_print(t) for i, t in edited([(i, t or "") for i, t in rows]).items()}


def test_one_doc_id_is_cut(spark):
    rows = [(7 if k % 3 else k, f"t{k % 400} u{k % 5} v") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fingerprint.fingerprint_documents(df)
    got = out.collect()
    assert sorted(g["doc_id"] for g in got) == sorted(i for i, _ in rows)
    assert max(Counter(r["p"] for r in out.select("doc_id", F.spark_partition_id().alias("p")).collect()).values()) < 1000
    # texts of the order: all that is known of ties is that equal texts stand together
    assert Counter(g["fingerprint"] for g in got) == Counter(plain_print(t) for _, t in rows)


def test_a_range_adds_one_string_to_the_plan(spark):
    df = spark.createDataFrame([(k, f"t{k} u v") for k in range(2000)], "doc_id long, text string")
    size, before = {}, spark.conf.get("spark.sql.shuffle.partitions")
    for n in (8, 211):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        size[n] = len(fingerprint.fingerprint_documents(df)._jdf.queryExecution().analyzed().toString())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert size[211] < size[8] + 2 * 50 * 2 * 211
