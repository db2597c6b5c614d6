import zlib

import duckdb

import corpus_pipeline as P
from brindle.llm import bpe, langid, mixing
from brindle.llm.queries import table, tokenizer_file
from tests.llm.test_minhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def test_stages_like_brute_force(spark):
    docs = table(spark, SF, "documents")
    first = P.language(spark, docs, SF)
    assert first.columns == docs.columns
    all_rows = {r["doc_id"]: r for r in docs.collect()}
    left = {r["doc_id"]: r for r in first.collect()}
    assert all(any(c.isalpha() for c in r["text"]) for r in left.values())
    assert sum(i in left for i, r in all_rows.items() if r["text"] and any(c.isalpha() for c in r["text"])) > 0.99 * len(all_rows)

    second = P.near_duplicates(spark, first, SF)
    want = {i for i, _, _, kept in brute([(r["doc_id"], r["text"]) for r in left.values()]) if kept}
    kept = {r["doc_id"]: r for r in second.collect()}
    assert {*kept} == want and second.columns == docs.columns

    third = P.mixture(spark, second, SF)
    con = duckdb.connect()
    con.register("documents", second.toArrow())
    chosen = {i for (i,) in con.execute(f"SELECT doc_id FROM ({mixing.sql(budget=P.BUDGET)}) WHERE sampled").fetchall()}
    assert 0.2 * len(kept) < len(chosen) < len(kept)
    assert {r["doc_id"] for r in third.collect()} == chosen and third.columns == docs.columns

    b = bpe.loaded(tokenizer_file())
    got = {r["doc_id"]: r["n_tokens"] for r in P.tokens(spark, third, SF).collect()}
    assert got == {i: len(b.encode(kept[i]["text"])) // 4 for i in chosen}
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == chosen


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog of the house", "en", "s", 1), (1, "the cat and the dog of the house", "en", "s", 1), (2, None, None, None, None), (3, "12 34", "en", "s", 5), (None, "der hund und die katze im haus", "de", "s", 1), (5, "the cat and the dog of the house", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    stage = P.language(spark, df, SF)
    assert sorted(map(str, (r["doc_id"] for r in stage.collect()))) == ["1", "1", "5", "None"]
    assert sorted(map(str, (r["doc_id"] for r in P.near_duplicates(spark, stage, SF).collect()))) == ["1", "None"]
    for _, f in P.STAGES:
        assert f(spark, df.limit(0), SF).count() == 0


def test_duplicates_go_by_row(spark):
    text = "the cat and the dog of the house by the sea"
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, "der hund und die katze im haus am see", "de", "b", 1), (1, text, "en", "b", 1)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(1, "en"), (2, "de")]


def test_unknown_language():
    assert zlib.crc32(b"1") % 3 in (0, 1, 2) and langid.UNKNOWN == "und"
