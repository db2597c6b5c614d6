import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bitplane
from brindle.llm.encoder import PieceEncoder
from brindle.llm.queries import tokenizer_file

TEXTS = ["a  b", "a \n b", "\n b\n\n c  d", "x\n <|endoftext|> y", " lead", "trail ", "", " ", "it's 's 'S", "\t a \r\n b", "ab  cd 　 e", "né 你好 🙂 x", "a\n \tb", "a\xa0 \n b c", None]


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_equal_whole_texts():
    e = PieceEncoder(tokenizer_file(), cache=3)
    texts = [t for t in TEXTS if t is not None] + ["the cat the dog a b c d e f g", "the cat sat"]
    assert list(e.encode(texts)) == [e.whole(t) for t in texts]


def test_first_words_are_encoded_once():
    e, asked = PieceEncoder(tokenizer_file()), []

    class Counted:
        def encode_batch_fast(self, texts, library=e.tokenizer, **k):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **k)

    e.tokenizer = Counted()
    a, b = e.encode(["the cat", "the cat"])
    assert a == b and asked == ["the", " cat"]


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 70000, n).astype("<u4")
    assert (bitplane.from_planes(bitplane.to_planes(ids, mode), n, mode) == ids).all()


def test_joined_crc():
    a, b = b"some bytes", b"and others" * 99
    assert bitplane.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_file_equals_brute_force(spark, tmp_path, mode):
    rows = [*enumerate(TEXTS), (50, "long " * 3000), (51, "ünd so weiter " * 50)]
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], "doc_id long, text string, shard string, planes int").repartition(5)
    bitplane.write_ids(docs, str(tmp_path / "ids"), tokenizer_file(), 2, block=64, mode=mode)
    got = sorted(map(tuple, bitplane.read_ids(spark, str(tmp_path / "ids"), mode).collect()))
    assert got == brute(rows)
    whole = bitplane.span(spark, str(tmp_path / "ids"), 0, 10**9, mode)
    assert (bitplane.span(spark, str(tmp_path / "ids"), 70, 333, mode) == whole[70:333]).all()


def test_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    bitplane.write_ids(none, str(tmp_path / "none"), tokenizer_file(), 2)
    assert bitplane.read_ids(spark, str(tmp_path / "none")).count() == 0
    twice = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, None)], "doc_id long, text string")
    bitplane.write_ids(twice, str(tmp_path / "twice"), tokenizer_file(), 2)
    got = bitplane.read_ids(spark, str(tmp_path / "twice"))
    assert got.count() == 4 and got.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first() == (9, 9)


def test_copies_of_one_row_are_cut(spark, tmp_path):
    rows = [(3, "one text of many copies")] * 4000 + [(1, "a"), (9, "b")]
    path = str(tmp_path / "ids")
    bitplane.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, tokenizer_file(), end_id=2, block=256)
    chunks = spark.read.parquet(f"{path}/chunks")
    per = {r["shard"]: r["n"] for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    assert len(per) > 4 and max(per.values()) < 0.5 * sum(per.values())
    got = bitplane.read_ids(spark, path).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert len(got) == 4002 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert len({r["ids_crc32"] for r in got}) == 3
