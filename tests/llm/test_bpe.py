import hashlib
import json
import random

import numpy as np
import pytest

from brindle.llm import bpe
from brindle.llm.queries import tokenizer_file


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def texts(n):
    r = random.Random(3)
    parts = ["a", "b", "th", "e", " ", "\n", "é", "你", "🙂", "'s", "<|endoftext|>", "1", "..", "  ", "\xa0", "\t"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_merges_like_a_scan():
    r = random.Random(1)
    ranks = {(a, b): k for k, (a, b) in enumerate(r.sample([(a, b) for a in range(6) for b in range(6)], 30))}
    merged = [r.randrange(6) for _ in ranks]
    for _ in range(500):
        symbols = [r.randrange(6) for _ in range(r.randint(0, 30))]
        want = list(symbols)
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks]:
            k, i = min(pairs)
            want[i : i + 2] = [merged[k]]
        assert bpe.merge_all(symbols, ranks, merged) == want


@pytest.mark.parametrize("wide", [1, 2, 5])
def test_trees_of_several_levels_merge_like_a_scan(monkeypatch, wide):
    monkeypatch.setattr(bpe, "WIDE", wide)
    test_merges_like_a_scan()


def test_a_usual_word_is_one_node(monkeypatch):
    b, asked = bpe.loaded(tokenizer_file()), []
    monkeypatch.setattr(bpe, "min", lambda *a, **k: asked.append(1) or min(*a, **k), raising=False)
    ids = b.word(" international")
    assert 0 < len(asked) <= 1 + len(" international") - len(ids) // 4  # a look at the root for each merge, and a last one


def test_equals_library():
    t, b = library(), bpe.loaded(tokenizer_file())
    for x in texts(1500):
        ids = t.encode(x, add_special_tokens=False).ids
        assert b.encode(x) == np.array(ids, "<u4").tobytes(), x
        assert b.decode(b.encode(x)) == t.decode(ids, skip_special_tokens=False)
    some = random.Random(2).choices(range(50257), k=3000)  # broken UTF-8 too
    assert b.decode(np.array(some, "<u4").tobytes()) == t.decode(some, skip_special_tokens=False)


def test_long_word_is_quick():
    x = "".join(random.Random(5).choice("abcdef") for _ in range(200_000))
    assert bpe.loaded(tokenizer_file()).encode(x) == np.array(library().encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_documents(spark):
    t = library()
    rows = [*enumerate(texts(60)), (None, None), (3, "again"), (3, "again"), (99, "")]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, ids string").repartition(3)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    got = bpe.encode_documents(df, tokenizer_file())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), tokenizer_file(), ids=True).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"model.ignore_merges": True}, {"model.dropout": 0.1}, {"pre_tokenizer.add_prefix_space": True}, {"pre_tokenizer": None}, {"added": "lstrip"}])
def test_other_files_are_refused(tmp_path, change):
    from brindle.llm import encoder

    spec = json.load(open(tokenizer_file(), encoding="utf-8"))
    ((key, value),) = change.items()
    if key == "added":
        spec["added_tokens"][0][value] = True
    else:
        at, *rest = key.split(".")
        if rest:
            spec[at][rest[0]] = value
        else:
            spec[at] = value
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w"))
    for make in (bpe.Bpe, encoder.PieceEncoder):
        with pytest.raises(ValueError, match="not a plain byte-level BPE file"):
            make(path)
