import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import sharding


def test_pack_balances_every_dimension():
    r = np.random.default_rng(1)
    sizes = np.column_stack([r.pareto(2, 5000) * 100, r.pareto(2, 5000) * 20, r.integers(1, 4, 5000)])
    bins = sharding.pack(sizes, 16)
    loads = np.array([sizes[bins == b].sum(axis=0) for b in range(16)])
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.01).all()


@pytest.mark.parametrize("block", [40_000, 300])
def test_documents(spark, block):
    r = np.random.default_rng(2)
    rows = [(i, " ".join("w" * int(x) for x in r.integers(1, 9, r.integers(0, 40)))) for i in range(3000)]
    rows += [(i, "a copy that a third of all rows share, ü") for i in range(3000, 4500)] + [(None, None), (7, None), (7, "")]
    got = sharding.shard_documents(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, shard int").repartition(6), block=block).collect()
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load, count, slots, homes = Counter(), Counter(), defaultdict(list), defaultdict(set)
    for g in got:
        load[g["shard"]] += g["size"]
        count[g["shard"]] += 1
        slots[g["shard"]].append(g["slot"])
        homes[g["text_crc32"], g["size"]].add(g["shard"])
    assert {*load} == {*range(16)} and max(load.values()) / (sum(load.values()) / 16) < 1.02 and max(count.values()) / (len(rows) / 16) < 1.1
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    assert len(homes[zlib.crc32("a copy that a third of all rows share, ü".encode()), 42]) == 16  # the hot group is cut
    assert all(g["law"] == "bytes" and g["grown_shard"] is None for g in got)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(none).count() == 0
    assert [(g["size"], g["slot"]) for g in sharding.shard_documents(spark.createDataFrame([(1, None)], none.schema)).collect()] == [(1, 0)]


@pytest.mark.parametrize("block", [40_000, 300])
def test_a_group_that_a_shard_can_take_stays_whole(spark, block):
    rows = [(i, f"text {i:04} of its own") for i in range(4000)] + [(4000 + i, f"copy {i % 4:04} of its own") for i in range(800)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    load, homes = Counter(), defaultdict(set)
    for g in got:
        load[g["shard"]] += g["size"]
        if g["doc_id"] >= 4000:
            homes[g["doc_id"] % 4].add(g["shard"])
    assert [len(homes[k]) for k in range(4)] == [1] * 4
    assert len(got) == len(rows) and max(load.values()) / (sum(load.values()) / 16) < 1.02
