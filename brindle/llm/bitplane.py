"""Token-ID output: bit-plane shuffled blocks with a chunk index.

The file format is a table of chunks (a Parquet directory, so that any store Spark
can write to holds it and a failed task leaves nothing behind).  A chunk holds one
fixed-size block of ids of a shard:

* ``shard, chunk``: place; shards ascend by doc_id, chunks within a shard by number;
* ``first``: ids of the shard before the block; ``n_ids``: ids in the block;
* ``planes``: the block transposed into bit planes (plane b has bit b of every id,
  packed eight to a byte, first id in the highest bit) or byte planes (plane b has
  byte b of every id), each compressed with zstandard;
* ``doc_no``: number in the shard of the first document that begins in the block,
  ``doc_ids, doc_starts``: the documents that begin there and where.

The chunk index beside it has all columns but the planes, with ``base``: ids of all
shards before.  A reader finds a document or a position by the index and decodes
only the blocks it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.encoder import encoder
from brindle.storage import parallelism, stored

CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_no", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))])
CHUNK_DDL = "shard int, chunk int, first long, n_ids int, doc_no long, doc_ids array<long>, doc_starts array<int>, planes array<binary>"
PIECE_DDL = "shard int, doc_no long, chunk int, doc_id long, at long, n long, crc long, whole boolean"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Transposes a block into as many planes as its largest id needs, each compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    if mode == "bit":
        return [pack(np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes()) for b in range(bits)]
    if mode == "byte":
        columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [pack(np.ascontiguousarray(columns[:, b]).tobytes()) for b in range(-(-bits // 8))]
    raise ValueError(f"planes are 'bit' or 'byte', not {mode!r}")


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The block's ids."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    if mode == "bit":
        ids = np.zeros(n, "<u4")
        for b, plane in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(unpack(plane), np.uint8), count=n).astype("<u4") << np.uint32(b)
        return ids
    columns = np.zeros((n, 4), np.uint8)
    for b, plane in enumerate(planes):
        columns[:, b] = np.frombuffer(unpack(plane), np.uint8)
    return columns.view("<u4").ravel()


class _Shard:
    """Gathers a shard's ids and cuts them into blocks."""

    def __init__(self, shard: int, block: int, mode: str):
        self.shard, self.block, self.mode = shard, block, mode
        self.waiting, self.chunk, self.first, self.docs, self.starts, self.doc_no = bytearray(), 0, 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        # a block that is full goes out before a new document begins
        yield from self.full(self.block)
        self.docs.append(doc_id)
        self.starts.append(len(self.waiting) // 4)
        self.waiting += ids
        yield from self.full(self.block)

    def full(self, least: int) -> Iterator[dict]:
        while len(self.waiting) >= max(4, 4 * least):
            ids = np.frombuffer(bytes(self.waiting[: 4 * self.block]), "<u4")
            yield {"shard": self.shard, "chunk": self.chunk, "first": self.first, "n_ids": len(ids), "doc_no": self.doc_no, "doc_ids": self.docs, "doc_starts": self.starts, "planes": to_planes(ids, self.mode)}
            del self.waiting[: 4 * self.block]
            self.chunk, self.first, self.doc_no = self.chunk + 1, self.first + len(ids), self.doc_no + len(self.docs)
            self.docs, self.starts = [], []


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = 65536, mode: str = "byte") -> None:
    """Encodes every text, appends ``end_id`` and writes the chunks in ascending doc_id order.

    docs: has ``doc_id`` and ``text``; other columns are not read.  A null text counts
    as empty, so it has the end id alone.  Null doc_ids come first; rows of one doc_id
    are ordered by a hash of their text, and each is a document of its own.  Ranges of
    (doc_id, hash, row) make the shards, so neither repeated doc_ids nor copies of one row
    meet in one task.  An empty table gives an empty chunk table.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc, end = _Shard(TaskContext.get().partitionId(), block, mode), encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            texts = (t or "" for t in batch.column(1).to_pylist())
            out = [c for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True) for c in shard.add(doc_id, ids + end)]
            if out:
                yield pa.RecordBatch.from_pylist(out, CHUNK)
        if out := [*shard.full(block), *shard.full(1)]:
            yield pa.RecordBatch.from_pylist(out, CHUNK)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(parallelism(spark), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    ordered.mapInArrow(encode, CHUNK_DDL).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_DDL).parquet(f"{path}/chunks").drop("planes")
    # one row a shard: as many as write tasks
    base = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    chunks.join(F.broadcast(base), "shard").write.parquet(f"{path}/index")


@lru_cache(maxsize=64)
def _zeros_operator(power: int) -> tuple[int, ...]:
    """How 2**power zero bytes move a crc32: a 32 x 32 matrix over GF(2)."""
    if power == 0:
        m = (0xEDB88320, *(1 << k for k in range(31)))  # one zero bit
        for _ in range(3):
            m = tuple(_times(m, x) for x in m)
        return m
    m = _zeros_operator(power - 1)
    return tuple(_times(m, x) for x in m)


def _times(m: tuple[int, ...], x: int) -> int:
    out = 0
    for row in m:
        if not x:
            break
        if x & 1:
            out ^= row
        x >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings set together, from each one's, and the second's length."""
    power = 0
    while length:
        if length & 1:
            first = _times(_zeros_operator(power), first)
        length, power = length >> 1, power + 1
    return first ^ second


def read_ids(spark: SparkSession, path: str, mode: str = "byte") -> DataFrame:
    """Reads the chunks back: a row a document with its start, length and checksum.

    Every block is decoded once, wherever it is; a document over several blocks is a few
    short pieces, whose checksums are put together by their lengths, so no task ever holds
    more ids than a block has.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                raw = from_planes(c["planes"], c["n_ids"], mode).astype("<u4").tobytes()
                docs, starts = c["doc_ids"], c["doc_starts"]
                if not starts or starts[0]:
                    docs, starts, at = [None, *docs], [0, *starts], c["doc_no"] - 1
                else:
                    at = c["doc_no"]
                for k, (doc_id, lo, hi) in enumerate(zip(docs, starts, [*starts[1:], c["n_ids"]], strict=True)):
                    # where a block begins and ends, a document may go on in another
                    whole = (k > 0 or bool(c["doc_starts"]) and c["doc_starts"][0] == 0) and hi < c["n_ids"]
                    out.append((c["shard"], at + k, c["chunk"], doc_id, c["first"] + lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]), whole))
            if out:
                names = [f.split()[0] for f in PIECE_DDL.split(", ")]
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def whole_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for parts in batch.column(4).to_pylist():
                total = 0
                for k, p in enumerate(sorted(parts, key=lambda p: p["chunk"])):
                    total = joined_crc(total, p["crc"], 4 * p["n"]) if k else p["crc"]
                crc.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n", "crc"])

    chunks = spark.read.schema(CHUNK_DDL).parquet(f"{path}/chunks")
    found = stored(chunks.mapInArrow(pieces, PIECE_DDL), "pieces")
    parts = found.filter("NOT whole").groupBy("shard", "doc_no").agg(F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.collect_list(F.struct("chunk", "crc", "n")).alias("p"))
    docs = found.filter("whole").select("shard", "doc_id", "at", "n", "crc").unionByName(parts.select("shard", "doc_id", "at", "n", "p").mapInArrow(whole_crc, "shard int, doc_id long, at long, n long, crc long"))
    base = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.first("base").alias("base"))  # one row a shard
    return docs.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def span(spark: SparkSession, path: str, start: int, stop: int, mode: str = "byte") -> np.ndarray:
    """The ids at positions start to stop of the whole corpus; only the blocks in question are read."""
    index = spark.read.parquet(f"{path}/index").withColumn("lo", F.col("base") + F.col("first"))
    hit = index.filter((F.col("lo") < stop) & (F.col("lo") + F.col("n_ids") > start)).select("shard", "chunk", "lo").collect()  # as few as the span has blocks
    if not hit:
        return np.zeros(0, "<u4")
    place = {(r["shard"], r["chunk"]): r["lo"] for r in hit}
    where = F.struct("shard", "chunk").isin([F.struct(F.lit(a).cast("int"), F.lit(b).cast("int")) for a, b in place])
    rows = spark.read.schema(CHUNK_DDL).parquet(f"{path}/chunks").filter(F.col("shard").isin(sorted({a for a, _ in place})) & where).collect()
    rows.sort(key=lambda r: place[r["shard"], r["chunk"]])
    ids = np.concatenate([from_planes(r["planes"], r["n_ids"], mode) for r in rows])
    low = place[rows[0]["shard"], rows[0]["chunk"]]
    return ids[max(0, start - low) : stop - low]
