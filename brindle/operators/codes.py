"""Huffman and Golomb codes, run lengths, bit packing and their inverses.

Code tables come from a heap over the alphabet, which is bounded and checked, a task a
table; all that touches the data is joins, aggregates and packing by blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.storage import stored

#: Symbols of an alphabet at most; the table is built in one task and broadcast.
ALPHABET = 1 << 16
#: Bits that the decoder looks up at once.
WINDOW = 12


def frequencies(symbols: DataFrame, *by: str) -> DataFrame:
    """Counts of ``symbol`` (A1), in each group of ``by``."""
    return symbols.groupBy(*by, "symbol").agg(F.count("*").alias("n"))


def code_lengths(freqs: list[tuple[object, int]]) -> dict[object, int]:
    """Huffman code lengths; the lighter two merge, ties by the first symbol; one symbol has length 1."""
    heap = [(n, s, [(s, 0)]) for s, n in freqs]
    heapq.heapify(heap)
    if len(heap) == 1:
        return {heap[0][1]: 1}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], a[1], [(s, d + 1) for s, d in a[2] + b[2]]))
    return dict(heap[0][2]) if heap else {}


def canonical(lengths: dict[object, int]) -> dict[object, int]:
    """Canonical codes by (length, symbol)."""
    out, code, before = {}, -1, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code = (code + 1) << (n - before)
        out[s], before = code, n
    return out


def codebook(freqs: DataFrame, *by: str) -> DataFrame:
    """``by..., symbol, n, len, code``; one book a group, built by a task of its own, after a check of the largest alphabet."""
    freqs = stored(freqs.select(*by, "symbol", F.col("n").cast("long").alias("n")), "freqs")
    largest = freqs.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > ALPHABET:
        raise ValueError(f"more than {ALPHABET} symbols")

    def book(g: pd.DataFrame) -> pd.DataFrame:
        f = sorted(zip(g["symbol"].tolist(), g["n"].tolist(), strict=True))
        lengths = code_lengths(f)
        words = canonical(lengths)
        first = {b: g[b].iloc[0] for b in by}
        return pd.DataFrame({**first, "symbol": [s for s, _ in f], "n": [n for _, n in f], "len": [lengths[s] for s, _ in f], "code": [words[s] for s, _ in f]})

    schema = T.StructType([*freqs.schema.fields, T.StructField("len", T.IntegerType()), T.StructField("code", T.LongType())])
    return stored(freqs.groupBy(*by).applyInPandas(book, schema), "book")


def encoded(symbols: DataFrame, book: DataFrame, *by: str) -> DataFrame:
    """Symbols with their code words (J5); the book is no larger than ``ALPHABET``."""
    return symbols.join(F.broadcast(book.drop("n")), [*by, "symbol"])


def packed(words: DataFrame, order: str = "pos", block: int = 4096, *by: str) -> DataFrame:
    """Packs ``len, code`` in the order of dense positions: ``by..., block, n, n_bits, payload``.

    A block has a fixed number of words, so blocks are packed, and later decoded, apart;
    within one, bits go from the highest of a byte to the lowest, and zeros fill the last byte.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lengths, codes = None, [], []

        def close() -> dict:
            n, c = np.array(lengths, np.int64), np.array(codes, np.int64)
            ends = np.cumsum(n)
            which = np.repeat(np.arange(len(n)), n)
            shift = np.minimum(ends[which] - np.arange(ends[-1] if len(ends) else 0) - 1, 63)  # a word may begin with many zeros
            stream = ((c[which] >> shift) & 1).astype(np.uint8)
            return {**dict(zip([*by, "block"], now, strict=True)), "n": len(n), "n_bits": len(stream), "payload": np.packbits(stream).tobytes()}

        for batch in batches:
            out = []
            for *key, length, code in zip(*(batch.column(k).to_pylist() for k in range(len(by) + 3)), strict=True):
                if lengths and key != now:
                    out.append(close())
                    lengths, codes = [], []
                now = key
                lengths.append(length)
                codes.append(code)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if lengths:
            yield pa.RecordBatch.from_pylist([close()], schema)

    keys = words.select(*by).schema
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([*((f.name, kinds[f.dataType.simpleString()]) for f in keys), ("block", pa.int64()), ("n", pa.int64()), ("n_bits", pa.int64()), ("payload", pa.binary())])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "block long, n long, n_bits long, payload binary"])
    rows = words.withColumn("block", F.floor(F.col(order) / block))
    rows = rows.repartition(*by, "block").sortWithinPartitions(*by, "block", order).select(*by, "block", F.col("len").cast("long"), F.col("code").cast("long"))
    return rows.mapInArrow(pack, ddl)


def decode_bits(payload: bytes, n: int, table: dict[tuple[int, int], object]) -> list:
    """The first ``n`` symbols of a packed block (C3, J6); table: (length, code) to symbol."""
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    # the next WINDOW bits at every place, and for each such number the word that it begins with
    padded = np.concatenate([bits, np.zeros(WINDOW, np.uint8)]).astype(np.int64)
    ahead = sum(padded[j : j + len(bits)] << (WINDOW - 1 - j) for j in range(WINDOW)).tolist() if len(bits) else []
    short: list = [None] * (1 << WINDOW)
    for (length, code), symbol in table.items():
        if length <= WINDOW:
            lo = code << (WINDOW - length)
            short[lo : lo + (1 << (WINDOW - length))] = [(length, symbol)] * (1 << (WINDOW - length))
    out, at = [], 0
    for _ in range(n):
        found = short[ahead[at]]
        if found is None:  # a longer word
            length, code = WINDOW, ahead[at]
            while (length, code) not in table:
                code, length = 2 * code + int(bits[at + length]), length + 1
            found = length, table[length, code]
        at += found[0]
        out.append(found[1])
    return out


def decoded(blocks: DataFrame, book: DataFrame, *by: str, block: int = 4096) -> DataFrame:
    """``by..., pos, symbol`` of packed blocks: every block is decoded apart."""
    rows = book.select(*by, "symbol", "len", "code").collect()  # an alphabet
    tables: dict[tuple, dict] = {}
    for r in rows:
        tables.setdefault(tuple(r[b] for b in by), {})[r["len"], r["code"]] = r["symbol"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, b, n, payload in zip(*(batch.column(k).to_pylist() for k in range(len(by) + 3)), strict=True):
                symbols = decode_bits(payload, n, tables[tuple(key)])
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, kind) for k, kind in zip(key, kinds, strict=True)), pa.array(range(b * block, b * block + n), pa.int64()), pa.array(symbols, symbol)], [*by, "pos", "symbol"])

    to_arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    kinds = [to_arrow[f.dataType.simpleString()] for f in book.select(*by).schema]
    symbol = to_arrow[book.schema["symbol"].dataType.simpleString()]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in book.select(*by).schema), "pos long", f"symbol {book.schema['symbol'].dataType.simpleString()}"])
    return blocks.select(*by, "block", "n", "payload").mapInArrow(read, ddl)


def golomb_words(v: Column, k: int) -> list[Column]:
    """``len`` and ``code`` of a value's Golomb word (C9); its zeros in front are in the length alone."""
    b = (k - 1).bit_length()
    short = (1 << b) - k  # remainders with one bit less
    r = F.pmod(v, F.lit(k)).cast("long")
    less = (r < short) if short not in (0, 1 << b) else F.lit(False)
    bits = F.when(less, b - 1).otherwise(b)
    tail = F.when(less, r).otherwise(r + (short if short not in (0, 1 << b) else 0))
    return [(F.floor(v / k) + 1 + bits).cast("long").alias("len"), (F.when(less, 1 << max(b - 1, 0)).otherwise(1 << b) + tail).cast("long").alias("code")]


def golomb_decoded(blocks: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``pos, symbol`` of packed Golomb words: every block is decoded apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                stream = "".join(map(str, np.unpackbits(np.frombuffer(payload, np.uint8)).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(range(b * block, b * block + n), pa.int64()), pa.array(golomb_decode(stream, k, n), pa.int64())], ["pos", "symbol"])

    return blocks.select("block", "n", "payload").mapInArrow(read, "pos long, symbol long")


def golomb_decode(stream: str, k: int, n: int | None = None) -> list[int]:
    """Values of Golomb words, all or the first n, for any k."""
    b = (k - 1).bit_length()
    short = (1 << b) - k
    out, at = [], 0
    while at < len(stream) if n is None else len(out) < n:
        q = stream.index("1", at) - at
        at += q + 1
        r = 0
        if b:
            low = b - 1 if short not in (0, 1 << b) else b
            r = int(stream[at : at + low] or "0", 2)
            at += low
            if low < b and r >= short:
                r = 2 * r + int(stream[at]) - short
                at += 1
        out.append(q * k + r)
    return out


def runs(ordered: DataFrame, symbol: str, *by: str, pos: str = "pos") -> DataFrame:
    """Run lengths (W3): ``by..., run, symbol, start, len``, runs numbered by their start in each group.

    A run begins where the symbol differs from the one before (a join on the position);
    a run's length is the distance to the next one's start, so only starts are ordered.
    """
    from brindle.operators.order import positions, with_previous

    marked = with_previous(ordered.select(*by, pos, symbol), [symbol], 1, pos, by)
    starts = marked.filter(~F.col(symbol).eqNullSafe(F.col(f"{symbol}_1")) | (F.col(pos) == 0)).select(*by, F.col(pos).alias("start"), F.col(symbol).alias("symbol"))
    numbered = positions(starts, *by, "start", name="_all")
    if by:
        first = numbered.groupBy(*by).agg(F.min("_all").alias("_first"))
        size = ordered.groupBy(*by).agg(F.count("*").alias("_n"))
        numbered = numbered.join(first, list(by)).join(size, list(by)).withColumn("run", F.col("_all") - F.col("_first"))
    else:
        n = ordered.count()
        numbered = numbered.withColumns({"run": F.col("_all"), "_n": F.lit(n)})
    after = numbered.select(*by, (F.col("run") - 1).alias("run"), F.col("start").alias("_next"))
    out = numbered.join(after, [*by, "run"], "left")
    return out.select(*by, "run", "symbol", "start", (F.coalesce("_next", "_n") - F.col("start")).cast("long").alias("len"))


def unrolled(found: DataFrame, *by: str) -> DataFrame:
    """Runs back to ``by..., pos, symbol``."""
    return found.select(*by, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"), "symbol")


def bit_total(book: DataFrame, *by: str) -> DataFrame:
    """Symbols, code bits, and entropy in bits of each book."""
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    p = F.col("n") / F.sum("n").over(total)
    return book.withColumn("_h", -p * F.log2(p)).groupBy(*by).agg(F.count("*").alias("n_symbols"), F.sum("n").alias("n_values"), F.sum(F.col("n") * F.col("len")).alias("n_bits"), F.max("len").alias("longest"), F.sum("_h").alias("entropy"))
