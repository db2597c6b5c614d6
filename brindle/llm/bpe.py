"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols stand in a row; each place holds the rank of the pair that begins
there.  A segment tree keeps, for every stretch of places, the least (rank, place);
its root names the leftmost lowest-rank merge.  A merge changes three places, each
in logarithmic time, until the root says that no pair can merge.  A node has up to
``WIDE`` below it, so the tree of a usual word is its root alone.

``Bpe`` reads a byte-level BPE file: its merges, its byte alphabet and its special
tokens.  ``encode_documents`` gives ids, their digest and the decoded text's digest.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.encoder import Generations, Inseparable, checked, separable
from brindle.llm.workers import releasing

#: The split pattern of byte-level BPE files; fixed by their format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and pieces between spaces, in each of the two generations of their caches; workers live on from stage to stage.
CACHE = 240_000
#: Places, or nodes, below a node of the tree, as a power of two.
WIDE = 5
#: The rank of no pair.
NONE = 1 << 30


def byte_alphabet() -> dict[int, str]:
    """Bytes as the characters that stand for them: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merge_all(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merges symbols by rank until no pair is left.

    ranks: pair to rank; merged: rank to the id that the pair becomes.  Keys are a
    rank and, in their low bits, a place, so the least is the leftmost of the lowest rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    bits = (n - 2).bit_length()
    none, places, get = NONE << bits, (1 << bits) - 1, ranks.get
    keys = [get(p, NONE) << bits | i for i, p in enumerate(pairwise(symbols))]
    tree = [keys]
    while len(low := tree[-1]) > 1 << WIDE:
        tree.append([min(low[k : k + (1 << WIDE)]) for k in range(0, len(low), 1 << WIDE)])
    top = tree[-1]
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    while (key := min(top)) < none:
        i = key & places
        j = after[i]  # the pair's second symbol goes
        after[i] = k = after[j]
        symbols[i] = new = merged[key >> bits]
        symbols[j] = -1
        if k < n:
            before[k] = i
            keys[j] = none
            keys[i] = get((new, symbols[k]), NONE) << bits | i
        else:
            keys[i] = none
        if (h := before[i]) >= 0:
            keys[h] = get((symbols[h], new), NONE) << bits | h
        if top is not keys:
            for at in (h, i, j) if h >= 0 else (i, j):
                for low, high in pairwise(tree):
                    at >>= WIDE
                    least = min(low[at << WIDE : (at + 1) << WIDE], default=none)
                    if at == len(high) or high[at] == least:
                        break
                    high[at] = least
    return [s for s in symbols if s >= 0]


class Bpe:
    """A byte-level BPE vocabulary.  Ids are handed about as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import regex

        spec = checked(path)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): k for k, (a, b) in reversed([*enumerate(merges)])}
        self.merged = [vocab[a + b] for a, b in merges]
        self.byte_ids = [vocab[alphabet[b]] for b in range(256)]
        of = {c: b for b, c in alphabet.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in vocab.items():
            if s not in special:
                self.bytes[i] = bytes(of[c] for c in s)
        for s, i in special.items():
            self.bytes[i] = s.encode()
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(SPLIT).findall
        self.words = Generations(lambda words: map(self.word, words), CACHE)
        self.pieces = Generations(self.after_spaces, CACHE)

    def word(self, word: str) -> bytes:
        """Ids of one cut of the split pattern."""
        return array("I", merge_all([*map(self.byte_ids.__getitem__, word.encode())], self.ranks, self.merged)).tobytes()

    def run(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        return b"".join(self.words.look_up(self.split(text)))

    def after_spaces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces with a space before each: cut together, for a cut that begins with a space begins a piece."""
        cuts = self.split(" " + " ".join(separable(pieces)))
        out: list[bytes] = []
        for cut, ids in zip(cuts, self.words.look_up(cuts), strict=True):
            if cut[0] == " ":
                out.append(ids)
            else:
                out[-1] += ids
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; the special tokens' strings become the special tokens.

        Beside single spaces the cuts do not depend on what lies around (see encoder.py),
        so such texts go piece by piece, and each different piece is cut once.
        """
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            return b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self.run(p) for k, p in enumerate(parts))
        first, space, rest = text.partition(" ")
        if not space or text[-1] == " " or "  " in text:
            return self.run(text)
        try:
            return self.run(first) + b"".join(self.pieces.look_up(rest.split(" ")))
        except Inseparable:
            return self.run(text)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary a worker process, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, tokenizer: str, ids: bool = False) -> DataFrame:
    """Encodes and decodes every text where it is read; nothing is shuffled.

    docs: has ``doc_id`` and ``text``; other columns are not read.  Returns doc_id, n_tokens,
    ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of
    the decoded text in UTF-8) and, asked for, ``ids``.  A null text counts as empty: no
    tokens.  Null and repeated doc_ids pass through, a row each; an empty table stays empty.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            rows[0] = batch.column(0)
            for text in batch.column(1):
                raw = bpe.encode(text.as_py() or "")
                rows[1].append(len(raw) // 4)
                rows[2].append(hashlib.sha256(raw).hexdigest())
                rows[3].append(hashlib.sha256(bpe.decode(raw).encode()).hexdigest())
                if ids:
                    rows[4].append(array("i", raw).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(encode), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
