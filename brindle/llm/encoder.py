"""Token ids of whole texts from the ``tokenizers`` library, with a cache of pieces.

A byte-level BPE file first cuts a text by a pattern in which a space can only be
the first character of a cut, or part of a run of white space.  So a cut falls before
every space that has no white space beside it on either side, or on its left side
only; pieces between such spaces can be encoded apart.  Texts with two spaces in a row,
a space at the end, white space right after a space, or the special token's string
are encoded whole: there the cuts depend on what lies around.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: Pieces held at most in each of the two generations of a cache.
CACHE = 450_000


def checked(path: str) -> dict:
    """A tokenizer file, if it is byte-level BPE with the settings that this module and ``bpe`` are right for; others are refused."""
    spec = json.load(open(path, encoding="utf-8"))
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        *[f"model {model.get('type')!r}"] * (model.get("type") != "BPE"),
        *["a normalizer"] * bool(spec.get("normalizer")),
        *["a post-processor"] * bool(spec.get("post_processor")),
        *[f"pre-tokenizer {cut.get('type')!r}"] * (cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)),
        *[k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)],
        *[f"added token {t['content']!r} with {k}" for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)],
    ]
    if wrong:
        raise ValueError(f"{path} is not a plain byte-level BPE file: it has {', '.join(wrong)}")
    return spec


class Inseparable(ValueError):
    """A piece begins with white space, so what lies before it matters."""


def separable(pieces: list[str]) -> list[str]:
    """The pieces, if none begins with white space.  Others are never cached, so all of them come by here."""
    if any(p[:1].isspace() for p in pieces):
        raise Inseparable
    return pieces


class Generations:
    """A map of bounded size; full, it becomes the old generation, and hits there move up."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE):
        self.make, self.limit, self.new, self.old = make, limit, {}, {}

    def look_up(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.new.get, keys))
        if missing := [n for n, x in enumerate(found) if x is None]:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            made = []
            for k in {keys[n] for n in missing}:
                if (x := self.old.get(k)) is None:
                    made.append(k)
                else:
                    self.new[k] = x
            if made:
                self.new.update(zip(made, self.make(made), strict=True))
            for n in missing:
                found[n] = self.new[keys[n]]
        return found


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to the library's own ids."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        checked(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Generations(self._after_spaces, cache)
        self.firsts = Generations(self._ids, cache // 8)
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(1 + max(vocab.values(), default=0), bool)
        self.begins[[i for s, i in vocab.items() if s[0] == SPACE]] = True

    def _after_spaces(self, pieces: list[str]) -> list[bytes]:
        """Encodes pieces in one text, a space before each; only an id that begins with a space begins a piece."""
        raw = self.whole(" " + " ".join(separable(pieces)))
        at = (4 * np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")])).tolist()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return self._ids([text])[0]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            first, space, rest = text.partition(" ")
            if not space or text[-1] == " " or "  " in text or any(s in text for s in self.special):
                yield self.whole(text)
                continue
            try:
                yield self.firsts.look_up([first])[0] + b"".join(self.cache.look_up(rest.split(" ")))
            except Inseparable:
                yield self.whole(text)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
