"""Language identification by words first, then shorter and shorter character n-grams.

The model counts words and the character n-grams of words in labelled texts.  A known
word has a score for each language: its log frequency there.  A word that no language
knows is looked up by its n-grams, longest first; at the first length at which any is
known, their mean log frequencies are its score.  A text's score is the mean over its
words, and the languages' shares follow from it, so long texts are not surer than short ones.

A word is a maximal run of letters, lower-cased; n-grams see a space at a word's ends.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.workers import releasing

WORD = re.compile(r"[^\W\d_]+")
#: Longest n-gram of the fallback.
LONGEST = 5
#: Labelled rows of a language that the model learns from at most (a bound of the fit).
ROWS = 1000
#: Scores of words a worker keeps.
CACHE = 150_000
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    """Letters only: no digit or letter-like number is part of a word."""
    found = WORD.findall((text or "").lower())
    return found if text is None or text.isascii() else [w for f in found for w in (("".join(c if c.isalpha() else " " for c in f)).split() if not f.isalpha() else [f])]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies: ``tables[0]`` numbers words, ``tables[n]`` n-grams; the row of that number in ``values[n]`` has one value a language."""

    langs: list[str]
    tables: list[dict[str, int]]
    values: list[np.ndarray]

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, int], dict[str, int]]) -> Model:
        langs = sorted({lang for lang, _ in counts})
        tables, values = [], []
        for n in range(LONGEST + 1):
            each = [counts.get((lang, n), {}) for lang in langs]
            keys = sorted(set().union(*each))
            table = np.array([[c.get(k, 0) for c in each] for k in keys], float).reshape(len(keys), len(langs)) + 0.5
            tables.append({k: i for i, k in enumerate(keys)})
            values.append(np.log(table / table.sum(axis=0, keepdims=True)) if keys else table)
        return cls(langs, tables, values)

    def packed(self) -> bytes:
        """A compact form for the workers, who unpack it for one task and let it go."""
        return zlib.compress(pickle.dumps((self.langs, ["\n".join(t) for t in self.tables], self.values)), 1)

    @classmethod
    def unpacked(cls, raw: bytes) -> Model:
        langs, tables, values = pickle.loads(zlib.decompress(raw))
        return cls(langs, [{k: i for i, k in enumerate(t.split("\n"))} if t else {} for t in tables], values)

    def of_word(self, word: str) -> np.ndarray:
        """The word's scores; none known at any length: no evidence."""
        known = self.tables[0].get(word)
        if known is not None:
            return self.values[0][known]
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            found = [i for g in grams(word, n) if (i := table.get(g)) is not None]
            if found:
                return self.values[n][found].sum(axis=0) / len(found)
        return np.zeros(len(self.langs))


class Judge:
    """Scores texts; rows of words seen are kept in one array."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.limit = model, cache
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language and its share; ``und`` and 0 for a text without letters or a model without languages.  Ties go to the first language by name."""
        count = Counter(words(text))
        if not count or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.at) + len(count) > max(self.limit, len(count)):
            self.clear()
        for w in [w for w in count if w not in self.at]:
            k = len(self.at)
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.model.of_word(w)
            self.at[w] = k
        many = np.fromiter(count.values(), float, len(count))
        mean = many @ self.rows[np.fromiter(map(self.at.__getitem__, count), np.int64, len(count))] / many.sum()
        best = int(mean.argmax())
        return self.model.langs[best], float(1 / np.exp(np.maximum(mean - mean[best], -700)).sum())


def fit(labelled: DataFrame, rows: int = ROWS) -> Model:
    """Learns from (text, lang, key): about ``rows`` rows of each language at most, chosen by a hash of the key.

    All that those rows hold is counted and kept, so ``rows`` bounds the model.  Rows with a
    null text or language are not used; an empty table gives a model without languages.
    """
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    size = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # as many rows as languages
    if not size:
        return Model.of_counts({})
    share = F.create_map(*(x for k, n in size.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))))[F.col("lang")]
    chosen = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * float(1 << 30)).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(words(text.as_py()))
        for lang, count in seen.items():
            for n in range(LONGEST + 1):
                table: Counter = count
                if n:
                    table = Counter()
                    for w, c in count.items():
                        for g in grams(w, n):
                            table[g] += c
                if table:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table)), pa.array([n] * len(table), pa.int32()), pa.array([*table]), pa.array([*table.values()], pa.int64())], ["lang", "n", "gram", "c"])

    total = chosen.mapInArrow(releasing(counted), "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counts: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
    for r in total.toLocalIterator():  # what is in the chosen rows
        counts[r["lang"], r["n"]][r["gram"]] = r["c"]
    return Model.of_counts(counts)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the predicted language's share, 0 to 1) to the columns ``keep``.

    Only ``text`` decides.  A null text, or one without letters, is ``und`` with score 0.
    Nothing is shuffled; the model goes to the workers by broadcast, and is bounded by ``fit``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    kinds = [*docs.select(*keep).schema.fields]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "lang_pred string", "score double"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(Model.unpacked(shared.value))
        for batch in batches:
            out = [judge.judge(t.as_py()) for t in batch.column(at)]
            columns = [*batch.columns[: len(keep)], pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    at = keep.index("text") if "text" in keep else len(keep)
    return docs.select(*keep, *["text"] * (at == len(keep))).mapInArrow(releasing(judged), ddl)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from the fit: crc32 of doc_id as text leaves 1 by 3 (a null doc_id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the documents that are not held out and predicts all: ``doc_id, held_out, lang_pred, score``.

    docs: has ``doc_id, text, lang``; other columns are not read.  Repeated rows are judged each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.filter(~held_out()).select("text", "lang", F.col("doc_id").alias("key")))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
