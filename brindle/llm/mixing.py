"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  Raking multiplies the cells'
token weights by one marginal's target over its present share after another until
all three marginals hold.  A cell's calibrated share of the budget over its tokens
is its documents' probability; a probability over 1 becomes 1, and what is over goes
to the other cells in proportion.  A document is sampled by a hash of its doc_id, so
the sample does not depend on partitions and is the same when a task runs again.

A topic is the nearest of ``TOPICS`` fixed directions to a document's words.  Words fall into
``BUCKETS`` buckets by a hash of their first byte and length, and a direction adds the counts
of half of the buckets and takes off the others'; what a document's sum exceeds the corpus's
share by is how near it is, in integers.

A target is a list of shares, or an exponent: then the ``NAMED`` largest values of that
marginal have their own shares to that power as targets, and the others one share together.
Every list has a share ``*`` for the values it does not name, null among them, so every
document with a word has a probability above 0.  There are at most the product of the
lists' lengths of cells, and they fit in the driver whatever the corpus.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.workers import releasing
from brindle.storage import stored

REST = "*"
DIMS = ("source", "lang", "topic")
TOPICS, BUCKETS = 8, 16
#: The corpus's shares are held in these parts.
PARTS = 1_000_000
#: Values of a marginal with a target of their own where the targets follow from an exponent.
NAMED = 32
#: Rounds of raking and of handing on what capped cells leave.
ROUNDS, CAPS = 60, 12
#: Error of a marginal from which the caller is warned.
FAR = 1e-6

#: What the registered query and the pipeline aim at.
TARGETS: dict[str, dict[str, float] | float] = {
    "source": 0.7,
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, REST: 0.05},
    "topic": 0.5,
}
BUDGET = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text by bucket; words are what white space of ASCII leaves, in UTF-8."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    if not n or raw is None or offsets[-1] == offsets[0]:
        return np.zeros((n, BUCKETS), np.int64)
    b = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    space = _SPACE[b]
    before, after = np.empty(len(b), bool), np.empty(len(b), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[at[:-1][at[:-1] < len(b)]] = True  # a text's first byte has no word before it
    after[at[1:][at[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    bucket = (b[start] + 5 * (end - start)) % BUCKETS
    text = np.searchsorted(at, start, "right") - 1
    return np.bincount(text * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)


#: Directions are rows of a Hadamard matrix: a column each.
SIGNS = np.array([[-1 if ((k + 1) & d).bit_count() % 2 else 1 for k in range(TOPICS)] for d in range(BUCKETS)])


def profiled(docs: DataFrame) -> DataFrame:
    """Adds ``tokens``, the words of the text (none in a null text), and ``_s``, their sums along the directions."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("_s", T.ArrayType(T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n = word_counts(part.column(at)).astype(np.int64)
                sums = pa.ListArray.from_arrays(np.arange(0, len(n) * TOPICS + 1, TOPICS, dtype=np.int32), pa.array((n @ SIGNS).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.sum(axis=1)), sums], [*part.schema.names, "tokens", "_s"])

    return docs.mapInArrow(releasing(count), schema)


def topic(tokens: Column, sums: Column, common: list[int]) -> Column:
    """``t0``, ``t1``, ...: the direction along which the sum exceeds the corpus's share most, ties to the first; ``none`` without words."""
    scores = F.array(*(sums[k] * PARTS - tokens * c for k, c in enumerate(common)))
    return F.when(tokens == 0, "none").otherwise(F.concat(F.lit("t"), (F.array_position(scores, F.array_max(scores)) - 1).cast("string")))


def uniform(key: Column, seed: int) -> Column:
    """52 bits of an md5 of seed and key, from 0 to 1; a null key is the empty string."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> tuple[dict[tuple[str, ...], float], float]:
    """Shares of the cells, summing to 1, whose marginals are the targets, and the largest error left in a marginal.

    A target without tokens is left out and the others of its list are scaled up.  Where
    zero cells forbid the targets, the shares are those of the last round, and the error says so.
    """
    w = {c: v for c, v in cells.items() if v > 0 and all(targets[d].get(c[d], 0) > 0 for d in range(len(targets)))}

    def marginal(d: int) -> dict[str, tuple[float, float]]:
        have: dict[str, float] = {}
        for c, v in w.items():
            have[c[d]] = have.get(c[d], 0.0) + v
        total = sum(targets[d][k] for k in have)
        return {k: (v, targets[d][k] / total) for k, v in have.items()}

    for _ in range(rounds):
        for d in range(len(targets)):
            m = marginal(d)
            w = {c: v * m[c[d]][1] / m[c[d]][0] for c, v in w.items()}
    return w, max((abs(have - want) for d in range(len(targets)) for have, want in marginal(d).values()), default=0.0)


def probabilities(cells: dict[tuple[str, ...], float], shares: dict[tuple[str, ...], float], budget: float) -> dict[tuple[str, ...], float]:
    """Sampling probability of each cell for an expected number of tokens."""
    full: set = set()
    scale = budget
    for _ in range(CAPS):
        full = {c for c, s in shares.items() if scale * s >= cells[c]}
        rest = sum(s for c, s in shares.items() if c not in full)
        scale = (budget - sum(cells[c] for c in full)) / rest if rest > 0 else scale
    return {c: 1.0 if c in full else max(0.0, min(1.0, scale * s / cells[c])) for c, s in shares.items()}


def tempered(totals: DataFrame, column: str, power: float) -> dict[str, float]:
    """Targets of the ``NAMED`` values with most tokens (ties by name) and of the others together: token totals to a power, as shares."""
    named = totals.filter(F.col(column).isNotNull() & (F.col(column) != REST) & (F.col("n") > 0)).orderBy(F.desc("n"), column).limit(NAMED).collect()
    rest = (totals.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in named)
    share = {r[column]: float(r["n"]) ** power for r in named} | {REST: float(rest) ** power if rest > 0 else 0.0}
    return {k: v / max(sum(share.values()), 1e-300) for k, v in share.items()}


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS, budget: float = BUDGET, seed: int = 7) -> DataFrame:
    """Adds ``topic, tokens, probability, weight, sampled`` to the columns of ``docs``.

    docs: has ``doc_id, text, source, lang``.  tokens: words between white space.  budget: expected
    tokens of the sample over all tokens.  weight: what a sampled document counts for, so that the
    weighted sample has the target marginals even where a probability was cut to 1.  Null sources
    and languages are pooled with what is not named; a list without a share for those is
    refused.  Empty, blank and null texts have no tokens and are not sampled.  Rows of equal
    doc_id share their fate.  Targets that the cells forbid give a warning with the error that is
    left.  An empty table stays empty.  Columns of docs with the names of new ones are replaced.
    """
    names = ["topic", "tokens", "probability", "weight", "sampled"]
    for d, t in targets.items():
        if not isinstance(t, float) and REST not in t:
            raise ValueError(f"no share {REST!r} for values of {d} that are not named")
    docs = docs.drop(*names, "_s")
    sums = profiled(docs.select("text")).agg(F.sum("tokens").alias("n"), *(F.sum(F.col("_s")[k]).alias(f"s{k}") for k in range(TOPICS))).first()
    words = sums["n"] or 0
    common = [PARTS * ((sums[f"s{k}"] or 0) + words) // max(words, 1) - PARTS for k in range(TOPICS)]
    with_topic = lambda df: profiled(df).withColumn("topic", topic(F.col("tokens"), F.col("_s"), common)).drop("_s")
    # no more rows than values of source and lang, times topics
    values = stored(with_topic(docs.select("text", "source", "lang")).groupBy(*DIMS).agg(F.sum("tokens").alias("n")), "values")
    lists = [tempered(values.groupBy(d).agg(F.sum("n").alias("n")), d, t) if isinstance(t := targets[d], float) else t for d in DIMS]
    pooled = [F.when(F.col(d).isin([k for k in t if k != REST]), F.col(d)).otherwise(REST) for d, t in zip(DIMS, lists, strict=True)]
    keys = [f"_{d}" for d in DIMS]
    have = {tuple(r[k] for k in keys): float(r["n"]) for r in values.groupBy(*(p.alias(k) for p, k in zip(pooled, keys, strict=True))).agg(F.sum("n").alias("n")).collect()}  # cells
    shares, error = rake(have, lists)
    if error > FAR:
        warnings.warn(f"the targets cannot hold together in these cells; the largest error of a marginal is {error:.2g}", stacklevel=2)
    total = sum(have.values())
    p = probabilities(have, shares, budget * total)
    cells = [(*c, p.get(c, 0.0), shares[c] * total / (have[c] * p[c]) if p.get(c) else 0.0) for c in product(*([*dict.fromkeys([*t, REST])] for t in lists))]
    table = docs.sparkSession.createDataFrame(cells, ", ".join(f"{k} string" for k in keys) + ", probability double, weight double")
    out = with_topic(docs).withColumns(dict(zip(keys, pooled, strict=True))).join(F.broadcast(table), keys, "left").drop(*keys)
    return out.withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))


def sql(targets: dict[str, dict[str, float] | float] = TARGETS, budget: float = BUDGET, seed: int = 7) -> str:
    """The registered query's rows in SQL."""
    byte = "CASE WHEN unicode(w) < 128 THEN unicode(w) WHEN unicode(w) < 2048 THEN 192 + unicode(w) // 64 WHEN unicode(w) < 65536 THEN 224 + unicode(w) // 4096 ELSE 240 + unicode(w) // 262144 END"
    parts = [
        "a AS (SELECT row_number() OVER () AS row, doc_id, source, lang, text FROM documents)",
        f"b AS (SELECT row, ({byte} + 5 * strlen(w)) % {BUCKETS} AS d FROM (SELECT row, unnest(regexp_split_to_array(text, '[\\x09-\\x0D ]+')) AS w FROM a) WHERE w <> '')",
        "nd AS MATERIALIZED (SELECT row, d, count(*) AS n FROM b GROUP BY row, d)",
        "total AS (SELECT row, CAST(sum(n) AS BIGINT) AS tokens FROM nd GROUP BY row)",
        f"sums AS MATERIALIZED (SELECT row, k, CAST(sum(CASE WHEN bit_count((k + 1) & d) % 2 = 1 THEN -n ELSE n END) AS BIGINT) AS s FROM nd, range({TOPICS}) t(k) GROUP BY row, k)",
        f"common AS (SELECT k, {PARTS} * (CAST(sum(s) AS BIGINT) + w) // w - {PARTS} AS c FROM sums, (SELECT CAST(sum(tokens) AS BIGINT) AS w FROM total) GROUP BY k, w)",
        f"score AS MATERIALIZED (SELECT row, k, {PARTS} * s - tokens * c AS s FROM sums JOIN total USING (row) JOIN common USING (k))",
        "best AS (SELECT row, 't' || min(k) AS topic FROM score JOIN (SELECT row, max(s) AS s FROM score GROUP BY row) USING (row, s) GROUP BY row)",
        "v AS MATERIALIZED (SELECT a.*, coalesce(tokens, 0) AS tokens, coalesce(topic, 'none') AS topic FROM a LEFT JOIN total USING (row) LEFT JOIN best USING (row))",
    ]
    for i, d in enumerate(DIMS):
        if isinstance(t := targets[d], float):
            parts.append(f"g{i} AS (SELECT {d} AS k, CAST(sum(tokens) AS DOUBLE) AS n, row_number() OVER (ORDER BY ({d} IS NULL OR {d} = '{REST}' OR sum(tokens) = 0), sum(tokens) DESC, {d}) AS r, ({d} IS NULL OR {d} = '{REST}' OR sum(tokens) = 0) AS out FROM v GROUP BY {d})")
            parts.append(f"f{i} AS (SELECT CASE WHEN out OR r > {NAMED} THEN '{REST}' ELSE k END AS k, power(sum(n), {t!r}) AS v FROM g{i} GROUP BY 1)")
            parts.append(f"t{i} AS MATERIALIZED (SELECT k, v / (SELECT sum(v) FROM f{i}) AS v FROM f{i})")
        else:
            parts.append(f"t{i}(k, v) AS (VALUES {', '.join(f'({k!r}, CAST({v!r} AS DOUBLE))' for k, v in t.items())})")
    pool = ", ".join(f"CASE WHEN {d} IN (SELECT k FROM t{i} WHERE k <> '{REST}') THEN {d} ELSE '{REST}' END AS k{i}" for i, d in enumerate(DIMS))
    parts += [
        f"c AS MATERIALIZED (SELECT *, {pool} FROM v)",
        "h AS MATERIALIZED (SELECT k0, k1, k2, CAST(sum(tokens) AS DOUBLE) AS n FROM c GROUP BY ALL)",
        "w0 AS MATERIALIZED (SELECT h.*, n AS w, t0.v AS v0, t1.v AS v1, t2.v AS v2 FROM h JOIN t0 ON t0.k = k0 JOIN t1 ON t1.k = k1 JOIN t2 ON t2.k = k2 WHERE n > 0 AND t0.v > 0 AND t1.v > 0 AND t2.v > 0)",
    ]
    at = 0
    for _ in range(ROUNDS):
        for d in range(3):
            # a value's target over the targets of the values that are there
            parts.append(f"w{at + 1} AS MATERIALIZED (SELECT k0, k1, k2, n, w * v{d} / (SELECT sum(v) FROM (SELECT DISTINCT k{d}, v{d} AS v FROM w{at})) / sum(w) OVER (PARTITION BY k{d}) AS w, v0, v1, v2 FROM w{at})")
            at += 1
    total = f"({budget!r} * (SELECT sum(n) FROM h))"
    parts.append(f"s0 AS MATERIALIZED (SELECT k0, k1, k2, n, w, {total} AS scale, false AS fl FROM w{at})")
    for k in range(CAPS):
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT k0, k1, k2, n, w, CASE WHEN sum(CASE WHEN scale * w >= n THEN 0 ELSE w END) OVER () > 0 THEN ({total} - sum(CASE WHEN scale * w >= n THEN n ELSE 0 END) OVER ()) / sum(CASE WHEN scale * w >= n THEN 0 ELSE w END) OVER () ELSE scale END AS scale, scale * w >= n AS fl FROM s{k})")
    parts.append(f"p AS (SELECT k0, k1, k2, CASE WHEN fl THEN 1.0 ELSE greatest(0.0, least(1.0, scale * w / n)) END AS p, n, w FROM s{CAPS})")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 0.0), 9) AS probability,
 round(CASE WHEN p > 0 THEN w * (SELECT sum(n) FROM h) / (p.n * p) ELSE 0.0 END, 6) AS weight,
 CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < coalesce(p, 0.0) AS sampled
FROM c LEFT JOIN p USING (k0, k1, k2)"""
