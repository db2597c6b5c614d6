"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a weighted set: its terms (runs of characters other than white space)
with their counts.  For each of ``SAMPLES`` samples and each term a hash gives
r and c from Gamma(2, 1) and b from [0, 1); with weight w

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1)

and the sample is the pair (term, t) of least a.  Two documents agree in a sample with
the probability of their generalised Jaccard similarity, sum of least weights by sum of
largest weights (improved consistent weighted sampling).  r and c are -ln(u1 u2), with
each u 52 bits of a hash of its own, so the least c of a text is drawn truly however many
terms it has.

Each sample is kept as 32 bits of (term, t); a fingerprint is all of them in hex.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import parallelism

SAMPLES = 32


def gamma_quantiles(n: int = 4096) -> tuple[float, ...]:
    """Gamma(2, 1) at (k + 1/2) / n: the roots of 1 - (1 + x) exp(-x) = q, by bisection.  Tests hold the draws to it."""
    q = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return tuple(((lo + hi) / 2).tolist())


def draws(term: Column, k: int) -> tuple[Column, Column, Column]:
    """r and c from Gamma(2, 1) and b from (0, 1) for sample k."""
    # 52 bits and a half: never 0 and never 1, so r and c are above 0
    u = [(F.shiftrightunsigned(F.xxhash64(term, F.lit(5 * k + j)), 12) + 0.5) * 2.0**-52 for j in range(5)]
    return -F.log(u[0] * u[1]), -F.log(u[2] * u[3]), u[4]


def sample_columns(term: Column, log_weight: Column, samples: int = SAMPLES) -> list[Column]:
    """For each sample a long to take the least of: ln a in the high half, (term, t) in the low half."""
    out = []
    for k in range(samples):
        r, c, b = draws(term, k)
        t = F.floor(log_weight / r + b)
        log_a = F.log(c) - r * (t - b + 1)
        low = term.bitwiseXOR(t.bitwiseAND(0x7FFFFFFF) * 2654435769).bitwiseAND(0xFFFFFFFF)
        out.append(F.shiftleft(((log_a + 1024) * float(1 << 20)).cast("long"), 32).bitwiseOR(low))
    return out


def _sortable(x: Column) -> Column:
    """A long as 16 hex digits that sort as the numbers do."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _bucket(place: Column, firsts: list[str]) -> Column:
    """The number of the last of sorted firsts that is not above place, by halving; the plan holds them as one string."""
    held = F.split(F.lit(",".join(firsts)), ",")
    halves = [1 << k for k in reversed(range(max(len(firsts) - 1, 0).bit_length()))]
    return F.aggregate(F.lit([0, *halves]), F.lit(0), lambda at, step: F.when(F.get(held, at + step) <= place, at + step).otherwise(at))


def _terms(text: Column) -> Column:
    """Runs of characters other than white space; a text without any has the one term ''."""
    found = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints every text and its edited text.

    docs: has ``doc_id`` and ``text``; other columns are not read.  The edited text has the
    last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id (null first, as the least long; equal doc_ids by a hash of
    the text; after the last comes the first).  Null texts count as empty; a text without terms
    has the one term ''.  Repeated rows are documents of their own.  An empty table gives no rows.

    Ids alone are ordered first, by ranges, and each range's first document is found.  Then texts
    are dealt once, by those ranges, and all that follows stays in that partition; a range's
    first document also goes to the range before it, which ends with it.  Rows of one doc_id,
    and copies of one row, are cut between ranges like any others.
    """
    spark = docs.sparkSession
    parts = 2 * parallelism(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    document = F.concat(_sortable(F.coalesce("doc_id", F.lit(-(1 << 63)))), _sortable(F.xxhash64("text")))
    docs = docs.withColumn("document", document).withColumn("place", F.concat("document", _sortable(F.monotonically_increasing_id())))
    # a row a range
    ranges = docs.select("place").repartitionByRange(parts, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("first"))
    firsts = sorted(r["first"] for r in ranges.select("first").collect())
    follows = [(first[:32], (k - 1) % len(firsts)) for k, first in enumerate(firsts)]
    ends = docs.join(F.broadcast(spark.createDataFrame(follows, "document string, bucket int")), "document").groupBy("bucket").agg(F.first("text").alias("text"))
    ends = ends.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("~").alias("place"), "bucket")
    dealt = docs.select("doc_id", "text", "place", _bucket(F.col("place"), firsts).alias("bucket")).unionByName(ends).repartitionById(parts, F.col("bucket"))

    order = Window.partitionBy("bucket").orderBy("place")
    n, half = F.length("text"), F.floor(F.length("text") / 2)
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))
    both = dealt.withColumns({"after": F.lead("text").over(order), "row": F.row_number().over(order)}).withColumns({"n_chars": n.cast("long"), "edited": edited})
    about = both.select("bucket", "row", "doc_id", (F.col("place") == "~").alias("end"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))

    # doc_id goes along, so that both sides of the join read the same exchange
    versions = both.select("bucket", "row", "doc_id", F.posexplode(F.array("text", "edited")).alias("version", "t"))
    terms = versions.select("bucket", "row", "doc_id", "version", F.explode(_terms(F.col("t"))).alias("term"))
    counts = terms.groupBy("bucket", "row", "doc_id", "version", F.xxhash64("term").alias("term")).agg(F.count("*").alias("n"))
    counts = counts.select("bucket", "row", "doc_id", "version", "term", F.log(F.col("n").cast("double")).alias("lw"))
    least = counts.groupBy("bucket", "row", "doc_id", "version").agg(*(F.min(c).alias(f"s{k}") for k, c in enumerate(sample_columns(F.col("term"), F.col("lw"), samples))))
    prints = least.select("bucket", "row", "doc_id", "version", F.array(*(F.col(f"s{k}").bitwiseAND(0xFFFFFFFF) for k in range(samples))).alias("s"))
    prints = prints.groupBy("bucket", "row", "doc_id").agg(F.max(F.when(F.col("version") == 0, F.col("s"))).alias("own"), F.max(F.when(F.col("version") == 1, F.col("s"))).alias("edit"))

    rows = about.join(prints.drop("doc_id"), ["bucket", "row"]).withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("row")))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    alike = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / samples
    return rows.filter(~F.col("end")).select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edit").alias("edited_fingerprint"), alike("own", "edit").alias("near_edited"), alike("own", "next").alias("near_next"))
