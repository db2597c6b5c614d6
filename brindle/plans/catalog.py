"""The registered queries of the compression operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import pixels as P
from brindle.functions import theory
from brindle.operators import bitmap, codes, graph, predict, shape, tabular
from brindle.operators.components import connected_components
from brindle.plans import predictive
from brindle.operators.order import positions, running_sums, with_previous
from brindle.storage import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Elements as SQL.
E = "e AS (SELECT 0 AS layer, vec_id AS elem, label, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)) AS px FROM embeddings WHERE embedding IS NOT NULL)"
CELLS = "cells AS (SELECT elem, label, generate_subscripts(px, 1) - 1 AS k, unnest(px) AS v FROM e)"
ORDER = "o AS (SELECT CAST(row_number() OVER (ORDER BY elem) - 1 AS BIGINT) AS pos, elem, label, px FROM e)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.images(table(spark, sf_dir, "embeddings"))


def ordered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(images(spark, sf_dir), "elem")


def joined(px) -> F.Column:
    return F.array_join(px, ",")


# -- shapes

@query(f"WITH {E} SELECT elem, label, array_to_string(px, ',') AS px FROM e")
def pixel_quantize(spark, sf):
    return images(spark, sf).select("elem", "label", joined("px").alias("px"))


@query(f"WITH {E}, {CELLS} SELECT elem, CAST(k AS INTEGER) AS k, v FROM cells")
def pixel_explode(spark, sf):
    return images(spark, sf).select("elem", F.posexplode("px").alias("k", "v"))


@query(f"WITH {E}, {CELLS} SELECT label, elem, CAST(sum(CASE WHEN v > 127 THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM cells GROUP BY label, elem")
def binarize_by_label(spark, sf):
    return bitmap.binary(images(spark, sf), 127).select("label", "elem", F.aggregate("px", F.lit(0).cast("long"), lambda t, x: t + x).alias("ones"))


@query(f"""WITH {E}, {CELLS} SELECT elem, CAST((k // 8) // 4 * 2 + (k % 8) // 4 AS INTEGER) AS layer, string_agg(v, ',' ORDER BY k) AS px FROM cells GROUP BY ALL""")
def sqpatch_4(spark, sf):
    return shape.patches(images(spark, sf), 8, 4).select("elem", "layer", joined("px").alias("px"))


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS elements FROM embeddings")
def sqpatch_roundtrip(spark, sf):
    df = images(spark, sf)
    back = shape.whole(shape.patches(df, 8, 4), 8, 4).withColumnRenamed("px", "back")
    return df.join(back, ["layer", "elem"], "left").agg(F.sum((~F.col("px").eqNullSafe(F.col("back"))).cast("long")).alias("mismatches"), F.count("*").alias("elements"))


@query(f"WITH {E}, {CELLS} SELECT elem, CAST(k // 16 AS INTEGER) AS layer, string_agg(v, ',' ORDER BY k) AS px FROM cells WHERE k < 48 GROUP BY ALL")
def rgb_layers(spark, sf):
    return shape.channels(images(spark, sf), 16).select("elem", "layer", joined("px").alias("px"))


@query(f"WITH {E}, {CELLS} SELECT elem, CAST(k // 16 * 4 + (k % 16 // 4) // 2 * 2 + (k % 4) // 2 AS INTEGER) AS layer, string_agg(v, ',' ORDER BY k) AS px FROM cells WHERE k < 48 GROUP BY ALL")
def rgb_sqpatch(spark, sf):
    return shape.patches(shape.channels(images(spark, sf), 16), 4, 2).select("elem", "layer", joined("px").alias("px"))


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS elements FROM embeddings")
def rgb_roundtrip(spark, sf):
    df = images(spark, sf)
    back = shape.merged_channels(shape.channels(df, 16)).withColumnRenamed("px", "back")
    return df.join(back, ["layer", "elem"], "left").agg(F.sum((~F.slice("px", 1, 48).eqNullSafe(F.col("back"))).cast("long")).alias("mismatches"), F.count("*").alias("elements"))


@query(f"""WITH {E}, {CELLS} SELECT elem, CAST(row_number() OVER (PARTITION BY elem ORDER BY k // 8 + k % 8, CASE WHEN (k // 8 + k % 8) % 2 = 0 THEN -(k // 8) ELSE k // 8 END) - 1 AS INTEGER) AS at, v FROM cells""")
def zigzag_scan(spark, sf):
    return images(spark, sf).select("elem", F.posexplode(shape.gather(F.col("px"), shape.zigzag(8, 8))).alias("at", "v"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS elements, CAST(count(*) - 1 AS BIGINT) AS last FROM embeddings")
def random_order(spark, sf):
    order = positions(images(spark, sf).select("elem", F.xxhash64("elem", F.lit(42)).alias("h")), "h", "elem")
    return order.agg(F.countDistinct("pos").alias("n"), F.countDistinct("elem").alias("elements"), F.max("pos").alias("last"))


@query(f"WITH {E} SELECT elem FROM e ORDER BY md5('42:' || CAST(elem AS VARCHAR)), elem LIMIT 50")
def sample_without_replacement(spark, sf):
    """50 elements, each as likely as any other, without replacement."""
    return images(spark, sf).select("elem").orderBy(F.md5(F.concat(F.lit("42:"), F.col("elem").cast("string")).cast("binary")), "elem").limit(50)


@query(f"WITH {E}, {CELLS} SELECT elem, CAST(k AS INTEGER) AS k, round(v / CAST(sum(v) OVER (PARTITION BY elem) AS DOUBLE), 9) AS share FROM cells")
def l1_normalized(spark, sf):
    """Pixels over their image's sum (P20)."""
    total = F.aggregate("px", F.lit(0).cast("long"), lambda t, x: t + x)
    return images(spark, sf).select("elem", F.posexplode(F.transform("px", lambda x: F.round(x / total, 9))).alias("k", "share"))


# -- frequencies and codes

FREQ = "f AS (SELECT v AS symbol, count(*) AS n FROM cells GROUP BY v)"
#: The heap as a list, one merge a step; struct order is (weight, first symbol).
HEAP = """h(step, heap) AS (SELECT 0, (SELECT list_sort(list({{'w': CAST(n AS BIGINT), 'f': symbol, 'l': [{{'s': symbol, 'd': 0}}]}})) FROM {f})
 UNION ALL SELECT step + 1, list_sort(list_append(heap[3:], {{'w': heap[1].w + heap[2].w, 'f': heap[1].f, 'l': list_transform(list_concat(heap[1].l, heap[2].l), lambda x: {{'s': x.s, 'd': x.d + 1}})}})) FROM h WHERE len(heap) > 1),
lens AS (SELECT x.s AS symbol, CAST(greatest(x.d, 1) AS INTEGER) AS len FROM (SELECT unnest(heap[1].l) AS x FROM h WHERE len(heap) = 1))"""
KRAFT = """book AS (SELECT symbol, len, CAST(coalesce(sum(CAST(1 AS HUGEINT) << (m - len)) OVER (ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >> (m - len) AS BIGINT) AS code FROM lens, (SELECT max(len) AS m FROM lens))"""


def pixel_symbols(spark, sf) -> DataFrame:
    """Pixels with their positions in (element, place) order."""
    order = ordered_images(spark, sf).select("pos", F.posexplode("px").alias("k", "symbol"))
    return order.select((F.col("pos") * 64 + F.col("k")).alias("pos"), "symbol")


def pixel_freqs(spark, sf) -> DataFrame:
    return codes.frequencies(images(spark, sf).select(F.explode("px").alias("symbol")))


@query(f"WITH {E}, {CELLS}, {FREQ} SELECT * FROM f")
def symbol_freqs(spark, sf):
    return pixel_freqs(spark, sf)


@query(f"WITH {E}, {CELLS}, {FREQ} SELECT * FROM f ORDER BY n DESC, symbol OFFSET 5")
def symbol_freqs_skip5(spark, sf):
    return pixel_freqs(spark, sf).orderBy(F.desc("n"), "symbol").offset(5)


CHARS = "f AS (SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY c)"


def char_symbols(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").filter("text <> ''").select(F.explode(F.split("text", "")).alias("symbol")).filter("symbol <> ''")


@query(f"WITH {CHARS} SELECT * FROM f")
def char_freqs(spark, sf):
    return codes.frequencies(char_symbols(spark, sf))


@query(f"WITH RECURSIVE {E}, {CELLS}, {FREQ}, {HEAP.format(f='f')} SELECT symbol, n, len FROM lens JOIN f USING (symbol)")
def huffman_lengths(spark, sf):
    return codes.codebook(pixel_freqs(spark, sf)).select("symbol", "n", "len")


@query(f"WITH RECURSIVE {E}, {CELLS}, {FREQ}, {HEAP.format(f='f')}, {KRAFT} SELECT symbol, len, code FROM book")
def huffman_codes(spark, sf):
    return codes.codebook(pixel_freqs(spark, sf)).select("symbol", "len", "code")


@query(f"WITH RECURSIVE {CHARS}, {HEAP.format(f='f')} SELECT count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol)")
def char_huffman_bits(spark, sf):
    return codes.bit_total(codes.codebook(codes.frequencies(char_symbols(spark, sf)))).select("n_symbols", "n_values", "n_bits")


@query(f"WITH RECURSIVE {E}, {CELLS}, {FREQ}, {HEAP.format(f='f')} SELECT count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n * len) AS BIGINT) AS n_bits, max(len) AS longest, round(-sum(n / t * log2(n / t)), 9) AS entropy FROM lens JOIN f USING (symbol), (SELECT CAST(sum(n) AS DOUBLE) AS t FROM f)")
def huffman_bits(spark, sf):
    return codes.bit_total(codes.codebook(pixel_freqs(spark, sf))).withColumn("entropy", F.round("entropy", 9))


@query(f"""WITH RECURSIVE {E}, {CELLS}, {FREQ}, {HEAP.format(f='f')}, {KRAFT}, {ORDER},
s AS (SELECT pos * 64 + k AS place, v FROM (SELECT pos, generate_subscripts(px, 1) - 1 AS k, unnest(px) AS v FROM o)),
w AS (SELECT place // 4096 AS block, place, lpad(to_binary(code), len, '0') AS word FROM s JOIN book ON symbol = v)
SELECT CAST(block AS BIGINT) AS block, count(*) AS n, CAST(sum(len(word)) AS BIGINT) AS n_bits, md5(string_agg(word, '' ORDER BY place)) AS bits_md5 FROM w GROUP BY block""")
def huffman_payload(spark, sf):
    symbols = pixel_symbols(spark, sf)
    book = codes.codebook(codes.frequencies(symbols))
    blocks = codes.packed(codes.encoded(symbols, book))
    # the payload's bits, without the zeros at its end, as text
    nibbles = F.transform(F.sequence(F.lit(1), F.length(F.hex("payload"))), lambda i: F.lpad(F.conv(F.substring(F.hex("payload"), i, F.lit(1)), 16, 2), 4, "0"))
    return blocks.select("block", "n", "n_bits", F.md5(F.substring(F.array_join(nibbles, ""), F.lit(1), F.col("n_bits").cast("int")).cast("binary")).alias("bits_md5"))


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) * 64 AS n FROM embeddings")
def huffman_roundtrip(spark, sf):
    symbols = stored(pixel_symbols(spark, sf), "symbols")
    book = codes.codebook(codes.frequencies(symbols))
    back = codes.decoded(codes.packed(codes.encoded(symbols, book)), book).withColumnRenamed("symbol", "back")
    return symbols.join(back, "pos", "left").agg(F.sum((~F.col("symbol").eqNullSafe(F.col("back"))).cast("long")).alias("mismatches"), F.count("*").alias("n"))


GOLOMB = "concat(repeat('0', CAST(v // {k} AS INTEGER)), '1', {tail})"


@query("WITH c AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events) SELECT event_id, v, " + GOLOMB.format(k=8, tail="lpad(to_binary(v % 8), 3, '0')") + " AS word FROM c")
def golomb_codes(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("v")).withColumn("word", P.golomb(F.col("v"), 8))


@query(f"WITH {E}, {CELLS} SELECT CAST(sum(v // 10 + 1 + CASE WHEN v % 10 < 6 THEN 3 ELSE 4 END) AS BIGINT) AS n_bits, count(*) AS n FROM cells")
def golomb_bits(spark, sf):
    v = images(spark, sf).select(F.explode("px").alias("v"))
    return v.agg(F.sum(F.length(P.golomb(F.col("v"), 10))).alias("n_bits"), F.count("*").alias("n"))


RUNS = """r0 AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_type AS symbol FROM events),
r1 AS (SELECT pos, symbol, CASE WHEN symbol IS NOT DISTINCT FROM lag(symbol) OVER (ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS f FROM r0),
r2 AS (SELECT pos, symbol, CAST(sum(f) OVER (ORDER BY pos) - 1 AS BIGINT) AS run FROM r1)"""


def event_order(spark, sf) -> DataFrame:
    return positions(table(spark, sf, "events").select("ts", "event_id", "event_type"), "ts", "event_id").select("pos", "event_type")


@query(f"WITH {RUNS} SELECT run, symbol, min(pos) AS start, count(*) AS len FROM r2 GROUP BY run, symbol")
def run_lengths(spark, sf):
    return codes.runs(event_order(spark, sf), "event_type")


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS n FROM events")
def run_length_inverse(spark, sf):
    df = event_order(spark, sf)
    back = codes.unrolled(codes.runs(df, "event_type"))
    return df.join(back, "pos", "left").agg(F.sum((~F.col("symbol").eqNullSafe(F.col("event_type"))).cast("long")).alias("mismatches"), F.count("*").alias("n"))


# -- deltas

DELTA = "d AS (SELECT pos, k, (v - lag(v) OVER (PARTITION BY k ORDER BY pos) + 256) % 256 AS v FROM (SELECT pos, generate_subscripts(px, 1) - 1 AS k, unnest(px) AS v FROM o))"


def deltas(spark, sf) -> DataFrame:
    df = with_previous(ordered_images(spark, sf).select("pos", "px"), ["px"])
    return df.filter("pos > 0").select("pos", P.wrapped_difference(F.col("px"), F.col("px_1")).alias("d"))


@query(f"WITH {E}, {ORDER}, {DELTA} SELECT pos, string_agg(v, ',' ORDER BY k) AS d FROM d WHERE pos > 0 GROUP BY pos")
def adjacent_delta(spark, sf):
    return deltas(spark, sf).select("pos", joined("d").alias("d"))


@query(f"WITH {E}, {ORDER} SELECT pos, array_to_string(px, ',') AS px FROM o")
def delta_inverse(spark, sf):
    """Running modular sums give the images back (W2), by ranges of positions."""
    first = ordered_images(spark, sf).filter("pos = 0").select("pos", F.col("px").alias("d"))
    cells = first.unionByName(deltas(spark, sf)).select("pos", F.posexplode("d").alias("k", "d"))
    return running_sums(cells, ["d"], ("k",)).withColumn("v", P.wrapped(F.col("d_sum"))).groupBy("pos").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])).alias("px"))


@query(f"WITH {E}, {ORDER}, {DELTA} SELECT pos, CAST(k AS INTEGER) AS col, CAST(v AS INTEGER) AS v FROM d WHERE pos > 0 AND v <> 0")
def delta_coo(spark, sf):
    return deltas(spark, sf).select("pos", F.posexplode("d").alias("col", "v")).filter("v <> 0")


@query(f"WITH {E}, {ORDER}, {DELTA} SELECT CAST(64 + sum(1 + 2 * nnz) AS BIGINT) AS n_bytes, CAST(sum(nnz) AS BIGINT) AS nnz FROM (SELECT pos, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nnz FROM d WHERE pos > 0 GROUP BY pos)")
def delta_coo_size(spark, sf):
    """First image whole; then a count, values and columns of one byte each."""
    nnz = deltas(spark, sf).select(F.size(F.filter("d", lambda x: x != 0)).cast("long").alias("nnz"))
    return nnz.agg((F.lit(64) + F.sum(1 + 2 * F.col("nnz"))).alias("n_bytes"), F.sum("nnz").alias("nnz"))


@query(f"WITH {E}, {ORDER}, {DELTA} SELECT pos, CAST(k AS INTEGER) AS col, row_number() OVER (ORDER BY v, pos, k) - 1 AS place FROM d WHERE pos > 0 AND v <> 0")
def coo_by_value(spark, sf):
    """Changed places in the order of their values."""
    coo = deltas(spark, sf).select("pos", F.posexplode("d").alias("col", "v")).filter("v <> 0")
    return positions(coo, "v", "pos", "col", name="place").select("pos", "col", "place")


#: Rows of a block of a COO stream; a row's symbol is its number in its block.
COO_ROWS = 4096


def _coo_heap(stream: str, symbol: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE f AS (SELECT CAST({symbol} AS INTEGER) AS symbol, count(*) AS n FROM d WHERE pos > 0 AND v <> 0 GROUP BY 1), {HEAP.format(f='f')} SELECT '{stream}' AS stream, count(*) AS n_symbols, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol))"


@query(f"WITH RECURSIVE {E}, {ORDER}, {DELTA.replace('d AS (', 'd AS MATERIALIZED (', 1)} " + " UNION ALL ".join(_coo_heap(*x) for x in (("data", "v"), ("rows", f"pos % {COO_ROWS}"), ("cols", "k"))))
def coo_stream_bits(spark, sf):
    """Huffman codes of the values, rows and columns of the changed places, a book a stream."""
    coo = deltas(spark, sf).select("pos", F.posexplode("d").alias("col", "v")).filter("v <> 0")
    streams = F.array(*(F.struct(F.lit(name).alias("stream"), c.cast("int").alias("symbol")) for name, c in (("data", F.col("v")), ("rows", F.pmod("pos", F.lit(COO_ROWS))), ("cols", F.col("col")))))
    symbols = coo.select(F.inline(streams))
    return codes.bit_total(codes.codebook(codes.frequencies(symbols, "stream"), "stream"), "stream").select("stream", "n_symbols", "n_bits")


@query(f"WITH RECURSIVE {E}, {ORDER}, {DELTA}, f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM d WHERE pos > 0 GROUP BY v), {HEAP.format(f='f')} SELECT CAST(ceil(max(len) / 8) AS BIGINT) AS width_bytes, CAST(count(*) * (1 + ceil(max(len) / 8)) AS BIGINT) AS book_bytes FROM lens")
def code_width(spark, sf):
    """Bytes of the longest code, and of a book of one-byte symbols with their codes."""
    book = codes.codebook(codes.frequencies(deltas(spark, sf).select(F.explode("d").alias("symbol"))))
    width = F.ceil(F.max("len") / 8)
    return book.agg(width.cast("long").alias("width_bytes"), (F.count("*") * (1 + width)).cast("long").alias("book_bytes"))


@query(f"WITH RECURSIVE {E}, {ORDER}, {DELTA}, f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM d WHERE pos > 0 GROUP BY v), {HEAP.format(f='f')} SELECT count(*) AS n_symbols, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol)")
def delta_huffman_bits(spark, sf):
    book = codes.codebook(codes.frequencies(deltas(spark, sf).select(F.explode("d").alias("symbol"))))
    return codes.bit_total(book).select("n_symbols", "n_bits")


@query(f"WITH {E}, {ORDER}, {DELTA} SELECT pos, CAST(sum(least(v, 256 - v) * least(v, 256 - v)) AS BIGINT) AS w FROM d WHERE pos > 0 GROUP BY pos")
def order_distances(spark, sf):
    return with_previous(ordered_images(spark, sf).select("pos", "px"), ["px"]).filter("pos > 0").select("pos", P.distance(F.col("px"), F.col("px_1"), "l2").alias("w"))


@query(f"""WITH {E}, {ORDER}, {DELTA}, w AS (SELECT CAST(sum(least(v, 256 - v) * least(v, 256 - v)) AS BIGINT) AS w FROM d WHERE pos > 0 GROUP BY pos),
b AS (SELECT least(99, ((w - lo) * 100) // (hi - lo)) AS bin, count(*) AS n FROM w, (SELECT min(w) AS lo, max(w) AS hi FROM w) GROUP BY 1)
SELECT round(-sum(n / t * log2(n / t)), 9) AS entropy, count(*) AS bins FROM b, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM b)""")
def order_entropy(spark, sf):
    """Entropy of the distances along the order over 100 bins of equal width."""
    w = stored(order_distances(spark, sf), "distances")
    low, high = w.agg(F.min("w"), F.max("w")).first()
    b = w.groupBy(F.least(F.lit(99), F.floor((F.col("w") - low) * 100 / max(1, (high or 1) - (low or 0)))).alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.lit(w.count())
    return b.agg(F.round(F.sum(-p * F.log2(p)), 9).alias("entropy"), F.count("*").alias("bins"))


# -- graphs

PAIRS = "SELECT a.elem AS src, b.elem AS dst, {w} AS w FROM e a, e b WHERE a.elem <> b.elem"
W = {
    "l2": "CAST(list_sum(list_transform(list_zip(a.px, b.px), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)",
    "l1": "CAST(list_sum(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) AS BIGINT)",
    "hamming": "CAST(list_sum(list_transform(list_zip(a.px, b.px), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT)",
}


def _knn_sql(metric: str, k: int = 6) -> str:
    return f"pairs AS ({PAIRS.format(w=W[metric])}), knn AS (SELECT src, dst, w, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS rank FROM pairs) WHERE rank <= {k})"


def _knn(metric):
    def f(spark, sf):
        return graph.knn(images(spark, sf), 6, metric).select("src", "dst", "w", "rank")

    f.__name__ = f"knn_{metric}"
    return query(f"WITH {E}, {_knn_sql(metric)} SELECT * FROM knn")(f)


knn_l2, knn_l1, knn_hamming = map(_knn, ("l2", "l1", "hamming"))


@query(f"WITH {E}, pairs AS ({PAIRS.format(w=W['l2'])}) SELECT src, dst, w FROM pairs WHERE src < dst AND w <= 20000")
def radius_join(spark, sf):
    return graph.within(images(spark, sf), 20000).select("src", "dst", "w")


# edges of the graph of nearest two neighbours; labels spread until nothing changes
@query(f"""WITH RECURSIVE {E}, {_knn_sql('l2', 2)}, both_ways AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn),
reach(node, seen) AS (SELECT elem, elem FROM e UNION SELECT b.dst, r.seen FROM reach r JOIN both_ways b ON b.src = r.node WHERE b.dst > r.seen OR true)
SELECT node, min(seen) AS label FROM reach GROUP BY node""")
def knn_components(spark, sf):
    return connected_components(graph.knn(images(spark, sf), 2))


@query(f"WITH {E}, k AS (SELECT CAST(floor(ln(count(*))) AS BIGINT) AS k FROM e) SELECT k, CAST(1 AS BIGINT) AS components FROM k")
def knn_escalation(spark, sf):
    edges, k = graph.escalated_knn(images(spark, sf))
    return connected_components(edges).agg(F.lit(k).cast("long").alias("k"), F.countDistinct("label").alias("components"))


#: Prim's algorithm; the tree is that of the total order (w, src, dst).
PRIM = """u AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM knn GROUP BY ALL),
prim(step, seen, a, b, w) AS (SELECT 0, [(SELECT min(a) FROM u)], CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
 UNION ALL SELECT step + 1, list_append(seen, CASE WHEN list_contains(seen, x.a) THEN x.b ELSE x.a END), x.a, x.b, x.w
 FROM prim, LATERAL (SELECT u.a, u.b, u.w FROM u WHERE list_contains(seen, u.a) <> list_contains(seen, u.b) ORDER BY u.w, u.a, u.b LIMIT 1) x),
mst AS MATERIALIZED (SELECT a AS src, b AS dst, w FROM prim WHERE a IS NOT NULL)"""
#: floor(ln n) neighbours at n = 500 as in the escalation; the number follows the table.
MST_SQL = f"{_knn_sql('l2').replace('rank <= 6', 'rank <= (SELECT floor(ln(count(*))) FROM e)')}, {PRIM}"


def tree(spark, sf) -> DataFrame:
    edges, _ = graph.escalated_knn(images(spark, sf))
    return stored(graph.spanning_forest(edges), "tree")


@query(f"WITH RECURSIVE {E}, {MST_SQL} SELECT * FROM mst")
def mst_edges(spark, sf):
    return tree(spark, sf)


@query(f"WITH RECURSIVE {E}, {MST_SQL} SELECT count(*) AS n_edges, CAST(sum(w) AS BIGINT) AS weight, round(avg(w), 6) AS mean_weight FROM mst")
def mst_weight(spark, sf):
    return tree(spark, sf).agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"), F.round(F.avg("w"), 6).alias("mean_weight"))


@query(f"WITH RECURSIVE {E}, {MST_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM mst UNION ALL SELECT dst FROM mst) GROUP BY node")
def mst_degree(spark, sf):
    return tree(spark, sf).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


#: Hop distances of all pairs of a tree's nodes.
HOPS = """two AS (SELECT src AS x, dst AS y FROM mst UNION ALL SELECT dst, src FROM mst),
hop(x, y, before, d) AS (SELECT DISTINCT x, x, CAST(-1 AS BIGINT), 0 FROM two UNION ALL SELECT hop.x, two.y, hop.y, d + 1 FROM hop JOIN two ON two.x = hop.y WHERE two.y <> hop.before)"""


@query(f"WITH RECURSIVE {E}, {MST_SQL}, {HOPS} SELECT x AS node, round((count(*) - 1) / sum(d), 9) AS closeness FROM hop GROUP BY x")
def closeness(spark, sf):
    """Closeness centrality on the spanning tree."""
    rows = graph.centrality(tree(spark, sf).withColumn("layer", F.lit(0)))
    return rows.select("node", F.round((F.col("n") - 1) / F.col("total"), 9).alias("closeness"))


@query(f"WITH RECURSIVE {E}, {MST_SQL}, {HOPS} SELECT CAST(max(d) AS BIGINT) AS diameter, count(*) AS pairs FROM hop")
def tree_diameter(spark, sf):
    """Longest path of the spanning tree in hops."""
    return graph.centrality(tree(spark, sf).withColumn("layer", F.lit(0))).agg(F.max("farthest").alias("diameter"), F.sum("n").alias("pairs"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS elements, CAST(0 AS BIGINT) AS child_first FROM embeddings")
def mst_order_check(spark, sf):
    """The order is a permutation and no element comes before its parent."""
    order = stored(graph.ordered_by_tree(tree(spark, sf).withColumn("layer", F.lit(0))), "order")
    parents = order.select(F.col("elem").alias("parent"), F.col("pos").alias("at"))
    return order.join(parents, "parent", "left").agg(F.countDistinct("pos").alias("n"), F.countDistinct("elem").alias("elements"), F.coalesce(F.sum((F.col("at") >= F.col("pos")).cast("long")), F.lit(0)).alias("child_first"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS elements FROM embeddings")
def diameter_order_check(spark, sf):
    order = graph.ordered_by_tree(tree(spark, sf).withColumn("layer", F.lit(0)), "diameter")
    return order.agg(F.countDistinct("pos").alias("n"), F.countDistinct("elem").alias("elements"))


@query(f"""WITH RECURSIVE {E}, {_knn_sql('l2')}, m AS MATERIALIZED (SELECT src, dst, rank FROM knn),
chain(pos, elem, seen) AS (SELECT CAST(0 AS BIGINT), (SELECT min(elem) FROM e), [(SELECT min(elem) FROM e)]
 UNION ALL SELECT pos + 1, x.n, list_append(seen, x.n) FROM chain, LATERAL (SELECT coalesce(
  (SELECT m.dst FROM m WHERE m.src = chain.elem AND NOT list_contains(chain.seen, m.dst) ORDER BY m.rank LIMIT 1),
  (SELECT min(e.elem) FROM e WHERE NOT list_contains(chain.seen, e.elem))) AS n) x WHERE x.n IS NOT NULL)
SELECT pos, elem FROM chain""")
def greedy_chain(spark, sf):
    return graph.greedy_chain(graph.knn(images(spark, sf), 6)).select("pos", "elem")


def coarse(spark, sf) -> DataFrame:
    """Elements of four pixels of one bit, so that many are equal."""
    return bitmap.binary(images(spark, sf), 127).withColumn("px", F.slice("px", 1, 4))


COARSE = "c AS (SELECT elem, array_to_string(list_transform(px[1:4], lambda x: CASE WHEN x > 127 THEN 1 ELSE 0 END), ',') AS px FROM e)"


@query(f"WITH {E}, {COARSE} SELECT px, min(elem) AS elem, count(*) AS n FROM c GROUP BY px")
def distinct_elements(spark, sf):
    return coarse(spark, sf).groupBy("layer", "px").agg(F.min("elem").alias("elem"), F.count("*").alias("n")).select(joined("px").alias("px"), "elem", "n")


@query(f"""WITH {E}, {COARSE}, r AS (SELECT elem, min(elem) OVER (PARTITION BY px) AS rep FROM c)
SELECT CAST(row_number() OVER (ORDER BY rep, elem = rep, elem) - 1 AS BIGINT) AS pos, elem FROM r""")
def pad_order(spark, sf):
    df = stored(coarse(spark, sf).select("layer", "elem", "px"), "coarse")
    reps = df.groupBy("layer", "px").agg(F.min("elem").alias("elem"))
    order = positions(reps.select("layer", "elem"), "elem")
    return graph.padded(order, df).select("pos", "elem")


@query(f"WITH {E}, {_knn_sql('l2')} SELECT src AS elem, round(avg(nz), 6) AS mean_differing FROM (SELECT k.src, {W['hamming']} AS nz FROM knn k JOIN e a ON a.elem = k.src JOIN e b ON b.elem = k.dst) GROUP BY src")
def nnz_neighbourhood(spark, sf):
    df = images(spark, sf).select("elem", "px")
    near = graph.knn(images(spark, sf), 6).select("src", "dst")
    rows = near.join(df.toDF("src", "a"), "src").join(df.toDF("dst", "b"), "dst")
    return rows.groupBy(F.col("src").alias("elem")).agg(F.round(F.avg(P.distance(F.col("a"), F.col("b"), "hamming")), 6).alias("mean_differing"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reorder along the spanning tree, adjacent deltas, Huffman: sizes beside raw and unordered (a layer a row)."""
    df = stored(images(spark, sf_dir).select("layer", "elem", "px"), "elements")
    reps = df.groupBy("layer", "px").agg(F.min("elem").alias("elem"))
    edges, _ = graph.escalated_knn(reps)
    forest = graph.spanning_forest(edges).withColumn("layer", F.lit(0))
    order = graph.padded(graph.ordered_by_tree(forest).select("layer", "pos", "elem"), df)
    out = None
    for name, o in (("mst", order), ("id", positions(df.select("layer", "elem"), "elem"))):
        placed = o.join(df, ["layer", "elem"]).select("layer", "pos", "px")
        d = with_previous(placed, ["px"], 1, "pos", ("layer",)).filter("pos > 0").select("layer", P.wrapped_difference(F.col("px"), F.col("px_1")).alias("d"))
        symbols = d.select("layer", F.explode("d").alias("symbol"))
        size = codes.bit_total(codes.codebook(codes.frequencies(symbols, "layer"), "layer"), "layer").select("layer", F.lit(name).alias("order_by"), "n_symbols", F.col("n_bits").alias("payload_bits"), (F.col("n_values") * 8).alias("raw_bits"), F.round(F.col("n_bits") / (F.col("n_values") * 8), 6).alias("ratio"))
        out = size if out is None else out.unionByName(size)
    return out


_FLAGSHIP = f"""WITH RECURSIVE {E.replace("e AS (", "e0 AS MATERIALIZED (", 1)}, e AS MATERIALIZED (SELECT min(elem) AS elem, px FROM e0 GROUP BY px), {MST_SQL},
two AS (SELECT src AS x, dst AS y FROM mst UNION ALL SELECT dst, src FROM mst),
dfs(node, before, way) AS (SELECT min(elem), CAST(-1 AS BIGINT), [min(elem)] FROM e UNION ALL SELECT two.y, dfs.node, list_append(way, two.y) FROM dfs JOIN two ON two.x = dfs.node WHERE two.y <> dfs.before),
reps AS (SELECT px, node AS rep, row_number() OVER (ORDER BY way) AS place FROM dfs JOIN e ON e.elem = dfs.node),
walks AS (SELECT 'mst' AS order_by, row_number() OVER (ORDER BY place, elem = rep, elem) AS pos, px FROM e0 JOIN reps USING (px) UNION ALL SELECT 'id', row_number() OVER (ORDER BY elem), px FROM e0),
d AS MATERIALIZED (SELECT order_by, (v - lag(v) OVER (PARTITION BY order_by, k ORDER BY pos) + 256) % 256 AS v, pos FROM (SELECT order_by, pos, generate_subscripts(px, 1) AS k, unnest(px) AS v FROM walks)),
m AS (SELECT order_by, CAST(v AS INTEGER) AS symbol, count(*) AS n FROM d WHERE pos > 1 GROUP BY ALL) """


def _flagship_heap(name: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE f AS (SELECT symbol, n FROM m WHERE order_by = '{name}'), {HEAP.format(f='f')} SELECT 0 AS layer, '{name}' AS order_by, count(*) AS n_symbols, CAST(sum(n * len) AS BIGINT) AS payload_bits, CAST(sum(n) * 8 AS BIGINT) AS raw_bits, round(sum(n * len) / (sum(n) * 8), 6) AS ratio FROM lens JOIN f USING (symbol))"


query(_FLAGSHIP + " UNION ALL ".join(map(_flagship_heap, ("mst", "id"))))(flagship)


@query(f"WITH RECURSIVE {E}, {MST_SQL}, {HOPS} SELECT x AS node, row_number() OVER (ORDER BY round((count(*) - 1) / sum(d), 9) DESC, x) - 1 AS place FROM hop GROUP BY x")
def nodes_by_closeness(spark, sf):
    """Nodes in the order of their closeness."""
    rows = graph.centrality(tree(spark, sf).withColumn("layer", F.lit(0)))
    return positions(rows.select("node", F.round((F.col("n") - 1) / F.col("total"), 9).alias("closeness")), F.desc("closeness"), "node", name="place").select("node", "place")


@query(f"""WITH RECURSIVE {E}, {MST_SQL}, two AS (SELECT src AS x, dst AS y FROM mst UNION ALL SELECT dst, src FROM mst),
way(node, before, path) AS (SELECT min(x), CAST(-1 AS BIGINT), [min(x)] FROM two UNION ALL SELECT two.y, way.node, list_append(path, two.y) FROM way JOIN two ON two.x = way.node WHERE two.y <> way.before)
SELECT node, array_to_string(path, ',') AS path FROM way""")
def tree_paths(spark, sf):
    """Paths of the spanning tree from its least node."""
    return graph.paths(tree(spark, sf).withColumn("layer", F.lit(0))).select("node", joined("path").alias("path"))

# -- prediction

STENCIL = """g AS (SELECT o.pos, r, c, o.px[r * 8 + c] AS d, o.px[(r - 1) * 8 + c] AS a, o.px[(r - 1) * 8 + c + 1] AS b, o.px[r * 8 + c + 1] AS y{more} FROM o {join}, range(1, 8) t1(r), range(1, 8) t2(c))"""
G0 = STENCIL.format(more="", join="")
# the place itself (X) of the two images before: their order is D, A, B, X
PREV = ", ".join(f"o{a}.px[{at}]" for a in (1, 2) for at in ("r * 8 + c", "(r - 1) * 8 + c", "(r - 1) * 8 + c + 1", "r * 8 + c + 1"))
G2 = STENCIL.format(more=f", [o.px[r * 8 + c], o.px[(r - 1) * 8 + c], o.px[(r - 1) * 8 + c + 1], {PREV}] AS x", join="JOIN o o1 ON o1.pos = o.pos - 1 JOIN o o2 ON o2.pos = o.pos - 2")


def contexts(spark, sf, n_previous: int = 2) -> DataFrame:
    return shape.features(ordered_images(spark, sf), 8, 8, "DAB", "DABX", n_previous)


@query(f"WITH {E}, {ORDER}, {G2} SELECT pos, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, array_to_string(x, ',') AS x, y FROM g")
def context_features(spark, sf):
    return contexts(spark, sf).select("pos", "r", "c", joined("x").alias("x"), "y")


@query(f"""WITH {E}, {ORDER}, z AS (SELECT pos, CAST(k // 8 AS INTEGER) AS r, CAST(k % 8 AS INTEGER) AS c, v FROM (SELECT pos, generate_subscripts(px, 1) - 1 AS k, unnest(px) AS v FROM o))
SELECT pos, CASE WHEN pos < 2 THEN 0 WHEN r < 1 THEN 1 ELSE 2 END AS band, r, c, v FROM z WHERE pos < 2 OR r < 1 OR c < 1""")
def residual_pixels(spark, sf):
    return shape.border(ordered_images(spark, sf), 8, 8, "DAB", "DABX", 2)


@query("SELECT count(*) * 64 AS pixels, count(*) * 64 AS kept FROM embeddings")
def pixel_conservation(spark, sf):
    order = ordered_images(spark, sf)
    n = shape.border(order, 8, 8, "DAB", "DABX", 2).select("pos").unionByName(shape.features(order, 8, 8, "DAB", "DABX", 2).select("pos"))
    return n.agg(F.count("*").alias("kept")).crossJoin(order.agg((F.count("*") * 64).alias("pixels")))  # one row each


@query(f"""WITH {E}, {ORDER}, {G0}, z AS (SELECT [d, a, b, 1, y] AS z FROM g)
SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, CAST(sum(CAST(z[i] AS BIGINT) * z[j]) AS BIGINT) AS v FROM z, range(1, 6) t1(i), range(1, 6) t2(j) WHERE i <= j GROUP BY i, j""")
def gram_matrix(spark, sf):
    return predict.gram(contexts(spark, sf, 0), 3)


@query(f"WITH {E}, {ORDER}, {G0} SELECT (y - (d + b) // 2 + 256) % 256 AS e, count(*) AS n FROM g GROUP BY 1")
def predict_fixed_avg(spark, sf):
    df = predict.errors(contexts(spark, sf, 0), F.floor((F.col("x")[0] + F.col("x")[2]) / 2))
    return df.groupBy("e").agg(F.count("*").alias("n"))


@query(f"WITH {E}, {ORDER}, {G0}, s AS (SELECT count(*) AS n, CAST(sum(d) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(CAST(d AS BIGINT) * y) AS DOUBLE) AS sxy, CAST(sum(CAST(d AS BIGINT) * d) AS DOUBLE) AS sxx FROM g) SELECT round((n * sxy - sx * sy) / (n * sxx - sx * sx), 9) AS slope, round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 6) AS intercept FROM s")
def predict_one_feature_ols(spark, sf):
    x = F.col("x")[0].cast("long")
    s = contexts(spark, sf, 0).agg(F.count("*").alias("n"), F.sum(x).cast("double").alias("sx"), F.sum("y").cast("double").alias("sy"), F.sum(x * F.col("y")).cast("double").alias("sxy"), F.sum(x * x).cast("double").alias("sxx"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select(F.round(slope, 9).alias("slope"), F.round((F.col("sy") - slope * F.col("sx")) / F.col("n"), 6).alias("intercept"))


#: Gauss-Jordan on the sums [X'X | X'y] of features z (the last but one is 1, the last y), a step a column; beta holds the solution.
def _solved(d: int, z: str, by: str = "0") -> str:
    n = d + 1
    return f"""sums AS MATERIALIZED (SELECT {by} AS grp, i, j, CAST(sum(CAST(z[i] AS BIGINT) * z[j]) AS DOUBLE) AS v FROM {z}, range(1, {n + 1}) t1(i), range(1, {n + 2}) t2(j) GROUP BY ALL),
gj(grp, step, m) AS (SELECT grp, 0, list(r ORDER BY i) FROM (SELECT grp, i, list(v ORDER BY j) AS r FROM sums GROUP BY grp, i) GROUP BY grp
 UNION ALL SELECT grp, step + 1, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j: CASE WHEN i = step + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] END)) FROM gj WHERE step < {n}),
beta AS MATERIALIZED (SELECT grp, list_transform(m, lambda r: r[{n + 1}]) AS w FROM gj WHERE step = {n})"""


@query(f"""WITH RECURSIVE {E}, {ORDER}, {G2}, z AS MATERIALIZED (SELECT list_concat(x, [1, y]) AS z FROM g), {_solved(11, 'z')},
er AS (SELECT (z[13] - CAST(trunc(greatest(least(list_sum(list_transform(range(1, 13), lambda i: z[i] * w[i])), 255), 0)) AS INTEGER) + 256) % 256 AS v FROM z, beta),
f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM er GROUP BY v), {HEAP.format(f='f')} SELECT count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol)""")
def predict_linear_errors(spark, sf):
    """Huffman size of the errors of a least-squares model on 11 features."""
    f = stored(contexts(spark, sf), "features")
    e = predict.errors(f, predict.linear(F.col("x"), predict.linear_model(f, 11)))
    return codes.bit_total(codes.codebook(codes.frequencies(e.select(F.col("e").alias("symbol"))))).select("n_symbols", "n_values", "n_bits")


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS elements FROM embeddings")
def predict_roundtrip(spark, sf):
    """Errors and border pixels give every image back."""
    order = ordered_images(spark, sf)
    f = stored(shape.features(order, 8, 8, "DAB", "DABX", 1), "features")
    model = predict.linear_model(f, 7)
    coded = predict.errors(f, predict.linear(F.col("x"), model)).withColumn("chain", F.lit(0))
    edges = shape.border(order, 8, 8, "DAB", "DABX", 1).filter("band > 0").withColumn("chain", F.lit(0))
    first = order.filter("pos < 1").select("pos", "px").withColumn("chain", F.lit(0))
    back = predict.decode_linear(first, coded, edges, 8, 8, shape.CONTEXTS["DAB"], shape.CONTEXTS["DABX"], 1, model).withColumnRenamed("px", "back")
    return order.join(back, "pos", "left").agg(F.sum((~F.col("px").eqNullSafe(F.col("back"))).cast("long")).alias("mismatches"), F.count("*").alias("elements"))


def channel_contexts(spark, sf) -> DataFrame:
    """Contexts in the three 4 x 4 planes of the first 48 values, a layer each."""
    planes = shape.channels(ordered_images(spark, sf), 16).select("layer", "pos", "px")
    return shape.features(planes, 4, 4, "DAB", "DAB", 1, ("layer",))


_RGB = "p AS (SELECT pos, l AS layer, px[l * 16 + 1:l * 16 + 16] AS px FROM o, range(0, 3) t(l)), g AS (SELECT p.layer, [p.px[r * 4 + c], p.px[(r - 1) * 4 + c], p.px[(r - 1) * 4 + c + 1], q.px[r * 4 + c], q.px[(r - 1) * 4 + c], q.px[(r - 1) * 4 + c + 1], 1, p.px[r * 4 + c + 1]] AS z FROM p JOIN p q ON q.layer = p.layer AND q.pos = p.pos - 1, range(1, 4) t1(r), range(1, 4) t2(c))"


@query(f"WITH {E}, {ORDER}, {_RGB} SELECT CAST(layer AS INTEGER) AS layer, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, CAST(sum(CAST(z[i] AS BIGINT) * z[j]) AS BIGINT) AS v FROM g, range(1, 9) t1(i), range(1, 9) t2(j) WHERE i <= j GROUP BY layer, i, j")
def gram_matrix_channels(spark, sf):
    """Sums for three models, a channel each (M1)."""
    return predict.gram(channel_contexts(spark, sf), 6, "layer")


_TRIPLE = f"""WITH RECURSIVE {E}, {ORDER}, {_RGB}, {_solved(6, 'g', 'layer')},
er AS MATERIALIZED (SELECT layer, (z[8] - CAST(trunc(greatest(least(list_sum(list_transform(range(1, 8), lambda i: z[i] * w[i])), 255), 0)) AS INTEGER) + 256) % 256 AS v FROM g JOIN beta ON grp = layer) """


def _triple_heap(layer: int) -> str:
    return f"SELECT * FROM (WITH RECURSIVE f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM er WHERE layer = {layer} GROUP BY v), {HEAP.format(f='f')} SELECT {layer} AS layer, count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol))"


@query(_TRIPLE + " UNION ALL ".join(map(_triple_heap, range(3))))
def predict_triple_errors(spark, sf):
    """Code size of the errors of three models, a channel each."""
    f = stored(channel_contexts(spark, sf), "features")
    value = F.lit(0.0)
    for layer, model in predict.linear_models(f, 6, "layer").items():
        value = F.when(F.col("layer") == layer, predict.linear(F.col("x"), model)).otherwise(value)
    e = predict.errors(f, value).select("layer", F.col("e").alias("symbol"))
    return codes.bit_total(codes.codebook(codes.frequencies(e, "layer"), "layer"), "layer").select("layer", "n_symbols", "n_values", "n_bits")


@query()
def patch_entropy_by_order(spark, sf):
    """Entropy over 100 bins of the distances along the tree's order and along a random one, a 4 x 4 patch a row."""
    from brindle.plans.container import order_elements

    df = stored(shape.patches(images(spark, sf), 8, 4).select("layer", "elem", "px"), "patches")
    shuffled = positions(df.select("layer", "elem", F.xxhash64("elem", F.lit(42)).alias("h")), "layer", "h", "elem", name="all")
    first = shuffled.groupBy("layer").agg(F.min("all").alias("first"))
    orders = {"mst": order_elements(df), "random": shuffled.join(F.broadcast(first), "layer").select("layer", (F.col("all") - F.col("first")).alias("pos"), "elem")}
    out = None
    for name, order in orders.items():
        placed = order.join(df, ["layer", "elem"]).select("layer", "pos", "px")
        w = stored(with_previous(placed, ["px"], 1, "pos", ("layer",)).filter("pos > 0").select("layer", F.sqrt(P.distance(F.col("px"), F.col("px_1"), "l2")).alias("w")), "distances")
        ends = w.groupBy("layer").agg(F.min("w").alias("low"), F.max("w").alias("high"), F.count("*").alias("all"))
        step = F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) / 100
        bins = w.join(F.broadcast(ends), "layer").groupBy("layer", "all", F.least(F.lit(99), F.floor((F.col("w") - F.col("low")) / step)).alias("bin")).agg(F.count("*").alias("n"))
        p = F.col("n") / F.col("all")
        h = bins.groupBy("layer").agg(F.sum(-p * F.log2(p)).alias(f"{name}_entropy"))
        out = h if out is None else out.join(h, "layer")
    return out


RULES = [([(0, "<=", 120.0)], [0.5, 0.0, 0.5, 1.0]), ([(2, ">", 118.0)], [1.0, -1.0, 1.0, 0.0]), ([(0, ">", 120.0), (1, "<=", 130.0)], [0.25, 0.25, 0.5, 0.0])]


@query(f"""WITH {E}, {ORDER}, {G0}, q AS (SELECT y, CASE WHEN d <= 120 THEN 1 ELSE 0 END AS r1, CASE WHEN b > 118 THEN 1 ELSE 0 END AS r2, CASE WHEN d > 120 AND a <= 130 THEN 1 ELSE 0 END AS r3, 0.5 * d + 0.5 * b + 1 AS v1, CAST(d - a + b AS DOUBLE) AS v2, 0.25 * d + 0.25 * a + 0.5 * b AS v3 FROM g)
SELECT (y - CAST(trunc(greatest(least(CASE WHEN r1 + r2 + r3 > 0 THEN (r1 * v1 + r2 * v2 + r3 * v3) / (r1 + r2 + r3) ELSE 0 END, 255), 0)) AS INTEGER) + 256) % 256 AS e, count(*) AS n FROM q GROUP BY 1""")
def rule_model_average(spark, sf):
    return predict.errors(contexts(spark, sf, 0), predict.rules_value(F.col("x"), RULES)).groupBy("e").agg(F.count("*").alias("n"))


def _predictive(spark, sf, encoder: str, family: str = "linear", model: dict | None = None, n_previous: int = 0, channels: int = 1, restart: int = 0, previous: str = "DAB") -> tuple[DataFrame, str]:
    """A predictive container of the images in order of id, 8 x 8 or the first 48 values as 4 x 4 x 3."""
    placed = ordered_images(spark, sf).select("pos", "px")
    if channels == 3:
        placed = placed.select("pos", F.slice("px", 1, 48).alias("px"))
    placed = stored(placed, "placed")
    side = 4 if channels == 3 else 8
    path = scratch_path(spark, "predictive")
    predictive.compress(placed, path, predictive.Settings(side, side, channels, "DAB", previous, n_previous, restart), encoder, family, model)
    return placed, path


#: The mean of the left and the upper neighbour, as a model.
FIXED = {"family": "linear", "models": [[0.5, 0.0, 0.5, 0.0]]}
_STREAMS = f"WITH RECURSIVE {E}, {ORDER}, {G0}, er AS (SELECT (pos * 7 + r - 1) * 7 + c - 1 AS pos, (y - (d + b) // 2 + 256) % 256 AS v FROM g), re AS (SELECT v FROM (SELECT generate_subscripts(px, 1) - 1 AS k, unnest(px) AS v FROM o) WHERE k < 8 OR k % 8 = 0)"


def _stream_heap(source: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM {source} GROUP BY v), {HEAP.format(f='f')} SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol))"


@query(f"{_STREAMS} SELECT 'errors' AS stream, * FROM ({_stream_heap('er')}) UNION ALL SELECT 'residuals', * FROM ({_stream_heap('re')})")
def pred_huffman_bits(spark, sf):
    """Streams of a written container, a book for errors and one for residuals."""
    return predictive.sizes(spark, _predictive(spark, sf, "pred-huff", model=FIXED)[1])


@query(f"{_STREAMS} SELECT 'errors' AS stream, count(*) AS n, CAST(sum(v // 8 + 4) AS BIGINT) AS n_bits FROM er UNION ALL SELECT 'residuals', count(*), CAST(sum(v // 32 + 6) AS BIGINT) FROM re")
def pred_golomb_stream_bits(spark, sf):
    """Streams of a written container, Golomb codes of both (C11)."""
    return predictive.sizes(spark, _predictive(spark, sf, "pred-golomb", model=FIXED)[1])


@query(f"""{_STREAMS}, f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM er GROUP BY v), {HEAP.format(f='f')},
r1 AS (SELECT pos, v, CASE WHEN v = lag(v) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS st FROM er), r2 AS (SELECT v, sum(st) OVER (ORDER BY pos) AS run FROM r1), r3 AS (SELECT v, run, count(*) AS n FROM r2 GROUP BY v, run)
SELECT 'errors' AS stream, count(*) AS n, CAST(sum(len) AS BIGINT) AS n_bits FROM r3 JOIN lens ON lens.symbol = r3.v UNION ALL SELECT 'lengths', count(*), CAST(sum(n // 8 + 4) AS BIGINT) FROM r3 UNION ALL SELECT 'residuals', * FROM ({_stream_heap('re')})""")
def pred_huff_run_stream_bits(spark, sf):
    """Streams of a written container, runs of errors."""
    return predictive.sizes(spark, _predictive(spark, sf, "pred-huff-run", model=FIXED)[1])


def _roundtrip(name: str, **kw):
    def f(spark, sf):
        placed, path = _predictive(spark, sf, **kw)
        return _same(placed, predictive.decompress(spark, path))

    f.__name__ = name
    f.__doc__ = f"A written container gives every image back (M8, M10): {kw}."
    return query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS elements FROM embeddings")(f)


def _same(placed: DataFrame, back: DataFrame) -> DataFrame:
    back = back.select("pos", F.col("px").alias("back"))
    return placed.join(back, "pos", "full").agg(F.sum((~F.col("px").eqNullSafe(F.col("back"))).cast("long")).alias("mismatches"), F.count("*").alias("elements"))


pred_huffman_roundtrip = _roundtrip("pred_huffman_roundtrip", encoder="pred-huff", n_previous=2, restart=64, previous="DABX")
pred_golomb_roundtrip = _roundtrip("pred_golomb_roundtrip", encoder="pred-golomb", n_previous=1, restart=50)
pred_huff_run_roundtrip = _roundtrip("pred_huff_run_roundtrip", encoder="pred-huff-run", n_previous=1, restart=0)
pred_triple_roundtrip = _roundtrip("pred_triple_roundtrip", encoder="pred-huff", n_previous=1, restart=40, channels=3, previous="DABX")
pred_rules_roundtrip = _roundtrip("pred_rules_roundtrip", encoder="pred-huff", family="rules", n_previous=1, restart=100)
pred_logistic_roundtrip = _roundtrip("pred_logistic_roundtrip", encoder="pred-golomb", family="logistic", n_previous=0, restart=100)


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS elements FROM embeddings")
def pred_recode_roundtrip(spark, sf):
    """Streams coded another way twice still give every image back."""
    placed, path = _predictive(spark, sf, "pred-huff", n_previous=1, restart=128)
    for encoder in ("pred-huff-run", "pred-golomb"):
        path, before = scratch_path(spark, "recoded"), path
        predictive.recode(spark, before, path, encoder)
    return _same(placed, predictive.decompress(spark, path))


@query()
def model_tree_errors(spark, sf):
    """Code size of the errors of a model tree, a split and a linear model a leaf."""
    f = stored(contexts(spark, sf, 1), "features")
    e = predict.errors(f, predict.rules_value(F.col("x"), predict.model_tree(f, 7)))
    return codes.bit_total(codes.codebook(codes.frequencies(e.select(F.col("e").alias("symbol"))))).select("n_symbols", "n_values", "n_bits")


@query()
def logistic_accuracy(spark, sf):
    """Exact hits of a logistic model of one class a pixel value."""
    return predict.accuracy(predict.logistic_predictions(stored(contexts(spark, sf, 0), "features"), 3))


@query(f"""WITH RECURSIVE {E}, {ORDER}, {G0}, s AS (SELECT (pos * 7 + r - 1) * 7 + c - 1 AS pos, (y - (d + b) // 2 + 256) % 256 AS v FROM g),
f AS (SELECT CAST(v AS INTEGER) AS symbol, count(*) AS n FROM s GROUP BY v), {HEAP.format(f='f')},
r1 AS (SELECT pos, v, CASE WHEN v = lag(v) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS st FROM s), r2 AS (SELECT v, sum(st) OVER (ORDER BY pos) AS run FROM r1), r3 AS (SELECT v, run, count(*) AS n FROM r2 GROUP BY v, run)
SELECT count(*) AS n_runs, CAST(sum(len) AS BIGINT) AS symbol_bits, CAST(sum(r3.n // 8 + 4) AS BIGINT) AS length_bits FROM r3 JOIN lens ON lens.symbol = r3.v""")
def huff_run_bits(spark, sf):
    """Runs of errors: Huffman on their symbols with the whole stream's table, Golomb on their lengths."""
    e = predict.errors(contexts(spark, sf, 0), F.floor((F.col("x")[0] + F.col("x")[2]) / 2))
    e = stored(e.select(((F.col("pos") * 7 + F.col("r") - 1) * 7 + F.col("c") - 1).alias("pos"), F.col("e").alias("symbol")), "errors")
    book = codes.codebook(codes.frequencies(e))
    found = codes.encoded(codes.runs(e, "symbol").select("symbol", F.col("len").alias("run_len")), book)
    return found.agg(F.count("*").alias("n_runs"), F.sum(F.col("len")).cast("long").alias("symbol_bits"), F.sum(F.length(P.golomb(F.col("run_len"), 8))).cast("long").alias("length_bits"))


@query(f"""WITH {E}, {ORDER}, {G0} SELECT CAST(sum(e // 8 + 4) AS BIGINT) AS error_bits, (SELECT CAST(sum(v // 32 + 6) AS BIGINT) FROM (SELECT generate_subscripts(px, 1) - 1 AS k, unnest(px) AS v FROM o) WHERE k < 8 OR k % 8 = 0) AS residual_bits FROM (SELECT (y - (d + b) // 2 + 256) % 256 AS e FROM g)""")
def pred_golomb_bits(spark, sf):
    """Golomb sizes with k = 8 for errors and 32 for residuals (C11)."""
    order = ordered_images(spark, sf)
    e = predict.errors(shape.features(order, 8, 8, "DAB", "DAB", 0), F.floor((F.col("x")[0] + F.col("x")[2]) / 2))
    v = shape.border(order, 8, 8, "DAB", "DAB", 0)
    return e.agg(F.sum(F.length(P.golomb(F.col("e"), 8))).alias("error_bits")).crossJoin(v.agg(F.sum(F.length(P.golomb(F.col("v"), 32))).alias("residual_bits")))  # one row each


# -- tables

@query("SELECT 'c_mktsegment' AS \"column\", coalesce('=' || c_mktsegment, '~') AS symbol, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', coalesce('=' || CAST(c_nationkey AS VARCHAR), '~'), count(*) FROM customer GROUP BY 2")
def column_value_counts(spark, sf):
    return tabular.column_value_counts(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def categorical_codes(spark, sf):
    return tabular.categorical(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


_COLUMNS = ["o_orderstatus", "o_orderpriority"]


def _column_heap(c: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE f AS (SELECT {c} AS symbol, count(*) AS n FROM orders GROUP BY 1), {HEAP.format(f='f')} SELECT '{c}' AS \"column\", count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n * len) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol))"


@query(" UNION ALL ".join(map(_column_heap, _COLUMNS)))
def tabular_huffman_sizes(spark, sf):
    return tabular.huffman_sizes(table(spark, sf, "orders"), _COLUMNS).select("column", "n_symbols", "n_values", "n_bits")


_A = [5.0, 15.0, 25.0, 35.0, 45.0]
_JJ = "CAST((x > 10) AS INTEGER) + CAST((x > 20) AS INTEGER) + CAST((x > 30) AS INTEGER) + CAST((x > 40) AS INTEGER)"


def sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH h AS (SELECT CAST(p_size AS DOUBLE) AS x, count(*) AS n FROM part GROUP BY 1), b AS (SELECT x, n, {_JJ} AS j, 5.0 + 10 * ({_JJ}) AS a FROM h) SELECT j, CAST(a AS DOUBLE) AS a, CAST(sum(n) AS BIGINT) AS n, sum(x * n) AS total, round_even(sum(x * n) / sum(n), 0) AS new_a, sum((x - a) * (x - a) * n) AS sq FROM b GROUP BY j, a")
def lloyd_max_step(spark, sf):
    return tabular.lloyd_step(sizes(spark, sf), _A)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, " + _JJ.replace("x >", "l_quantity >") + " AS bin FROM lineitem")
def quantize_bins(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", tabular.bin_of(F.col("l_quantity"), tabular.midpoints(_A)).alias("bin"))


@query(f"SELECT round(avg((x - a) * (x - a)), 6) AS mse FROM (SELECT x, 5.0 + 10 * ({_JJ}) AS a FROM (SELECT CAST(p_size AS DOUBLE) AS x FROM part))")
def quantizer_mse(spark, sf):
    return tabular.lloyd_step(sizes(spark, sf), _A).agg(F.round(F.sum("sq") / F.sum("n"), 6).alias("mse"))


#: All runs from their starts, a round a step, until a bin is empty or the error falls by less than 1e-5; z is the state after it.
LLOYD = """h AS (SELECT list(x ORDER BY x) AS xs, list(n ORDER BY x) AS ns, count(*) AS m FROM (SELECT CAST(p_size AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1)),
z(run, step, a, mse, over) AS (SELECT run, 0, list_transform(range(16), lambda i: xs[CAST((i * 4294967296 + ((run * 16 + i + 1) * 2654435761) % 4294967296) * m // (16 * 4294967296) AS BIGINT) + 1]), CAST('inf' AS DOUBLE), false FROM h, range(64) t(run)
 UNION ALL SELECT run, step + 1, CASE WHEN empty OR mse - now < 1e-5 THEN a ELSE list_sort(means) END, CASE WHEN empty THEN -1 ELSE now END, empty OR mse - now < 1e-5
 FROM (SELECT *, list_contains(sizes, 0) AS empty, list_sum(list_transform(range(1, m + 1), lambda q: power(xs[q] - a[js[q] + 1], 2) * ns[q])) / list_sum(ns) AS now,
   list_transform(range(16), lambda j: round_even(list_sum(list_transform(range(1, m + 1), lambda q: CASE WHEN js[q] = j THEN xs[q] * ns[q] ELSE 0 END)) / greatest(sizes[j + 1], 1), 0)) AS means
  FROM (SELECT *, list_transform(range(16), lambda j: list_sum(list_transform(range(1, m + 1), lambda q: CASE WHEN js[q] = j THEN ns[q] ELSE 0 END))) AS sizes
   FROM (SELECT run, step, a, mse, m, xs, ns, list_transform(xs, lambda x: CAST(list_sum(list_transform(range(1, 16), lambda j: CASE WHEN x > (a[j] + a[j + 1]) / 2 THEN 1 ELSE 0 END)) AS BIGINT)) AS js FROM z, h WHERE NOT over))))"""


@query(f"WITH RECURSIVE {LLOYD} SELECT CAST(run AS INTEGER) AS run, array_to_string(list_transform(a, lambda x: CAST(x AS INTEGER)), ',') AS centroids, round(mse, 9) AS mse FROM z WHERE over")
def lloyd_max_runs(spark, sf):
    """The fixed point that each of 64 starts comes to (L1)."""
    h = stored(sizes(spark, sf), "histogram")
    runs = tabular.lloyd_max(h, tabular.starts(h, 16))
    return spark.createDataFrame([(k, ",".join(str(int(x)) for x in a), round(mse, 9)) for k, (a, mse) in enumerate(runs)], "run int, centroids string, mse double")


@query(f"WITH RECURSIVE {LLOYD} SELECT 16 AS bins, round(min(mse), 9) AS mse FROM z WHERE over AND mse >= 0")
def lloyd_max_run(spark, sf):
    """The least error of 64 starts (L4)."""
    a, mse = tabular.best_of(sizes(spark, sf), 16)
    return spark.createDataFrame([(len(a), round(mse, 9))], "bins int, mse double")


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) AS n FROM orders")
def tabular_roundtrip(spark, sf):
    """A table's streams give all its rows back, in their order."""
    df = table(spark, sf, "orders")
    path = scratch_path(spark, "tabular")
    tabular.compress_table(df, path)
    back = tabular.decompress_table(spark, path)
    return df.agg(F.count("*").alias("n")).select(F.lit(df.exceptAll(back).count()).alias("missing"), F.lit(back.exceptAll(df).count()).alias("added"), "n")


_ORDER_HEAP = "SELECT * FROM (WITH RECURSIVE f AS (SELECT coalesce('=' || {c}, '~') AS symbol, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT '.', 0), {heap} SELECT '{c}' AS \"column\", CAST(sum(n * len) + max(CASE WHEN symbol = '.' THEN len END) AS BIGINT) AS n_bits FROM lens JOIN f USING (symbol))"


@query(" UNION ALL ".join(_ORDER_HEAP.format(c=c, heap=HEAP.format(f="f")) for c in ("o_orderstatus", "o_orderpriority")))
def tabular_stream_bits(spark, sf):
    """Bits of the written streams, the end symbols (of weight 0) among them."""
    path = scratch_path(spark, "tabular")
    tabular.compress_table(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), path)
    return spark.read.parquet(f"{path}/blocks").groupBy("column").agg(F.sum("n_bits").alias("n_bits"))


# -- bitmaps

BITS = "bits AS (SELECT elem, label, k, CASE WHEN v > 127 THEN 1 ELSE 0 END AS x FROM cells), maj AS (SELECT label, k, CASE WHEN sum(x) * 2 > count(*) THEN 1 ELSE 0 END AS m FROM bits GROUP BY label, k), flip AS (SELECT elem, bits.label, k FROM bits JOIN maj USING (label, k) WHERE x <> m), isl AS (SELECT elem, k // 8 AS row, k % 8 AS col, k % 8 - row_number() OVER (PARTITION BY elem, k // 8 ORDER BY k) AS g FROM flip), rng AS (SELECT elem, CAST(row AS INTEGER) AS row, CAST(min(col) AS INTEGER) AS lo, CAST(max(col) + 1 AS INTEGER) AS hi FROM isl GROUP BY elem, row, g)"


def bits_of(spark, sf) -> DataFrame:
    return bitmap.binary(images(spark, sf), 127)


@query(f"WITH {E}, {CELLS}, {BITS} SELECT label, CAST(k AS INTEGER) AS k, m AS v FROM maj")
def majority_image(spark, sf):
    return bitmap.majority(bits_of(spark, sf))


@query(f"WITH {E}, {CELLS}, {BITS} SELECT elem, label, CAST(k AS INTEGER) AS k FROM flip")
def xor_diff(spark, sf):
    return bitmap.flips(bits_of(spark, sf))


@query(f"WITH {E}, {CELLS}, {BITS} SELECT * FROM rng")
def range_encode(spark, sf):
    return bitmap.ranges(bitmap.flips(bits_of(spark, sf)), 8)


@query(f"WITH {E}, {CELLS}, {BITS} SELECT elem, CAST(5 * (1 + 2 * count(DISTINCT row) + 2 * count(lo)) AS BIGINT) AS n_bits FROM e LEFT JOIN rng USING (elem) GROUP BY elem")
def range_bits(spark, sf):
    df = bits_of(spark, sf)
    return bitmap.range_bits(df, bitmap.ranges(bitmap.flips(df), 8))


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS elements FROM embeddings")
def range_roundtrip(spark, sf):
    df = bits_of(spark, sf)
    back = bitmap.unflipped(df, bitmap.ranges(bitmap.flips(df), 8), bitmap.majority(df), 8).withColumnRenamed("px", "back")
    return df.join(back, "elem", "left").agg(F.sum((~F.col("px").eqNullSafe(F.col("back"))).cast("long")).alias("mismatches"), F.count("*").alias("elements"))


PIXEL_H = "h AS (SELECT k, -sum(n / t * ln(n / t)) AS entropy FROM (SELECT k, v, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY k) AS t FROM cells GROUP BY k, v) GROUP BY k)"


def _pixel_entropy(spark, sf) -> DataFrame:
    n = images(spark, sf).select(F.posexplode("px").alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("k"))
    return n.withColumn("h", -p * F.log(p)).groupBy("k").agg(F.sum("h").alias("entropy"))


@query(f"WITH {E}, {CELLS}, {PIXEL_H} SELECT CAST(k AS INTEGER) AS k, round(entropy, 9) AS entropy FROM h")
def pixel_entropy(spark, sf):
    return _pixel_entropy(spark, sf).withColumn("entropy", F.round("entropy", 9))


@query(f"WITH {E}, {CELLS}, {PIXEL_H} SELECT CAST(k AS INTEGER) AS k, CAST(row_number() OVER (ORDER BY round(entropy, 9), k) - 1 AS BIGINT) AS place FROM h")
def entropy_feature_order(spark, sf):
    return positions(_pixel_entropy(spark, sf).withColumn("entropy", F.round("entropy", 9)), "entropy", "k", name="place").select("k", "place")


# -- theory, baselines

_DRAW = "CAST(('0x' || substr(md5('7:' || CAST(event_id AS VARCHAR)), 1, 13)) AS BIGINT) * 97 // 4503599627370496"


@query(f"SELECT CAST({_DRAW} AS BIGINT) AS bin, count(*) AS balls FROM events GROUP BY 1")
def balls_in_bins(spark, sf):
    """A ball an event, thrown into one of 97 bins by a hash: the bins that are not empty."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return table(spark, sf, "events").groupBy(F.shiftright(u * 97, 52).alias("bin")).agg(F.count("*").alias("balls"))


@query(f"""WITH {E}, {CELLS}, n AS (SELECT c.elem, c.k, c.v, coalesce(CASE WHEN c.k % 8 > 0 THEN l.v END, 0) AS a, coalesce(u.v, 0) AS b, coalesce(CASE WHEN c.k % 8 > 0 THEN lu.v END, 0) AS c
 FROM cells c LEFT JOIN cells l ON l.elem = c.elem AND l.k = c.k - 1 LEFT JOIN cells u ON u.elem = c.elem AND u.k = c.k - 8 LEFT JOIN cells lu ON lu.elem = c.elem AND lu.k = c.k - 9),
w AS (SELECT elem, (v - CASE WHEN c >= greatest(a, b) THEN least(a, b) WHEN c <= least(a, b) THEN greatest(a, b) ELSE a + b - c END + 384) % 256 - 128 AS e FROM n),
z AS (SELECT elem, CASE WHEN e < 0 THEN -2 * e - 1 ELSE 2 * e END AS z FROM w)
SELECT elem, CAST(min(bits) + 3 AS BIGINT) AS n_bits FROM (SELECT elem, j, sum((z >> j) + 1 + j) AS bits FROM z, range(8) t(j) GROUP BY elem, j) GROUP BY elem""")
def med_golomb_bits(spark, sf):
    """Image sizes under the median edge detector and Golomb codes, a stand-in for the lossless photo standard."""
    return images(spark, sf).select("elem", predict.rice_bits(predict.med_errors(F.col("px"), 8)).alias("n_bits"))

HOURS = "b AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bin FROM events), g AS (SELECT user_id, bin, bin - lag(bin) OVER (PARTITION BY user_id ORDER BY bin) - 1 AS gap FROM b)"


def spacings(spark, sf) -> DataFrame:
    """Empty hours between a user's busy hours."""
    hours = table(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("bin")).distinct()
    return hours.withColumn("gap", F.col("bin") - F.lag("bin").over(Window.partitionBy("user_id").orderBy("bin")) - 1)


@query(f"WITH {HOURS} SELECT user_id, bin, gap FROM g")
def bin_spacings(spark, sf):
    return spacings(spark, sf)


@query(f"WITH {HOURS} SELECT round(1 / avg(gap), 9) AS rate, count(gap) AS n FROM g")
def spacing_rate(spark, sf):
    """Rate of an exponential law of the gaps (T12), by maximum likelihood."""
    return spacings(spark, sf).agg(F.round(1 / F.avg("gap"), 9).alias("rate"), F.count("gap").alias("n"))


#: Order statuses' and segments' shares as distributions, for several n.
_CATEGORIES = "(SELECT id * 100 + n AS id, n, p FROM (SELECT CAST(1 AS INTEGER) AS id, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderstatus UNION ALL SELECT 2, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM customer) FROM customer GROUP BY c_mktsegment) s CROSS JOIN (SELECT 20 AS n UNION ALL SELECT 50 UNION ALL SELECT 90) t)"
_BOUNDS = "SELECT id, n, round(upper_nats, 6) AS upper_nats, round(lower_nats, 6) AS lower_nats FROM ({b}) x"


@query(_BOUNDS.format(b=theory.bounds_sql(_CATEGORIES)))
def multinomial_bounds(spark, sf):
    for t in ("orders", "customer"):
        table(spark, sf, t).createOrReplaceTempView(f"theory_{t}")
    source = _CATEGORIES.replace("FROM orders", "FROM theory_orders").replace("FROM customer", "FROM theory_customer")
    return spark.sql(_BOUNDS.format(b=theory.bounds_sql(source)))


@query("""WITH s AS (SELECT o_orderstatus AS c, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1), lf AS (SELECT j, coalesce(sum(ln(j)) OVER (ORDER BY j), 0) AS f FROM range(1, 41) t(j)),
g AS (SELECT CAST(0 AS BIGINT) AS j, 0.0 AS f UNION ALL SELECT * FROM lf), x AS (SELECT c, p, j, exp((SELECT f FROM g WHERE g.j = 40) - g.f - (SELECT f FROM g g2 WHERE g2.j = 40 - g.j) + g.j * ln(p) + (40 - g.j) * ln(1 - p)) * g.f AS t FROM s, g)
SELECT round((SELECT -f FROM g WHERE j = 40) - 40 * (SELECT sum(p * ln(p)) FROM s) + sum(t), 6) AS entropy FROM x""")
def multinomial_true_entropy(spark, sf):
    """Exact entropy of 40 draws from the order statuses."""
    n = 40
    s = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("c"))
    s = s.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0)))).withColumn("n", F.lit(n))  # a row a status
    cells = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("t", theory.binomial(F.col("n"), F.col("p"), F.col("j")) * theory.log_factorial(F.col("j")))
    per = cells.groupBy("o_orderstatus", "p").agg(F.sum("t").alias("t"))
    return per.agg(F.round(-theory.log_factorial(F.lit(n)) - n * F.sum(F.col("p") * F.log("p")) + F.sum("t"), 6).alias("entropy"))


@query()
def external_sizes(spark, sf):
    """Document sizes under gzip, bz2 and xz."""
    df = table(spark, sf, "documents").select("source", "text")
    return predict.compressed_size(df, "text").groupBy("source").agg(*(F.sum(c).alias(c) for c in ("raw", "gz", "bz2", "xz")))


@query("SELECT label, count(*) AS images, CAST(count(*) * 8 AS BIGINT) AS n_bytes FROM embeddings GROUP BY label")
def bit_pack_size(spark, sf):
    """One bit a pixel."""
    return images(spark, sf).groupBy("label").agg(F.count("*").alias("images"), F.sum(F.ceil(F.size("px") / 8)).alias("n_bytes"))


@query("SELECT CAST(0 AS BIGINT) AS far, count(*) AS elements FROM embeddings")
def dct_roundtrip(spark, sf):
    """The cosine transform and back are within 4 of every pixel (P8); in fact they are equal."""
    from brindle.operators.transforms import dct, inverse_dct

    df = images(spark, sf)
    back = inverse_dct(dct(df, 8), 8)
    far = F.exists(F.zip_with("px", "back", lambda a, b: F.abs(a - b) > 0), lambda x: x)
    return back.agg(F.sum(far.cast("long")).alias("far"), F.count("*").alias("elements"))


#: A fixed dictionary of four words on 64 places, and integer codes of an image: its quarters' means.
WORDS = [[1 if k // 16 == w else 0 for k in range(64)] for w in range(4)]


@query(f"WITH {E}, {CELLS} SELECT elem, string_agg(back, ',' ORDER BY k) AS back FROM (SELECT elem, k, CAST(sum(v) OVER (PARTITION BY elem, k // 16) // 16 AS INTEGER) AS back FROM cells) GROUP BY elem")
def dict_reconstruct(spark, sf):
    """Integer codes times a fixed dictionary, cut and wrapped (P10)."""
    import numpy as np

    from brindle.operators.transforms import reconstructed

    quarters = [F.floor(F.aggregate(F.slice("px", 16 * w + 1, 16), F.lit(0), lambda t, x: t + x) / 16).cast("double") for w in range(4)]
    return reconstructed(images(spark, sf).withColumn("code", F.array(*quarters)), np.array(WORDS, float)).select("elem", joined("back").alias("back"))


@query()
def dict_learned(spark, sf):
    """A learned non-negative dictionary brings the images back closer than their mean does."""
    from brindle.operators.transforms import dictionary_code, learned_dictionary

    df = images(spark, sf)
    words = learned_dictionary(df, 12, rounds=8)
    back = dictionary_code(df, words).select(P.distance(F.col("px"), F.col("back"), "l2").alias("w"), "px")
    mean = df.select(F.posexplode("px").alias("k", "v")).groupBy("k").agg(F.var_pop("v").alias("s")).agg(F.sum("s")).first()[0]
    return back.agg((F.avg("w") < mean).alias("closer"), F.count("*").alias("elements"))
