"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule w(t) = a + b*t over the training time t in
[0, 1]. Its integral, scaled to the source's target, is the source's
cumulative token demand; a document whose tokens begin at offset x of the
source's stream is needed when demand reaches x, so inverting the demand gives
its training position, and documents are range-sorted by position.

A source's stream is its documents in the order of md5(doc_id), read again
from the start when it runs out, cut where the target is met. Offsets are
running sums: inside buckets of a source (the first hex digits of the md5, so
that a hot source spreads over many tasks), plus the sums of the buckets
before, from one row per bucket.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, words

#: A source's total is shared out again where its target passes this many times its size.
MOST = 3
#: Weights by rank of the source: 1, 2, 3 and again. The ramp (a, b) of w(t) goes by the same rank: falling, flat, rising.
WEIGHTS = 3
RAMPS = [(1.5, -1.0), (1.0, 0.0), (0.5, 1.0)]


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, size_ -> plus rank, target. One row per source.

    Targets are min(MOST * size, level * weight), where the level makes them
    sum to the total size: the fixed point of capping and resharing by weight.
    Sources that cap first have the least MOST * size / weight, so the level is
    found from running sums in that order. Sources without words get 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = sizes.withColumn("rank", rank).withColumn("weight", (F.col("rank") % WEIGHTS + 1).cast("double"))
    s = s.withColumn("most", (F.lit(MOST) * F.col("size_")).cast("double"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("size_").over(every).cast("double"))
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(order), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    # The level if all sources before this one are capped and no other; the true one is the first that leaves its own source under its cap.
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(every)["level"])
    return s.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")))


def mix(docs: DataFrame, whole: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions, and the columns ``carry``, for every row of docs.

    docs needs doc_id, text and source. taken counts the words of the document
    that the mix takes, repeats counted; the source's stream is cut at its
    target, in the middle of a document, unless ``whole``: then a copy is taken
    if half of it or more lies before the cut. positions holds the training time
    of each copy that is taken, also in part. A null text has size 0; a null
    source is a source of its own, ranked last; repeated rows count each.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = F.size(words(F.col("text"))).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("key_"), *carry).withColumn("bucket", F.substring("key_", 1, 3))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    w = Window.partitionBy("source").orderBy("bucket")
    buckets = buckets.withColumn("before", F.sum("bucket_size").over(w) - F.col("bucket_size"))
    sizes = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("size_")))
    sizes = sizes.select(F.col("source").alias("source_"), F.col("size_").alias("source_size"), "target", "rank")
    known = buckets.join(sizes, F.col("source").eqNullSafe(F.col("source_"))).select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "before", "source_size", "target", "rank")
    inside = Window.partitionBy("source", "bucket").orderBy("key_", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    rows = rows.withColumn("offset", F.col("offset") + F.col("before"))
    cut = F.floor(F.col("target") + 0.5)
    left = [F.greatest(F.lit(0), F.least(F.col("size"), cut - F.col("source_size") * e - F.col("offset"))) for e in range(MOST)]
    if whole:
        left = [F.when((x > 0) & (2 * x >= F.col("size")), F.col("size")).otherwise(F.lit(0)) for x in left]
    taken = sum(left[1:], left[0]).cast("long")
    ramp = F.pmod(F.col("rank"), F.lit(len(RAMPS)))
    a = F.element_at(F.array(*[F.lit(x) for x, _ in RAMPS]), ramp + 1)
    b = F.element_at(F.array(*[F.lit(x) for _, x in RAMPS]), ramp + 1)

    def needed(offset):
        # Demand a*t + b*t*t/2 of a total of a + b/2 is the fraction x of the target; the root is written so that b may be 0.
        x = offset / F.col("target") * (a + b / 2)
        return 2 * x / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * b * x)))

    each = F.array(*[F.when(x > 0, needed(F.col("offset") + F.col("source_size") * e)) for e, x in enumerate(left)])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.filter(each, lambda p: p.isNotNull()).alias("positions"), *carry)


def op8(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, in training order; documents that are not taken come last."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE8 = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rnk FROM s),
w AS (SELECT *, (rnk % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM r),
l AS (SELECT a.*, (SELECT sum(source_size)::DOUBLE FROM w) AS total,
    coalesce((SELECT sum(b.most) FROM w b WHERE (b.most / b.weight, b.rnk) < (a.most / a.weight, a.rnk)), 0) AS capped,
    (SELECT sum(b.weight) FROM w b WHERE (b.most / b.weight, b.rnk) >= (a.most / a.weight, a.rnk)) AS open FROM w a),
v AS (SELECT (total - capped) / open AS level FROM l WHERE (total - capped) / open * weight <= most ORDER BY most / weight, rnk LIMIT 1),
t AS (SELECT source, source_size, rnk, least(most, coalesce((SELECT level FROM v), most) * weight) AS target FROM w),
o AS (SELECT d.*, source_size, target, rnk, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, floor(target + 0.5)::BIGINT - off)) + greatest(0, least(size, floor(target + 0.5)::BIGINT - source_size - off))
    + greatest(0, least(size, floor(target + 0.5)::BIGINT - 2 * source_size - off)) AS taken, [1.5, 1.0, 0.5][rnk % 3 + 1]::DOUBLE AS a, [-1.0, 0.0, 1.0][rnk % 3 + 1]::DOUBLE AS b FROM o)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
    CASE WHEN taken > 0 THEN round(2 * (off / target * (a + b / 2)) / (a + sqrt(greatest(0.0, a * a + 2 * b * (off / target * (a + b / 2))))), 9) END AS position FROM q
"""
