"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range, so
it grows with the document: the sketches of a part and of a whole that are very
unequal in length still estimate containment, and the sketch of a union is the
union of the sketches. A text of up to SHORT shingles keeps all of its hashes,
so that two short texts are compared exactly; against a longer one it is
compared below the threshold, where a part of fewer than some 50 shingles is an
estimate from under six hashes. A long text whose hashes all lie above the
threshold keeps its least one, so no text with a word has an empty sketch.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, words

SHINGLE = 5
#: One hash in SCALE is retained; all of them up to SHORT.
SCALE, SHORT = 8, 128
_LEAST = -(1 << 63)

#: Quantiles of doc_id, and bytes of a segment of them.
QUANTILES, SEGMENT_BYTES = 256, 4 << 20
#: Segments up to which their first rows are found by a broadcast; more go through a shuffled join.
BROADCAST_SEGMENTS = 65_536


def _below(hashes: Column, scale: int) -> Column:
    return F.filter(hashes, lambda h: h < F.lit(_LEAST + (1 << 64) // scale))


def _kept(hashes: Column, scale: int) -> Column:
    """What a sketch holds of distinct hashes."""
    low = _below(hashes, scale)
    return F.when(F.size(hashes) <= SHORT, hashes).when(F.size(low) == 0, F.array(F.array_min(hashes))).otherwise(low)


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with the sketch of its column text as ``name``: distinct longs, ascending.

    A text of fewer than SHINGLE words is one shingle; one without words, or
    null, has an empty sketch.
    """
    n = F.size("words_")
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get("words_", i + k) for k in range(SHINGLE)]))
    df = df.withColumn("words_", words(F.col(text)))
    df = df.withColumn("hashes_", F.when(n >= SHINGLE, each).when(n > 0, F.array(F.xxhash64("words_"))).otherwise(F.array().cast("array<long>"))).drop("words_")
    # Long texts are cut to what lies below the threshold before repeats are looked for.
    df = df.withColumn("low_", F.when(F.size("hashes_") > 8 * SHORT, _below(F.col("hashes_"), scale)))
    df = df.withColumn("low_", F.array_distinct(F.when(F.size("low_") > SHORT, F.col("low_")).otherwise(F.col("hashes_"))))
    return df.withColumn(name, F.array_sort(_kept(F.col("low_"), scale))).drop("hashes_", "low_")


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together. Where both kept all, and are more than SHORT together, or one kept all, it is cut to what lies below the threshold."""
    both = F.array_sort(F.array_union(a, b))
    whole = _whole(a, scale) & _whole(b, scale)
    low = _below(both, scale)
    return F.when(whole | (F.size(low) == 0), _kept(both, scale)).otherwise(low)


def _whole(sketch: Column, scale: int) -> Column:
    """Whether a sketch shows that it kept all hashes: one lies above the threshold, or there are none."""
    return (F.size(sketch) == 0) | (F.array_max(sketch) >= F.lit(_LEAST + (1 << 64) // scale))


def _alike_cut(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """Two sketches at the scale that both have."""
    whole = _whole(a, scale) & _whole(b, scale)
    return F.when(whole, a).otherwise(_below(a, scale)), F.when(whole, b).otherwise(_below(b, scale))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity, exact for two short texts; 1 for equal sketches."""
    x, y = _alike_cut(a, b, scale)
    common = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).otherwise(F.coalesce(common / F.nullif(F.size(x) + F.size(y) - common, F.lit(0)), F.lit(0.0)))


def containment(part: Column, whole: Column, scale: int = SCALE) -> Column:
    """Estimated share of part's shingles that whole has, exact for two short texts; 1 for an empty part."""
    x, y = _alike_cut(part, whole, scale)
    return F.when((F.size(part) == 0) | (part == whole), 1.0).otherwise(F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, carry: list[str], prepare=lambda d: d) -> DataFrame:
    """docs (doc_id, text, ...) with next_: the struct of the columns ``carry`` of the next row by descending doc_id.

    The last row's next is the first; a single row is its own next. Rows of one
    doc_id follow each other by hash of their text; null ids come last.
    ``prepare`` adds columns before the one shuffle, which deals rows by
    segments of the doc_id range, of about SEGMENT_BYTES of text, each with a guest: the first row of the
    segment that follows in descending order.
    """
    docs = docs.withColumn("tie_", F.xxhash64("text"))
    probes = [i / QUANTILES for i in range(1, QUANTILES)]
    least, most, found = docs.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", probes, 10_000)).first()
    bounds = sorted({least, *found, most}) if found else []
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    docs = docs.withColumn("q_", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))) + 1))
    # A quantile gets as many segments as its bytes need: a row per quantile comes to the driver.
    sizes = {r[0]: r[1] or 0 for r in docs.groupBy("q_").agg(F.sum(F.octet_length("text"))).collect()}
    per = [max(1, -(-sizes.get(q, 0) // SEGMENT_BYTES)) for q in range(len(bounds) + 2)]
    starts = [sum(per[:q]) for q in range(len(per))]
    at = lambda values, q: F.get(F.array(*[F.lit(v).cast("long") for v in values]), q)
    lo, hi = F.get(edges, F.greatest(F.col("q_") - 2, F.lit(0))), F.get(edges, F.greatest(F.col("q_") - 1, F.lit(0)))
    parts = at(per, F.col("q_"))
    # Rows without an id lie in the order of their texts' hashes.
    share = F.when(F.col("q_") == 0, F.col("tie_").cast("double") / 2.0**64 + 0.5).otherwise((F.col("doc_id") - lo).cast("double") / (hi - lo).cast("double"))
    inner = F.when(parts > 1, F.greatest(F.lit(0), F.least(F.floor(share * parts), parts - 1))).otherwise(0)
    docs = docs.withColumn("seg_", at(starts, F.col("q_")) + F.coalesce(inner, F.lit(0)))
    # One row per segment: its first row in descending order goes, as a guest, to the next higher segment there is; the highest wraps round.
    first = docs.groupBy("q_", "seg_").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.col("tie_").alias("tie"))).alias("top"))
    least = first.groupBy("q_").agg(F.min("seg_").alias("least"))
    over = Window.orderBy("q_")  # a row per quantile
    least = least.withColumn("to_next", F.coalesce(F.lead("least").over(over), F.min("least").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("least")
    first = first.join(F.broadcast(least), "q_").withColumn("to_", F.coalesce(F.lead("seg_").over(Window.partitionBy("q_").orderBy("seg_")), "to_next"))
    first = first.select(F.col("seg_").alias("from_"), F.col("top.id").alias("id_"), F.col("top.tie").alias("top_tie_"), "to_")
    docs = docs.drop("q_")
    if sum(per) <= BROADCAST_SEGMENTS:
        first = F.broadcast(first)
    is_first = (F.col("seg_") == F.col("from_")) & (F.coalesce("doc_id", F.lit(_LEAST)) == F.col("id_")) & (F.col("tie_") == F.col("top_tie_"))
    guests = docs.join(first, is_first).withColumn("seg_", F.col("to_")).drop("from_", "id_", "top_tie_", "to_")
    both = docs.withColumn("guest_", F.lit(False)).unionByName(guests.withColumn("guest_", F.lit(True)))
    both = prepare(both)
    w = Window.partitionBy("seg_").orderBy("guest_", F.col("doc_id").desc_nulls_last(), F.col("tie_").desc())
    both = both.withColumn("next_", F.lead(F.struct(*carry)).over(w))
    return both.filter(~F.col("guest_")).drop("seg_", "guest_", "tie_")


def op4(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = with_next(docs, ["text", "sketch"], lambda x: with_sketch(x, "text", "sketch"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next_.text"), F.lit(1), half)))
    d = with_sketch(d.withColumn("next_sketch", F.col("next_.sketch")).drop("text", "next_"), "edited", "edited_sketch")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )
