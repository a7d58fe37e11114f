"""Phrase collocations: counts of 1..max_n-grams per language, exact scores, and the best of each language.

The grams of a length are exploded into rows (lang, phrase, n), added up within
an Arrow batch first, and hash-aggregated by Spark. A gram is at most as
frequent as either part that is one word shorter, so the grams of a length are
exploded only where both parts may be frequent: a *sieve*, one bit per hash,
tells. A wrong bit costs a row that the count then drops; no frequent gram is
lost, and a sieve that is too small for the corpus lets more rows through, no
fewer. It is the only thing that is broadcast, at most MOST_BITS bits whatever
the corpus.
"""
from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .recompression import chunks

#: The query's limits: longest phrase, least count, phrases of a language.
MAX_N, LEAST, TOP = 5, 100, 2000
#: A sieve has about SPREAD bits per gram in it, LEAST_BITS to MOST_BITS.
SPREAD, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: A gram's hash goes on to the next word's by this factor.
STEP = 1_000_003
#: Shares that the join of one-word parts, and a language's ranking, are dealt to first.
SALTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 for a byte of a word, 1 for white space, 2 for what ends a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _words(data: np.ndarray, offsets: np.ndarray):
    """Of texts one after another: their words as an Arrow dictionary array, each word's text, and how many words from it on lie in its piece."""
    import pyarrow as pa

    low, kind = _LOWER[data], _KIND[data]
    inside = kind == 0
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    left = np.ones(len(starts), np.int64)
    if len(starts):
        # A piece ends where the next word has another text or more cuts before it.
        last = np.append((text[1:] != text[:-1]) | (piece[1:] != piece[:-1]), True)
        end = np.flatnonzero(last)
        left = end[np.searchsorted(end, np.arange(len(starts)))] - np.arange(len(starts)) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[inside])).dictionary_encode()
    return words, text, left


def _counted(lang_ids: np.ndarray, word_ids: np.ndarray, at: np.ndarray, k: int):
    """(first place, count) of every distinct (language, k words from a place on)."""
    import pandas as pd

    code = lang_ids[at]
    for j in range(k):
        code, _ = pd.factorize((code.astype(np.int64) << 32) | word_ids[at + j])
    distinct = int(code.max()) + 1 if len(code) else 0
    first = np.empty(distinct, np.int64)
    first[code[::-1]] = at[::-1]
    return first, np.bincount(code, minlength=distinct)


def _exploded(docs: DataFrame, k: int, sieve) -> DataFrame:
    """(lang, phrase, n): the k-grams of batches of docs (lang, text) that pass the sieve; for k = 1 also a null phrase with the number of words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def explode(batches):
        for batch in batches:
            langs = batch.column(0).cast(pa.string()).dictionary_encode()
            names, codes = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            for row, data, offsets in chunks(batch.column(1), 1 << 22):
                words, text, left = _words(data, offsets)
                ids, lang = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes[row + text].astype(np.int64)
                ok = left >= k
                if k > 1:
                    bits = np.frombuffer(sieve.value, np.uint8)
                    size = len(bits) * 8
                    hashed = np.fromiter((zlib.crc32(w.encode()) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))[ids]
                    h = np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.int64, len(names))[lang] % size
                    n = len(ids) - k + 2  # places that a part of k - 1 words may start at
                    if n < 2:
                        continue
                    h = h[:n]
                    for j in range(k - 1):
                        h = (h * STEP + hashed[j : j + n]) % size
                    known = (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0
                    ok = ok[: n - 1] & known[:-1] & known[1:]
                first, counts = _counted(lang, ids, np.flatnonzero(ok), k)
                parts = [words.dictionary.take(pa.array(ids[first + j])) for j in range(k)]
                phrases = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[first])), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])
                if k == 1:
                    total = np.bincount(lang, minlength=len(names))
                    yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(total.astype(np.int64))], ["lang", "phrase", "n"])

    return docs.mapInArrow(explode, "lang string, phrase string, n long")


def _hash(size: int) -> Column:
    """The bit of a phrase in a sieve of that size, as tasks compute it from words."""
    crc = lambda c: F.crc32(c.cast("binary"))
    return F.aggregate(F.split("phrase", " "), crc(F.col("lang")) % size, lambda h, w: (h * F.lit(STEP) + crc(w)) % size)


def _sieve(found: DataFrame) -> bytes:
    """The bits of all phrases of found, of a bounded size."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (SPREAD * max(1, found.count()) - 1).bit_length()))
    at = found.select((_hash(size) + 1).alias("bit"))
    pages = at.groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for p in pages:
        start = (p["page"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(p["bits"], np.uint8)
    return out.tobytes()


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of up to max_n words found ``least`` times or more, and (lang, n) with all words of a language.

    docs has lang (null: ``und``) and text (null: empty), read whole. A phrase
    lies in one piece (texts are cut at ``[.,;:!?\\x0A-\\x0D]``), occurrences
    overlap, A-Z are lower-cased, words ``[^\\x20\\x09]+`` are joined by one space.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    levels, totals, sieve = [], None, None
    for k in range(1, max_n + 1):
        found = _exploded(docs, k, sieve).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found = written(found.filter((F.col("f") >= least) | F.col("phrase").isNull()), "grams")
        if sieve:
            sieve.unpersist()
        if k == 1:
            totals = found.filter("phrase is null").select("lang", F.col("f").alias("n"))
        found = found.filter("phrase is not null")
        levels.append(found.withColumn("k", F.lit(k)))
        if k < max_n:
            sieve = spark.sparkContext.broadcast(_sieve(found))
    return reduce(DataFrame.unionByName, levels), totals


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut (ties: the first).

    The score floor(1000 * a * n / (l * r)) is computed in decimals of 38 digits.
    One-word parts are shared by many phrases: their rows are dealt to SALTS shares.
    """
    size = F.size(F.split("phrase", " "))
    salt = lambda part, phrase: F.when(~F.contains(part, F.lit(" ")), F.pmod(F.xxhash64(phrase), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    one = F.sequence(F.lit(0), F.when(F.col("k") == 1, SALTS - 1).otherwise(0))
    parts = grams.select("lang", F.col("phrase").alias("part"), "f", F.explode(one).alias("salt"))
    words = F.split("phrase", " ")
    cuts = grams.filter("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.concat_ws(" ", F.slice(words, 1, F.col("cut"))), "right": F.concat_ws(" ", F.slice(words, F.col("cut") + 1, size))})
    for side, name in (("left", "l"), ("right", "r")):
        keyed = cuts.withColumn("salt", salt(F.col(side), F.col("phrase")))
        cuts = keyed.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(name), "salt"), ["lang", side, "salt"]).drop("salt", side)
    score = F.expr("(1000BD * cast(f as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    cuts = cuts.join(totals, "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "f", "k", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.k", F.col("b.f").alias("a"), "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two to max_n words found ``least`` times or more.

    A phrase goes if a longer one that holds it is as frequent; as counts fall
    with length, one that is a word longer then is so too. Ties of score go to
    the more frequent phrase, then the first in byte order. Empty tables and
    texts give no rows; rows that repeat count as often as they stand; columns
    other than lang and text play no part.
    """
    grams, totals = frequent(docs, max_n, least)
    found = written(scored(grams, totals), "phrases")
    words, k = F.split("phrase", " "), F.col("k")
    inner = F.explode(F.array(F.concat_ws(" ", F.slice(words, 1, k - 1)), F.concat_ws(" ", F.slice(words, 2, k - 1))))
    covered = found.filter("k > 2").select("lang", inner.alias("phrase"), "a")
    kept = found.join(covered, ["lang", "phrase", "a"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE13 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rn, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS pn, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM p),
w AS (SELECT pn, lang, generate_subscripts(ws, 1) AS i, ws FROM q WHERE len(ws) > 0),
u AS (SELECT lang, unnest(generate_series(1, least(5, len(ws) - i + 1))) AS k, ws, i FROM w),
c AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM u GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT * FROM c WHERE k > 1 AND f >= 100),
x AS (SELECT lang, phrase, k, f, unnest(generate_series(1, k - 1)) AS cut, string_split(phrase, ' ') AS ws FROM a),
s AS (SELECT x.lang, x.phrase, x.k, x.f AS a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.f * n.n) // (l.f::HUGEINT * r.f) AS score
    FROM x JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
    JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN n ON n.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, f, k AS longer, string_split(phrase, ' ') AS ws FROM a WHERE k > 2),
i AS (SELECT lang, f, longer, ws, unnest(generate_series(2, longer - 1)) AS m FROM o),
j AS (SELECT lang, f, ws, m, unnest(generate_series(1, longer - m + 1)) AS i FROM i),
v AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN j ON j.lang = b.lang AND b.phrase = array_to_string(j.ws[j.i:j.i + j.m - 1], ' ') AND 100 * j.f >= 100 * b.a),
k AS (SELECT b.* FROM b ANTI JOIN v ON v.lang = b.lang AND v.phrase = b.phrase),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM k)
SELECT * FROM z WHERE rank <= 2000
"""
