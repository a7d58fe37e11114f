"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon is mined from a bounded sample of labelled rows: words and beginnings
of words that are far more usual in toxic texts than in others. A text becomes
a few densities: of the lexicon's tiers, of its words near a second person, of
capitals, punctuation and disguised words. A text is scored where it lies,
whole and without a shuffle. Spark ML grows the trees and calibrates on rows
that they haven't seen.
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import log1p

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Labelled rows of a class to learn from (about: taken by a hash of doc_id), and one in how many of them calibrates.
SAMPLE, CALIBRATE = {1: 4000, 0: 8000}, 4
#: Lengths of beginnings; least G-test and least odds of an entry; odds from which it is a strong one; most entries of a tier.
LENGTHS, LEAST_G, LEAST_ODDS, STRONG_ODDS, LEXICON = range(4, 9), 25.0, 4.0, 20.0, 400
#: Words to either side in which a second person counts as near.
NEAR = 5
#: Trees, their depth, and their share of a step.
TREES, DEPTH, STEP = 25, 3, 0.2
#: The trees' own probability breaks the calibration's ties by this weight.
TIES = 0.001

#: Second persons of the languages at hand, lower-cased.
SECOND = frozenset("you your yours yourself u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
#: What stands for a letter in disguised words, and the letters.
DISGUISES, LETTERS = "013457@$!*", "oieastasi"
PLAIN = str.maketrans(DISGUISES[:-1], LETTERS)
SYMBOLS = "#*$%&@|<>"
RUN, CAPITALS, MARK_RUNS = re.compile(r"[^\W\d_]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[!?]{2,}")
#: A word with such signs between letters.
DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+")

FEATURES = ["strong", "weak", "words_strong", "log_strong", "near_second", "second", "capitals", "shouted", "marks", "mark_runs", "disguised", "disguised_hits", "symbols", "log_words"]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Lexicon:
    """Entries of two kinds, whole words and beginnings, and two tiers: (whole word?, strong?) to a set."""

    entries: dict

    def tagger(self):
        """A function from a lower-cased word to its tier: 1 and 2 are strong (a word, a beginning), 3 and 4 weak, 0 none."""
        tiers = [(self.entries.get(k, frozenset()), k[0]) for k in ((True, True), (False, True), (True, False), (False, False))]

        @lru_cache(1 << 18)
        def tag(w: str) -> int:
            return next((i for i, (entries, whole) in enumerate(tiers, 1) if (w in entries if whole else any(w[:k] in entries for k in LENGTHS))), 0)

        return tag


def mined(sample: DataFrame) -> Lexicon:
    """The lexicon of a bounded sample (text, toxic 0 or 1): at most LEXICON entries of a kind and tier, by their G-test over documents."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({})
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    # An entry is one string, so that they are told apart by hash: a word has "=" before it.
    starts = [lambda w, k=k: F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in LENGTHS]
    every = F.flatten(F.transform(words, lambda w: F.array(F.concat(F.lit("="), w), *[s(w) for s in starts])))
    rows = sample.select("toxic", F.explode(F.array_distinct(every)).alias("x")).filter("x is not null and x != '='").groupBy("x").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, na, nb = F.col("a"), F.col("b"), F.lit(float(sizes[1])), F.lit(float(sizes[0]))
    each = (a + b) / (na + nb)
    part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
    g = 2 * (part(a, na * each) + part(b, nb * each) + part(na - a, na * (1 - each)) + part(nb - b, nb * (1 - each)))
    odds = ((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1))
    judged = rows.select("x", F.col("x").startswith("=").alias("word"), g.alias("g"), odds.alias("odds")).filter((F.col("g") >= LEAST_G) & (F.col("odds") >= LEAST_ODDS))
    first = Window.partitionBy("word", "strong").orderBy(F.desc("g"), "x")
    best = judged.withColumn("strong", F.col("odds") >= STRONG_ODDS).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= LEXICON).collect()
    return Lexicon({(r["word"], r["strong"]): frozenset(x["x"].lstrip("=") for x in best if (x["word"], x["strong"]) == (r["word"], r["strong"])) for r in best})


def measured(text: str | None, tag) -> tuple:
    """The FEATURES of a text; tag(word) is the tier of a lower-cased word. All are 0 for a text without words but marks, symbols and capitals."""
    text = text or ""
    runs = RUN.findall(text.lower())
    counts = Counter(runs)
    n, chars = max(1, len(runs)), max(1, len(text))
    tags = {w: t for w in counts if (t := tag(w))}
    strong = {w for w, t in tags.items() if t <= 2}
    hits = sum(counts[w] for w in strong)
    near = 0
    if strong and not SECOND.isdisjoint(counts):
        near = sum(not SECOND.isdisjoint(runs[max(0, i - NEAR) : i + NEAR + 1]) for i, w in enumerate(runs) if w in strong)
    capitals = CAPITALS.findall(text)
    disguised = DISGUISED.findall(text.lower()) if any(c in text for c in DISGUISES) else []
    undone = sum(tag("".join(RUN.findall(t.translate(PLAIN)))) in (1, 2) for t in disguised)
    return (
        hits / n,
        sum(counts[w] for w, t in tags.items() if t > 2) / n,
        sum(counts[w] for w, t in tags.items() if t == 1) / n,
        log1p(hits),
        near / n,
        sum(counts[w] for w in SECOND if w in counts) / n,
        sum(map(len, capitals)) / chars,
        sum(len(c) > 1 for c in capitals) / n,
        (text.count("!") + text.count("?")) / chars,
        len(MARK_RUNS.findall(text)) / n,
        len(disguised) / n,
        undone / n,
        sum(text.count(c) for c in SYMBOLS) / chars,
        log1p(len(runs)),
    )


def features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (with text) plus the FEATURES, doubles; a null text counts as empty."""
    columns = docs.columns
    at = columns.index("text")

    def judge(batches):
        import pyarrow as pa

        tag = lexicon.tagger()
        for batch in batches:
            # A text after the other: only one is held as words.
            rows = np.array([measured(x.as_py(), tag) for x in batch.column(at)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, rows.T)], [*columns, *FEATURES])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *[T.StructField(f, T.DoubleType()) for f in FEATURES]]))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold): about SAMPLE rows of a class, one text a doc_id; fold 0 calibrates.

    A doc_id with several labels is toxic if one says so; null labels and ids
    are left out. The labels taken are few, so they go to the texts.
    """
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for k, size in sizes.items():
        share = F.when(F.col("toxic") == k, min(1.0, SAMPLE[k] / size)).otherwise(share)
    few = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return one.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(CALIBRATE)))


def scored(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (with text) plus score (0 to 1) and predicted (1 from 0.5 on).

    Learns from the rows of labelled (doc_id, text) with a label in labels
    (doc_id, toxic). Where one class has no labelled text, every score is 1 or
    0 as the other class says, 0 without labels. Rows are scored one by one, so
    repeated rows, ties and extra columns need no care.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    kept = docs.columns
    rows = written(sampled(labelled, labels), "labelled")
    seen = {(r["toxic"], r["calibrates"]) for r in rows.select("toxic", (F.col("fold") == 0).alias("calibrates")).distinct().collect()}
    if not {(0, False), (1, False)} <= seen:
        only = {k for k, _ in seen}
        out = docs.withColumn("score", F.lit(1.0 if only == {1} else 0.0))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    lexicon = mined(rows.filter("fold != 0").select("text", "toxic"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features_")
    of = lambda d: vector.transform(features(d, lexicon))
    dense = written(features(rows, lexicon).select("toxic", "fold", *FEATURES), "features")
    train = vector.transform(dense.filter("fold != 0")).coalesce(4)
    trees = GBTClassifier(featuresCol="features_", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=7).fit(train)
    trees.setRawPredictionCol("raw_").setProbabilityCol("chances_").setPredictionCol("vote_")
    judged = lambda d: trees.transform(d).withColumn("chance_", vector_to_array("chances_")[1])
    out = judged(of(docs))
    score = F.col("chance_")
    if {(0, True), (1, True)} <= seen:
        curve = IsotonicRegression(featuresCol="chance_", labelCol="toxic", predictionCol="even_").fit(judged(vector.transform(dense.filter("fold = 0"))))
        out = curve.transform(out)
        score = (1 - TIES) * F.col("even_") + TIES * F.col("chance_")
    out = out.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*kept, "score", "predicted")


def op11(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    out = scored(docs, docs.filter(~held_out()), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
