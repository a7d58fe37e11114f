"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds the ratio of two counts of a document from below, above or both.
The counts and all rules are built-in functions of the text: no user function,
shuffle or state, so a document costs its own length wherever it lies.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, words

#: Common short words of the languages at hand.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "with", "for", "was", "be", "have", "it", "on", "as", "at", "are", "this", "by", "from",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "plus", "sur", "au", "avec",
    "el", "los", "las", "y", "se", "del", "una", "por", "con", "no", "su", "para", "es", "lo", "como", "más", "o", "al", "que", "un",
]
SYMBOLS = "#*$%&|<>"
REPEAT = 5


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose count / per lies in [least, most]; where per is 0 the ratio is 0."""

    name: str
    count: str
    per: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("words", "n_words", "one", 10, 1_000_000),
    Rule("word length", "word_chars", "n_words", 2, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop words", "n_stop_words", "n_words", 0.04, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.3),
)


def counts(docs: DataFrame) -> DataFrame:
    """docs (with a text column) plus the counts that rules may name.

    n_words, word_chars (code points in words), n_symbols, n_stop_words,
    n_lines (lines with a word), n_dup_lines (such lines equal to an earlier
    one), n_repeat_words (words in REPEAT-word windows found twice or more in
    the text). A null text counts as an empty one: all counts are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"text_": text, "words_": words(F.col("text"))})
    spaces = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split("text_", "\n"), lambda x: F.translate(x, spaces, "") != "")
    n = F.size("words_")
    hashes = F.when(n >= REPEAT, F.transform(F.sequence(F.lit(0), n - REPEAT), lambda i: F.xxhash64(*[F.get("words_", i + k) for k in range(REPEAT)])))
    d = d.withColumns({"lines_": lines, "hashes_": hashes})
    # Only texts that hold a window twice are sorted: (hash, place), so that equal windows are neighbours.
    pairs = F.when(F.size(F.array_distinct("hashes_")) < F.size("hashes_"), F.array_sort(F.transform("hashes_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.translate("text_", spaces, "")).cast("long"),
            "n_symbols": (F.char_length("text_") - F.char_length(F.translate("text_", SYMBOLS, ""))).cast("long"),
            "n_stop_words": F.size(F.filter("words_", lambda w: w.isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("lines_").cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "pairs_": pairs,
        }
    )
    same = lambda e, j, by: (j + by >= 0) & F.coalesce(F.get("pairs_", j + by)["h"] == e["h"], F.lit(False))
    places = F.filter(F.transform("pairs_", lambda e, j: F.when(same(e, j, -1) | same(e, j, 1), e["i"])), lambda i: i.isNotNull())
    covered = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(-REPEAT).alias("last"), F.lit(0).alias("total")),
        lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(REPEAT), i - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("text_", "words_", "lines_", "hashes_", "pairs_")


def passes(rules=RULES) -> Column:
    """One boolean column of the counts: true if every rule holds."""
    out = F.lit(True)
    for r in rules:
        per = F.lit(1.0) if r.per == "one" else F.col(r.per).cast("double")
        ratio = F.when(per == 0, F.lit(0.0)).otherwise(F.col(r.count) / per)
        if r.least is not None:
            out = out & (ratio >= float(r.least))
        if r.most is not None:
            out = out & (ratio <= float(r.most))
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; extra columns of the table play no part."""
    d = counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes())
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


ORACLE5 = (
    r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
u AS (SELECT rn, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
g AS (SELECT rn, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY rn ORDER BY i)),
h AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, w, w1, w2, w3, w4) AS n FROM g WHERE w4 IS NOT NULL),
p AS (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS before FROM h WHERE n > 1),
r AS (SELECT rn, sum(least(5, i - coalesce(before, i - 5)))::BIGINT AS n_repeat_words FROM p GROUP BY rn),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(ws, lambda w: list_contains(["""
    + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + r"""], w)))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines FROM d LEFT JOIN r USING (rn)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
    AND n_words BETWEEN 10 AND 1000000 AND word_chars::DOUBLE / n_words BETWEEN 2 AND 20 AND n_symbols::DOUBLE / n_words <= 0.1
    AND n_stop_words::DOUBLE / n_words >= 0.04 AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) <= 0.3 AS kept, n_stop_words, n_lines FROM v
"""
)
