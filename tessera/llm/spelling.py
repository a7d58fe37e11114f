"""Spelling variants: a symmetric-delete join of all words of a corpus, forms, and roots of forms.

Every word emits itself and its distinct single deletions as keys. Words that
share a key are compared exactly. A key has at most (length + 1) x alphabet
words, whatever the corpus: those that one letter more makes of it. So no key
is hot, and pairs grow with the number of near words.
"""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Every run whose checksum this divides loses a letter; least length and count of a word; times that a form is as frequent.
PLANT, LENGTH, LEAST, TIMES = 199, 6, 5, 5
#: What is no letter of a run, once A-Z are lower-cased.
OTHER = "[^a-zÀ-ÿ]+"


def _without(word: Column, i: Column) -> Column:
    """word without its code point i (from 1)."""
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): the words of LENGTH code points or more with ``least`` occurrences or more.

    docs has doc_id (null counts as an empty one) and text (null: no words),
    read whole. Runs of letters lose a letter by the checksum of
    ``<doc_id>:<run>``; rows that repeat count as often as they stand.
    """
    runs = F.split(F.translate("text", ascii_uppercase, ascii_lowercase), OTHER)
    d = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    d = d.filter(F.length("run") >= LENGTH).withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    cut = _without(F.col("run"), (F.col("h") % F.length("run") + 1).cast("int"))
    words = d.select(F.when(F.col("h") % PLANT == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb) of every two words (word, n; each once) at distance exactly one, once, a < b.

    Two such words share one key only: without their common start and end they
    are two letters, or one and none.
    """
    w = F.col("word")
    deletions = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: _without(w, i))
    keys = words.filter(F.length(w) > 0).select("word", "n", F.explode(F.array_distinct(F.concat(F.array(w), deletions))).alias("key"))
    one, other = keys.toDF("a", "na", "key"), keys.toDF("b", "nb", "key")
    return one.join(other, "key").filter((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "na", "nb")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word of links (word, form; each word once, no circles): where its forms end. Steps double from round to round."""
    out = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        last, out = out, written(out.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        dropped(last)
        if out.filter("moved").limit(1).count() == 0:
            return out.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs.

    A form is the near word of largest n (ties: the first in code-point order)
    if its n is ``times`` the word's or more, else null; a root is where forms
    end, the word itself if it has none. Counts grow along forms, so there are
    no circles. No texts, or none with a word frequent enough: no rows.
    """
    words = written(vocabulary(docs, least), "words")
    pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("x"))
    best = pairs.select("x.word", "x.near", "x.m").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= times * F.col("n"), -F.col("best.m")))
    found = written(found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    """The spelling variants of all words of documents."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE12 = r"""
WITH RECURSIVE k AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n,
    list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n))),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS m FROM d WHERE length(run) >= 6 GROUP BY ALL),
x AS (SELECT run, m, hex(encode(id || ':' || run)) AS s FROM r),
y AS (SELECT run, m, list_prepend(4294967295, list_transform(range(length(s) // 2), lambda i: (instr('0123456789ABCDEF', s[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', s[2 * i + 2]) - 1)) AS bytes FROM x),
h AS (SELECT run, m, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM y, k),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM h),
w AS (SELECT word, sum(m)::BIGINT AS n FROM f WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
e AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM e),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT w.word, v.word, v.n FROM w JOIN v ON v.cut = w.word UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.cut = w.word),
b AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1),
o AS (SELECT w.word, CASE WHEN b.m >= 5 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM o UNION ALL SELECT g.word, o.form FROM g JOIN o ON o.word = g.root WHERE o.form IS NOT NULL),
z AS (SELECT g.word, g.root FROM g JOIN o ON o.word = g.root WHERE o.form IS NULL)
SELECT o.word, o.form, z.root, o.n, o.n_near, o.form_n FROM o JOIN z USING (word)
"""
