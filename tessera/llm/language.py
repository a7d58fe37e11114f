"""Language identification: the family first, then one-versus-one within it.

Features are hashed byte trigrams of the whole lower-cased text, non-letters of
ASCII taken as spaces; their square roots, scaled to length one. Linear support
vector machines (squared hinge) first tell families apart, one against one,
then the languages of the winning family. Spark computes the features of a
bounded sample, trains every machine in its own task and scores all texts in
Arrow batches; only the machines' weights pass through the driver.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, table
from .recompression import chunks

#: Hashed trigrams, and labelled rows of a language that are learned from (about: rows are taken by a hash of doc_id).
DIM = 4096
SAMPLE = 1000
#: Rows of a matrix of features: short texts would make one of all rows of a batch, 32 KB each.
ROWS = 256
#: Strength of the penalty, steps of the solver, and slope of the logistic that turns margins into scores.
PENALTY, STEPS, SLOPE = 1e-3, 200, 4.0
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "bg", "sr"],
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _letters() -> np.ndarray:
    keep = np.arange(256, dtype=np.uint32)
    for b in range(128):
        if not chr(b).isalpha():
            keep[b] = 32
    return keep


_KEEP = _letters()


def features(texts) -> "iter":
    """(first row, matrix of rows by DIM) of runs of rows of a pyarrow string array; a text without letters is a zero row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for row, data, offsets in chunks(pc.utf8_lower(texts.cast(pa.large_string())), rows=ROWS):
        m = len(offsets) - 1
        out = np.zeros((m, DIM), np.float32)
        if len(data) >= 3:
            b = _KEEP[data]
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            text = np.repeat(np.arange(m), np.diff(offsets))
            inside = (text[:-2] == text[2:]) & (code != 0x202020)
            bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)
            out = np.bincount(text[:-2][inside] * DIM + bucket[inside], minlength=m * DIM).reshape(m, DIM).astype(np.float32)
            np.sqrt(out, out)
            norm = np.sqrt((out * out).sum(1, keepdims=True))
            out /= np.where(norm == 0, 1, norm)
        yield row, out


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of a linear machine for labels 1 and -1, both classes with equal weight. x has a last column of ones."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = at = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (PENALTY + 4))
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ at))
        new = at - step * (PENALTY * at - 2 * (x.T @ (each * y * slack)))
        at = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def machines(sample: DataFrame, langs: list[str]) -> list[tuple[str, str, str, bytes]]:
    """(level, a, b, weights): level "" tells families apart, another one the languages of that family."""
    families = sorted({family_of(x) for x in langs})
    jobs = [("", a, b) for a, b in combinations(families, 2)]
    jobs += [(f, a, b) for f in families for a, b in combinations(sorted(x for x in langs if family_of(x) == f), 2)]
    if not jobs:
        return []

    def featured(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            names = batch.column(0).to_pylist()
            for row, x in features(batch.column(1)):
                half = x.astype(np.float16)
                out = [(j, lang, half[i].tobytes()) for i, lang in enumerate(names[row : row + len(x)]) for j, (level, a, b) in enumerate(jobs) if (lang if level else family_of(lang)) in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.string(), pa.binary()))], ["job", "lang", "x"])

    def fit(key, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        level, a, b = jobs[job := key[0].as_py()]
        # The order of rows would show in the last digits.
        order = pc.sort_indices(rows, sort_keys=[("lang", "ascending"), ("x", "ascending")]).to_numpy()
        names = np.array(rows.column("lang").to_pylist(), object)[order]
        # The only matrix of all rows: no copies of it, and none of the rows' bytes.
        x = np.ones((len(order), DIM + 1), np.float32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = 0
        for chunk in rows.column("x").chunks:
            for at in range(len(chunk)):
                x[place[row], :DIM] = np.frombuffer(chunk[at].as_buffer(), np.float16)
                row += 1
        y = np.where([(lang if level else family_of(lang)) == a for lang in names], 1, -1).astype(np.float32)
        return pa.table({"job": pa.array([job], pa.int32()), "w": pa.array([train(x, y).tobytes()], pa.binary())})

    found = sample.select("lang", "text").mapInArrow(featured, "job int, lang string, x binary").groupBy("job").applyInArrow(fit, "job int, w binary").collect()
    return [(*jobs[r["job"]], bytes(r["w"])) for r in sorted(found)]


def _winner(classes: list[str], pairs: dict, margins: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of every row: the class with most votes (then the largest margins), and its mean logistic score."""
    rows = len(next(iter(margins.values())))
    votes, score = np.zeros((rows, len(classes))), np.zeros((rows, len(classes)))
    for pair in pairs:
        p = 1 / (1 + np.exp(-SLOPE * margins[pair]))
        for c, s in ((pair[0], p), (pair[1], 1 - p)):
            votes[:, classes.index(c)] += s > 0.5
            score[:, classes.index(c)] += s
    score /= max(1, len(classes) - 1)
    best = np.argmax(votes + score, 1)
    return best, score[np.arange(rows), best]


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs (with a column text) plus lang_pred and score (0 to 1).

    labelled has doc_id, text and lang (rows without a lang are left out): what
    to learn from. A null text, one without a letter, and any text if nothing
    was learned is ``und`` with score 0; with one language learned all others
    are that language, score 1. Texts are judged whole.
    """
    from pyspark.sql import types as T

    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(counts)
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, SAMPLE / counts[k]))]), F.col("lang")) if langs else F.lit(0.0)
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    found = machines(sample, langs)
    families = sorted({family_of(x) for x in langs})
    columns = docs.columns
    text_at = columns.index("text")

    def judged(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        weights = np.stack([np.frombuffer(w, np.float32) for *_, w in found], 1) if found else None
        for batch in sliced(batches):
            texts = batch.column(text_at)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for row, x in features(texts) if langs else ():
                part = slice(row, row + len(x))
                if not found:
                    names[part], scores[part] = langs[0], 1.0
                    continue
                margin = x @ weights[:-1] + weights[-1]
                of = {(level, a, b): margin[:, i] for i, (level, a, b, _) in enumerate(found)}
                best, score = np.zeros(len(x), int), np.ones(len(x))
                if len(families) > 1:
                    pairs = [(a, b) for level, a, b in of if not level]
                    best, score = _winner(families, pairs, {p: of["", *p] for p in pairs})
                for k, family in enumerate(families):
                    rows = np.flatnonzero(best == k)
                    inside = [x for x in langs if family_of(x) == family]
                    names[row + rows], scores[row + rows] = inside[0], score[rows]
                    if len(inside) > 1 and len(rows):
                        pairs = list(combinations(inside, 2))
                        lang, s = _winner(inside, pairs, {p: of[family, *p][rows] for p in pairs})
                        names[row + rows], scores[row + rows] = np.array(inside, object)[lang], score[rows] * s
            names[~letters], scores[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], [*columns, "lang_pred", "score"])

    return docs.mapInArrow(judged, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op6(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
