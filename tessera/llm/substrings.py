"""Substring dedup by recompression.

Every window of 50 words that also starts in a document with a smaller doc_id
is a repeat, and each word that a repeat covers goes.

1. A copy of a whole text with a smaller doc_id is a repeat from end to end and
   reveals nothing else; only the first of equal texts is parsed.
2. Each text is parsed to high-level symbols (see recompression). Symbols that
   two documents share *reveal* where repeats may lie: a repeated window's core
   consists of shared symbols only. Most windows end here.
3. The other windows are dealt by their 128-bit names, made of their core's
   symbols and the words on either side of it, which *verifies* them: all but
   those of the least doc_id are repeats. A window without a core (4 % of
   prose, and long runs) is a symbol of its own in step 2.
4. The places of repeats go back to their texts. All steps share one exchange
   of the texts, by doc_id.

A name that many documents share is dealt to several groups, as many as its
first core symbol's documents call for. In a group all but the least doc_id are
repeats at once; only the least of each group meet in a second exchange.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import recompression as rc
from .common import sliced, table

#: Documents that share a symbol for each group of a window's name.
GROUP = 1000


def _columns(batch, docs_at: int, text_at: int):
    """Document ids (0 where null) with a mask of nulls, and the chunks of texts."""
    ids = batch.column(docs_at)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), rc.chunks(batch.column(text_at))


def _symbols(batches):
    import pyarrow as pa

    for batch in batches:
        ids, null, parts = _columns(batch, 0, 1)
        for row, data, offsets in parts:
            words = rc.Words(data, offsets)
            parsed = rc.parse(words)
            coreless = np.flatnonzero(parsed.lo >= parsed.hi)
            text = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(parsed.first)), words.text[parsed.starts[coreless]]])
            names = np.concatenate([parsed.names[0], rc.window_names(words, parsed, coreless)[0]])
            order = np.lexsort((names, text))
            names, text = names[order], text[order] + row
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
            new &= ~null[text]
            yield pa.RecordBatch.from_arrays([pa.array(names[new].view(np.int64)), pa.array(ids[text[new]])], ["symbol", "doc_id"])


def _among(known: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where names stand in the sorted array known, and whether they do."""
    if not len(known):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return at, known[at] == names


def _windows(batches):
    """Of (doc_id, tie, text, shared symbols, their documents): windows whose core symbols are all shared."""
    import pyarrow as pa

    for batch in batches:
        ids, null, parts = _columns(batch, 0, 2)
        ties = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column(3)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        symbols = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        counts = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        for row, data, offsets in parts:
            words = rc.Words(data, offsets)
            parsed = rc.parse(words)
            names, starts, lo, hi = parsed.names[0], parsed.starts, parsed.lo, parsed.hi
            if not len(starts):
                continue
            known, where = np.unique(symbols[at[row] : at[row + len(offsets) - 1]], return_index=True)
            docs = counts[at[row] : at[row + len(offsets) - 1]][where]
            found, shared = _among(known, names)
            unshared = np.concatenate([[0], np.cumsum(~shared)])
            keep = unshared[np.clip(lo, 0, len(names))] == unshared[np.clip(hi, 0, len(names))]
            coreless = np.flatnonzero(lo >= hi)
            at_own, keep[coreless] = _among(known, rc.window_names(words, parsed, coreless)[0])
            symbol = np.zeros(len(starts), np.int64)
            symbol[coreless] = at_own
            cored = lo < hi
            symbol[cored] = found[lo[cored]]
            text = words.text[starts] + row
            keep &= ~null[text]
            a, b = rc.window_names(words, parsed, np.flatnonzero(keep))
            starts, text, symbol = starts[keep], text[keep], symbol[keep]
            place = (ties[text] << 32) | (starts - words.first[text - row])
            # A window that a text holds again and again goes out once, with all its places.
            key = rc.mix(a + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rows = order[new]
            others = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32)), pa.array(place[order[~new]]), mask=pa.array(others == 0))
            doc = ids[text[rows]]
            groups = -(-docs[symbol[rows]] // GROUP)
            salt = np.where(groups > 1, rc.mix(doc.view(np.uint64) + np.uint64(1)) % groups.astype(np.uint64), 0).astype(np.int32) - (groups == 1)
            yield pa.RecordBatch.from_arrays([pa.array(a[rows].view(np.int64)), pa.array(b[rows].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(place[rows]), more], ["a", "b", "salt", "doc_id", "place", "more"])


def cover(n: int, places: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that begins at one of places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, np.minimum(places + rc.WINDOW, n), -1)
    return np.cumsum(step[:-1]) > 0


def repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) plus copy_ (the text is a copy of one with a smaller doc_id),
    tie_ (tells rows of one doc_id apart) and places (of other repeats): an array of tie_ << 32 | first word.

    Rows with a null doc_id have no smaller or larger id: they lose nothing and
    cost others nothing. Rows of one doc_id don't repeat each other.
    """
    narrow = docs.select("doc_id", F.md5("text").alias("md5_"))
    firsts = narrow.groupBy("md5_").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("md5_", "least")
    copies = narrow.join(firsts, "md5_").filter("doc_id > least").groupBy("doc_id").agg(F.collect_set("md5_").alias("copies_"))
    # The order is the text itself: an expression would be computed before the exchange and keep it from being shared.
    tied = docs.withColumn("tie_", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    is_copy = F.coalesce(F.array_contains("copies_", F.md5("text")), F.lit(False))
    tied = tied.join(copies, "doc_id", "left").withColumn("copy_", is_copy).drop("copies_")
    fresh = tied.select("doc_id", "tie_", F.when(~F.col("copy_"), F.col("text")).alias("text"))
    found = fresh.select("doc_id", "text").mapInArrow(_symbols, "symbol long, doc_id long")
    # A symbol comes once from each row of docs.
    shared = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    anchors = found.join(shared, "symbol").groupBy("doc_id").agg(F.collect_list(F.struct("symbol", "docs")).alias("anchors"))
    known = fresh.join(anchors, "doc_id", "left").select("doc_id", "tie_", "text", F.col("anchors.symbol").alias("symbols"), F.col("anchors.docs").alias("counts"))
    # salt is -1 for names that are dealt to one group.
    windows = known.mapInArrow(_windows, "a long, b long, salt int, doc_id long, place long, more array<long>")
    windows = windows.withColumn("least", F.min("doc_id").over(Window.partitionBy("a", "b", "salt").orderBy("doc_id")))
    # Sure repeats only pass the second exchange, each under a key of its own, so that windows are computed once.
    sure = F.col("doc_id") > F.col("least")
    found = windows.withColumn("sure", sure).filter("sure or salt >= 0")
    found = found.select(F.when(F.col("sure"), F.col("doc_id")).otherwise(F.col("a")).alias("k1"), F.when(F.col("sure"), F.col("place")).otherwise(F.col("b")).alias("k2"), "sure", "doc_id", "place", "more")
    hits = found.withColumn("least", F.min("doc_id").over(Window.partitionBy("k1", "k2").orderBy("doc_id"))).filter("sure or doc_id > least")
    return tied.join(hits.groupBy("doc_id").agg(F.concat(F.collect_list("place"), F.flatten(F.collect_list("more"))).alias("places")), "doc_id", "left")


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) plus n_words, n_removed, kept_text, kept_sha256.

    kept_text joins the words that stay by one space. A null text has no words;
    a text of fewer than 50 words loses none. An empty docs gives no rows.
    """
    own = docs.columns
    joined = repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).select(*[F.col(f"`{c}`") for c in own], "copy_", "tie_", "places")
    text_at = own.index("text")

    def kept(batches):
        import hashlib

        import pyarrow as pa

        for batch in sliced(batches):
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            n_words, n_removed, kept_text, digest = [], [], [], []
            for text, copy, tie, places in zip(texts, *(batch.column(len(own) + k).to_pylist() for k in (0, 1)), batch.column(len(own) + 2)):
                words = (text or b"").split()  # bytes split at the white space of the contract
                n = len(words)
                gone = 0
                if copy and n >= rc.WINDOW:
                    words, gone = [], n
                elif places.is_valid and not copy:
                    at = places.values.to_numpy(zero_copy_only=False)
                    mask = cover(n, at[at >> 32 == tie] & 0xFFFFFFFF)
                    gone = int(mask.sum())
                    words = [words[i] for i in np.flatnonzero(~mask)]
                joined = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                kept_text.append(joined)
                digest.append(hashlib.sha256(joined).hexdigest())
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *columns], [*own, "n_words", "n_removed", "kept_text", "kept_sha256"])

    from pyspark.sql import types as T

    schema = T.StructType([*joined.schema.fields[: len(own)], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(kept, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """What every document keeps."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
