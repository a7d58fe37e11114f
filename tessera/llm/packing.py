"""Best-fit packing of documents into fixed-size sequences with vector capacities.

A sequence (bin) has three capacities: tokens, documents and attention cost
(the sum of squared piece lengths). A piece goes to the open bin that can hold
it under all three and is left with the least weighted norm of its residuals
("norm"), or that has the largest weighted dot-product of residual and demand
("dot"); with no such bin it opens one. Pieces come longest first.

Documents longer than a sequence are cut into whole sequences behind a first
remainder. Whole sequences need no bin; every document leaves one partial
piece at most, so ``rows / GROUP`` groups of hashed documents, a partition
each, bound the work of a task, and each group wastes part of one sequence only.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, table

SEQUENCE = 2048
GROUP = 4096
END = 0
#: Token, document-count and attention-cost capacities of a sequence. The first two bind; one piece of 2047 tokens already needs nearly all of the third, which so steers the choice only.
CAPS = (SEQUENCE, 256, SEQUENCE * SEQUENCE)
WEIGHTS = (1.0, 1.0, 1.0)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space on which the ranks' pattern would recurse too deeply.
LONG_SPACE = re.compile(r"\s{1000}")


def encoder(tokenizer: str, ranks: str, pattern: str):
    """text -> its token ids by the tokenizer file with add_special_tokens=False.

    ranks is the same vocabulary as base64 tokens and ranks, which give equal
    ids several times faster; texts that hold one of the tokenizer's added
    tokens or very long white space go to the tokenizer itself.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=of, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or LONG_SPACE.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def cut(tokens: bytes, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the first piece may be shorter."""
    n = len(tokens) // 4
    ends = list(range(n % sequence or min(n, sequence), n + 1, sequence))
    starts = [0, *ends[:-1]]
    return [(k, a, b - a, zlib.crc32(tokens[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, ends))]


def best_fit(lengths: np.ndarray, caps=CAPS, weights=WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece. caps: tokens, pieces, sum of squared lengths of a bin.

    Every piece must fit an empty bin. Order of equal pieces is kept, so the
    result is a function of the input alone.
    """
    cap = np.asarray(caps, float)
    weight = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    left = np.empty((3, 1024))
    names = np.empty(1024, np.int64)
    used = opened = 0
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    for i in order:
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        now = left[:, :used]
        fits = np.flatnonzero((now[0] >= need[0]) & (now[1] >= need[1]) & (now[2] >= need[2]))
        if len(fits):
            rest = (now[:, fits] - need[:, None]) / cap[:, None]
            if by == "norm":
                at = fits[np.argmin(weight @ (rest * rest))]
            else:
                at = fits[np.argmax((weight * need / cap) @ (now[:, fits] / cap[:, None]))]
        else:
            if used == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], 1)
                names = np.concatenate([names, np.empty_like(names)])
            at = used
            left[:, at], names[at] = cap, opened
            used, opened = used + 1, opened + 1
        bins[i], offsets[i] = names[at], int(cap[0] - left[0, at])
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1:  # full: the last open bin takes its place
            used -= 1
            left[:, at], names[at] = left[:, used], names[used]
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    docs needs doc_id and text. A null text is empty: its one token ends the
    document. Repeated rows and null ids are packed row by row; an empty docs
    gives no rows. tokenizer and ranks are files of one byte-level vocabulary,
    by default byte_bpe_50k.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def tokenized(batches):
        import pyarrow as pa

        encode = encoder(tokenizer, ranks, pattern)
        at = 0  # tells rows of one doc_id and text apart, so that many of them are dealt to many groups
        for b in sliced(batches):
            rows = [(d, *p, at + i) for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for p in cut(np.array([*(encode(t) if t else ()), END], "<u4").tobytes())]
            at += b.num_rows
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "at"])

    def packed(batches):
        import pyarrow as pa

        batches = list(batches)  # of one group, some GROUP partial pieces of a few numbers each, and whole ones
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("group_", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        of, lengths = table.column("group_").to_numpy(), table.column("length").to_numpy()
        ids, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for g in np.unique(of):
            own = np.flatnonzero(of == g)
            whole = lengths[own] == SEQUENCE
            bins, offsets = best_fit(lengths[own[~whole]])
            ids[own[~whole]], places[own[~whole]] = bins, offsets
            ids[own[whole]] = bins.max(initial=-1) + 1 + np.arange(whole.sum())
            ids[own] += int(g) << 32
        out = table.drop(["group_"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(places))
        yield from out.to_batches(max_chunksize=10_000)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, -(-docs.count() // GROUP))
    pieces = docs.mapInArrow(tokenized, PIECES + ", at long")
    group = F.pmod(F.xxhash64("doc_id", "ids_crc32", F.when(F.col("doc_id").isNull(), F.col("at"))), F.lit(groups)).cast("int")
    # A document's whole pieces may lie in any group: they take no part in the packing.
    dealt = pieces.select(group.alias("group_"), "doc_id", "piece", "start", "length", "ids_crc32").repartitionById(groups, F.col("group_"))
    return dealt.mapInArrow(packed, PIECES + ", sequence_id long, offset long")


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
