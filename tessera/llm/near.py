"""Near-duplicates by SimHash and bit-sliced comparison, with an exact check: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

A set's fingerprint has WORDS * 64 bits, each a majority over its shingles as
op3's. Op3's buckets hold pairs of up to four different bits, and a Jaccard of
0.8 means up to a fifth of them; so buckets come from a prefix join: of two
sets with such a Jaccard, the least fifth of the one (by hash) and that of the
other share a shingle, so no pair is missed. In a bucket, which holds the sets
with one such shingle, fingerprints are compared bit plane by bit plane with
carry-save counters, as op3's (``simhash.within``); pairs over RADIUS bits are
out. A Jaccard of 0.8 makes a bit differ with a chance of at most 0.19, so that
it passes a pair by with one under 1e-14.

Pairs must also agree in size and in parity bits (BITS counts of shingles
modulo 2: two sets differ in at least as many shingles as they differ in bits).
Sets of over LONG shingles would fill those bits; they also have those of a
sample of 256 to 512 shingles, and of half of it, and a pair may differ in as
many as eight standard deviations more than a pair of 0.8 does on average (a
chance under 1e-14 to pass one by). Those that are left are compared by two
bits a shingle, then shingle by shingle on the whole texts.

A bucket of up to SMALL sets gives all its pairs. A larger one gives a spanning
forest of its candidates, the likest first, and after their check every pair
whose sets are still in different components. Only sets of components between
which the check has cut a candidate go on to that. A pair that shares many shingles is given
by the bucket of the least of them (a few times at most): the bucket of another
sees, by the sets' BACK shingles before it, that they share a lesser one.
Buckets of more than TILE sets are compared tile by tile.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, sliced, written
from .components import components
from .simhash import majority, within

SHINGLE = 5
SEED = 42
#: Parity bits of a set in a bucket; sets of more than half as many shingles also have a longer sketch, and sets of LONG shingles a sample's bits.
BITS, LONG = 1024, 1600
SMALL, TILE = 16, 4096
#: Words of a fingerprint, and most bits in which those of two similar sets differ.
WORDS, RADIUS = 4, 104
#: Shingles of a set before one that tell of other buckets.
BACK = 4
#: Pairs looked at, and pairs hung on a forest, at once.
LOOK, HANG = 1 << 13, 1 << 17
#: Sets held for comparison in a task.
HELD = 256


def shingles(text: bytes) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once. A shorter text is one shingle; one without words has none."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(g), SEED) for g in grams], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard of two sets is 0.8 or more, counted in integers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parity(s: np.ndarray, bits: int = BITS) -> bytes:
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def level(n):
    """How often a long set's sample is halved."""
    return np.floor(np.log2(np.maximum(n, 256) / 256)).astype(np.int64)


def sampled(s: np.ndarray) -> bytes:
    """Parity bits of a sample of a long set and of half that sample. It goes by bits of the hashes that neither the prefix nor the parity goes by."""
    at = int(level(len(s)))
    middle = s >> np.uint64(20)
    return b"".join(parity(s[middle & np.uint64((1 << k) - 1) == 0], BITS // 2) for k in (at, at + 1))


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits of a smaller modulus, both powers of two."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, digest (md5 of the text), key (of the set), size, bits, fp, sketch (of long sets, else null), prefix for every row of docs (doc_id, text)."""

    def of(batches):
        import pyarrow as pa
        import xxhash

        for b in sliced(batches):
            keys, sizes, bits, fps, sketches, prefixes = [], [], [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                s = shingles(t.as_py() or b"")
                keys.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                bits.append(parity(s) + (sampled(s) if len(s) >= LONG else bytes(BITS // 8)))
                fps.append(majority(s, WORDS))
                sketches.append(parity(s, 2 << (len(s) - 1).bit_length()) if 2 * len(s) > BITS else None)
                prefixes.append(s[: len(s) - (4 * len(s) + 4) // 5 + 1].tobytes())
            columns = [b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(fps, pa.binary()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "key", "size", "bits", "fp", "sketch", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    return rows.mapInArrow(of, "doc_id long, digest string, key long, size int, bits binary, fp binary, sketch binary, prefix binary")


def _spread(batches):
    """(key, prefix) -> (token, key)."""
    import pyarrow as pa

    for b in batches:
        prefixes = b.column(1).to_pylist()
        if prefixes:
            keys = np.repeat(b.column(0).to_numpy(), [len(p) // 8 for p in prefixes])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), np.int64)), pa.array(keys)], ["token", "key"])


def _whole(batches, columns: int):
    """Batches of rows sorted by their first ``columns`` columns -> tables that cut no group of them."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)], 1)
        if held and tuple(k[0]) != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = tuple(k[-1])
        change = np.flatnonzero((k[1:] != k[:-1]).any(1))
        if len(change):
            end = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, end)]).combine_chunks()
            held, b = [], b.slice(end)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _shared(batches):
    """(token, key) sorted -> (token, key, n) of the tokens that n > 1 sets have."""
    import pyarrow as pa

    for t in _whole(batches, 1):
        token, key = t.column(0).to_numpy(), t.column(1).to_numpy()
        sizes = np.diff(_runs(token))
        n = np.repeat(sizes, sizes)
        kept = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(token[kept]), pa.array(key[kept]), pa.array(n[kept].astype(np.int64))], ["token", "key", "n"])


def _apart(x, y) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _slack(size, bits, i, j) -> np.ndarray:
    """How far pairs of sets are from bits that rule out a Jaccard of 0.8, by their size; negative: they do."""
    a, b, x, y = size[i], size[j], bits[i], bits[j]
    fits = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    half, la, lb = BITS // 128, level(a), level(b)
    exact, one, two = slice(0, 2 * half), slice(2 * half, 3 * half), slice(3 * half, 4 * half)
    # Sizes that fit are at most one level apart: the half of the one is as small a sample as the whole of the other.
    apart = np.where(la == lb, _apart(x[..., one], y[..., one]), np.where(la < lb, _apart(x[..., two], y[..., one]), _apart(x[..., one], y[..., two])))
    mean = (a + b) / 9 / 2.0 ** np.maximum(la, lb)
    rough = (mean + 8 * np.sqrt(mean) + 8 - apart) / (9 * mean)
    return np.where(fits, np.where((a >= LONG) & (b >= LONG), rough, (a + b - 9 * _apart(x[..., exact], y[..., exact])) / (a + b)), -1)


def _columns(t, at: int):
    key, size = t.column(at).to_numpy(), t.column(at + 1).to_numpy().astype(np.int64)
    bits, fps = (np.frombuffer(b"".join(t.column(at + i).to_pylist()), np.uint64).reshape(len(key), -1) for i in (2, 3))
    return key, size, bits, fps


def _pairs(key, i, j):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], ["a", "b"])


def _candidates(size, bits, fps, until, radius: int, open_):
    """Arrays (i, j, slack) of pairs of a bucket that agree in fingerprints, in what ``open_`` of (i, j) says, and in parity bits."""
    for i, j in within(until, fps, radius):
        for start in range(0, len(i), LOOK):
            x, y = i[start : start + LOOK], j[start : start + LOOK]
            good = open_(x, y)
            x, y = x[good], y[good]
            slack = _slack(size, bits, x, y)
            good = slack >= 0
            if good.any():
                yield x[good], y[good], slack[good]


def _small(radius: int):
    """(token, key, size, bits, fp) of buckets of up to SMALL sets, sorted -> all candidates (a, b)."""

    def of(batches):
        for t in _whole(batches, 1):
            key, size, bits, fps = _columns(t, 1)
            edges = _runs(t.column(0).to_numpy())
            for i, j, _ in _candidates(size, bits, fps, np.repeat(edges[1:], np.diff(edges)), radius, lambda i, j: np.ones(len(i), bool)):
                yield _pairs(key, i, j)

    return of


def _hang(up: np.ndarray, i, j, slack):
    """Hang the pairs' members on a forest, the likest first. The forest, flat, and the pairs that joined two of its trees."""

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    joined = []
    for k in np.argsort(-slack, kind="stable"):
        a, b = top(i[k]), top(j[k])
        if a != b:
            up[max(a, b)] = min(a, b)
            joined.append(k)
    while not np.array_equal(up, above := up[up]):
        up = above
    return up, i[joined], j[joined]


def _large(forest: bool, radius: int):
    """(token, x, y, tile, key, size, bits, fp, label, BACK lesser tokens), sorted -> candidates of each bucket between sets of different labels: a spanning forest, or all."""

    def of(batches):
        for t in _whole(batches, 3):
            token, x, y, tile = (t.column(k).to_numpy().astype(np.int64) for k in range(4))
            key, size, bits, fps = _columns(t, 4)
            label, back = t.column(8).to_numpy(), np.stack([t.column(9 + k).to_numpy() for k in range(BACK)], 1)
            edges = _runs(token, x, y)
            bucket = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            # In order of size, those that a set can be similar to follow it at once.
            until = np.concatenate([a + np.searchsorted(4 * size[a:b], 5 * size[a:b], "right") for a, b in zip(edges, edges[1:])])
            # The first member of each label in a bucket.
            order = np.lexsort((np.arange(len(label)), label, bucket))
            runs = _runs(bucket[order], label[order])
            up = np.empty(len(label), np.int64)
            up[order] = np.repeat(order[runs[:-1]], np.diff(runs))
            held = []

            def open_(i, j):
                good = (up[i] != up[j]) & ((x[i] == y[i]) | (tile[i] != tile[j]))
                at = np.flatnonzero(good)
                p, q = back[i[at]], back[j[at]]
                # Tokens of none before are the bucket's own.
                both = (p[:, :, None] == q[:, None, :]) & (p != token[i[at]][:, None])[:, :, None]
                good[at] = ~both.any((1, 2))
                return good

            for i, j, slack in _candidates(size, bits, fps, until, radius, open_):
                if not forest:
                    yield _pairs(key, i, j)
                    continue
                held.append((i, j, slack))
                if sum(len(h[0]) for h in held) >= HANG:
                    up, i, j = _hang(up, *map(np.concatenate, zip(*held)))
                    held = []
                    yield _pairs(key, i, j)
            if held:
                up, i, j = _hang(up, *map(np.concatenate, zip(*held)))
                yield _pairs(key, i, j)

    return of


def _close(batches):
    """(a, b, size_a, size_b, sketch_a, sketch_b) -> (a, b) that agree in their sketches too."""
    import pyarrow as pa

    for b in sliced(batches):
        kept = []
        for m, n, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
            if x is None or y is None:
                kept.append(True)
                continue
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            least = min(len(x), len(y))
            kept.append(9 * int(np.bitwise_count(fold(x, least) ^ fold(y, least)).sum(dtype=np.int64)) <= m + n)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(kept, pa.bool_())) for i in (0, 1)], ["a", "b"])


def _verified(batches):
    """(a, b, text_a, text_b) -> (a, b) of the similar ones."""
    import pyarrow as pa

    known = lru_cache(HELD)(shingles)
    for b in sliced(batches):
        ends = zip(*(b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)))
        good = np.array([similar(known(x or b""), known(y or b"")) for x, y in ends], bool)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest (md5 of the text), component for every row of docs (doc_id, text).

    Rows of one component are linked by a chain of pairs with a Jaccard of 0.8
    or more. Texts without words are all alike; a null text is one of them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(sets(docs), "sets")
    tokens = found.select("key", "prefix").dropDuplicates(["key"]).mapInArrow(_spread, "token long, key long")
    shared = tokens.repartition(parts, "token").sortWithinPartitions("token", "key").mapInArrow(_shared, "token long, key long, n long")
    facts = found.select("key", "size", "bits", "fp").dropDuplicates(["key"])
    lesser = Window.partitionBy("key", F.col("n") > SMALL).orderBy("token")
    back = {f"back_{k}": F.lag("token", k).over(lesser) for k in range(1, BACK + 1)}
    shared = shared.repartition(parts, "key").withColumns(back).withColumns({k: F.when(F.col("n") > SMALL, F.coalesce(k, "token")) for k in back})
    shared = written(shared.join(facts, "key"), "buckets")
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = written(found.filter("sketch is not null").select("key", "size", "sketch").dropDuplicates(["key"]), "sketches")
    known = written(found.select("doc_id", "digest", "key"), "keys")
    dropped(found)
    digests = known.groupBy("key").agg(F.min("digest").alias("digest"))

    def check(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = written(candidates.distinct(), "candidates")
        both = pairs
        for end in ("a", "b"):
            both = both.join(sketches.toDF(end, f"size_{end}", f"sketch_{end}"), end, "left")
        close = written(both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_close, "a long, b long"), "close")
        # Written, so that its size is known: a few texts are fetched without an exchange of all.
        need = written(close.select(F.col("a").alias("key")).unionAll(close.select("b")).distinct().join(digests, "key"), "need")
        of = written(texts.join(need.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).join(need, "digest").select("key", "text"), "texts")
        ends = close.join(of.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(of.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        links = written(ends.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), "links")
        dropped(close, need, of)
        return pairs, links

    def label(of: str):
        return roots.select(F.col("u").alias(of), F.col("v").alias(f"label_{of}"))

    small = shared.filter(F.col("n") <= SMALL).select("token", "key", "size", "bits", "fp")
    pairs, links = check(small.repartition(parts, "token").sortWithinPartitions("token", "key").mapInArrow(_small(RADIUS), "a long, b long"))
    roots = written(components(links), "roots")
    dropped(pairs, links)
    large = shared.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        tiles = F.ceil(F.col("n") / TILE).cast("int")
        large = large.withColumn("tile", F.pmod(F.xxhash64("key"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        large = large.select("token", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "key", "size", "bits", "fp", *back)

        def candidates(rows: DataFrame, forest: bool) -> DataFrame:
            dealt = rows.select(*large.columns[:8], "label", *back).repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "size", "key")
            return dealt.mapInArrow(_large(forest, RADIUS), "a long, b long")

        def labelled() -> DataFrame:
            return large.join(label("key"), "key", "left").withColumn("label", F.coalesce("label_key", "key"))

        def merged(links: DataFrame) -> DataFrame:
            return written(components(roots.unionAll(links)), "roots")

        pairs, links = check(candidates(labelled(), True))
        before, roots = roots, merged(links)
        ends = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a != b")
        cut = written(ends.select(F.col("a").alias("label")).unionAll(ends.select("b")).distinct(), "cut")
        dropped(before, pairs, links)
        if not cut.isEmpty():
            pairs, links = check(candidates(labelled().join(cut, "label", "left_semi"), False))
            before, roots = roots, merged(links)
            dropped(before, pairs, links)
        dropped(cut)
    of = written(known.join(roots.select(F.col("u").alias("key"), "v"), "key", "left").select("doc_id", "digest", F.coalesce("v", "key").alias("component")), "groups")
    dropped(shared, sketches, known, roots)
    return of
