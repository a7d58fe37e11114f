"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64-bit majorities of shingle hashes. Equal ones are one. Two
that differ in at most RADIUS bits agree in at least two of BLOCKS = RADIUS + 2
blocks of bits, so each goes to a bucket for every two blocks, and no pair is
missed. A bucket's members lie in bit planes, 64 lanes to a word: one pass over
the planes counts 64 distances at a time in carry-save bitwise counters, and a
word whose lanes have all passed the radius is abandoned. A bucket gives a
spanning forest of its links, never all its pairs.

Buckets of more than TILE members are compared tile by tile, every pair of
tiles in its own group, so that no task holds more than two tiles of a bucket.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = RADIUS + 2
TILE = 4096
#: Words of 64 lanes compared at once, and looks for words to abandon.
CHUNK, LOOKS = 1 << 14, 8


def simhash(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The fingerprint of a text, 8 bytes, highest bit first."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return bytes(8)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = b"".join([digest(join(g), SEED) for g in grams])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every row of docs (doc_id, text). A null text has no words: 0."""

    def of(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = b"".join([simhash(t.as_py() or b"") for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, fp long")


def bucket_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """An array of longs: for every choice of blocks - radius blocks, their number and their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (least member known) after linking members i and j."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def majority(hashes: np.ndarray, words: int = 1) -> bytes:
    """The fingerprint of a set of 64-bit hashes, 64 * words bits: the first word is that of the hashes, each other that of another mix of them."""
    all_ = np.empty((len(hashes), words), np.uint64)
    for k in range(words):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        if k:  # splitmix64
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        all_[:, k] = x
    bits = np.unpackbits(all_.view(np.uint8), axis=1)
    ones = np.zeros(64 * words, np.int64)
    for start in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        ones += bits[start : start + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def within(until: np.ndarray, fps: np.ndarray, radius: int):
    """Pairs i < j of members whose fingerprints (a row of 64-bit words each) differ in at most ``radius`` bits, as arrays, in order of i.

    Members of a bucket lie one after another; i meets those up to ``until[i]``.
    64 members are the lanes of a word in every bit plane, and a word's distances
    are counted at once, in carry-save bitwise counters.
    """
    if not len(fps):
        return
    fps = fps.reshape(len(fps), -1)
    width, depth = 64 * fps.shape[1], max(1, radius.bit_length())
    lanes = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 64, width // 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0].T.copy()
    # A member meets its own word of lanes and the later ones of its bucket.
    block = np.arange(len(fps)) // 64
    meets = (until - 1) // 64 - block + 1
    ends = np.cumsum(meets)
    row = 0
    while row < len(fps):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + CHUNK, "right")))
        member = np.repeat(np.arange(row, end), meets[row:end])
        at = block[member] + np.arange(len(member)) - np.repeat(np.cumsum(meets[row:end]) - meets[row:end], meets[row:end])
        row = end
        own = fps[member].T.copy()
        over = np.zeros(len(at), np.uint64)
        counter, waiting = [over] * depth, [None] * depth
        for bit in range(width):
            x = planes[bit][at] ^ (np.uint64(0) - ((own[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)))
            # Two bits of a level are added to its counter at once, and carry one to the next.
            for level in range(depth):
                if waiting[level] is None:
                    waiting[level] = x
                    break
                y, waiting[level], c = waiting[level], None, counter[level]
                t = c ^ x
                counter[level], x = t ^ y, (c & x) | (t & y)
            else:
                over = over | x
            if (bit + 1) % (width // LOOKS) == 0 and (bit >= radius or bit + 1 == width):
                for level in range(depth):
                    if waiting[level] is not None:
                        x, waiting[level] = waiting[level], None
                        for k in range(level, depth):
                            counter[k], x = counter[k] ^ x, counter[k] & x
                        over = over | x
                near = ~(over | _above(counter, radius))
                alive = near != 0
                if not alive.all():
                    member, at, over, near, own = member[alive], at[alive], over[alive], near[alive], own[:, alive]
                    counter = [c[alive] for c in counter]
        hit, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(near).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = member[hit], 64 * at[hit] + lane
        good = (i < j) & (j < until[i])
        yield i[good], j[good]


def link(sizes: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For members of buckets (``sizes`` of each, members one after another): the least
    member index that each is linked with, through any chain in its bucket."""
    label = np.arange(len(fps))
    for i, j in within(np.repeat(np.cumsum(sizes), sizes), fps, radius):
        label = _hook(label, i, j)
    return label


def _above(counter: list[np.ndarray], radius: int):
    """Lanes whose counter (its bits, lowest first) is above radius."""
    out = np.zeros_like(counter[0])
    equal = ~out
    for bit in reversed(range(len(counter))):
        if radius >> bit & 1:
            equal = equal & counter[bit]
        else:
            out, equal = out | (equal & counter[bit]), equal & ~counter[bit]
    return out


def _forests(batches):
    """(key, a, b, fp) sorted by bucket -> (fp, root) of every member linked with a smaller one."""
    import pyarrow as pa

    def done(keys, fps):
        new = np.ones(len(fps), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        sizes = np.diff(np.append(np.flatnonzero(new), len(fps)))
        several = np.repeat(sizes > 1, sizes)
        fps, sizes = fps[several], sizes[sizes > 1]
        label = link(sizes, fps.view(np.uint64)) if len(fps) else np.empty(0, np.int64)
        far = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[far]), pa.array(fps[label[far]])], ["fp", "root"])

    keys, fps = np.empty((0, 3), np.int64), np.empty(0, np.int64)
    for b in batches:
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, b.column(3).to_numpy(zero_copy_only=False)])
        # The last bucket may go on in the next batch.
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        if len(change):
            end = change[-1] + 1
            yield done(keys[:end], fps[:end])
            keys, fps = keys[end:], fps[end:]
    if len(fps):
        yield done(keys, fps)


def links(distinct: DataFrame) -> DataFrame:
    """(fp, root): links between distinct fingerprints that connect what any links connect."""
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").count().filter(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    dealt = keyed.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b", "fp").mapInArrow(_forests, "fp long, root long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text).

    component_id is the least doc_id that links reach. Texts without words all
    have fingerprint zero and link like others. A null doc_id takes part in
    links and is never the least, unless a component has no other: null then.
    """
    found = written(fingerprints(docs), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    of = distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(of.join(least, "root").select("fp", "component_id"), "fp")


def op3(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    g = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
