"""Stages on the small corpus, each on what its predecessor left."""
from collections import Counter

import corpus_pipeline as cp
import pytest


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data[0]}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], data[0]).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == cp.COLUMNS


def test_rejected_languages_go(stages):
    ids = {r["doc_id"] for r in stages[1].collect()}
    assert not ids & {200, 201, 202, 206}
    assert ids >= set(range(120))


def test_one_of_each_group_stays(stages):
    ids = Counter(r["doc_id"] for r in stages[2].collect())
    assert max(n for d, n in ids.items() if d is not None) == 1
    assert 1 in ids and not ids.keys() & set(range(61, 100, 6)) and 207 not in ids


def test_repeats_go(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    changed = [d for d in after if after[d]["text"] != before[d]]
    assert len(changed) >= 5 and 0 not in changed


def test_mix_repeats_whole_documents(stages):
    before = Counter((r["doc_id"], r["text"]) for r in stages[3].collect())
    after = Counter((r["doc_id"], r["text"]) for r in stages[4].collect())
    assert after.keys() <= before.keys() and max(n for (d, _), n in after.items() if d is not None) <= 3


def test_all_copies_are_packed(stages):
    assert Counter(r["doc_id"] for r in stages[4].collect()) == Counter(r["doc_id"] for r in stages[5].filter("piece = 0").collect())


def test_empty(spark, data):
    assert cp.run(spark, data[1]).collect() == []


def test_near_dedup_links_by_jaccard(spark, data):
    """Every pair of 0.8 or more is linked, and nothing else: against all pairs, also in buckets that are dealt in tiles."""
    import random

    from tessera.llm import near

    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", " \n", "a b c d e f"]
    grams = [near.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not len(grams[i]) and not len(grams[j]) or len(grams[i]) and len(grams[j]) and near.similar(grams[i], grams[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {top(i) for i in range(len(texts))}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    tile, near.TILE = near.TILE, 10
    try:
        assert {r["doc_id"] for r in cp.near_dedup(spark, docs, data[0]).collect()} == want
    finally:
        near.TILE = tile


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_goes_by_fingerprints(spark, data):
    """A near copy goes if its fingerprint is within the radius, and only then."""
    from tessera.llm import near

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:k] + ["v"] + words[k + 1 :]) for k in range(0, 200, 10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert [r["doc_id"] for r in cp.near_dedup(spark, docs, data[0]).collect()] == [0]
    radius, near.RADIUS = near.RADIUS, 0
    try:
        assert cp.near_dedup(spark, docs, data[0]).count() == len(texts)
    finally:
        near.RADIUS = radius


def test_fingerprints_within_a_radius():
    """Bit planes give the pairs that a comparison one by one gives, and lose none of similar sets."""
    import numpy as np
    from tessera.llm import near, simhash

    rng = np.random.default_rng(4)
    for words, radius in ((1, 4), (2, 40), (4, near.RADIUS)):
        fps = rng.integers(0, 1 << 64, (20, words), np.uint64)[rng.integers(0, 20, 700)]
        fps ^= np.packbits(rng.random((700, 64 * words)) < rng.choice([0.01, 0.1, 0.3], (700, 1)), axis=1).view(np.uint64)
        until = np.repeat([1, 3, 67, 300, 700], [1, 2, 64, 233, 400])
        got = [(a, b) for i, j in simhash.within(until, fps, radius) for a, b in zip(i.tolist(), j.tolist())]
        want = [(i, j) for i in range(700) for j in range(i + 1, until[i]) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius]
        assert sorted(got) == want
    for n in (4, 8, 12, 40, 400, 3000):
        for _ in range(30):
            a = rng.integers(0, 1 << 64, n, np.uint64)
            b = np.concatenate([a, rng.integers(0, 1 << 64, n // 4, np.uint64)])
            x, y = (np.frombuffer(simhash.majority(s, near.WORDS), np.uint64) for s in (a, b))
            assert near.similar(np.sort(a), np.sort(b)) and np.bitwise_count(x ^ y).sum() <= near.RADIUS


def test_one_bucket_gives_a_pair():
    """A group of near copies shares many buckets, and few of them give a pair; none is lost. A forest grows as the group does."""
    import numpy as np
    import pyarrow as pa
    from tessera.llm import near, simhash

    rng = np.random.default_rng(7)

    def rows(n, forest):
        base = rng.integers(0, 1 << 64, 300, np.uint64)
        sets = [np.sort(np.concatenate([base[rng.random(300) < 0.95], rng.integers(0, 1 << 64, 10, np.uint64)])) for _ in range(n)]
        prefixes = [s[: len(s) - (4 * len(s) + 4) // 5 + 1].view(np.int64) for s in sets]
        of = {}
        for k, p in enumerate(prefixes):
            for t in p.tolist():
                of.setdefault(t, []).append(k)
        large = {t for t, m in of.items() if len(m) > near.SMALL}
        own = [sorted(large & set(p.tolist())) for p in prefixes]
        table = []
        for t in sorted(large):
            for k in sorted(of[t], key=lambda k: len(sets[k])):
                at, s = own[k].index(t), sets[k]
                back = [own[k][at - b] if at >= b else t for b in range(1, near.BACK + 1)]
                table.append((t, 0, 0, 0, k, len(s), near.parity(s) + bytes(near.BITS // 8), simhash.majority(s, near.WORDS), k, *back))
        names = ["token", "x", "y", "tile", "key", "size", "bits", "fp", "label", *(f"back_{b}" for b in range(1, near.BACK + 1))]
        batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in table])
        out = [tuple(r.values()) for b in near._large(forest, near.RADIUS)(iter([batch])) for r in b.to_pylist()]
        met = {(a, b) for m in (of[t] for t in large) for a in m for b in m if a < b}
        return out, {(a, b) for a, b in met if near.similar(sets[a], sets[b])}

    out, similar = rows(60, False)
    assert set(out) >= similar and len(similar) > 500
    assert len(out) <= 1.5 * len(set(out))
    out, _ = rows(60, True)
    twice, _ = rows(120, True)
    assert len(twice) <= 3 * len(out)


def test_memory_of_short_texts():
    """The features of a batch of short texts are no matrix of all its rows."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.llm import language

    texts = pa.array([f"word {i % 700} of a short text" for i in range(6000)])
    tracemalloc.start()
    try:
        at = [(row, len(x), x[[0, -1]].copy()) for row, x in language.features(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    assert [row for row, _, _ in at] == list(np.cumsum([0, *(n for _, n, _ in at)])[:-1]) and sum(n for _, n, _ in at) == 6000
    for row, n, ends in at[::7]:
        for k, x in zip((row, row + n - 1), ends):
            assert np.array_equal(x, next(language.features(texts.slice(k, 1)))[1][0])


def test_slices_hold_every_row_once():
    import pyarrow as pa

    from tessera.llm.common import sliced

    texts = ["x" * (i * 37 % 900) for i in range(2000)] + ["long " * 9000, None, ""]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for most in (1, 5000, 1 << 22):
        parts = list(sliced([whole.slice(0, 0), whole.slice(3, 1500), whole.slice(1503)], most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole.slice(3)]))
        assert most > 1 or all(p.num_rows == 1 for p in parts)
    assert max(p.nbytes for p in sliced([whole.slice(0, 2000)], 50_000)) < 100_000
