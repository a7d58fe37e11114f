"""Toxicity, spelling variants and collocations against brute force and held-out accuracy."""
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from tessera.llm import phrases, spelling, toxicity
from tessera.llm.queries import QUERIES


def rows(spark, data, name):
    return [r.asDict() for r in QUERIES[name](spark, data[0]).collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(a, b):
    """Whether one insertion, deletion or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(counts, times=5):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    nears = defaultdict(list)
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            nears[a].append(b)
            nears[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(nears[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(nears[w]), counts[form[w]] if form[w] else None))
    return out


def test_op12(spark, data, docs_rows):
    counts = Counter()
    for d, t, *_ in docs_rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    got = rows(spark, data, "op12_spelling")
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == forms(counts)
    assert len(got) == len(counts) > 100


def test_spelling_of_few_letters(spark):
    """Words of two letters in every arrangement: repeated letters, chains of forms, ties, all at once."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randint(6, 9))) for _ in range(400)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaa", "aabaaa"}
    counts = {w: 5 * rng.choice([1, 1, 1, 6, 30, 200]) for w in sorted(words)}
    for k, n in (("aaaaaa", 7), ("aaaaaaa", 40), ("aaaaaaaa", 300), ("aaaaaaab", 1600)):
        counts[k] = n
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    # The checksum takes letters from runs of some documents: an id without such a run.
    doc = next(d for d in range(10_000) if not any(zlib.crc32(f"{d}:{w}".encode()) % 199 == 0 for w in counts))
    got = spelling.variants(spark.createDataFrame([(doc, text), (1, None)], "doc_id long, text string")).collect()
    want = forms(counts)
    assert {tuple(r) for r in got} == want
    assert any(f and r != f for _, f, r, *_ in want)


def collocations(docs, least, top, max_n=5):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, seen in f.items():
        known = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in known.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items()):
                continue
            score, k = min((1000 * a * total[lang] // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


@pytest.mark.parametrize("least, top", [(100, 2000), (4, 2000), (6, 7)])
def test_op13(spark, data, docs_rows, least, top):
    docs = spark.read.parquet(data[0] + "/documents.parquet")
    got = phrases.collocations(docs, least=least, top=top).collect()
    want = collocations([(la, t) for _, t, la, *_ in docs_rows], least, top)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_collocations_of_two_words(spark):
    """Overlaps, ties, white space and pieces; a sieve of one word, and a language as hot as the rest together."""
    docs = [("en", "a a a a a a"), ("en", "b\ta  a\x0bB A. a b, a b"), (None, "x y x y;x y"), ("und", "x\xa0y x y"), ("en", None), ("de", ""), ("en", "a b " * 200)]
    docs += [("hot", "p q r s t u v")] * 300
    got = phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), least=2, top=50).collect()
    assert {tuple(r) for r in got} == collocations(docs, 2, 50)


def test_op11(spark, data, docs_rows):
    got = rows(spark, data, "op11_toxicity")
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in docs_rows)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_on_unseen_texts(spark):
    """Insults, stems of insults and disguised ones, in texts that were not learned from."""
    rng = random.Random(8)
    plain = ["".join(rng.choice(["ta", "lo", "mi", "ner", "su", "ka"]) for _ in range(3)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(["Blorgh", "blorgh!", "zwick" + rng.choice(plain)])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "you Bl0rgh, you!")]
    table, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.scored(table, table.filter("doc_id % 5 != 0"), known.filter("doc_id % 5 != 0")).collect()}
    assert len(out) == len(docs)
    unseen = [(out[i]["predicted"], y) for i, y in labels if i % 5 == 0]
    assert sum(p == y for p, y in unseen) >= 0.97 * len(unseen)
    assert out[5000]["predicted"] == out[5001]["predicted"] == 0
    # Labels of one class, and none.
    for ones, want in ((known.filter("toxic = 1"), 1.0), (known.filter("toxic = 0"), 0.0), (known.limit(0), 0.0)):
        assert {r["score"] for r in toxicity.scored(table, table, ones).collect()} == {want}


def test_measures_of_a_text():
    lexicon = toxicity.Lexicon({(True, True): frozenset({"scum"}), (False, False): frozenset({"grob"})})
    m = lambda text: dict(zip(toxicity.FEATURES, toxicity.measured(text, lexicon.tagger())))
    a = m("You SCUM! grobian a b")
    assert (a["strong"], a["weak"], a["words_strong"], a["near_second"], a["second"]) == (1 / 5, 1 / 5, 1 / 5, 1 / 5, 1 / 5)
    assert a["capitals"] == 5 / 21 and a["shouted"] == 1 / 5 and a["marks"] == 1 / 21
    assert m("s.c.u.m")["strong"] == 0 and m("5cum sc*um")["disguised"] == 1 / 3
    assert m("s0ft sc@m sk1p")["disguised_hits"] == 0 and m("xx yy$um")["disguised"] == 1 / 3
    far = m("you a b c d e f scum")
    assert far["near_second"] == 0 and far["strong"] == 1 / 8
    assert set(m(None).values()) == {0.0}


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- a --!>", "<!-- a -->", "<!---->", "<!-- > -- -!> -->"])
def test_comments_end_as_html_ends_them(comment):
    from tessera.llm import html_text

    found = html_text.blocks(f"<article><p>one</p>{comment}<p>two</p></article>")
    assert [t for _, _, t, _ in found] == ["one", "two"]


def test_addresses_of_stores():
    from tessera.llm import warc

    assert warc.address("s3a://bucket/a") == "s3://bucket/a" and warc.address("dbfs:/x/y") == "file:///dbfs/x/y" and warc.address("file:///x") == "file:///x"
