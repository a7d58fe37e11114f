"""A small corpus with copies, shared passages, nulls, empty and long texts, ties and a clashing column."""
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string"
LABELS = "doc_id long, quality int, toxic int, text string, score double"
PAGES = "page_id long, url string, html string, text string"

STOPS = {"en": "the of and to in is".split(), "de": "der die und das ist ein".split(), "fr": "le la et les des est".split(), "es": "el los y que del una".split()}
PARTS = {"en": "th er on an re ha ing tion".split(), "de": "sch ein ver ung keit zu ß ä".split(), "fr": "eau oi ai aux ç é è elle".split(), "es": "ción os ar ñ ó ga do ll".split()}


def prose(rng, lang, n):
    word = lambda: "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(2, 4)))
    return " ".join(rng.choice(STOPS[lang]) if rng.random() < 0.3 else word() for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = rng.choice(list(STOPS))
        text = "\n".join(prose(rng, lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 6)))
        rows.append([i, text, lang, f"src{i % 7}" if i % 3 else "hot"])
    passage = prose(rng, "en", 70)
    for i in range(0, 60, 4):
        words = rows[i][1].split(" ")
        k = rng.randint(0, len(words))
        rows[i][1] = " ".join(words[:k] + [passage] + words[k:])
    for i in range(61, 100, 6):
        rows[i][1] = rows[1][1]
    for i in range(62, 100, 6):
        rows[i][1] = rows[2][1] + " " + prose(rng, "en", 1)
    rows += [
        [200, None, None, None], [201, "", "en", "hot"], [202, " \t\n ", "fr", ""], [203, "one", "en", None], [204, "ab cd ef", "en", "hot"],
        [205, "x " * 3000, "en", "hot"], [206, "*** %% $$ 123", None, "hot"], [207, rows[7][1], "en", "hot"], [207, rows[7][1], "en", "hot"],
        [208, rows[8][1].upper(), None, "hot"], [208, rows[9][1], None, "hot"], [209, prose(rng, "de", 4000), "de", "long"], [None, rows[10][1], "en", "hot"], [None, None, None, None],
        [210, "  two  spaces\there é 漢字 <|endoftext|> don't x ", "en", "hot"], [211, "a b " * 200 + passage, "en", "hot"], [212, "a b " * 150, "en", "hot"],
    ]
    return [(d, t, lang, s, len(t or ""), 0.5, "b") for d, t, lang, s in rows]


def site():
    rng = random.Random(6)
    rows = []
    for i in range(30):
        body = "".join(f"<p>{prose(rng, 'en', rng.randint(3, 40))}.</p>" for _ in range(rng.randint(1, 5)))
        rows.append([i, f"http://x.example/{i}", f"<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>{prose(rng, 'en', 4)}</h1>{body}</article><footer>&copy; x</footer></body></html>"])
    for i in range(10, 20, 3):
        rows[i][2] = rows[3][2]
    rows += [[100, None, None], [101, "http://x/\r\ny", ""], [102, "u", rows[5][2]], [102, "u", rows[5][2]], [None, "n", rows[6][2]], [103, "u", "<p>é &amp; ü &lt;" + "x" * 50_000], [104, "u", "<div"], [105, "u", "plain"]]
    return [(p, u, h, "clash") for p, u, h in rows]


def judged():
    """Labels of every other document, some twice, null or of no document."""
    rows = [(i, 1, int(i % 10 == 0), "clash", 0.5) for i in range(0, 130, 2)]
    return [*rows, (4, 1, 1, "clash", 0.5), (6, 1, None, None, None), (None, 0, 1, None, None), (999, 0, 1, None, None), (200, 0, 0, None, None), (205, 0, 1, None, None)]


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def pages_rows():
    return site()


@pytest.fixture(scope="session")
def data(spark, tmp_path_factory):
    """A folder with documents, pages and labels, and one with empty tables."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for rows, schema, name in ((corpus(), DOCS, "documents"), (site(), PAGES, "pages"), (judged(), LABELS, "labels")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)
