"""Documents, quads and frames in; golden rows out. Documents go through the operators together, as they would in a table."""
import json
import re

import pytest
from pyspark.sql import functions as F
from tessera.functions import iri
from tessera.functions import literals as lit
from tessera.operators import canon, compact, frame, graph, rdf
from tessera.operators.expand import expand
from tessera.sources import nquads

EX = "http://example.org/"

DOCS = {
    0: {"@context": {"name": "http://xmlns.com/foaf/0.1/name"}, "name": "Alice"},
    1: {"@context": {"@vocab": EX}, "@id": "alice", "knows": {"@id": EX + "bob", "age": 3}},
    2: {"@context": {"@vocab": EX, "ex": EX, "l": {"@container": "@list"}, "d": {"@container": "@language"}, "i": {"@container": "@index"}, "j": {"@type": "@json"}, "t": {"@type": "ex:date"}, "r": {"@reverse": "ex:parent"}, "n": None}, "@id": "ex:a", "@type": ["A", "B"], "l": [1, "x", {"@id": "ex:z"}], "d": {"en": ["Hi", "Ho"], "@none": "?"}, "i": {"k": "v"}, "j": {"b": 1, "a": [True, None]}, "t": "2024", "r": {"@id": "ex:child"}, "n": 1, "unknown:x": 1.5, "e": {"@list": []}, "w": 1.0, "big": 1e19, "ok": False},
    3: {"@context": [{"@vocab": "http://one/"}, {"@vocab": "http://two/", "@language": "EN"}], "@graph": [{"@id": "http://g/1", "p": "x"}, {"@id": "http://g/2", "p": {"@value": "y", "@language": "fr"}}]},
    4: {"@context": {"@vocab": EX}, "@id": EX + "g", "@graph": [{"@id": EX + "s", "p": "in graph"}], "about": "a graph"},
    5: "https://example.com/none.jsonld",
    6: {"@context": "https://example.com/ctx.jsonld", "name": "Ada"},
    7: {"@context": "https://example.com/missing.jsonld", "name": "Ada"},
    8: {"@context": {"@vocab": EX}, "p": {"@value": "x", "@type": "t", "@language": "en"}},
    9: {"@context": {"@vocab": EX, "@language": 3}, "p": 1},
    10: {"@context": {"a": {"@id": EX + "a", "@type": "_:b"}}, "a": 1},
    11: {"@context": {"@vocab": EX}, "p": {"@id": 5, "q": 1}},
}


@pytest.fixture(scope="module")
def expanded(spark):
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in DOCS.items()] + [(12, None), (13, "{")], "doc_id long, doc string")
    remote = spark.createDataFrame([("https://example.com/ctx.jsonld", '{"@context":{"name":"http://schema.org/name"}}')], "url string, document string")
    e = expand(docs, remote=remote, base=EX)
    return e.statements.cache(), {r["doc_id"]: r["code"] for r in e.errors.collect()}, e.tree


def of(expanded, doc):
    return {(r["g"], r["s"], r["p"], r["o"], r["datatype"], r["language"], r["pos"]) for r in expanded[0].filter(F.col("doc_id") == doc).collect()}


def test_errors(expanded):
    assert expanded[1] == {7: "loading remote context failed", 8: "invalid value object", 9: "invalid default language", 10: "invalid type mapping", 11: "invalid @id value", 12: "loading document failed", 13: "loading document failed"}


def test_term_and_remote_context(expanded):
    assert {x[2:4] for x in of(expanded, 0)} == {("http://xmlns.com/foaf/0.1/name", "Alice")}
    assert {x[2:4] for x in of(expanded, 6)} == {("http://schema.org/name", "Ada")}


def test_nested_node_and_base(expanded):
    assert of(expanded, 1) == {(None, EX + "alice", EX + "knows", EX + "bob", None, None, None), (None, EX + "bob", EX + "age", "3", lit.INTEGER, None, None)}


def test_containers_and_values(expanded):
    a = EX + "a"
    got = of(expanded, 2)
    assert {(x[3], x[6]) for x in got if x[2] == EX + "l"} == {("1", 0), ("x", 1), (EX + "z", 2)}
    assert {(x[3], x[5]) for x in got if x[2] == EX + "d"} == {("Hi", "en"), ("Ho", "en"), ("?", None)}
    assert {x[3] for x in got if x[2] == "@type"} == {EX + "A", EX + "B"}
    assert (None, EX + "child", EX + "parent", a, None, None, None) in got
    assert (None, a, EX + "j", '{"a":[true,null],"b":1}', lit.JSON, None, None) in got
    assert (None, a, EX + "t", "2024", EX + "date", None, None) in got
    assert (None, a, "unknown:x", "1.5E0", lit.DOUBLE, None, None) in got
    assert (None, a, EX + "w", "1", lit.INTEGER, None, None) in got
    assert (None, a, EX + "big", "10000000000000000000", lit.INTEGER, None, None) in got
    assert (None, a, EX + "ok", "false", lit.BOOLEAN, None, None) in got
    assert not any(x[2] == EX + "n" for x in got)


def test_later_contexts_win_and_languages(expanded):
    assert of(expanded, 3) == {(None, "http://g/1", "http://two/p", "x", lit.LANG_STRING, "en", None), (None, "http://g/2", "http://two/p", "y", lit.LANG_STRING, "fr", None)}


def test_named_graph(expanded):
    assert of(expanded, 4) == {(EX + "g", EX + "s", EX + "p", "in graph", lit.STRING, None, None), (None, EX + "g", EX + "about", "a graph", lit.STRING, None, None)}


V = {"@vocab": EX}
TREES = {
    20: {"@context": V, "@id": "http://a", "p": {"@context": {"@vocab": "http://in/"}, "@id": "http://b", "q": 1}},
    21: {"@context": {**V, "Person": {"@id": EX + "Person", "@context": {"name": "http://foaf/name"}}}, "@id": "http://a", "@type": "Person", "name": "Ann", "knows": {"@id": "http://b", "name": "Bo"}},
    22: {"@context": {**V, "prop": {"@id": EX + "prop", "@context": {"q": "http://scoped/q"}}}, "@id": "http://a", "q": 1, "prop": {"@id": "http://b", "q": 2, "r": {"q": 3}}},
    23: {"@context": {**V, "value": "@value", "lang": "@language", "typ": "@type"}, "@id": "http://a", "p": {"value": "x", "lang": "en"}, "q": {"value": "3", "typ": "http://dt"}},
    24: {"@context": {**V, "labels": "@nest", "rev": "@reverse"}, "@id": "http://a", "labels": {"name": "N", "labels": {"deep": 1}}, "rev": {"parent": {"@id": "http://c"}}},
    25: {"@context": {**V, "l": {"@container": "@list"}}, "@id": "http://a", "l": [[1, 2], [3], []], "m": {"@list": [], "@index": "i"}},
    26: {"@context": {**V, "c": {"@container": "@graph"}}, "@id": "http://a", "c": {"@id": "http://s", "name": "x"}},
    27: {"@context": {**V, "c": {"@container": ["@graph", "@id"]}}, "@id": "http://a", "c": {"http://g1": {"@id": "http://s", "name": "x"}}},
    28: {"@context": {**V, "i": {"@id": EX + "i", "@container": "@index", "@index": "cat"}}, "@id": "http://a", "i": {"k": {"@id": "http://b"}}},
    30: {"@context": {"@version": 1.1, "tag": {"@id": "http://tag/"}}, "@id": "http://a", "tag:x": 1},
    31: {"@context": {"@version": 1.1, "tag": "http://tag/"}, "@id": "http://a", "tag:x": 1},
    32: {"@context": {"@base": None, "p": EX + "p"}, "@id": "rel", "p": 1},
    33: {"@context": {"@base": "dir/", "p": EX + "p"}, "@id": "x", "p": 1},
    34: {"@context": V, "@id": "http://a", "e": [], "s": {"@set": [1, [2]]}, "n": None},
    35: {"@context": V, "@id": "http://a", "@included": [{"@id": "http://inc", "p": 1}]},
    36: {"@context": {"@propagate": False, **V}, "@id": "http://a", "p": {"@id": "http://b", "q": 1, "http://r": 2}},
    38: {"@context": {**V, "j": {"@type": "@json"}}, "@id": "http://a", "j": {"b": [1.5, {"z": 1, "a": "\x1f"}], "a": None}},
    39: {"@context": {"name": "http://xmlns.com/foaf/0.1/name"}, "name": "Alice"},
    40: {"@context": ["https://example.com/c0", V], "@id": "http://a", "t": "through five"},
    41: {"@context": {**V, **{f"t{i}": f"t{i + 1}:x" for i in range(300)}, "t300": "http://end/"}, "@id": "http://a", "t0": 1},
    42: {"@context": {**V, "@import": "https://example.com/base"}, "@id": "http://a", "name": 1, "other": 2},
    43: {"@id": "http://only"},
}
WANT = {
    20: [{"@id": "http://a", EX + "p": [{"@id": "http://b", "http://in/q": [{"@value": 1}]}]}],
    21: [{"@id": "http://a", "@type": [EX + "Person"], EX + "knows": [{"@id": "http://b", EX + "name": [{"@value": "Bo"}]}], "http://foaf/name": [{"@value": "Ann"}]}],
    22: [{"@id": "http://a", EX + "q": [{"@value": 1}], EX + "prop": [{"@id": "http://b", "http://scoped/q": [{"@value": 2}], EX + "r": [{"http://scoped/q": [{"@value": 3}]}]}]}],
    23: [{"@id": "http://a", EX + "p": [{"@value": "x", "@language": "en"}], EX + "q": [{"@value": "3", "@type": "http://dt"}]}],
    24: [{"@id": "http://a", EX + "name": [{"@value": "N"}], EX + "deep": [{"@value": 1}], "@reverse": {EX + "parent": [{"@id": "http://c"}]}}],
    25: [{"@id": "http://a", EX + "l": [{"@list": [{"@list": [{"@value": 1}, {"@value": 2}]}, {"@list": [{"@value": 3}]}, {"@list": []}]}], EX + "m": [{"@list": [], "@index": "i"}]}],
    26: [{"@id": "http://a", EX + "c": [{"@graph": [{"@id": "http://s", EX + "name": [{"@value": "x"}]}]}]}],
    27: [{"@id": "http://a", EX + "c": [{"@id": "http://g1", "@graph": [{"@id": "http://s", EX + "name": [{"@value": "x"}]}]}]}],
    28: [{"@id": "http://a", EX + "i": [{"@id": "http://b", EX + "cat": [{"@value": "k"}]}]}],
    30: [{"@id": "http://a", "tag:x": [{"@value": 1}]}],
    31: [{"@id": "http://a", "http://tag/x": [{"@value": 1}]}],
    32: [{"@id": "rel", EX + "p": [{"@value": 1}]}],
    33: [{"@id": EX + "dir/x", EX + "p": [{"@value": 1}]}],
    34: [{"@id": "http://a", EX + "e": [], EX + "s": [{"@value": 1}, {"@value": 2}]}],
    35: [{"@id": "http://a", "@included": [{"@id": "http://inc", EX + "p": [{"@value": 1}]}]}],
    36: [{"@id": "http://a", EX + "p": [{"@id": "http://b", "http://r": [{"@value": 2}]}]}],
    38: [{"@id": "http://a", EX + "j": [{"@type": "@json", "@value": {"a": None, "b": [1.5, {"a": "\x1f", "z": 1}]}}]}],
    39: [{"http://xmlns.com/foaf/0.1/name": [{"@value": "Alice"}]}],
    40: [{"@id": "http://a", "http://deep/t": [{"@value": "through five"}]}],
    41: [{"@id": "http://a", "t1:x": [{"@value": 1}]}],
    42: [{"@id": "http://a", "http://imported/name": [{"@value": 1}], EX + "other": [{"@value": 2}]}],
    43: [],
}
WRONG = {
    60: ({"@context": [{"@vocab": EX, "@protected": True, "t": "http://t"}, {"t": "http://other"}], "t": 1}, "protected term redefinition"),
    61: ({"@context": [{"@protected": True, "t": "http://t"}, None], "t": 1}, "invalid context nullification"),
    62: ({"@context": {**V, "x": "@id"}, "@id": "http://a", "x": "http://b", "p": 1}, "colliding keywords"),
    63: ({"@context": "https://example.com/self", "p": 1}, "recursive context inclusion"),
    64: ({"@context": {"a": {"@id": "http://a", "@prefix": 1}}}, "invalid @prefix value"),
    65: ({"@context": {"a": {"@id": "http://a", "@context": {"b": 7}}}}, "invalid scoped context"),
    66: ({"@context": {"a": {"@id": "http://a", "@container": "@type", "@type": "http://t"}}}, "invalid type mapping"),
    67: ({"@context": {"a:b": "http://other"}}, "invalid IRI mapping"),
    68: ({"@context": {**V, "n": "@nest"}, "n": 3}, "invalid @nest value"),
    69: ({"@context": V, "p": {"@list": [], "q": 1}}, "invalid set or list object"),
    70: ({"@context": V, "@reverse": 3}, "invalid @reverse value"),
    71: ({"@context": V, "p": {"@value": 1, "q": 1}}, "invalid value object"),
    72: ({"@context": V, "p": {"@id": "http://b", "@index": 7}}, "invalid @index value"),
    73: ({"@context": {"@version": 1.0}}, "invalid @version value"),
    74: ({"@context": {"@import": 7}}, "invalid @import value"),
    75: ({"@context": {"a": "a:x"}}, "cyclic IRI mapping"),
    76: ({"@context": {**V, "a": "b:x", "b": "a:y"}}, "cyclic IRI mapping"),
    77: ({"@context": {**V, "i": {"@id": EX + "i", "@container": "@index", "@index": "cat"}}, "i": {"k": "v"}}, "invalid value object"),
}


@pytest.fixture(scope="module")
def trees(spark):
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in TREES.items()] + [(k, json.dumps(v)) for k, (v, _) in WRONG.items()], "doc_id long, doc string")
    chain = [(f"https://example.com/c{i}", json.dumps({"@context": f"c{i + 1}"})) for i in range(5)] + [("https://example.com/c5", json.dumps({"@context": {"t": "http://deep/t"}}))]
    remote = spark.createDataFrame([*chain, ("https://example.com/self", '{"@context":"self"}'), ("https://example.com/base", '{"@context":{"name":"http://imported/name"}}')], "url string, document string")
    return expand(docs, remote=remote, base=EX), docs


def test_expanded_json(trees):
    """Contexts that change along the tree, aliases, containers, lists of lists: documents as expanded JSON."""
    from tessera.operators import tree

    e, docs = trees
    assert {r["doc_id"]: r["code"] for r in e.errors.collect()} == {k: c for k, (_, c) in WRONG.items() if c}
    got = {r["doc_id"]: json.loads(r["doc"]) for r in tree.expanded_json(e.tree, docs).collect()}
    assert {k: got[k] for k in WANT} == WANT


def test_keys_of_statements(trees):
    """No statement has a keyword but @type and @list as its property; a graph container's content is in its graph."""
    st = trees[0].statements
    assert {r["p"] for r in st.filter("p like '@%'").select("p").distinct().collect()} <= {"@type", "@list"}
    assert [r["g"] for r in st.filter("doc_id = 27 and s = 'http://s'").collect()] == ["http://g1"]
    quads = rdf.to_rdf(st.filter("doc_id = 25"))
    node = {r["id"]: json.loads(r["node"]) for r in graph.from_rdf(quads, native_types=True).collect()}["http://a"]
    assert node[EX + "l"] == WANT[25][0][EX + "l"] and node[EX + "m"] == [{"@list": []}]
    flat = {r["id"]: json.loads(r["node"]) for r in graph.nodes(st.filter("doc_id = 25"), native_types=True).collect()}
    assert flat["http://a"][EX + "l"] == WANT[25][0][EX + "l"]


def test_safe_mode_expand_context_and_old_mode(spark):
    docs = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"a":1}'), (3, '{"@context":{"c":null},"c":1}'), (4, '{"@context":{"@version":1.1},"a":1}'), (5, None)], "doc_id long, doc string")
    safe = expand(docs, context='{"a":"http://a"}', safe=True)
    assert {r["doc_id"]: r["code"] for r in safe.errors.collect()} == {1: "invalid property", 3: "invalid property", 5: "loading document failed"}
    old = expand(docs, context='{"a":"http://a"}', mode="json-ld-1.0")
    assert {r["doc_id"]: r["code"] for r in old.errors.collect()} == {4: "processing mode conflict", 5: "loading document failed"}
    assert {r["doc_id"] for r in old.statements.collect()} == {1, 2}
    deep = spark.createDataFrame([(1, '{"http://p":' * 12 + '{"http://p":1}' + "}" * 12), (2, '{"http://p":{"http://p":1}}')], "doc_id long, doc string")
    cut = expand(deep, max_depth=5)
    assert {r["doc_id"]: r["code"] for r in cut.errors.collect()} == {1: "nesting too deep"} and {r["doc_id"] for r in cut.statements.collect()} == {2}
    empty = expand(docs.limit(0))
    assert empty.statements.count() == empty.errors.count() == empty.tree.count() == 0


def test_documents_in_parts(spark):
    """Rows of one doc_id, and rows without one, are parts of a document: their blank nodes stay apart."""
    from tessera.operators import tree

    docs = spark.createDataFrame([(d, json.dumps({"http://p": {"http://q": k}})) for d in (1, None) for k in (1, 2)], "doc_id long, doc string")
    e = expand(docs)
    assert e.statements.filter("p = 'http://p'").select("doc_id", "s", "o").distinct().count() == 4
    assert {r["doc_id"]: json.loads(r["doc"]) for r in tree.expanded_json(e.tree, docs).collect()} == {d: [{"http://p": [{"http://q": [{"@value": k}]}]} for k in (1, 2)] for d in (1, None)}
    both, _ = frame.frame_json(e.statements, {"http://q": {}})
    assert sorted(len(json.loads(r["doc"])["@graph"]) for r in both.collect()) == [2, 2]


def test_rdf_round_trip(spark, expanded):
    quads = rdf.to_rdf(expanded[0])
    back = nquads.parse(nquads.serialize(quads))
    assert back.filter("error is not null").count() == 0
    assert quads.exceptAll(back.drop("error")).count() == 0 and back.drop("error").exceptAll(quads).count() == 0
    nodes = {(r["doc_id"], r["g"], r["id"]): json.loads(r["node"]) for r in graph.from_rdf(quads, native_types=True).collect()}
    a = nodes[2, None, EX + "a"]
    assert a[EX + "l"] == [{"@list": [{"@value": 1}, {"@value": "x"}, {"@id": EX + "z"}]}]
    assert a[EX + "e"] == [{"@list": []}] and a[EX + "ok"] == [{"@value": False}]
    assert (4, EX + "g", EX + "s") in nodes


def test_flatten(expanded):
    docs = {r["doc_id"]: json.loads(r["doc"]) for r in graph.flatten(expanded[0], native_types=True).filter("doc_id in (1, 4)").collect()}
    assert docs[1] == [{"@id": EX + "alice", EX + "knows": [{"@id": EX + "bob"}]}, {"@id": EX + "bob", EX + "age": [{"@value": 3}]}]
    assert docs[4] == [{"@id": EX + "g", "@graph": [{"@id": EX + "s", EX + "p": [{"@value": "in graph"}]}], EX + "about": [{"@value": "a graph"}]}]


def quads(spark, text):
    q = nquads.parse(spark.createDataFrame([(0, x) for x in text.strip().split("\n")], "doc_id long, line string"))
    assert q.filter("error is not null").count() == 0
    return q.drop("error")


def test_nested_lists_and_chains_that_are_none(spark):
    f, r, nil = f"<{lit.FIRST}>", f"<{lit.REST}>", f"<{lit.NIL}>"
    q = quads(spark, f"""
<http://s> <http://p> _:a .
_:a {f} "1" .
_:a {r} _:b .
_:b {f} _:c .
_:b {r} {nil} .
_:c {f} "in" .
_:c {r} {nil} .
<http://s> <http://q> _:x .
_:x {f} "1" .
_:x {r} _:y .
_:y {f} "2" .
_:y {r} _:x .
<http://s> <http://twice> _:t .
<http://s> <http://again> _:t .
_:t {f} "1" .
_:t {r} {nil} .
<http://s> <http://none> {nil} .
""")  # fmt: skip
    nodes = {r["id"]: json.loads(r["node"]) for r in graph.from_rdf(q).collect()}
    s = nodes["http://s"]
    assert s["http://p"] == [{"@list": [{"@value": "1"}, {"@list": [{"@value": "in"}]}]}]
    assert s["http://none"] == [{"@list": []}]
    assert s["http://q"] == [{"@id": "_:x"}] and lit.REST in nodes["_:x"] and lit.FIRST in nodes["_:y"]
    assert s["http://twice"] == [{"@id": "_:t"}] and lit.FIRST in nodes["_:t"]


def test_circles_and_deep_lists(spark):
    """Circles of one to seven cells stay cells; lists nest 25 deep; two lists that hold each other stay cells; a null doc_id is a document."""
    f, r, nil = f"<{lit.FIRST}>", f"<{lit.REST}>", f"<{lit.NIL}>"
    lines = []
    for n in range(1, 8):
        lines += [x for i in range(n) for x in (f'_:c{n}x{i} {f} "{i}" .', f"_:c{n}x{i} {r} _:c{n}x{(i + 1) % n} .")]
    depth = 25
    lines += [x for i in range(depth) for x in (f"_:d{i} {f} " + (f"_:d{i + 1} ." if i < depth - 1 else '"in" .'), f"_:d{i} {r} {nil} .")] + ["<http://s> <http://deep> _:d0 ."]
    lines += [f"_:m {f} _:n .", f"_:m {r} {nil} .", f"_:n {f} _:m .", f"_:n {r} {nil} ."]
    q = quads(spark, "\n".join(lines))
    q = q.unionByName(q.withColumn("doc_id", F.lit(None).cast("long")))
    got = graph.from_rdf(q).collect()
    for doc in (0, None):
        nodes = {x["id"]: json.loads(x["node"]) for x in got if x["doc_id"] == doc}
        value = nodes["http://s"]["http://deep"][0]
        for _ in range(depth - 1):
            (value,) = value["@list"]
        assert value == {"@list": [{"@value": "in"}]}
        assert all(nodes[f"_:c{n}x{i}"][lit.REST] == [{"@id": f"_:c{n}x{(i + 1) % n}"}] for n in range(1, 8) for i in range(n)), doc
        assert nodes["_:m"][lit.FIRST] == [{"@id": "_:n"}] and nodes["_:n"][lit.FIRST] == [{"@id": "_:m"}]


def test_long_list(spark):
    n = 3000
    q = spark.range(n).select(F.lit(0).cast("long").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(lit.FIRST).alias("p"), F.col("id").cast("string").alias("o"), F.lit("lit").alias("k")),
        F.struct(F.lit(lit.REST).alias("p"), F.when(F.col("id") == n - 1, lit.NIL).otherwise(F.concat(F.lit("_:c"), F.col("id") + 1)).alias("o"), F.when(F.col("id") == n - 1, "iri").otherwise("bnode").alias("k")))).alias("x"), F.concat(F.lit("_:c"), "id").alias("s"))
    none = F.lit(None).cast("string")
    q = q.select("doc_id", "s", "x.p", "x.o", F.col("x.k").alias("o_kind"), F.when(F.col("x.k") == "lit", lit.STRING).alias("datatype"), none.alias("language"), none.alias("g"))
    q = q.unionByName(quads(spark, "<http://s> <http://p> _:c0 ."))
    got = rdf.with_lists(q).filter("p = '@list'").orderBy("pos").collect()
    assert [r["o"] for r in got] == [str(i) for i in range(n)]


def test_lists_in_blocks(spark):
    """A list's cells are the same whatever the block of positions that a task numbers: with nulls left out, lists in lists, empty ones, no doc_id."""
    items = [None, *range(7), None, [1, None, 2], None, None, [], *"abc"]
    docs = spark.createDataFrame([(d, json.dumps({"@context": {**V, "l": {"@container": "@list"}}, "@id": "http://a", "l": items[:n]})) for d, n in ((1, 16), (2, 5), (3, 0), (None, 12))], "doc_id long, doc string")
    st = expand(docs).statements
    whole, parts = (sorted(map(str, rdf.to_rdf(st, block=b).collect())) for b in (1 << 16, 3))
    assert whole == parts and sum("'" + lit.FIRST + "'" in x for x in whole) == (12 + 2) + 4 + 0 + (8 + 2)
    back = graph.from_rdf_json(rdf.to_rdf(st, block=2), native_types=True).filter("doc_id = 1").first()["doc"]
    assert json.loads(back)[0][EX + "l"] == [{"@list": [*({"@value": i} for i in range(7)), {"@list": [{"@value": 1}, {"@value": 2}]}, {"@list": []}, *({"@value": x} for x in "abc")]}]


def test_contexts_beyond_the_driver(spark, monkeypatch):
    """Statements are the same where contexts are too long, or too many, for the driver."""
    from tessera.operators import context

    docs = spark.createDataFrame([(i, json.dumps({"@context": {**V, f"t{i}": {"@id": f"http://t/{i}", "@context": {"in": f"http://in/{i}"}}}, f"t{i}": {"in": i}})) for i in range(4)], "doc_id long, doc string")
    want = sorted(map(str, expand(docs).statements.collect()))
    for name in ("SMALL", "ALL", "FEW"):
        with monkeypatch.context() as m:
            m.setattr(context, name, 2)
            assert sorted(map(str, expand(docs).statements.collect())) == want
    assert len(want) == 8


def test_nquads_lines(spark):
    lines = ['<http://a> <http://p> "a\\"b\\\\\\n\\u00e9\\U0001F600\\t"@en-us <http://g> . # "c"', "bad", "# comment", "", '_:b.1 <p:q> "x"^^<http://dt> .', "<http://a> <http://p> <http://o>", '<http://a> <http://p> "\\q" .', '<http://a> <http://p> "' + "long \\n" * 20_000 + '" .']
    got = nquads.parse(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, line string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert set(by) == {0, 1, 4, 5, 6, 7}
    assert by[0]["o"] == 'a"b\\\n\u00e9\U0001f600\t' and by[0]["language"] == "en-us" and by[0]["g"] == "http://g" and by[0]["error"] is None
    assert by[4]["s"] == "_:b.1" and by[4]["datatype"] == "http://dt"
    assert by[1]["error"] and by[5]["error"] and by[6]["error"]
    assert by[7]["o"] == "long \n" * 20_000
    escaped = spark.createDataFrame([(0, '<http://a> <http://p> "\\U00000022\\U0000005C\\u0022\\U0001f600\\U0010FFFF" .')], "doc_id long, line string")
    assert nquads.parse(escaped).first()["o"] == '"\\"\U0001f600\U0010ffff'


def test_nquads_error_places(spark):
    """Errors are those of the parser, each at the first term that doesn't fit."""
    a = "<http://a> <http://p> "
    wrong = [
        ("bad", 1, "unexpected character"), ("<http://a> _x <http://o> .", 12, "unexpected character"), (a + "<http://o>", 33, "unexpected end"), ("  <http://a", 3, "invalid IRI"), ("<http://a\\q> <p:q> <o:o> .", 1, "invalid IRI"),
        (a + '"open .', 23, "invalid literal"), (a + '"\\q" .', 23, "invalid literal"), (a + '"\\U00110000" .', 23, "invalid literal"), ('"x" <http://p> <http://o> .', 1, "literal out of place"), ('<http://a> "x" <http://o> .', 12, "literal out of place"),
        (a + '<http://o> "g" .', 34, "literal out of place"), (a + "<http://o> <http://g> <http://h> .", 45, "expected '.'"), (a + '"x"^^int .', 26, "expected '.'"), (a + "\U0001f600 .", 23, "unexpected character"), (a + "_:b . left", 27, "unexpected character"), (None, None, "null line"),
        (a + '"\\uD83D\\uDE00" .', 23, "invalid literal"), (a + '"\\U0000dfff" .', 23, "invalid literal"), (a + '"\\\\uD83D" .', 0, ""),
        (a + '"' + "long " * 50_000, 23, "invalid literal"), ("", 0, ""), (" # comment", 0, ""), (a + "_:b.1 <http://g> . # end", 0, ""), (a + '"a\\u00e9\\U0001F600\\n"@en .', 0, ""), (a + '"' + "long \\n" * 50_000 + '" .', 0, ""), (a + '"x"^^<d:t>_:g.', 0, ""),
    ]
    lines = spark.createDataFrame([(i, line) for i, (line, *_) in enumerate(wrong)], "doc_id long, line string")
    got = {r["doc_id"]: (r["column"], r["code"]) for r in nquads.errors(lines).collect()}
    assert got == {i: (column, code) for i, (_, column, code) in enumerate(wrong) if code}
    assert set(got) == {r["doc_id"] for r in nquads.parse(lines).filter("error is not null").collect()}
    texts = spark.createDataFrame([(1, "bad\r\n<a:b> <p:q> <o:o> .\n  worse"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["number"], r["column"]) for r in nquads.errors(nquads.lines_of(texts)).orderBy("number").collect()] == [(1, 1, 1), (1, 3, 3)]


def test_nquads_files(spark, tmp_path):
    q = quads(spark, '<http://a> <http://p> "x" .\n<http://a> <http://p> "x" .\n<http://a> <http://b> <http://c> .')
    nquads.write(q, str(tmp_path / "out"))
    assert nquads.read(spark, str(tmp_path / "out")).count() == 2


def test_stream(spark, tmp_path):
    from tessera import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text('<http://a> <http://p> "x" .\n<rel> <http://p> "x" .\nbroken\n')
    q = streaming.quads(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("quads_seen").start()
    q.processAllAvailable()
    q.stop()
    assert [r["s"] for r in spark.table("quads_seen").collect()] == ["http://a"]


def test_well_formed(spark):
    rows = [("http://a b", False), ("http://a#x#y", False), ("rel", False), ("urn:x", True), ("http://a/\u00e9", True)]
    df = spark.createDataFrame(rows, "i string, ok boolean")
    assert df.filter(iri.is_well_formed(F.col("i")) != F.col("ok")).count() == 0
    tags = spark.createDataFrame([("en", True), ("x y", False), ("abcdefghi", False), ("de-1996", True), ("1a", False)], "t string, ok boolean")
    assert tags.filter(iri.is_well_formed_language(F.col("t")) != F.col("ok")).count() == 0


def test_resolution(spark):
    """The examples of RFC 3986, 5.4; absolute references stay as they are."""
    want = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "urn:x": "urn:x"}
    got = spark.createDataFrame(list(want.items()), "r string, w string").select("r", "w", iri.resolve(F.lit("http://a/b/c/d;p?q"), F.col("r")).alias("o")).collect()
    assert {r["r"]: r["o"] for r in got} == want


def test_opaque_bases(spark):
    """Bases without an authority, and dot segments of random paths against the steps of RFC 3986, 5.2.4, for columns and for contexts."""
    import random

    from tessera.functions import definitions

    want = {("tag:example", "a"): "tag:a", ("tag:example/foo", "a"): "tag:example/a", ("tag:example/foo/", "a"): "tag:example/foo/a", ("ex:", "test"): "ex:test", ("tag:x/y/z", "../up"): "tag:x/up", ("tag:x/y/z", "/./top/../t"): "tag:/t", ("tag:x", "../a"): "tag:a", ("tag:x?q", "#f"): "tag:x?q#f"}
    got = spark.createDataFrame([(*k, v) for k, v in want.items()], "b string, r string, w string").select("b", "r", iri.resolve(F.col("b"), F.col("r")).alias("o")).collect()
    assert {(r["b"], r["r"]): r["o"] for r in got} == want
    assert all(definitions.resolve(b, r) == w for (b, r), w in want.items())

    def steps(left):
        done = ""
        while left:
            if left.startswith(("../", "./")):
                left = left.partition("/")[2]
            elif left in (".", ".."):
                left = ""
            elif left.startswith("/./") or left == "/.":
                left = "/" + left[3:]
            elif left.startswith("/../") or left == "/..":
                left, done = "/" + left[4:], done.rpartition("/")[0]
            else:
                cut = left.find("/", 1) if "/" in left[1:] else len(left)
                done, left = done + left[:cut], left[cut:]
        return done

    r = random.Random(5)
    paths = [r.choice(["", "/"]) + "/".join(r.choice(["a", "bc", ".", "..", "..."]) for _ in range(r.randint(1, 7))) + r.choice(["", "/"]) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in paths], "x string").select("x", iri.without_dot_segments(F.col("x")).alias("y")).collect()
    assert [(x["x"], x["y"]) for x in got] == [(x, steps(x)) for x in paths]
    assert [definitions.without_dots(x) for x in paths] == [steps(x) for x in paths]


def test_relative_references(spark):
    """What a reference is made of resolves to it again."""
    base = "http://a/b/c/d"
    want = {"http://a/b/c/e": "e", "http://a/b/x": "../x", "http://a/": "../../", "http://a/b/c/": "./", "http://a/b/c/d?q#f": "d?q#f", "http://other/x": "http://other/x", "urn:x": "urn:x", "http://a/b/c/x:y": "./x:y", "http://a/b/c/e/f": "e/f"}
    got = spark.createDataFrame(list(want), "string").select("value", iri.relative_to(F.lit(base), F.col("value")).alias("r")).withColumn("back", iri.resolve(F.lit(base), F.col("r"))).collect()
    assert {r["value"]: r["r"] for r in got} == want
    assert all(r["back"] == r["value"] for r in got)


def test_missing_values(spark):
    """Null lines are errors; null doc_ids are a document; repeated quads count once."""
    got = nquads.parse(spark.createDataFrame([(1, None), (None, "<http://a> <http://p> _:x ."), (None, "<http://a> <http://p> _:x .")], "doc_id long, line string"))
    assert sorted((r["doc_id"] or 0, r["error"]) for r in got.select("doc_id", "error").collect() if r["doc_id"]) == [(1, "invalid line")]
    lines, errors = canon.canonize(got.filter("error is null").drop("error"))
    assert [(r["doc_id"], r["line"]) for r in lines.collect()] == [(None, "<http://a> <http://p> _:c14n0 .")] and errors.count() == 0


def test_remote_contexts_over_http(spark):
    """Contexts of contexts from a server of this machine, each loaded once; a redirect, a Link header, a missing one."""
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tessera.sources import remote

    seen = Counter()
    pages = {"/one": {"@context": ["two", "missing"]}, "/two": {"@context": {"name": "http://two/name"}}, "/linked": {"name": "x"}}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/one")
                self.end_headers()
                return
            self.send_response(200 if self.path in pages else 404)
            self.send_header("Content-Type", "application/json")
            if self.path == "/linked":
                self.send_header("Link", '</two>; rel="http://www.w3.org/ns/json-ld#context"')
            self.end_headers()
            self.wfile.write(json.dumps(pages.get(self.path, {})).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    docs = spark.createDataFrame([(k, json.dumps({"@context": u, "name": "Ada"})) for k, u in enumerate([f"{at}/one", f"{at}/one", "one", f"{at}/moved"])] + [(9, "{"), (10, None)], "doc_id long, doc string")
    got = {r["url"].removeprefix(at) for r in remote.contexts_of(docs, base=f"{at}/x").collect()}
    linked = remote.load(f"{at}/linked")[0]
    server.shutdown()
    assert got == {"/one", "/two", "/moved"} and seen["/two"] == 1 and seen["/missing"] == 1
    assert json.loads(linked) == {"@context": f"{at}/two", "name": "x"}


def test_shared_folder(spark):
    """Without a named folder, only a local session may make one."""
    from tessera.sources import shared

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_numbers(spark):
    rows = [(1.5, "1.5E0", "1.5"), (2095.23, "2.09523E3", "2095.23"), (-0.001, "-1.0E-3", "-0.001"), (1e21, "1.0E21", "1e+21"), (1e-7, "1.0E-7", "1e-7"), (123456789012345680000.0, "1.234567890123457E20", "123456789012345680000"), (0.0, "0.0E0", "0"), (100.0, "1.0E2", "100"), (0.000001, "1.0E-6", "0.000001"), (1.25e-9, "1.25E-9", "1.25e-9"), (2e23, "2.0E23", "2e+23"), (5e-324, "4.9E-324", "5e-324"), (-1.6130484589462314e17, "-1.613048458946231E17", "-161304845894623140")]
    got = spark.createDataFrame(rows, "x double, xsd string, js string").select("xsd", "js", lit.xsd_double(F.col("x")).alias("a"), lit.json_number(F.col("x")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(r["xsd"], r["js"]) for r in got]


def test_canonical_forms(spark):
    one = quads(spark, '_:x <http://p> "1" .\n_:x <http://q> _:y .\n_:y <http://p> "2" .')
    two = quads(spark, '_:b <http://p> "2" .\n_:a <http://q> _:b .\n_:a <http://p> "1" .\n_:a <http://p> "1" .')
    a, b = (canon.canonize(q)[0] for q in (one, two))
    assert {r["line"] for r in a.collect()} == {r["line"] for r in b.collect()} and "_:c14n1" in str(a.collect())
    assert canon.digest(a).first() == canon.digest(b).first()
    # Nodes alike: two in a circle, a path whose ends differ only far off, under other labels and in other order.
    alike = ["<http://s> <http://p> _:x .\n<http://s> <http://p> _:y .", "_:a <http://p> _:b .\n_:b <http://p> _:a .", "_:a <http://p> _:b .\n_:b <http://p> _:c .\n_:c <http://p> _:d .\n_:d <http://p> _:e .\n_:x <http://p> _:y .\n_:y <http://p> _:z ."]
    import random

    other = []
    for text in alike:
        label = {n: f"_:q{k}" for k, n in enumerate(random.Random(2).sample(sorted(set(re.findall(r"_:[a-z]", text))), len(set(re.findall(r"_:[a-z]", text)))))}
        lines = [re.sub(r"_:[a-z]", lambda m: label[m[0]], x) for x in text.split("\n")]
        other.append("\n".join(reversed(lines)))
    forms = []
    for texts in (alike, other):
        rows = [(i, x) for i, t in enumerate(texts) for x in t.split("\n")]
        got, errors = canon.canonize(nquads.parse(spark.createDataFrame(rows, "doc_id long, line string")).drop("error"))
        assert errors.count() == 0
        forms.append(sorted((r["doc_id"], r["line"]) for r in got.collect()))
    assert forms[0] == forms[1] and len(forms[0]) == 10
    # Two like chains, longer than any call stack, and a document in which few of many nodes are tied.
    ends = "<http://first>", "<http://last>"
    chain = "\n".join(f"_:{c}{i} <http://p> _:{c}{i + 1} ." for c in "ab" for i in range(3000)) + "".join(f"\n_:{c}0 <http://q> {ends[0]} ." for c in "ab")
    many = "\n".join(f'_:n{i} <http://p> "{i}" .\n_:n{i} <http://next> _:n{i + 1} .' for i in range(3000)) + "\n_:x <http://p> _:n7 .\n_:y <http://p> _:n8 .\n_:x <http://p> _:y .\n_:y <http://p> _:x ."
    rows = [(k, x) for k, t in enumerate((chain, many)) for x in t.split("\n")]
    got, errors = canon.canonize(nquads.parse(spark.createDataFrame(rows, "doc_id long, line string")).drop("error"))
    assert errors.count() == 0 and got.groupBy("doc_id").count().orderBy("doc_id").collect() == [(0, 6002), (1, 6004)]
    names = got.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"_:c14n(\d+)"), F.lit(1))).alias("n")).distinct().groupBy("doc_id").agg(F.count("*"), F.max(F.col("n").cast("int")) + 1)
    assert sorted(tuple(r) for r in names.collect()) == [(0, 6002, 6002), (1, 3003, 3003)]
    lines, errors = canon.canonize(nquads.parse(spark.createDataFrame(rows[:100], "doc_id long, line string")).drop("error"), most=10, work=None)
    assert lines.count() == 0 and errors.count() == 1
    star = "\n".join(f"_:h{k} <http://p> _:l{k}x{i} ." for k in (0, 1) for i in range(10))
    lines, errors = canon.canonize(quads(spark, star), work=2000)
    assert lines.count() == 0 and [r["code"] for r in errors.collect()] == ["canonicalize-failed"]
    v = F.parse_json(F.lit('{"b":1.50,"a":"x\\"\\n","c":true,"\\ufffd":null,"\\ud83d\\ude00":1e21}'))
    assert spark.range(1).select(canon.canonical_json(v).alias("j")).first()["j"] == '{"a":"x\\"\\n","b":1.5,"c":true,"\U0001f600":1e+21,"\ufffd":null}'


def test_compact(spark, expanded):
    context = {"ex": EX, "@vocab": "http://none/", "l": {"@id": EX + "l", "@container": "@list"}, "d": {"@id": EX + "d", "@container": "@language"}, "when": {"@id": EX + "t", "@type": EX + "date"}, "ok": EX + "ok", "w": {"@id": EX + "w", "@container": "@set"}}
    docs, errors = compact.compact_json(expanded[2].filter("doc_id = 2"), json.dumps(context))
    (a,) = [json.loads(r["doc"]) for r in docs.collect()]
    assert errors.count() == 0 and a["@context"] == context and a["@id"] == "ex:a"
    assert a["l"] == [1, "x", {"@id": "ex:z"}] and a["d"] == {"@none": "?", "en": ["Hi", "Ho"]} and a["when"] == "2024" and a["ok"] is False and a["w"] == [1.0]
    assert sorted(a["@type"]) == ["ex:A", "ex:B"] and a["ex:e"] == {"@list": []} and a["ex:i"] == {"@index": "k", "@value": "v"}
    with pytest.raises(ValueError, match="invalid IRI mapping"):
        compact.compact_json(expanded[2], '{"a":"b"}')


def walked(edges, kind):
    """What node 0 embeds, by walking: @last walks backwards, as the last place of one walk is the first of the other."""
    if not any(a == 0 for a, _, _ in edges):
        return None
    seen, subjects = {0}, {a for a, _, _ in edges}

    def node(n, above):
        out = {"@id": f"{EX}{n}"}
        if n in subjects:
            out["@type"] = [EX + ("N" if n else "R")]
        for _, p, b in sorted((x for x in edges if x[0] == n), key=lambda x: (x[1], x[2]), reverse=kind == "@last"):
            if b in above or (kind != "@always" and b in seen):
                child = {"@id": f"{EX}{b}"}
            else:
                seen.add(b)
                child = node(b, above | {b})
            out.setdefault(EX + p, []).append(child)
        for p in ("p", "q"):
            if EX + p in out:
                out[EX + p].sort(key=lambda x: x["@id"])
        return out

    return node(0, {0})


def test_dropped_tables_of_any_store(spark):
    """Tables are deleted through Spark's file systems: one that only Hadoop knows."""
    from tessera.sources import shared

    place = spark.conf.get("spark.checkpoint.dir")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.drop.link./x", place)
    spark.range(1).write.parquet(f"{place}/one")
    t = spark.read.parquet("viewfs://drop/x/one")
    t.written_at = "viewfs://drop/x/one"
    shared.dropped(t)
    import os

    assert not os.path.exists(place.removeprefix("file://") + "/one")


def test_whole_numbers_end_below_1e21(spark):
    e = expand(spark.createDataFrame([(1, '{"http://p":[1e21,999999999999999900000,-1e21,1e19]}')], "doc_id long, doc string"))
    got = {(r["o"], r["datatype"]) for r in e.statements.collect()}
    assert got == {("1.0E21", lit.DOUBLE), ("999999999999999900000", lit.INTEGER), ("-1.0E21", lit.DOUBLE), ("10000000000000000000", lit.INTEGER)}


def test_redirected_contexts(spark):
    """A context that moved to another folder names one beside it there."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tessera.sources import remote

    pages = {"/b/moved": {"@context": ["inner", {"x": EX + "x"}]}, "/b/inner": {"@context": {"name": EX + "right"}}, "/a/inner": {"@context": {"name": EX + "wrong"}}}

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/a/start":
                self.send_response(302)
                self.send_header("Location", "/b/moved")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("Content-Type", "application/ld+json")
            self.end_headers()
            self.wfile.write(json.dumps(pages[self.path]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        docs = spark.createDataFrame([(1, json.dumps({"@context": f"http://127.0.0.1:{server.server_port}/a/start", "name": "n"}))], "doc_id long, doc string")
        found = remote.contexts_of(docs)
        e = expand(docs, remote=found)
        assert [(r["p"], r["o"]) for r in e.statements.collect()] == [(EX + "right", "n")] and e.errors.count() == 0
    finally:
        server.shutdown()


def test_frames(spark):
    q = quads(spark, f"""
<{EX}a> <{lit.TYPE}> <{EX}Person> .
<{EX}a> <{EX}name> "Ann" .
<{EX}a> <{EX}knows> <{EX}b> .
<{EX}b> <{EX}name> "Bo"@en .
<{EX}b> <{lit.TYPE}> <{EX}Dog> .
<{EX}c> <{EX}name> "Cy" .
""")  # fmt: skip
    st = rdf.with_lists(q)
    ids = lambda f: {r["s"].removeprefix(EX) for r in frame.matching(st, frame.resolved(spark, {"@context": {"@vocab": EX}} | f)).collect()}
    assert ids({"@type": "Person"}) == {"a"}
    assert ids({}) == {"a", "b", "c"}
    assert ids({"@id": EX + "c"}) == {"c"}
    assert ids({"name": {"@value": "Bo"}}) == set() and ids({"name": {"@value": "Bo", "@language": "en"}}) == {"b"}
    assert ids({"knows": [], "name": {}}) == {"b", "c"}
    assert ids({"knows": {"name": {"@language": {}, "@value": {}}}}) == {"a"}
    f = frame.resolved(spark, {"@context": {"@vocab": EX}, "@type": "Person", "knows": {"@explicit": True, "name": {}}, "age": {"@default": 7}})
    got = [json.loads(r["node"]) for r in frame.framed(st, f).collect()]
    assert got == [{"@id": EX + "a", "@type": [EX + "Person"], EX + "name": [{"@value": "Ann"}], EX + "knows": [{"@id": EX + "b", "@type": [EX + "Dog"], EX + "name": [{"@language": "en", "@value": "Bo"}]}], EX + "age": [{"@value": 7}]}]
    plain = frame.resolved(spark, {"@context": {"@vocab": EX}, "@type": "Person", "knows": {}, "age": {"@default": 7}})
    got = [json.loads(r["node"]) for r in frame.framed(st, plain, explicit=True, omit_default=True, default_graph=True).collect()]
    assert got == [{"@id": EX + "a", "@type": [EX + "Person"], EX + "knows": [{"@id": EX + "b", "@type": [EX + "Dog"]}]}]
    listed = rdf.with_lists(quads(spark, f"""
<{EX}a> <{lit.TYPE}> <{EX}Person> .
<{EX}a> <{EX}l> _:c .
_:c <{lit.FIRST}> <{EX}b> .
_:c <{lit.REST}> <{lit.NIL}> .
<{EX}b> <{EX}name> "Bo" .
"""))
    got = [json.loads(r["node"]) for r in frame.framed(graph.listed(listed), frame.resolved(spark, {"@context": {"@vocab": EX}, "@type": "Person", "l": {"name": {}}})).collect()]
    assert got == [{"@id": EX + "a", "@type": [EX + "Person"], EX + "l": [{"@list": [{"@id": EX + "b", EX + "name": [{"@value": "Bo"}]}]}]}]
    # Walks against a model: random graphs, each kind of embedding.
    import random

    rng = random.Random(2)
    edges = {d: {(rng.randrange(6), rng.choice("pq"), rng.randrange(6)) for _ in range(rng.randrange(4, 14))} for d in range(12)}
    st = expand(spark.createDataFrame([(d, json.dumps([{"@context": {"@vocab": EX}, "@id": f"{EX}{a}", "@type": "N" if a else "R", p: {"@id": f"{EX}{b}"}} for a, p, b in sorted(e)])) for d, e in edges.items()], "doc_id long, doc string")).statements
    for kind in ("@once", "@last", "@always"):
        shape = frame.resolved(spark, {"@context": {"@vocab": EX}, "@type": "R"})
        got = {r["doc_id"]: json.loads(r["node"]) for r in frame.framed(st, shape, embed=kind).collect()}
        for d, e in edges.items():
            assert got.get(d) == walked(e, kind), (kind, d)
    for bad, code in (({"@embed": "@maybe"}, "invalid @embed value"), ({"@id": 5}, "invalid frame"), ({"@type": "no iri", "@context": {}}, "invalid frame")):
        with pytest.raises(frame.FrameError) as e:
            frame.resolved(spark, {"@context": {"@vocab": EX}} | bad)
        assert e.value.code == code


def test_without_the_training_data_subpackage():
    """Nothing outside imports tessera.llm, and the entry module guards it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in [*root.glob("tessera/*.py"), *root.glob("tessera/[!l]*/*.py")]:
        assert "tessera.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_documents_with_one_context_go_over_all_tasks(spark, monkeypatch):
    import tessera.operators.expand as module

    levels = []
    monkeypatch.setattr(module, "written", lambda df, what, write=module.written: levels.append(write(df, what)) or levels[-1])
    docs = spark.createDataFrame([(i, json.dumps({"@context": {"@vocab": EX, "v": "@value"}, "@id": f"{EX}{i}", "p": {"v": "x"}, "q": [{"v": i}]})) for i in range(400)], "doc_id long, doc string").coalesce(1)
    assert expand(docs).statements.count() == 800
    assert [len(t.inputFiles()) for t in levels if "next" in t.columns] == [4, 4]


def test_many_documents_of_tied_nodes_a_batch(spark):
    """Documents are named together, each as it would be alone, and cost little more than their own steps."""
    row = lambda doc, s, o: (doc, s, EX + "next", o, "bnode", None, None, None)
    quads = [row(d, f"_:{c}{i}", f"_:{c}{i + 1}") for d in range(300) for c in "ab" for i in range(1 + d % 3)]
    q = spark.createDataFrame(quads, "doc_id long, s string, p string, o string, o_kind string, datatype string, language string, g string")
    lines = {}
    for r in canon.canonize(q)[0].collect():
        lines.setdefault(r["doc_id"], set()).add(r["line"])
    assert len(lines) == 300 and all(lines[d] == lines[d % 3] and len(lines[d]) == 2 * (1 + d % 3) for d in lines)
    linked = [(1, "_:a", EX, "_:b", None), (1, "_:b", EX, "_:a", None), (2, "_:a", EX, "_:b", None), (2, "_:b", EX, "_:a", None)]
    tied = [(d, n, "h", d) for d in (1, 2) for n in ("_:a", "_:b")]
    made = canon._apart(spark.createDataFrame(linked, "doc_id long, s string, p string, o string, g string"), spark.createDataFrame(tied, "doc_id long, me string, hash string, start long"), None)
    assert "FlatMapCoGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["name"]) for r in made.collect()} == {(1, "_:c14n1"), (1, "_:c14n2"), (2, "_:c14n2"), (2, "_:c14n3")}


def plans_of(monkeypatch, *modules):
    """(name, physical plan) of every table that modules write, as it is written."""
    out = []

    def write(df, what, write=modules[0].written):
        out.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, what)

    for m in modules:
        monkeypatch.setattr(m, "written", write)
    return out


def test_compaction_deals_values_once(spark, monkeypatch):
    """Values go to their objects by their place, once a depth: no join looks for the objects first, nothing is counted for them, and the rows with their terms are not written again. Documents without an id, that come twice, with lists in lists, graphs and empty arrays come out as ever."""
    import tessera.operators.tree as tree

    doc = {"@context": {"@vocab": EX}, "@id": EX + "a", "l": {"@list": [1, {"@list": ["x", {"@id": EX + "b"}]}]}, "m": {"@list": ["a", "b"]}, "e": [], "n": {"@list": []}, "g": {"@graph": [{"@id": EX + "c", "p": "in"}]}, "q": {"r": {"s": "deep"}}}
    twice, alone = {"@context": {"@vocab": EX}, "@id": EX + "t", "m": {"@list": ["a"]}}, {"@context": {"@vocab": EX}, "@id": EX + "n", "m": {"@list": ["a"]}, "g": {"@graph": [{"p": "in"}]}}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"@context": {"@vocab": EX}, "p": None})), (None, json.dumps(alone)), (3, None), (4, json.dumps(twice)), (4, json.dumps(twice))], "doc_id long, doc string")
    made = expand(docs).tree
    plans = plans_of(monkeypatch, compact, tree)
    context = {"@vocab": EX, "m": {"@id": EX + "m", "@container": "@list"}, "g": {"@id": EX + "g", "@container": "@graph"}}
    got, errors = compact.compact_json(made, json.dumps(context))
    got = {r["doc_id"]: {k: v for k, v in json.loads(r["doc"]).items() if k != "@context"} for r in got.collect()}
    assert errors.count() == 0 and set(got) == {None, 1, 4}
    assert got[1] == {"@id": EX + "a", "e": [], "g": {"@id": EX + "c", "p": "in"}, "l": {"@list": [1, {"@list": ["x", {"@id": EX + "b"}]}]}, "m": ["a", "b"], "n": {"@list": []}, "q": {"r": {"s": "deep"}}}
    # What the objects of a document without an id hold is not looked up; equal rows are told apart by nothing.
    assert got[None] == {"@id": EX + "n", "g": {"@graph": [{"p": "in"}]}, "m": ["a"]}
    assert got[4] == {"@graph": [{"@id": EX + "t", "m": [["a", "a"], ["a", "a"]]}] * 2}
    assert "tree" not in dict(plans) and "keyed" not in dict(plans)
    facts, objects = dict(plans)["facts"], [p for what, p in plans if what == "objects"]
    assert "distinct" not in facts and len(objects) == 4 and not any("LeftSemi" in p for p in objects)


def test_names_alone_are_shortened(spark, monkeypatch):
    """A reference is taken apart once, a literal is no name, and what only objects need goes with objects."""
    expr = iri.relative_to(F.col("base"), F.col("name"))
    assert str(expr._jc.toString()).count("regexp_extract") <= 10
    odd = [(None, "http://h/a"), ("http://h/a/b", None), ("http://h/a/b", ""), ("http://h/a/b", "http://h/a/b\n#x"), ("http://h/a/b", "http://h/a/"), ("http://h/a/b", "http://h/a/@type"), ("http://h/a/b", "http://h/a/x:y"), ("http://h/a/b/c/", "http://h/a/q?r#s"), ("http://h/a/b", "http://h"), ("http://h", "http://h/a"), ("http://h/a", "http://g/a"), ("tag:x", "tag:y")]
    got = [r[0] for r in spark.createDataFrame(odd, "base string, name string").select(expr).collect()]
    assert got == ["http://h/a", None, "", "b\n#x", "./", "./@type", "./x:y", "../../q?r#s", "../../", "/a", "http://g/a", "tag:y"]
    tables = []
    monkeypatch.setattr(compact, "written", lambda df, what, write=compact.written: tables.append((what, write(df, what))) or tables[-1][1])
    doc = [{"@id": "http://b/a/x", "@type": [EX + "T"], EX + "text": [{"@value": "http://b/a/y"}], EX + "r": [{"@id": "http://b/a/y"}, {"@id": "http://b/z", EX + "n": [{"@value": "v", "@type": EX + "D"}]}], EX + "v": [{"@id": EX + "w"}]}]
    context = {"@vocab": EX, "@base": "http://b/a/doc", "r": {"@type": "@id"}, "v": {"@type": "@vocab"}}
    docs, _ = compact.compact_json(expand(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, doc string")).tree, json.dumps(context))
    assert {k: v for k, v in json.loads(docs.first()["doc"]).items() if k != "@context"} == {"@id": "x", "@type": "T", "text": "http://b/a/y", "r": ["y", {"@id": "../z", "n": {"@type": "D", "@value": "v"}}], "v": "w"}
    rows = dict(tables)["terms"].select("p", "at", "o_kind", "id_short", "id_vocab", "keyword").collect()
    assert all(r["id_short"] is None for r in rows if r["o_kind"] == "lit") and all(r["id_vocab"] is None for r in rows if r["p"] not in ("@type", EX + "v")) and all((r["keyword"] is None) == (r["at"] is None) for r in rows)


def test_framing_reads_once(spark, monkeypatch):
    """Documents are parsed once, wrong ones too; what occurrences point at, and what they say, is joined once. Literals under @type, rows without a document or that come twice are framed as ever."""
    import tessera.operators.expand as expansion

    good = {"@context": {"@vocab": EX}, "@id": EX + "a", "p": 1}
    plans = plans_of(monkeypatch, expansion, frame)
    e = expand(spark.createDataFrame([(1, json.dumps(good)), (2, "{"), (3, None), (4, "[]"), (5, "[null, 7]"), (6, "null"), (1, json.dumps(good)), (7, "[{}, 1]"), (None, "}")], "doc_id long, doc string"))
    assert {r["doc_id"]: r["code"] for r in e.errors.collect()} == dict.fromkeys((None, 2, 3), "loading document failed") and e.statements.select("doc_id", "o").distinct().collect() == [(1, "1")]
    assert "parseJson" in dict(plans)["objects"] and "parseJson" not in dict(plans)["errors"]
    row = lambda doc, s, p, o, kind, **more: tuple(({"doc_id": doc, "s": s, "p": p, "o": o, "o_kind": kind} | more).get(k) for k in frame.STATEMENT)
    types = ", ".join(f"{k} {'long' if k == 'doc_id' else 'int' if k == 'pos' else 'string'}" for k in frame.STATEMENT)
    of = lambda doc: [row(doc, EX + "a", "@type", EX + "T", "iri"), row(doc, EX + "a", "@type", "text", "lit", datatype=lit.STRING), row(doc, EX + "a", EX + "p", "v", "lit", datatype=lit.LANG_STRING, language="en"), row(doc, EX + "a", EX + "q", EX + "b", "iri"), row(doc, EX + "b", EX + "q", EX + "a", "iri"), row(doc, EX + "b", EX + "l", "1", "lit", datatype=lit.INTEGER, list="_:l", pos=0)]
    st = spark.createDataFrame([*of(1), *of(1), *of(None)], types)
    got = frame.framed(st, frame.resolved(spark, {"@type": EX + "T"})).collect()
    node = lambda items: {"@id": EX + "a", "@type": [EX + "T", "text", {"@value": "text"}], EX + "p": [{"@language": "en", "@value": "v"}], EX + "q": [{"@id": EX + "b", EX + "l": [{"@list": [{"@value": 1}] * items}], EX + "q": [{"@id": EX + "a"}]}]}
    assert {r["doc_id"]: json.loads(r["node"]) for r in got} == {1: node(2), None: node(1)} and len(got) == 2
    assert {what for what, _ in plans} >= {"children", "judged", "own"} and all(p.count("Join") == 1 for what, p in plans if what in ("children", "judged", "own"))
    assert "Join" not in dict(plans)["framed"]
