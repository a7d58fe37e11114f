"""Queries over documents of many shapes: one for each thing that a document or a context can say.

Every customer is written into a document by a template ($k its key, $n its
name); the SQL writes the same into the document that must come out.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals as lit
from tessera.operators import compact, frame, graph, rdf, tree
from tessera.operators.expand import Expanded, expand

EX = "http://ex.org/"
V = {"@vocab": EX}
ME = "http://ex.org/c/$k"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: (url, document) of remote contexts: a chain of five, and one to import.
REMOTE = [(f"http://ctx.org/c{i}", {"@context": f"c{i + 1}"}) for i in range(5)] + [("http://ctx.org/c5", {"@context": {"name": EX + "deep"}}), ("http://ctx.org/base", {"@context": {"name": EX + "imported"}})]


def text_of(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def documents(spark, sf_dir: str, template: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").cast("long").alias("doc_id"), F.replace(F.replace(F.lit(template), F.lit("$k"), F.col("c_custkey").cast("string")), F.lit("$n"), F.col("c_name")).alias("doc"))


def expanded(spark, sf_dir: str, template: str, **options) -> Expanded:
    remote = spark.createDataFrame([(u, json.dumps(d)) for u, d in REMOTE], "url string, document string") if "http://ctx.org/" in template else None
    return expand(documents(spark, sf_dir, template), remote=remote, **options)


def wanted(want: str) -> str:
    quoted = want.replace("'", "''")
    return f"SELECT c_custkey::BIGINT AS doc_id, replace(replace('{quoted}', '$k', c_custkey::VARCHAR), '$n', c_name) AS doc FROM customer"


def expands(name: str, doc, want, **options) -> None:
    template = json.dumps(doc)
    QUERIES[f"expand_{name}"] = lambda spark, sf_dir: tree.expanded_json(expanded(spark, sf_dir, template, **options).tree)
    ORACLE[f"expand_{name}"] = wanted(text_of(want))


def fails(name: str, doc, code: str, **options) -> None:
    template = json.dumps(doc)
    QUERIES[f"error_{name}"] = lambda spark, sf_dir: expanded(spark, sf_dir, template, **options).errors
    ORACLE[f"error_{name}"] = f"SELECT c_custkey::BIGINT AS doc_id, '{code}' AS code FROM customer"


def compacts(name: str, doc, context: dict, want: dict) -> None:
    template, shown = json.dumps(doc), text_of(context)
    QUERIES[f"compact_{name}"] = lambda spark, sf_dir: compact.compact_json(expanded(spark, sf_dir, template).tree, shown)[0]
    ORACLE[f"compact_{name}"] = wanted('{"@context":' + shown + "," + text_of(want)[1:])


def value(v, **more) -> list:
    return [{"@value": v, **more}]


expands("json", {"@context": {**V, "knows": {"@type": "@id"}}, "@id": ME, "@type": "Customer", "name": "$n", "knows": EX + "x", "n": 1.5, "nested": {"deep": [True, None, "s"]}},
        [{"@id": ME, "@type": [EX + "Customer"], EX + "name": value("$n"), EX + "knows": [{"@id": EX + "x"}], EX + "n": value(1.5), EX + "nested": [{EX + "deep": [{"@value": True}, {"@value": "s"}]}]}])
expands("embedded", {"@context": V, "@id": ME, "p": {"@context": {"@vocab": "http://in/"}, "@id": EX + "b", "name": "$n"}},
        [{"@id": ME, EX + "p": [{"@id": EX + "b", "http://in/name": value("$n")}]}])
expands("null_context", {"@context": V, "@id": ME, "p": {"@context": None, "@id": EX + "b", "gone": 1, "http://kept": "$n"}},
        [{"@id": ME, EX + "p": [{"@id": EX + "b", "http://kept": value("$n")}]}])
expands("scoped", {"@context": {**V, "Customer": {"@id": EX + "Customer", "@context": {"name": "http://foaf/name"}}}, "@id": ME, "@type": "Customer", "name": "$n", "knows": {"@id": EX + "b", "name": "Bo"}},
        [{"@id": ME, "@type": [EX + "Customer"], "http://foaf/name": value("$n"), EX + "knows": [{"@id": EX + "b", EX + "name": value("Bo")}]}])
expands("property_scoped", {"@context": {**V, "in": {"@id": EX + "in", "@context": {"name": "http://scoped/name"}}}, "@id": ME, "name": "$n", "in": {"name": "$n", "r": {"name": "$n"}}},
        [{"@id": ME, EX + "name": value("$n"), EX + "in": [{"http://scoped/name": value("$n"), EX + "r": [{"http://scoped/name": value("$n")}]}]}])
expands("propagate", {"@context": {"@propagate": False, **V}, "@id": ME, "p": {"@id": EX + "b", "gone": 1, "http://kept": "$n"}},
        [{"@id": ME, EX + "p": [{"@id": EX + "b", "http://kept": value("$n")}]}])
expands("protected", {"@context": [{**V, "@protected": True, "name": EX + "kept"}, {"name": EX + "kept"}], "@id": ME, "name": "$n"},
        [{"@id": ME, EX + "kept": value("$n")}])
expands("remote_chain", {"@context": ["http://ctx.org/c0", V], "@id": ME, "name": "$n"}, [{"@id": ME, EX + "deep": value("$n")}])
expands("import", {"@context": {**V, "@import": "http://ctx.org/base"}, "@id": ME, "name": "$n", "other": 2}, [{"@id": ME, EX + "imported": value("$n"), EX + "other": value(2)}])
expands("aliases", {"@context": {**V, "id": "@id", "type": "@type", "value": "@value", "lang": "@language", "list": "@list", "set": "@set", "graph": "@graph", "rev": "@reverse"}, "id": ME, "p": {"value": "$n", "lang": "EN"}, "q": {"value": "3", "type": "date"}, "l": {"list": [1]}, "s": {"set": [2]}, "rev": {"parent": {"id": EX + "r"}}, "graph": {"id": EX + "g", "x": 1}},
        [{"@id": ME, EX + "p": value("$n", **{"@language": "en"}), EX + "q": value("3", **{"@type": EX + "date"}), EX + "l": [{"@list": value(1)}], EX + "s": value(2), "@reverse": {EX + "parent": [{"@id": EX + "r"}]}, "@graph": [{"@id": EX + "g", EX + "x": value(1)}]}])
expands("nest", {"@context": {**V, "labels": "@nest"}, "@id": ME, "labels": [{"name": "$n"}, {"labels": {"deep": 1}}], "@nest": {"plain": 2}},
        [{"@id": ME, EX + "name": value("$n"), EX + "deep": value(1), EX + "plain": value(2)}])
expands("nested_lists", {"@context": {**V, "l": {"@container": "@list"}}, "@id": ME, "l": [[1, "$n"], [[3]], []]},
        [{"@id": ME, EX + "l": [{"@list": [{"@list": [{"@value": 1}, {"@value": "$n"}]}, {"@list": [{"@list": value(3)}]}, {"@list": []}]}]}])
expands("graph_container", {"@context": {**V, "g": {"@container": "@graph"}, "h": {"@container": ["@graph", "@id"]}, "i": {"@container": ["@graph", "@index"]}}, "@id": ME, "g": {"name": "$n"}, "h": {EX + "g/$k": {"name": "$n"}}, "i": {"x": {"name": "$n"}}},
        [{"@id": ME, EX + "g": [{"@graph": [{EX + "name": value("$n")}]}], EX + "h": [{"@id": EX + "g/$k", "@graph": [{EX + "name": value("$n")}]}], EX + "i": [{"@index": "x", "@graph": [{EX + "name": value("$n")}]}]}])
expands("index_property", {"@context": {**V, "i": {"@container": "@index", "@index": "category"}}, "@id": ME, "i": {"$n": {"@id": EX + "b"}}},
        [{"@id": ME, EX + "i": [{"@id": EX + "b", EX + "category": value("$n")}]}])
expands("included", {"@context": V, "@id": ME, "@included": [{"@id": EX + "b", "name": "$n"}]}, [{"@id": ME, "@included": [{"@id": EX + "b", EX + "name": value("$n")}]}])
expands("base", {"@context": {"@base": "http://base.org/a/b", "p": EX + "p"}, "@id": "../c/$k", "p": {"@context": {"@base": None}, "@id": "left", "p": 1}},
        [{"@id": "http://base.org/c/$k", EX + "p": [{"@id": "left", EX + "p": value(1)}]}])
expands("prefix_flag", {"@context": {"yes": "http://yes/", "no": {"@id": "http://no/"}, "set": {"@id": "http://set/", "@prefix": True}}, "@id": ME, "yes:p": "$n", "no:p": 1, "set:p": 2},
        [{"@id": ME, "http://yes/p": value("$n"), "no:p": value(1), "http://set/p": value(2)}])
expands("json_literal", {"@context": {**V, "j": {"@type": "@json"}}, "@id": ME, "j": {"b": [1.5, {"z": "$n", "a": None}], "a": {}}},
        [{"@id": ME, EX + "j": [{"@type": "@json", "@value": {"a": {}, "b": [1.5, {"a": None, "z": "$n"}]}}]}])
expands("language_direction", {"@context": {**V, "@language": "DE", "@direction": "ltr", "p": {"@language": None}, "q": {"@direction": None, "@language": "fr"}, "r": {"@direction": "rtl"}}, "@id": ME, "name": "$n", "p": "$n", "q": "$n", "r": "$n", "v": {"@value": "$n"}},
        [{"@id": ME, EX + "name": value("$n", **{"@language": "de", "@direction": "ltr"}), EX + "p": value("$n", **{"@direction": "ltr"}), EX + "q": value("$n", **{"@language": "fr"}), EX + "r": value("$n", **{"@language": "de", "@direction": "rtl"}), EX + "v": value("$n")}])
expands("coercion", {"@context": {**V, "v": {"@type": "@vocab"}, "i": {"@type": "@id"}, "n": {"@type": "@none"}, "d": {"@type": "date"}, "Thing": "http://thing/"}, "@id": ME, "v": "Thing", "i": EX + "x", "n": "$n", "d": ["2024", 7]},
        [{"@id": ME, EX + "v": [{"@id": "http://thing/"}], EX + "i": [{"@id": EX + "x"}], EX + "n": value("$n"), EX + "d": [{"@type": EX + "date", "@value": "2024"}, {"@type": EX + "date", "@value": 7}]}])
expands("empty_arrays", {"@context": V, "@id": ME, "e": [], "s": {"@set": []}, "l": {"@list": []}, "gone": None}, [{"@id": ME, EX + "e": [], EX + "s": [], EX + "l": [{"@list": []}]}])
expands("reverse_terms", {"@context": {**V, "child": {"@reverse": EX + "parent", "@type": "@id"}}, "@id": ME, "child": [EX + "x", {"@id": EX + "y", "name": "$n"}], "@reverse": {"child": {"@id": EX + "up"}}},
        [{"@id": ME, EX + "parent": [{"@id": EX + "up"}], "@reverse": {EX + "parent": [{"@id": EX + "x"}, {"@id": EX + "y", EX + "name": value("$n")}]}}])
expands("maps", {"@context": {**V, "l": {"@container": "@language"}, "i": {"@container": "@index"}, "d": {"@container": "@id"}, "t": {"@container": "@type"}, "none": "@none"}, "@id": ME, "l": {"en": "$n", "none": ["x"]}, "i": {"k": "v"}, "d": {EX + "d": {"name": "$n"}, "@none": {"name": "y"}}, "t": {"T": {"@type": "U", "name": "$n"}}},
        [{"@id": ME, EX + "l": [{"@value": "$n", "@language": "en"}, {"@value": "x"}], EX + "i": value("v", **{"@index": "k"}), EX + "d": [{EX + "name": value("y")}, {"@id": EX + "d", EX + "name": value("$n")}], EX + "t": [{"@type": [EX + "T", EX + "U"], EX + "name": value("$n")}]}])
expands("expand_context", {"@id": ME, "name": "$n"}, [{"@id": ME, EX + "given": value("$n")}], context=json.dumps({"name": EX + "given"}))

expands("terms", {"@context": {**V, "gone": None, "lost": {"@id": None}, "named": {"@id": "http://n/named"}, EX + "iri": {"@type": "@id"}, "z": EX + "same", "a": EX + "same", "@unknown": EX + "x", "@ignored": "http://i/", "made.up": "http://dotted/"}, "@id": ME, "gone": 1, "lost": 2, "named": "$n", EX + "iri": EX + "x", "z": 3, "a": ["$n", 4], "@unknown": 5, "@ignored": 6, "made.up": 7},
        [{"@id": ME, "http://n/named": value("$n"), EX + "iri": [{"@id": EX + "x"}], EX + "same": [{"@value": "$n"}, {"@value": 4}, {"@value": 3}], "http://dotted/": value(7)}])
expands("relative_vocab", {"@context": [V, {"@vocab": "in/"}, {"@vocab": "deep#"}], "@id": ME, "@type": "T", "name": "$n"}, [{"@id": ME, "@type": [EX + "in/deep#T"], EX + "in/deep#name": value("$n")}])
expands("opaque_base", {"@context": {"@base": "tag:example/foo/bar", "p": {"@id": EX + "p", "@type": "@id"}}, "@id": "$k", "p": ["../up", "/top", "#f", {"@id": "s", EX + "name": "$n"}]},
        [{"@id": "tag:example/foo/$k", EX + "p": [{"@id": "tag:example/up"}, {"@id": "tag:/top"}, {"@id": "tag:example/foo/bar#f"}, {"@id": "tag:example/foo/s", EX + "name": value("$n")}]}])
expands("set_keywords", {"@context": {**V, "@id": {"@container": "@set"}, "@type": {"@container": ["@set"], "@protected": True}}, "@id": ME, "@type": "T", "name": "$n"}, [{"@id": ME, "@type": [EX + "T"], EX + "name": value("$n")}])

fails("protected", {"@context": [{"@protected": True, "name": EX + "a"}, {"name": EX + "b"}], "name": "$n"}, "protected term redefinition")
fails("nullified", {"@context": [{"@protected": True, "name": EX + "a"}, None], "name": "$n"}, "invalid context nullification")
fails("colliding", {"@context": {**V, "id": "@id"}, "@id": ME, "id": EX, "name": "$n"}, "colliding keywords")
fails("safe_mode", {"@context": {"name": EX + "name"}, "name": "$n", "unmapped": 1}, "invalid property", safe=True)
fails("old_mode", {"@context": {"@version": 1.1, **V}, "name": "$n"}, "processing mode conflict", mode="json-ld-1.0")
fails("nesting", {"@context": V, "a": {"a": {"a": {"a": "$n"}}}}, "nesting too deep", max_depth=3)
fails("scoped", {"@context": {"a": {"@id": EX + "a", "@context": {"b": 7}}}, "a": "$n"}, "invalid scoped context")
fails("nest", {"@context": {**V, "n": "@nest"}, "n": "$n"}, "invalid @nest value")
fails("remote", {"@context": "http://ctx.org/missing", "name": "$n"}, "loading remote context failed")

#: Broken documents, each with its code.
BROKEN = [(({"@context": c, EX + "p": "$n"}), code) for c, code in (
    ({"": EX}, "invalid term definition"), ({"./a": EX + "a"}, "invalid IRI mapping"), ({"../a": {"@id": EX + "a"}}, "invalid term definition"), ({"@id": {"@id": EX}}, "keyword redefinition"), ({"@id": {"@container": "@list"}}, "keyword redefinition"),
    ({"@type": {"@protected": True}}, "keyword redefinition"), ({"@type": "@id"}, "keyword redefinition"), ([{"@type": {"@container": "@set", "@protected": True}}, {"@type": {"@container": "@set"}}], "protected term redefinition"), ([{"@protected": True, "@id": {"@container": "@set"}}, {"@id": 7}], "protected term redefinition"),
    ({"@graph": EX}, "keyword redefinition"), ({"a": {"@id": EX + "a", "@type": 7}}, "invalid type mapping"), ({"a": {"@id": EX + "a", "@container": "@type", "@type": EX + "T"}}, "invalid type mapping"), ({"a": "http://a/", "a:b": EX + "x"}, "invalid IRI mapping"), ({"a": {"@reverse": EX + "p", "@nest": "n"}}, "invalid reverse property"),
    ({"a": 7}, "invalid term definition"), (7, "invalid local context"), ({"@base": 7}, "invalid base IRI"), ({"@vocab": 7}, "invalid vocab mapping"), ({"@language": 7}, "invalid default language"), ({"@direction": "up"}, "invalid base direction"), ({"@version": 1.0}, "invalid @version value"),
    ({"@propagate": 7}, "invalid @propagate value"), ({"@import": 7}, "invalid @import value"), ({"a": {"@id": EX + "a", "@language": 7}}, "invalid language mapping"), ({"a": "@context"}, "invalid keyword alias"), ({"a": {"@id": EX + "a", "@protected": 7}}, "invalid @protected value"), ({"a": {"@id": EX + "a", "@direction": "up"}}, "invalid base direction"),
)]
BROKEN += [({"@context": V, **d}, code) for d, code in (
    ({"@id": 7, "p": "$n"}, "invalid @id value"), ({"p": {"@value": {"a": 1}}}, "invalid value object value"), ({"p": {"@value": "x", "@type": EX + "T", "@language": "en"}}, "invalid value object"), ({"p": {"@value": 1, "@language": "en"}}, "invalid language-tagged value"), ({"p": {"@value": "x", "@type": ["a"]}}, "invalid typed value"),
    ({"p": {"@list": [1], "@id": EX}}, "invalid set or list object"), ({"p": {"@index": 7, "@value": 1}}, "invalid @index value"), ({"@reverse": 7}, "invalid @reverse value"), ({"@reverse": {"p": "$n"}}, "invalid reverse property value"), ({"@included": "$n"}, "invalid @included value"), ({"p": {"@value": "x", "@direction": "up"}}, "invalid base direction"),
    ({"@context": {**V, "l": {"@container": "@language"}}, "l": {"en": 7}}, "invalid language map value"), ({"@reverse": {"@id": ME}}, "invalid reverse property map"), ({"p": {"@type": {"a": 1}}}, "invalid type value"), ({"@nest": "$n"}, "invalid @nest value"),
)]


def _broken(spark, sf_dir):
    """Every customer's key deals it one of the broken documents."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    doc = F.get(F.array(*[F.lit(json.dumps(d)) for d, _ in BROKEN]), (F.col("c_custkey") % len(BROKEN)).cast("int"))
    return expand(c.select(F.col("c_custkey").cast("long").alias("doc_id"), F.replace(F.replace(doc, F.lit("$k"), F.col("c_custkey").cast("string")), F.lit("$n"), F.col("c_name")).alias("doc"))).errors


QUERIES["error_catalogue"] = _broken
ORACLE["error_catalogue"] = "SELECT c_custkey::BIGINT AS doc_id, (list_value(" + ", ".join(f"'{code}'" for _, code in BROKEN) + f"))[c_custkey % {len(BROKEN)} + 1] AS code FROM customer"

compacts("json", [{"@id": ME, "@type": [EX + "T"], EX + "name": value("$n"), EX + "nested": [{"@id": EX + "b", EX + "n": [{"@value": 1}, {"@value": True}]}], EX + "d": value("2024", **{"@type": EX + "date"}), EX + "l": [{"@list": [{"@value": 1}, {"@list": value(2)}]}]}],
         {**V, "id": "@id", "type": "@type", "d": {"@type": EX + "date"}, "l": {"@container": "@list"}},
         {"id": ME, "type": "T", "name": "$n", "nested": {"id": EX + "b", "n": [1, True]}, "d": "2024", "l": [1, [2]]})
compacts("maps", [{"@id": ME, EX + "lang": [{"@value": "$n", "@language": "en"}, {"@value": "y"}], EX + "i": [{"@value": "v", "@index": "k"}, {"@value": "w", "@index": "k"}], EX + "m": [{"@id": EX + "m1", EX + "x": value(1)}], EX + "t": [{"@id": EX + "t1", "@type": [EX + "A", EX + "B"], EX + "x": value(2)}]}],
         {**V, "lang": {"@container": "@language"}, "i": {"@container": "@index"}, "m": {"@container": "@id"}, "t": {"@container": "@type"}},
         {"@id": ME, "lang": {"en": "$n", "@none": "y"}, "i": {"k": ["v", "w"]}, "m": {EX + "m1": {"x": 1}}, "t": {"A": {"@id": EX + "t1", "@type": "B", "x": 2}}})
compacts("reverse", [{"@id": ME, "@reverse": {EX + "parent": [{"@id": EX + "c"}], EX + "other": [{"@id": EX + "d", EX + "name": value("$n")}]}}],
         {**V, "child": {"@reverse": EX + "parent", "@type": "@id"}}, {"@id": ME, "child": EX + "c", "@reverse": {"other": {"@id": EX + "d", "name": "$n"}}})
compacts("graphs", [{"@id": ME, EX + "g": [{"@graph": [{"@id": EX + "s", EX + "name": value("$n")}]}], EX + "h": [{"@id": EX + "g1", "@graph": [{"@id": EX + "s", EX + "name": value("$n")}]}]}],
         {**V, "g": {"@container": "@graph"}, "h": {"@container": ["@graph", "@id"]}}, {"@id": ME, "g": {"@id": EX + "s", "name": "$n"}, "h": {EX + "g1": {"@id": EX + "s", "name": "$n"}}})
compacts("nest", [{"@id": ME, EX + "name": value("$n"), EX + "e": [], EX + "s": value(1), EX + "j": [{"@type": "@json", "@value": {"a": [1]}}]}],
         {**V, "labels": "@nest", "name": {"@nest": "labels"}, "s": {"@container": "@set"}, "j": {"@type": "@json"}}, {"@id": ME, "labels": {"name": "$n"}, "e": [], "s": [1], "j": {"a": [1]}})
compacts("relative", [{"@id": "http://base.org/a/$k", EX + "r": [{"@id": "http://base.org/a/y"}, {"@id": "http://base.org/z"}]}, {"@id": EX + "b", EX + "name": value("$n")}],
         {**V, "@base": "http://base.org/a/doc", "r": {"@type": "@id"}}, {"@graph": [{"@id": "$k", "r": ["y", "../z"]}, {"@id": EX + "b", "name": "$n"}]})
compacts("scoped", [{"@id": ME, "@type": [EX + "P"], EX + "name": value("$n"), EX + "knows": [{"@id": EX + "b", EX + "name": value("Bo")}]}],
         {**V, "P": {"@id": EX + "P", "@context": {"nom": EX + "name"}}}, {"@id": ME, "@type": "P", "nom": "$n", "knows": {"@id": EX + "b", "name": "Bo"}})
compacts("aliases", [{"@id": ME, "@index": "ii", "@included": [{"@id": EX + "i", EX + "name": value("$n", **{"@language": "en"})}]}],
         {**V, "inc": "@included", "ix": "@index", "val": "@value", "lang": "@language"}, {"@id": ME, "ix": "ii", "inc": {"@id": EX + "i", "name": {"lang": "en", "val": "$n"}}})
compacts("index_property", [{"@id": ME, EX + "i": [{"@id": EX + "b", EX + "category": value("z$n"), EX + "n": value(1)}, {"@id": EX + "c", EX + "category": [{"@value": "k1"}, {"@value": "k2"}]}, {"@id": EX + "d", EX + "n": value(2)}, {"@id": EX + "e", EX + "category": value("k1", **{"@language": "en"})}]}],
         {**V, "i": {"@container": "@index", "@index": "category"}}, {"@id": ME, "i": {"z$n": {"@id": EX + "b", "n": 1}, "@none": {"@id": EX + "d", "n": 2}, "k1": [{"@id": EX + "c", "category": "k2"}, {"@id": EX + "e"}]}})


def _confused(spark, sf_dir):
    return compact.compact_json(expanded(spark, sf_dir, json.dumps([{"@id": ME, "tag:x": value("$n")}])).tree, '{"tag":"http://tag/"}')[1]


QUERIES["error_confused"], ORACLE["error_confused"] = _confused, "SELECT c_custkey::BIGINT AS doc_id, 'IRI confused with prefix' AS code FROM customer"


def _lists_back(spark, sf_dir):
    """Lists of lists to quads and back."""
    e = expanded(spark, sf_dir, json.dumps({"@context": {**V, "l": {"@container": "@list"}}, "@id": ME, "l": [[1, "$n"], [], [[3]]]}))
    return graph.from_rdf(rdf.to_rdf(e.statements), native_types=True).select("doc_id", F.col("node").alias("doc"))


QUERIES["from_rdf_nested_lists"], ORACLE["from_rdf_nested_lists"] = _lists_back, wanted(text_of({"@id": ME, EX + "l": [{"@list": [{"@list": [{"@value": 1}, {"@value": "$n"}]}, {"@list": []}, {"@list": [{"@list": value(3)}]}]}]}))


def _from_quads(spark, sf_dir):
    """Types as values of rdf:type, a named graph, a list, and native values, by way of quads."""
    e = expanded(spark, sf_dir, json.dumps({"@context": V, "@id": ME, "@type": "T", "name": "$n", "l": {"@list": [1, True]}, "@graph": {"@id": EX + "s", "@type": "U", "p": [2.5, 2.5]}}))
    return graph.from_rdf_json(rdf.to_rdf(e.statements), native_types=True, rdf_type=True)


QUERIES["from_rdf_json"] = _from_quads
_RDF_TYPE = lambda t: {lit.TYPE: [{"@id": EX + t}]}
ORACLE["from_rdf_json"] = wanted("[" + text_of({"@graph": [{"@id": EX + "s", EX + "p": value(2.5), **_RDF_TYPE("U")}]})[:-1].replace('{"@graph"', '{"@id":"' + ME + '","@graph"') + "," + text_of({EX + "l": [{"@list": [{"@value": 1}, {"@value": True}]}], EX + "name": value("$n"), **_RDF_TYPE("T")})[1:] + "]")


def _flattened(spark, sf_dir):
    e = expanded(spark, sf_dir, json.dumps({"@context": V, "@id": ME, "name": "$n", "knows": {"@id": EX + "b", "l": {"@list": [1]}}, "@graph": {"@id": EX + "s", "p": 1}}))
    return graph.flatten(e.statements, native_types=True)


QUERIES["flatten_json"], ORACLE["flatten_json"] = _flattened, wanted(text_of([{"@id": EX + "b", EX + "l": [{"@list": value(1)}]}, {"@graph": [{"@id": EX + "s", EX + "p": value(1)}], "@id": ME, EX + "knows": [{"@id": EX + "b"}], EX + "name": value("$n")}]).replace('{"@graph":[{"@id":"' + EX + 's","' + EX + 'p":[{"@value":1}]}],"@id":"' + ME + '"', '{"@id":"' + ME + '","@graph":[{"@id":"' + EX + 's","' + EX + 'p":[{"@value":1}]}]'))


def _conflicts(spark, sf_dir):
    e = expanded(spark, sf_dir, json.dumps({"@context": V, "a": {"@id": ME, "@index": "one"}, "b": {"@id": ME, "@index": "two"}, "name": "$n"}))
    return graph.conflicting_indexes(e.statements)


QUERIES["error_conflicting_indexes"], ORACLE["error_conflicting_indexes"] = _conflicts, "SELECT c_custkey::BIGINT AS doc_id, 'conflicting indexes' AS code FROM customer"


def _unsafe_terms(spark, sf_dir):
    e = expanded(spark, sf_dir, json.dumps({"@id": ME, "http://p/x y": "$n", "http://ok": 1}))
    return rdf.ill_formed(e.statements)


QUERIES["error_invalid_term"], ORACLE["error_invalid_term"] = _unsafe_terms, "SELECT c_custkey::BIGINT AS doc_id, 'invalid term' AS code FROM customer"


def frames(name: str, doc, shape: dict, want: dict, **options) -> None:
    """A query that frames every document, and another that names documents which can't be."""
    template = json.dumps(doc)
    QUERIES[f"frame_{name}"] = lambda spark, sf_dir: frame.frame_json(expanded(spark, sf_dir, template).statements, shape, **options)[0]
    context = '{"@context":' + text_of(shape["@context"]) + ","
    ORACLE[f"frame_{name}"] = wanted(context + text_of(want)[1:])


_C = {"@context": V}
#: A customer, a nation and a region that name each other in circles.
_CIRCLE = [{**_C, "@id": ME, "@type": "Customer", "name": "$n", "nation": {"@id": EX + "n/$k", "@type": "Nation", "region": {"@id": EX + "r/$k", "size": 5, "best": {"@id": ME}, "holds": {"@id": EX + "n/$k"}}}, "region": {"@id": EX + "r/$k"}}]
_REGION = {"@id": EX + "r/$k", "size": 5, "best": {"@id": ME}, "holds": {"@id": EX + "n/$k"}}
_NATION = {"@id": EX + "n/$k", "@type": "Nation", "region": _REGION}
_LEFT = {"@id": ME, "@type": "Customer", "name": "$n"}
_ID = lambda x: {"@id": x["@id"]}
frames("once", _CIRCLE, {**_C, "@type": "Customer"}, {**_LEFT, "nation": _NATION, "region": _ID(_REGION)})
frames("first", _CIRCLE, {**_C, "@type": "Customer", "@embed": "@first"}, {**_LEFT, "nation": _NATION, "region": _ID(_REGION)})
frames("last", _CIRCLE, {**_C, "@type": "Customer"}, {**_LEFT, "nation": _ID(_NATION), "region": {**_REGION, "holds": {**_NATION, "region": _ID(_REGION)}}}, embed="@last")
frames("cycle", _CIRCLE, {**_C, "@type": "Customer", "@embed": "@always"}, {**_LEFT, "nation": _NATION, "region": {**_REGION, "holds": {**_NATION, "region": _ID(_REGION)}}})
frames("link", _CIRCLE, {**_C, "@type": "Customer", "@embed": "@link"}, {**_LEFT, "nation": _NATION, "region": {**_REGION, "holds": {**_NATION, "region": _ID(_REGION)}}})
frames("never", _CIRCLE, {**_C, "@type": "Customer", "@embed": "@never"}, {**_LEFT, "nation": _ID(_NATION), "region": _ID(_REGION)})
frames("explicit", _CIRCLE, {**_C, "@type": "Customer", "@explicit": True, "nation": {"@explicit": True, "region": {}}}, {"@id": ME, "@type": "Customer", "nation": _NATION})
frames("nested_never", _CIRCLE, {**_C, "@type": "Customer", "nation": {"region": {"@embed": "@never"}}}, {**_LEFT, "nation": {**_NATION, "region": _ID(_REGION)}, "region": _REGION})
frames("unfit", _CIRCLE, {**_C, "@type": "Customer", "nation": {"@type": "Else"}, "region": {"size": {"@value": 5}}}, {**_LEFT, "nation": None, "region": {**_REGION, "holds": {**_NATION, "region": _ID(_REGION)}}})
#: Two graphs that customers name, and a default graph.
_GRAPHS = [{**_C, "@id": ME, "@type": "Customer", "name": "$n", "@graph": [{"@id": EX + "o/$k", "@type": "Order", "part": {"@id": EX + "p/$k"}}, {"@id": EX + "p/$k", "@type": "Part", "n": 1}]}, {**_C, "@id": EX + "other", "@type": "Thing"}]
frames("graphs", _GRAPHS, {**_C, "@type": "Customer", "@graph": {}}, {**_LEFT, "@graph": [{"@id": EX + "o/$k", "@type": "Order", "part": {"@id": EX + "p/$k", "@type": "Part", "n": 1}}]})
frames("graph_parts", _GRAPHS, {**_C, "@type": "Customer", "@graph": {"@type": "Part"}}, {**_LEFT, "@graph": [{"@id": EX + "p/$k", "@type": "Part", "n": 1}]})
frames("default_graph", _GRAPHS, {**_C, "@type": "Customer"}, {**_LEFT, "@graph": [{"@id": EX + "o/$k", "@type": "Order", "part": {"@id": EX + "p/$k", "@type": "Part", "n": 1}}]}, default_graph=True)
frames("merged_graphs", _GRAPHS, {**_C, "@type": "Order"}, {"@id": EX + "o/$k", "@type": "Order", "part": {"@id": EX + "p/$k", "@type": "Part", "n": 1}})
frames("included", _CIRCLE, {**_C, "@type": "Customer", "@explicit": True, "name": {}, "@included": {"@type": "Nation"}}, {**_LEFT, "@included": {**_NATION}})
_TEXTS = [{**_C, "@id": ME, "@type": "Customer", "a": "a\":null}", "b": "@null", "c": "\":null,", "j": {"@type": "@json", "@value": {"k": None, "n": "$n"}}, "none": [], "l": {"@list": [1, {"@id": EX + "x", "size": True}, {"@list": ["1", 2.5]}]}}]
frames("null_texts", _TEXTS, {**_C, "@type": "Customer", "missing": {}, "said": {"@default": "@null"}, "given": {"@default": "null"}},
       {"@id": ME, "@type": "Customer", "a": "a\":null}", "b": "@null", "c": "\":null,", "j": {"@type": "@json", "@value": {"k": None, "n": "$n"}}, "l": {"@list": [1, {"@id": EX + "x", "size": True}, {"@list": ["1", 2.5]}]}, "missing": None, "said": None, "given": "null"})
frames("list_items", [{**_C, "@id": ME, "@type": "Customer", "l": {"@list": [{"@id": EX + "x", "size": 1, "name": "$n"}, 3]}}], {**_C, "l": {"@list": [{"@explicit": True, "name": {}}]}}, {"@id": ME, "@type": "Customer", "l": {"@list": [{"@id": EX + "x", "name": "$n"}, 3]}})
frames("omit_graph", _CIRCLE, {**_C, "@type": "Customer", "@explicit": True}, {"@graph": [{"@id": ME, "@type": "Customer"}]}, omit_graph=False)
frames("blank_names", [{**_C, "@id": ME, "@type": "Customer", "p": {"name": "$n", "q": {"n": 2}}}], {**_C, "@type": "Customer"}, {"@id": ME, "@type": "Customer", "p": {"name": "$n", "q": {"n": 2}}})


def _flattened_as_it_is(spark, sf_dir):
    """Native values, the same as strings with a type, empty arrays and an index."""
    doc = {**_C, "@id": ME, "e": [], "i": 1, "t": {"@value": "1", "@type": lit.INTEGER}, "d": {"@value": 1, "@type": lit.DOUBLE}, "b": True, "f": 1.5, "s": {"@set": []}, "both": [1, {"@value": "1", "@type": lit.INTEGER}], "x": {"@id": EX + "x", "@index": "i", "name": "$n"}, "v": {"@value": "v", "@index": "k"}}
    return graph.flatten(expanded(spark, sf_dir, json.dumps(doc)).statements)


QUERIES["flatten_native"], ORACLE["flatten_native"] = _flattened_as_it_is, wanted(text_of([
    {"@id": ME, EX + "b": value(True), EX + "both": [{"@type": lit.INTEGER, "@value": "1"}, {"@value": 1}], EX + "d": [{"@type": lit.DOUBLE, "@value": 1}], EX + "e": [], EX + "f": value(1.5), EX + "i": value(1), EX + "s": [], EX + "t": [{"@type": lit.INTEGER, "@value": "1"}], EX + "v": [{"@index": "k", "@value": "v"}], EX + "x": [{"@id": EX + "x"}]},
    {"@id": EX + "x", "@index": "i", EX + "name": value("$n")},
]))

_TWO_INDEXES = json.dumps({"@context": V, "a": {"@id": ME, "@index": "one"}, "b": {"@id": ME, "@index": "two"}, "name": "$n"})
QUERIES["error_flatten"] = lambda spark, sf_dir: graph.flatten_errors(expanded(spark, sf_dir, _TWO_INDEXES).statements)
QUERIES["error_frame"] = lambda spark, sf_dir: frame.frame_json(expanded(spark, sf_dir, _TWO_INDEXES).statements, {**_C, "name": {}})[1]
ORACLE["error_flatten"] = ORACLE["error_frame"] = ORACLE["error_conflicting_indexes"]


def _framed(spark, sf_dir):
    """Framed and compacted, blank nodes that are named once without a name."""
    context = {**V, "knows": {"@type": "@id"}}
    e = expanded(spark, sf_dir, json.dumps([{"@context": V, "@id": ME, "@type": "Customer", "name": "$n", "knows": {"@type": "Friend", "name": "Bo"}}, {"@context": V, "@id": EX + "other", "@type": "Thing"}]))
    return frame.frame_json(e.statements, {"@context": context, "@type": "Customer", "knows": {"@type": "Friend"}, "age": {"@default": 7}, "none": {}})[0]


_FRAME = {**V, "knows": {"@type": "@id"}}
QUERIES["frame_json"], ORACLE["frame_json"] = _framed, wanted('{"@context":' + text_of(_FRAME) + "," + text_of({"@id": ME, "@type": "Customer", "name": "$n", "knows": {"@type": "Friend", "name": "Bo"}, "age": 7, "none": None})[1:])
