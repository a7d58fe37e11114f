"""Compaction: an expanded tree to short names under a target context.

The context is turned round once: for every IRI the terms that stand for it,
each with its container signature and the types or languages it is meant for.
Every row picks its term from that list, in order of preference; then objects
are put together from the inside, values under language, index, id, type and
graph containers as maps. Where the context has scoped contexts, rows pick
their terms a depth a round, from the outside.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import iri as iris
from tessera.functions import literals as lit
from tessera.operators.context import Contexts, expand_iri, step
from tessera.operators.tree import NO_DOC, joined, put_together
from tessera.sources.shared import split_code, written

_ALIASED = ["@id", "@type", "@value", "@language", "@direction", "@index", "@graph", "@included", "@reverse", "@list", "@none"]
_LAST = 1 << 30


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def inverse(contexts: DataFrame) -> DataFrame:
    """contexts plus by_iri (IRI -> its terms, shortest then least first, with signature and slots), prefixes (term, IRI) and keyword (keyword -> its shortest name)."""
    default = F.coalesce(F.lower("language"), F.lit("@none"))
    default = F.when(F.col("direction").isNotNull(), F.concat(F.coalesce("language", F.lit("")), F.lit("_"), "direction")).otherwise(default)

    def slots(d):
        tag = lambda kind, x: F.concat(F.lit(kind), x)
        spoken = d["language"].isNotNull() | d["plain"]
        directed = d["direction"].isNotNull() | d["undirected"]
        both = F.concat(F.coalesce(d["language"], F.lit("")), F.lit("_"), F.coalesce(d["direction"], F.lit("")))
        return (
            F.when(d["reverse"], F.array(F.lit("T@reverse")))
            .when(d["type"] == "@none", F.array(F.lit("L@any"), F.lit("T@any")))
            .when(d["type"].isNotNull(), F.array(tag("T", d["type"])))
            .when(spoken & directed, F.array(tag("L", F.when(both == "_", "@null").when(d["direction"].isNull(), d["language"]).otherwise(both))))
            .when(spoken, F.array(tag("L", F.coalesce(d["language"], F.lit("@null")))))
            .when(directed, F.array(tag("L", F.when(d["direction"].isNull(), "@none").otherwise(F.concat(F.lit("_"), d["direction"])))))
            .otherwise(F.array(tag("L", default), F.lit("L@none"), F.lit("T@none")))
        )

    shape = lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("term"), F.when(F.size(e["value"]["container"]) == 0, "@none").otherwise(F.array_join(F.array_sort(e["value"]["container"]), "")).alias("sig"), slots(e["value"]).alias("slots"), e["value"].alias("def"))
    entries = F.filter(F.map_entries("terms"), lambda e: e["value"]["iri"].isNotNull())
    order = lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["term"] < b["term"], -1).otherwise(1)
    c = contexts.withColumn("all_", F.array_sort(F.transform(entries, shape), order))
    named = lambda which: F.array_distinct(F.transform(which, lambda x: x["def"]["iri"]))
    c = c.withColumn("by_iri", F.map_from_entries(F.transform(named("all_"), lambda i: F.struct(i.alias("key"), F.filter("all_", lambda x: x["def"]["iri"] == i).alias("value")))))
    c = c.withColumn("prefixes", F.transform(F.filter("all_", lambda x: x["def"]["prefix"]), lambda x: F.struct(x["term"].alias("term"), x["def"]["iri"].alias("iri"))))
    keyword = F.create_map(*[x for k in _ALIASED for x in (F.lit(k), F.coalesce(F.get(F.element_at("by_iri", F.lit(k)), F.lit(0))["term"], F.lit(k)))])
    return c.withColumn("keyword", keyword).drop("all_")


def _suffix(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.lit(_LAST))


def short_iri(iri: Column, vocab: bool = True) -> Column:
    """A full name, a column, in its shortest form: a plain term, vocabulary suffix, prefix form (shortest, then least), relative to the base, or as it is."""
    i = iri
    suffix = F.when(i.startswith(F.col("vocab")) & (F.length(i) > F.length("vocab")), _suffix(i, F.length("vocab")))
    forms = F.transform(F.filter("prefixes", lambda p: i.startswith(p["iri"]) & (F.length(i) > F.length(p["iri"]))), lambda p: F.concat(p["term"], F.lit(":"), _suffix(i, F.length(p["iri"]))))
    forms = F.filter(forms, lambda f: F.coalesce(F.element_at("terms", f)["iri"] == i, F.lit(True)))
    best = F.array_min(F.transform(forms, lambda f: F.struct(F.length(f).alias("n"), f.alias("form"))))["form"]
    if not vocab:
        return F.coalesce(best, F.when(~i.startswith("_:"), iris.relative_to(F.col("base"), i)), i)
    plain = F.get(F.filter(F.element_at("by_iri", i), lambda t: F.exists(t["slots"], lambda s: s.isin("L@none", "L@null", "L@any")) & ~t["def"]["reverse"]), F.lit(0))["term"]
    keyword = F.when(i.startswith("@"), F.element_at("keyword", i))
    return F.coalesce(keyword, plain, F.when(~F.map_contains_key("terms", suffix), suffix), best, i)


def confused(iri: Column) -> Column:
    """Whether a name that is written in full reads as a prefix form."""
    prefix = F.substring_index(iri, ":", 1)
    return _no(F.contains(iri, F.lit(":")) & F.element_at("terms", prefix)["prefix"] & ~F.substring(iri, F.length(prefix) + 2, F.lit(2)).startswith("//"))


def _preferences(rows: DataFrame) -> DataFrame:
    """rows with containers and slots that fit their value, best first."""
    c = F.col
    leaf = c("at").isNull()
    is_list = c("is_list")
    literal = leaf & c("o_kind").isin("lit", "json", "null")
    ref = ~is_list & ~literal & (c("o_kind").isin("iri", "bnode"))
    said = F.when(literal, F.when(c("o_kind") == "json", F.lit("@json")).otherwise(F.get_json_object("json", "$['@type']")))
    tongue = F.when(c("direction").isNotNull(), F.concat(F.coalesce("language", F.lit("")), F.lit("_"), "direction")).otherwise(c("language"))
    value_slot = F.when(tongue.isNotNull(), F.concat(F.lit("L"), tongue)).when(said.isNotNull(), F.concat(F.lit("T"), said)).otherwise(F.lit("L@null"))
    items = F.when(c("list_size") == 0, F.lit("L@any")).otherwise(c("list_slot"))
    slot = F.when(c("rev"), F.lit("T@reverse")).when(is_list, items).when(literal, value_slot).otherwise(F.lit("T@id"))
    index = c("idx").isNotNull()
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    graphs = F.when(c("is_graph"), F.concat(F.when(index, lits("@graph@index", "@graph@index@set", "@index", "@index@set")).otherwise(none), F.when(c("named"), lits("@graph@id", "@graph@id@set")).otherwise(none), lits("@graph", "@graph@set", "@set"), F.when(~index, lits("@graph@index", "@graph@index@set")).otherwise(none), F.when(~c("named"), lits("@graph@id", "@graph@id@set")).otherwise(none)))
    containers = F.concat(
        F.when(index & ~c("is_graph"), lits("@index", "@index@set")).otherwise(none), F.coalesce(graphs, none), F.when(ref & ~c("is_graph"), lits("@id", "@id@set", "@type", "@set@type")).otherwise(none),
        F.when(is_list & ~index, lits("@list")).otherwise(none), F.when(literal & tongue.isNotNull() & ~index, lits("@language", "@language@set")).otherwise(none), lits("@set", "@none"),
        F.when(~index, lits("@index", "@index@set")).otherwise(none), F.when(literal & tongue.isNull() & said.isNull() & ~index, lits("@language", "@language@set")).otherwise(none),
    )
    rows = rows.withColumns({"said": said, "literal": literal, "containers": containers, "slot": slot, "full": F.when(c("rev"), c("s")).otherwise(c("o"))})
    by_vocab = lit.bound(short_iri(F.col("full")), lambda x: _no(F.element_at("terms", x)["iri"] == F.col("full")))
    ids = F.when(by_vocab, lits("T@vocab", "T@id")).otherwise(lits("T@id", "T@vocab"))
    both = F.when(F.contains("slot", F.lit("_")) & F.col("slot").startswith("L"), F.array(F.col("slot"), F.concat(F.lit("L_"), F.element_at(F.split("slot", "_"), -1)))).otherwise(F.array("slot"))
    wanted = F.when(F.col("slot") == "T@id", ids).when(F.col("slot") == "T@reverse", F.concat(F.array("slot"), ids)).otherwise(both)
    kind = F.substring("slot", 1, 1)
    return rows.withColumn("wanted", F.concat(wanted, F.array(F.concat(kind, F.lit("@none")), F.lit("L@any"), F.lit("T@any"))))


def _chosen(rows: DataFrame) -> DataFrame:
    """rows with the term (or short name) of their property, its definition, and what is wrong."""
    c = F.col
    rows = _preferences(rows)
    fit = lambda t: F.struct(F.array_position("containers", t["sig"]).alias("container"), F.array_min(F.transform(F.filter(t["slots"], lambda s: F.array_contains("wanted", s)), lambda s: F.array_position("wanted", s))).alias("slot"), t["n"].alias("n"), t["term"].alias("term"))
    fits = F.filter(F.transform(F.element_at("by_iri", c("p")), fit), lambda f: (f["container"] > 0) & f["slot"].isNotNull())
    term = F.array_min(fits)["term"]
    rows = rows.withColumn("term", F.when(c("p").isin(*_ALIASED), F.element_at("keyword", c("p"))).otherwise(term))
    rows = rows.withColumn("def", F.when(~c("p").startswith("@"), F.element_at("terms", c("term"))))
    name = short_iri(c("p"))
    # A reverse property without a reverse term stays under @reverse.
    rows = rows.withColumn("under_reverse", c("rev") & ~_no(c("def.reverse")))
    rows = rows.withColumn("def", F.when(~c("under_reverse"), c("def"))).withColumn("term", F.when(c("under_reverse") | c("term").isNull(), name).otherwise(c("term")))
    return rows.withColumn("wrong", F.when(c("def").isNull() & ~c("p").startswith("@") & (c("term") == c("p")) & confused(c("p")), "IRI confused with prefix"))


def _leaf_text(rows: DataFrame) -> DataFrame:
    """rows with the compact JSON of values, references and types as ``leaf``."""
    c = F.col
    key = lambda k: lit.json_string(F.element_at("keyword", F.lit(k)))
    member = lambda k, text: F.when(text.isNotNull(), F.concat(key(k), F.lit(":"), text))
    string = lambda x: F.when(x.isNotNull(), lit.json_string(x))
    has = lambda k: _no(F.array_contains("def.container", k))
    raw = F.to_json(F.try_variant_get(F.parse_json(F.when(c("literal"), c("json"))), "$['@value']", "variant"))
    # A literal's text is no name, and few names are asked for by vocabulary.
    by_vocab = ~_no(c("literal")) & ((c("p") == "@type") | (c("def.type") == "@vocab"))
    rows = rows.withColumns({"raw": raw, "id_short": F.when(~_no(c("literal")), short_iri(c("full"), vocab=False)), "id_vocab": F.when(by_vocab, short_iri(c("full"))), "type_short": F.when(c("said").isNotNull(), short_iri(c("said")))})
    own = F.when(_no(c("def.plain")), None).otherwise(F.coalesce("def.language", "own_language"))
    way = F.when(_no(c("def.undirected")), None).otherwise(F.coalesce("def.direction", "own_direction"))
    index = F.when(~has("@index"), c("idx"))
    text = F.substring("raw", 1, 1) == '"'
    in_map = has("@language")
    alike = c("language").eqNullSafe(own) & c("direction").eqNullSafe(way)
    bare = index.isNull() & F.when(c("said").isNotNull(), _no(c("said") == c("def.type"))).otherwise(~_no(c("def.type") == "@none") & (~text | (alike | in_map)) & (~text | ~_no(~c("def.type").isin("@id", "@vocab", "@none"))))
    whole = F.concat(F.lit("{"), joined(F.array_sort(F.filter(F.array(member("@type", string(c("type_short"))), member("@language", string(c("language"))), member("@direction", string(c("direction"))), member("@index", string(index)), member("@value", c("raw"))), lambda x: x.isNotNull()))), F.lit("}"))
    value = F.when(bare, c("raw")).otherwise(whole)
    name = F.when((c("p") == "@type") | (c("def.type") == "@vocab"), c("id_vocab")).otherwise(c("id_short"))
    as_name = (c("p") == "@type") | (c("def.type").isin("@id", "@vocab") & index.isNull())
    ref = F.when(_no(as_name), lit.json_string(name)).otherwise(F.concat(F.lit("{"), joined(F.array_sort(F.filter(F.array(member("@id", lit.json_string(name)), member("@index", string(index))), lambda x: x.isNotNull()))), F.lit("}")))
    return rows.withColumn("leaf", F.when(c("o_kind") == "null", "null").when(c("literal"), value).when(c("at").isNull() & c("json").isNotNull(), ref))


_KEEP = ["doc_id", "up", "at", "ord", "p", "rev", "named", "idx", "is_list", "is_graph", "term", "under_reverse", "json", "language", "o_kind", "o"]


def _facts(tree: DataFrame) -> DataFrame:
    """The tree with what term selection needs to know of objects: whether they are lists or graphs, and what a list's items have in common."""
    c = F.col
    listed = c("at").isNotNull() & (c("o").isNull() | (c("o_kind") == "list"))
    t = tree.withColumn("is_list", _no(listed))
    said = F.when(c("o_kind") == "json", F.lit("@json")).otherwise(F.get_json_object("json", "$['@type']"))
    tongue = F.when(c("direction").isNotNull(), F.concat(F.coalesce("language", F.lit("")), F.lit("_"), "direction")).otherwise(c("language"))
    literal = c("at").isNull() & c("o_kind").isin("lit", "json")
    slot = F.when(literal, F.when(tongue.isNotNull(), F.concat(F.lit("L"), tongue)).when(said.isNotNull(), F.concat(F.lit("T"), said)).otherwise(F.lit("L@null"))).otherwise(F.lit("T@id"))
    real = c("json").isNotNull() | c("at").isNotNull()
    # Only objects and lists have anything inside; what is common to items is asked of rows in lists alone.
    holder = ["doc_id", F.col("up").alias("at")]
    graphs = t.filter("up is not null").groupBy(*holder).agg(F.min(c("p") == "@graph").alias("only_graph"))
    lists = t.filter("up is not null and list is not null").groupBy(*holder).agg(F.count(F.when(real, 1)).alias("list_size"), F.min(slot).alias("least"), F.max(slot).alias("most"))
    kind = lambda s: F.substring(s, 1, 1)
    common = F.when(c("least") == c("most"), c("most")).when(kind("least") == kind("most"), F.concat(kind("most"), F.lit("@none"))).when(c("most").isNotNull(), "L@none")
    objects = t.filter("at is not null").join(graphs, ["doc_id", "at"], "left").join(lists, ["doc_id", "at"], "left")
    objects = objects.select(*t.columns, F.coalesce("list_size", F.lit(0).cast("long")).alias("list_size"), common.alias("list_slot"), (_no(c("only_graph")) & ~c("is_list")).alias("is_graph"))
    return objects.unionByName(t.filter("at is null").withColumns({"list_size": F.lit(0).cast("long"), "list_slot": F.lit(None).cast("string"), "is_graph": F.lit(False)}))


def _with_terms(tree: DataFrame, contexts: Contexts, key: str) -> DataFrame:
    """Every row with its term and its leaf text, under the context of the object it lies in."""
    facts = written(_facts(tree).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC))), "facts")
    turned = lambda: written(inverse(contexts.rows.select("ctx_key", "base", "vocab", "language", "direction", "terms")).withColumnsRenamed({"language": "own_language", "direction": "own_direction"}), "inverse")
    scoped = F.col("def.scoped")

    def pick(rows: DataFrame) -> DataFrame:
        # Written, as what lies below is picked from it.
        rows = _leaf_text(_chosen(rows.join(turned(), "ctx_key")))
        return rows.select(*[c for c in _KEEP], "ctx_key", F.struct(F.col("def.container").alias("container"), F.col("def.nest").alias("nest"), F.col("def.index").alias("index"), F.when(F.col("def.index").isNotNull(), expand_iri(F.col("def.index"), F.col("terms"), F.col("vocab"), None)).alias("index_iri"), F.col("def.type").alias("type"), scoped.alias("scoped"), F.col("def.scoped_base").alias("scoped_base")).alias("how"), "id_short", "id_vocab", "leaf", "wrong", F.element_at("keyword", F.lit("@none")).alias("none_name"), F.when(F.col("at").isNotNull(), F.col("keyword")).alias("keyword"))

    if not contexts.scoped:
        with split_code(facts.sparkSession):
            return written(pick(facts.withColumn("ctx_key", F.lit(key))), "terms")
    facts = facts.withColumn("depth", F.when(F.col("up").isNotNull(), F.size(F.split("up", "_"))).otherwise(0))
    depths = [r[0] for r in facts.select("depth").distinct().orderBy("depth").collect()]
    types = facts.filter("p = '@type'").groupBy("doc_id", F.col("up").alias("at")).agg(F.array_sort(F.collect_set("o")).alias("types"))
    held, out = facts.filter("false").select("doc_id", F.col("at").alias("up")).withColumn("ctx_key", F.lit(key)), []
    for d in depths:
        rows = facts.filter(F.col("depth") == d)
        rows = rows.withColumn("ctx_key", F.lit(key)) if d == 0 else rows.join(held, ["doc_id", "up"])
        with split_code(facts.sparkSession):
            rows = written(pick(rows), "terms")
        out.append(rows)
        inner = rows.filter("at is not null").join(types, ["doc_id", "at"], "left").join(contexts.rows.select("ctx_key", "prev"), "ctx_key")
        # Type-scoped contexts end at the next object.
        inner = inner.withColumn("ctx_key", F.when(F.col("is_list"), F.col("ctx_key")).otherwise(F.coalesce("prev", "ctx_key")))
        inner = _stepped(inner, contexts, F.when(F.col("how.scoped").isNotNull(), step(F.col("how.scoped"), F.col("how.scoped_base"), override=True)))
        inner = inner.join(inverse(contexts.rows.select("ctx_key", "base", "vocab", "language", "direction", "terms")).select("ctx_key", "base", "vocab", "terms", "by_iri", "prefixes"), "ctx_key")
        short = F.array_sort(F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.coalesce(F.get(F.element_at("by_iri", t), F.lit(0))["term"], F.when(t.startswith(F.col("vocab")), _suffix(t, F.length("vocab"))), t)))
        each = F.filter(F.transform(short, lambda t: F.when(F.element_at("terms", t)["scoped"].isNotNull(), step(F.element_at("terms", t)["scoped"], F.element_at("terms", t)["scoped_base"], propagate=False))), lambda x: x.isNotNull())
        inner = _stepped(inner.withColumn("each", each).drop("terms", "by_iri", "prefixes", "base", "vocab"), contexts, F.when(F.size("each") > 0, F.array_join("each", ",")))
        now = written(inner.select("doc_id", F.col("at").alias("up"), "ctx_key"), "contexts")
        held = held.unionByName(now)
    return reduce(DataFrame.unionByName, out)


def _stepped(rows: DataFrame, contexts: Contexts, steps: Column) -> DataFrame:
    rows = rows.withColumn("steps", F.when(steps.isNotNull(), F.concat(F.lit("["), steps, F.lit("]"))))
    made = contexts.derive(rows.filter("steps is not null").select(F.col("ctx_key").alias("parent"), "steps")).select(F.col("parent").alias("ctx_key"), "steps", F.col("ctx_key").alias("new"))
    return rows.join(made, ["ctx_key", "steps"], "left").withColumn("ctx_key", F.coalesce("new", "ctx_key")).drop("steps", "new")


def _index_keys(rows: DataFrame) -> DataFrame:
    """rows with ``index_key``: the first value of the property that keys an object in a map by a property, if it is a string. That value's own row goes."""
    c = F.col
    if rows.filter("how.index_iri is not null").isEmpty():
        return rows.withColumn("index_key", F.lit(None).cast("string"))
    mapped = c("at").isNotNull() & ~c("is_list") & ~c("is_graph") & F.array_contains("how.container", "@index") & c("how.index_iri").isNotNull()
    holders = rows.filter(mapped).select("doc_id", c("at").alias("up"), c("how.index_iri").alias("p"))
    # A literal's string is the key whatever its type or language; a name is if the property's term is of names.
    own = F.when(c("o_kind") == "lit", F.to_json(F.try_variant_get(F.parse_json("json"), "$['@value']", "variant"))).otherwise(c("leaf"))
    first = rows.filter("at is null and leaf is not null").join(holders, ["doc_id", "up", "p"]).groupBy("doc_id", "up", "p").agg(F.min(F.struct("ord", "leaf", own.alias("own"))).alias("first"))
    first = written(first.filter(c("first.own").startswith('"')).select("doc_id", "up", "p", "first.ord", "first.leaf", "first.own"), "keys")
    rows = rows.join(first.drop("own"), ["doc_id", "up", "p", "ord", "leaf"], "left_anti")
    keys = first.select("doc_id", c("up").alias("at"), F.get(F.from_json(F.concat(F.lit("["), "own", F.lit("]")), "array<string>"), F.lit(0)).alias("index_key"))
    return rows.join(keys, ["doc_id", "at"], "left")


def compact_json(tree: DataFrame, context: str, base: str | None = None, remote: DataFrame | None = None, compact_arrays: bool = True, graph: bool = False) -> tuple[DataFrame, DataFrame]:
    """((doc_id, doc), errors): every document of an expanded tree as compact JSON under one target context (JSON text).

    Several top objects, and with ``graph`` one too, stand in @graph. Keys are
    sorted. A document with a name that reads as a prefix form has an error row
    (doc_id, code) and no doc. A wrong context raises ValueError with its code.
    """
    spark = tree.sparkSession
    contexts = Contexts(spark, base, remote)
    made = contexts.derive(spark.createDataFrame([(contexts.start,)], "parent string").select("parent", F.concat(F.lit("["), step(F.lit(context), base), F.lit("]")).alias("steps"))).first()
    if made["error"]:
        raise ValueError(made["error"])
    rows = _with_terms(tree, contexts, made["ctx_key"])
    bad = written(rows.filter("wrong is not null").select("doc_id", F.col("wrong").alias("code")).distinct(), "wrong")
    if bad.isEmpty() and rows.filter("how.index_iri is not null").isEmpty():
        rows = rows.withColumn("index_key", F.lit(None).cast("string"))
    else:
        rows = written(_index_keys(rows.join(bad.select("doc_id"), "doc_id", "left_anti")), "keyed")
    own = ["doc_id", "up"]
    c = F.col
    arrays = F.lit(compact_arrays)
    has = lambda k: _no(F.array_contains("how.container", k))
    array_of = lambda vs: F.concat(F.lit("["), joined(vs), F.lit("]"))
    one = lambda vs, keep: F.when((F.size(vs) == 1) & ~keep & arrays, F.get(vs, F.lit(0))).otherwise(array_of(vs))

    def entries(inner: DataFrame) -> DataFrame:
        # An object's own key in its map was set when it was closed; a leaf's is its language or index.
        kind = F.when(has("@graph") & ~c("is_graph"), None).when(has("@language") & (c("o_kind") == "lit"), "@language").when(has("@index"), "@index").when(has("@id"), "@id").when(has("@type"), "@type")
        inner = inner.withColumn("kind", kind)
        mk = F.when(c("kind") == "@language", c("language")).when((c("kind") == "@index") & c("how.index").isNull(), c("idx")).when((c("kind") == "@id") & c("at").isNull(), c("id_short")).otherwise(c("key"))
        inner = inner.withColumn("mk", F.when(c("kind").isNotNull(), F.coalesce(mk, "none_name")))
        keep_one = has("@set") | (c("p").isin("@graph")) | (c("p") == "@list")
        group = ["term", "under_reverse", "p"]
        values = inner.groupBy(*own, *group, "kind", "mk").agg(F.array_sort(F.collect_list(F.when(c("text").isNotNull(), F.struct("ord", "text")))).alias("vs"), F.max(keep_one).alias("keep"), F.max(has("@list")).alias("listed"), F.max("how.nest").alias("nest"), F.max(c("is_list")).alias("lists"), F.first("keyword").alias("keyword"))
        values = values.withColumn("vs", F.transform("vs", lambda v: v["text"]))
        text = F.when(c("listed") & (F.size("vs") == 1), F.get("vs", F.lit(0))).otherwise(one(c("vs"), c("keep")))
        values = values.withColumn("text", text)
        terms = values.groupBy(*own, *group).agg(F.array_sort(F.collect_list(F.when(c("kind").isNotNull(), F.struct("mk", "text")))).alias("maps"), F.array_sort(F.collect_list(F.when(c("kind").isNull(), c("text")))).alias("plain"), F.max("nest").alias("nest"), F.first("keyword").alias("keyword"), F.max(F.when(c("p") == "@type", F.transform("vs", lambda v: v))).alias("types"), F.max(F.when(c("kind").isNull(), c("vs"))).alias("items"), F.max("keep").alias("keep"))
        as_map = F.concat(F.lit("{"), joined(F.transform("maps", lambda m: F.concat(lit.json_string(m["mk"]), F.lit(":"), m["text"]))), F.lit("}"))
        text = F.when(F.size("maps") > 0, as_map).otherwise(F.get("plain", F.lit(0)))
        entry = F.struct("term", F.concat(lit.json_string(c("term")), F.lit(":"), text).alias("e"))
        sides = terms.groupBy(*own).agg(
            F.array_sort(F.collect_list(F.when(~c("under_reverse") & c("nest").isNull() & (c("p") != "@type"), entry))).alias("forward"), F.array_sort(F.collect_list(F.when(c("under_reverse"), entry))).alias("back"), F.array_sort(F.collect_list(F.when(c("nest").isNotNull() & ~c("under_reverse"), F.struct("nest", entry.alias("e"))))).alias("nested"),
            F.max("types").alias("types"), F.max(F.when(c("p") == "@type", c("keep"))).alias("types_set"), F.max("items").alias("items"), F.max(F.when(c("p") == "@graph", c("items"))).alias("graph"), F.first("keyword").alias("keyword"),
        )
        return sides.select(*own, F.struct("forward", "back", "nested", "types", "types_set", "items", "graph").alias("parts"))

    def close(made: DataFrame) -> Column:
        entry_type = "array<struct<term:string,e:string>>"
        none = F.array().cast(entry_type)
        key = lambda k: F.element_at("keyword", F.lit(k))
        single = lambda k, text: F.when(text.isNotNull(), F.struct(key(k).alias("term"), F.concat(lit.json_string(key(k)), F.lit(":"), text).alias("e")))
        in_id, in_type, in_graph = has("@id") & ~c("is_list"), has("@type") & ~c("is_list"), has("@graph") & c("is_graph")
        types = F.when(in_type, F.slice("parts.types", 2, F.lit(_LAST))).otherwise(c("parts.types"))
        type_text = F.when(F.size(types) > 0, one(types, _no(c("parts.types_set"))))
        id_text = F.when(c("named") & ~in_id, lit.json_string("id_short"))
        index = F.when(c("idx").isNotNull() & ~has("@index"), lit.json_string("idx"))
        back = F.when(F.size("parts.back") > 0, F.concat(F.lit("{"), joined(F.transform("parts.back", lambda x: x["e"])), F.lit("}")))
        nests = F.array_distinct(F.transform("parts.nested", lambda x: x["nest"]))
        nested = F.transform(nests, lambda n: F.struct(n.alias("term"), F.concat(lit.json_string(n), F.lit(":{"), joined(F.transform(F.filter("parts.nested", lambda x: x["nest"] == n), lambda x: x["e"]["e"])), F.lit("}")).alias("e")))
        own_entries = F.filter(F.array(single("@id", id_text), single("@type", type_text), single("@index", index), single("@reverse", back)), lambda x: x.isNotNull())
        every = F.array_sort(F.concat(own_entries, F.coalesce("parts.forward", none), F.coalesce(nested, none)))
        node = F.concat(F.lit("{"), joined(F.transform(every, lambda x: x["e"])), F.lit("}"))
        lone = (F.size(every) == 1) & (F.size(own_entries) == 1) & id_text.isNotNull() & c("index_key").isNull()
        name = F.when(c("how.type") == "@vocab", lit.json_string("id_vocab")).when(c("how.type") == "@id", lit.json_string("id_short"))
        node = F.when(lone & name.isNotNull(), name).otherwise(node)
        items = F.coalesce("parts.items", F.array().cast("array<string>"))
        listed = F.when(has("@list"), array_of(items)).otherwise(F.concat(F.lit("{"), joined(F.filter(F.array(F.concat(lit.json_string(key("@list")), F.lit(":"), array_of(items)), F.when(index.isNotNull(), F.concat(lit.json_string(key("@index")), F.lit(":"), index))), lambda x: x.isNotNull())), F.lit("}")))
        held = F.coalesce("parts.graph", F.array().cast("array<string>"))
        included = F.when(F.size(held) == 1, F.get(held, F.lit(0))).otherwise(F.concat(F.lit("{"), lit.json_string(key("@included")), F.lit(":"), array_of(held), F.lit("}")))
        return F.when(c("is_list"), listed).when(in_graph & (has("@id") | has("@index") | ~c("named")), included).otherwise(node)

    def keyed(made: DataFrame) -> Column:
        """The key of an object in a map of ids, types or values of a property."""
        return F.when(c("index_key").isNotNull(), c("index_key")).when(has("@id"), F.when(F.col("named"), F.col("id_short"))).when(has("@type"), F.get(F.from_json(array_of(F.col("parts.types")), "array<string>"), F.lit(0)))

    rows = rows.withColumn("json", F.col("leaf")).withColumn("key", F.lit(None).cast("string"))
    tops = put_together(rows, entries, close, keyed).filter("text != '{}'")
    tops = tops.filter(~(F.col("text").rlike(r'^\{"[^"]*":"(?:[^"\\]|\\.)*+"\}$') & F.col("parts_empty")))
    every = tops.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("all"), F.first(F.element_at("keyword", F.lit("@graph"))).alias("graph_name"))
    texts = F.transform("all", lambda x: x["text"])
    body = F.when((F.size("all") == 1) & F.lit(not graph) & arrays, F.substring(F.get(texts, F.lit(0)), F.lit(2), F.lit(_LAST))).otherwise(F.concat(lit.json_string(F.col("graph_name")), F.lit(":"), array_of(texts), F.lit("}")))
    shown = context if context.strip() not in ("{}", "null") else None
    doc = F.concat(F.lit("{"), F.lit(f'"@context":{shown},' if shown else ""), body)
    back = F.nullif("doc_id", F.lit(NO_DOC))
    return every.select(back.alias("doc_id"), doc.alias("doc")), bad.select(back.alias("doc_id"), "code")
