"""Expansion: JSON-LD documents to statements, level by level.

A statement is a row (doc_id, g, s, p, o, o_kind, datatype, language,
direction, idx, list, pos, json). o_kind is iri, bnode, lit, json, list or
empty. Items of an ordered list share ``list`` and count up in ``pos``; an
empty list is one row with pos null. A list in a list is an item of kind list,
and its own items have it as s and "@list" as p. A property that holds an
empty array is a row of kind empty without an o. Native numbers and booleans
keep their text under their XSD type, as RDF sees them; ``json`` is the value
as the document has it, so that 1 and "1" with a type stay apart.

A level holds the objects of one depth. Each finds its active context (going
back from type-scoped ones, then its property's, its own and its types'), is
judged by its keys under that context (a value, list, set or node object), and
its keys are exploded into values: scalars become rows, objects the next
level. A level ends in a written table, so the plan stays small however deep
documents are.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals as lit
from tessera.operators.context import KEYWORDS, Contexts, expand_iri, is_null, items, members, step, text_of
from tessera.sources.shared import split_code, written

STATEMENT = ["doc_id", "g", "s", "p", "o", "o_kind", "datatype", "language", "direction", "idx", "list", "pos", "json"]
#: Of a row in the document's tree: the place of the object it lies in, its own place (of objects and lists), its order there, whether under @reverse, and whether it wrote its name.
TREE = ["up", "at", "ord", "rev", "named"]
#: How values under a property are read.
HOW = "struct<type:string,language:string,plain:boolean,direction:string,undirected:boolean>"
FRONTIER = f"doc_id long, ctx_key string, enter string, lone boolean, g string, s string, p string, rev boolean, how {HOW}, list string, pos int, mk_kind string, mk string, ip string, graph boolean, up string, at string, ord array<int>, obj string, own string"
LEVEL = "doc_id long, g string, s string, p string, o string, o_kind string, datatype string, language string, direction string, idx string, list string, pos int, json string, error string, up string, at string, ord array<int>, rev boolean, named boolean"


#: What rows have of their active context, and of that in which their types are read.
CONTEXT = ["terms", "type_terms", "vocab", "type_vocab", "base", "own_language", "own_direction", "aliases"]

#: Objects of a level up to which its file may be one, and is dealt to all cores again: reading them costs more than moving them; and how many a task takes then, while there are less than 4 tasks a core.
FEW_OBJECTS, A_TASK = 10_000_000, 25_000


@dataclass
class Expanded:
    """statements; errors (doc_id, code); tree: the rows with what the JSON form needs of them (STATEMENT and TREE columns, p and o null where a row is no statement)."""

    statements: DataFrame
    errors: DataFrame
    tree: DataFrame


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _number(text: Column, x: Column) -> tuple[Column, Column]:
    """Text and XSD type of a number, x, from its JSON text: whole ones below 1e21 are integers, as text 1.0 is."""
    whole = F.coalesce(text.try_cast("decimal(38,0)").cast("string"), lit.xsd_integer(x))
    return F.when(lit.is_integral(x), whole).otherwise(lit.xsd_double(x)), F.when(lit.is_integral(x), lit.INTEGER).otherwise(lit.DOUBLE)


def _blank(doc: Column, label: Column) -> Column:
    """Blank labels are of one document: d<doc>x<label> for labels it wrote, d<doc>n<place> for nodes it left unnamed, d<doc>l<place> for lists."""
    return F.concat(F.lit("_:d"), F.coalesce(doc.cast("string"), F.lit("null")), label)


def _written_blank(doc: Column, name: Column) -> Column:
    return F.when(name.startswith("_:"), _blank(doc, F.concat(F.lit("x"), F.substring(name, F.lit(3), F.lit(1 << 30))))).otherwise(name)


def _entries(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def _role(key: Column) -> Column:
    """The keyword that a key is or stands for."""
    return F.when(key.startswith("@"), F.when(key.isin(sorted(KEYWORDS)), key)).otherwise(F.element_at("aliases", key))


def _has(entries: str, keyword: str) -> Column:
    return F.exists(entries, lambda e: e["role"] == keyword)


def _of(entries: str, keyword: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["role"] == keyword), F.lit(0))["value"]


def _roles(df: DataFrame) -> DataFrame:
    """df with its obj, or what was made of it in ``extra``, as entries (key, value, role); @context is left out."""
    raw = _entries(members(F.parse_json("obj")))
    if "extra" in df.columns:
        raw = F.coalesce(F.transform(F.from_json("extra", _ENTRY), lambda x: F.struct(x["key"].alias("key"), F.parse_json(x["value"]).alias("value"))), raw)
    own = F.transform(raw, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _role(e["key"]).alias("role")))
    return df.withColumn("entries", F.filter(own, lambda e: ~e["role"].eqNullSafe(F.lit("@context"))))


class _Steps:
    """Takes the calls that are made of a DataFrame and repeats them on others: a level's expressions are built once."""

    def __init__(self):
        self.columns, self.calls = ["extra"], []

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self

        return call

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, args, kwargs in self.calls:
            df = getattr(df, name)(*args, **kwargs)
        return df


#: Steps by Spark context and safe mode.
_LEVELS: WeakKeyDictionary = WeakKeyDictionary()


def _level(e: DataFrame, safe: bool) -> DataFrame:
    """What a level's objects, joined with their contexts, come to."""
    own = _LEVELS.setdefault(e.sparkSession.sparkContext, {})
    if safe not in own:
        steps = _Steps()
        _rows(_values(_judged(steps)), safe)
        own[safe] = steps
    return own[safe](e)


def _own(v: Column, text: Column) -> Column:
    """JSON text of the context that an object, v, has in it; text is the object's."""
    return F.when(F.contains(text, F.lit('"@context"')), F.to_json(F.try_variant_get(v, "$['@context']", "variant")))


def _entered(frontier: DataFrame, contexts: Contexts, only: str | None, local: bool) -> tuple[DataFrame, DataFrame, str | None]:
    """As _enter; and the context of all objects, if they are known to share one. only: that which they come with."""
    if not local and not contexts.reverts and not contexts.scoped:
        return frontier.withColumn("type_key", F.col("ctx_key")).drop("enter", "lone", "own"), frontier.select("doc_id", F.lit(None).cast("string").alias("code")).filter("false"), only
    entered, wrong = _enter(frontier, contexts, local)
    entered = written(entered, "entered")
    if contexts.few is None:
        return entered, wrong, None
    keys = entered.select("ctx_key", "type_key").distinct().limit(2).collect()
    return entered, wrong, keys[0]["ctx_key"] if len(keys) == 1 and keys[0]["ctx_key"] == keys[0]["type_key"] else None


def _enter(frontier: DataFrame, contexts: Contexts, local: bool) -> tuple[DataFrame, DataFrame]:
    """The frontier with every object's active context as ctx_key, the one that its types are read in as type_key, and ``fail``."""
    f = frontier.withColumn("fail", F.lit(None).cast("string"))
    if contexts.reverts:
        f = _roles(f.join(contexts.rows.select("ctx_key", "prev", "aliases"), "ctx_key"))
        stays = F.col("lone") | _has("entries", "@value") | (_has("entries", "@id") & (F.size("entries") == 1))
        f = f.withColumn("ctx_key", F.when(stays, F.col("ctx_key")).otherwise(F.coalesce("prev", "ctx_key"))).drop("prev", "aliases", "entries")

    def apply(f: DataFrame, steps: Column) -> DataFrame:
        f = f.withColumn("steps", steps)
        made = contexts.derive(f.filter("steps is not null").select(F.col("ctx_key").alias("parent"), "steps"))
        made = made.select(F.col("parent").alias("ctx_key"), "steps", F.col("ctx_key").alias("new"), F.col("error").alias("wrong"))
        f = f.join(made, ["ctx_key", "steps"], "left")
        return f.withColumns({"ctx_key": F.coalesce("new", "ctx_key"), "fail": F.coalesce("fail", "wrong")}).drop("steps", "new", "wrong")

    if local:
        # The context of an object comes from its document, whose address is that of relative URLs.
        both = F.concat_ws(",", F.expr("substring(enter, 2, length(enter) - 2)"), F.when(F.col("own").isNotNull(), step(F.col("own"), F.col("base_url"))))
        f = apply(f, F.when(both != "", F.concat(F.lit("["), both, F.lit("]"))))
    f = f.withColumn("type_key", F.col("ctx_key"))
    if contexts.scoped:
        f = _roles(f.join(contexts.rows.select("ctx_key", "aliases", "terms"), "ctx_key"))
        types = F.filter(F.flatten(F.transform(F.filter("entries", lambda e: e["role"] == "@type"), lambda e: F.transform(items(e["value"]), text_of))), lambda t: t.isNotNull())
        types = F.array_sort(F.array_distinct(F.concat(types, F.when(F.col("mk_kind") == "@type", F.array("mk")).otherwise(F.array().cast("array<string>")))))
        each = F.filter(F.transform(types, lambda t: F.when(F.element_at("terms", t)["scoped"].isNotNull(), step(F.element_at("terms", t)["scoped"], F.element_at("terms", t)["scoped_base"], propagate=False))), lambda x: x.isNotNull())
        f = f.withColumn("each", each).drop("aliases", "terms", "entries")
        f = apply(f, F.when(F.size("each") > 0, F.concat(F.lit("["), F.array_join("each", ","), F.lit("]")))).drop("each")
    bad = f.filter("fail is not null").select("doc_id", F.col("fail").alias("code"))
    return f.filter("fail is null").drop("fail", "enter", "lone", "own"), bad


_ENTRY = "array<struct<key:string,value:string>>"


def _unnested(e: DataFrame, contexts: Contexts) -> DataFrame:
    """e with ``extra``: the entries of objects, those under @nest at any depth among their own (JSON text); and ``bad_nest``."""
    none = F.array().cast("array<struct<key:string,value:variant>>")
    held = lambda x: F.when(x["role"] == "@nest", F.flatten(F.transform(items(x["value"]), lambda v: F.coalesce(_entries(members(v)), none)))).otherwise(F.array(F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    wrong = F.exists("entries", lambda x: (x["role"] == "@nest") & F.exists(items(x["value"]), lambda v: members(v).isNull()))
    out = F.to_json(F.transform(F.flatten(F.transform("entries", held)), lambda x: F.struct(x["key"].alias("key"), F.to_json(x["value"]).alias("value"))))
    columns = [c for c in e.columns]
    e = e.withColumns({"extra": F.lit(None).cast("string"), "bad_nest": F.lit(False)})
    while True:
        e = _roles(e.join(contexts.rows.select("ctx_key", "aliases"), "ctx_key")).withColumn("more", _has("entries", "@nest"))
        e = e.withColumns({"bad_nest": F.col("bad_nest") | _no(wrong), "extra": out})
        e = written(e.select(*columns, "extra", "bad_nest", "more"), "unnested")
        if e.filter("more and not bad_nest").isEmpty():
            return e.drop("more")


def _judged(e: DataFrame) -> DataFrame:
    """Objects with their entries, and ``o``: what is known of them, their kind (value, list, set, node), their name, and what is wrong with them.

    A projection copies every column, so that a level is as fast as its columns
    and projections are few: what goes through together is one struct, and
    what is cheap is repeated in one projection rather than named in another.
    """
    c = F.col
    e = _roles(e)
    top = c("p").isNull()
    only_graph = top & _has("entries", "@graph") & (F.size("entries") == 1)
    is_list, is_value = _has("entries", "@list"), _has("entries", "@value")
    kind = F.when(is_value, "value").when(is_list, "list").when(_has("entries", "@set") | only_graph, "set").when(_has("entries", "@language") & (F.size("entries") == 1), "none").otherwise("node")
    type_in, index_in = _of("entries", "@type"), _of("entries", "@index")
    e = e.withColumns({
        "kind": kind, "only_graph": only_graph, "roles": F.transform("entries", lambda x: x["role"]),
        "content": F.when(only_graph, _of("entries", "@graph")).when(is_value, _of("entries", "@value")).when(is_list, _of("entries", "@list")).otherwise(_of("entries", "@set")),
        "id_text": text_of(_of("entries", "@id")), "type_text": text_of(type_in), "type_null": is_null(type_in), "first_type": F.get(F.transform(items(type_in), text_of), F.lit(0)),
        "lang_text": text_of(_of("entries", "@language")), "dir_text": text_of(_of("entries", "@direction")), "index_text": text_of(index_in), "reverse": _of("entries", "@reverse"),
    })
    has = lambda keyword: F.array_contains("roles", keyword)
    raw = F.coalesce(c("id_text"), F.when((c("mk_kind") == "@id") & ~c("graph"), c("mk")))
    e = e.withColumn("full_id", expand_iri(raw, c("terms"), None, c("base")))
    node = F.when(c("full_id").isNull(), _blank(c("doc_id"), F.concat(F.lit("n"), c("at")))).otherwise(_written_blank(c("doc_id"), c("full_id")))
    # A graph container holds an object unless a map already holds a graph object.
    graph_only = has("@graph") & (F.size(F.filter("roles", lambda r: ~_no(r.isin("@graph", "@id", "@index")))) == 0)
    wrapped = c("graph") & (c("kind") == "node") & ~(c("mk_kind").isNotNull() & graph_only)
    map_id = F.when(c("mk_kind") == "@id", expand_iri(c("mk"), c("terms"), None, c("base")))
    graph_id = F.when(wrapped, F.coalesce(_written_blank(c("doc_id"), map_id), _blank(c("doc_id"), F.concat(F.lit("g"), c("at")))))
    singular = F.filter("roles", lambda r: r.isNotNull() & ~r.isin("@type", "@included", "@reverse", "@nest"))
    beside = lambda *allowed: F.exists("roles", lambda r: ~_no(r.isin(*allowed)))
    free = c("p").isNull() | (c("p") == "@graph")
    value, node_kind = c("kind") == "value", c("kind") == "node"
    # An entry's value is there wherever its role is: null is a value of its own.
    error = (
        F.when(c("bad_nest"), "invalid @nest value")
        .when(F.size(singular) != F.size(F.array_distinct(singular)), "colliding keywords")
        .when(has("@index") & c("index_text").isNull(), "invalid @index value")
        .when(value & (beside("@value", "@type", "@language", "@direction", "@index") | (has("@type") & (has("@language") | has("@direction"))) | c("ip").isNotNull()), "invalid value object")
        .when(value & has("@language") & c("lang_text").isNull(), "invalid language-tagged string")
        .when(value & has("@direction") & ~_no(c("dir_text").isin("ltr", "rtl")), "invalid base direction")
        .when(value & ~_no(c("first_type") == "@json") & (members(c("content")).isNotNull() | F.try_variant_get("content", "$", "array<variant>").isNotNull()), "invalid value object value")
        .when(value & has("@language") & ~is_null(c("content")) & text_of(c("content")).isNull(), "invalid language-tagged value")
        .when(value & has("@type") & c("type_text").isNull() & ~c("type_null"), "invalid typed value")
        .when(c("kind").isin("list", "set") & ~c("only_graph") & beside("@list", "@set", "@index") | (has("@list") & has("@set")), "invalid set or list object")
        .when(node_kind & has("@id") & c("id_text").isNull(), "invalid @id value")
        .when(node_kind & has("@reverse") & members(c("reverse")).isNull(), "invalid @reverse value")
        .when((c("p") == "@included") & ~c("kind").isin("node", "set"), "invalid @included value")
        .when(c("rev") & c("kind").isin("value", "list") & ~free, "invalid reverse property value")
    )
    o = {k: c(k) for k in ("ctx_key", "doc_id", "base_url", "g", "s", "p", "rev", "how", "list", "pos", "mk_kind", "mk", "up", "at", "ord", "kind", "type_text", "type_null", "lang_text", "dir_text", "index_text")} | {
        "index_": F.coalesce(F.when((c("mk_kind") == "@index") & c("ip").isNull() & ~c("graph"), c("mk")), c("index_text")), "node": node, "named": c("full_id").isNotNull(), "wrapped": wrapped, "graph_id": graph_id, "inner_g": F.coalesce(graph_id, c("g")), "error": error, "has_type": has("@type"),
        # A list's own content stays behind: it would be copied with every item.
        "empty": (c("kind") == "list") & _no(F.size(F.try_variant_get("content", "$", "array<variant>")) == 0), "content": F.when(value, c("content")),
    }
    return e.withColumns({"o": F.struct(*[v.alias(k) for k, v in o.items()]), "every": _every()})


def _every() -> Column:
    """One row for each object itself (role "self") and for each value under its keys."""
    c = F.col
    row = lambda key, value, rev, role: F.struct(key.alias("key"), value.alias("value"), F.lit(rev).alias("under"), role.alias("role"))
    none, variant = F.lit(None).cast("string"), F.lit(None).cast("variant")
    own = F.transform(F.filter("entries", lambda x: x["role"].isNull() | x["role"].isin("@type", "@graph", "@included")), lambda x: row(x["key"], x["value"], False, x["role"]))
    back = F.when(c("reverse").isNotNull(), F.flatten(F.transform(F.filter("entries", lambda x: x["role"] == "@reverse"), lambda x: F.transform(_entries(members(x["value"])), lambda y: row(y["key"], y["value"], True, F.when(_role(y["key"]).isNotNull(), "bad reverse"))))))
    # A map's key is the type of what it holds, or a property's value.
    given = F.filter(F.array(F.when((c("mk_kind") == "@type") & c("mk").isNotNull(), row(F.lit("@type"), F.parse_json(lit.json_string(c("mk"))), False, F.lit("@type"))), F.when(c("ip").isNotNull() & c("mk").isNotNull(), row(c("ip"), F.parse_json(lit.json_string(c("mk"))), False, none))), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<key:string,value:variant,under:boolean,role:string>>")
    every = F.when(c("kind") == "node", F.concat(F.array(row(none, variant, False, F.lit("self"))), F.when(c("mk").isNotNull(), given).otherwise(empty), own, F.coalesce(back, empty)))
    every = every.when(c("kind") == "set", F.array(row(none, c("content"), False, F.lit("members"))))
    return every.when(c("kind") == "list", F.array(row(none, variant, False, F.lit("self")), row(none, c("content"), False, F.lit("members")))).otherwise(F.array(row(none, variant, False, F.lit("self"))))


def _values(e: DataFrame) -> DataFrame:
    """A row for each value of an object's rows, with what its key says of it."""
    c = F.col
    none, variant = F.lit(None).cast("string"), F.lit(None).cast("variant")
    # No object has no rows, and an outer explode doesn't compute them twice to find that out.
    n = e.select(*CONTEXT, "o", F.posexplode_outer("every").alias("key_at", "e_")).select(*CONTEXT, "o", "key_at", "e_.key", "e_.value", "e_.under", F.col("e_.role").alias("role"))
    term = F.when(c("role").isNull(), F.element_at("terms", c("key")))
    prop = F.when(c("role").isNull(), F.when(F.map_contains_key("terms", c("key")), term["iri"]).otherwise(expand_iri(c("key"), c("terms"), c("vocab"), None))).otherwise(F.when(c("role").isin("@type", "@graph", "@included"), c("role")))
    n = n.withColumns({"term": term, "prop": prop, "map": members(c("value"))})
    kinds = F.coalesce("term.container", F.array().cast("array<string>"))
    is_json = _no(c("term.type") == "@json")
    map_kind = F.when(~is_json & c("map").isNotNull() & (F.size(kinds) > 0), F.get(F.array_intersect(kinds, F.array(*[F.lit(k) for k in ("@language", "@index", "@id", "@type")])), F.lit(0)))
    n = n.filter(~(_no(is_null(c("value"))) & ~is_json & (c("role").isNull() | (c("role") != "self"))))
    n = n.withColumns({"dropped": c("role").isNull() & ~_no(F.contains("prop", F.lit(":"))), "is_json": is_json, "map_kind": map_kind, "in_graph": F.array_contains(kinds, "@graph")})
    pair = lambda v, mk=none: F.struct(v.alias("v"), mk.alias("mk"))
    # A map's key may stand for @none.
    key_of = lambda k: F.when(~_no(_role(k) == "@none"), k)
    by_key = F.flatten(F.transform(F.map_entries("map"), lambda x: F.transform(items(x["value"]), lambda v: pair(v, key_of(x["key"])))))
    array = F.try_variant_get("value", "$", "array<variant>")
    # What a list container holds is a list, or becomes one.
    listed = F.exists(F.map_keys("map"), lambda k: _role(k) == "@list")
    as_list = F.when(_no(listed), c("value")).otherwise(F.parse_json(F.concat(F.when(array.isNull(), '{"@list":[').otherwise('{"@list":'), F.to_json("value"), F.when(array.isNull(), "]}").otherwise("}"))))
    whole = F.when(c("is_json"), F.array(pair(c("value")))).when(F.array_contains("term.container", "@list"), F.array(pair(as_list))).when(c("map_kind").isNotNull(), by_key)
    n = n.withColumn("holds", F.when(c("role") == "self", F.array(pair(variant))).otherwise(whole.when(array.isNull(), F.array(pair(c("value")))).otherwise(F.transform(array, lambda v: pair(v)))))
    n = n.select(*CONTEXT, "o", "key_at", "role", "under", "term", "prop", "dropped", "is_json", "map_kind", "in_graph", F.posexplode_outer("holds").alias("item_at", "item")).withColumns({"v": c("item.v"), "item_mk": c("item.mk")}).drop("item")
    return n.filter(~(_no(is_null(c("v"))) & ~c("is_json")))


def _rows(n: DataFrame, safe: bool) -> DataFrame:
    """LEVEL rows of a level's values, and the objects of the next level under ``next``.

    Steps go through named columns where an expression is large, so that each stands in the plan once or twice.
    """
    c = F.col
    none = F.lit(None).cast("string")
    me, part, is_type = _no(c("role") == "self"), _no(c("role") == "members"), _no(c("role") == "@type")
    value_object = me & (c("o.kind") == "value")
    how = F.when(part, c("o.how")).otherwise(F.struct(c("term.type"), c("term.language"), c("term.plain"), c("term.direction"), c("term.undirected")).cast(HOW))
    n = n.withColumns({"x": F.when(value_object, c("o.content")).otherwise(c("v")), "how_": how})
    x_kind = F.schema_of_variant("x")
    json_here = F.when(value_object, _no(c("o.type_text") == "@json")).otherwise(c("is_json") | (part & _no(c("o.how.type") == "@json")))
    # A variant's kind is asked for once: reading it as a type builds a cast for every row.
    n = n.withColumns({"x_kind": F.when(x_kind.startswith("OBJECT"), "OBJECT").when(x_kind.startswith("ARRAY"), "ARRAY").otherwise(x_kind), "text": text_of(c("x")), "is_json": json_here, "digits": F.when(x_kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.to_json("x"))})
    is_obj, arr = c("v").isNotNull() & _no(c("x_kind") == "OBJECT"), c("v").isNotNull() & _no(c("x_kind") == "ARRAY")
    deeper = _no(~me & ~c("is_json") & ~is_type & (is_obj | arr | ((c("map_kind") == "@type") & c("text").isNotNull())))
    by_id = ~me & ~is_type & c("text").isNotNull() & _no(c("how_.type").isin("@id", "@vocab"))
    short = F.when(is_type | by_id, c("text")).when(value_object, c("o.type_text"))
    # Types are read in the context before that of the types.
    full = expand_iri(c("short"), F.when(is_type | value_object, c("type_terms")).otherwise(c("terms")), F.when(is_type, c("type_vocab")).otherwise(c("vocab")), c("base"), ~(c("by_id") & (c("how_.type") == "@id")))
    n = n.withColumns({"me": me, "part": part, "is_type": is_type, "value_object": value_object, "deeper": deeper, "by_id": by_id, "short": short, "number": c("digits").try_cast("double")})
    is_string = c("x_kind") == "STRING"
    plain = is_string & ~_no(~c("how_.type").isin("@id", "@vocab", "@none", "@json"))
    in_map = c("map_kind") == "@language"
    language = F.when(c("value_object"), F.lower("o.lang_text")).when(in_map, F.lower("item_mk")).when(plain & ~_no(c("how_.plain")), F.coalesce("how_.language", "own_language"))
    direction = F.when(c("value_object"), c("o.dir_text")).when(plain & ~_no(c("how_.undirected")), F.coalesce("how_.direction", "own_direction"))
    number, number_type = _number(c("digits"), c("number"))
    scalar = F.when(is_string, c("text")).when(c("x_kind") == "BOOLEAN", F.to_json("x")).when(c("digits").isNotNull(), number)
    scalar_type = F.when(is_string, lit.STRING).when(c("x_kind") == "BOOLEAN", lit.BOOLEAN).otherwise(number_type)
    list_me, in_list = c("me") & (c("o.kind") == "list"), c("part") & (c("o.kind") == "list")
    nested = (c("o.kind") == "list") & c("o.list").isNotNull()
    leaf = _no(~c("me") & ~c("deeper") & c("v").isNotNull() | c("value_object") & ~(is_null(c("x")) & ~c("is_json")))
    n = n.withColumns({"full": F.when(c("short").isNotNull(), full), "lang_": F.when(~c("is_json"), language), "dir_": F.when(~c("is_json"), direction), "scalar": scalar, "scalar_type": scalar_type, "in_list": in_list, "nested": nested, "leaf": leaf, "is_node": c("me") & (c("o.kind") == "node"), "names": c("is_type") | c("by_id"), "wrapped": c("o.wrapped")})
    said = F.when(c("is_json"), "@json").when(c("value_object"), c("full")).when(~_no(c("how_.type").isin("@id", "@vocab", "@none", "@json")) & ~_no(in_map), c("how_.type"))
    datatype = F.when(c("is_json"), lit.JSON).when(c("lang_").isNotNull(), lit.LANG_STRING).otherwise(F.coalesce(said, c("scalar_type")))
    n = n.withColumns({"said": said, "datatype_": datatype})
    lexical = F.when(c("is_json"), lit.canonical_text("x")).when((c("datatype_") == lit.DOUBLE) & ~is_string, lit.xsd_double(c("number"))).otherwise(c("scalar"))
    own_list = _blank(c("o.doc_id"), F.concat(F.lit("l"), c("o.at")))
    # Where a row stands: the object itself and a set's or list's members under their parent's property, others under their own.
    under_parent, at0 = c("me") | c("part"), F.coalesce("item_at", F.lit(0))
    object_ = F.when(c("is_node"), F.coalesce("o.graph_id", "o.node")).when(c("names"), _written_blank(c("o.doc_id"), c("full"))).when(c("nested") & c("me"), F.when(c("o.empty"), lit.NIL).otherwise(own_list)).when(c("leaf"), lexical)
    idx = F.when(c("me"), c("o.index_")).when((c("map_kind") == "@index") & c("term.index").isNull(), c("item_mk"))
    idx = F.when(c("is_node") & c("wrapped"), F.when(c("o.mk_kind") == "@index", c("o.mk"))).otherwise(idx)
    child = F.when(~c("deeper"), None).when(is_obj, F.to_json("v")).when(arr, F.concat(F.lit(F.when(c("in_list"), '{"@list":').otherwise('{"@set":')), F.to_json("v"), F.lit("}"))).otherwise(F.concat(F.lit('{"@id":'), F.to_json("v"), F.lit("}")))
    raw = F.when(c("is_json") & c("x").isNull(), "null").otherwise(F.to_json("x"))
    n = n.withColumns({
        "o_": object_, "idx_": idx, "child": child, "raw": F.when(c("leaf") & ~c("names"), raw),
        "subject": F.when(c("in_list") & c("nested"), own_list).when(under_parent, c("o.s")).otherwise(c("o.node")),
        "predicate": F.when(c("in_list") & c("nested"), "@list").when(under_parent, c("o.p")).otherwise(c("prop")),
        "swap": F.when(under_parent, c("o.rev")).otherwise(c("under") != _no(c("term.reverse"))),
        "lst": F.when(c("in_list"), own_list).when(under_parent, c("o.list")), "at_pos": F.when(c("in_list"), c("item_at")).when(under_parent, c("o.pos")).cast("int"),
        "inside": F.when(c("in_list"), c("o.at")).when(under_parent, c("o.up")).when(c("wrapped"), F.concat("o.at", F.lit("_g"))).otherwise(c("o.at")),
        "order": F.when(c("me"), c("o.ord")).when(c("in_list"), F.array(at0)).when(c("part"), F.concat("o.ord", F.array(at0))).otherwise(F.array("key_at", at0)),
        "graph_": F.when(c("role") == "@graph", c("o.node")).when(c("is_node") & c("wrapped"), c("o.g")).otherwise(c("o.inner_g")),
    })
    literal = c("leaf") & ~c("names")
    free = c("predicate").isNull() | (c("predicate") == "@graph")
    unsafe = F.lit(safe) & c("dropped")
    error = F.coalesce(
        F.when(c("me"), c("o.error")).when(unsafe, "invalid property"),
        F.when(c("role") == "bad reverse", "invalid reverse property map")
        .when(c("is_type") & c("v").isNotNull() & c("text").isNull(), "invalid type value")
        .when(c("value_object") & c("o.has_type") & ~c("is_json") & ~c("o.type_null") & ~_no(F.contains("full", F.lit(":"))), "invalid typed value")
        .when(in_map & ~c("me") & c("v").isNotNull() & ~is_string, "invalid language map value")
        .when((c("role") == "@included") & ~c("deeper"), "invalid @included value")
        .when((c("map_kind") == "@index") & c("term.index").isNotNull() & c("leaf") & ~c("names") & ~c("me"), "invalid value object")
        .when(c("swap") & c("leaf") & ~c("names") & ~free, "invalid reverse property value"),
    )
    # A member is no row of its own where its object isn't one (floating values), or where it goes to the next level.
    real = c("predicate").isNotNull() & ~c("predicate").isin("@graph", "@included") & c("subject").isNotNull() & ~c("dropped")
    hole = ~c("deeper") & c("v").isNull() & ~c("me")
    nothing = hole & ~c("in_list") & ~c("swap")
    o_kind = F.when(c("nested") & c("me"), "list").when(c("o_").isNull(), None).when(c("is_node") | c("names"), F.when(c("o_").startswith("_:"), "bnode").otherwise("iri")).when(c("is_json"), "json").otherwise("lit")
    o_kind = F.when(nothing & real, "empty").otherwise(o_kind)
    says = real & (c("o_").isNotNull() | (c("in_list") & hole & ~c("nested")) | nothing)
    tree = ~c("dropped") & (c("is_node") | (list_me & ~free) | (c("leaf") & ~free) | (hole & ~free & ~c("in_list")))
    member = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), lit.json_string(value)))
    value_text = F.concat(F.lit("{"), F.concat_ws(",", member("@direction", c("dir_")), member("@index", c("idx_")), member("@language", c("lang_")), member("@type", c("said")), F.concat(F.lit('"@value":'), c("raw"))), F.lit("}"))
    ref_text = F.when(c("is_type"), lit.json_string(c("o_"))).otherwise(F.concat(F.lit("{"), F.concat_ws(",", member("@id", c("o_")), member("@index", c("idx_"))), F.lit("}")))
    kid_s = F.when(c("predicate").isin("@graph", "@included"), None).otherwise(c("subject"))
    enter = F.when(c("term.scoped").isNotNull(), F.concat(F.lit("["), step(c("term.scoped"), c("term.scoped_base"), override=True), F.lit("]")))
    here = F.when(c("part"), F.concat_ws("_", "o.at", at0)).otherwise(F.concat_ws("_", "o.at", "key_at", at0))
    kid = F.struct(
        c("o.ctx_key").alias("ctx_key"), enter.alias("enter"), _no(c("map_kind") == "@index").alias("lone"), c("graph_").alias("g"), kid_s.alias("s"), c("predicate").alias("p"), c("swap").alias("rev"), c("how_").alias("how"), c("lst").alias("list"), c("at_pos").alias("pos"),
        F.when(~c("part"), c("map_kind")).otherwise(c("o.mk_kind")).alias("mk_kind"), F.when(~c("part"), c("item_mk")).otherwise(c("o.mk")).alias("mk"), F.when(~c("part") & (c("map_kind") == "@index"), c("term.index")).alias("ip"),
        _no(c("in_graph") & ~c("part")).alias("graph"), c("inside").alias("up"), here.alias("at"), c("order").alias("ord"), c("child").alias("obj"), F.when(is_obj, _own(c("v"), c("child"))).alias("own"),
    )
    row = lambda s, p, o, kind, up, at, order, rev, named, idx_, lst, pos, json, err, says_, tree_, g_: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), up.alias("up"), at.alias("at"), order.alias("ord"), rev.alias("rev"), named.alias("named"), idx_.alias("idx"), lst.alias("list"), pos.alias("pos"), json.alias("json"), err.alias("error"), says_.alias("says"), tree_.alias("in_tree"), g_.alias("g"))
    place = F.when(c("is_node") | list_me, c("o.at"))
    main = row(
        F.when(c("swap"), c("o_")).otherwise(c("subject")), c("predicate"), F.when(c("swap"), c("subject")).otherwise(c("o_")), F.when(c("swap"), F.when(c("subject").startswith("_:"), "bnode").otherwise("iri")).otherwise(o_kind),
        c("inside"), place, c("order"), c("swap"), F.when(c("wrapped"), c("o.mk_kind").eqNullSafe("@id") & c("o.mk").isNotNull()).otherwise(c("o.named")) & c("is_node"), c("idx_"), c("lst"), F.when(c("o_").isNotNull(), c("at_pos")),
        F.when(c("leaf"), F.when(c("names"), ref_text).otherwise(value_text)), c("error"), says, tree, c("graph_"),
    )
    inner = row(none, F.lit("@graph"), c("o.node"), F.when(c("o.node").startswith("_:"), "bnode").otherwise("iri"), c("o.at"), F.concat("o.at", F.lit("_g")), F.array(F.lit(0)), F.lit(False), c("o.named"), c("o.index_text"), none, F.lit(None).cast("int"), none, none, F.lit(False), F.lit(True), c("o.inner_g"))
    n = n.withColumn("error", error)
    n = n.withColumns({"next": F.when(c("deeper") & ~c("dropped") & c("error").isNull(), kid), "main": main, "inner": F.when(c("is_node") & c("wrapped"), inner)})
    return n.select(c("o.doc_id").alias("doc_id"), c("o.base_url").alias("base_url"), F.when(literal, c("datatype_")).alias("datatype"), F.when(literal, c("lang_")).alias("language"), F.when(literal, c("dir_")).alias("direction"), "next", "main", "inner")


def _flat(level: DataFrame) -> DataFrame:
    """LEVEL rows of a written level."""
    fields = ["s", "p", "o", "o_kind", "idx", "list", "pos", "error", "says", "in_tree", "up", "at", "ord", "rev", "named", "json", "g"]
    main = level.filter("main.says or main.in_tree or main.error is not null").select("doc_id", "datatype", "language", "direction", *[F.col(f"main.{f}").alias(f) for f in fields])
    if "inner" not in level.columns:
        return main
    none = F.lit(None).cast("string")
    inner = level.filter("inner is not null").select("doc_id", none.alias("datatype"), none.alias("language"), none.alias("direction"), *[F.col(f"inner.{f}").alias(f) for f in fields])
    return main.unionByName(inner)


def expand(docs: DataFrame, remote: DataFrame | None = None, base: str | None = None, max_depth: int | None = None, context: str | None = None, mode: str = "json-ld-1.1", safe: bool = False, chain: int = 50) -> Expanded:
    """Statements, errors and tree of (doc_id, doc), doc being JSON text.

    remote is (url, document), context a local context for all documents, mode
    json-ld-1.1 or json-ld-1.0, chain the longest chain of remote contexts. A
    document that isn't JSON, whose context is invalid, that has an invalid
    value or nests deeper than max_depth, and with ``safe`` one that has a key
    which means nothing, has an error row (doc_id, code) and no statements. A
    null doc counts as one that isn't JSON. doc_id names documents: rows that
    share one, or have none, are one document in several parts; equal rows are
    one part.
    """
    spark = docs.sparkSession
    contexts = Contexts(spark, base, remote, mode, chain)
    start = contexts.start
    bad = []
    if context is not None:
        made = contexts.derive(spark.createDataFrame([(start,)], "parent string").select("parent", F.concat(F.lit("["), step(F.lit(context), base), F.lit("]")).alias("steps"))).first()
        if made["error"]:
            bad.append(docs.select("doc_id", F.lit(made["error"]).alias("code")))
            docs = docs.limit(0)
        start = made["ctx_key"] or start
    # Places begin with a hash of the text, so that blank nodes of the parts of a document stay apart.
    # Small files may come as one task, whose documents would stay in one.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "doc", F.xxhash64("doc").alias("hash_")).hint("rebalance", "hash_")
    parsed = dealt.select("doc_id", "doc", F.hex("hash_").alias("part"), F.try_parse_json("doc").alias("v"))
    # A document that isn't JSON is a row without an object, so that documents are read and parsed once.
    tops = parsed.select("doc_id", "part", F.col("v").isNull().alias("broken"), F.when(F.schema_of_variant("v").startswith("OBJECT") & ~F.contains("doc", F.lit("\\")), F.col("doc")).alias("doc"), F.posexplode(items(F.col("v"))).alias("at", "v")).filter(F.col("broken") | F.schema_of_variant("v").startswith("OBJECT"))
    none = F.lit(None).cast("string")
    # The text of an object without escapes names its keys as they are.
    tops = tops.withColumn("obj", F.coalesce("doc", F.to_json("v")))
    frontier = tops.select(
        "doc_id", F.lit(start).alias("ctx_key"), none.alias("enter"), F.lit(False).alias("lone"), none.alias("g"), none.alias("s"), none.alias("p"), F.lit(False).alias("rev"), F.lit(None).cast(HOW).alias("how"), none.alias("list"), F.lit(None).cast("int").alias("pos"),
        none.alias("mk_kind"), none.alias("mk"), none.alias("ip"), F.lit(False).alias("graph"), none.alias("up"), F.concat_ws("_", "part", "at").alias("at"), F.array("at").alias("ord"), "obj", _own(F.col("v"), F.col("obj")).alias("own"), F.lit(base).cast("string").alias("base_url"),
    )
    frontier = written(frontier, "objects")
    bad.append(frontier.filter("obj is null").select("doc_id", F.lit("loading document failed").alias("code")))
    frontier = frontier.filter("obj is not null")
    tables: list[DataFrame] = []
    depth = 0
    while True:
        n, graphs, local, nests, least, only = frontier.agg(F.count(F.lit(1)), F.max("graph"), F.max(F.col("own").isNotNull() | F.col("enter").isNotNull()), F.max(F.contains("obj", F.lit('"@nest"'))), F.min("ctx_key"), F.max("ctx_key")).first()
        if not n:
            break
        if max_depth is not None and depth >= max_depth:
            bad.append(frontier.select("doc_id", F.lit("nesting too deep").alias("code")))
            break
        entered, wrong, only = _entered(frontier, contexts, only if least == only else None, bool(local))
        bad.append(wrong)
        entered = _unnested(entered, contexts) if nests or contexts.nests else entered.withColumns({"extra": F.lit(None).cast("string"), "bad_nest": F.lit(False)})
        if n <= FEW_OBJECTS:
            cores = spark.sparkContext.defaultParallelism
            entered = entered.repartition(max(cores, min(4 * cores, n // A_TASK)))
        constant = only and contexts.constant(only)
        if constant:
            # What all rows share is part of the expressions, not of the rows.
            entered = entered.withColumns({"own_" + k if k in ("language", "direction") else k: v for k, v in constant.items()})
        else:
            entered = entered.join(contexts.rows.select("ctx_key", "aliases", "base", "vocab", F.col("language").alias("own_language"), F.col("direction").alias("own_direction"), "terms"), "ctx_key")
        if contexts.scoped and not constant:
            entered = entered.join(contexts.rows.select(F.col("ctx_key").alias("type_key"), F.col("terms").alias("type_terms"), F.col("vocab").alias("type_vocab")), "type_key")
        else:
            entered = entered.withColumns({"type_terms": F.col("terms"), "type_vocab": F.col("vocab")})
        with split_code(spark):
            level = _level(entered, safe)
            level = written(level if graphs else level.drop("inner"), "level")
        tables.append(_flat(level))
        frontier = level.filter("next is not null").select("doc_id", "next.*", "base_url")
        depth += 1
    rows = reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], LEVEL + ", says boolean, in_tree boolean")
    bad.append(rows.filter("error is not null").select("doc_id", F.col("error").alias("code")))
    errors = written(reduce(DataFrame.unionByName, bad).groupBy("doc_id").agg(F.min("code").alias("code")), "errors")
    good = rows.join(errors.select(F.col("doc_id").alias("bad_id")), F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return Expanded(good.filter("says").select(*STATEMENT), errors, good.filter("in_tree").select(*STATEMENT, *TREE))
