"""Framing: query by example over statements.

A frame is one small document. Its keys become one aggregation per node with a
boolean per pattern (matching), and semi joins where a pattern describes a
referenced node.

What a result embeds is found for all results at once. An *occurrence* is a
node at a place of a result; places are paths of keys that sort as a walk of
the result goes (graphs, included nodes, properties in order, reverse
properties; names in order). A round joins the occurrences that embed with the
edges of their nodes and judges those anew: a circle never embeds, and under
@once a node embeds at its first place. As a place rests on those before it
alone, rounds settle from the front, at most one more than the deepest result
is deep. The settled occurrences become a tree as expansion gives it.
"""
from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals as lit
from tessera.operators.compact import compact_json
from tessera.operators.context import compiled, expand_iri
from tessera.operators.expand import STATEMENT, TREE
from tessera.operators.graph import conflicting_indexes, merged
from tessera.operators.rdf import value_json
from tessera.operators.tree import NO_DOC, top_objects
from tessera.sources.shared import written

FLAGS = {"@embed", "@explicit", "@requireAll", "@omitDefault", "@default", "@null", "@context"}
EMBED = ("@always", "@once", "@never", "@first", "@last", "@link", True, False, "true", "false")


class FrameError(ValueError):
    """A frame that is none; ``code`` is the code of the data model."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def resolved(spark, frame: dict) -> dict:
    """The frame with its keys, types and names in full, under its own context (a single row)."""
    ctx = written(compiled(spark.createDataFrame([(json.dumps(frame.get("@context", {})),)], "ctx string")), "context")
    names: set[str] = set()

    def collect(f):
        for k, v in f.items():
            if k == "@context":
                continue
            names.add(k)
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict):
                    collect(x)
                elif isinstance(x, str):
                    names.add(x)

    collect(frame)
    table = spark.createDataFrame([(n,) for n in sorted(names)] or [("",)], "name string").crossJoin(F.broadcast(ctx))
    rows = table.select("name", expand_iri(F.col("name"), F.col("terms"), F.col("vocab"), F.col("base")).alias("full"), "error").collect()  # the frame's own names
    if rows and rows[0]["error"]:
        raise FrameError(rows[0]["error"])
    full = {r["name"]: r["full"] for r in rows}

    def rename(f):
        out = {}
        for k, v in f.items():
            if k == "@context":
                continue
            key = full[k] or k
            if key in ("@type", "@id"):
                v = [full.get(x, x) if isinstance(x, str) else x for x in (v if isinstance(v, list) else [v])]
            elif key in ("@graph", "@included", "@list"):
                v = [rename(x) if isinstance(x, dict) else x for x in (v if isinstance(v, list) else [v])]
            elif not key.startswith("@") or key == "@reverse":
                v = {full[p] or p: rename(x) for p, x in v.items()} if key == "@reverse" else [rename(x) if isinstance(x, dict) else x for x in (v if isinstance(v, list) else [v])]
            out[key] = v
        return out

    out = rename(frame)
    check(out)
    return out


def check(frame: dict) -> None:
    for x in frame.get("@id", []):
        if not (x == {} or (isinstance(x, str) and ":" in x)):
            raise FrameError("invalid frame")
    for x in frame.get("@type", []):
        if not (isinstance(x, dict) or (isinstance(x, str) and ":" in x)):
            raise FrameError("invalid frame")
    if "@embed" in frame and frame["@embed"] not in EMBED:
        raise FrameError("invalid @embed value")
    for k, v in frame.items():
        if not k.startswith("@") or k in ("@graph", "@included"):
            for x in v:
                if isinstance(x, dict):
                    check(x)


def _flag(frame: dict, name: str, default: bool) -> bool:
    v = frame.get(name, default)
    return v in (True, "true")


def _value(pattern: dict) -> Column:
    """Whether a statement's object fits a value pattern; {} in a place is any, a missing type or language must be missing."""
    def part(name, column, missing):
        if name not in pattern:
            return missing
        v = pattern[name]
        options = v if isinstance(v, list) else [v]
        return column.isNotNull() if {} in options else column.isin([str(x).lower() if isinstance(x, bool) else str(x) for x in options])

    untyped = F.col("datatype").isin(lit.STRING, lit.LANG_STRING)
    return (
        (F.col("o_kind") == "lit") & part("@value", F.col("o"), F.lit(True)) & part("@language", F.col("language"), F.col("language").isNull())
        & (part("@type", F.when(~untyped, F.col("datatype")), untyped | F.col("datatype").isin(lit.INTEGER, lit.DOUBLE, lit.BOOLEAN)) if pattern else F.lit(True))
    )


def _marked(st: DataFrame, pattern: dict, require_all: bool, n: int) -> tuple[DataFrame, Column]:
    """st with a mark on the edges to nodes that fit a pattern, and whether a row has it."""
    fit = matching(st.select(*STATEMENT), pattern, require_all).select("doc_id", F.col("s").alias("o")).distinct().withColumn(mark := f"fits{n}", F.lit(True))
    return st.join(fit, ["doc_id", "o"], "left"), F.col("o_kind").isin("iri", "bnode") & F.col(mark)


def matching(statements: DataFrame, frame: dict, require_all: bool = False) -> DataFrame:
    """(doc_id, g, s) of the nodes that a resolved frame describes.

    One pass: a node's statements are reduced to a boolean per key. Keys are
    joined by AND under @requireAll, else by OR, where @id and @type decide
    alone and [] (the property must be absent) holds in any case. A property
    with a default may be absent. Properties of a frame in @graph count as the
    frame's own. A frame without keys takes every node.
    """
    require_all = _flag(frame, "@requireAll", require_all)
    inside = next((x for x in frame.get("@graph", []) if isinstance(x, dict)), {})
    frame = {**{k: v for k, v in inside.items() if not k.startswith("@")}, **frame}
    node = ["doc_id", "g", "s"]
    st = statements
    has = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
    tests: dict[str, Column] = {}
    absent, optional = set(), set()
    if "@id" in frame:
        tests["@id"] = F.lit(True) if {} in frame["@id"] else has(F.col("s").isin(frame["@id"]))
    if "@type" in frame:
        types = [t for t in frame["@type"] if isinstance(t, str)]
        if not frame["@type"]:
            tests["@type"], absent = ~has(F.col("p") == "@type"), absent | {"@type"}
        else:
            tests["@type"] = F.lit(True) if any(isinstance(t, dict) and "@default" in t for t in frame["@type"]) else has((F.col("p") == "@type") & (F.lit(True) if not types else F.col("o").isin(types)))
    for p, patterns in frame.items():
        if p.startswith("@"):
            continue
        here = (F.col("p") == p) & ~F.col("o_kind").eqNullSafe(F.lit("empty"))
        if not patterns:
            tests[p], absent = ~has(here), absent | {p}
            continue
        pattern = patterns[0]
        if isinstance(pattern, dict) and "@default" in pattern:
            optional.add(p)
            tests[p] = has(here)
            continue
        if not isinstance(pattern, dict):
            tests[p] = has(here & (F.col("o") == str(pattern)))
        elif any(k in pattern for k in ("@value", "@language")) and not any(not k.startswith("@") for k in pattern):
            tests[p] = has(here & _value(pattern))
        elif set(pattern) <= FLAGS:
            tests[p] = has(here)
        elif "@list" in pattern:
            inner = _first(pattern["@list"])
            if "@value" in inner or set(inner) <= FLAGS:
                tests[p] = has(here & F.col("list").isNotNull() & (_value(inner) if "@value" in inner else F.lit(True)))
            else:
                st, mark = _marked(st, inner, require_all, len(tests))
                tests[p] = has(here & F.col("list").isNotNull() & mark)
        else:
            st, mark = _marked(st, pattern, require_all, len(tests))
            tests[p] = has(here & mark)
    if not tests:
        return st.select(*node).distinct()
    names = {k: f"t{i}" for i, k in enumerate(tests)}
    reduced = st.groupBy(*node).agg(*[c.alias(names[k]) for k, c in tests.items()])
    true = lambda keys: [F.col(names[k]) for k in keys]
    if require_all:
        keep = true(k for k in tests if k not in optional)
        out = F.lit(True)
        for c in keep:
            out = out & c
    elif "@id" in tests or "@type" in tests:
        out = F.col(names["@id"] if "@id" in tests else names["@type"])
    else:
        out = F.lit(False)
        for c in true(tests):
            out = out | c
        for c in true(absent):
            out = out & c
    return reduced.filter(out).select(*node)


@dataclass(frozen=True)
class Flags:
    """What holds where a frame doesn't say."""

    embed: str = "@once"
    explicit: bool = False
    require_all: bool = False
    omit_default: bool = False


def _first(v):
    """The first object of a key's frames, {} for none."""
    return next((x for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)), {})


class Rules:
    """The frames that rule places of a result, numbered: a frame, those in it, and for properties that a frame doesn't mention the implicit ones that take its flags.

    The number of a rule's rule for a property is in ``of``, for another one in
    ``implicit`` (none under @explicit), for items of lists in ``items``.
    """

    def __init__(self, frame: dict, flags: Flags):
        self.flags, self.frames, self.embed, self.explicit, self.require_all = flags, [], [], [], []
        self.of, self.implicit, self.items, self.back, self.graph, self.included = {}, {}, {}, {}, {}, {}
        self._plain: dict = {}
        self._add(frame)
        # A choice is by the first place, or by the last if no frame asks for the first.
        self.last = "@last" in self.embed and not {"@once", "@first"} & set(self.embed)

    def _add(self, frame: dict, embed: str | None = None, explicit: bool | None = None, require_all: bool | None = None) -> int:
        n = len(self.frames)
        said = frame.get("@embed", embed or self.flags.embed)
        said = {True: "@once", "true": "@once", False: "@never", "false": "@never"}.get(said, said)
        self.frames.append(frame)
        self.embed.append(said)
        self.explicit.append(_flag(frame, "@explicit", self.flags.explicit if explicit is None else explicit))
        self.require_all.append(_flag(frame, "@requireAll", self.flags.require_all if require_all is None else require_all))
        own = (said, self.explicit[n], self.require_all[n])
        if own not in self._plain:
            self._plain[own] = len(self.frames) if any(not k.startswith("@") or k not in FLAGS for k in frame) else n
            if self._plain[own] != n:
                self._add({}, *own)
        if not self.explicit[n]:
            self.implicit[n] = self._plain[own]
        for p, patterns in frame.items():
            if not p.startswith("@"):
                sub = _first(patterns)
                self.of[n, p] = self._add(sub)
                self.items[n, p] = self._add(_first(sub["@list"])) if "@list" in sub else self._plain[own]
        for p, sub in frame.get("@reverse", {}).items():
            self.back[n, p] = self._add(_first(sub))
        self.graph[n] = self._add(_first(frame.get("@graph", {}))) if "@graph" in frame else None
        if "@included" in frame:
            self.included[n] = self._add(_first(frame["@included"]))
        return n

    def bare(self, n: int) -> bool:
        """Whether every node fits rule n."""
        return set(self.frames[n]) <= FLAGS | {"@reverse", "@included"} and "@graph" not in self.frames[n]


def _looked_up(table: dict, key: Column, kind: str) -> Column:
    """The entry of a small table, null where there is none."""
    if not table:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


def _ruled(table: dict) -> dict:
    return {f"{n} {p}": v for (n, p), v in table.items()}


_NODE = ["doc_id", "g", "s"]
#: An occurrence: a node s of graph g at a place of the result ``root``, under rule n; its place as path, that of the object or list it lies in as held; the nodes above it.
_PLACE = ["doc_id", "root", "path", "g", "s", "n", "above"]


def _name(g: Column, s: Column) -> Column:
    return F.concat(g, F.lit("\x00"), s)


def _children(occ: DataFrame, st: DataFrame, rules: Rules, subjects: DataFrame, fits: DataFrame | None, merged_graphs: bool) -> DataFrame:
    """What the nodes of occurrences point at, with the rule and place of each: kind 0 is a node of the graph that a node names, 1 an included one, 2 a property's, 3 one that points here."""
    c = F.col
    key = lambda kind, *parts: F.concat_ws("\x00", F.lit(kind), *parts)
    none = F.lit(None).cast("string")
    ref = c("o_kind").isin("iri", "bnode") & ~c("p").startswith("@")
    edges = st.filter(ref).select(*_NODE, "p", "o", "list", "pos")
    n_p = F.concat_ws(" ", c("n").cast("string"), "p")
    rule = F.when(c("list").isNotNull(), _looked_up(_ruled(rules.items), n_p, "int")).otherwise(_looked_up(_ruled(rules.of), n_p, "int"))
    held = F.when(c("list").isNotNull(), F.concat("path", F.array(key("2", "p", F.lit("1"), c("list"))))).otherwise(c("path"))
    place = F.when(c("list").isNotNull(), key("2", F.lpad(c("pos").cast("string"), 10, "0"))).otherwise(key("2", "p", F.lit("0"), c("o")))
    found = occ.join(edges, _NODE).withColumns({"rule": F.coalesce(rule, _looked_up(rules.implicit, c("n"), "int")), "held": held}).filter("rule is not null")
    out = [found.select(*_PLACE, F.lit(2).alias("kind"), "p", c("g").alias("child_g"), c("o").alias("child"), "rule", "held", place.alias("key"), "list", "pos")]
    if rules.back:
        pointing = st.filter(ref & c("list").isNull()).select("doc_id", "g", c("o").alias("s"), "p", c("s").alias("child")).distinct()
        back = occ.join(pointing, _NODE).withColumn("rule", _looked_up(_ruled(rules.back), n_p, "int")).filter("rule is not null")
        out.append(back.select(*_PLACE, F.lit(3).alias("kind"), "p", c("g").alias("child_g"), "child", "rule", c("path").alias("held"), key("3", "p", c("child")).alias("key"), none.alias("list"), F.lit(None).cast("int").alias("pos")))
    within = lambda kind, rule, graph_of, p: occ.withColumn("rule", rule).filter("rule is not null").join(subjects.select("doc_id", c("g").alias("child_g"), c("s").alias("child")).withColumnRenamed("doc_id", "doc_"), (c("doc_id") == c("doc_")) & (c("child_g") == graph_of)).select(*_PLACE, F.lit(kind).alias("kind"), F.lit(p).alias("p"), "child_g", "child", "rule", c("path").alias("held"), key(str(kind), c("child")).alias("key"), none.alias("list"), F.lit(None).cast("int").alias("pos"))
    if not merged_graphs:
        asked = {n: g for n, g in rules.graph.items() if g is not None}
        out.append(within(0, F.coalesce(_looked_up(asked, c("n"), "int"), F.lit(rules.wild)), c("s"), "@graph"))
    if rules.included:
        # Included are nodes of the graph that a result, or a node of a graph, is a node of.
        out.append(within(1, F.when(c("top"), _looked_up(rules.included, c("n"), "int")), c("g"), "@included"))
    rows = reduce(DataFrame.unionByName, out)
    if fits is None:
        return rows
    free = _looked_up({n: True for n in range(len(rules.frames)) if rules.bare(n)}, c("rule"), "boolean")
    marked = rows.join(fits.select("doc_id", c("g").alias("child_g"), c("s").alias("child"), c("n").alias("rule"), F.lit(True).alias("fit")), ["doc_id", "child_g", "child", "rule"], "left")
    return marked.filter(F.coalesce(free, F.lit(False)) | c("fit")).drop("fit")


def _judged(children: DataFrame, rules: Rules) -> DataFrame:
    """children with their path and whether they embed, are references or (``embeds`` null) nothing."""
    c = F.col
    mode = _looked_up(dict(enumerate(rules.embed)), c("rule"), "string")
    free = c("kind") < 2
    rows = children.withColumn("path", F.concat("held", F.array("key"))).withColumn("can", free | (~F.array_contains("above", _name(c("child_g"), c("child"))) & (mode != "@never")))
    rows = written(rows, "children")  # else the best places would join occurrences and edges once more
    who = ["doc_id", "root", "child_g", "child"]
    best = rows.filter("can").groupBy(*who).agg((F.max if rules.last else F.min)("path").alias("best"))
    top = (c("child") == c("root")) & (c("child_g") == "")
    rows = rows.join(best, who, "left").withColumn("chosen", c("can") & (((c("path") == c("best")) & ~top) | (mode.isin("@always", "@link") & ~free)))
    return rows.withColumn("embeds", F.when(c("chosen"), True).when(~free, False)).drop("can", "best", "chosen")


def _settled(st: DataFrame, rules: Rules, roots: DataFrame, merged_graphs: bool) -> tuple[DataFrame, DataFrame]:
    """(occurrences that embed, judged children of these)."""
    c = F.col
    subjects = written(st.filter("not startswith(s, '_:l') or p != '@list'").select(*_NODE).distinct(), "subjects") if not merged_graphs or rules.included else st
    bound = [n for n in range(1, len(rules.frames)) if not rules.bare(n)]
    fits = written(reduce(DataFrame.unionByName, [matching(st, rules.frames[n], rules.require_all[n]).select(*_NODE, F.lit(n).alias("n")).distinct() for n in bound]), "fits") if bound else None
    start = roots.select("doc_id", c("s").alias("root"), F.array().cast("array<string>").alias("path"), "g", "s", F.lit(0).alias("n"), F.array(_name(c("g"), c("s"))).alias("above"), F.lit(True).alias("top"))
    occ, seen = start, None
    while True:
        judged = written(_judged(_children(occ, st, rules, subjects, fits, merged_graphs), rules), "judged")
        now = tuple(judged.filter("embeds").agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "root", "path", "rule").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return occ, judged
        seen = now
        more = judged.filter("embeds").select("doc_id", "root", "path", c("child_g").alias("g"), c("child").alias("s"), c("rule").alias("n"), F.concat("above", F.array(_name(c("child_g"), c("child")))).alias("above"), (c("kind") == 0).alias("top"))
        occ = written(start.unionByName(more), "places")


def _default(v) -> tuple[str, str, str | None]:
    """(kind, JSON, name) of a default: its first value; "@null" is null."""
    v = v[0] if isinstance(v, list) and v else v
    if v == "@null" or v is None or v == []:
        return "null", "null", None
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if isinstance(v, dict) and set(v) == {"@id"}:
        return "iri", text(v), v["@id"]
    return "lit", text(v if isinstance(v, dict) else {"@value": v}), None


def _tree(st: DataFrame, rules: Rules, occ: DataFrame, judged: DataFrame) -> DataFrame:
    """The tree of all results: doc_id, STATEMENT and TREE columns, as expansion gives them, and ``root``."""
    c = F.col
    none = F.lit(None).cast("string")
    place = lambda path: F.concat_ws("_", F.md5("root"), F.transform(path, lambda k: F.md5(k)))
    letters = lambda name: F.transform(F.split(name, ""), lambda x: F.ascii(x))
    kind = lambda name: F.when(name.startswith("_:"), "bnode").otherwise("iri")
    zero = F.array(F.lit(0))

    def rows(df, **given):
        types = {"pos": "int", "ord": "array<int>", "rev": "boolean", "named": "boolean"}
        given = {"g": none, "rev": F.lit(False), "named": F.lit(False), "ord": zero} | given
        every = [*STATEMENT[1:], *TREE]
        return df.select("doc_id", "root", *[given.get(k, F.lit(None)).cast(types.get(k, "string")).alias(k) for k in every])

    tops = rows(occ.filter(F.size("path") == 0), o=c("s"), o_kind=kind(c("s")), at=place(c("path")), ord=letters(c("s")), named=F.lit(True))
    back, virtual = c("kind") == 3, c("kind") < 2
    j = judged.filter("embeds is not null")
    listed = c("list").isNotNull()
    ref = F.concat(F.lit('{"@id":'), lit.json_string(c("child")), F.lit("}"))
    edges = rows(
        j, s=F.when(back, c("child")).when(~virtual, c("s")), p=c("p"), o=F.when(back, c("s")).otherwise(c("child")), o_kind=kind(F.when(back, c("s")).otherwise(c("child"))), up=place(c("held")),
        at=F.when(c("embeds"), place(c("path"))), rev=back, named=c("embeds"), json=F.when(~c("embeds"), ref), list=c("list"), pos=c("pos"), ord=F.when(listed, F.array("pos")).otherwise(letters(c("child"))),
    )
    # Values, types and lists of the nodes that embed.
    n_p = F.concat_ws(" ", c("n").cast("string"), "p")
    own = occ.drop("above", "top").join(st.filter("o_kind is null or o_kind != 'empty'"), _NODE)
    asked = _looked_up(_ruled(rules.of), n_p, "int").isNotNull() | _looked_up(rules.implicit, c("n"), "int").isNotNull()
    # Written, as it is read for types, values, lists and their items.
    own = written(own.filter((c("p") == "@type") | (asked & ~c("p").startswith("@"))), "own")
    fit = F.lit(True)
    for (n, p), sub in rules.of.items():
        pattern = {k: v for k, v in rules.frames[sub].items() if k in ("@value", "@type", "@language")}
        if pattern:
            fit = F.when((c("n") == n) & (c("p") == p), F.coalesce(_value(pattern), F.lit(False)) if "@value" in pattern else F.lit(False)).otherwise(fit)
    value = F.coalesce("json", value_json(True))
    leaf = {k: c(k) for k in ("s", "p", "o", "o_kind", "datatype", "language", "direction", "idx")}
    # A row is shown as a type, as a value, or (a literal under @type) as both.
    shown = own.withColumn("is_type", F.explode(F.array_compact(F.array(F.when(c("p") == "@type", True), F.when(c("o_kind").isin("lit", "json") & c("list").isNull() & fit, False)))))
    of_value = {k: F.when(~c("is_type"), c(k)) for k in ("datatype", "language", "direction", "idx")}
    said = rows(shown, **(leaf | of_value), up=place(c("path")), json=F.when(c("is_type"), lit.json_string(c("o"))).otherwise(value))
    out = [tops, edges, said]
    # Lists of these nodes, then those in lists, a depth a round.
    inside = own.filter("list is not null").withColumn("held", F.concat("path", F.array(F.concat_ws("\x00", F.lit("2"), "p", F.lit("1"), "list"))))
    heads = inside.select("doc_id", "root", "s", "p", "path", "held").distinct()
    out.append(rows(heads, s=c("s"), p=c("p"), up=place(c("path")), at=place(c("held"))))
    items = written(inside.drop("path", "n").withColumn("outer", F.lit(True)), "items")
    deeper = st.filter("p = '@list' and list is not null").select("doc_id", "g", c("s").alias("inner"), *[x for x in STATEMENT[3:]])
    while not items.isEmpty():
        at = place(F.concat("held", F.array(c("pos").cast("string"))))
        plain = items.filter(c("o_kind").isin("lit", "json") | (c("o_kind").isin("iri", "bnode") & ~c("outer")))
        leaves = {**leaf, "list": c("list"), "pos": c("pos"), "up": place(c("held")), "ord": F.array("pos"), "json": value}
        out.append(rows(plain, **leaves))
        lists = items.filter("o_kind = 'list'")
        out.append(rows(lists, s=c("s"), p=c("p"), o=c("o"), o_kind=c("o_kind"), list=c("list"), pos=c("pos"), up=place(c("held")), at=at, ord=F.array("pos")))
        next_ = lists.select("doc_id", "root", "g", c("o").alias("inner"), F.concat("held", F.array(c("pos").cast("string"))).alias("held"))
        items = written(next_.join(deeper, ["doc_id", "g", "inner"]).withColumnRenamed("inner", "s").withColumn("outer", F.lit(False)), "items")
    tree = written(reduce(DataFrame.unionByName, out), "framed")
    # Defaults stand for properties that came out empty.
    given = []
    for n, frame in enumerate(rules.frames):
        for p, patterns in frame.items():
            said = _first(patterns)
            if (p.startswith("@") and not (p == "@type" and "@default" in said)) or _flag(said, "@omitDefault", rules.flags.omit_default):
                continue
            given.append((n, p, *_default(said.get("@default", "@null"))))
    if not given:
        return tree
    # As large as the frame.
    known = occ.sparkSession.createDataFrame(given, "n int, p string, o_kind string, json string, o string")
    wanted = occ.join(F.broadcast(known), "n").withColumn("at_", place(c("path")))
    present = tree.filter(~c("rev") & c("up").isNotNull()).select("doc_id", c("up").alias("at_"), "p").distinct()
    missing = wanted.join(present, ["doc_id", "at_", "p"], "left_anti")
    text = F.when(c("p") == "@type", F.to_json(F.try_variant_get(F.parse_json("json"), "$['@value']", "variant"))).otherwise(c("json"))
    return tree.unionByName(rows(missing, s=c("s"), p=c("p"), o=F.coalesce("o", F.get_json_object("json", "$['@value']")), o_kind=F.when(c("p") == "@type", "iri").otherwise(c("o_kind")), up=c("at_"), json=text))


def framed_tree(statements: DataFrame, frame: dict, default_graph: bool = False, embed: str = "@once", explicit: bool = False, require_all: bool = False, omit_default: bool = False) -> DataFrame:
    """The tree (STATEMENT and TREE columns, and ``root``, the result's name) of the nodes that a resolved frame describes, with what they embed.

    Graphs are merged, unless default_graph or @graph in the frame asks for the
    default graph; then a node that names a graph holds that graph's nodes in
    @graph. embed, explicit, require_all and omit_default hold where a frame
    doesn't say. A property with a frame holds the nodes and values that fit
    it, one without holds all it has (nothing under @explicit); nodes are
    embedded in turn. Under @once and @first a node is embedded at its first
    place in a result, under @last at its last, under @always (and @link, as
    text has no links) at each, under @never at none; a node is never embedded
    in itself. Elsewhere it is a reference. Places go by the order of
    properties and of the names of their values; where a frame has @last beside
    @once, @last counts as @once. @included holds the nodes that fit its frame
    and have no place yet. Lists keep their order. A property that the frame
    has and the result lacks gets its @default, or null. Empty arrays are left
    out.
    """
    if embed not in EMBED:
        raise FrameError("invalid @embed value")
    by_graph = default_graph or _mentions_graph(frame)
    st = statements if by_graph else merged(statements)
    st = written(st.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.coalesce("g", F.lit("")).alias("g"), *STATEMENT[2:]), "merged")
    rules = Rules(frame, Flags(embed, explicit, require_all, omit_default))
    rules.wild = rules._add({})
    roots = written(matching(st.filter("g = ''"), frame, rules.require_all[0]).select(*_NODE).distinct(), "found")
    occ, judged = _settled(st, rules, roots, not by_graph)
    return _tree(st, rules, occ, judged).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_DOC)))


def _mentions_graph(frame) -> bool:
    return isinstance(frame, dict) and ("@graph" in frame or any(_mentions_graph(v) for v in frame.values())) or isinstance(frame, list) and any(map(_mentions_graph, frame))


def framed(statements: DataFrame, frame: dict, **options) -> DataFrame:
    """(doc_id, id, node): the nodes that a resolved frame describes, with what they embed, as expanded JSON; defaults without a value are null. Options are those of framed_tree."""
    tops = top_objects(framed_tree(statements, frame, **options))
    return tops.select(F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.col("o").alias("id"), F.col("text").alias("node"))


def frame_json(statements: DataFrame, frame: dict, compact_arrays: bool = True, omit_graph: bool = True, prune: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """((doc_id, doc), errors): every document framed and compacted under the frame's context.

    Options are those of framed_tree. Several nodes stand in @graph, one alone
    only without omit_graph. With prune, a blank node that the result names
    once has no @id. A document that gives a node two indexes, or whose names
    can't be compacted, has an error row and no doc.
    """
    wrong = written(conflicting_indexes(statements), "conflicts")
    right = statements.join(wrong.select(F.col("doc_id").alias("wrong_")), F.col("doc_id").eqNullSafe(F.col("wrong_")), "left_anti")
    rows = framed_tree(right, resolved(statements.sparkSession, frame), **options).drop("root")
    if prune:
        name = F.when(F.col("rev"), F.col("s")).otherwise(F.col("o"))
        once = rows.filter(name.startswith("_:") & F.col("o_kind").isin("iri", "bnode")).groupBy("doc_id", name.alias("name_")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
        once = once.select(F.col("doc_id").alias("id_"), "name_", F.lit(True).alias("once_"))
        rows = rows.join(once, F.col("doc_id").eqNullSafe(F.col("id_")) & (name == F.col("name_")), "left")
        rows = rows.withColumn("named", F.col("named") & F.col("once_").isNull()).drop("id_", "name_", "once_")
    docs, errors = compact_json(rows, json.dumps(frame.get("@context", {}), sort_keys=True, separators=(",", ":"), ensure_ascii=False), compact_arrays=compact_arrays, graph=not omit_graph)
    return docs, errors.unionByName(wrong)
