"""Statements to quads and back, with ordered lists as chains of cells."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import literals as lit
from tessera.operators.expand import STATEMENT
from tessera.sources.nquads import QUAD, kind_of, well_formed
from tessera.sources.shared import written

#: Stands for a missing doc_id while rows are joined.
NO_DOC = -(1 << 63)
#: Positions of a list that one task numbers.
BLOCK = 1 << 16


def _numbered(items: DataFrame, block: int) -> DataFrame:
    """Items of lists with ``n``, their number from 1 (positions may have gaps), and ``more``, whether others follow; a list of any length goes over all tasks, a block at a time."""
    items = items.withColumns({"doc_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), "block": F.floor(F.coalesce("pos", F.lit(0)) / block)})
    whole = Window.partitionBy("doc_", "list")
    counts = items.groupBy("doc_", "list", "block").agg(F.count(F.lit(1)).alias("inside"))
    counts = counts.select("doc_", "list", "block", (F.sum("inside").over(whole.orderBy("block")) - F.col("inside")).alias("before"), F.sum("inside").over(whole).alias("length"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("doc_", "list", "block").orderBy("pos")))
    n = ranked.join(counts, ["doc_", "list", "block"]).withColumn("n", F.col("before") + F.col("rank"))
    return n.withColumn("more", F.col("n") < F.col("length")).drop("doc_", "block", "rank", "before", "length")


def to_rdf(statements: DataFrame, keep_ill_formed: bool = False, block: int = BLOCK) -> DataFrame:
    """Quads of statements. A list becomes a chain of first and rest; an empty one is rdf:nil.

    Ill-formed quads (relative IRIs, forbidden characters, bad language tags)
    are left out unless asked for; ill_formed names the documents that have some.
    """
    p = F.when(F.col("p") == "@type", lit.TYPE).otherwise(F.col("p"))
    kind = F.when(F.col("o_kind") == "json", "lit").otherwise(F.col("o_kind"))
    st = statements.filter("o_kind is distinct from 'empty'").withColumn("p", p).withColumn("o_kind", kind)
    none = F.lit(None).cast("string")
    plain = st.filter("list is null").select(*QUAD)
    cell = lambda n: F.concat("list", F.lit("_"), n.cast("string"))
    cells = _numbered(st.filter("list is not null"), block)
    own, following = cell(F.col("n")), F.when(F.col("more"), cell(F.col("n") + 1)).otherwise(lit.NIL)
    head = F.when(F.col("pos").isNull(), lit.NIL).otherwise(own)
    # A list in a list is an item that names its first cell.
    nested = F.col("o_kind") == "list"
    item = F.when(nested & (F.col("o") != lit.NIL), F.concat("o", F.lit("_1"))).otherwise(F.col("o"))
    item_kind = F.when(nested, kind_of(item)).otherwise(F.col("o_kind"))
    row = lambda s, p, o, kind, dt=none, lang=none: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), dt.alias("datatype"), lang.alias("language"))
    rows = F.array(
        F.when((F.col("n") == 1) & (F.col("p") != "@list"), row(F.col("s"), F.col("p"), head, kind_of(head))),
        F.when(F.col("pos").isNotNull(), row(own, F.lit(lit.FIRST), item, item_kind, F.col("datatype"), F.col("language"))),
        F.when(F.col("pos").isNotNull(), row(own, F.lit(lit.REST), following, kind_of(following))),
    )
    listed = cells.select("doc_id", "g", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("doc_id", "r.s", "r.p", "r.o", "r.o_kind", "r.datatype", "r.language", "g")
    quads = plain.unionByName(listed)
    return quads if keep_ill_formed else quads.filter(well_formed())


def invalid_json(quads: DataFrame) -> DataFrame:
    """(doc_id, code) of documents with a JSON literal that is no JSON; from_rdf keeps their text as it is."""
    wrong = (F.col("o_kind") == "lit") & (F.col("datatype") == lit.JSON) & F.try_parse_json("o").isNull()
    return quads.filter(wrong).select("doc_id", F.lit("invalid JSON literal").alias("code")).distinct()


def ill_formed(statements: DataFrame) -> DataFrame:
    """(doc_id, code) of documents with quads that can't stand in RDF: what safe mode refuses."""
    return to_rdf(statements, keep_ill_formed=True).filter(~F.coalesce(well_formed(), F.lit(False))).select("doc_id", F.lit("invalid term").alias("code")).distinct()


def _chains(cells: DataFrame) -> DataFrame:
    """(doc_id, k, head, depth) of every cell (doc_id, k, rest) that a chain of rests leads to from a cell which no rest names.

    A cell knows one above it and how far that is; each round it takes what
    that one knows, so the distance doubles. Cells that have met their head
    rest. A round in which none does so leaves circles only, which stay out.
    """
    before = cells.select("doc_id", F.col("k").alias("up"), F.col("rest").alias("k"))
    first = cells.select("doc_id", "k").join(before, ["doc_id", "k"], "left")
    state = written(first.select("doc_id", "k", F.coalesce("up", "k").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("met")), "jump")
    done, still = [state.filter("met")], state.filter("not met")
    while True:
        known = reduce(DataFrame.unionByName, done)
        above = known.unionByName(still).select("doc_id", F.col("k").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("met").alias("top_met"))
        far = written(still.join(above, ["doc_id", "up"]).select("doc_id", "k", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top_met").alias("met")), "jump")
        new, still = far.filter("met"), far.filter("not met")
        if new.isEmpty():
            return known.select("doc_id", "k", F.col("up").alias("head"), "depth")
        done.append(new)


def with_lists(quads: DataFrame, unlisted: DataFrame | None = None) -> DataFrame:
    """Statements of quads (doc_id, s, p, o, o_kind, datatype, language, g): every chain of
    cells that only its one reference and its own rests reach is one list again.

    A cell has one first, one rest, at most the type rdf:List and nothing else,
    and one use in its document. Circles, chains that don't end in rdf:nil, and
    those whose (doc_id, list) is in unlisted stay as they are. o_kind is
    ``list`` where a value is a list; its items are rows whose s is that list.
    Repeated quads count once; quads without a doc_id are one document.
    """
    graph = F.coalesce("g", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))
    q = quads.select(*QUAD).distinct().withColumn("doc_id", doc)
    # Names are compared within a document, as 128-bit hashes.
    hashed = lambda *text: F.unhex(F.md5(F.concat(*text)))
    key = lambda c: hashed(F.length(graph).cast("string"), F.lit(":"), graph, F.col(c))
    q = written(q.withColumns({"k": key("s"), "k_o": F.when(F.col("o_kind") != "lit", key("o"))}), "quads")
    is_list_type = (F.col("p") == lit.TYPE) & (F.col("o") == lit.LIST)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    is_rest = (F.col("p") == lit.REST) & (F.col("o_kind") != "lit")
    shape = q.filter("startswith(s, '_:')").groupBy("doc_id", "k").agg(
        F.max("s").alias("s"), count(F.col("p") == lit.FIRST).alias("firsts"), count(F.col("p") == lit.REST).alias("rests"), count(~(F.col("p").isin(lit.FIRST, lit.REST) | is_list_type)).alias("others"),
        F.max(F.when(is_rest, F.col("k_o"))).alias("rest"), F.max(F.when(is_rest, F.col("o") == lit.NIL)).alias("last"),
    ).filter("firsts = 1 and rests = 1 and others = 0 and rest is not null")
    uses = q.filter("o_kind = 'bnode'").groupBy("doc_id", hashed(F.col("o")).alias("name")).agg(F.count(F.lit(1)).alias("uses")).filter("uses = 1")
    cells = written(shape.withColumn("name", hashed(F.col("s"))).join(uses, ["doc_id", "name"]).select("doc_id", "k", "s", "rest", "last"), "cells")
    found = _chains(cells).join(cells, ["doc_id", "k"])
    names = cells.select("doc_id", F.col("k").alias("head"), F.col("s").alias("list"))
    ends = found.groupBy("doc_id", "head").agg(F.max("last").alias("ends")).filter("ends").drop("ends").join(names, ["doc_id", "head"])
    if unlisted is not None:
        ends = ends.join(unlisted.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), "list"), ["doc_id", "list"], "left_anti")
    chained = written(found.select("doc_id", "k", "head", "depth").join(ends, ["doc_id", "head"]).select("doc_id", "k", "list", "depth"), "members")
    refs = chained.filter("depth = 0").select("doc_id", F.col("k").alias("k_o"), F.lit(True).alias("is_head"))
    rows = q.join(chained, ["doc_id", "k"], "left").filter(F.col("list").isNull() | (F.col("p") == lit.FIRST)).join(refs, ["doc_id", "k_o"], "left")
    p = F.when(F.col("list").isNotNull(), F.lit("@list")).when((F.col("p") == lit.TYPE) & (F.col("o_kind") != "lit"), "@type").otherwise(F.col("p"))
    empty = (F.col("o") == lit.NIL) & (F.col("o_kind") == "iri")
    kind = F.when(F.coalesce("is_head", F.lit(False)) | empty, "list").when((F.col("o_kind") == "lit") & (F.col("datatype") == lit.JSON), "json").otherwise(F.col("o_kind"))
    return rows.select(
        F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), "g", F.coalesce("list", "s").alias("s"), p.alias("p"), "o", kind.alias("o_kind"), "datatype", "language", F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("string").alias("idx"), "list", F.col("depth").cast("int").alias("pos"), F.lit(None).cast("string").alias("json"),
    ).select(*STATEMENT)


def native(value: Column, datatype: Column) -> Column:
    """JSON text of a literal as a native value; null where its text doesn't allow it."""
    whole = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("long").cast("string"))
    real = value.try_cast("double")
    number = F.when(~F.isnan(real) & (F.abs(real) != float("inf")), lit.json_number(real))
    return F.when(datatype == lit.BOOLEAN, F.when(value.isin("true", "1"), "true").when(value.isin("false", "0"), "false")).when(datatype == lit.INTEGER, whole).when(datatype == lit.DOUBLE, number)


def value_json(native_types: bool = False) -> Column:
    """A statement's object as an expanded value, JSON text with sorted keys: as its document has it, or with native_types as its XSD type allows. Null for kind empty."""
    o = lit.json_string(F.col("o"))
    typed = F.concat(F.lit('{"@type":'), lit.json_string(F.col("datatype")), F.lit(',"@value":'), o, F.lit("}"))
    tagged = F.concat(F.lit("{"), F.when(F.col("direction").isNotNull(), F.concat(F.lit('"@direction":'), lit.json_string(F.col("direction")), F.lit(","))).otherwise(""), F.when(F.col("language").isNotNull(), F.concat(F.lit('"@language":'), lit.json_string(F.col("language")), F.lit(","))).otherwise(""), F.lit('"@value":'), o, F.lit("}"))
    literal = F.when(F.col("language").isNotNull() | F.col("direction").isNotNull(), tagged).when(F.coalesce("datatype", F.lit(lit.STRING)) == lit.STRING, F.concat(F.lit('{"@value":'), o, F.lit("}"))).otherwise(typed)
    if native_types:
        literal = F.coalesce(F.concat(F.lit('{"@value":'), native(F.col("o"), F.col("datatype")), F.lit("}")), literal)
    node = F.concat(F.lit('{"@id":'), o, F.lit("}"))
    json = F.concat(F.lit('{"@type":"@json","@value":'), F.col("o"), F.lit("}"))
    own = F.when(F.col("o_kind").isin("lit", "json"), F.col("json"))
    return F.when(F.col("o_kind").isin("iri", "bnode"), F.when(F.col("p") == "@type", o).otherwise(node)).when(F.col("o_kind") == "empty", None).when(own.isNotNull(), own).when(F.col("o_kind") == "json", json).otherwise(literal)
