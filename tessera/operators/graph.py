"""Node objects from statements: flattening, merging graphs, and RDF to JSON-LD."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals as lit
from tessera.operators.expand import STATEMENT
from tessera.operators.rdf import NO_DOC, value_json, with_lists
from tessera.sources.shared import written


def merged(statements: DataFrame) -> DataFrame:
    """All graphs of a document as one; equal values of a property once, lists as often as they stand."""
    every = statements.withColumn("g", F.lit(None).cast("string"))
    return every.filter("list is null").distinct().unionByName(every.filter("list is not null"))


def reversed_edges(statements: DataFrame) -> DataFrame:
    """Node-to-node statements with subject and object in each other's place."""
    kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri")
    edges = statements.filter(F.col("o_kind").isin("iri", "bnode") & (F.col("p") != "@type") & F.col("list").isNull())
    return edges.select("doc_id", "g", F.col("o").alias("s"), "p", F.col("s").alias("o"), kind.alias("o_kind"), *STATEMENT[6:12], F.lit(None).cast("string").alias("json"))


def _references(statements: DataFrame) -> DataFrame:
    """Statements in which every list is a value of kind list, and its items are rows of it, as with_lists gives them."""
    listed = F.col("list").isNotNull()
    items = statements.filter(listed).withColumns({"s": F.col("list"), "p": F.lit("@list")})
    none = F.lit(None)
    refs = statements.filter(listed & (F.col("p") != "@list")).select("doc_id", "g", "s", "p", F.col("list").alias("o"), F.lit("list").alias("o_kind"), *[none.cast("string").alias(c) for c in STATEMENT[6:11]], none.cast("int").alias("pos"), none.cast("string").alias("json")).distinct()
    return statements.filter(~listed).unionByName(refs).unionByName(items)


def listed(statements: DataFrame) -> DataFrame:
    """Statements of with_lists in the form that expansion gives: items of a list that is a property's value stand under that property."""
    refs = statements.filter((F.col("o_kind") == "list") & (F.col("p") != "@list") & (F.col("o") != lit.NIL)).select("doc_id", F.col("o").alias("list"), F.col("s").alias("own_s"), F.col("p").alias("own_p"))
    rest = statements.filter(~((F.col("o_kind") == "list") & (F.col("p") != "@list") & (F.col("o") != lit.NIL)))
    joined = rest.join(refs.withColumnRenamed("doc_id", "id_").withColumnRenamed("list", "list_"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("list") == F.col("list_")), "left")
    return joined.withColumns({"s": F.coalesce("own_s", "s"), "p": F.coalesce("own_p", "p")}).select(*STATEMENT)


def _with_values(st: DataFrame, native_types: bool) -> tuple[DataFrame, DataFrame]:
    """(statements that are no items, with ``value``: their JSON, lists in lists put together from the inside, a level a round; (doc_id, list) of those that hold each other)."""
    st = st.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC))).withColumn("value", value_json(native_types))
    st = st.withColumn("value", F.when(F.col("o_kind") != "list", F.col("value")).when(F.col("o") == lit.NIL, '{"@list":[]}'))
    waiting = written(st.filter("list is not null").select("doc_id", "list", "pos", "o", "o_kind", "value"), "items")
    done = []
    while not waiting.isEmpty():
        lists = waiting.groupBy("doc_id", "list").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "value")))).alias("items"), F.max((F.col("value").isNull() & F.col("pos").isNotNull()).cast("int")).alias("open"))
        ready = written(lists.filter("open = 0").select("doc_id", F.col("list").alias("o"), F.concat(F.lit('{"@list":['), F.array_join(F.transform("items", lambda x: x["value"]), ","), F.lit("]}")).alias("text")), "lists")
        if ready.isEmpty():
            break
        done.append(ready)
        left = waiting.join(ready.select("doc_id", F.col("o").alias("list")), ["doc_id", "list"], "left_anti")
        found = ready.withColumn("o_kind", F.lit("list"))
        waiting = written(left.join(found, ["doc_id", "o", "o_kind"], "left").select("doc_id", "list", "pos", "o", "o_kind", F.coalesce("value", "text").alias("value")), "items")
    plain = st.filter("list is null")
    if done:
        text = reduce(DataFrame.unionByName, done).withColumn("o_kind", F.lit("list"))
        plain = plain.join(text, ["doc_id", "o", "o_kind"], "left").withColumn("value", F.coalesce("value", "text")).drop("text")
    return plain.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_DOC))), waiting.select(F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), "list").distinct()


def _by_property(valued: DataFrame) -> DataFrame:
    return valued.select("doc_id", "g", "s", "p", "value").distinct().groupBy("doc_id", "g", "s", "p").agg(F.array_sort(F.collect_list("value")).alias("values"))


def properties(statements: DataFrame, native_types: bool = False) -> DataFrame:
    """(doc_id, g, s, p, values): the sorted, distinct values of every property as JSON; list items in order, as one value; none for an empty array."""
    return _by_property(_with_values(_references(statements), native_types)[0])


def conflicting_indexes(statements: DataFrame) -> DataFrame:
    """(doc_id, code) of documents that give one node two indexes in a graph."""
    return statements.filter("idx is not null and o_kind in ('iri', 'bnode')").groupBy("doc_id", "g", "o").agg(F.countDistinct("idx").alias("n")).filter("n > 1").select("doc_id", F.lit("conflicting indexes").alias("code")).distinct()


def _nodes(props: DataFrame) -> DataFrame:
    held = F.array_join("values", ",")
    entry = F.concat(lit.json_string(F.col("p")), F.lit(":"), F.when(F.col("p") == "@index", held).otherwise(F.concat(F.lit("["), held, F.lit("]"))))
    each = props.groupBy("doc_id", "g", "s").agg(F.array_sort(F.collect_list(F.struct("p", entry.alias("entry")))).alias("entries"))
    text = F.concat(F.lit('{"@id":'), lit.json_string(F.col("s")), F.lit(","), F.array_join(F.transform("entries", lambda x: x["entry"]), ","), F.lit("}"))
    return each.select("doc_id", "g", F.col("s").alias("id"), text.alias("node"))


def nodes(statements: DataFrame, native_types: bool = False) -> DataFrame:
    """(doc_id, g, id, node): one flattened node object per graph and subject, keys sorted, with the index that it is given where it is named. A node that only has a name has no row."""
    props = properties(statements, native_types)
    indexed = statements.filter("idx is not null and o_kind in ('iri', 'bnode') and p != '@type'").groupBy("doc_id", "g", F.col("o").alias("s")).agg(F.min("idx").alias("idx"))
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("doc_id", "g", "s")]
    own = indexed.alias("a").join(props.select("doc_id", "g", "s").distinct().alias("b"), keys, "left_semi")
    return _nodes(props.unionByName(own.select("doc_id", "g", "s", F.lit("@index").alias("p"), F.array(lit.json_string(F.col("idx"))).alias("values"))))


def folded(all_nodes: DataFrame) -> DataFrame:
    """(doc_id, doc) of nodes (doc_id, g, id, node): every document as an array of node objects in order of name; a named graph is in @graph of its node."""
    all_nodes = all_nodes.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)))
    graphs = all_nodes.filter("g is not null").groupBy("doc_id", F.col("g").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "node"))).alias("inner"))
    inside = F.concat(F.lit('"@graph":['), F.array_join(F.transform("inner", lambda x: x["node"]), ","), F.lit("]"))
    top = all_nodes.filter("g is null").drop("g").join(graphs, ["doc_id", "id"], "full")
    opening = F.concat(F.lit('{"@id":'), lit.json_string(F.col("id")))
    rest = F.expr("substring(node, length(to_json(array(id))) + 6)")  # behind the name
    node = F.when(F.col("node").isNull(), F.concat(opening, F.lit(","), inside, F.lit("}"))).when(F.col("inner").isNull(), F.col("node")).otherwise(F.concat(opening, F.lit(","), inside, rest))
    each = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", node.alias("node")))).alias("all"))
    return each.select(F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["node"]), ","), F.lit("]")).alias("doc"))


def flatten(statements: DataFrame, native_types: bool = False) -> DataFrame:
    """(doc_id, doc): every document flattened, values as it has them (with native_types those that come from RDF as native ones), but those that flatten_errors names."""
    wrong = written(flatten_errors(statements), "conflicts").select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("wrong_"))
    right = statements.join(wrong, F.coalesce("doc_id", F.lit(NO_DOC)) == F.col("wrong_"), "left_anti")
    return folded(nodes(right, native_types))


def flatten_errors(statements: DataFrame) -> DataFrame:
    """(doc_id, code) of the documents that can't be flattened."""
    return conflicting_indexes(statements)


def from_rdf_json(quads: DataFrame, native_types: bool = False, rdf_type: bool = False) -> DataFrame:
    """(doc_id, doc): the quads of every document as one expanded document."""
    return folded(from_rdf(quads, native_types, rdf_type))


def from_rdf(quads: DataFrame, native_types: bool = False, rdf_type: bool = False) -> DataFrame:
    """(doc_id, g, id, node) of quads, lists rebuilt, to any depth of lists in lists.

    Lists that hold each other in a circle stay the cells they are. With
    rdf_type, types are values of rdf:type, not of @type. Quads without a
    doc_id are one document.
    """
    valued, stuck = _with_values(with_lists(quads), native_types)
    if not stuck.isEmpty():
        valued, _ = _with_values(with_lists(quads, stuck), native_types)
    if rdf_type:
        is_type = F.col("p") == "@type"
        valued = valued.withColumns({"value": F.when(is_type, F.concat(F.lit('{"@id":'), F.col("value"), F.lit("}"))).otherwise(F.col("value")), "p": F.when(is_type, lit.TYPE).otherwise(F.col("p"))})
    return _nodes(_by_property(valued))
