"""Trees of rows put together to JSON text: what nests deepest first, a level a round."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals as lit
from tessera.sources.shared import written

#: Stands for a missing doc_id while rows are joined.
NO_DOC = -(1 << 63)


def joined(parts: Column) -> Column:
    return F.array_join(parts, ",")


def member(name: str, text: Column) -> Column:
    """A member of an object; null where its text is."""
    return F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), lit.json_string(text)))


def put_together(rows: DataFrame, entries, close, keyed=None) -> DataFrame:
    """doc_id, up, p, ord, rev and text of the outermost objects of a tree.

    Rows with ``at`` are objects or lists, which hold the rows whose ``up`` is
    their ``at``. rows is read again for every depth, so it comes from written
    tables. entries(rows) makes a table (doc_id, up, parts) of the rows of one
    depth, whose texts are known; close(rows) the text of objects from their
    ``parts`` (null for none); keyed(rows), if given, their ``key``.
    """
    depth_of = lambda place: F.size(F.split(place, "_"))
    depths = [r[0] for r in rows.filter("at is not null").select(depth_of("at").alias("depth")).distinct().orderBy(F.desc("depth")).collect()]
    leaves = rows.filter("at is null").withColumns({"text": F.col("json"), "parts_empty": F.lit(True)})
    done = None
    tops = None
    for d in depths:
        here = rows.filter(F.col("at").isNotNull() & (depth_of("at") == d))
        # A place tells how deep it is, so what lies in these objects is found without them, and dealt once for all that follows.
        inner = leaves if done is None else leaves.unionByName(done)
        inner = inner.filter(F.col("up").isNotNull() & (depth_of("up") == d)).repartition("doc_id", "up")
        made = here.join(entries(inner).withColumnRenamed("up", "at"), ["doc_id", "at"], "left")
        made = made.withColumns({"text": close(made), "parts_empty": F.col("parts").isNull(), **({"key": keyed(made)} if keyed else {})})
        made = written(made.select(*rows.columns, "text", "parts_empty"), "objects")
        inside, top = made.filter("up is not null"), made.filter("up is null")
        done = inside if done is None else done.unionByName(inside)
        tops = top if tops is None else tops.unionByName(top)
    if tops is None:
        tops = rows.filter("false").withColumns({"text": F.lit(None).cast("string"), "parts_empty": F.lit(True)})
    return tops


def top_objects(tree: DataFrame) -> DataFrame:
    """The outermost objects of an expanded tree, with ``text``, their expanded JSON; a missing doc_id is NO_DOC."""
    own = ["doc_id", "up"]
    tree = tree.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)))

    def entries(rows: DataFrame) -> DataFrame:
        values = rows.groupBy(*own, "rev", "p").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))).alias("vs"))
        values = values.withColumn("vs", F.transform("vs", lambda v: v["text"]))
        entry = F.concat(lit.json_string(F.col("p")), F.lit(":["), joined(F.col("vs")), F.lit("]"))
        sides = values.groupBy(*own).agg(*[F.array_sort(F.collect_list(F.when(F.col("rev") == r, F.struct("p", entry.alias("e"))))).alias(n) for n, r in (("forward", False), ("back", True))], F.max(joined(F.col("vs"))).alias("items"))
        back = F.when(F.size("back") > 0, F.array(F.struct(F.lit("@reverse").alias("p"), F.concat(F.lit('"@reverse":{'), joined(F.transform("back", lambda x: x["e"])), F.lit("}")).alias("e"))))
        return sides.select(*own, F.struct(F.concat("forward", F.coalesce(back, F.array().cast("array<struct<p:string,e:string>>"))).alias("entries"), "items").alias("parts"))

    def close(rows: DataFrame) -> Column:
        is_list = F.col("at").isNotNull() & F.coalesce(F.col("o_kind") == "list", F.col("o").isNull())
        o = F.when(F.col("rev"), F.col("s")).otherwise(F.col("o"))
        own_entries = F.array(F.when(F.col("named"), F.struct(F.lit("@id").alias("p"), member("@id", o).alias("e"))), F.when(F.col("idx").isNotNull(), F.struct(F.lit("@index").alias("p"), member("@index", F.col("idx")).alias("e"))))
        every = F.array_sort(F.concat(F.filter(own_entries, lambda x: x.isNotNull()), F.coalesce("parts.entries", F.array().cast("array<struct<p:string,e:string>>"))))
        listed = F.concat(F.lit("{"), F.concat_ws(",", member("@index", F.col("idx")), F.concat(F.lit('"@list":['), F.coalesce("parts.items", F.lit("")), F.lit("]"))), F.lit("}"))
        return F.when(is_list, listed).otherwise(F.concat(F.lit("{"), joined(F.transform(every, lambda x: x["e"])), F.lit("}")))

    return put_together(written(tree, "tree"), entries, close)


def expanded_json(tree: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc): every document of an expanded tree as expanded JSON, keys sorted.

    With docs (doc_id), documents that say nothing are empty arrays; without,
    they have no row.
    """
    tops = top_objects(tree)
    # A top object that only has a name says nothing.
    tops = tops.filter(~F.col("text").rlike(r'^\{(?:"@id":"(?:[^"\\]|\\.)*+")?\}$'))
    out = tops.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("all")).select(F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.concat(F.lit("["), joined(F.transform("all", lambda x: x["text"])), F.lit("]")).alias("doc"))
    if docs is None:
        return out
    return docs.select("doc_id").distinct().join(out.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", F.coalesce("doc", F.lit("[]")).alias("doc"))
