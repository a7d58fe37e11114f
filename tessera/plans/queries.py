"""Queries over linked data derived from the star schema, each with its SQL.

Every row of a table becomes a JSON-LD document or a few quads, goes through
the operators, and comes back as plain columns.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import iri
from tessera.functions import literals as lit
from tessera.operators import canon, compact, frame, graph, rdf
from tessera.operators.expand import expand
from tessera.plans import shapes
from tessera.sources import nquads

EX = "http://ex.org/"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def link(kind: str, key: str):
    return F.concat(F.lit(f"{EX}{kind}/"), F.col(key).cast("string"))


def documents(df: DataFrame, key: str, context: dict, **fields) -> DataFrame:
    """(doc_id, doc): a document per row with one context; fields are named by their JSON keys."""
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    doc = F.concat(F.lit('{"@context":' + json.dumps(context, separators=(",", ":")) + ","), F.expr("substring(body, 2)"))
    return df.withColumn("body", body).select(F.col(key).cast("long").alias("doc_id"), doc.alias("doc"))


CUSTOMER = {"@vocab": EX, "id": "@id", "nation": {"@type": "@id"}, "type": "@type"}


def customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return documents(c, "c_custkey", CUSTOMER, id=link("customer", "c_custkey"), type=F.lit("Customer"), name=F.col("c_name"), balance=F.col("c_acctbal"), segment=F.col("c_mktsegment"), nation=link("nation", "c_nationkey"))


def geography(spark, sf_dir) -> DataFrame:
    """Nations and regions as one dataset."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations = documents(n, "n_nationkey", {"@vocab": EX, "id": "@id", "region": {"@type": "@id"}, "type": "@type"}, id=link("nation", "n_nationkey"), type=F.lit("Nation"), name=F.col("n_name"), region=link("region", "n_regionkey"))
    regions = documents(r, "r_regionkey", {"@vocab": EX, "id": "@id", "type": "@type"}, id=link("region", "r_regionkey"), type=F.lit("Region"), name=F.col("r_name"))
    return expand(nations.unionByName(regions.withColumn("doc_id", F.col("doc_id") + 1_000_000))).statements


def world(spark, sf_dir) -> DataFrame:
    """Customers, nations and regions as one dataset."""
    return geography(spark, sf_dir).unionByName(expand(customers(spark, sf_dir)).statements).withColumn("doc_id", F.lit(0).cast("long"))


def field(name: str, of: str = "node"):
    """The first value of a property of a node's JSON text."""
    return F.get_json_object(of, f"$['{EX}{name}'][0]['@value']")


_CUSTOMER_ROWS = f"""
SELECT '{EX}customer/' || c_custkey AS s, '@type' AS p, '{EX}Customer' AS o, NULL::DOUBLE AS num, NULL AS datatype FROM customer
UNION ALL SELECT '{EX}customer/' || c_custkey, '{EX}name', c_name, NULL, '{lit.STRING}' FROM customer
UNION ALL SELECT '{EX}customer/' || c_custkey, '{EX}segment', c_mktsegment, NULL, '{lit.STRING}' FROM customer
UNION ALL SELECT '{EX}customer/' || c_custkey, '{EX}nation', '{EX}nation/' || c_nationkey, NULL, NULL FROM customer
UNION ALL SELECT '{EX}customer/' || c_custkey, '{EX}balance', NULL, c_acctbal, CASE WHEN c_acctbal = floor(c_acctbal) THEN '{lit.INTEGER}' ELSE '{lit.DOUBLE}' END FROM customer
"""


def _numbers(df: DataFrame) -> DataFrame:
    number = F.col("datatype").isin(lit.INTEGER, lit.DOUBLE)
    return df.select("s", "p", F.when(~F.coalesce(number, F.lit(False)), F.col("o")).alias("o"), F.when(number, F.col("o").cast("double")).alias("num"), "datatype")


@query("expand_customer", _CUSTOMER_ROWS)
def expand_customer(spark, sf_dir):
    return _numbers(expand(customers(spark, sf_dir)).statements)


@query("to_rdf_customer", _CUSTOMER_ROWS.replace("'@type'", f"'{lit.TYPE}'"))
def to_rdf_customer(spark, sf_dir):
    return _numbers(rdf.to_rdf(expand(customers(spark, sf_dir)).statements))


@query("nquads_nation", f"""
SELECT '<{EX}nation/' || n_nationkey || '> <{EX}name> "' || n_name || '" .' AS line FROM nation
UNION ALL SELECT '<{EX}nation/' || n_nationkey || '> <{EX}region> <{EX}region/' || n_regionkey || '> .' FROM nation
UNION ALL SELECT '<{EX}nation/' || n_nationkey || '> <{lit.TYPE}> <{EX}Nation> .' FROM nation
UNION ALL SELECT '<{EX}region/' || r_regionkey || '> <{EX}name> "' || r_name || '" .' FROM region
UNION ALL SELECT '<{EX}region/' || r_regionkey || '> <{lit.TYPE}> <{EX}Region> .' FROM region""")  # fmt: skip
def nquads_nation(spark, sf_dir):
    return nquads.serialize(rdf.to_rdf(geography(spark, sf_dir))).select("line")


@query("nquads_round_trip", "SELECT doc_id, md5(text) AS hash, lang AS language FROM documents WHERE text IS NOT NULL")
def nquads_round_trip(spark, sf_dir):
    """Whole texts, with their newlines and quotes, written as literals and parsed again."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    none = F.lit(None).cast("string")
    quads = d.select("doc_id", link("doc", "doc_id").alias("s"), F.lit(EX + "text").alias("p"), F.col("text").alias("o"), F.lit("lit").alias("o_kind"), F.when(F.col("lang").isNull(), lit.STRING).otherwise(lit.LANG_STRING).alias("datatype"), F.col("lang").alias("language"), none.alias("g"))
    return nquads.parse(nquads.serialize(quads)).select("doc_id", F.md5("o").alias("hash"), "language")


@query("well_formed_filter", r"""
SELECT url || CASE WHEN page_id % 3 = 0 THEN ' x' WHEN page_id % 3 = 1 THEN '#a#b' ELSE '' END AS s FROM pages
WHERE page_id % 3 = 2 AND regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT regexp_matches(url, '[ "<>{}|\\^`]')""")
def well_formed_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, " x").when(F.col("page_id") % 3 == 1, "#a#b").otherwise("")
    none = F.lit(None).cast("string")
    quads = p.select("page_id", F.concat("url", tail).alias("s"), F.lit(EX + "p").alias("p"), F.lit("v").alias("o"), F.lit("lit").alias("o_kind"), F.lit(lit.STRING).alias("datatype"), none.alias("language"), none.alias("g"))
    return quads.filter(nquads.well_formed()).select("s")


@query("flatten_orders", f"""
SELECT c_custkey AS doc_id, '{EX}customer/' || c_custkey AS id, c_name AS name, NULL AS status FROM customer
UNION ALL SELECT o_custkey, '{EX}order/' || o_orderkey, NULL, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def flatten_orders(spark, sf_dir):
    """Orders nested in their customers, one document a customer."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(link("order", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("orders"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    docs = documents(c, "c_custkey", {"@vocab": EX, "id": "@id"}, id=link("customer", "c_custkey"), name=F.col("c_name"), order=F.col("orders"))
    return graph.nodes(expand(docs).statements).select("doc_id", "id", field("name").alias("name"), field("status").alias("status"))


@query("merge_graphs", f"""
SELECT '{EX}nation/' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation UNION SELECT '{EX}nation/' || n_nationkey, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT '{EX}nation/' || n_nationkey, 'name', r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def merge_graphs(spark, sf_dir):
    """Two named graphs of a document say some things twice."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct(F.concat(F.lit(EX + "g/1/"), F.col("n_nationkey")).alias("id"), F.array(F.struct(link("nation", "n_nationkey").alias("id"), F.array("n_name", "r_name").alias("name"))).alias("graph"))
    two = F.struct(F.concat(F.lit(EX + "g/2/"), F.col("n_nationkey")).alias("id"), F.array(F.struct(link("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))).alias("graph"))
    docs = documents(n, "n_nationkey", {"@vocab": EX, "id": "@id", "graph": "@graph"}, **{"@graph": F.to_json(F.array(F.to_json(one), F.to_json(two)))})
    docs = docs.withColumn("doc", F.concat(F.lit('{"@context":' + json.dumps({"@vocab": EX, "id": "@id", "graph": "@graph"}) + ',"@graph":['), F.array_join(F.from_json(F.get_json_object("doc", "$['@graph']"), "array<string>"), ","), F.lit("]}")))
    return graph.merged(expand(docs).statements).select("s", F.replace("p", F.lit(EX), F.lit("")).alias("p"), "o")


@query("language_map", "SELECT doc_id, coalesce(lang, '') AS language, md5(text) AS hash FROM documents WHERE text IS NOT NULL")
def language_map(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    docs = documents(d, "doc_id", {"@vocab": EX, "id": "@id", "text": {"@container": "@language"}}, id=link("doc", "doc_id"), text=F.create_map(F.coalesce("lang", F.lit("@none")), F.col("text")))
    return expand(docs).statements.select("doc_id", F.coalesce("language", F.lit("")).alias("language"), F.md5("o").alias("hash"))


def _by_region(spark, sf_dir, items):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(items)).alias("nations"))
    return table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))


@query("index_map", f"SELECT '{EX}region/' || n_regionkey AS s, '{EX}nation/' || n_nationkey AS o, n_name AS idx FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)")
def index_map(spark, sf_dir):
    r = _by_region(spark, sf_dir, F.struct("n_name", link("nation", "n_nationkey")))
    docs = documents(r, "r_regionkey", {"@vocab": EX, "id": "@id", "nation": {"@type": "@id", "@container": "@index"}}, id=link("region", "r_regionkey"), nation=F.col("nations"))
    return expand(docs).statements.select("s", "o", "idx")


@query("id_map", f"SELECT '{EX}region/' || n_regionkey AS region, '{EX}nation/' || n_nationkey AS nation, n_name AS name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)")
def id_map(spark, sf_dir):
    r = _by_region(spark, sf_dir, F.struct(link("nation", "n_nationkey"), F.struct(F.col("n_name").alias("name"))))
    docs = documents(r, "r_regionkey", {"@vocab": EX, "id": "@id", "nation": {"@container": "@id"}}, id=link("region", "r_regionkey"), nation=F.col("nations"))
    st = expand(docs).statements
    edges = st.filter(F.col("p") == EX + "nation").select("doc_id", F.col("s").alias("region"), F.col("o").alias("nation"))
    return edges.join(st.filter(F.col("p") == EX + "name").select("doc_id", F.col("s").alias("nation"), F.col("o").alias("name")), ["doc_id", "nation"]).select("region", "nation", "name")


@query("type_map", f"SELECT '{EX}customer/' || c_custkey AS s, '{EX}' || c_mktsegment AS type, c_name AS name FROM customer")
def type_map(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    docs = documents(c, "c_custkey", {"@vocab": EX, "id": "@id", "member": {"@container": "@type"}}, id=link("club", "c_custkey"), member=F.create_map("c_mktsegment", F.struct(link("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"))))
    st = expand(docs).statements
    return st.filter(F.col("p") == "@type").select("doc_id", "s", F.col("o").alias("type")).join(st.filter(F.col("p") == EX + "name").select("doc_id", "s", F.col("o").alias("name")), ["doc_id", "s"]).select("s", "type", "name")


@query("list_round_trip", """
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS part FROM lineitem""")
def list_round_trip(spark, sf_dir):
    """Items of an order as an ordered list: to chains of cells in RDF and back."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    docs = documents(li, "l_orderkey", {"@vocab": EX, "id": "@id", "items": {"@container": "@list"}}, id=link("order", "l_orderkey"), items=F.transform("items", lambda x: x["l_partkey"]))
    st = rdf.with_lists(rdf.to_rdf(expand(docs).statements))
    return st.filter("p = '@list'").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("o").cast("long").alias("part"))


@query("reverse_property", f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}region' AS p, '{EX}region/' || n_regionkey AS o FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)")
def reverse_property(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(link("nation", "n_nationkey").alias("id"))).alias("nations"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    docs = documents(r, "r_regionkey", {"@vocab": EX, "id": "@id"}, id=link("region", "r_regionkey"), **{"@reverse": F.struct(F.col("nations").alias("region"))})
    return expand(docs).statements.select("s", "p", "o")


@query("from_rdf_nodes", f"""
SELECT '{EX}region/' || n_regionkey AS id, '{{"@id":"{EX}region/' || n_regionkey || '","{EX}nation":[' || string_agg('{{"@id":"{EX}nation/' || n_nationkey || '"}}', ',' ORDER BY '{{"@id":"{EX}nation/' || n_nationkey || '"}}') || ']}}' AS node FROM nation GROUP BY n_regionkey""")
def from_rdf_nodes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    none = F.lit(None).cast("string")
    quads = n.select(F.lit(0).cast("long").alias("doc_id"), link("region", "n_regionkey").alias("s"), F.lit(EX + "nation").alias("p"), link("nation", "n_nationkey").alias("o"), F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("language"), none.alias("g"))
    return graph.from_rdf(quads.unionAll(quads)).select("id", "node")


@query("native_types", f"SELECT '{EX}part/' || p_partkey AS id, p_size::BIGINT AS size, p_retailprice AS price, p_size > 25 AS large FROM part")
def native_types(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = lambda name, value, dt: F.struct(F.lit(EX + name).alias("p"), value.alias("o"), F.lit(dt).alias("datatype"))
    rows = F.array(row("size", F.col("p_size").cast("string"), lit.INTEGER), row("price", lit.xsd_double(F.col("p_retailprice")), lit.DOUBLE), row("large", (F.col("p_size") > 25).cast("string"), lit.BOOLEAN))
    none = F.lit(None).cast("string")
    quads = p.select(F.col("p_partkey").cast("long").alias("doc_id"), link("part", "p_partkey").alias("s"), F.explode(rows).alias("r")).select("doc_id", "s", "r.p", "r.o", F.lit("lit").alias("o_kind"), "r.datatype", none.alias("language"), none.alias("g"))
    n = graph.from_rdf(quads, native_types=True)
    return n.select("id", field("size").cast("long").alias("size"), field("price").cast("double").alias("price"), field("large").cast("boolean").alias("large"))


def _frame(spark, f: dict) -> dict:
    return frame.resolved(spark, {"@context": CUSTOMER | {"region": {"@type": "@id"}}} | f)


@query("frame_type", f"SELECT '{EX}nation/' || n_nationkey AS id FROM nation")
def frame_type(spark, sf_dir):
    return frame.matching(world(spark, sf_dir), _frame(spark, {"type": "Nation"})).select(F.col("s").alias("id"))


@query("frame_value", f"SELECT '{EX}customer/' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def frame_value(spark, sf_dir):
    return frame.matching(world(spark, sf_dir), _frame(spark, {"segment": {"@value": "BUILDING"}})).select(F.col("s").alias("id"))


@query("frame_require_all", f"SELECT '{EX}customer/' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND n_regionkey = 1")
def frame_require_all(spark, sf_dir):
    f = {"@requireAll": True, "type": "Customer", "segment": {"@value": "MACHINERY"}, "nation": {"@requireAll": True, "type": "Nation", "region": {"id": EX + "region/1"}}}
    return frame.matching(world(spark, sf_dir), _frame(spark, f)).select(F.col("s").alias("id"))


@query("frame_absent", f"SELECT '{EX}region/' || r_regionkey AS id FROM region UNION ALL SELECT '{EX}nation/' || n_nationkey FROM nation")
def frame_absent(spark, sf_dir):
    return frame.matching(world(spark, sf_dir), _frame(spark, {"segment": [], "name": {}, "@requireAll": True})).select(F.col("s").alias("id"))


@query("frame_embed", f"SELECT '{EX}customer/' || c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def frame_embed(spark, sf_dir):
    f = _frame(spark, {"type": "Customer", "nation": {"type": "Nation", "region": {"type": "Region"}}})
    got = frame.framed(world(spark, sf_dir), f)
    inner = lambda path: F.get_json_object("node", f"$['{EX}nation'][0]{path}['{EX}name'][0]['@value']")
    return got.select("id", field("name").alias("name"), inner("").alias("nation"), inner(f"['{EX}region'][0]").alias("region"))


@query("frame_reverse", f"SELECT '{EX}region/' || n_regionkey AS id, count(*) AS n FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) GROUP BY n_regionkey")
def frame_reverse(spark, sf_dir):
    f = _frame(spark, {"type": "Region", "@reverse": {"region": {"@explicit": True}}})
    got = frame.framed(world(spark, sf_dir), f)
    held = F.from_json(F.get_json_object("node", f"$['@reverse']['{EX}region']"), "array<string>")
    return got.select("id", F.size(held).cast("long").alias("n"))


@query("frame_default", f"SELECT '{EX}nation/' || n_nationkey AS id, 'none' AS segment FROM nation")
def frame_default(spark, sf_dir):
    got = frame.framed(world(spark, sf_dir), _frame(spark, {"type": "Nation", "segment": {"@default": "none"}}))
    return got.select("id", field("segment").alias("segment"))


@query("compact_customer", f"SELECT '{EX}customer/' || c_custkey AS id, c_name AS name, c_acctbal AS balance, 'ex:nation/' || c_nationkey AS nation, 'ex:Customer' AS type FROM customer")
def compact_customer(spark, sf_dir):
    context = {"ex": EX, "label": EX + "name", "balance": EX + "balance", "nation": {"@id": EX + "nation", "@type": "@id"}, "segments": {"@id": EX + "segment", "@container": "@set"}}
    got, _ = compact.compact_json(expand(customers(spark, sf_dir)).tree, json.dumps(context))
    of = lambda path: F.get_json_object("doc", path)
    return got.select(F.regexp_replace(of("$['@id']"), "^ex:", EX).alias("id"), of("$.label").alias("name"), of("$.balance").cast("double").alias("balance"), of("$.nation").alias("nation"), of("$['@type']").alias("type"))


@query("canonical_hash", f"""
WITH l AS (SELECT n_nationkey AS doc_id, '<{EX}nation/' || n_nationkey || '> <{EX}name> "' || n_name || '" .' AS line FROM nation
UNION ALL SELECT n_nationkey, '<{EX}nation/' || n_nationkey || '> <{EX}place> _:c14n0 .' FROM nation
UNION ALL SELECT n_nationkey, '_:c14n0 <{EX}in> <{EX}region/' || n_regionkey || '> .' FROM nation)
SELECT doc_id::BIGINT AS doc_id, sha256(string_agg(line, chr(10) ORDER BY encode(line)) || chr(10)) AS hash FROM l GROUP BY doc_id""")
def canonical_hash(spark, sf_dir):
    """Documents with a blank node each, hashed over their canonical lines."""
    n = table(spark, sf_dir, "nation")
    docs = documents(n, "n_nationkey", {"@vocab": EX, "id": "@id", "in": {"@type": "@id"}}, id=link("nation", "n_nationkey"), name=F.col("n_name"), place=F.struct(link("region", "n_regionkey").alias("in")))
    lines, _ = canon.canonize(rdf.to_rdf(expand(docs).statements))
    return canon.digest(lines)


@query("canonical_json", """SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","user":' || user_id || '}' AS json FROM events""")
def canonical_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.parse_json(F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.col("event_id").alias("id"))))
    return e.select("event_id", canon.canonical_json(v).alias("json"))


@query("canonical_nested", """SELECT event_id, '{"a":{"t":"' || event_type || '","z":null},"b":[' || user_id || ',[true,{"id":' || event_id || '}]]}' AS json FROM events""")
def canonical_nested(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.format_string('{"b":[%d.0, [true, {"id": %d}]], "a":{"z":null,"t":"%s"}}', "user_id", "event_id", "event_type")
    return e.select("event_id", canon.canonical_json(F.parse_json(doc)).alias("json"))


@query("canonical_ties", f"SELECT n_nationkey::BIGINT AS doc_id, '<{EX}nation/' || n_nationkey || '> <{EX}has> _:c14n' || i || ' .' AS line FROM nation, (VALUES (0), (1)) t(i)")
def canonical_ties(spark, sf_dir):
    """Two blank nodes that nothing tells apart."""
    n = table(spark, sf_dir, "nation")
    none = F.lit(None).cast("string")
    quads = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), link("nation", "n_nationkey").alias("s"), F.lit(EX + "has").alias("p"), F.explode(F.array(F.lit("_:x"), F.lit("_:y"))).alias("o"), F.lit("bnode").alias("o_kind"), none.alias("datatype"), none.alias("language"), none.alias("g"))
    return canon.canonize(quads)[0]


@query("canonical_chains", "SELECT c_custkey::BIGINT AS doc_id, 40::BIGINT AS names, true AS same FROM customer")
def canonical_chains(spark, sf_dir):
    """Two like chains of 20 blank nodes a customer: as many names as nodes, and the same lines under other labels in another order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id")).repartition(spark.sparkContext.defaultParallelism).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(37))))
    none = F.lit(None).cast("string")
    at = lambda i: F.concat(F.lit("_:"), F.when(i % 2 == 0, "a").otherwise("b"), i.cast("string"))
    other = lambda i: F.concat(F.lit("_:x"), (F.col("doc_id") * 40 + 39 - i).cast("string"))
    quads = lambda name: c.select("doc_id", name(F.col("i")).alias("s"), F.lit(EX + "next").alias("p"), name(F.col("i") + 2).alias("o"), F.lit("bnode").alias("o_kind"), none.alias("datatype"), none.alias("language"), none.alias("g"))
    one, two = (canon.canonize(quads(name), work=None)[0] for name in (at, other))
    names = one.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"_:c14n\d+"), F.lit(0))).alias("name")).groupBy("doc_id").agg(F.count_distinct("name").alias("names"))
    same = canon.digest(one).join(canon.digest(two).withColumnRenamed("hash", "other"), "doc_id", "left")
    return names.join(same, "doc_id").select("doc_id", "names", (F.col("hash") == F.col("other")).alias("same"))


_A = f"<{EX}c/"
#: Ends of a line after its subject, which of their characters the error is at, and its code.
_ENDS = [("> <p> \"$n .", 7, "invalid literal"), ("> <p> $n .", 7, "unexpected character"), ("> <p> <o> <g> <h> .", 15, "expected '.'"), ("> <p> <o>", 10, "unexpected end"), ("> <p> <o> <$n .", 11, "invalid IRI"), ("> \"$n\" <o> .", 3, "literal out of place"), ("> <p> \"$n\"@en <g> .", None, None)]


@query("nquads_errors", f"""
SELECT c_custkey::BIGINT AS doc_id, 2::INTEGER AS number, (length('{_A}' || c_custkey) + ([{", ".join(str(at) for _, at, _ in _ENDS[:-1])}])[c_custkey % {len(_ENDS)} + 1])::INTEGER AS "column", ([{", ".join("'" + code.replace("'", "''") + "'" for *_, code in _ENDS[:-1])}])[c_custkey % {len(_ENDS)} + 1] AS code
FROM customer WHERE c_custkey % {len(_ENDS)} < {len(_ENDS) - 1}""")  # fmt: skip
def nquads_errors(spark, sf_dir):
    """A text of three lines for every customer, the second broken in one of six ways or sound."""
    c = table(spark, sf_dir, "customer")
    end = F.replace(F.get(F.array(*[F.lit(end) for end, *_ in _ENDS]), (F.col("c_custkey") % len(_ENDS)).cast("int")), F.lit("$n"), F.col("c_name"))
    text = F.concat(F.lit("# customers\n" + _A), F.col("c_custkey").cast("string"), end, F.lit(f"\n<{EX}a> <{EX}b> _:c ."))
    return nquads.errors(nquads.lines_of(c.select(F.col("c_custkey").cast("long").alias("doc_id"), text.alias("text")))).select("doc_id", "number", "column", "code")


@query("relative_urls", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/x/y' AS url, '../x/y' AS ref FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+')")
def relative_urls(spark, sf_dir):
    """An address beside every page's host, as a reference, and resolved again."""
    p = table(spark, sf_dir, "pages").filter(F.col("url").rlike("^[a-z]+://[^/?#]+"))
    host = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    p = p.select("page_id", F.concat(host, F.lit("/a/b")).alias("base"), F.concat(host, F.lit("/x/y")).alias("to")).withColumn("ref", iri.relative_to(F.col("base"), F.col("to")))
    return p.select("page_id", iri.resolve(F.col("base"), F.col("ref")).alias("url"), "ref")


@query("reversed_edges", f"SELECT '{EX}region/' || n_regionkey AS s, '{EX}region' AS p, '{EX}nation/' || n_nationkey AS o FROM nation")
def reversed_edges(spark, sf_dir):
    return graph.reversed_edges(geography(spark, sf_dir)).select("s", "p", "o")


@query("error_codes", """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'loading document failed' WHEN 1 THEN 'cyclic IRI mapping' WHEN 2 THEN 'invalid type value' WHEN 3 THEN 'invalid container mapping' WHEN 4 THEN 'invalid language-tagged string' END AS code, count(*) AS n
FROM part WHERE p_partkey % 6 < 5 GROUP BY 1""")
def error_codes(spark, sf_dir):
    """Five kinds of broken documents, and sound ones, one for each part."""
    texts = ["{", '{"@context":{"a":"b:x","b":"a:y"},"a":1}', '{"@context":{"@vocab":"http://ex.org/"},"@type":7}', '{"@context":{"a":{"@id":"http://ex.org/a","@container":"@bag"}},"a":1}', '{"@context":{"@vocab":"http://ex.org/"},"a":{"@value":"x","@language":3}}', '{"@context":{"@vocab":"http://ex.org/"},"a":1}']
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 6).cast("int")).alias("doc"))
    return expand(p).errors.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_urls", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/a/c?q' AS url FROM pages")
def resolve_urls(spark, sf_dir):
    """A reference with dot segments against every page's address."""
    return table(spark, sf_dir, "pages").select("page_id", iri.resolve(F.col("url"), F.lit("/a/./b/../c?q")).alias("url"))


QUERIES |= shapes.QUERIES
ORACLE |= shapes.ORACLE


def flagship(spark, sf_dir) -> DataFrame:
    """Documents to RDF, lists and nodes rebuilt, customers framed with their nations and regions."""
    return frame_embed(spark, sf_dir)
