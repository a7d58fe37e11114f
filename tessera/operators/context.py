"""Contexts as a dimension table: one row per distinct active context.

An active context is what a chain of local contexts makes of the initial one:
the document's own, those embedded in nodes, and those scoped to types and
properties. Rows that need one ask for (context, steps); requests are reduced
to distinct ones, compiled, and met again by a join, so a context is compiled
once however many documents carry it. Its key is a hash of its content.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import definitions, iri
from tessera.functions.definitions import KEYWORDS  # noqa: F401
from tessera.sources.shared import written

#: Documents by URL, and where they were found.
REMOTE = "map<string,struct<document:string,final:string>>"
#: Contexts of a chain of remote contexts, at most.
CHAIN = 50
#: Distinct contexts, and requests for them, that the driver compiles itself; what each request, and all contexts, may take there (characters).
FEW, SMALL, ALL = 500, 1 << 17, 1 << 25

TERM = "struct<iri:string,type:string,container:array<string>,language:string,plain:boolean,direction:string,undirected:boolean,reverse:boolean,nest:string,index:string,prefix:boolean,scoped:string,scoped_base:string>"
ROW = f"ctx_key string, state string, base string, vocab string, language string, direction string, prev string, aliases map<string,string>, terms map<string,{TERM}>"
DERIVED = "parent string, steps string, ctx_key string, error string, state string"


def text_of(v: Column) -> Column:
    """The string that a variant holds; null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def is_null(v: Column) -> Column:
    return F.coalesce(F.is_variant_null(v), F.lit(False))


def members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """A variant array's items, or the variant itself as the only one."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def step(local: Column, base: Column | str | None = None, override: bool = False, propagate: bool = True) -> Column:
    """One local context (JSON text) to be applied, as an element of steps; base is where it came from."""
    base = base if isinstance(base, Column) else F.lit(base).cast("string")
    return F.concat(F.lit('{"local":'), local, F.when(base.isNotNull(), F.concat(F.lit(',"base":'), F.get(F.split(F.to_json(F.array(base)), r"^\[|\]$"), F.lit(1)))).otherwise(""), F.lit(f',"override":{json.dumps(override)},"propagate":{json.dumps(propagate)}}}'))


def _compiled(rows: list[tuple], most: int) -> tuple[list[tuple], dict[str, dict]]:
    """DERIVED rows, without states, of (parent, steps, state, remote); and the contexts that they come to."""
    out, states = [], {}
    for parent, steps, state, remote in rows:
        loading = definitions.Loading(None if remote is None else dict(remote), {}, most)
        try:
            active = json.loads(state)
            for s in json.loads(steps):
                active = definitions.apply(active, s["local"], loading, s.get("base"), (), s["override"], s["propagate"])
                loading.kept[definitions.key_of(active)] = active
        except definitions.Invalid as e:
            out.append((parent, steps, None, e.args[0], None))
        except ValueError:
            out.append((parent, steps, None, "invalid local context", None))
        else:
            out.append((parent, steps, definitions.key_of(active), None, None))
            states |= loading.kept
    return out, states


def _derived(batches, most: int):
    import pyarrow as pa

    for b in batches:
        out, states = _compiled(list(zip(*(c.to_pylist() for c in b.columns))), most)
        out += [(None, None, k, None, json.dumps(a, ensure_ascii=False)) for k, a in states.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 5)], ["parent", "steps", "ctx_key", "error", "state"])


def _urls(batches):
    """(id, base, text of steps or of a context) -> (id, url) of the remote contexts that it names."""
    import pyarrow as pa

    for b in batches:
        ids, urls = [], []
        for i, base, text in zip(*(c.to_pylist() for c in b.columns)):
            try:
                local = json.loads(text)
            except (TypeError, ValueError):
                continue
            found: list[str] = []
            if base is None:
                for s in local:
                    own: list[str] = []
                    definitions.strings(s["local"], own)
                    found += [definitions.resolve(s.get("base"), u) for u in own]
            else:
                definitions.strings(local.get("@context") if isinstance(local, dict) else None, found)
                found = [definitions.resolve(base, u) for u in found]
            ids += [i] * len(found)
            urls += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(urls, pa.string())], ["id", "url"])


class Contexts:
    """The dimension as far as it is needed. remote is (url, document), and final_url if it has one: where a document was found, which addresses in it go by.

    rows: ctx_key, base, vocab, language, direction, prev (the context to go
    back to), aliases (term -> keyword), terms; and state for further steps.
    """

    def __init__(self, spark: SparkSession, base: str | None = None, remote: DataFrame | None = None, mode: str = "json-ld-1.1", chain: int = CHAIN):
        self.spark, self.remote, self.chain = spark, remote, chain
        first = definitions.initial(base, mode == "json-ld-1.0")
        self.start = definitions.key_of(first)
        #: The contexts, while they are few enough to be known here too.
        self.few: dict[str, dict] | None = {self.start: first}
        self.size = 0
        self._known(self.few)

    def _parsed(self, states: DataFrame) -> DataFrame:
        parsed = F.from_json("state", f"struct<base:string,vocab:string,language:string,direction:string,prev:string,terms:map<string,{TERM}>>")
        rows = states.select("ctx_key", "state", parsed.alias("s")).select("ctx_key", "state", "s.base", "s.vocab", "s.language", "s.direction", "s.prev", "s.terms")
        return rows.withColumn("aliases", F.transform_values(F.map_filter("terms", lambda k, t: t["iri"].isin(sorted(KEYWORDS))), lambda k, t: t["iri"]))

    def _states(self, few: dict[str, dict]) -> DataFrame:
        return self.spark.createDataFrame([(k, json.dumps(a, ensure_ascii=False)) for k, a in few.items()], "ctx_key string, state string")

    def _known(self, few: dict[str, dict]) -> None:
        # They are few: joins with them leave the other side where it is, though all its rows may have one key.
        self.rows = F.broadcast(self._parsed(self._states(few)))
        terms = [t for a in few.values() for t in a["terms"].values()]
        #: Whether any context goes back to another, has scoped contexts, or has a name for @nest.
        self.reverts, self.scoped, self.nests = any(a["prev"] for a in few.values()), any(t["scoped"] for t in terms), any(t["iri"] == "@nest" for t in terms)

    def _written(self, states: DataFrame) -> None:
        states = self.rows.select("ctx_key", "state").unionByName(states).dropDuplicates(["ctx_key"])
        self.rows, self.few = written(self._parsed(states), "contexts"), None
        scoped = F.exists(F.map_values("terms"), lambda t: t["scoped"].isNotNull())
        known = self.rows.agg(F.count("prev") > 0, F.max(scoped), F.max(F.array_contains(F.map_values("aliases"), "@nest"))).first()
        self.reverts, self.scoped, self.nests = (bool(k) for k in known)

    def constant(self, key: str) -> dict[str, Column] | None:
        """base, vocab, language, direction, aliases and terms of a context as constants; null for one that only tables know, or that is long."""
        state = None if self.few is None else json.dumps(self.few[key], ensure_ascii=False)
        if state is None or len(state) > SMALL:
            return None
        own = self.few[key]
        terms = F.from_json(F.lit(json.dumps(own["terms"], ensure_ascii=False)), f"map<string,{TERM}>")
        aliases = [F.lit(x) for k, t in own["terms"].items() if t["iri"] in KEYWORDS for x in (k, t["iri"])]
        texts = {c: F.lit(own[c]).cast("string") for c in ("base", "vocab", "language", "direction")}
        return texts | {"aliases": F.create_map(*aliases) if aliases else F.from_json(F.lit("{}"), "map<string,string>"), "terms": terms}

    def derive(self, requests: DataFrame) -> DataFrame:
        """parent, steps, ctx_key, error of every distinct (parent, steps): steps is a JSON array of ``step``. Rows of new contexts are added.

        Up to FEW requests of up to SMALL characters are compiled here, and
        joined from memory while all contexts have up to ALL characters; more
        are compiled by tasks and written.
        """
        asked = requests.select("parent", "steps").distinct()
        most = self.chain
        if self.remote is None and self.few is not None and len(self.few) <= FEW:
            some = asked.select("parent", F.when(F.length("steps") <= SMALL, F.col("steps"))).limit(FEW + 1).collect()
            if len(some) <= FEW and all(r[1] is not None for r in some):
                made, states = _compiled([(r[0], r[1], json.dumps(self.few[r[0]]), None) for r in some], most)
                new = {k: a for k, a in states.items() if k not in self.few}
                self.size += sum(len(json.dumps(a, ensure_ascii=False)) for a in new.values())
                self.few |= new
                if new and self.size > ALL:
                    self._written(self._states(new))
                elif new:
                    self._known(self.few)
                return F.broadcast(self.spark.createDataFrame(made, DERIVED).drop("state"))
        if self.remote is None:
            asked = asked.withColumn("remote", F.lit(None).cast(REMOTE))
        else:
            asked = written(asked.withColumn("id", F.sha2(F.concat("parent", "steps"), 256)), "asked")
            asked = asked.join(self._fetched(asked), "id", "left").select("parent", "steps", F.coalesce("remote", F.create_map().cast(REMOTE)).alias("remote"))
        of = asked.join(self.rows.select(F.col("ctx_key").alias("parent"), "state"), "parent").select("parent", "steps", "state", "remote")
        done = written(of.mapInArrow(lambda batches: _derived(batches, most), DERIVED), "derived")
        self._written(done.filter("state is not null").select("ctx_key", "state"))
        return done.filter("state is null").drop("state")

    def _fetched(self, asked: DataFrame) -> DataFrame:
        """id, remote: the documents that a request can come to, by URL."""
        final = F.coalesce("final_url", "url") if "final_url" in self.remote.columns else F.col("url")
        documents = self.remote.select("url", "document", final.alias("final")).dropDuplicates(["url"])
        new = asked.select("id", F.lit(None).cast("string").alias("base"), F.col("steps").alias("text")).mapInArrow(_urls, "id string, url string").distinct()
        seen = None
        for _ in range(self.chain + 1):
            new = written(new.join(documents, "url").select("id", "url", "document", "final"), "remote")
            if new.isEmpty():
                break
            seen = new if seen is None else seen.unionByName(new)
            new = new.select("id", F.col("final").alias("base"), F.col("document").alias("text")).mapInArrow(_urls, "id string, url string").distinct().join(seen.select("id", "url"), ["id", "url"], "left_anti")
        if seen is None:
            return self.spark.createDataFrame([], f"id string, remote {REMOTE}")
        return seen.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("url", F.struct("document", "final")))).alias("remote"))


def compiled(contexts: DataFrame, remote: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """One row per distinct context of (ctx), JSON text: ctx, ctx_key, base, vocab, language, direction, aliases, terms, error (a code of the data model; then the rest is null)."""
    c = Contexts(contexts.sparkSession, base, remote)
    asked = contexts.filter("ctx is not null").select("ctx", F.lit(c.start).alias("parent"), F.concat(F.lit("["), step(F.col("ctx"), base), F.lit("]")).alias("steps")).distinct()
    return asked.join(c.derive(asked), ["parent", "steps"]).join(c.rows, "ctx_key", "left").select("ctx", "ctx_key", "base", "vocab", "language", "direction", "aliases", "terms", "error")


def expand_iri(value: Column, terms: Column, vocab: Column | None, base: Column | None, by_term: Column | None = None) -> Column:
    """A name in full: by term and vocabulary (if vocab is given, and by_term allows it), by prefix, or against base; null for a null-mapped or keyword-like name."""
    prefix = F.substring_index(value, ":", 1)
    suffix = F.substring(value, F.length(prefix) + 2, F.lit(1 << 30))
    of = F.element_at(terms, prefix)
    by_term = F.lit(vocab is not None) if by_term is None else by_term
    out = F.when(value.isin(sorted(KEYWORDS)), value).when(iri.is_keyword_form(value), None)
    term = F.element_at(terms, value)
    if vocab is not None:
        out = out.when(term.isNotNull() & (by_term | term["iri"].isin(sorted(KEYWORDS))), term["iri"])
    colon = F.when((prefix != "_") & ~suffix.startswith("//") & (F.length(prefix) > 0) & of["prefix"] & of["iri"].isNotNull(), F.concat(of["iri"], suffix)).when(value.startswith("_:") | iri.is_absolute(value), value)
    out = out.when(colon.isNotNull() & F.contains(value, F.lit(":")), colon)
    if vocab is not None:
        out = out.when(by_term & vocab.isNotNull(), F.concat(vocab, value))
    return out.otherwise(iri.resolve(base, value) if base is not None else value)
