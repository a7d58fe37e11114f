"""Remote contexts over HTTP, fetched once each by Spark tasks into the (url, document) table that expansion joins with."""
from __future__ import annotations

import json
import re
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import definitions
from tessera.operators.context import items, text_of
from tessera.sources.shared import written

#: What is asked for, and the relation of a header that names a context.
ACCEPT = "application/ld+json, application/json;q=0.9, */*;q=0.5"
CONTEXT_LINK = re.compile(r'<([^>]*)>[^,]*?rel="?http://www\.w3\.org/ns/json-ld#context"?')
LOADED = "url string, document string, final_url string, error string"


def load(url: str, timeout: float = 30.0) -> tuple[str | None, str | None, str | None]:
    """(document, address after redirects, error) of one URL. A JSON document whose Link header names a context gets it if it has none."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": ACCEPT}), timeout=timeout) as r:  # noqa: S310
            text, final, kind, link = r.read().decode("utf-8", "replace"), r.geturl(), r.headers.get_content_type(), r.headers.get("Link")
        document = json.loads(text)
    except (OSError, ValueError) as e:
        return None, None, f"loading remote context failed: {e}"
    named = CONTEXT_LINK.search(link or "")
    if named and kind != "application/ld+json" and isinstance(document, dict) and "@context" not in document:
        text = json.dumps({"@context": definitions.resolve(final, named[1]), **document})
    return text, final, None


def fetch(urls: DataFrame, timeout: float = 30.0, loader=load) -> DataFrame:
    """url, document, final_url, error of the distinct URLs of (url), each loaded once; written, so that it stays so."""

    def loaded(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(u, *loader(u, timeout)) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], ["url", "document", "final_url", "error"])

    return written(urls.select("url").filter("url is not null").distinct().mapInArrow(loaded, LOADED), "remote")


def contexts_of(docs: DataFrame, base: str | None = None, timeout: float = 30.0, chain: int = 50, loader=load) -> DataFrame:
    """(url, document, final_url) of all contexts that documents (doc_id, doc) name at their top, and those that these name in turn; final_url is where a document was in the end, which relative addresses in it go by."""
    v = F.try_parse_json("doc")
    tops = docs.select(F.explode(items(v)).alias("v")).select(F.explode(items(F.try_variant_get("v", "$['@context']", "variant"))).alias("c"))

    def resolved(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([u and definitions.resolve(base, u) for u in b.column(0).to_pylist()], pa.string())], ["url"])

    def named(batches):
        import pyarrow as pa

        for b in batches:
            out: list[str] = []
            for url, document in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    inner = json.loads(document)
                except (TypeError, ValueError):
                    continue
                found: list[str] = []
                definitions.strings(inner.get("@context") if isinstance(inner, dict) else None, found)
                out += [definitions.resolve(url, u) for u in found]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["url"])

    new = tops.select(text_of(F.col("c")).alias("url")).distinct().mapInArrow(resolved, "url string")
    every = None
    for _ in range(chain + 1):
        got = fetch(new, timeout, loader)
        if got.isEmpty():
            break
        every = got if every is None else every.unionByName(got)
        # Inner addresses go by where a document was in the end.
        new = got.filter("document is not null").select("final_url", "document").mapInArrow(named, "url string").distinct().join(every.select("url"), "url", "left_anti")
    if every is None:
        return docs.sparkSession.createDataFrame([], "url string, document string, final_url string")
    return every.filter("document is not null").select("url", "document", "final_url")
