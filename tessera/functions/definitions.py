"""What one local context makes of an active one.

A small helper for the rows of the context dimension (see operators.context):
it sees one distinct context at a time, never a document. Definitions of a
context lean on each other by name, in any order and to any depth, so they are
settled by recursion. An active context is a plain dict, stored as JSON.
"""
from __future__ import annotations

import hashlib
import json
import re
import sys
from dataclasses import dataclass, field

#: Fixed values of the data model.
KEYWORDS = frozenset(
    "@base @container @context @default @direction @embed @explicit @graph @id @import @included @index @json @language @list @nest @none @null @omitDefault @prefix @preserve @propagate @protected @requireAll @reverse @set @type @value @version @vocab".split()
)
SETTINGS = frozenset("@base @direction @import @language @propagate @protected @version @vocab".split())
CONTAINERS = frozenset("@list @set @index @language @id @type @graph".split())
MEMBERS = frozenset("@id @reverse @container @context @direction @index @language @nest @prefix @protected @type".split())
#: Characters that end an IRI which a simple term may be a prefix of.
PREFIX_ENDS = ":/?#[]@"

_FORM = re.compile(r"@[A-Za-z]+\Z")
_SCHEME = re.compile(r"[^\W\d_](?:[^\W_]|[+.\-])*:")
_PARTS = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\Z", re.S)


class Invalid(Exception):
    """A context that is none; its argument is the code of the data model."""


def absolute(iri: str) -> bool:
    return bool(_SCHEME.match(iri))


def without_dots(path: str) -> str:
    first, *parts = re.sub(r"^(?:\.\.?/)+", "", path).split("/")
    out = ["" if not parts and first in (".", "..") else first]
    for i, x in enumerate(parts):
        if x == "..":
            del out[-1:]
        if x not in (".", ".."):
            out.append("/" + x)
        elif i == len(parts) - 1:
            out.append("/")
    return "".join(out)


def resolve(base: str | None, ref: str) -> str:
    """ref against base (RFC 3986, 5.2); as it is if it is absolute or there is no base."""
    if base is None or absolute(ref):
        return ref
    scheme, authority, path, query, _ = _PARTS.match(base).groups()
    _, authority_2, path_2, query_2, fragment = _PARTS.match(ref).groups()
    if authority_2 is not None:
        authority, path, query = authority_2, without_dots(path_2) if path_2 else "", query_2
    elif path_2 == "":
        query = query if query_2 is None else query_2
    else:
        if not path_2.startswith("/"):
            path_2 = "/" + path_2 if authority is not None and not path else path.rpartition("/")[0] + "/" + path_2 if "/" in path else path_2
        path, query = without_dots(path_2), query_2
    return (f"{scheme}:" if scheme else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")


def initial(base: str | None, old: bool = False) -> dict:
    return {"base": base, "original": base, "vocab": None, "language": None, "direction": None, "prev": None, "old": old, "terms": {}}


def key_of(active: dict) -> str:
    return hashlib.sha256(json.dumps(active, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:40]


@dataclass
class Loading:
    """Documents by URL, each with the address that it was found at (final), contexts that others go back to, and the longest chain of remote contexts."""

    remote: dict[str, dict] | None = None
    kept: dict[str, dict] = field(default_factory=dict)
    most: int = 50


@dataclass
class _Local:
    """A local context while its terms are defined."""

    members: dict
    base: str | None
    chain: tuple
    loading: Loading
    override: bool
    protected: bool
    done: dict[str, bool] = field(default_factory=dict)


def fetched(url: str, base: str | None, chain: tuple, loading: Loading) -> tuple[str, str, object]:
    """The address asked for, the one that the document was found at, and the document's context."""
    url = resolve(base, url)
    if url in chain:
        raise Invalid("recursive context inclusion")
    if len(chain) >= loading.most or loading.remote is None or url not in loading.remote:
        raise Invalid("loading remote context failed")
    try:
        document = json.loads(loading.remote[url]["document"])
    except (TypeError, ValueError):
        raise Invalid("loading remote context failed") from None
    if not isinstance(document, dict) or "@context" not in document:
        raise Invalid("invalid remote context")
    return url, loading.remote[url]["final"] or url, document["@context"]


def apply(active: dict, local, loading: Loading, base: str | None = None, chain: tuple = (), override: bool = False, propagate: bool = True) -> dict:
    """The active context after a local one (null, a URL, an object, or an array of them)."""
    contexts = local if isinstance(local, list) else [local]
    for c in contexts:
        if isinstance(c, dict) and "@propagate" in c:
            if active["old"]:
                raise Invalid("invalid context entry")
            if not isinstance(c["@propagate"], bool):
                raise Invalid("invalid @propagate value")
            propagate = c["@propagate"]
    out = {**active, "terms": dict(active["terms"])}
    if not propagate and out["prev"] is None:
        out["prev"] = key_of(active)
        loading.kept[out["prev"]] = active
    for c in contexts:
        if c is None:
            if not override and any(t["protected"] for t in out["terms"].values()):
                raise Invalid("invalid context nullification")
            out = {**initial(out["original"], out["old"]), "prev": None if propagate else out["prev"]}
        elif isinstance(c, str):
            url, final, inner = fetched(c, base, chain, loading)
            out = apply(out, inner, loading, final, (*chain, url), override, propagate)
        elif isinstance(c, dict):
            out = _with_object(out, c, loading, base, chain, override)
        else:
            raise Invalid("invalid local context")
    return out


def _with_object(out: dict, c: dict, loading: Loading, base, chain, override) -> dict:
    if "@version" in c:
        if isinstance(c["@version"], bool) or c["@version"] != 1.1:
            raise Invalid("invalid @version value")
        if out["old"]:
            raise Invalid("processing mode conflict")
    if "@import" in c:
        if out["old"]:
            raise Invalid("invalid context entry")
        if not isinstance(c["@import"], str):
            raise Invalid("invalid @import value")
        *_, imported = fetched(c["@import"], base, (), loading)
        if not isinstance(imported, dict):
            raise Invalid("invalid remote context")
        if "@import" in imported:
            raise Invalid("invalid context entry")
        c = imported | {k: v for k, v in c.items() if k != "@import"}
    local = _Local(c, base, chain, loading, override, c.get("@protected") is True)
    if "@base" in c and not chain:
        b = c["@base"]
        if b is None:
            out["base"] = None
        elif not isinstance(b, str) or not (absolute(b) or b == "" or out["base"] is not None):
            raise Invalid("invalid base IRI")
        elif b:
            out["base"] = resolve(out["base"], b)
    if "@vocab" in c:
        v = c["@vocab"]
        if v is not None and not isinstance(v, str):
            raise Invalid("invalid vocab mapping")
        if v is not None:
            v = expand(out, v, local, vocab=True, relative=True)
            if v is None or (out["old"] and not absolute(v) and not v.startswith("_:")):
                raise Invalid("invalid vocab mapping")
        out["vocab"] = v
    if "@language" in c:
        if c["@language"] is not None and not isinstance(c["@language"], str):
            raise Invalid("invalid default language")
        out["language"] = c["@language"] and c["@language"].lower()
    if "@direction" in c:
        if c["@direction"] not in (None, "ltr", "rtl"):
            raise Invalid("invalid base direction")
        out["direction"] = c["@direction"]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 8 * len(c)))
    try:
        for term in c:
            if term not in SETTINGS:
                define(out, local, term)
    finally:
        sys.setrecursionlimit(limit)
    return out


def expand(active: dict, value: str, local: _Local | None = None, vocab: bool = False, relative: bool = False) -> str | None:
    """A name in full, defining what it leans on first; null for a null-mapped or keyword-like one."""
    if value in KEYWORDS:
        return value
    if _FORM.match(value):
        return None
    waits = lambda t: local is not None and t in local.members and t not in SETTINGS and local.done.get(t) is not True
    if waits(value):
        define(active, local, value)
    term = active["terms"].get(value)
    if term is not None and (vocab or term["iri"] in KEYWORDS):
        return term["iri"]
    if ":" in value[1:]:
        prefix, suffix = value.split(":", 1)
        if prefix == "_" or suffix.startswith("//"):
            return value
        if waits(prefix):
            define(active, local, prefix)
        known = active["terms"].get(prefix)
        if known is not None and known["iri"] is not None and known["prefix"]:
            return known["iri"] + suffix
        if absolute(value):
            return value
    if vocab and active["vocab"] is not None:
        return active["vocab"] + value
    return resolve(active["base"], value) if relative else value


def define(active: dict, local: _Local, term: str) -> None:
    """Add a term of a local context, or raise the code of what is wrong with it."""
    if term in local.done:
        if not local.done[term]:
            raise Invalid("cyclic IRI mapping")
        return
    if term == "" or term.startswith(("./", "../")):
        raise Invalid("invalid term definition" if term == "" or isinstance(local.members[term], dict) else "invalid IRI mapping")
    value, old = local.members[term], active["old"]
    local.done[term] = False
    if term in ("@type", "@id"):
        known = active["terms"].get(term)
        if known is not None and known["protected"] and not local.override:
            raise Invalid("protected term redefinition")
        members = {"@container", "@protected"} | ({"@id"} if term == "@type" else set())
        if old or not isinstance(value, dict) or not set(value) <= members or value.get("@container") not in ("@set", ["@set"]):
            raise Invalid("keyword redefinition")
    elif term in KEYWORDS:
        raise Invalid("keyword redefinition")
    elif _FORM.match(term):
        local.done[term] = True
        return
    before = active["terms"].pop(term, None)
    simple = isinstance(value, str)
    if value is None or simple:
        value = {"@id": value}
    if not isinstance(value, dict) or not set(value) <= MEMBERS:
        raise Invalid("invalid term definition")
    if old and {"@protected", "@prefix", "@context", "@nest", "@index"} & set(value):
        raise Invalid("invalid term definition")
    protected = value.get("@protected", local.protected)
    if not isinstance(protected, bool):
        raise Invalid("invalid @protected value")
    d = {"iri": None, "type": None, "container": [], "language": None, "plain": False, "direction": None, "undirected": False, "reverse": False, "nest": None, "index": None, "prefix": False, "protected": protected, "scoped": None, "scoped_base": None}
    if "@type" in value:
        d["type"] = _type(active, local, value["@type"])
    if "@reverse" in value:
        iri = value["@reverse"]
        if "@id" in value or "@nest" in value:
            raise Invalid("invalid reverse property")
        if not isinstance(iri, str):
            raise Invalid("invalid IRI mapping")
        if _FORM.match(iri):
            local.done[term] = True
            return
        d["iri"] = expand(active, iri, local, vocab=True)
        if d["iri"] is None or not absolute(d["iri"]):
            raise Invalid("invalid IRI mapping")
        if value.get("@container") not in (None, "@set", "@index"):
            raise Invalid("invalid reverse property")
        d["container"], d["reverse"] = [value["@container"]] if value.get("@container") else [], True
    else:
        if not _iri(active, local, term, value, simple, d):
            local.done[term] = True
            return
        _rest(active, local, term, value, d)
    if before is not None and before["protected"] and not local.override:
        if {**before, "protected": True} != {**d, "protected": True}:
            raise Invalid("protected term redefinition")
        d = before
    active["terms"][term] = d
    local.done[term] = True


def _type(active: dict, local: _Local, kind) -> str:
    if not isinstance(kind, str):
        raise Invalid("invalid type mapping")
    kind = expand(active, kind, local, vocab=True)
    if kind is None or kind.startswith("_:") or (active["old"] and kind in ("@json", "@none")) or not (kind in ("@id", "@vocab", "@json", "@none") or absolute(kind)):
        raise Invalid("invalid type mapping")
    return kind


def _iri(active: dict, local: _Local, term: str, value: dict, simple: bool, d: dict) -> bool:
    """The name of a term and whether it serves as a prefix; false for a definition that is to be passed by."""
    if "@id" in value and value["@id"] != term:
        iri = value["@id"]
        if iri is None:
            return True
        if not isinstance(iri, str):
            raise Invalid("invalid IRI mapping")
        if iri not in KEYWORDS and _FORM.match(iri):
            return False
        iri = expand(active, iri, local, vocab=True)
        if iri == "@context":
            raise Invalid("invalid keyword alias")
        if iri is None or not (iri in KEYWORDS or absolute(iri) or iri.startswith("_:")):
            raise Invalid("invalid IRI mapping")
        if ":" in term[1:-1] or "/" in term:
            local.done[term] = True
            if not active["old"] and expand(active, term, local, vocab=True) != iri:
                raise Invalid("invalid IRI mapping")
            local.done[term] = False
        elif ":" not in term:
            d["prefix"] = simple and (iri[-1:] in PREFIX_ENDS or iri.startswith("_:")) or active["old"]
        d["iri"] = iri
        return True
    if ":" in term[1:]:
        prefix, suffix = term.split(":", 1)
        if prefix in local.members and prefix not in SETTINGS:
            define(active, local, prefix)
        known = active["terms"].get(prefix)
        d["iri"] = known["iri"] + suffix if known is not None and known["iri"] is not None else term
    elif "/" in term:
        d["iri"] = expand({**active, "terms": {}}, term, None, vocab=True, relative=True)
        if not absolute(d["iri"]):
            raise Invalid("invalid IRI mapping")
    elif term in ("@type", "@id"):
        d["iri"] = term
    elif active["vocab"] is not None:
        d["iri"] = active["vocab"] + term
    else:
        raise Invalid("invalid IRI mapping")
    return True


def _rest(active: dict, local: _Local, term: str, value: dict, d: dict) -> None:
    """Container, index, scoped context, language, direction, nest and prefix of a term."""
    if "@container" in value:
        c = value["@container"]
        kinds = c if isinstance(c, list) else [c]
        some = set(kinds) if all(isinstance(k, str) for k in kinds) else {None}
        graph = "@graph" in some and some <= {"@graph", "@id", "@index", "@set"} and not {"@id", "@index"} <= some
        if not some <= CONTAINERS or not some or ("@list" in some and len(kinds) > 1) or not (graph or ("@graph" not in some and len(some - {"@set"}) <= 1)):
            raise Invalid("invalid container mapping")
        if active["old"] and (isinstance(c, list) or some & {"@id", "@type", "@graph"}):
            raise Invalid("invalid container mapping")
        if "@type" in some:
            d["type"] = d["type"] or "@id"
            if d["type"] not in ("@id", "@vocab"):
                raise Invalid("invalid type mapping")
        d["container"] = sorted(some)
    if "@index" in value:
        index = value["@index"]
        if "@index" not in d["container"] or not isinstance(index, str) or index in KEYWORDS:
            raise Invalid("invalid term definition")
        full = expand(active, index, local, vocab=True)
        if full is None or not absolute(full):
            raise Invalid("invalid term definition")
        d["index"] = index
    if "@context" in value:
        scoped, urls = value["@context"], []
        strings(scoped, urls)
        if not urls:
            try:
                apply({**active, "prev": None}, scoped, local.loading, local.base, local.chain, override=True)
            except Invalid:
                raise Invalid("invalid scoped context") from None
        d["scoped"], d["scoped_base"] = json.dumps(scoped, sort_keys=True, ensure_ascii=False), local.base
    if "@language" in value and "@type" not in value:
        if value["@language"] is not None and not isinstance(value["@language"], str):
            raise Invalid("invalid language mapping")
        d["language"], d["plain"] = value["@language"] and value["@language"].lower(), value["@language"] is None
    if "@direction" in value and "@type" not in value:
        if value["@direction"] not in (None, "ltr", "rtl"):
            raise Invalid("invalid base direction")
        d["direction"], d["undirected"] = value["@direction"], value["@direction"] is None
    if "@nest" in value:
        nest = value["@nest"]
        if not isinstance(nest, str) or (nest in KEYWORDS and nest != "@nest"):
            raise Invalid("invalid @nest value")
        d["nest"] = nest
    if "@prefix" in value:
        if ":" in term or "/" in term:
            raise Invalid("invalid term definition")
        if not isinstance(value["@prefix"], bool):
            raise Invalid("invalid @prefix value")
        if value["@prefix"] and d["iri"] in KEYWORDS:
            raise Invalid("invalid term definition")
        d["prefix"] = value["@prefix"]


def strings(local, out: list) -> None:
    """URLs that a local context names, also in its terms' contexts."""
    for c in local if isinstance(local, list) else [local]:
        if isinstance(c, str):
            out.append(c)
        elif isinstance(c, dict):
            if isinstance(c.get("@import"), str):
                out.append(c["@import"])
            for v in c.values():
                if isinstance(v, dict) and "@context" in v:
                    strings(v["@context"], out)


def aliases(active: dict) -> dict[str, list[str]]:
    """Terms that stand for each keyword."""
    out: dict[str, list[str]] = {}
    for name, t in sorted(active["terms"].items()):
        if t["iri"] in KEYWORDS and name != t["iri"]:
            out.setdefault(t["iri"], []).append(name)
    return out
