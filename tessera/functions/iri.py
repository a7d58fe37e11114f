"""IRI and language-tag functions over string columns (RFC 3986, BCP 47 shape)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.literals import bound

#: A scheme is a letter, then letters, digits, plus, dot and minus.
SCHEME = r"^\p{L}[\p{L}\p{N}+.\-]*:"
FORBIDDEN = r"[\p{Cntrl} \"<>{}|\\^`]"
LANGUAGE = r"^\p{L}{1,8}(-[\p{L}\p{N}]{1,8})*$"
KEYWORD_FORM = r"^@[A-Za-z]+$"
#: RFC 3986, appendix B: scheme 2, authority 3 (with //), path 5, query 6 (with ?), fragment 8.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def is_absolute(iri: Column) -> Column:
    return iri.rlike(SCHEME)


def is_keyword_form(key: Column) -> Column:
    return key.rlike(KEYWORD_FORM)


def is_well_formed(iri: Column) -> Column:
    """An absolute IRI without forbidden characters and with one fragment at most; null for null."""
    return is_absolute(iri) & ~iri.rlike(FORBIDDEN) & ~iri.rlike("#.*#")


def is_well_formed_language(tag: Column) -> Column:
    return tag.rlike(LANGUAGE)


def without_dot_segments(path: Column) -> Column:
    """RFC 3986, 5.2.4, for paths with and without a slash at their beginning."""
    parts = F.split(F.regexp_replace(path, r"^(?:\.\.?/)+", ""), "/", -1)
    first = F.get(parts, F.lit(0))
    kept = F.aggregate(
        F.slice(parts, 2, 1 << 30),
        F.array(F.when((F.size(parts) == 1) & first.isin(".", ".."), "").otherwise(first)),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(F.concat(F.lit("/"), x)))),
    )
    ends = (F.size(parts) > 1) & F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, ""), F.when(ends, "/").otherwise(""))


def resolve(base: Column, ref: Column) -> Column:
    """ref against base. Absolute references and any without a base stay as they are; an empty one is the base without its fragment."""
    of = lambda c, i: F.regexp_extract(c, PARTS, i)
    start, authority, base_path, base_query = of(base, 1), of(base, 3), of(base, 5), of(base, 6)
    path, query, fragment = of(ref, 5), of(ref, 6), of(ref, 8)
    merged = F.when((base_path == "") & (authority != ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path))
    new_path = F.when(path == "", base_path).otherwise(without_dot_segments(F.when(path.startswith("/"), path).otherwise(merged)))
    new_query = F.when((path == "") & (query == ""), base_query).otherwise(query)
    full = F.when(of(ref, 3) != "", F.concat(start, of(ref, 3), without_dot_segments(path), query, fragment)).otherwise(F.concat(start, authority, new_path, new_query, fragment))
    return F.when(base.isNull() | is_absolute(ref), ref).otherwise(full)


def relative_to(base: Column, iri: Column) -> Column:
    """iri as a reference that resolves to it against base: the inverse of resolve. As it is where they share no authority."""
    of = lambda c, i: F.regexp_extract(c, PARTS, i)
    def path(x):
        # The folder's path ends in a slash, so its last part is empty and no folder.
        up = F.size(x["folders"]) - 1
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(up - 1, F.lit(0))), lambda i: F.when(F.get(x["folders"], i) == F.get(x["parts"], i), i + 1).otherwise(-1))
        common = bound(F.array_position(pairs, F.lit(-1).cast("int")).cast("int"), lambda off: F.least(F.when(off > 0, off - 1).otherwise(up), F.size(x["parts"]) - 1))
        return bound(common, lambda n: F.concat(F.repeat(F.lit("../"), up - n), F.array_join(F.slice(x["parts"], n + 1, F.lit(1 << 30)), "/")))

    split = F.struct(F.split(F.regexp_replace(of(base, 5), "[^/]*$", ""), "/", -1).alias("folders"), F.split(of(iri, 5), "/", -1).alias("parts"))
    whole = F.concat(bound(split, path), of(iri, 6), F.regexp_extract(iri, "(#.*)$", 1))
    marked = lambda short: F.when(short == "", "./").when(short.rlike(r"^@[A-Za-z]+$") | F.contains(F.substring_index(short, "/", 1), F.lit(":")), F.concat(F.lit("./"), short)).otherwise(short)
    same = (of(base, 1) == of(iri, 1)) & (of(base, 3) == of(iri, 3)) & (of(base, 3) != "")
    return F.when(base.isNotNull() & same, bound(whole, marked)).otherwise(iri)
