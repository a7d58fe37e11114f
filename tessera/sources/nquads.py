"""N-Quads as lines of text: a splittable source, a sink, and the well-formedness filter.

Quads are rows (doc_id, s, p, o, o_kind, datatype, language, g). Blank nodes
begin with "_:"; o_kind is iri, bnode or lit; g is null in the default graph.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import iri
from tessera.functions import literals as lit

QUAD = ["doc_id", "s", "p", "o", "o_kind", "datatype", "language", "g"]

_IRI = r"<[^<>\"\n\r]*>"
_BLANK = r"_:[A-Za-z0-9_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])?"
_NODE = f"({_IRI}|{_BLANK})"
_END = r"\s*\.\s*(?:#.*)?$"
_PLAIN = rf"^\s*{_NODE}\s*{_NODE}\s*{_NODE}\s*{_NODE}?{_END}"
_HEAD = rf"^\s*{_NODE}\s*{_NODE}\s*$"
# One literal without a step of the regular expression's stack per character, its escapes among those that unescape knows.
_ESCAPE = r"\\(?:[tbnrf\"'\\/]|u(?![Dd][89A-Fa-f])[0-9A-Fa-f]{4}|U(?!0000[Dd][89A-Fa-f])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})"
_LITERAL = rf"\"(?:[^\"\\\n\r]|{_ESCAPE})*+\"(?:@[A-Za-z0-9\-]+|\^\^<(?:[^<>\"\\\n\r]|{_ESCAPE})*+>)?"
_TAIL = rf"^(?:@([A-Za-z0-9\-]+)|\^\^(<[^<>\"\n\r]*>))?\s*{_NODE}?{_END}"


def term(value: Column, kind: Column, datatype: Column | None = None, language: Column | None = None) -> Column:
    """One term as N-Quads writes it; xsd:string is left out."""
    literal = F.concat(F.lit('"'), lit.escape(value), F.lit('"'))
    if datatype is not None:
        tail = F.when(language.isNotNull(), F.concat(F.lit("@"), language)).when(datatype != lit.STRING, F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
        literal = F.concat(literal, F.coalesce(tail, F.lit("")))
    return F.when(kind == "bnode", value).when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(literal)


def kind_of(value: Column) -> Column:
    return F.when(value.startswith("_:"), "bnode").otherwise("iri")


def line(s="s", p="p", o="o", o_kind="o_kind", datatype="datatype", language="language", g="g") -> Column:
    c = F.col
    parts = [term(c(s), kind_of(c(s))), term(c(p), kind_of(c(p))), term(c(o), c(o_kind), c(datatype), c(language)), term(c(g), kind_of(c(g))), F.lit(".")]
    return F.concat_ws(" ", *parts)


def serialize(quads: DataFrame) -> DataFrame:
    """(doc_id, line) of every quad. Sort and drop repeats at the sink, where it is wanted."""
    return quads.select("doc_id", line().alias("line"))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns computed in a step of their own, which filters and projections above don't repeat."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("settled_")
    return df.select(*[F.col(c) for c in df.columns if c not in columns], one).select(*[c for c in df.columns if c not in columns], "settled_.*")


def parse(lines: DataFrame) -> DataFrame:
    """Quads of (doc_id, line), plus an error for lines that are none, null ones among them; blank lines and comments give no row.

    A literal is cut out between its quotes first, so no pattern runs over it
    and its length doesn't matter.
    """
    c = settled(lines.select("doc_id", "line"), line=F.col("line")).filter(~F.coalesce(F.col("line").rlike(r"^\s*(#.*)?$"), F.lit(False)))
    # Escapes hide their second character, so that the next quote is the closing one.
    c = settled(c, hidden=F.when(F.contains("line", F.lit("\\")), F.regexp_replace("line", r"(?s)\\.", "__")).otherwise(F.col("line")))
    first = F.instr("hidden", '"')
    c = settled(c, q1=first, q2=F.when(first > 0, F.expr("locate('\"', hidden, instr(hidden, '\"') + 1)")).otherwise(0))
    quoted = F.col("q2") > 0
    inside = {"body": F.when(quoted, F.expr("substring(line, q1 + 1, q2 - q1 - 1)")), "tail": F.when(quoted, F.expr("substring(line, q2 + 1)"))}
    c = settled(c, head=F.when(quoted, F.expr("substring(line, 1, q1 - 1)")).otherwise(F.col("line")), **inside)
    ok = F.when(quoted, F.col("head").rlike(_HEAD) & F.col("tail").rlike(_TAIL) & ~F.col("body").rlike(r"[\n\r]")).otherwise(F.col("head").rlike(_PLAIN))
    c = settled(c, ok=F.coalesce(ok, F.lit(False)))

    def name(x):
        inner = F.when(x.startswith("<"), lit.unescape(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)
        return F.when(F.col("ok") & (x != ""), inner)

    plain = lambda i: F.when(~quoted, F.regexp_extract("head", _PLAIN, i))
    node = lambda i: F.when(quoted, F.regexp_extract("head", _HEAD, i)).otherwise(plain(i))
    tail = lambda i: F.regexp_extract("tail", _TAIL, i)
    literal = F.col("ok") & quoted
    language = F.when(literal & (tail(1) != ""), tail(1))
    out = settled(
        c, s=name(node(1)), p=name(node(2)), o=F.when(literal, lit.unescape(F.col("body"))).otherwise(name(plain(3))),
        o_kind=F.when(literal, "lit").when(F.col("ok"), F.when(plain(3).startswith("_:"), "bnode").otherwise("iri")),
        datatype=F.when(language.isNotNull(), lit.LANG_STRING).when(literal, F.coalesce(name(tail(2)), F.lit(lit.STRING))),
        language=language, g=name(F.when(quoted, tail(3)).otherwise(plain(4))),
    ).select(*QUAD, "ok")
    # An unknown escape leaves a null where a term should be.
    sound = F.col("ok") & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    return out.withColumn("error", F.when(~sound, "invalid line")).drop("ok")


def lines_of(texts: DataFrame) -> DataFrame:
    """(doc_id, number, line) of (doc_id, text): the lines of whole documents, from 1; a null text has none."""
    return texts.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("number", "line")).withColumn("number", F.col("number") + 1)


def errors(lines: DataFrame) -> DataFrame:
    """Where and why the lines that ``parse`` refuses are none: their columns, plus ``column`` and ``code``.

    The column (code points, from 1) is that at which the first term that
    doesn't fit begins, or one past the end if the line ends too early; a null
    line has none. Codes: unexpected end, unexpected character, invalid IRI,
    invalid literal (not closed, an unknown escape, or no address after ^^),
    literal out of place, expected '.', and null line.
    """
    node = rf"(?:<(?:[^<>\"\\\n\r]|{_ESCAPE})*+>|{_BLANK})"
    upto = [r"^\s*"]
    for one in (node, node, rf"(?:{node}|{_LITERAL})", node):
        upto.append(upto[-1] + one + r"\s*")
    whole = F.col("line").rlike(upto[3] + rf"(?:{node})?{_END}")
    c = lines.filter(F.col("line").isNull() | ~(F.col("line").rlike(r"^\s*(#.*)?$") | whole))
    fits = [F.length(F.regexp_extract("line", one, 0)) for one in upto]
    c = settled(c, fit_=F.greatest(*fits), terms_=F.size(F.filter(F.array(*[F.col("line").rlike(one) for one in upto[1:]]), lambda x: x)))
    c = settled(c, next_=F.expr("substring(line, fit_ + 1, 1)"))
    starts = lambda x: F.col("next_") == x
    code = (
        F.when(F.col("line").isNull(), "null line").when(starts(""), "unexpected end").when(starts("<") & (F.col("terms_") < 4), "invalid IRI")
        .when(starts('"') & (F.col("terms_") == 2), "invalid literal").when(starts('"') & (F.col("terms_") < 4), "literal out of place")
        .when(F.col("terms_") < 3, "unexpected character").when(starts("."), "unexpected character").otherwise("expected '.'")
    )
    return c.withColumn("column", F.when(F.col("line").isNotNull(), F.col("fit_") + 1)).withColumn("code", code).drop("fit_", "terms_", "next_")


def well_formed() -> Column:
    """Whether a quad's terms can stand in RDF."""
    node = lambda c: F.col(c).startswith("_:") | iri.is_well_formed(F.col(c))
    literal = iri.is_well_formed(F.col("datatype")) & (F.col("language").isNull() | iri.is_well_formed_language(F.col("language")))
    o = F.when(F.col("o_kind") == "lit", literal).otherwise(node("o"))
    return node("s") & iri.is_well_formed(F.col("p")) & o & (F.col("g").isNull() | node("g"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Quads of text files; a file's path scopes its blank nodes as doc_id (a hash)."""
    lines = spark.read.text(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("line"))
    return parse(lines)


def write(quads: DataFrame, path: str) -> None:
    """Sorted lines without repeats."""
    serialize(quads).select("line").distinct().orderBy("line").write.text(path)
