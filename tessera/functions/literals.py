"""Lexical forms of literals: XSD numbers, canonical JSON scalars and N-Quads escapes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
STRING, BOOLEAN, INTEGER, DOUBLE = XSD + "string", XSD + "boolean", XSD + "integer", XSD + "double"
LANG_STRING, JSON = RDF + "langString", RDF + "JSON"
TYPE, FIRST, REST, NIL, LIST = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil", RDF + "List"


def xsd_double(x: Column) -> Column:
    """Canonical xsd:double: 16 significant digits, no trailing zeros, E and the exponent."""
    text = F.format_string("%.15E", x)
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^([^E]*)E", 1), r"0+$", ""), r"\.$", ".0")
    exponent = F.regexp_extract(text, r"E(.*)$", 1).try_cast("int").cast("string")
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").when(x == 0, "0.0E0")
    return F.when(x.isNotNull(), F.coalesce(special, F.concat(mantissa, F.lit("E"), exponent)))


def is_integral(x: Column) -> Column:
    return (F.abs(x) < 1e21) & (F.floor(x).cast("double") == x) | (F.abs(x) >= 9e18) & (F.abs(x) < 1e21)


def xsd_integer(x: Column) -> Column:
    """A whole double as an integer numeral."""
    return x.try_cast("decimal(38,0)").cast("string")


def _lower_hex(json: Column) -> Column:
    """JSON text with the hex digits of its control characters in lower case."""
    out = json
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u00" + code, r"$1\\u00" + code.lower())
    return F.when(json.rlike(r"\\u00(?:0[BEF]|1[A-F])"), out).otherwise(json)


def json_string(text: Column) -> Column:
    """A JSON string with the escapes of canonical JSON (RFC 8785) only."""
    quoted = F.substring(F.to_json(F.array(text)), 2, 1 << 30)
    return _lower_hex(F.regexp_replace(quoted, r"\]$", ""))


def shortest(x: Column) -> Column:
    """A double with as few digits as name it, in some decimal or E notation."""
    tiny = [F.when((F.abs(x) < 1e-300), F.format_string(f"%.{n}E", x)) for n in range(4)]
    tries = [*tiny, *[F.format_string(f"%.{n}E", x) for n in (14, 15, 16)]]
    return F.coalesce(*[F.when(t.try_cast("double") == x, t) for t in tries], x.cast("string"))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ecma(plain: Column) -> Column:
    """Digits in decimal or E notation as ECMAScript writes them, without a sign."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^-?([0-9.]+)", 1), r"\.0*$", ""), r"\.", "")
    power = F.coalesce(F.regexp_extract(plain, r"E([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0)) + F.length(F.regexp_extract(plain, r"^-?([0-9]+)", 1))
    # digits are d1 d2 ...; the value is 0.d1d2... times ten to the power. Leading zeros of 0.00x move the point.
    parts = lambda d: F.struct(F.regexp_replace(F.regexp_replace(d, r"^0+", ""), r"0+$", "").alias("d"), (power - F.length(F.regexp_extract(d, r"^(0*)", 1))).alias("n"))

    def written(x):
        d, n = x["d"], x["n"]
        k = F.length(d)
        return (
            F.when((k <= n) & (n <= 21), F.concat(d, F.repeat(F.lit("0"), n - k)))
            .when((n > 0) & (n <= 21), F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, F.lit(400))))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
            .otherwise(F.concat(F.substring(d, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(d, 2, 400))).otherwise(""), F.when(n - 1 < 0, "e").otherwise("e+"), (n - 1).cast("string")))
        )

    return bound(bound(digits, parts), written)


def json_number(x: Column) -> Column:
    """A double as ECMAScript prints it: shortest round trip, exponent from 1e21 and below 1e-6."""
    whole = F.when((F.abs(x) < 1e15) & (F.floor(x).cast("double") == x), F.floor(x).cast("string"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").when(x == 0, "0").when(whole.isNotNull(), whole).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), bound(shortest(x), _ecma)))


#: Strings, numbers and what lies between them in JSON text.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+\-]*+|[^"0-9\-]++'


def canonical_text(v: Column | str) -> Column:
    """A JSON value (a variant) as canonical JSON (RFC 8785), at any depth.

    A variant keeps an object's members in the order that the form wants, by
    UTF-16 code units; numbers and escapes are what is left to do.
    """
    tokens = F.regexp_extract_all(_lower_hex(F.to_json(v)), F.lit(_TOKEN), F.lit(0))
    number = lambda t: F.when(t.rlike(r"^(?:-?[1-9][0-9]{0,14}|0)$"), t).when(t.rlike("^-?[0-9]"), json_number(t.cast("double"))).otherwise(t)
    return F.array_join(F.transform(tokens, number), "")


def escape(text: Column) -> Column:
    """N-Quads: backslash, quote, newline, return and tab, per code point."""
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    r"""N-Quads: \t \b \n \r \f \" \' \\ \/, \uXXXX and \UXXXXXXXX; null for an unknown escape, or one of no character (a surrogate, or past 10FFFF)."""
    plain = F.regexp_replace(text, r"\\\\", r"\\u005C")  # now every backslash begins an escape
    plain = F.replace(plain, F.lit("\\'"), F.lit("'"))
    plain = F.regexp_replace(plain, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    wide = r"\\U(00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})"
    parts = F.split(plain, wide, -1)
    codes = F.transform(F.regexp_extract_all(plain, F.lit(wide), F.lit(1)), lambda x: F.decode(F.unhex(x), "UTF-32"))
    plain = F.array_join(F.flatten(F.zip_with(parts, codes, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")
    read = F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    read = F.when(~plain.rlike(r"\\u[Dd][89A-Fa-f]"), F.get(read, F.lit(0)))
    return F.when(F.contains(text, F.lit("\\")), read).otherwise(text)
