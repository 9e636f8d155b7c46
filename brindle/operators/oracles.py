"""What a declaration's text says that a check of it can use: fields, members, aliases, sample values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .source_tree import NAME

#: A body in braces, with braces up to two deep inside it.
BODY = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def _lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~x.startswith("//"))


def interface_fields(source: Column, name: Column) -> Column:
    """array of (name, type, optional) of an interface's own lines; empty where it is not declared, null for a null source."""
    body = F.call_function("regexp_extract", source, F.concat(F.lit(r"\binterface\s+\Q"), name, F.lit(r"\E\s*" + BODY)), F.lit(1))
    field = rf"^({NAME})(\?)?\s*:\s*(.+?)\s*;?$"
    found = F.filter(_lines(body), lambda x: x.rlike(field))
    part = lambda x, k: F.regexp_extract(x, field, k)
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("name"), part(x, 3).alias("type"), (part(x, 2) == "?").alias("optional")))


def _named(source: Column, pattern: str, make) -> Column:
    """array of make(name, body) of every match of a pattern with two groups."""
    names, bodies = (F.regexp_extract_all(source, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, bodies, make)


def enums(source: Column) -> Column:
    """array of (name, members) of the exported enums, members in order and without their values."""
    member = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"(?s)=.*$", ""))
    members = lambda b: F.filter(F.transform(F.split(b, ","), member), lambda x: x != "")
    return _named(source, rf"\bexport\s+enum\s+({NAME})\s*\{{([^}}]*)\}}", lambda n, b: F.struct(n.alias("name"), members(b).alias("members")))


def aliases(source: Column) -> Column:
    """array of (name, type) of the exported type aliases of one line."""
    return _named(source, rf"\bexport\s+type\s+({NAME})\s*=\s*([^;\n]+)", lambda n, b: F.struct(n.alias("name"), F.btrim(b).alias("type")))


def const_objects(source: Column) -> Column:
    """array of (name, entries) of the exported constant records, a map of key to value text each."""
    entry = rf"^('[^']+'|\"[^\"]+\"|{NAME})\s*:\s*(.+?),*$"
    pairs = lambda b: F.transform(F.filter(_lines(b), lambda x: x.rlike(entry)), lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, entry, 1), "['\"]", "").alias("key"), F.regexp_extract(x, entry, 2).alias("value")))
    return _named(source, rf"\bexport\s+const\s+({NAME})\s*:\s*Record<[^>]+>\s*=\s*\{{([^}}]*)\}}", lambda n, b: F.struct(n.alias("name"), F.map_from_entries(pairs(b)).alias("entries")))


LITERAL = r"^(?:'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|true|false)$"


def sample_value(kind: Column, optional: Column, known: Column | None = None) -> Column:
    """A value of a type as source text: a literal type's own, else one of its kind; known: enums().
    Null where none is known and the field is not optional."""
    t = F.replace(kind, F.lit(" "), F.lit(""))
    literals = F.filter(F.split(t, r"\|"), lambda x: x.rlike(LITERAL))
    out = F.when(F.size(literals) > 0, F.get(literals, F.lit(0)))
    out = out.when(t.contains("|") & t.contains("string") & t.contains("number"), "'sample'")
    for names, value in ((("string", "String"), "'sample'"), (("number", "Number"), "1"), (("boolean", "Boolean"), "true")):
        out = out.when(t.isin(*names), value)
    out = out.when(t.endswith("[]"), "[]")
    if known is not None:
        own = F.get(F.filter(known, lambda e: (e["name"] == t) & (F.size(e["members"]) > 0)), F.lit(0))
        out = out.when(own.isNotNull(), F.concat(t, F.lit("."), F.get(own["members"], F.lit(0))))
    return out.when(t.contains("Resource"), "{} as Resource").when(optional, "undefined")
