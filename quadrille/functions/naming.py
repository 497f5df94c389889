"""Names and IRIs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces that the graphs use.
BASE = "http://example.org/schema#"
DR = "http://example.org/datarepository#"
HARVEST = "http://example.org/harvestor/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def is_set(c: Column) -> Column:
    """Neither null nor only white space."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def pascal(c: Column) -> Column:
    """order_items -> OrderItems; null and blank -> Unknown."""
    words = F.filter(F.split(F.lower(c), r"[_\s]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return F.when(is_set(c), joined).otherwise(F.lit("Unknown"))


def camel(c: Column) -> Column:
    name = pascal(c)
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def sanitise(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_"), F.lit("unknown"))


def class_iri(table: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(base), pascal(table))


def data_property_iri(table: Column, column: Column, base: str = BASE) -> Column:
    return F.concat(class_iri(table, base), F.lit("_"), camel(column))


def object_property_iri(fk_table: Column, pk_table: Column, base: str = BASE) -> Column:
    return F.concat(class_iri(fk_table, base), F.lit("_has"), pascal(pk_table))


def node_shape_iri(table: Column, base: str = BASE) -> Column:
    return F.concat(class_iri(table, base), F.lit("Shape"))


def property_shape_iri(table: Column, column: Column, base: str = BASE) -> Column:
    return F.concat(node_shape_iri(table, base), F.lit("/"), camel(column), F.lit("Shape"))


def fk_property_shape_iri(table: Column, pk_table: Column, base: str = BASE) -> Column:
    return F.concat(node_shape_iri(table, base), F.lit("/has"), pascal(pk_table), F.lit("Shape"))


def constraint_iri(table: Column, name: Column, base: str = BASE) -> Column:
    return F.concat(node_shape_iri(table, base), F.lit("/constraint/"), sanitise(name))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def camel_to_upper_snake(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?<!^)(\p{Lu})", "_$1"))


def iri_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss-SSS")


def iso_instant(ts: Column) -> Column:
    """ISO-8601 in UTC (the session's time zone), with 0, 3 or 6 digits of a second's fraction."""
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(F.substring(micros, 4, 3) == "000", F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def extraction_iri(database: Column, schema: Column, ts: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(base + "extraction/"), sanitise(database), F.lit("/"), sanitise(schema), F.lit("/"), iri_timestamp(ts))


def stable_iri(database: Column, schema: Column | None = None, base: str = BASE) -> Column:
    parts = [F.lit(base + "repo/"), sanitise(database)]
    return F.concat(*parts, F.lit("/"), sanitise(schema)) if schema is not None else F.concat(*parts)


def version_iri(database: Column, schema: Column, rest: Column | str, base: str = BASE) -> Column:
    tail = F.lit(rest) if isinstance(rest, str) else rest
    return F.concat(F.lit(base + "version/"), sanitise(database), F.lit("/"), sanitise(schema), F.lit("/"), tail)
