"""Type names: SQL to XSD, XSD to SQL of a dialect, and the tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.naming import XSD

# The XSD type of each SQL name, and its name in each dialect.
XSD_TYPES = {
    "VARCHAR": "string",
    "CHARACTER VARYING": "string",
    "CHAR": "string",
    "CHARACTER": "string",
    "TEXT": "string",
    "NVARCHAR": "string",
    "NCHAR": "string",
    "STRING": "string",
    "CLOB": "string",
    "VARIANT": "string",
    "OBJECT": "string",
    "ARRAY": "string",
    "UUID": "string",
    "JSON": "string",
    "JSONB": "string",
    "XML": "string",
    "INET": "string",
    "CIDR": "string",
    "MACADDR": "string",
    "INTEGER": "integer",
    "INT": "integer",
    "INT4": "integer",
    "SERIAL": "integer",
    "INT2": "short",
    "SMALLINT": "short",
    "SMALLSERIAL": "short",
    "BIGINT": "long",
    "INT8": "long",
    "OID": "long",
    "BIGSERIAL": "long",
    "TINYINT": "byte",
    "BYTEINT": "byte",
    "DECIMAL": "decimal",
    "NUMERIC": "decimal",
    "NUMBER": "decimal",
    "MONEY": "decimal",
    "FLOAT": "float",
    "FLOAT4": "float",
    "REAL": "float",
    "FLOAT8": "double",
    "DOUBLE PRECISION": "double",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
    "DATE": "date",
    "TIME": "time",
    "TIMETZ": "time",
    "TIME WITH TIME ZONE": "time",
    "TIMESTAMP": "dateTime",
    "TIMESTAMP_NTZ": "dateTime",
    "TIMESTAMP_LTZ": "dateTime",
    "TIMESTAMP WITHOUT TIME ZONE": "dateTime",
    "TIMESTAMP_TZ": "dateTimeStamp",
    "TIMESTAMPTZ": "dateTimeStamp",
    "TIMESTAMP WITH TIME ZONE": "dateTimeStamp",
    "BINARY": "base64Binary",
    "VARBINARY": "base64Binary",
    "BYTEA": "base64Binary",
}
DIALECTS = ("ANSI", "SNOWFLAKE", "POSTGRESQL")
DIALECT_NAMES = {  # ANSI, SNOWFLAKE, POSTGRESQL
    "string": ("VARCHAR", "VARCHAR", "VARCHAR"),
    "integer": ("INTEGER", "INTEGER", "INTEGER"),
    "short": ("SMALLINT", "SMALLINT", "SMALLINT"),
    "long": ("BIGINT", "BIGINT", "BIGINT"),
    "byte": ("TINYINT", "BYTEINT", "SMALLINT"),
    "decimal": ("DECIMAL", "NUMBER", "NUMERIC"),
    "float": ("FLOAT", "FLOAT", "REAL"),
    "double": ("DOUBLE PRECISION", "DOUBLE", "DOUBLE PRECISION"),
    "boolean": ("BOOLEAN", "BOOLEAN", "BOOLEAN"),
    "date": ("DATE", "DATE", "DATE"),
    "time": ("TIME", "TIME", "TIME"),
    "dateTime": ("TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP"),
    "dateTimeStamp": ("TIMESTAMP WITH TIME ZONE", "TIMESTAMP_TZ", "TIMESTAMPTZ"),
    "base64Binary": ("BINARY", "BINARY", "BYTEA"),
    "nonNegativeInteger": ("INTEGER", "INTEGER", "INTEGER"),
}
NUMERIC = {"integer", "long", "short", "byte", "decimal", "float", "double", "nonNegativeInteger"}
TEMPORAL = {"date", "time", "dateTime", "dateTimeStamp"}
STRING_PREFIXES = ("VARCHAR", "CHAR", "NVARCHAR", "TEXT", "STRING")
DDL_STRING_PREFIXES = ("VARCHAR", "CHAR", "NVARCHAR", "STRING")
RULES = {0: "CASCADE", 1: "RESTRICT", 2: "SET_NULL", 3: "NO_ACTION", 4: "SET_DEFAULT"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.upper(c)), r"\(.*\)", ""))


def to_xsd(sql_type: Column) -> Column:
    """The XSD IRI of a SQL type name; unknown, null and blank names are strings."""
    found = F.try_element_at(_map(XSD_TYPES), F.coalesce(_bare(sql_type), F.lit("")))
    return F.concat(F.lit(XSD), F.coalesce(found, F.lit("string")))


def to_sql(xsd_iri: Column, dialect: str) -> Column:
    at = DIALECTS.index(dialect)
    found = F.try_element_at(_map({XSD + k: v[at] for k, v in DIALECT_NAMES.items()}), F.coalesce(xsd_iri, F.lit("")))
    return F.coalesce(found, F.lit("VARCHAR"))


def sql_name(xsd_iri: str | None, dialect: str) -> str:
    """As to_sql, for one value on the driver."""
    names = DIALECT_NAMES.get((xsd_iri or "").removeprefix(XSD)) if (xsd_iri or "").startswith(XSD) else None
    return names[DIALECTS.index(dialect)] if names else "VARCHAR"


def for_diff(sql_type: Column) -> Column:
    """Upper case without length; null counts as empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.upper(sql_type), r"\(.*\)", "")), F.lit(""))


def is_string_type(sql_type: Column) -> Column:
    return F.coalesce(F.upper(sql_type).rlike(f"^({'|'.join(STRING_PREFIXES)})"), F.lit(False))


def rule_name(code: Column) -> Column:
    """The name of a referential rule's JDBC code; others are NO_ACTION."""
    return F.coalesce(F.try_element_at(_map(RULES), code), F.lit("NO_ACTION"))


def parse_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def short_xsd(iri: str) -> str:
    return "xsd:" + iri.rpartition("#")[2]
