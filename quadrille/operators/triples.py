"""Statements as rows: quads, and the helper that makes them from metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.naming import RDF, XSD

KEY = ["graph", "s", "s_kind", "p", "o", "o_kind", "o_datatype"]


def iri(value: Column | str) -> Column:
    return _term(value, "iri", None)


def bnode(value: Column) -> Column:
    return _term(value, "bnode", None)


def lit(value: Column | str, datatype: str = "string") -> Column:
    return _term(value, "literal", XSD + datatype)


def _term(value: Column | str, kind: str, datatype: str | None) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(value.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))


def emit(rows: DataFrame, graph: Column, subject: Column, order: list[Column], items: list[tuple], s_kind: str = "iri") -> DataFrame:
    """A quad for each item (predicate, object[, condition]) of each row; a null object or a false condition gives none."""
    made = []
    for k, (p, o, *when) in enumerate(items):
        made.append(F.when(o["o"].isNotNull() & (when[0] if when else F.lit(True)), F.struct(F.lit(p).alias("p"), o["o"].alias("o"), o["o_kind"].alias("o_kind"), o["o_datatype"].alias("o_datatype"), F.lit(k).alias("k"))))
    cells = rows.select("snapshot_id", graph.alias("graph"), subject.alias("s"), F.lit(s_kind).alias("s_kind"), F.array(*[c.cast("int") for c in order]).alias("at"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("q"))
    return cells.select("snapshot_id", "graph", "s", "s_kind", "q.p", "q.o", "q.o_kind", "q.o_datatype", F.concat("at", F.array("q.k")).alias("seq"))


def type_of(name: str) -> tuple:
    return (RDF + "type", iri(name))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_set(quads: DataFrame) -> DataFrame:
    """Equal statements count once, at the place of the first."""
    return quads.groupBy("snapshot_id", *KEY).agg(F.min("seq").alias("seq"))


def merged(quads: DataFrame, graph: str) -> DataFrame:
    """The set union of all graphs of a snapshot as one graph."""
    return as_set(quads.withColumn("graph", F.lit(graph)))


def counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("snapshot_id", "graph").agg(F.count("*").alias("triples"))


def type_counts(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == RDF + "type").groupBy("graph", F.col("o").alias("type")).agg(F.count("*").alias("subjects"))


def of_graph(quads: DataFrame, graph: str) -> DataFrame:
    return quads.where(F.col("graph") == graph)
