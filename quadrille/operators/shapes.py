"""Shapes of tables as statements, and the table model read back from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import naming as N
from quadrille.functions import xsd
from quadrille.functions.naming import OWL, RDF, RDFS, SH
from quadrille.operators.frames import SnapshotFrames, with_keys
from quadrille.operators.triples import as_set, emit, iri, lit, type_of, union


def shape_quads(frames: SnapshotFrames, graph: Column | None = None, base: str = N.BASE) -> DataFrame:
    """Node, property and constraint shapes of every table, in the given graph (default: one for each snapshot)."""
    g = F.concat(F.lit(N.HARVEST), F.col("snapshot_id")) if graph is None else graph
    c = F.col
    shape = N.node_shape_iri(c("table_name"), base)
    tables = emit(frames.tables, g, shape, [c("table_seq"), F.lit(0), F.lit(0)], [
        type_of(SH + "NodeShape"), (SH + "targetClass", iri(N.class_iri(c("table_name"), base))),
        (RDFS + "label", lit(F.concat(c("table_name"), F.lit("Shape")))), (SH + "description", lit(c("remarks")), N.is_set(c("remarks"))),
    ])
    rows = with_keys(frames)
    fk = c("is_fk")
    prop = F.when(fk, N.fk_property_shape_iri(c("table_name"), c("fk.pk_table"), base)).otherwise(N.property_shape_iri(c("table_name"), c("column_name"), base))
    path = F.when(fk, N.object_property_iri(c("table_name"), c("fk.pk_table"), base)).otherwise(N.data_property_iri(c("table_name"), c("column_name"), base))
    long = xsd.is_string_type(c("data_type")) & (F.coalesce(c("max_length"), F.lit(0)) > 0)
    order = [c("table_seq"), F.lit(1), c("col_seq")]
    properties = emit(rows, g, prop, order, [
        type_of(SH + "PropertyShape"), (SH + "name", lit(c("column_name"))), (RDFS + "label", lit(F.concat(c("table_name"), F.lit("."), c("column_name"), F.lit(" shape")))),
        (SH + "path", iri(path)), (SH + "datatype", iri(xsd.to_xsd(c("data_type"))), ~fk), (SH + "class", iri(N.class_iri(c("fk.pk_table"), base)), fk),
        (SH + "nodeKind", iri(SH + "Literal"), ~fk), (SH + "nodeKind", iri(SH + "IRI"), fk), (SH + "maxLength", lit(c("max_length"), "int"), ~fk & long),
        (SH + "minCount", lit("1", "int"), ~c("nullable")), (SH + "maxCount", lit("1", "int")), (SH + "description", lit(c("remarks")), N.is_set(c("remarks"))),
    ])
    links = emit(rows, g, shape, [c("table_seq"), F.lit(0), F.lit(1), c("col_seq")], [(SH + "property", iri(prop))])
    seq = frames.tables.select("snapshot_id", "table_name", "table_seq")
    checks = frames.checks.join(seq, ["snapshot_id", "table_name"]).select("*", c("ck_seq").alias("n"), F.concat(F.lit("CHECK constraint violated: "), "constraint_name").alias("message"), F.concat(F.lit("SQL CHECK: "), "check_clause").alias("comment"), F.lit(2).alias("part"))
    listed = F.array_join("columns", ", ")
    uniques = frames.uniques.join(seq, ["snapshot_id", "table_name"]).select("*", c("uq_seq").alias("n"), F.concat(F.lit("UNIQUE constraint violated: "), c("constraint_name"), F.lit(" ("), listed, F.lit(")")).alias("message"), F.concat(F.lit("UNIQUE on columns: "), listed).alias("comment"), F.lit(3).alias("part"))
    keep = ["snapshot_id", "table_name", "table_seq", "constraint_name", "n", "message", "comment", "part"]
    both = checks.select(*keep, F.replace("check_clause", F.lit("*/"), F.lit("* /")).alias("clause")).unionByName(uniques.select(*keep, F.lit(None).cast("string").alias("clause")))
    node = N.constraint_iri(c("table_name"), c("constraint_name"), base)
    select = F.concat(F.lit("SELECT $this WHERE { FILTER(false) } /* "), c("clause"), F.lit(" */"))
    constraints = emit(both, g, node, [c("table_seq"), c("part"), c("n")], [
        type_of(SH + "SPARQLConstraint"), (RDFS + "label", lit(c("constraint_name"))), (SH + "message", lit(c("message"))),
        (RDFS + "comment", lit(c("comment"))), (SH + "select", lit(select)),
    ])
    held = emit(both, g, shape, [c("table_seq"), F.lit(0), c("part"), c("n")], [(SH + "sparql", iri(node))])
    return as_set(union(tables, properties, links, constraints, held))


def read_shapes(quads: DataFrame) -> DataFrame:
    """One row per column of every node shape: what the query layer knows of a table.

    Shapes without a target class and properties without a name are left out; of several
    values the first counts; both spellings of nodeKind are read.
    """
    first = lambda p: F.min_by(F.when(F.col("p").isin([SH + x for x in p] if isinstance(p, list) else [p]), F.col("o")), F.when(F.col("p").isin([SH + x for x in p] if isinstance(p, list) else [p]), F.col("seq")))
    by_node = quads.groupBy("snapshot_id", "graph", "s").agg(
        first(RDF + "type").alias("kind"), first(SH + "targetClass").alias("target"), first(SH + "name").alias("name"), first(SH + "path").alias("path"),
        first(SH + "datatype").alias("datatype"), first(SH + "class").alias("class"), first(["nodeKind", "NodeKind"]).alias("node_kind"), first(SH + "minCount").alias("min_count"), first(SH + "maxLength").alias("max_length"),
    )
    nodes = by_node.where((F.col("kind") == SH + "NodeShape") & F.col("target").isNotNull()).select("snapshot_id", "graph", F.col("s").alias("shape"), "target")
    links = quads.where(F.col("p") == SH + "property").select("snapshot_id", "graph", F.col("s").alias("shape"), F.col("o").alias("s"), F.col("seq").alias("at"))
    props = by_node.where(F.coalesce("name", "path").isNotNull()).drop("target", "kind")
    named = F.coalesce(F.upper("name"), N.camel_to_upper_snake(F.regexp_extract(N.local_name(F.col("path")), r"([^_]*)$", 1)))
    return nodes.join(links, ["snapshot_id", "graph", "shape"]).join(props, ["snapshot_id", "graph", "s"]).select(
        "snapshot_id", "graph", N.local_name(F.col("target")).alias("table_name"), "shape", F.col("at").alias("seq"), named.alias("column_name"), F.col("datatype").alias("xsd_datatype"),
        F.coalesce((F.col("node_kind") == SH + "IRI"), F.col("class").isNotNull()).alias("is_foreign_key"), N.local_name(F.col("class")).alias("referenced_table"),
        (F.coalesce(xsd.parse_int(F.col("min_count")), F.lit(0)) < 1).alias("nullable"), xsd.parse_int(F.col("max_length")).alias("max_length"),
    )


def read_constraints(quads: DataFrame) -> DataFrame:
    """UNIQUE and CHECK messages of every node shape; a comment is preferred to a message."""
    links = quads.where(F.col("p") == SH + "sparql").select("snapshot_id", "graph", F.col("s").alias("shape"), F.col("o").alias("s"))
    text = quads.groupBy("snapshot_id", "graph", "s").agg(F.max(F.when(F.col("p") == SH + "message", F.col("o"))).alias("message"), F.max(F.when(F.col("p") == RDFS + "comment", F.col("o"))).alias("comment"))
    kind = F.when(F.startswith("message", F.lit("UNIQUE")), "UNIQUE").when(F.startswith("message", F.lit("CHECK")), "CHECK")
    return links.join(text, ["snapshot_id", "graph", "s"]).select("snapshot_id", "graph", "shape", kind.alias("kind"), F.coalesce("comment", "message").alias("message")).where("kind is not null")


def read_keys(quads: DataFrame, depth: int = 64) -> DataFrame:
    """Every hasKey list of a class, followed cell by cell: class, list head, position, column name."""
    first = quads.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    rest = quads.where(F.col("p") == RDF + "rest").select(F.col("s").alias("cell"), F.col("o").alias("next"))
    cells = first.join(rest, "cell")
    heads = quads.where(F.col("p") == OWL + "hasKey").select(F.col("s").alias("class"), F.col("o").alias("head"), F.col("o").alias("cell"))
    spark = quads.sparkSession
    heads.createOrReplaceTempView("_key_heads")
    cells.createOrReplaceTempView("_key_cells")
    walked = spark.sql(f"""
        WITH RECURSIVE walk(class, head, pos, item, next) MAX RECURSION LEVEL {depth} AS (
          SELECT h.class, h.head, 0, c.item, c.next FROM _key_heads h JOIN _key_cells c ON h.cell = c.cell
          UNION ALL
          SELECT w.class, w.head, w.pos + 1, c.item, c.next FROM walk w JOIN _key_cells c ON w.next = c.cell)
        SELECT class, head, pos, item FROM walk""")
    return walked.select("class", "head", "pos", N.camel_to_upper_snake(F.regexp_extract(N.local_name(F.col("item")), r"_([^_]*)$", 1)).alias("column_name"))


@dataclass
class ShapeColumn:
    name: str
    xsd_datatype: str | None
    nullable: bool = True
    is_foreign_key: bool = False
    referenced_table: str | None = None
    max_length: int | None = None
    is_primary_key: bool = False
    physical: str | None = None


@dataclass
class ShapeTable:
    """What request validation and SQL text need, on the driver: a few names for each table."""

    name: str
    columns: list[ShapeColumn]
    primary_key: list[str] = field(default_factory=list)
    constraints: list[str] = field(default_factory=list)
    physical: str | None = None

    def column(self, name: str) -> ShapeColumn | None:
        return next((c for c in self.columns if c.name.upper() == name.upper()), None)


def shape_tables(frames: SnapshotFrames) -> list[ShapeTable]:
    """Shape tables of a harvest, with the names that the tables have in the data."""
    rows = with_keys(frames).withColumn("xsd", F.when(~F.col("is_fk"), xsd.to_xsd(F.col("data_type")))).withColumn("target", N.pascal(F.col("fk.pk_table"))).withColumn("shape_name", N.pascal(F.col("table_name")))
    keys: dict[str, list[str]] = {}
    for r in frames.primary_keys.orderBy("table_name", "key_seq").collect():
        keys.setdefault(r["table_name"], []).append(r["column_name"].upper())
    out: dict[str, ShapeTable] = {}
    for r in rows.orderBy("table_seq", "col_seq").collect():
        t = out.setdefault(r["table_name"], ShapeTable(r["shape_name"], [], keys.get(r["table_name"], []), [], r["table_name"]))
        length = r["max_length"] if not r["is_fk"] else None
        t.columns.append(ShapeColumn(r["column_name"].upper(), r["xsd"], r["nullable"], r["is_fk"], r["target"] if r["is_fk"] else None, length, r["primary_key"], r["column_name"]))
    return list(out.values())
