"""The four ontology graphs of a harvest: vocabulary, repository, schema and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import naming as N
from quadrille.functions import xsd
from quadrille.functions.naming import DR, OWL, RDF, RDFS, XSD
from quadrille.operators.frames import SnapshotFrames, with_keys
from quadrille.operators.triples import as_set, bnode, emit, iri, lit, type_of, union

# Classes and properties of the vocabulary, with the class that each property describes.
CLASSES = {"DataRepository": "A database that schemas were harvested from.", "DatabaseSchema": "A schema of a database.", "DatabaseTable": "A table or a view of a schema.", "TableColumn": "A column of a table."}
LINKS = {"hasSchema": ("DataRepository", "DatabaseSchema"), "hasTable": ("DatabaseSchema", "DatabaseTable"), "hasColumn": ("DatabaseTable", "TableColumn")}
ATTRIBUTES = {
    "DataRepository": {"databaseType": "string", "host": "string", "port": "integer", "databaseName": "string", "jdbcUrl": "string", "warehouse": "string", "role": "string", "authMode": "string", "extractedAt": "dateTime"},
    "DatabaseSchema": {"schemaName": "string"},
    "DatabaseTable": {"tableName": "string", "tableType": "string", "tableRemarks": "string"},
    "TableColumn": {"columnName": "string", "sqlDataType": "string", "ordinalPosition": "integer", "isNullable": "boolean", "isPrimaryKey": "boolean", "isForeignKey": "boolean", "maxLength": "integer", "numericPrecision": "integer", "numericScale": "integer", "columnRemarks": "string", "defaultValue": "string"},
}


def _pair(sep: str) -> Column:
    return F.concat(N.sanitise(F.col("database_name")), F.lit(sep), N.sanitise(F.col("schema_name")))


def _text(*parts: Column | str) -> Column:
    """Concatenation in which a null reads as null, as in the labels of the graphs."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def vocabulary_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    """Four classes, three links and twenty-four attributes, and the header of the ontology."""
    one, graph = frames.snapshots, F.lit(base + "vocabulary/datarepository")
    header = emit(one, graph, graph, [F.lit(0), F.lit(0)], [type_of(OWL + "Ontology"), (RDFS + "label", lit("DataRepository Vocabulary")), (RDFS + "comment", lit("Classes and properties that describe harvested schemas.")), (OWL + "versionInfo", lit("1.0"))])
    return union(header, _vocabulary(frames, graph))


def _vocabulary(frames: SnapshotFrames, graph: Column) -> DataFrame:
    """The names of the vocabulary in the given graph of each snapshot."""
    names = [(n, "Class", text, None, None) for n, text in CLASSES.items()]
    names += [(n, "ObjectProperty", f"From {a} to {b}.", DR + a, DR + b) for n, (a, b) in LINKS.items()]
    names += [(n, "DatatypeProperty", f"{n} of {a}.", DR + a, XSD + t) for a, held in ATTRIBUTES.items() for n, t in held.items()]
    rows = frames.snapshots.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(names)], "at int, name string, kind string, text string, domain string, range string")
    rows = rows.crossJoin(F.broadcast(frames.snapshots.select("snapshot_id", "database_name", "schema_name")))  # the vocabulary has 31 names
    c = F.col
    return emit(rows, graph, F.concat(F.lit(DR), c("name")), [F.lit(1), c("at")], [(RDF + "type", iri(F.concat(F.lit(OWL), c("kind")))), (RDFS + "label", lit(c("name"))), (RDFS + "comment", lit(c("text"))), (RDFS + "domain", iri(c("domain"))), (RDFS + "range", iri(c("range")))])


def _column_items(c) -> list[tuple]:
    return [
        type_of(DR + "TableColumn"), (RDFS + "label", lit(c("column_name"))), (DR + "columnName", lit(c("column_name"))), (DR + "sqlDataType", lit(c("data_type")), N.is_set(c("data_type"))),
        (DR + "ordinalPosition", lit(c("ordinal_position"), "int")), (DR + "isNullable", lit(c("nullable"), "boolean")), (DR + "isPrimaryKey", lit(c("primary_key"), "boolean")), (DR + "isForeignKey", lit(c("is_fk"), "boolean")),
        (DR + "maxLength", lit(c("max_length"), "int")), (DR + "numericPrecision", lit(c("numeric_precision"), "int")), (DR + "numericScale", lit(c("numeric_scale"), "int")),
        (DR + "columnRemarks", lit(c("remarks")), N.is_set(c("remarks"))), (DR + "defaultValue", lit(c("default_value")), N.is_set(c("default_value"))),
    ]


def _connection(names: dict[str, str]) -> list[tuple]:
    return [(DR + p, lit(F.col(column)), N.is_set(F.col(column))) for p, column in names.items()]


_STRINGS = {"databaseType": "database_type", "databaseName": "database_name", "host": "host", "jdbcUrl": "jdbc_url", "warehouse": "warehouse", "role": "role", "authMode": "auth_mode"}


def repository_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    c, s = F.col, frames.snapshots
    graph = F.concat(F.lit(base + "repo/"), _pair("/"))
    repo, schema = F.concat(F.lit(base + "repo/"), _pair("_")), F.concat(F.lit(base + "repo/"), _pair("_"), F.lit("_Schema"))
    header = emit(s, graph, graph, [F.lit(0)], [type_of(OWL + "Ontology"), (RDFS + "label", lit(_text("Repository Instance: ", c("database_name"), " / ", c("schema_name")))), (RDFS + "comment", lit(_text("Individuals of ", c("database_name"), " / ", c("schema_name")))), (OWL + "versionInfo", lit("1.0")), (OWL + "imports", iri(base + "vocabulary/datarepository"))])
    table = F.concat(F.lit(base + "repo/table/"), N.pascal(c("table_name")))
    column = F.concat(F.lit(base + "repo/column/"), N.pascal(c("table_name")), F.lit("_"), N.pascal(c("column_name")))
    return as_set(union(header, _individuals(frames, graph, repo, schema, table, column)))


def _individuals(frames: SnapshotFrames, graph: Column, repo: Column, schema: Column, table: Column, column: Column) -> DataFrame:
    """Repository, schema, tables and columns under the given names."""
    c, s = F.col, frames.snapshots
    repos = emit(s, graph, repo, [F.lit(1)], [type_of(DR + "DataRepository"), (RDFS + "label", lit(_text(c("database_name"), " / ", c("schema_name")))), *_connection(_STRINGS), (DR + "port", lit(c("port"), "int")), (DR + "extractedAt", lit(N.iso_instant(c("extracted_at")), "dateTime")), (DR + "hasSchema", iri(schema))])
    schemas = emit(s, graph, schema, [F.lit(2)], [type_of(DR + "DatabaseSchema"), (RDFS + "label", lit(c("schema_name"))), (DR + "schemaName", lit(c("schema_name")))])
    where = s.select("snapshot_id", "database_name", "schema_name")
    tables = frames.tables.join(where, "snapshot_id")
    t = emit(tables, graph, table, [F.lit(3), c("table_seq"), F.lit(0)], [type_of(DR + "DatabaseTable"), (RDFS + "label", lit(c("table_name"))), (DR + "tableName", lit(c("table_name"))), (DR + "tableType", lit(c("table_type")), N.is_set(c("table_type"))), (DR + "tableRemarks", lit(c("remarks")), N.is_set(c("remarks")))])
    has = emit(tables, graph, schema, [F.lit(3), c("table_seq"), F.lit(1)], [(DR + "hasTable", iri(table))])
    columns = with_keys(frames).join(where, "snapshot_id")
    k = emit(columns, graph, column, [F.lit(3), c("table_seq"), F.lit(2), c("col_seq")], _column_items(c))
    held = emit(columns, graph, table, [F.lit(3), c("table_seq"), F.lit(2), c("col_seq"), F.lit(99)], [(DR + "hasColumn", iri(column))])
    return union(repos, schemas, t, has, k, held)


def schema_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    """Classes, datatype and object properties, cardinalities and keys. Blank nodes are named by what they stand for."""
    c, s = F.col, frames.snapshots
    graph = F.concat(F.lit(base + "ontology/"), _pair("/"))
    header = emit(s, graph, graph, [F.lit(0)], [type_of(OWL + "Ontology"), (RDFS + "label", lit(_text("Schema Ontology: ", c("database_name"), " / ", c("schema_name")))), (RDFS + "comment", lit(_text("Classes and properties of ", c("database_name"), " / ", c("schema_name")))), (OWL + "versionInfo", lit("1.0")), (OWL + "imports", iri(base + "vocabulary/datarepository"))])
    tables = frames.tables.join(s.select("snapshot_id", "database_name", "schema_name"), "snapshot_id")
    kind = emit(tables, graph, F.lit(base + "tableType"), [F.lit(1)], [type_of(OWL + "AnnotationProperty"), (RDFS + "label", lit("tableType"))])
    typed = emit(tables, graph, N.class_iri(c("table_name"), base), [F.lit(2), c("table_seq"), F.lit(1)], [(base + "tableType", lit(c("table_type")))])
    return as_set(union(header, kind, _classes(frames, graph, base), typed))


def _classes(frames: SnapshotFrames, graph: Column, base: str) -> DataFrame:
    """A class for each table, with its properties, cardinalities, keys and checks, in the given graph of each snapshot."""
    c = F.col
    where = frames.snapshots.select("snapshot_id", "database_name", "schema_name")
    tables = frames.tables.join(where, "snapshot_id")
    cls = N.class_iri(c("table_name"), base)
    classes = emit(tables, graph, cls, [F.lit(2), c("table_seq"), F.lit(0)], [type_of(OWL + "Class"), (RDFS + "label", lit(c("table_name"))), (RDFS + "comment", lit(c("remarks")), N.is_set(c("remarks")))])
    columns = with_keys(frames).join(where, "snapshot_id").where(~F.col("is_fk"))
    prop = N.data_property_iri(c("table_name"), c("column_name"), base)
    order = [F.lit(3), c("table_seq"), c("col_seq")]
    properties = emit(columns, graph, prop, order, [type_of(OWL + "DatatypeProperty"), (RDFS + "label", lit(c("column_name"))), (RDFS + "domain", iri(cls)), (RDFS + "range", iri(xsd.to_xsd(c("data_type")))), (RDFS + "comment", lit(c("remarks")), N.is_set(c("remarks")))])
    required = columns.where(~F.col("nullable")).withColumn("bound", F.explode(F.array(F.lit("minCardinality"), F.lit("maxCardinality"))))
    node = F.concat(F.lit("r"), F.hex(F.xxhash64("snapshot_id", "table_name", "column_name", "bound")))
    bounds = emit(required, graph, node, order, [type_of(OWL + "Restriction"), (OWL + "onProperty", iri(prop)), (OWL + "minCardinality", lit("1", "nonNegativeInteger"), c("bound") == "minCardinality"), (OWL + "maxCardinality", lit("1", "nonNegativeInteger"), c("bound") == "maxCardinality")], "bnode")
    sub = emit(required, graph, cls, order, [(RDFS + "subClassOf", bnode(node))])
    # a foreign key to a table that was not harvested gives no property
    known = frames.tables.select("snapshot_id", c("table_name").alias("pk_table"))
    fks = frames.foreign_keys.join(known, ["snapshot_id", "pk_table"]).join(where, "snapshot_id")
    link = N.object_property_iri(c("fk_table"), c("pk_table"), base)
    rule = _text("FK: ", c("constraint_name"), " | UPDATE=", c("update_rule"), " | DELETE=", c("delete_rule"))
    objects = emit(fks, graph, link, [F.lit(4), c("fk_seq")], [type_of(OWL + "ObjectProperty"), (RDFS + "label", lit(F.concat(F.lit("references"), N.pascal(c("pk_table"))))), (RDFS + "domain", iri(N.class_iri(c("fk_table"), base))), (RDFS + "range", iri(N.class_iri(c("pk_table"), base))), (RDFS + "comment", lit(rule), N.is_set(c("constraint_name")))])
    pks = frames.primary_keys.groupBy("snapshot_id", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("key_seq", "column_name"))), lambda x: x["column_name"]).alias("columns")).withColumn("key_no", F.lit(-1)).withColumn("key_name", F.lit("PRIMARY"))
    keys = pks.unionByName(frames.uniques.select("snapshot_id", "table_name", "columns", c("uq_seq").alias("key_no"), c("constraint_name").alias("key_name")))
    cells = keys.join(where, "snapshot_id").select("*", F.posexplode("columns").alias("pos", "column_name"))
    cell = lambda at: F.concat(F.lit("k"), F.hex(F.xxhash64("snapshot_id", "table_name", "key_no", "key_name", at)))
    last = c("pos") == F.size("columns") - 1
    at = [F.lit(5), c("key_no"), c("pos")]
    lists = emit(cells, graph, cell(c("pos")), at, [(RDF + "first", iri(N.data_property_iri(c("table_name"), c("column_name"), base))), (RDF + "rest", iri(RDF + "nil"), last), (RDF + "rest", bnode(cell(c("pos") + 1)), ~last)], "bnode")
    has = emit(cells.where("pos = 0"), graph, cls, at, [(OWL + "hasKey", bnode(cell(c("pos"))))])
    checks = emit(frames.checks.join(where, "snapshot_id"), graph, cls, [F.lit(6), c("ck_seq")], [(RDFS + "comment", lit(_text("CHECK[", c("constraint_name"), "]: ", c("check_clause"))))])
    return union(classes, properties, bounds, sub, objects, lists, has, checks)


def single_graph_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    """Vocabulary, individuals and classes as one graph, with individuals named after their classes and linked by describedBy."""
    c, s = F.col, frames.snapshots
    graph = F.concat(F.lit(base), _pair("/"))
    header = emit(s, graph, graph, [F.lit(0)], [type_of(OWL + "Ontology"), (RDFS + "comment", lit(_text("Ontology of the ", c("database_type"), " schema ", c("schema_name")))), (OWL + "versionInfo", lit("1.0"))])
    table = F.concat(N.class_iri(c("table_name"), base), F.lit("_TableNode"))
    column = F.concat(N.class_iri(c("table_name"), base), F.lit("_"), N.pascal(c("column_name")), F.lit("_ColNode"))
    individuals = _individuals(frames, graph, F.concat(F.lit(base), _pair("_"), F.lit("_Repository")), F.concat(F.lit(base), _pair("_"), F.lit("_Schema")), table, column)
    tables = frames.tables.join(s.select("snapshot_id", "database_name", "schema_name"), "snapshot_id")
    described = emit(tables, graph, F.lit(base + "describedBy"), [F.lit(4)], [type_of(OWL + "AnnotationProperty"), (RDFS + "label", lit("describedBy"))])
    links = emit(tables, graph, N.class_iri(c("table_name"), base), [F.lit(5), c("table_seq")], [(base + "describedBy", iri(table))])
    return as_set(union(header, _vocabulary(frames, graph), individuals, described, links, _classes(frames, graph, base)))


def linking_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    c, s = F.col, frames.snapshots
    graph = F.concat(F.lit(base + "link/"), _pair("/"))
    header = emit(s, graph, graph, [F.lit(0)], [type_of(OWL + "Ontology"), (RDFS + "label", lit(_text("Linking Ontology: ", c("database_name"), " / ", c("schema_name")))), (RDFS + "comment", lit("From classes to the tables they stand for.")), (OWL + "versionInfo", lit("1.0")), (OWL + "imports", iri(F.concat(F.lit(base + "repo/"), _pair("/")))), (OWL + "imports", iri(F.concat(F.lit(base + "ontology/"), _pair("/"))))])
    source = emit(s, graph, F.lit(DR + "sourceTable"), [F.lit(1)], [type_of(OWL + "AnnotationProperty"), (RDFS + "label", lit("sourceTable")), (RDFS + "comment", lit("The table individual that a class stands for.")), (RDFS + "domain", iri(OWL + "Class")), (RDFS + "range", iri(DR + "DatabaseTable"))])
    tables = frames.tables.join(s.select("snapshot_id", "database_name", "schema_name"), "snapshot_id")
    table = iri(F.concat(F.lit(base + "repo/table/"), N.pascal(c("table_name"))))
    return as_set(union(header, source, emit(tables, graph, N.class_iri(c("table_name"), base), [F.lit(2), c("table_seq")], [(DR + "sourceTable", table), (RDFS + "seeAlso", table)])))


GRAPHS = {"vocabulary": vocabulary_quads, "repository": repository_quads, "schema": schema_quads, "linking": linking_quads}


def ontology_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    """All four graphs, with a column that names which."""
    return union(*[build(frames, base).withColumn("kind", F.lit(kind)) for kind, build in GRAPHS.items()])


def snapshot_quads(frames: SnapshotFrames, base: str = N.BASE) -> DataFrame:
    """An extraction record with its own table and column nodes, and the stable repository and schema nodes."""
    c = F.col
    record = N.extraction_iri(c("database_name"), c("schema_name"), c("extracted_at"), base)
    repo, schema = N.stable_iri(c("database_name"), None, base), N.stable_iri(c("database_name"), c("schema_name"), base)
    s = frames.snapshots.join(frames.counts(), "snapshot_id")
    graph = record
    iso = N.iso_instant(c("extracted_at"))
    head = emit(s, graph, record, [F.lit(0)], [type_of(DR + "ExtractionRecord"), (RDFS + "label", lit(_text("Extraction: ", c("database_name"), "/", c("schema_name"), " @ ", iso))), (DR + "forRepository", iri(repo)), (DR + "forSchema", iri(schema)), *_connection(_STRINGS), (DR + "port", lit(c("port"), "int")), (DR + "extractedAt", lit(iso, "dateTime")), (DR + "tableCount", lit(c("table_count"), "int")), (DR + "columnCount", lit(c("column_count"), "int"))])
    repos = emit(s, graph, repo, [F.lit(1)], [type_of(DR + "DataRepository"), (RDFS + "label", lit(c("database_name"))), *_connection({k: _STRINGS[k] for k in ("databaseType", "databaseName", "warehouse")}), (DR + "hasSchema", iri(schema))])
    schemas = emit(s, graph, schema, [F.lit(2)], [type_of(DR + "DatabaseSchema"), (RDFS + "label", lit(c("schema_name"))), (DR + "schemaName", lit(c("schema_name")))])
    where = frames.snapshots.select("snapshot_id", "database_name", "schema_name", "extracted_at")
    tables = frames.tables.join(where, "snapshot_id")
    table = F.concat(record, F.lit("/table/"), N.pascal(c("table_name")))
    t = emit(tables, graph, table, [F.lit(3), c("table_seq"), F.lit(0)], [type_of(DR + "DatabaseTable"), (RDFS + "label", lit(c("table_name"))), (DR + "tableName", lit(c("table_name"))), (DR + "tableType", lit(c("table_type")), N.is_set(c("table_type"))), (DR + "tableRemarks", lit(c("remarks")), N.is_set(c("remarks")))])
    has = emit(tables, graph, record, [F.lit(3), c("table_seq"), F.lit(1)], [(DR + "hasTable", iri(table))])
    columns = with_keys(frames).join(where, "snapshot_id")
    column = F.concat(record, F.lit("/column/"), N.pascal(c("table_name")), F.lit("_"), N.pascal(c("column_name")))
    k = emit(columns, graph, column, [F.lit(3), c("table_seq"), F.lit(2), c("col_seq")], _column_items(c))
    held = emit(columns, graph, table, [F.lit(3), c("table_seq"), F.lit(3), c("col_seq")], [(DR + "hasColumn", iri(column))])
    return as_set(union(head, repos, schemas, t, has, k, held))
