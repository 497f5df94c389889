"""Queries that return the statements of the graphs of the test tables themselves, and the SQL that states them again.

The graphs of a harvest follow from its columns and declared constraints, so the
SQL starts from DESCRIBE and the declarations. Blank nodes have no name that SQL
could state; what they say is compared through the nodes that they belong to.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.naming import BASE, DR, OWL, RDF, RDFS, SH, XSD
from quadrille.operators import ontology, triples
from quadrille.operators.evolution import diff
from quadrille.operators.frames import SnapshotFrames, build
from quadrille.operators.shapes import read_constraints, shape_quads
from quadrille.sources.harvest import Declared
from quadrille.sources.serialize import ntriples, turtle_blocks

TERM = ["s", "p", "o", "o_kind", "o_datatype"]


def named(quads: DataFrame) -> DataFrame:
    """Statements without blank nodes."""
    return quads.where((F.col("s_kind") != "bnode") & (F.col("o_kind") != "bnode"))


def cardinalities(quads: DataFrame) -> DataFrame:
    """The restrictions of each class: property, kind of bound and its value."""
    sub = quads.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("class"), F.col("o").alias("s"))
    on = quads.where(F.col("p") == OWL + "onProperty").select("s", F.col("o").alias("property"))
    bound = quads.where(F.col("p").isin(OWL + "minCardinality", OWL + "maxCardinality")).select("s", F.col("p").alias("bound"), F.col("o").alias("value"), F.col("o_datatype").alias("datatype"))
    return sub.join(on, "s").join(bound, "s").drop("s")


def altered(spark: SparkSession, after: bool) -> SnapshotFrames:
    """Two states of a schema that differ in every way that a difference knows."""
    text = lambda name, n: {"name": name, "type": "VARCHAR", "length": n}
    number = lambda name, kind="BIGINT", nullable=False: {"name": name, "type": kind, "nullable": nullable}
    people = {"name": "PEOPLE", "columns": [number("ID"), text("NAME", 20), number("AGE", "INTEGER", True), number("OLD", "DATE", True)], "primary_key": ["ID"], "uniques": [("UQ_NAME", ["NAME"])], "checks": [("CHK_AGE", "AGE >= 0 /* years */")]}
    pets = {"name": "PETS", "columns": [number("ID"), number("OWNER_ID"), number("VET_ID")], "primary_key": ["ID"], "foreign_keys": [{"name": "FK_OWNER", "column": "OWNER_ID", "pk_table": "PEOPLE", "pk_column": "ID", "update": "CASCADE", "delete": "SET_NULL"}]}
    if not after:
        tables = [people, pets, {"name": "GONE", "columns": [number("ID")]}]
    else:
        columns = [number("id"), text("NAME", 40), number("AGE", "DECIMAL"), text("MAIL", 100)]
        pets = pets | {"foreign_keys": [{"name": "FK_VET", "column": "VET_ID", "pk_table": "VETS", "pk_column": "ID"}]}
        tables = [people | {"name": "people", "columns": columns, "primary_key": ["NAME", "ID"]}, pets, {"name": "VETS", "columns": [number("ID")]}]
    return build(spark, {"snapshot_id": "after" if after else "before", "database_type": "POSTGRESQL", "database_name": "DB", "schema_name": "S", "extracted_at": datetime(2026, 1, 2 if after else 1), "tables": tables})


def graph_queries(harvest: Callable[[SparkSession, str], SnapshotFrames], fixture: Callable[[SparkSession, int], SnapshotFrames]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def statements(graph: Callable[[SnapshotFrames], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda s, d: named(graph(harvest(s, d))).select("graph", *TERM)

    return {
        "shape_statements": lambda s, d: shape_quads(harvest(s, d)).select(*TERM),
        **{f"{kind}_statements": statements(graph) for kind, graph in ontology.GRAPHS.items()},
        "snapshot_statements": statements(ontology.snapshot_quads),
        "single_graph_statements": statements(ontology.single_graph_quads),
        "merged_statements": lambda s, d: named(triples.merged(ontology.ontology_quads(harvest(s, d)).drop("kind"), "merged")).select(*TERM),
        "linking_ntriples": lambda s, d: ntriples(ontology.linking_quads(harvest(s, d))),
        "linking_turtle_classes": lambda s, d: turtle_blocks(ontology.linking_quads(harvest(s, d))).where(F.col("block").contains("seeAlso")).select("block"),
        "class_cardinalities": lambda s, d: cardinalities(ontology.schema_quads(fixture(s, 2))),
        "check_constraints_read_back": lambda s, d: read_constraints(shape_quads(altered(s, False))).select("kind", "message"),
        "foreign_key_rules": lambda s, d: ontology.schema_quads(altered(s, False)).where((F.col("p") == RDFS + "comment") & F.col("s").contains("Pets")).select("s", "o"),
        "schema_diff_every_kind": lambda s, d: diff(altered(s, False), altered(s, True)),
        "schema_diff_without_previous": lambda s, d: diff(None, altered(s, True)).drop("description"),
    }


def _statements(source: str, subject: str, items: list[tuple], where: str = "TRUE") -> list[str]:
    """A SELECT for each (predicate, object, "iri" or datatype[, condition])."""
    out = []
    for p, o, kind, *when in items:
        is_iri = kind == "iri"
        out.append(f"SELECT {subject} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{'iri' if is_iri else 'literal'}' AS o_kind, {'NULL' if is_iri else repr(XSD + kind)} AS o_datatype FROM {source} WHERE {where} AND {when[0] if when else 'TRUE'}")
    return out


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") {names}"


def _typed(name: str) -> tuple:
    return (RDF + "type", f"'{name}'", "iri")


def _label(text: str) -> tuple:
    return (RDFS + "label", text, "string")


def graph_sql(described: str, pascal: Callable[[str], str], xsd_case: str, declared: Declared, place: dict) -> dict[str, str]:
    """The SQL of graph_queries over the columns that `described` lists (table_name, column_name, column_type, ordinal_position)."""
    db, sc = place["database_name"], place["schema_name"]
    low = lambda x: f"lower(({x})[1:1]) || ({x})[2:]"
    pks = _values([(t, c, 1) for t, held in declared.primary_keys.items() for c in held], "p(table_name, column_name, is_pk)")
    fks = _values([(t, c, pt, n) for n, t, c, pt, _ in declared.foreign_keys], "f(table_name, column_name, target, fk_name)")
    head = f"""WITH cols AS (SELECT d.*, CASE column_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' ELSE column_type END AS data_type,
        {xsd_case} AS xsd, {pascal("table_name")} AS tp, {pascal("column_name")} AS cp, {low(pascal("column_name"))} AS cc, coalesce(is_pk, 0) = 1 AS pk, target IS NOT NULL AS fk, fk_name, {pascal("target")} AS tt
        FROM ({described}) d LEFT JOIN {pks} USING (table_name, column_name) LEFT JOIN {fks} USING (table_name, column_name)),
        tabs AS (SELECT DISTINCT table_name, tp FROM cols), one AS (SELECT 1 AS x),
        checks AS (SELECT table_name, {pascal("table_name")} AS tp, n, clause FROM {_values([(t, n, c) for t, held in declared.checks.items() for n, c in held], "c(table_name, n, clause)")}),
        uniques AS (SELECT table_name, {pascal("table_name")} AS tp, n, list FROM {_values([(t, n, ", ".join(c)) for t, held in declared.uniques.items() for n, c in held], "u(table_name, n, list)")})
        """
    b = lambda rest: f"'{BASE}' || {rest}"
    node, cls = b("tp || 'Shape'"), b("tp")
    prop = b("tp || 'Shape/' || CASE WHEN fk THEN 'has' || tt ELSE cc END || 'Shape'")
    link, attribute = b("tp || '_has' || tt"), b("tp || '_' || cc")
    constraint = b("tp || 'Shape/constraint/' || n")
    shapes = [
        *_statements("tabs", node, [_typed(SH + "NodeShape"), (SH + "targetClass", cls, "iri"), _label("table_name || 'Shape'")]),
        *_statements("cols", node, [(SH + "property", prop, "iri")]),
        *_statements("cols", prop, [_typed(SH + "PropertyShape"), (SH + "name", "column_name", "string"), _label("table_name || '.' || column_name || ' shape'"), (SH + "path", f"CASE WHEN fk THEN {link} ELSE {attribute} END", "iri"), (SH + "datatype", "xsd", "iri", "NOT fk"), (SH + "class", b("tt"), "iri", "fk"), (SH + "nodeKind", f"'{SH}' || CASE WHEN fk THEN 'IRI' ELSE 'Literal' END", "iri"), (SH + "maxCount", "1", "int")]),
        *_statements("checks", node, [(SH + "sparql", constraint, "iri")]),
        *_statements("uniques", node, [(SH + "sparql", constraint, "iri")]),
        *_statements("checks", constraint, [_typed(SH + "SPARQLConstraint"), _label("n"), (SH + "message", "'CHECK constraint violated: ' || n", "string"), (RDFS + "comment", "'SQL CHECK: ' || clause", "string"), (SH + "select", "'SELECT $this WHERE { FILTER(false) } /* ' || clause || ' */'", "string")]),
        *_statements("uniques", constraint, [_typed(SH + "SPARQLConstraint"), _label("n"), (SH + "message", "'UNIQUE constraint violated: ' || n || ' (' || list || ')'", "string"), (RDFS + "comment", "'UNIQUE on columns: ' || list", "string")]),
    ]
    graphs = {kind: BASE + f"{folder}/{db}/{sc}" for kind, folder in (("repository", "repo"), ("schema", "ontology"), ("linking", "link"))} | {"vocabulary": BASE + "vocabulary/datarepository"}

    def header(kind: str, label: str, comment: str, *imports: str) -> list[str]:
        return _statements("one", f"'{graphs[kind]}'", [_typed(OWL + "Ontology"), _label(f"'{label}'"), (RDFS + "comment", f"'{comment}'", "string"), (OWL + "versionInfo", "'1.0'", "string"), *[(OWL + "imports", f"'{x}'", "iri") for x in imports]])

    words = [(n, "Class", text, None, None) for n, text in ontology.CLASSES.items()]
    words += [(n, "ObjectProperty", f"From {x} to {y}.", DR + x, DR + y) for n, (x, y) in ontology.LINKS.items()]
    words += [(n, "DatatypeProperty", f"{n} of {x}.", DR + x, XSD + t) for x, held in ontology.ATTRIBUTES.items() for n, t in held.items()]
    terms_of_vocabulary = _statements(_values(words, "w(n, kind, text, d, r)"), f"'{DR}' || n", [(RDF + "type", f"'{OWL}' || kind", "iri"), _label("n"), (RDFS + "comment", "text", "string"), (RDFS + "domain", "d", "iri", "d IS NOT NULL"), (RDFS + "range", "r", "iri", "r IS NOT NULL")])
    vocabulary = header("vocabulary", "DataRepository Vocabulary", "Classes and properties that describe harvested schemas.") + terms_of_vocabulary

    iso = "'2026-01-01T00:00:00Z'"
    cell = [_typed(DR + "TableColumn"), _label("column_name"), (DR + "columnName", "column_name", "string"), (DR + "sqlDataType", "data_type", "string"), (DR + "ordinalPosition", "ordinal_position", "int"), (DR + "isNullable", "TRUE", "boolean"), (DR + "isPrimaryKey", "pk", "boolean"), (DR + "isForeignKey", "fk", "boolean")]
    sheet = [_typed(DR + "DatabaseTable"), _label("table_name"), (DR + "tableName", "table_name", "string"), (DR + "tableType", "'TABLE'", "string")]

    def holding(repo: str, schema: str, table: str, column: str) -> list[str]:
        """What a repository, its schema, the tables and the columns say, under the names that the graph uses."""
        return [
            *_statements("one", f"'{repo}'", [_typed(DR + "DataRepository"), _label(f"'{db} / {sc}'"), (DR + "databaseType", "'PARQUET'", "string"), (DR + "databaseName", f"'{db}'", "string"), (DR + "extractedAt", iso, "dateTime"), (DR + "hasSchema", f"'{schema}'", "iri")]),
            *_statements("one", f"'{schema}'", [_typed(DR + "DatabaseSchema"), _label(f"'{sc}'"), (DR + "schemaName", f"'{sc}'", "string")]),
            *_statements("tabs", table, sheet), *_statements("tabs", f"'{schema}'", [(DR + "hasTable", table, "iri")]),
            *_statements("cols", column, cell), *_statements("cols", table, [(DR + "hasColumn", column, "iri")]),
        ]

    repo = BASE + f"repo/{db}_{sc}"
    table_node = b("'repo/table/' || tp")
    repository = header("repository", f"Repository Instance: {db} / {sc}", f"Individuals of {db} / {sc}", graphs["vocabulary"]) + holding(repo, repo + "_Schema", table_node, b("'repo/column/' || tp || '_' || cp"))
    classes = [
        *_statements("tabs", cls, [_typed(OWL + "Class"), _label("table_name")]),
        *_statements("cols", attribute, [_typed(OWL + "DatatypeProperty"), _label("column_name"), (RDFS + "domain", cls, "iri"), (RDFS + "range", "xsd", "iri")], "NOT fk"),
        *_statements("cols", link, [_typed(OWL + "ObjectProperty"), _label("'references' || tt"), (RDFS + "domain", cls, "iri"), (RDFS + "range", b("tt"), "iri"), (RDFS + "comment", "'FK: ' || fk_name || ' | UPDATE=NO_ACTION | DELETE=NO_ACTION'", "string")], "fk"),
        *_statements("checks", cls, [(RDFS + "comment", "'CHECK[' || n || ']: ' || clause", "string")]),
    ]
    schema = header("schema", f"Schema Ontology: {db} / {sc}", f"Classes and properties of {db} / {sc}", graphs["vocabulary"])
    schema += _statements("one", b("'tableType'"), [_typed(OWL + "AnnotationProperty"), _label("'tableType'")]) + classes + _statements("tabs", cls, [(BASE + "tableType", "'TABLE'", "string")])
    linking = header("linking", f"Linking Ontology: {db} / {sc}", "From classes to the tables they stand for.", graphs["repository"], graphs["schema"])
    linking += _statements("one", f"'{DR}sourceTable'", [_typed(OWL + "AnnotationProperty"), _label("'sourceTable'"), (RDFS + "comment", "'The table individual that a class stands for.'", "string"), (RDFS + "domain", f"'{OWL}Class'", "iri"), (RDFS + "range", f"'{DR}DatabaseTable'", "iri")])
    linking += _statements("tabs", cls, [(DR + "sourceTable", table_node, "iri"), (RDFS + "seeAlso", table_node, "iri")])

    record = BASE + f"extraction/{db}/{sc}/2026-01-01_00-00-00-000"
    stable, stable_schema = BASE + f"repo/{db}", BASE + f"repo/{db}/{sc}"
    record_table, record_column = f"'{record}/table/' || tp", f"'{record}/column/' || tp || '_' || cp"
    snapshot = [
        *_statements("one", f"'{record}'", [_typed(DR + "ExtractionRecord"), _label(f"'Extraction: {db}/{sc} @ ' || {iso}"), (DR + "forRepository", f"'{stable}'", "iri"), (DR + "forSchema", f"'{stable_schema}'", "iri"), (DR + "databaseType", "'PARQUET'", "string"), (DR + "databaseName", f"'{db}'", "string"), (DR + "extractedAt", iso, "dateTime"), (DR + "tableCount", "(SELECT count(*) FROM tabs)", "int"), (DR + "columnCount", "(SELECT count(*) FROM cols)", "int")]),
        *_statements("one", f"'{stable}'", [_typed(DR + "DataRepository"), _label(f"'{db}'"), (DR + "databaseType", "'PARQUET'", "string"), (DR + "databaseName", f"'{db}'", "string"), (DR + "hasSchema", f"'{stable_schema}'", "iri")]),
        *_statements("one", f"'{stable_schema}'", [_typed(DR + "DatabaseSchema"), _label(f"'{sc}'"), (DR + "schemaName", f"'{sc}'", "string")]),
        *_statements("tabs", record_table, sheet), *_statements("tabs", f"'{record}'", [(DR + "hasTable", record_table, "iri")]),
        *_statements("cols", record_column, cell), *_statements("cols", record_table, [(DR + "hasColumn", record_column, "iri")]),
    ]
    single, own = BASE + f"{db}/{sc}", b("tp || '_TableNode'")
    one_graph = [
        *terms_of_vocabulary,
        *_statements("one", f"'{single}'", [_typed(OWL + "Ontology"), (RDFS + "comment", f"'Ontology of the PARQUET schema {sc}'", "string"), (OWL + "versionInfo", "'1.0'", "string")]),
        *_statements("one", b("'describedBy'"), [_typed(OWL + "AnnotationProperty"), _label("'describedBy'")]),
        *holding(BASE + f"{db}_{sc}_Repository", BASE + f"{db}_{sc}_Schema", own, b("tp || '_' || cp || '_ColNode'")),
        *classes, *_statements("tabs", cls, [(BASE + "describedBy", own, "iri")]),
    ]
    terms = ", ".join(TERM)
    of = lambda parts, graph=None: f"{head} SELECT DISTINCT {f'{graph!r} AS graph, ' if graph else ''}{terms} FROM ({' UNION ALL '.join(parts)})"
    line = "'<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"' END || ' .'"
    required = [("Customers", c, 1) for c in ("customerId", "firstName", "lastName", "email")] + [("Orders", c, 1) for c in ("orderId", "status")] + [("Products", c, 1) for c in ("productId", "productName", "price")]
    changes = [
        (0, "TABLE_ADDED", "VETS", None, None, None, "Table 'VETS' was added"),
        (1, "TABLE_DROPPED", "GONE", None, None, None, "Table 'GONE' was dropped"),
        (2, "COLUMN_ADDED", "people", "MAIL", None, "VARCHAR", "Column 'people.MAIL' was added (VARCHAR, nullable)"),
        (3, "COLUMN_DROPPED", "people", "OLD", "DATE", None, "Column 'people.OLD' was dropped"),
        (4, "COLUMN_LENGTH_CHANGED", "people", "NAME", "20", "40", "Column 'people.NAME' maxLength changed from 20 to 40"),
        (5, "COLUMN_TYPE_CHANGED", "people", "AGE", "INTEGER", "DECIMAL", "Column 'people.AGE' type changed from 'INTEGER' to 'DECIMAL'"),
        (6, "COLUMN_NULLABILITY_CHANGED", "people", "AGE", "true", "false", "Column 'people.AGE' nullability changed from true to false"),
        (7, "PRIMARY_KEY_CHANGED", "people", None, None, None, "Primary key changed from [ID] to [ID, NAME]"),
        (8, "FOREIGN_KEY_ADDED", "PETS", "VET_ID", None, "VETS.ID", "FK 'FK_VET' added: PETS.VET_ID → VETS.ID"),
        (9, "FOREIGN_KEY_DROPPED", "PETS", "OWNER_ID", "PEOPLE.ID", None, "FK 'FK_OWNER' dropped"),
    ]
    return {
        "shape_statements": of(shapes),
        "vocabulary_statements": of(vocabulary, graphs["vocabulary"]),
        "repository_statements": of(repository, graphs["repository"]),
        "schema_statements": of(schema, graphs["schema"]),
        "linking_statements": of(linking, graphs["linking"]),
        "snapshot_statements": of(snapshot, record),
        "single_graph_statements": of(one_graph, single),
        "merged_statements": of(vocabulary + repository + schema + linking),
        "linking_ntriples": f"{head} SELECT DISTINCT {line} AS value FROM ({' UNION ALL '.join(linking)})",
        "linking_turtle_classes": f"{head} SELECT 'schema:' || tp || ' dr:sourceTable <' || {table_node} || '> ;\n    rdfs:seeAlso <' || {table_node} || '> .' AS block FROM tabs",
        "class_cardinalities": f"SELECT '{BASE}' || t AS class, '{BASE}' || t || '_' || c AS property, '{OWL}' || k AS bound, '1' AS value, '{XSD}nonNegativeInteger' AS datatype FROM {_values(required, 'v(t, c, n)')}, (VALUES ('minCardinality'), ('maxCardinality')) b(k)",
        "check_constraints_read_back": "SELECT * FROM (VALUES ('UNIQUE', 'UNIQUE on columns: NAME'), ('CHECK', 'SQL CHECK: AGE >= 0 /* years */')) t(kind, message)",
        "foreign_key_rules": f"SELECT '{BASE}Pets_hasPeople' AS s, 'FK: FK_OWNER | UPDATE=CASCADE | DELETE=SET_NULL' AS o",
        "schema_diff_every_kind": "SELECT change_no::BIGINT AS change_no, * EXCLUDE (change_no) FROM " + _values(changes, "t(change_no, change_type, table_name, column_name, previous_value, new_value, description)"),
        "schema_diff_without_previous": "SELECT * FROM (SELECT '' AS change_type, '' AS table_name, '' AS column_name, '' AS previous_value, '' AS new_value, 0::BIGINT AS change_no) WHERE FALSE",
    }
