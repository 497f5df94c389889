"""The reference workload: filter requests, harvests, graphs, text, differences and registries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import naming, xsd
from quadrille.graph_queries import graph_queries, graph_sql
from quadrille.operators import filters, ontology, statements, triples, versions
from quadrille.operators.evolution import diff
from quadrille.operators.frames import SnapshotFrames, build
from quadrille.operators.shapes import read_constraints, read_keys, read_shapes, shape_quads, shape_tables
from quadrille.plans import sqltext
from quadrille.sources.harvest import Declared, harvest_parquet
from quadrille.sources.serialize import ntriples

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
DECLARED = Declared(
    primary_keys={"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"]},
    foreign_keys=[("fk_nation_region", "nation", "n_regionkey", "region", "r_regionkey"), ("fk_customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("fk_supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("fk_orders_customer", "orders", "o_custkey", "customer", "c_custkey"), ("fk_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("fk_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"), ("fk_lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey")],
    uniques={"nation": [("uq_nation_name", ["n_name"])]},
    checks={"lineitem": [("chk_quantity", "l_quantity >= 0")], "part": [("chk_size", "p_size > 0")]},
)
HARVEST = {"snapshot_id": "tables", "database_name": "testdata", "schema_name": "public"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def harvest(spark: SparkSession, sf_dir: str, include: list[str] | None = None) -> SnapshotFrames:
    return harvest_parquet(spark, sf_dir, TABLES, DECLARED, HARVEST, include)


def _request(name: str, **parts) -> Callable[[SparkSession, str], DataFrame]:
    """A filter request over one table: harvest its shape, validate, plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shape = shape_tables(harvest(spark, sf_dir, [name]))
        request = filters.Request.parse({"tableName": name, **parts})
        return filters.run(request, table(spark, sf_dir, name), filters.resolve(name, shape))

    return run


def _one(column: str, operator: str, *values: str) -> dict:
    c: dict = {"column": column, "operator": operator}
    if operator in ("IN", "NOT_IN"):
        c["values"] = list(values)
    else:
        c |= dict(zip(("value", "valueTo"), values, strict=False))
    return {"criteria": [c]}


ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ITEM = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
NESTED = {
    "operator": "AND",
    "criteria": [{"column": "o_totalprice", "operator": "GT", "value": "1000"}],
    "groups": [
        {"operator": "OR", "criteria": [{"column": "o_orderstatus", "operator": "EQ", "value": "F"}, {"column": "o_orderpriority", "operator": "LIKE", "value": "1%"}], "groups": [{"operator": "AND", "criteria": [{"column": "o_orderstatus", "operator": "EQ", "value": "O"}, {"column": "o_orderdate", "operator": "GTE", "value": "1996-01-01"}]}]},
        {"operator": "AND", "criteria": [], "groups": []},
    ],
}
FLAGSHIP = {"selectColumns": ["o_orderkey", "o_orderstatus", "o_totalprice"], "filterGroup": {"criteria": [{"column": "o_orderstatus", "operator": "IN", "values": ["F", "O"]}, {"column": "o_totalprice", "operator": "BETWEEN", "value": "1000", "valueTo": "50000"}]}, "orderBy": [{"column": "o_totalprice", "direction": "DESC"}, {"column": "o_orderkey"}], "limit": 10}


def _nullable(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    """IS_NULL needs a column that has nulls: the lowest priority counts as unknown here."""
    df = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    shape = filters.resolve("orders", shape_tables(harvest(spark, sf_dir, ["orders"])))
    return filters.run(filters.Request.parse({"tableName": "ORDERS", "selectColumns": ORDER, "filterGroup": _one("o_orderpriority", op)}), df, shape)


def _pk(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    df, shape = table(spark, sf_dir, "orders"), filters.resolve("orders", shape_tables(harvest(spark, sf_dir, ["orders"])))
    key = {"o_orderkey": 1}
    if what == "select":
        return statements.select_by_pk(df, shape, key)
    if what == "update":
        return statements.update_by_pk(df, shape, key, {"o_orderstatus": "X", "o_totalprice": 1.5})
    if what == "insert":
        return statements.insert(df, shape, {"o_orderkey": -1, "o_orderstatus": "N"})
    return statements.delete_by_pk(df, shape, key)


def fixture(spark: SparkSession, version: int) -> SnapshotFrames:
    """The evolution scenario: customers and orders, then a product table and a phone, then a name less, a longer status and notes."""
    customers = [{"name": "CUSTOMER_ID", "type": "BIGINT", "nullable": False}, {"name": "FIRST_NAME", "type": "VARCHAR", "length": 100, "nullable": False}]
    if version < 3:
        customers.append({"name": "LAST_NAME", "type": "VARCHAR", "length": 100, "nullable": False})
    customers.append({"name": "EMAIL", "type": "VARCHAR", "length": 255, "nullable": False})
    if version > 1:
        customers.append({"name": "PHONE", "type": "VARCHAR", "length": 20})
    orders = [{"name": "ORDER_ID", "type": "BIGINT", "nullable": False}, {"name": "CUSTOMER_ID", "type": "BIGINT", "nullable": False}, {"name": "STATUS", "type": "VARCHAR", "length": 100 if version > 2 else 50, "nullable": False}, {"name": "TOTAL_AMOUNT", "type": "DECIMAL"}]
    if version > 2:
        orders.append({"name": "NOTES", "type": "VARCHAR", "length": 500})
    tables = [{"name": "CUSTOMERS", "columns": customers, "primary_key": ["CUSTOMER_ID"], "uniques": [("UQ_EMAIL", ["EMAIL"])]}, {"name": "ORDERS", "columns": orders, "primary_key": ["ORDER_ID"], "foreign_keys": [{"name": "FK_ORDERS_CUSTOMER", "column": "CUSTOMER_ID", "pk_table": "CUSTOMERS", "pk_column": "CUSTOMER_ID"}]}]
    if version > 1:
        tables.append({"name": "PRODUCTS", "columns": [{"name": "PRODUCT_ID", "type": "BIGINT", "nullable": False}, {"name": "PRODUCT_NAME", "type": "VARCHAR", "length": 200, "nullable": False}, {"name": "PRICE", "type": "DECIMAL", "nullable": False}], "primary_key": ["PRODUCT_ID"]})
    when = {1: datetime(2026, 1, 1, 10), 2: datetime(2026, 3, 15, 10), 3: datetime(2026, 6, 1, 10)}[version]
    return build(spark, {"snapshot_id": f"v{version}", "database_type": "POSTGRESQL", "database_name": "EVOLUTION_DB", "schema_name": "EVOLUTION_SCHEMA", "extracted_at": when, "tables": tables})


def all_versions(spark: SparkSession) -> SnapshotFrames:
    return fixture(spark, 1).union(fixture(spark, 2)).union(fixture(spark, 3))


def _diff(spark: SparkSession, a: int, b: int) -> DataFrame:
    return diff(fixture(spark, a), fixture(spark, b)).drop("description")


def _records(spark: SparkSession) -> DataFrame:
    frames = all_versions(spark)
    return versions.record_rows(frames, F.concat(F.lit(naming.HARVEST), "snapshot_id"))


def _show(records: DataFrame) -> DataFrame:
    return records.select("snapshot_id", "table_count", "column_count", naming.iso_instant(F.col("extracted_at")).alias("extracted_at"), "record")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest(spark, sf_dir).columns.select("table_name", "column_name", (F.col("col_seq") + 1).cast("long").alias("ordinal_position"), xsd.to_xsd(F.col("data_type")).alias("xsd"))


def _naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = harvest(spark, sf_dir).columns
    t, n = F.col("table_name"), F.col("column_name")
    return c.select("table_name", "column_name", naming.class_iri(t).alias("class_iri"), naming.data_property_iri(t, n).alias("property_iri"), naming.property_shape_iri(t, n).alias("shape_iri"), naming.camel_to_upper_snake(naming.camel(n)).alias("back"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = shape_tables(harvest(spark, sf_dir))
    rows = [(d, k, s.kind, s.sql, ",".join(s.params)) for d in xsd.DIALECTS for held in sqltext.statements(shapes, dialect=d).values() for k, s in enumerate(held)]
    return spark.createDataFrame(rows, "dialect string, seq int, kind string, sql string, params string")


def _filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the nested request, run by Spark itself with named parameters."""
    shape = filters.resolve("orders", shape_tables(harvest(spark, sf_dir, ["orders"])))
    request = filters.Request.parse({"tableName": "orders", "dialect": "SNOWFLAKE", "selectColumns": ["o_orderkey", "o_totalprice"], "filterGroup": NESTED})
    text = sqltext.filter_select(request, shape)
    table(spark, sf_dir, "orders").createOrReplaceTempView(shape.name)
    # a request's values are strings; the columns' types decide what is bound
    read = {"double": float, "decimal": float, "long": int, "integer": int, "dateTime": datetime.fromisoformat}
    kinds = {c.name: (c.xsd_datatype or naming.XSD + "long").removeprefix(naming.XSD) for c in shape.columns}
    values = {name: read.get(kinds[c.column.upper()], str)(v) for c in request.where.walk() for name, v in zip(sqltext.param_names(c), c.values or [c.value, c.value_to], strict=False)}
    out = spark.sql(text.sql.rstrip(";"), args=values).toDF("o_orderkey", "o_totalprice")
    spark.catalog.dropTempView(shape.name)  # the plan is resolved and needs it no more
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _request("orders", **FLAGSHIP)(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship_filter": flagship,
    "filter_eq": _request("orders", selectColumns=ORDER, filterGroup=_one("O_ORDERSTATUS", "EQ", "F")),
    "filter_neq": _request("orders", selectColumns=ORDER, filterGroup=_one("o_orderstatus", "NEQ", "F")),
    "filter_gt": _request("lineitem", selectColumns=ITEM, filterGroup=_one("l_quantity", "GT", "45")),
    "filter_gte": _request("lineitem", selectColumns=ITEM, filterGroup=_one("l_quantity", "GTE", "45")),
    "filter_lt": _request("lineitem", selectColumns=ITEM, filterGroup=_one("l_shipdate", "LT", "1996-01-01")),
    "filter_lte": _request("lineitem", selectColumns=ITEM, filterGroup=_one("l_extendedprice", "LTE", "1500.5")),
    "filter_like": _request("part", filterGroup=_one("p_type", "LIKE", "%A%")),
    "filter_not_like": _request("part", filterGroup=_one("p_type", "NOT_LIKE", "%A%")),
    "filter_ilike": _request("customer", filterGroup=_one("c_mktsegment", "ILIKE", "%build%")),
    "filter_in": _request("orders", selectColumns=ORDER, filterGroup=_one("o_orderstatus", "IN", "F", "P")),
    "filter_not_in": _request("orders", selectColumns=ORDER, filterGroup=_one("o_orderstatus", "NOT_IN", "F", "P")),
    "filter_between": _request("orders", selectColumns=ORDER, filterGroup=_one("o_orderdate", "BETWEEN", "1997-01-01", "1997-12-31")),
    "filter_not_between": _request("orders", selectColumns=ORDER, filterGroup=_one("o_totalprice", "NOT_BETWEEN", "1000", "200000")),
    "filter_is_null": lambda s, d: _nullable(s, d, "IS_NULL"),
    "filter_is_not_null": lambda s, d: _nullable(s, d, "IS_NOT_NULL"),
    "filter_nested_and_or": _request("orders", selectColumns=ORDER, filterGroup=NESTED),
    "filter_text_in_spark": _filter_text,
    "filter_order_limit_offset": _request("orders", selectColumns=["o_orderkey", "o_totalprice"], orderBy=[{"column": "o_totalprice", "direction": "DESC"}, {"column": "o_orderkey", "direction": "ASC"}], limit=25, offset=50),
    "select_all": lambda s, d: statements.select_all(table(s, d, "orders"), filters.resolve("orders", shape_tables(harvest(s, d, ["orders"])))),
    "select_by_pk": lambda s, d: _pk(s, d, "select"),
    "insert_projection": lambda s, d: _pk(s, d, "insert"),
    "update_by_pk_projection": lambda s, d: _pk(s, d, "update"),
    "delete_by_pk_projection": lambda s, d: _pk(s, d, "delete"),
    "harvest_tables": lambda s, d: harvest(s, d).tables.select("table_name", "table_type"),
    "harvest_columns": _columns,
    "harvest_counts": lambda s, d: harvest(s, d).counts().drop("snapshot_id"),
    "iri_naming": _naming,
    "xsd_type_counts": lambda s, d: _columns(s, d).groupBy("xsd").agg(F.count("*").alias("columns")),
    "shape_triples": lambda s, d: triples.counts(shape_quads(fixture(s, 1).union(fixture(s, 2)).union(fixture(s, 3)))).drop("graph"),
    "shape_predicate_counts": lambda s, d: shape_quads(fixture(s, 2)).groupBy("p").agg(F.count("*").alias("n")),
    "shape_roundtrip": lambda s, d: read_shapes(shape_quads(harvest(s, d))).select("table_name", "column_name", "nullable", "is_foreign_key", "referenced_table"),
    "shape_constraints": lambda s, d: read_constraints(shape_quads(fixture(s, 1))).select("kind", "message"),
    "haskey_lists": lambda s, d: read_keys(ontology.schema_quads(fixture(s, 2))).select("class", "pos", "column_name"),
    "ontology_triple_counts": lambda s, d: ontology.ontology_quads(fixture(s, 2)).groupBy("kind").agg(F.count("*").alias("triples")),
    "ontology_merged_count": lambda s, d: triples.merged(ontology.ontology_quads(fixture(s, 2)).drop("kind"), "merged").agg(F.count("*").alias("triples")),
    "ontology_type_counts": lambda s, d: triples.type_counts(ontology.schema_quads(fixture(s, 2))).select("type", "subjects"),
    "snapshot_graph_count": lambda s, d: triples.counts(ontology.snapshot_quads(fixture(s, 3))).select("graph", "triples"),
    "ntriples_lines": lambda s, d: ntriples(ontology.linking_quads(fixture(s, 1))).groupBy(F.endswith("value", F.lit(" .")).alias("whole")).agg(F.count("*").alias("lines")),
    "sql_statements": _statements,
    "schema_diff_v1_v2": lambda s, d: _diff(s, 1, 2),
    "schema_diff_v2_v3": lambda s, d: _diff(s, 2, 3),
    "latest_snapshot": lambda s, d: _show(versions.latest(_records(s), "EVOLUTION_DB", "EVOLUTION_SCHEMA")),
    "latest_of_each_schema": lambda s, d: _show(versions.latest_of_each(_records(s))),
    "snapshot_history": lambda s, d: _show(versions.history(_records(s), "EVOLUTION_DB", "EVOLUTION_SCHEMA")),
    "next_version": lambda s, d: versions.next_version(_records(s).select("database_name", "schema_name", F.substring("snapshot_id", 2, 9).cast("int").alias("version")), "EVOLUTION_DB", "EVOLUTION_SCHEMA"),
    "version_chain": lambda s, d: versions.with_previous(_records(s).select("database_name", "schema_name", F.substring("snapshot_id", 2, 9).cast("int").alias("version"))).select("version", "previous_version", "is_current"),
    "version_graph_counts": lambda s, d: triples.counts(versions.version_quads(fixture(s, 3), diff(fixture(s, 2), fixture(s, 3)), 3)).select("graph", "triples"),
    "fk_orphans": lambda s, d: statements.orphans(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders"), "o_orderkey").select("l_orderkey", "l_linenumber"),
    "unique_violations": lambda s, d: statements.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    **graph_queries(harvest, fixture),
}

_X = naming.XSD
_O = ", ".join(ORDER)
_I = ", ".join(ITEM)
_DESCRIBED = " UNION ALL ".join(f"SELECT {i} AS table_seq, '{t}' AS table_name, column_name, column_type, row_number() OVER () AS ordinal_position FROM (DESCRIBE {t})" for i, t in enumerate(TABLES))
_XSD_CASE = f"""'{_X}' || CASE column_type WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'dateTime' ELSE 'string' END"""
_PASCAL = "list_aggregate(list_transform(string_split({0}, '_'), lambda x: upper(x[1:1]) || x[2:]), 'string_agg', '')"
_CAMEL = "lower(({0})[1:1]) || ({0})[2:]"
_TP, _CP = _PASCAL.format("table_name"), _PASCAL.format("column_name")
_CC = _CAMEL.format(_CP)
_NESTED_SQL = "o_totalprice > 1000 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '1%' OR (o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01'))"
_FKS = "(VALUES " + ", ".join(f"('{t}', '{c}', '{''.join(w.title() for w in pt.split('_'))}')" for _, t, c, pt, _ in DECLARED.foreign_keys) + ") f(table_name, column_name, target)"
_BASE, _DB = naming.BASE, "EVOLUTION_DB/EVOLUTION_SCHEMA"
_RECORDS = f"(VALUES ('v1', 2, 8, '2026-01-01T10:00:00Z', '{_BASE}extraction/{_DB}/2026-01-01_10-00-00-000'), ('v2', 3, 12, '2026-03-15T10:00:00Z', '{_BASE}extraction/{_DB}/2026-03-15_10-00-00-000'), ('v3', 3, 12, '2026-06-01T10:00:00Z', '{_BASE}extraction/{_DB}/2026-06-01_10-00-00-000')) r(snapshot_id, table_count, column_count, extracted_at, record)"
_STATEMENTS = f"""
    WITH cols AS (SELECT table_name, ordinal_position AS i, {_TP} AS tp, upper(column_name) AS u, column_type, target AS tt, key_column IS NOT NULL AS pk
        FROM ({_DESCRIBED}) columns LEFT JOIN {_FKS} USING (table_name, column_name) LEFT JOIN (VALUES {", ".join(f"('{t}', '{c}')" for t, held in DECLARED.primary_keys.items() for c in held)}) p(table_name, key_column) ON p.table_name = columns.table_name AND key_column = column_name),
    named AS (SELECT *, CASE dialect WHEN 'SNOWFLAKE' THEN '' ELSE '"' END AS q,
        CASE WHEN tt IS NOT NULL OR column_type = 'BIGINT' THEN 'BIGINT' WHEN column_type = 'INTEGER' THEN 'INTEGER' WHEN column_type = 'DOUBLE' THEN CASE dialect WHEN 'SNOWFLAKE' THEN 'DOUBLE' ELSE 'DOUBLE PRECISION' END WHEN column_type = 'TIMESTAMP' THEN CASE dialect WHEN 'SNOWFLAKE' THEN 'TIMESTAMP_NTZ' ELSE 'TIMESTAMP' END ELSE 'VARCHAR' END AS kind
        FROM cols, (VALUES ('ANSI'), ('SNOWFLAKE'), ('POSTGRESQL')) d(dialect)),
    parts AS (SELECT dialect, q || tp || q AS t, tp, string_agg('    ' || q || u || q, ',
' ORDER BY i) AS names, string_agg('    ' || q || u || q || ' ' || kind, ',
' ORDER BY i) AS definitions, string_agg(u, ',' ORDER BY i) AS all_params,
        string_agg('    :' || u, ',
' ORDER BY i) AS binds, string_agg('    ' || q || u || q || ' = :' || u, ',
' ORDER BY i) FILTER (NOT pk) AS updates, string_agg(u, ',' ORDER BY i) FILTER (NOT pk) AS free, max(u) FILTER (pk) AS key, max(q || u || q) FILTER (pk) AS quoted_key,
        string_agg(',
    CONSTRAINT fk_' || tp || '_' || tt || ' FOREIGN KEY (' || q || u || q || ') REFERENCES ' || q || tt || q || ' (' || q || u || q || ')', '' ORDER BY i) FILTER (tt IS NOT NULL) AS links
        FROM named GROUP BY dialect, tp, q),
    clauses AS (SELECT *, 'SELECT
' || names || '
FROM ' || t AS body, CASE WHEN key IS NULL THEN '
WHERE /* no primary key defined */' ELSE '
WHERE ' || quoted_key || ' = :' || key END AS by_key FROM parts)
    SELECT dialect, 0 AS seq, 'CREATE_TABLE' AS kind, 'CREATE TABLE ' || t || ' (
' || definitions || coalesce(',
    CONSTRAINT pk_' || tp || ' PRIMARY KEY (' || quoted_key || ')', '') || coalesce(links, '') || '
);' AS sql, '' AS params FROM clauses
    UNION ALL SELECT dialect, 1, 'SELECT_ALL', body || ';', '' FROM clauses
    UNION ALL SELECT dialect, 2, 'SELECT_BY_PK', body || by_key || ';', coalesce(key, '') FROM clauses
    UNION ALL SELECT dialect, 3, 'INSERT', 'INSERT INTO ' || t || ' (
' || names || '
) VALUES (
' || binds || '
);', all_params FROM clauses
    UNION ALL SELECT dialect, 4, 'UPDATE_BY_PK', 'UPDATE ' || t || ' SET
' || updates || by_key || ';', free || coalesce(',' || key, '') FROM clauses
    UNION ALL SELECT dialect, 5, 'DELETE_BY_PK', 'DELETE FROM ' || t || replace(by_key, 'no primary key defined', 'no primary key defined — DELETE ALL') || ';', coalesce(key, '') FROM clauses"""
_RECORD_ROW = "snapshot_id, table_count::BIGINT AS table_count, column_count::BIGINT AS column_count, extracted_at, record"
_DIFF_HEAD = "SELECT change_type, table_name, column_name::VARCHAR AS column_name, previous_value::VARCHAR AS previous_value, new_value::VARCHAR AS new_value, change_no::BIGINT AS change_no FROM (VALUES "
_DIFF_TAIL = ") d(change_no, change_type, table_name, column_name, previous_value, new_value)"

ORACLE_SQL: dict[str, str] = {
    "flagship_filter": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 10",
    "filter_eq": f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq": f"SELECT {_O} FROM orders WHERE o_orderstatus != 'F'",
    "filter_gt": f"SELECT {_I} FROM lineitem WHERE l_quantity > 45",
    "filter_gte": f"SELECT {_I} FROM lineitem WHERE l_quantity >= 45",
    "filter_lt": f"SELECT {_I} FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'",
    "filter_lte": f"SELECT {_I} FROM lineitem WHERE l_extendedprice <= 1500.5",
    "filter_like": "SELECT * FROM part WHERE p_type LIKE '%A%'",
    "filter_not_like": "SELECT * FROM part WHERE p_type NOT LIKE '%A%'",
    "filter_ilike": "SELECT * FROM customer WHERE c_mktsegment ILIKE '%build%'",
    "filter_in": f"SELECT {_O} FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "filter_not_in": f"SELECT {_O} FROM orders WHERE o_orderstatus NOT IN ('F', 'P')",
    "filter_between": f"SELECT {_O} FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
    "filter_not_between": f"SELECT {_O} FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 200000",
    "filter_is_null": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL",
    "filter_is_not_null": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL",
    "filter_nested_and_or": f"SELECT {_O} FROM orders WHERE {_NESTED_SQL}",
    "filter_text_in_spark": f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_NESTED_SQL}",
    "filter_order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 25 OFFSET 50",
    "select_all": "SELECT * FROM orders",
    "select_by_pk": "SELECT * FROM orders WHERE o_orderkey = 1",
    "insert_projection": "SELECT * FROM orders UNION ALL SELECT -1, NULL, 'N', NULL, NULL, NULL",
    "update_by_pk_projection": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 1 THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "delete_by_pk_projection": "SELECT * FROM orders WHERE NOT o_orderkey = 1",
    "harvest_tables": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', 'TABLE')" for t in TABLES) + ") t(table_name, table_type)",
    "harvest_columns": f"SELECT table_name, column_name, ordinal_position, {_XSD_CASE} AS xsd FROM ({_DESCRIBED})",
    "harvest_counts": f"SELECT count(DISTINCT table_name) AS table_count, count(*) AS column_count, {len(DECLARED.foreign_keys)}::BIGINT AS fk_count FROM ({_DESCRIBED})",
    "iri_naming": f"SELECT table_name, column_name, '{_BASE}' || {_TP} AS class_iri, '{_BASE}' || {_TP} || '_' || {_CC} AS property_iri, '{_BASE}' || {_TP} || 'Shape/' || {_CC} || 'Shape' AS shape_iri, upper(regexp_replace({_CC}, '([A-Z])', '_\\1', 'g')) AS back FROM ({_DESCRIBED})",
    "xsd_type_counts": f"SELECT {_XSD_CASE} AS xsd, count(*) AS columns FROM ({_DESCRIBED}) GROUP BY 1",
    "sql_statements": _STATEMENTS,
    "shape_triples": "SELECT * FROM (VALUES ('v1', 86::BIGINT), ('v2', 126::BIGINT), ('v3', 125::BIGINT)) t(snapshot_id, triples)",
    "shape_roundtrip": f"SELECT {_TP} AS table_name, upper(c.column_name) AS column_name, TRUE AS nullable, f.target IS NOT NULL AS is_foreign_key, f.target AS referenced_table FROM (SELECT table_name, column_name FROM ({_DESCRIBED})) c LEFT JOIN {_FKS} USING (table_name, column_name)",
    "shape_constraints": "SELECT 'UNIQUE' AS kind, 'UNIQUE on columns: EMAIL' AS message",
    "haskey_lists": f"SELECT '{_BASE}' || c AS class, 0 AS pos, k AS column_name FROM (VALUES ('Customers', 'CUSTOMER_ID'), ('Customers', 'EMAIL'), ('Orders', 'ORDER_ID'), ('Products', 'PRODUCT_ID')) t(c, k)",
    "schema_diff_v1_v2": _DIFF_HEAD + "(0, 'TABLE_ADDED', 'PRODUCTS', NULL, NULL, NULL), (1, 'COLUMN_ADDED', 'CUSTOMERS', 'PHONE', NULL, 'VARCHAR')" + _DIFF_TAIL,
    "schema_diff_v2_v3": _DIFF_HEAD + "(0, 'COLUMN_DROPPED', 'CUSTOMERS', 'LAST_NAME', 'VARCHAR', NULL), (1, 'COLUMN_ADDED', 'ORDERS', 'NOTES', NULL, 'VARCHAR'), (2, 'COLUMN_LENGTH_CHANGED', 'ORDERS', 'STATUS', '50', '100')" + _DIFF_TAIL,
    "latest_snapshot": f"SELECT {_RECORD_ROW} FROM {_RECORDS} ORDER BY extracted_at DESC LIMIT 1",
    "latest_of_each_schema": f"SELECT {_RECORD_ROW} FROM {_RECORDS} WHERE snapshot_id = 'v3'",
    "snapshot_history": f"SELECT {_RECORD_ROW} FROM {_RECORDS} ORDER BY extracted_at DESC",
    "next_version": "SELECT max(v) + 1 AS version FROM (VALUES (1), (2), (3)) t(v)",
    "version_chain": "SELECT v AS version, lag(v) OVER (ORDER BY v) AS previous_version, v = 3 AS is_current FROM (VALUES (1), (2), (3)) t(v)",
    # what each graph states of the fixture's 3 tables, 12 columns (6 with a length), 1 foreign key and 1 unique constraint
    "ontology_triple_counts": "SELECT kind, n::BIGINT AS triples FROM (VALUES ('vocabulary', 4 + 4 * 3 + 27 * 5), ('repository', 5 + 5 + 4 + 3 * 5 + 12 * 9 + 6), ('schema', 5 + 2 + 3 * 3 + 11 * 4 + 9 * 8 + 5 + 4 * 3), ('linking', 6 + 5 + 3 * 2)) t(kind, n)",
    "ontology_merged_count": "SELECT 460::BIGINT AS triples",
    "shape_predicate_counts": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}::BIGINT)" for k, n in {naming.RDF + "type": 16, naming.SH + "targetClass": 3, naming.RDFS + "label": 16, naming.SH + "name": 12, naming.SH + "path": 12, naming.SH + "datatype": 11, naming.SH + "class": 1, naming.SH + "nodeKind": 12, naming.SH + "maxLength": 6, naming.SH + "minCount": 10, naming.SH + "maxCount": 12, naming.SH + "property": 12, naming.SH + "message": 1, naming.RDFS + "comment": 1, naming.SH + "sparql": 1}.items()) + ") t(p, n)",
    "snapshot_graph_count": f"SELECT '{_BASE}extraction/{_DB}/2026-06-01_10-00-00-000' AS graph, (9 + 5 + 3 + 3 * 5 + 12 * 9 + 6)::BIGINT AS triples",
    "version_graph_counts": f"SELECT '{_BASE}version/{_DB}/' || k AS graph, n::BIGINT AS triples FROM (VALUES ('registry', 4 + 3 + 10), ('v3', 3 * 3 + 12 * 8 + 6), ('v3/changes', 3 * 6 + 2 + 2)) t(k, n)",
    "ontology_type_counts": f"SELECT '{naming.OWL}' || k AS type, n::BIGINT AS subjects FROM (VALUES ('Ontology', 1), ('AnnotationProperty', 1), ('Class', 3), ('DatatypeProperty', 11), ('Restriction', 18), ('ObjectProperty', 1)) t(k, n)",
    "ntriples_lines": "SELECT TRUE AS whole, (6 + 5 + 2 * 2)::BIGINT AS lines",
    "fk_orphans": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)",
    "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    **graph_sql(_DESCRIBED, _PASCAL.format, _XSD_CASE, DECLARED, HARVEST),
}
