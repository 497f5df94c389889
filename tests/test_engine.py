import base64
from datetime import datetime
import json
import random
import subprocess
import sys
import xml.etree.ElementTree as ET

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrille import queries as Q
from quadrille.api import Engine
from quadrille.functions import naming, xsd
from quadrille.operators import filters, ontology, shapes, statements, triples, versions
from quadrille.operators.evolution import diff
from quadrille.operators.frames import build
from quadrille.plans import sqltext
from quadrille.sources import connect, harvest
from quadrille.sources.serialize import Format, ntriples, read_ntriples, serialize
from quadrille.streaming import snapshots
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
LONG, STRING, DECIMAL, TIME = (naming.XSD + x for x in ("long", "string", "decimal", "dateTime"))
ORDERS = shapes.ShapeTable("Orders", [
    shapes.ShapeColumn("ORDER_ID", LONG, False, is_primary_key=True), shapes.ShapeColumn("CUSTOMER_ID", None, False, True, "Customers"),
    shapes.ShapeColumn("STATUS", STRING, False, max_length=50), shapes.ShapeColumn("TOTAL_AMOUNT", DECIMAL), shapes.ShapeColumn("ORDER_DATE", TIME, False), shapes.ShapeColumn("DELETED_AT", TIME),
], ["ORDER_ID"])


def values(spark, column, *data):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], "x string").select(column(F.col("x"))).collect()]


def test_naming(spark):
    assert values(spark, naming.pascal, "order_items", "CUSTOMER_ID", "product", " ", None) == ["OrderItems", "CustomerId", "Product", "Unknown", "Unknown"]
    assert values(spark, naming.camel, "order_items", "ORDER_DATE") == ["orderItems", "orderDate"]
    assert values(spark, naming.camel_to_upper_snake, "orderId", "firstName", "totalAmount", "status") == ["ORDER_ID", "FIRST_NAME", "TOTAL_AMOUNT", "STATUS"]
    assert values(spark, naming.sanitise, "a b/c-1", None) == ["a_b_c-1", "unknown"]
    assert values(spark, naming.local_name, "http://x#Orders", "http://x/y/Z") == ["Orders", "Z"]
    stamps = spark.createDataFrame([(datetime(2026, 6, 24, 20, 6, 7, 641016),), (datetime(2026, 1, 1, 10),), (datetime(2026, 1, 1, 10, 0, 0, 5000),)], "t timestamp")
    assert [r[0] for r in stamps.select(naming.iso_instant(F.col("t"))).collect()] == ["2026-06-24T20:06:07.641016Z", "2026-01-01T10:00:00Z", "2026-01-01T10:00:00.005Z"]
    assert stamps.select(naming.iri_timestamp(F.col("t"))).first()[0] == "2026-06-24_20-06-07-641"


def test_types(spark):
    pairs = {"VARCHAR": "string", "varchar(255)": "string", "VARIANT": "string", "UNKNOWN_TYPE": "string", "INTEGER": "integer", "BIGINT": "long", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "dateTime", "TIMESTAMP_NTZ": "dateTime", "TIMESTAMP_TZ": "dateTimeStamp", "NUMERIC(10,2)": "decimal", "NUMBER": "decimal", "FLOAT": "float", "CHAR(1)": "string", "": "string", "  ": "string", None: "string"}
    assert values(spark, xsd.to_xsd, *pairs) == [naming.XSD + x for x in pairs.values()]
    assert values(spark, lambda c: xsd.to_sql(c, "POSTGRESQL"), naming.XSD + "byte", naming.XSD + "decimal", "x", None) == ["SMALLINT", "NUMERIC", "VARCHAR", "VARCHAR"]
    assert values(spark, xsd.for_diff, "varchar(20)", None) == ["VARCHAR", ""] and values(spark, xsd.parse_int, " 7 ", "x", None) == [7, None, None]


def request(**parts):
    return filters.Request.parse({"tableName": "Orders", **parts})


def test_filter_text_of_every_operator():
    cases = {
        "EQ": ("STATUS", ["A"], '"STATUS" = :STATUS_0'), "NEQ": ("STATUS", ["A"], '"STATUS" != :STATUS_0'), "GT": ("TOTAL_AMOUNT", ["1"], '"TOTAL_AMOUNT" > :TOTAL_AMOUNT_0'), "GTE": ("TOTAL_AMOUNT", ["1"], '"TOTAL_AMOUNT" >= :TOTAL_AMOUNT_0'),
        "LT": ("TOTAL_AMOUNT", ["1"], '"TOTAL_AMOUNT" < :TOTAL_AMOUNT_0'), "LTE": ("TOTAL_AMOUNT", ["1"], '"TOTAL_AMOUNT" <= :TOTAL_AMOUNT_0'), "LIKE": ("STATUS", ["A%"], '"STATUS" LIKE :STATUS_0'), "NOT_LIKE": ("STATUS", ["A%"], '"STATUS" NOT LIKE :STATUS_0'),
        "ILIKE": ("STATUS", ["a%"], 'LOWER("STATUS") LIKE LOWER(:STATUS_0)'), "IN": ("STATUS", ["A", "B"], '"STATUS" IN (:STATUS_0_0, :STATUS_0_1)'), "NOT_IN": ("STATUS", ["A"], '"STATUS" NOT IN (:STATUS_0_0)'),
        "BETWEEN": ("TOTAL_AMOUNT", ["1", "2"], '"TOTAL_AMOUNT" BETWEEN :TOTAL_AMOUNT_0 AND :TOTAL_AMOUNT_0_TO'), "NOT_BETWEEN": ("TOTAL_AMOUNT", ["1", "2"], '"TOTAL_AMOUNT" NOT BETWEEN :TOTAL_AMOUNT_0 AND :TOTAL_AMOUNT_0_TO'),
        "IS_NULL": ("DELETED_AT", [], '"DELETED_AT" IS NULL'), "IS_NOT_NULL": ("DELETED_AT", [], '"DELETED_AT" IS NOT NULL'),
    }
    assert set(cases) == {o.name for o in filters.Op}
    for op, (column, vals, text) in cases.items():
        got = sqltext.filter_select(request(selectColumns=["order_id"], filterGroup=Q._one(column.lower(), op, *vals)), ORDERS)
        assert got.sql == f'SELECT\n    "ORDER_ID"\nFROM "Orders"\nWHERE {text};', op
        assert len(got.params) == len(vals)
    assert "ILIKE :STATUS_0" in sqltext.filter_select(request(dialect="POSTGRESQL", filterGroup=Q._one("STATUS", "ILIKE", "a")), ORDERS).sql
    assert "WHERE STATUS = :STATUS_0" in sqltext.filter_select(request(dialect="SNOWFLAKE", filterGroup=Q._one("STATUS", "EQ", "a")), ORDERS).sql


def test_filter_text_of_groups_order_and_limits():
    tree = {"operator": "OR", "criteria": [{"column": "STATUS", "operator": "EQ", "value": "A"}], "groups": [{"operator": "AND", "criteria": [{"column": "TOTAL_AMOUNT", "operator": "GTE", "value": "1"}, {"column": "DELETED_AT", "operator": "IS_NULL"}]}, {"criteria": []}]}
    got = sqltext.filter_select(request(selectColumns=["STATUS"], filterGroup=tree, orderBy=[{"column": "status", "direction": "DESC"}], limit=5, offset=0), ORDERS)
    assert got.sql == 'SELECT\n    "STATUS"\nFROM "Orders"\nWHERE (\n  "STATUS" = :STATUS_0\n  OR (\n  "TOTAL_AMOUNT" >= :TOTAL_AMOUNT_1\n  AND "DELETED_AT" IS NULL\n)\n)\nORDER BY "STATUS" DESC\nLIMIT 5;'
    assert got.params == ["STATUS_0", "TOTAL_AMOUNT_1"]
    assert "WHERE" not in sqltext.filter_select(request(filterGroup={"criteria": [], "groups": [{"criteria": []}]}), ORDERS).sql
    assert sqltext.filter_select(request(offset=3), ORDERS).sql.endswith("\nOFFSET 3;")


def test_validation_collects_all_errors():
    tree = {"criteria": [{"column": "NOPE", "operator": "EQ", "value": "1"}, {"column": "STATUS", "operator": "GT", "value": " "}, {"column": "TOTAL_AMOUNT", "operator": "LIKE", "value": "1"}, {"column": "STATUS", "operator": "IN"}, {"column": "TOTAL_AMOUNT", "operator": "BETWEEN"}, {"column": "ORDER_DATE", "operator": "IS_NULL"}]}
    with pytest.raises(filters.FilterError) as e:
        filters.validate(request(selectColumns=["X"], filterGroup=tree, orderBy=[{"column": "Y"}]), ORDERS)
    assert e.value.errors == [
        "SELECT column 'X' does not exist in shape for table 'Orders'", "Filter column 'NOPE' does not exist in the shape",
        "Operator GT on column 'STATUS' requires a non-null 'value'", "Operator GT on column 'STATUS' requires a numeric or date/time column, but column type is xsd:string",
        "Operator LIKE on column 'TOTAL_AMOUNT' requires a string (xsd:string) column, but column type is xsd:decimal", "Operator IN on column 'STATUS' requires a non-empty 'values' list",
        "Operator BETWEEN on column 'TOTAL_AMOUNT' requires 'value' (lower bound)", "Operator BETWEEN on column 'TOTAL_AMOUNT' requires 'valueTo' (upper bound)",
        "Operator IS_NULL on column 'ORDER_DATE' is always false — the column is declared NOT NULL in the shape", "ORDER BY column 'Y' does not exist in shape for table 'Orders'",
    ]
    assert str(e.value).startswith("Filter validation failed: SELECT column")
    filters.validate(request(filterGroup=Q._one("CUSTOMER_ID", "LIKE", "1%")), ORDERS)  # a foreign key's type is not known
    filters.validate(request(filterGroup=Q._one("ORDER_ID", "IS_NOT_NULL")), ORDERS)
    with pytest.raises(LookupError, match=r"No SHACL shape found for table 'T'. Available tables: \[Orders\]"):
        filters.resolve("T", [ORDERS])
    with pytest.raises(filters.FilterError):
        request(limit=0)


def test_random_filters_agree_with_their_text(spark):
    """A compiled condition and its rendered text, run by DuckDB, select the same rows."""
    frames = Q.harvest(spark, SF, ["orders"])
    shape, df = shapes.shape_tables(frames)[0], Q.table(spark, SF, "orders")
    con, r = duckdb.connect(), random.Random(5)
    con.execute(f"create view \"Orders\" as select * from '{SF}/orders.parquet'")
    pick = {"o_orderstatus": ["F", "O", "P"], "o_totalprice": ["1000", "90000.5", "250000"], "o_custkey": ["5", "70"], "o_orderdate": ["1996-01-01", "1999-06-30"], "o_orderpriority": ["1%", "%LOW", "5-LOW"]}

    def criterion():
        c = r.choice(list(pick))
        text = c in ("o_orderstatus", "o_orderpriority")
        op = r.choice(["EQ", "NEQ", "IN", "NOT_IN", "IS_NOT_NULL"] + (["LIKE", "NOT_LIKE", "ILIKE"] if text else ["GT", "LTE", "BETWEEN", "NOT_BETWEEN"]))
        return Q._one(c, op, *sorted(r.choices(pick[c], k=2))[: 1 if op not in ("IN", "NOT_IN", "BETWEEN", "NOT_BETWEEN") else 2])["criteria"][0]

    def group(depth):
        return {"operator": r.choice(["AND", "OR"]), "criteria": [criterion() for _ in range(r.randint(1, 2))], "groups": [group(depth - 1)] if depth and r.random() < 0.7 else []}

    for _ in range(12):
        req = filters.Request.parse({"tableName": "orders", "selectColumns": ["o_orderkey"], "filterGroup": group(2)})
        sql = sqltext.filter_select(req, shape)
        text = sql.sql.replace(":", "$")
        got = sorted(x[0] for x in filters.run(req, df, shape).collect())
        assert got == sorted(x[0] for x in con.execute(text.rstrip(";"), sqltext.bind_values(req)).fetchall()), text


def test_bad_values_are_request_errors(spark):
    shape = shapes.shape_tables(Q.harvest(spark, SF, ["orders"]))[0]
    req = filters.Request.parse({"tableName": "orders", "filterGroup": Q._one("o_totalprice", "GT", "abc")})
    with pytest.raises(filters.FilterError, match="Value 'abc'"):
        filters.run(req, Q.table(spark, SF, "orders"), shape)


def test_filters_reach_the_scan(spark):
    plan = Q._request("orders", selectColumns=["o_orderkey"], filterGroup=Q._one("o_orderstatus", "IN", "F", "P"))(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus" in plan and "o_totalprice" not in plan


def test_sql_statements():
    made = {k: sqltext.statement(k, ORDERS, "POSTGRESQL") for k in sqltext.KINDS}
    assert made["CREATE_TABLE"].sql.splitlines()[1:5] == ['    "ORDER_ID" BIGINT NOT NULL,', '    "CUSTOMER_ID" BIGINT NOT NULL,', '    "STATUS" VARCHAR(50) NOT NULL,', '    "TOTAL_AMOUNT" NUMERIC,']
    assert made["CREATE_TABLE"].sql.endswith('    CONSTRAINT pk_Orders PRIMARY KEY ("ORDER_ID"),\n    CONSTRAINT fk_Orders_Customers FOREIGN KEY ("CUSTOMER_ID") REFERENCES "Customers" ("CUSTOMER_ID")\n);')
    assert made["SELECT_BY_PK"].sql.endswith('FROM "Orders"\nWHERE "ORDER_ID" = :ORDER_ID;') and made["SELECT_BY_PK"].params == ["ORDER_ID"]
    assert made["UPDATE_BY_PK"].params[-1] == "ORDER_ID" and made["UPDATE_BY_PK"].sql.startswith('UPDATE "Orders" SET\n    "CUSTOMER_ID" = :CUSTOMER_ID,')
    assert made["DELETE_BY_PK"].sql == 'DELETE FROM "Orders"\nWHERE "ORDER_ID" = :ORDER_ID;' and made["INSERT"].params == [c.name for c in ORDERS.columns]
    bare = shapes.ShapeTable("UnkeyedTable", [shapes.ShapeColumn("COL_A", STRING)])
    assert "/* no primary key defined */" in sqltext.statement("SELECT_BY_PK", bare).sql and "DELETE ALL" in sqltext.statement("DELETE_BY_PK", bare).sql
    keyed = shapes.ShapeTable("K", [shapes.ShapeColumn("A", LONG)], ["A"])
    assert sqltext.statement("UPDATE_BY_PK", keyed).sql == "-- No updatable columns for table K"
    assert list(sqltext.statements([ORDERS, bare], ["INSERT", "SELECT_ALL"], include=["orders"])) == ["Orders"]
    assert sqltext.quote('a"b', "ANSI") == '"a""b"' and sqltext.quote("a", "SNOWFLAKE") == "a"


def test_statements_without_a_key_are_refused(spark):
    bare = shapes.ShapeTable("T", [shapes.ShapeColumn("A", LONG)])
    for f in (statements.select_by_pk, statements.delete_by_pk):
        with pytest.raises(ValueError, match="no primary key"):
            f(spark.range(1), bare, {})


def test_evolution(spark):
    got = diff(Q.fixture(spark, 2), Q.fixture(spark, 3)).orderBy("change_no").collect()
    assert [r["change_type"] for r in got] == ["COLUMN_DROPPED", "COLUMN_ADDED", "COLUMN_LENGTH_CHANGED"]
    assert got[1]["description"] == "Column 'ORDERS.NOTES' was added (VARCHAR, nullable)"
    assert diff(None, Q.fixture(spark, 1)).count() == 0
    old = build(spark, {"snapshot_id": "a", "tables": [{"name": "t", "columns": [{"name": "A", "type": "INT"}, {"name": "b", "type": "VARCHAR(10)", "nullable": False}], "primary_key": ["A"], "foreign_keys": [{"name": "f1", "column": "A", "pk_table": "x", "pk_column": "i"}, {"name": None, "column": "b", "pk_table": "x", "pk_column": "j"}]}, {"name": "gone"}]})
    new = build(spark, {"snapshot_id": "b", "tables": [{"name": "T", "columns": [{"name": "a", "type": "BIGINT"}, {"name": "B", "type": "varchar(20)"}], "primary_key": ["B", "a"], "foreign_keys": [{"name": "f2", "column": "A", "pk_table": "x", "pk_column": "i"}, {"name": None, "column": "b", "pk_table": "x", "pk_column": "j"}]}, {"name": "fresh"}]})
    kinds = [(r["change_type"], r["table_name"], r["column_name"], r["previous_value"], r["new_value"]) for r in diff(old, new).orderBy("change_no").collect()]
    assert kinds == [("TABLE_ADDED", "FRESH", None, None, None), ("TABLE_DROPPED", "GONE", None, None, None), ("COLUMN_TYPE_CHANGED", "T", "a", "INT", "BIGINT"), ("COLUMN_NULLABILITY_CHANGED", "T", "B", "false", "true"), ("PRIMARY_KEY_CHANGED", "T", None, None, None), ("FOREIGN_KEY_ADDED", "T", "A", None, "x.i"), ("FOREIGN_KEY_DROPPED", "T", "A", "x.i", None)]


def test_registry(spark, tmp_path):
    reg = versions.Registry(spark, f"file://{tmp_path}/reg")
    assert reg.latest_shapes("EVOLUTION_DB", "EVOLUTION_SCHEMA").count() == 0
    names = [reg.register(Q.fixture(spark, v)) for v in (1, 2, 3)]
    assert [r["snapshot_id"] for r in reg.history("EVOLUTION_DB", "EVOLUTION_SCHEMA").collect()] == ["v3", "v2", "v1"]
    assert reg.latest_shapes(None, "EVOLUTION_SCHEMA").count() == 125 and reg.graph(names[0]).count() == 86
    assert len(versions.token()) == 22
    assert reg.history("OTHER", "EVOLUTION_SCHEMA").count() == 0
    store = versions.VersionStore(spark, f"file://{tmp_path}/store")
    assert store.save(Q.fixture(spark, 1), diff(None, Q.fixture(spark, 1))) == 1
    assert store.save(Q.fixture(spark, 2), diff(Q.fixture(spark, 1), Q.fixture(spark, 2))) == 2
    flags = store.registry_graph("EVOLUTION_DB", "EVOLUTION_SCHEMA").where(F.col("p") == naming.DR + "isCurrent").orderBy("s").collect()
    assert [r["o"] for r in flags] == ["false", "true"]
    assert store.changes_graph("EVOLUTION_DB", "EVOLUTION_SCHEMA", 2).where(F.col("p") == naming.DR + "changeType").count() == 2
    assert store.snapshot_graph("EVOLUTION_DB", "EVOLUTION_SCHEMA", 1).count() == 2 * 3 + 8 * 8 + 4


def test_shapes_of_the_retail_schema(spark):
    """233 statements: four tables, twenty columns, three foreign keys, two checks, a unique key and an index for each primary key."""
    n = lambda name, kind, **more: {"name": name, "type": kind, "nullable": False, **more}
    tables = [
        {"name": "CUSTOMERS", "columns": [n("CUSTOMER_ID", "BIGINT"), n("FIRST_NAME", "VARCHAR", length=100), n("LAST_NAME", "VARCHAR", length=100), n("EMAIL", "VARCHAR", length=255), n("PHONE", "VARCHAR", length=20, nullable=True), n("CREATED_AT", "TIMESTAMP")], "primary_key": ["CUSTOMER_ID"], "uniques": [("PRIMARY_KEY_6", ["CUSTOMER_ID"]), ("UQ", ["EMAIL"])]},
        {"name": "PRODUCTS", "columns": [n("PRODUCT_ID", "BIGINT"), n("PRODUCT_NAME", "VARCHAR", length=200), n("PRICE", "DECIMAL"), n("STOCK_QTY", "INTEGER")], "uniques": [("PRIMARY_KEY_7", ["PRODUCT_ID"])], "checks": [("CHK_PRICE", "PRICE >= 0 */"), ("CHK_STOCK", "STOCK_QTY >= 0")]},
        {"name": "ORDERS", "columns": [n("ORDER_ID", "BIGINT"), n("CUSTOMER_ID", "BIGINT"), n("ORDER_DATE", "TIMESTAMP"), n("STATUS", "VARCHAR", length=50), n("TOTAL_AMOUNT", "DECIMAL", nullable=True)], "foreign_keys": [{"name": "FK1", "column": "CUSTOMER_ID", "pk_table": "CUSTOMERS", "pk_column": "CUSTOMER_ID"}], "uniques": [("PRIMARY_KEY_8", ["ORDER_ID"])]},
        {"name": "ORDER_ITEMS", "columns": [n("ORDER_ITEM_ID", "BIGINT"), n("ORDER_ID", "BIGINT"), n("PRODUCT_ID", "BIGINT"), n("QUANTITY", "INTEGER"), n("UNIT_PRICE", "DECIMAL")], "foreign_keys": [{"name": "FK2", "column": "ORDER_ID", "pk_table": "ORDERS", "pk_column": "ORDER_ID"}, {"name": "FK3", "column": "PRODUCT_ID", "pk_table": "PRODUCTS", "pk_column": "PRODUCT_ID"}], "uniques": [("PRIMARY_KEY_9", ["ORDER_ITEM_ID"])]},
    ]
    quads = shapes.shape_quads(build(spark, {"snapshot_id": "r", "schema_name": "PUBLIC", "tables": tables}))
    # one unique index more than the two declared keys, as drivers report one for every primary key
    assert quads.count() == 4 * 3 + 20 * 8 + 18 + 6 + 2 * 6 + 5 * 5 == 233
    back = {(r["table_name"], r["column_name"]): r for r in shapes.read_shapes(quads).collect()}
    assert len(back) == 20 and back["Orders", "CUSTOMER_ID"]["referenced_table"] == "Customers" and back["Customers", "EMAIL"]["max_length"] == 255 and back["Customers", "PHONE"]["nullable"]
    assert quads.where(F.col("p") == naming.SH + "select").where(F.col("o").contains("PRICE >= 0 * / */")).count() == 1
    assert {r["kind"] for r in shapes.read_constraints(quads).collect()} == {"CHECK", "UNIQUE"}


def test_serialisers(spark):
    frames = build(spark, {"snapshot_id": "s", "database_type": "POSTGRESQL", "database_name": "D", "schema_name": "S", "extracted_at": datetime(2026, 1, 1), "tables": [{"name": "T", "remarks": 'say "hi"\nand\\nothing\t<&>', "columns": [{"name": "A", "type": "INT", "nullable": False}], "primary_key": ["A"]}]})
    quads = ontology.ontology_quads(frames).drop("kind")
    one = triples.merged(quads, "m").drop("seq")
    read = read_ntriples(ntriples(one))
    columns = ["s", "s_kind", "p", "o", "o_kind", "o_datatype"]
    assert read.select(columns).exceptAll(one.select(columns)).count() == 0 and read.count() == one.count()
    whole = triples.merged(quads, "m")
    tree = ET.fromstring(serialize(whole, Format.RDF_XML))
    assert sum(len(d) for d in tree) == whole.count()
    graph = json.loads(serialize(quads, Format.JSON_LD))
    assert len(graph["@graph"]) == 4 and graph["@context"]["owl"] == naming.OWL
    turtle, trig = serialize(whole, Format.TURTLE), serialize(quads, Format.TRIG)
    assert "a owl:Class ;" in turtle and "\nschema:T " in turtle and trig.count("{\n") == 4 and '"1"^^xsd:nonNegativeInteger' in trig
    assert "owl:hasKey ( schema:T_a )" in turtle and "rdfs:subClassOf [ a owl:Restriction ;" in turtle and "_:" not in turtle and "@prefix owl: <http://www.w3.org/2002/07/owl#> ." in turtle
    assert serialize(whole, Format.N_TRIPLES).count(" .\n") == whole.count() and Format.TRIG.value == ("application/trig", "trig")


def test_catalog_frames(spark):
    """The relational catalog of a database becomes the same frames as a nested description."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = harvest.Catalog(
        df([("A", "TABLE", None), ("B", "VIEW", "r")], "table_name string, table_type string, remarks string"),
        df([("A", "y", "VARCHAR", 2, True, None, 20, None, None), ("A", "x", "INT", 1, False, "0", 10, 0, None), ("B", "z", "INT", 1, True, None, 10, 0, None)], "table_name string, column_name string, data_type string, ordinal_position int, nullable boolean, default_value string, column_size int, numeric_scale int, remarks string"),
        df([("A", 2, "y"), ("A", 1, "x")], "table_name string, key_seq int, column_name string"),
        df([("fk", "A", "x", "B", "z", 0, 9)], "constraint_name string, fk_table string, fk_column string, pk_table string, pk_column string, update_rule int, delete_rule int"),
        df([("A", "u", False, 2, "x"), ("A", "u", False, 1, "y"), ("A", "n", True, 1, "x"), ("A", None, False, 1, "x")], "table_name string, index_name string, non_unique boolean, ordinal_position int, column_name string"),
        df([("s", "c1", "A", "CHECK"), ("s", "c2", "A", "CHECK"), ("s", "k", "A", "PRIMARY KEY")], "constraint_schema string, constraint_name string, table_name string, constraint_type string"),
        df([("s", "c1", "x > 0"), ("s", "c2", "x IS NOT NULL")], "constraint_schema string, constraint_name string, check_clause string"),
    )
    f = harvest.harvest_frames(spark, {"snapshot_id": "s"}, c, ["A"])
    assert [(r["column_name"], r["col_seq"], r["max_length"]) for r in f.columns.orderBy("col_seq").collect()] == [("x", 0, None), ("y", 1, 20)]
    assert harvest.primary_key_lists(f.primary_keys).first()["columns"] == ["x", "y"]
    assert [(r["constraint_name"], r["columns"]) for r in f.uniques.collect()] == [("u", ["y", "x"])] and [r["constraint_name"] for r in f.checks.collect()] == ["c1"]
    fk = f.foreign_keys.first()
    assert (fk["update_rule"], fk["delete_rule"]) == ("CASCADE", "NO_ACTION")
    assert len(f.only(["a"], ignore_case=True).tables.collect()) == 1 and not f.only(["a"], ignore_case=False).tables.collect()
    with pytest.raises(LookupError, match="CATALOG"):
        harvest.harvester("ORACLE")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("seen_view")
    assert "seen_view" in {r["table_name"] for r in harvest.harvest_catalog(spark, "default").tables.collect()}


def test_jdbc_harvest(spark):
    """Tables, keys, unique indexes and referential rules from a driver's own metadata; views that the database lacks are a warning."""
    url, driver = "jdbc:derby:memory:harvest", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    jvm = spark._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    con = jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    for text in (
        "CREATE SCHEMA SHOP", "CREATE SCHEMA SH_P", "CREATE TABLE SHOP.CUSTOMERS (ID BIGINT NOT NULL PRIMARY KEY, EMAIL VARCHAR(255) NOT NULL, PRICE DECIMAL(10,2) DEFAULT 0)",
        "CREATE UNIQUE INDEX SHOP.UQ_EMAIL ON SHOP.CUSTOMERS (EMAIL)", "CREATE TABLE SHOP.ORDERS (A INT NOT NULL, B INT NOT NULL, CUSTOMER_ID BIGINT CONSTRAINT FK_C REFERENCES SHOP.CUSTOMERS ON DELETE CASCADE, PRIMARY KEY (B, A))",
        "CREATE VIEW SHOP.SEEN AS SELECT ID FROM SHOP.CUSTOMERS", "CREATE TABLE SH_P.OTHER (X INT)",
    ):
        con.createStatement().execute(text)
    con.close()
    kinds = connect.Connectors({"DERBY": lambda c, store: {"url": url, "driver": driver}})
    read = lambda schema, include=None: harvest.harvest_jdbc(spark, connect.Connection("DERBY", schema=schema), {"snapshot_id": "s", "schema_name": schema}, include, kinds)
    with pytest.warns(UserWarning, match="CHECK"):
        f = read("SHOP")
    assert [(r["table_name"], r["table_type"]) for r in f.tables.orderBy("table_seq").collect()] == [("CUSTOMERS", "TABLE"), ("ORDERS", "TABLE"), ("SEEN", "VIEW")]
    columns = {(r["table_name"], r["column_name"]): r for r in f.columns.collect()}
    price, email = columns["CUSTOMERS", "PRICE"], columns["CUSTOMERS", "EMAIL"]
    assert (price["data_type"], price["numeric_precision"], price["numeric_scale"], price["default_value"], price["nullable"], price["max_length"]) == ("DECIMAL", 10, 2, "0", True, None)
    assert (email["max_length"], email["nullable"], email["ordinal_position"]) == (255, False, 2) and len(columns) == 7
    assert {r["table_name"]: r["columns"] for r in harvest.primary_key_lists(f.primary_keys).collect()} == {"CUSTOMERS": ["ID"], "ORDERS": ["B", "A"]}
    fk = f.foreign_keys.first()
    assert (fk["constraint_name"], fk["fk_table"], fk["fk_column"], fk["pk_table"], fk["pk_column"], fk["delete_rule"], fk["update_rule"]) == ("FK_C", "ORDERS", "CUSTOMER_ID", "CUSTOMERS", "ID", "CASCADE", "NO_ACTION")
    assert ["EMAIL"] in [r["columns"] for r in f.uniques.collect()] and f.checks.count() == 0
    with pytest.warns(UserWarning):
        assert [r["table_name"] for r in read("SH_P").tables.collect()] == ["OTHER"] and [r["table_name"] for r in read("SHOP", ["ORDERS"]).columns.collect()] == ["ORDERS"] * 3


def test_numbers_of_versions_are_claimed_once(spark, tmp_path):
    store, frames = versions.VersionStore(spark, f"file://{tmp_path}"), Q.fixture(spark, 1)
    assert store._claim("EVOLUTION_DB", "EVOLUTION_SCHEMA", 1) == 1  # another writer, who then breaks off
    changes = diff(None, frames).withColumn("description", F.lit(None).cast("string"))
    assert store.save(frames, changes) == 2 and store._claim("EVOLUTION_DB", "OTHER", 1) == 1
    graph = store.registry_graph("EVOLUTION_DB", "EVOLUTION_SCHEMA")
    assert graph.where(F.col("p") == naming.DR + "previousVersion").count() == 0 and graph.where((F.col("p") == naming.DR + "isCurrent") & (F.col("o") == "true")).count() == 1
    versions.version_quads(Q.fixture(spark, 2), changes, 3).write.mode("append").partitionBy("graph").parquet(f"{store.path}/quads")  # a save that broke off
    assert store.registry_graph("EVOLUTION_DB", "EVOLUTION_SCHEMA").count() == graph.count() and store.versions().count() == 1


def test_connections(tmp_path):
    C = connect.Connection
    options = connect.Connectors().options
    assert options(C("POSTGRESQL", user="u", password="p"))["url"] == "jdbc:postgresql://localhost:5432/postgres"
    assert options(C("POSTGRESQL", user="u", secret="x"), lambda path: {"password": path + "!"})["password"] == "x!"
    snow = options(C("SNOWFLAKE", account="acc.snowflakecomputing.com", database="d", password="p"))
    assert snow["url"] == "jdbc:snowflake://acc.snowflakecomputing.com/" and (snow["db"], snow["schema"]) == ("D", "PUBLIC")
    der = b"\x30\x03abc"
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(der).decode() + "\n-----END PRIVATE KEY-----"
    (tmp_path / "k.pem").write_text(pem)
    (tmp_path / "k.der").write_bytes(der)
    for key in ({"private_key_pem": pem}, {"private_key_path": str(tmp_path / "k.pem")}, {"private_key_path": str(tmp_path / "k.der")}, {"private_key_base64": base64.b64encode(der).decode()}):
        assert connect.load_key(C("SNOWFLAKE", **key)) == der
    assert options(C("SNOWFLAKE", account="a", auth_mode="KEY_PAIR", private_key_pem=pem))["authenticator"] == "snowflake_jwt"
    for bad in (C("ORACLE"), C("SNOWFLAKE", password="p"), C("POSTGRESQL", user="u", password=" "), C("SNOWFLAKE", account="a", auth_mode="KEY_PAIR"), C("SNOWFLAKE", account="a", auth_mode="KEY_PAIR", private_key_pem=pem.replace("PRIVATE", "ENCRYPTED PRIVATE"))):
        with pytest.raises(connect.ConnectionFailure):
            options(bad)
    assert connect.SecretConfig(prefix="/db/").path("x") == "secret/data/db/x"


def test_engine(spark, tmp_path):
    frames = Q.fixture(spark, 2)
    e = Engine(spark, frames, versions.Registry(spark, f"file://{tmp_path}"))
    assert e.ping() == {"status": "OK", "database": "EVOLUTION_DB", "schema": "EVOLUTION_SCHEMA", "tables": 3}
    with pytest.raises(LookupError):
        e.latest("EVOLUTION_DB", "EVOLUTION_SCHEMA")
    out = e.extract(axioms=False)
    assert (out.tables, out.columns, out.foreign_keys, out.warnings) == (3, 12, 1, []) and out.shapes.count("NodeShape") == 3
    assert e.latest("EVOLUTION_DB", "EVOLUTION_SCHEMA").count() == 126 and e.history(None, "EVOLUTION_SCHEMA").count() == 1
    assert "WHERE" in e.filter_sql({"tableName": "CUSTOMERS", "filterGroup": Q._one("EMAIL", "LIKE", "%x")}).sql
    assert set(e.generate_sql()) == {"Customers", "Orders", "Products"} and e.diff(Q.fixture(spark, 1)).count() == 2
    with pytest.raises(LookupError, match="merged"):
        e.graph("none")


def test_stream_of_snapshots(spark, tmp_path):
    rows = [[("T", "a", "INT", True, None), ("T", "b", "VARCHAR", True, 10)], [("T", "b", "VARCHAR", True, 20), ("T", "c", "INT", False, None)]]
    for day, held in enumerate(rows, 1):
        lines = [json.dumps({"database_name": "d", "schema_name": "s", "extracted_at": f"2026-01-0{day}T00:00:00", "table_name": t, "column_name": c, "data_type": k, "nullable": n, "max_length": m}) for t, c, k, n, m in held]
        (tmp_path / "feed").mkdir(exist_ok=True)
        (tmp_path / "feed" / f"{day}.json").write_text("\n".join(lines))
        snapshots.follow(snapshots.read_feed(spark, str(tmp_path / "feed")), str(tmp_path / "state"), str(tmp_path / "changes"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["batch"], r["column_name"], r["change_type"]) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert got == {(0, "a", "COLUMN_ADDED"), (0, "b", "COLUMN_ADDED"), (1, "a", "COLUMN_DROPPED"), (1, "b", "COLUMN_LENGTH_CHANGED"), (1, "c", "COLUMN_ADDED")}


def test_orphans_are_the_rows_without_a_target(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 15)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 1), (7, 1), (14, 2), (98, 1), (99, 3), (None, 1)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, Q.QUERIES["fk_orphans"](spark, str(tmp_path)).collect())) == [(98, 1), (99, 3)]


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in Q.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_entry_works_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'filter_eq' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_values_outside_the_enums_are_errors_of_the_request():
    tree = {"operator": "and", "criteria": [{"column": "STATUS", "operator": "SOUNDS_LIKE", "value": "A"}, {"operator": "EQ"}], "groups": [{"operator": "XOR"}]}
    with pytest.raises(filters.FilterError) as e:
        request(filterGroup=tree, orderBy=[{"column": "STATUS", "direction": "desc"}, {}], limit=0, dialect="ORACLE")
    for part in ("'and'", "'XOR'", "'SOUNDS_LIKE'", "'column'", "'desc'", "ORDER BY", "limit", "'ORACLE'"):
        assert any(part in x for x in e.value.errors), part
    assert request(filterGroup={"operator": None, "criteria": []}, orderBy=[{"column": "STATUS", "direction": None}]).order_by == [("STATUS", "ASC")]


@pytest.mark.parametrize("name", ["MY_DB", "My DB", "my.db-1"])
def test_version_graphs_are_read_under_the_name_they_are_written_under(spark, tmp_path, name):
    store = versions.VersionStore(spark, f"file://{tmp_path}/store")
    frames = build(spark, {"snapshot_id": "s", "database_type": "POSTGRESQL", "database_name": name, "schema_name": "a b.c", "extracted_at": datetime(2026, 1, 1), "tables": [{"name": "T", "columns": [{"name": "ID", "type": "BIGINT"}]}]})
    none = diff(frames, frames)
    assert store.save(frames, none) == 1 and store.save(frames, none) == 2
    assert store.snapshot_graph(name, "a b.c", 2).count() > 0
    current = {r["s"][-1]: r["o"] for r in store.registry_graph(name, "a b.c").where(F.col("p").endswith("isCurrent")).collect()}
    assert current == {"1": "false", "2": "true"}
