"""Harvests: the schema of Parquet folders, catalog databases and JDBC databases as SnapshotFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VarcharType

from quadrille.functions.xsd import rule_name
from quadrille.operators.frames import SCHEMAS, SnapshotFrames, build, local
from quadrille.sources.connect import Connection, Connectors, normalised


@dataclass
class Declared:
    """Constraints that a source without a constraint catalog is said to have, by table."""

    primary_keys: dict[str, list[str]] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str, str, str]] = field(default_factory=list)  # name, table, column, target table, target column
    uniques: dict[str, list[tuple[str, list[str]]]] = field(default_factory=dict)
    checks: dict[str, list[tuple[str, str]]] = field(default_factory=dict)


def table_from_schema(name: str, schema: StructType, declared: Declared, kind: str = "TABLE") -> dict:
    """A table's metadata from its Spark schema; lengths are those of strings alone."""
    columns = []
    for f in schema.fields:
        t = f.dataType
        decimal = t.typeName() == "decimal"
        columns.append({"name": f.name, "type": t.simpleString().upper(), "nullable": f.nullable, "length": t.length if isinstance(t, VarcharType) else None, "precision": t.precision if decimal else None, "scale": t.scale if decimal else None, "remarks": (f.metadata or {}).get("comment")})
    fks = [{"name": n, "column": c, "pk_table": pt, "pk_column": pc} for n, t, c, pt, pc in declared.foreign_keys if t == name]
    return {"name": name, "type": kind, "columns": columns, "primary_key": declared.primary_keys.get(name, []), "foreign_keys": fks, "uniques": declared.uniques.get(name, []), "checks": declared.checks.get(name, [])}


def harvest_parquet(spark: SparkSession, folder: str, names: list[str], declared: Declared | None = None, snapshot: dict | None = None, include: list[str] | None = None) -> SnapshotFrames:
    """Tables <folder>/<name>.parquet: only footers of those that the include list names (exactly) are read."""
    wanted = [n for n in names if not include or n in include]
    tables = [table_from_schema(n, spark.read.parquet(f"{folder}/{n}.parquet").schema, declared or Declared()) for n in wanted]
    head = {"snapshot_id": "s1", "database_type": "PARQUET", "database_name": folder.rstrip("/").rpartition("/")[2], "schema_name": "public", "extracted_at": datetime(2026, 1, 1)}
    return build(spark, head | (snapshot or {}) | {"tables": tables})


def harvest_catalog(spark: SparkSession, database: str, declared: Declared | None = None, snapshot: dict | None = None, include: list[str] | None = None) -> SnapshotFrames:
    """Tables and views of a database of the session's catalog."""
    found = [t for t in spark.catalog.listTables(database) if not include or t.name in include]
    tables = [table_from_schema(t.name, spark.table(t.name if t.isTemporary else f"{database}.{t.name}").schema, declared or Declared(), "VIEW" if "VIEW" in t.tableType.upper() or t.isTemporary else "TABLE") for t in found]
    head = {"snapshot_id": "s1", "database_type": "CATALOG", "database_name": None, "schema_name": database, "extracted_at": datetime(2026, 1, 1)}
    return build(spark, head | (snapshot or {}) | {"tables": tables})


@dataclass
class Catalog:
    """The catalog tables of a database as DataFrames, however they were read."""

    tables: DataFrame  # table_name, table_type, remarks
    columns: DataFrame  # table_name, column_name, data_type, ordinal_position, nullable, default_value, column_size, numeric_scale, remarks
    primary_keys: DataFrame  # table_name, key_seq, column_name
    imported_keys: DataFrame  # constraint_name, fk_table, fk_column, pk_table, pk_column, update_rule (code), delete_rule (code)
    indexes: DataFrame  # table_name, index_name, non_unique, ordinal_position, column_name
    table_constraints: DataFrame | None = None  # constraint_schema, constraint_name, table_name, constraint_type
    check_constraints: DataFrame | None = None  # constraint_schema, constraint_name, check_clause


def primary_key_lists(keys: DataFrame) -> DataFrame:
    """The columns of each primary key in the order of key_seq."""
    return keys.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("key_seq", "column_name"))), lambda x: x["column_name"]).alias("columns"))


def unique_indexes(indexes: DataFrame) -> DataFrame:
    """Unique indexes with a name, and their columns in order; a primary key's own index is one of them."""
    return indexes.where(~F.col("non_unique") & F.col("index_name").isNotNull()).groupBy("table_name", "index_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))), lambda x: x["column_name"]).alias("columns"))


def check_rows(constraints: DataFrame, checks: DataFrame, without_not_null: bool = True) -> DataFrame:
    """CHECK clauses of tables: an equi-join on schema and name; PostgreSQL's NOT NULL checks are left out."""
    found = constraints.where(F.col("constraint_type") == "CHECK").join(checks, ["constraint_schema", "constraint_name"])
    if without_not_null:
        found = found.where(~F.col("check_clause").like("%IS NOT NULL"))
    return found.select("table_name", "constraint_name", "check_clause")


def string_length(data_type: Column, size: Column) -> Column:
    """The reported column size as a length, for string types only."""
    from quadrille.functions.xsd import is_string_type

    return F.when(is_string_type(data_type), size)


def harvest_frames(spark: SparkSession, snapshot: dict, c: Catalog, include: list[str] | None = None, without_not_null: bool = True) -> SnapshotFrames:
    """Frames from catalog tables, all as DataFrame plans; an include list is applied before anything is joined."""
    from pyspark.sql import Window

    key = F.lit(snapshot["snapshot_id"])
    seq = lambda *by, part=None: (F.row_number().over((Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(*by)) - 1).cast("int")
    tables = c.tables.where(F.col("table_name").isin(include)) if include else c.tables
    tables = tables.select(key.alias("snapshot_id"), seq("table_name").alias("table_seq"), "table_name", "table_type", "remarks")
    mine = tables.select("table_name", "table_seq")
    columns = c.columns.join(mine, "table_name").select(key.alias("snapshot_id"), "table_seq", "table_name", seq("ordinal_position", part=["table_name"]).alias("col_seq"), "column_name", "data_type", F.col("ordinal_position").cast("int"), "nullable", "default_value", string_length(F.col("data_type"), F.col("column_size")).cast("int").alias("max_length"), F.col("column_size").cast("int").alias("numeric_precision"), F.col("numeric_scale").cast("int"), "remarks")
    pks = c.primary_keys.join(mine, "table_name").select(key.alias("snapshot_id"), "table_name", F.col("key_seq").cast("int"), "column_name")
    fks = c.imported_keys.join(mine.withColumnRenamed("table_name", "fk_table"), "fk_table").select(key.alias("snapshot_id"), seq("table_seq", "constraint_name", "fk_column").alias("fk_seq"), "constraint_name", "fk_table", "fk_column", "pk_table", "pk_column", rule_name(F.col("update_rule")).alias("update_rule"), rule_name(F.col("delete_rule")).alias("delete_rule"))
    uniques = unique_indexes(c.indexes).join(mine, "table_name").select(key.alias("snapshot_id"), "table_name", seq("index_name", part=["table_name"]).alias("uq_seq"), F.col("index_name").alias("constraint_name"), "columns")
    if c.check_constraints is None or c.table_constraints is None:
        checks = spark.createDataFrame([], SCHEMAS["checks"])
    else:
        checks = check_rows(c.table_constraints, c.check_constraints, without_not_null).join(mine, "table_name").select(key.alias("snapshot_id"), "table_name", seq("constraint_name", part=["table_name"]).alias("ck_seq"), "constraint_name", "check_clause")
    return SnapshotFrames(build(spark, snapshot | {"tables": []}).snapshots, tables, columns, pks, fks, uniques, checks)


# Columns of a driver's metadata by the part of the catalog that they fill, and the kind of each.
_METADATA = {
    "tables": ("table_name string, table_type string, remarks string", ["TABLE_NAME", "TABLE_TYPE", "REMARKS"]),
    "columns": ("table_name string, column_name string, data_type string, ordinal_position int, nullable boolean, default_value string, column_size int, numeric_scale int, remarks string", ["TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "ORDINAL_POSITION", "NULLABLE", "COLUMN_DEF", "COLUMN_SIZE", "DECIMAL_DIGITS", "REMARKS"]),
    "primary_keys": ("table_name string, key_seq int, column_name string", ["TABLE_NAME", "KEY_SEQ", "COLUMN_NAME"]),
    "imported_keys": ("constraint_name string, fk_table string, fk_column string, pk_table string, pk_column string, update_rule int, delete_rule int", ["FK_NAME", "FKTABLE_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME", "UPDATE_RULE", "DELETE_RULE"]),
    "indexes": ("table_name string, index_name string, non_unique boolean, ordinal_position int, column_name string", ["TABLE_NAME", "INDEX_NAME", "NON_UNIQUE", "ORDINAL_POSITION", "COLUMN_NAME"]),
}


def _rows(found, part: str, schema: str, schema_column: str) -> list[tuple]:
    """The rows of a metadata result that belong to the schema; its name was a pattern to the driver."""
    kinds = [x.rpartition(" ")[2] for x in _METADATA[part][0].split(", ")]
    out = []
    while found.next():
        if found.getString(schema_column) == schema:
            read = [found.getString(name) for name in _METADATA[part][1]]
            out.append(tuple(x if x is None or k == "string" else int(x) if k == "int" else x.lower() in ("1", "t", "true", "y", "yes") for x, k in zip(read, kinds, strict=True)))
    found.close()
    return out


def jdbc_catalog(spark: SparkSession, options: dict[str, str], database: str | None, schema: str, include: list[str] | None = None) -> Catalog:
    """What a database's driver says of its tables: the same calls for every vendor, remarks and unique indexes included.

    A key or index scan that a driver refuses for a table is a warning, and the rest is kept.
    """
    jvm, held = spark._jvm, {k: [] for k in _METADATA}
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        if k not in ("url", "driver"):
            properties.setProperty(k, v)
    kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 3)
    kinds[0], kinds[1], kinds[2] = "TABLE", "VIEW", "BASE TABLE"
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        meta = connection.getMetaData()
        tables = _rows(meta.getTables(database, schema, "%", kinds), "tables", schema, "TABLE_SCHEM")
        held["tables"] = [(n, "VIEW" if kind == "VIEW" else "TABLE", remarks) for n, kind, remarks in tables if not include or n in include]
        held["columns"] = _rows(meta.getColumns(database, schema, "%", "%"), "columns", schema, "TABLE_SCHEM")
        for name, _, _ in held["tables"]:
            scans = {"primary_keys": lambda: meta.getPrimaryKeys(database, schema, name), "imported_keys": lambda: meta.getImportedKeys(database, schema, name), "indexes": lambda: meta.getIndexInfo(database, schema, name, True, True)}  # noqa: B023
            for part, scan in scans.items():
                try:
                    held[part] += _rows(scan(), part, schema, "FKTABLE_SCHEM" if part == "imported_keys" else "TABLE_SCHEM")
                except Py4JJavaError as e:
                    warnings.warn(f"no {part} of {schema}.{name}: {e.java_exception.getMessage()}", stacklevel=2)
    finally:
        connection.close()
    return Catalog(**{k: local(spark, v, _METADATA[k][0]) for k, v in held.items()})


def harvest_jdbc(spark: SparkSession, c: Connection, snapshot: dict, include: list[str] | None = None, connectors: Connectors | None = None, store=None) -> SnapshotFrames:
    """A database's tables, columns, keys, unique indexes and, where it has the standard views for them, CHECK clauses."""
    options = (connectors or Connectors()).options(c, store)
    c = normalised(c)
    catalog = jdbc_catalog(spark, options, c.database, c.schema, include)
    quoted = c.schema.replace("'", "''")
    read = lambda query: spark.read.format("jdbc").options(**options).option("query", query).load()
    try:
        constraints = read(f"SELECT constraint_schema, constraint_name, table_name, constraint_type FROM information_schema.table_constraints WHERE table_schema = '{quoted}'")
        clauses = read("SELECT constraint_schema, constraint_name, check_clause FROM information_schema.check_constraints")
        lower = lambda df: df.toDF(*[x.lower() for x in df.columns])
        catalog.table_constraints, catalog.check_constraints = lower(constraints), lower(clauses)
    except Py4JJavaError as e:
        warnings.warn(f"no CHECK clauses of {c.schema}: {e.java_exception.getMessage()}", stacklevel=2)
    return harvest_frames(spark, snapshot, catalog, include, without_not_null=c.kind != "SNOWFLAKE")


#: Harvesters by source kind.
HARVESTERS: dict[str, Callable[..., SnapshotFrames]] = {"PARQUET": harvest_parquet, "CATALOG": harvest_catalog, "JDBC": harvest_jdbc}


def harvester(kind: str) -> Callable[..., SnapshotFrames]:
    if kind not in HARVESTERS:
        raise LookupError(f"no harvester for {kind}; available: {', '.join(sorted(HARVESTERS))}")
    return HARVESTERS[kind]
