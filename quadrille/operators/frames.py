"""A harvested schema as seven DataFrames, keyed by snapshot."""

from __future__ import annotations

from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMAS = {
    "snapshots": "snapshot_id string, database_type string, database_name string, schema_name string, host string, port int, jdbc_url string, warehouse string, role string, auth_mode string, extracted_at timestamp",
    "tables": "snapshot_id string, table_seq int, table_name string, table_type string, remarks string",
    "columns": "snapshot_id string, table_seq int, table_name string, col_seq int, column_name string, data_type string, ordinal_position int, nullable boolean, default_value string, max_length int, numeric_precision int, numeric_scale int, remarks string",
    "primary_keys": "snapshot_id string, table_name string, key_seq int, column_name string",
    "foreign_keys": "snapshot_id string, fk_seq int, constraint_name string, fk_table string, fk_column string, pk_table string, pk_column string, update_rule string, delete_rule string",
    "uniques": "snapshot_id string, table_name string, uq_seq int, constraint_name string, columns array<string>",
    "checks": "snapshot_id string, table_name string, ck_seq int, constraint_name string, check_clause string",
}


@dataclass
class SnapshotFrames:
    snapshots: DataFrame
    tables: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame
    uniques: DataFrame
    checks: DataFrame

    def of(self, snapshot_id: str) -> SnapshotFrames:
        return SnapshotFrames(**{f.name: getattr(self, f.name).where(F.col("snapshot_id") == snapshot_id) for f in fields(self)})

    def union(self, other: SnapshotFrames) -> SnapshotFrames:
        return SnapshotFrames(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})

    def only(self, names: list[str], ignore_case: bool) -> SnapshotFrames:
        """The tables of an include list; harvests compare names exactly, SQL generation ignores their case."""
        if not names:
            return self
        wanted = [n.upper() for n in names] if ignore_case else names
        key = {"foreign_keys": "fk_table", "snapshots": None}
        out = {}
        for f in fields(self):
            df, column = getattr(self, f.name), key.get(f.name, "table_name")
            name = F.upper(column) if column and ignore_case else column and F.col(column)
            out[f.name] = df if column is None else df.where(name.isin(wanted))
        return SnapshotFrames(**out)

    def counts(self) -> DataFrame:
        """Tables, columns and foreign keys of each snapshot."""
        by = lambda df, name: df.groupBy("snapshot_id").agg(F.count("*").alias(name))
        out = self.snapshots.select("snapshot_id")
        for df, name in ((self.tables, "table_count"), (self.columns, "column_count"), (self.foreign_keys, "fk_count")):
            out = out.join(by(df, name), "snapshot_id", "left")
        return out.na.fill(0)

    def without_columns(self) -> DataFrame:
        """Tables that have no column: what a harvest warns about."""
        return self.tables.join(self.columns, ["snapshot_id", "table_name"], "left_anti")


def with_keys(frames: SnapshotFrames) -> DataFrame:
    """The columns with primary_key, the first foreign key of each (by name, ignoring case) and whether its table is known."""
    pk = frames.primary_keys.select("snapshot_id", "table_name", "column_name", F.lit(True).alias("primary_key")).distinct()
    fk = frames.foreign_keys.groupBy("snapshot_id", F.col("fk_table").alias("table_name"), F.upper("fk_column").alias("fk_upper")).agg(F.min_by(F.struct("constraint_name", "pk_table", "pk_column", "update_rule", "delete_rule"), "fk_seq").alias("fk"))
    out = frames.columns.join(pk, ["snapshot_id", "table_name", "column_name"], "left").withColumn("fk_upper", F.upper("column_name"))
    out = out.join(fk, ["snapshot_id", "table_name", "fk_upper"], "left").drop("fk_upper")
    return out.withColumn("primary_key", F.coalesce("primary_key", F.lit(False))).withColumn("is_fk", F.col("fk").isNotNull())


def build(spark: SparkSession, snapshot: dict) -> SnapshotFrames:
    """Frames of one snapshot given as nested dicts: its own fields, and `tables` with columns and constraints."""
    key = snapshot["snapshot_id"]
    rows: dict[str, list] = {k: [] for k in SCHEMAS}
    names = [x.split()[0] for x in SCHEMAS["snapshots"].split(", ")]
    rows["snapshots"].append(tuple(snapshot.get(n) for n in names))
    fk_seq = 0
    for t, table in enumerate(snapshot.get("tables", [])):
        name = table["name"]
        rows["tables"].append((key, t, name, table.get("type", "TABLE"), table.get("remarks")))
        for c, col in enumerate(table.get("columns", [])):
            rows["columns"].append((key, t, name, c, col["name"], col.get("type"), col.get("ordinal", c + 1), col.get("nullable", True), col.get("default"), col.get("length"), col.get("precision"), col.get("scale"), col.get("remarks")))
        for k, col in enumerate(table.get("primary_key", [])):
            rows["primary_keys"].append((key, name, k + 1, col))
        for fk in table.get("foreign_keys", []):
            rows["foreign_keys"].append((key, fk_seq, fk.get("name"), name, fk["column"], fk["pk_table"], fk["pk_column"], fk.get("update", "NO_ACTION"), fk.get("delete", "NO_ACTION")))
            fk_seq += 1
        for u, (constraint, columns) in enumerate(table.get("uniques", [])):
            rows["uniques"].append((key, name, u, constraint, columns))
        for k, (constraint, clause) in enumerate(table.get("checks", [])):
            rows["checks"].append((key, name, k, constraint, clause))
    return SnapshotFrames(**{k: local(spark, v, SCHEMAS[k]) for k, v in rows.items()})


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, which plans read without a task of their own."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)
