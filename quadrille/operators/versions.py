"""Registries of snapshots: one keyed by time, one by version number, both as Parquet tables of quads.

Quads are partitioned by graph, so a named graph is read by partition pruning.
Quads are written first and count only once the row that names them is there, so
a registration that breaks off leaves nothing to be seen. A version's number is
claimed by creating a file, which the file system grants to one writer alone;
numbers are never used twice, but one that was claimed in vain is left out.
"""

from __future__ import annotations

import secrets
import string

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import naming as N
from quadrille.functions.naming import DR, RDFS
from quadrille.operators.frames import SCHEMAS, SnapshotFrames
from quadrille.operators.shapes import shape_quads
from quadrille.operators.triples import as_set, emit, iri, lit, type_of, union

QUADS = "snapshot_id string, graph string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, seq array<int>"
RECORDS = SCHEMAS["snapshots"] + ", record string, shapes string, table_count long, column_count long"
VERSIONS = "database_name string, schema_name string, version int, snapshot_id string, extracted_at timestamp, table_count long, column_count long, change_count long"


def token() -> str:
    """22 characters of a base-62 alphabet, about 131 bits; drawn on the driver, never in a plan."""
    return "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(22))


def record_rows(frames: SnapshotFrames, shapes_iri: Column, base: str = N.BASE) -> DataFrame:
    counted = frames.snapshots.join(frames.counts().drop("fk_count"), "snapshot_id")
    return counted.select(*[x.split()[0] for x in SCHEMAS["snapshots"].split(", ")], N.extraction_iri(F.col("database_name"), F.col("schema_name"), F.col("extracted_at"), base).alias("record"), shapes_iri.alias("shapes"), "table_count", "column_count")


def record_quads(records: DataFrame, base: str = N.BASE) -> DataFrame:
    """The default graph's statements about each record, its schema and its repository."""
    c, none = F.col, F.lit(None).cast("string")
    repo, schema = N.stable_iri(c("database_name"), None, base), N.stable_iri(c("database_name"), c("schema_name"), base)
    iso = N.iso_instant(c("extracted_at"))
    label = F.concat(F.lit("Extraction: "), F.coalesce("database_name", F.lit("null")), F.lit("/"), F.coalesce("schema_name", F.lit("null")), F.lit(" @ "), iso)
    return as_set(union(
        emit(records, none, schema, [F.lit(0)], [type_of(DR + "DatabaseSchema"), (DR + "schemaName", lit(c("schema_name"))), (DR + "hasVersion", iri(c("record")))]),
        emit(records, none, repo, [F.lit(1)], [type_of(DR + "DataRepository"), (DR + "databaseName", lit(F.coalesce(c("database_name"), F.lit("")))), (DR + "databaseType", lit(c("database_type"))), (DR + "hasSchema", iri(schema))]),
        emit(records, none, c("record"), [F.lit(2)], [type_of(DR + "ExtractionRecord"), (RDFS + "label", lit(label)), (DR + "forSchema", iri(schema)), (DR + "forRepository", iri(repo)), (DR + "extractedAt", lit(iso, "dateTime")), (DR + "tableCount", lit(c("table_count"), "int")), (DR + "columnCount", lit(c("column_count"), "int")), (DR + "hasShapes", iri(c("shapes")))]),
    ))


def history(records: DataFrame, database: str | None, schema: str) -> DataFrame:
    """Newest first; the newest of equal times is the one with the larger record name."""
    mine = F.col("schema_name") == schema
    if database is not None:
        mine &= F.coalesce("database_name", F.lit("")) == database
    return records.where(mine).orderBy(F.desc_nulls_last("extracted_at"), F.desc("record"))


def latest(records: DataFrame, database: str | None, schema: str) -> DataFrame:
    return history(records, database, schema).limit(1)


def latest_of_each(records: DataFrame) -> DataFrame:
    """The latest record of every schema in one pass."""
    by = Window.partitionBy("database_name", "schema_name").orderBy(F.desc_nulls_last("extracted_at"), F.desc("record"))
    return records.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def next_version(versions: DataFrame, database: str, schema: str) -> DataFrame:
    """One more than the largest number of the schema; 1 if it has none."""
    mine = (F.col("database_name") == database) & (F.col("schema_name") == schema)
    return versions.where(mine).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def with_previous(versions: DataFrame) -> DataFrame:
    """Each version with the number before it and whether it is the current one."""
    by = Window.partitionBy("database_name", "schema_name").orderBy("version")
    return versions.select("*", F.lag("version").over(by).alias("previous_version"), F.lead("version").over(by).isNull().alias("is_current"))


class Registry:
    """Records and shape graphs under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, base: str = N.BASE):
        self.spark, self.path, self.base = spark, path.rstrip("/"), base

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def records(self) -> DataFrame:
        return self._read("records", RECORDS)

    def quads(self) -> DataFrame:
        """The default graph and the shape graph of every record."""
        records = self.records()
        return union(record_quads(records, self.base), self._read("quads", QUADS).join(records.select(F.col("shapes").alias("graph")), "graph", "left_semi"))

    def graph(self, name: str) -> DataFrame:
        return self._read("quads", QUADS).where(F.col("graph") == name)

    def register(self, frames: SnapshotFrames, shapes_iri: str | None = None) -> str:
        """Write the shapes into a fresh graph, then the record that makes them visible."""
        name = shapes_iri or N.HARVEST + token()
        shape_quads(frames, F.lit(name), self.base).coalesce(1).write.mode("append").partitionBy("graph").parquet(f"{self.path}/quads")
        record_rows(frames, F.lit(name), self.base).coalesce(1).write.mode("append").parquet(f"{self.path}/records")
        return name

    def latest_shapes(self, database: str | None, schema: str) -> DataFrame:
        found = latest(self.records(), database, schema).select("shapes").first()
        return self.graph(found[0]) if found else self.spark.createDataFrame([], QUADS)

    def history(self, database: str | None, schema: str) -> DataFrame:
        return history(self.records(), database, schema)


def version_quads(frames: SnapshotFrames, changes: DataFrame, version: int, base: str = N.BASE, previous: int | None = None) -> DataFrame:
    """Registry, snapshot and changes graphs of a numbered version; the previous one is the number before it unless it is named."""
    from quadrille.operators.frames import with_keys

    c, s = F.col, frames.snapshots.join(frames.counts(), "snapshot_id")
    db, sc = c("database_name"), c("schema_name")
    at = lambda rest: N.version_iri(db, sc, rest, base)
    registry, snapshot, changed, node = at("registry"), at(f"v{version}"), at(f"v{version}/changes"), at(f"version_{version}")
    repo = F.concat(F.lit(base + "repo/"), N.sanitise(db), F.lit("_"), N.sanitise(sc))
    schema = F.concat(repo, F.lit("_Schema"))
    strings = {"databaseType": "database_type", "databaseName": "database_name", "host": "host", "warehouse": "warehouse", "jdbcUrl": "jdbc_url", "authMode": "auth_mode"}
    parts = [
        emit(s, registry, repo, [F.lit(0)], [type_of(DR + "DataRepository"), *[(DR + p, lit(c(x)), N.is_set(c(x))) for p, x in strings.items()], (DR + "hasSchema", iri(schema))]),
        emit(s, registry, schema, [F.lit(1)], [type_of(DR + "DatabaseSchema"), (DR + "schemaName", lit(sc)), (DR + "hasVersion", iri(node))]),
        emit(s, registry, node, [F.lit(2)], [type_of(DR + "SchemaVersion"), (DR + "versionNumber", lit(str(version), "int")), (DR + "versionLabel", lit(f"v{version}")), (DR + "snapshotOf", iri(schema)), (DR + "isCurrent", lit("true", "boolean")), (DR + "tableCount", lit(c("table_count"), "int")), (DR + "columnCount", lit(c("column_count"), "int")), (DR + "extractedAt", lit(N.iso_instant(c("extracted_at")), "dateTime")), (DR + "snapshotGraph", iri(snapshot)), *([(DR + "previousVersion", iri(at(f"version_{previous or version - 1}")))] if (version if previous is None else previous + 1) > 1 else [])]),
    ]
    where = frames.snapshots.select("snapshot_id", "database_name", "schema_name")
    table = at(F.concat(F.lit("table/"), N.pascal(c("table_name"))))
    column = at(F.concat(F.lit("column/"), N.pascal(c("table_name")), F.lit("_"), N.pascal(c("column_name"))))
    tables, columns = frames.tables.join(where, "snapshot_id"), with_keys(frames).join(where, "snapshot_id")
    parts += [
        emit(tables, snapshot, table, [F.lit(3), c("table_seq"), F.lit(0)], [type_of(DR + "DatabaseTable"), (DR + "tableName", lit(c("table_name"))), (DR + "tableType", lit(c("table_type"))), (DR + "tableRemarks", lit(c("remarks")), N.is_set(c("remarks")))]),
        emit(columns, snapshot, column, [F.lit(3), c("table_seq"), F.lit(1), c("col_seq")], [type_of(DR + "TableColumn"), (DR + "columnName", lit(c("column_name"))), (DR + "sqlDataType", lit(c("data_type"))), (DR + "ordinalPosition", lit(c("ordinal_position"), "int")), (DR + "isNullable", lit(c("nullable"), "boolean")), (DR + "isPrimaryKey", lit(c("primary_key"), "boolean")), (DR + "isForeignKey", lit(c("is_fk"), "boolean")), (DR + "maxLength", lit(c("max_length"), "int"))]),
        emit(columns, snapshot, table, [F.lit(3), c("table_seq"), F.lit(2), c("col_seq")], [(DR + "hasColumn", iri(column))]),
    ]
    moved = changes.crossJoin(F.broadcast(where))  # one snapshot
    change = F.concat(changed, F.lit("/change_"), c("change_no"))
    parts += [
        emit(moved, changed, change, [F.lit(4), c("change_no")], [type_of(DR + "SchemaChange"), (DR + "changeType", lit(c("change_type"))), (DR + "changeDescription", lit(c("description"))), (DR + "affectsTable", iri(table)), (DR + "affectsColumn", iri(column), c("column_name").isNotNull()), (DR + "previousValue", lit(c("previous_value"))), (DR + "newValue", lit(c("new_value")))]),
        emit(moved, changed, node, [F.lit(5), c("change_no")], [(DR + "hasChange", iri(change))]),
    ]
    return as_set(union(*parts))


class VersionStore(Registry):
    """Numbered versions with their changes, each in graphs of its own."""

    def versions(self) -> DataFrame:
        return with_previous(self._read("versions", VERSIONS))

    def _claim(self, database: str | None, schema: str | None, number: int) -> int:
        """The first number from the given one on that no other writer has."""
        jvm = self.spark.sparkContext._jvm
        folder = f"{self.path}/claims/" + "/".join("n" + (x or "").encode().hex() for x in (database, schema))
        while True:
            where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")
            try:
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(where, False).close()
                return number
            except Py4JJavaError as e:
                if not e.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
                    raise
                number += 1

    def save(self, frames: SnapshotFrames, changes: DataFrame) -> int:
        snap = frames.snapshots.first()
        database, schema = snap["database_name"], snap["schema_name"]
        first = next_version(self._read("versions", VERSIONS), database, schema).first()[0]
        number = self._claim(database, schema, first)
        version_quads(frames, changes, number, self.base, first - 1).coalesce(1).write.mode("append").partitionBy("graph").parquet(f"{self.path}/quads")
        row = frames.snapshots.join(frames.counts(), "snapshot_id").select("database_name", "schema_name", F.lit(number).alias("version"), "snapshot_id", "extracted_at", "table_count", "column_count", F.lit(changes.count()).alias("change_count"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return number

    def _at(self, database: str, schema: str, rest: str) -> Column:
        """The name under which version_quads writes; it folds to a literal, so the graph is read by partition pruning."""
        return N.version_iri(F.lit(database), F.lit(schema), rest, self.base)

    def registry_graph(self, database: str, schema: str) -> DataFrame:
        """The registry graph with isCurrent true for the last version alone; the flag follows from the numbers."""
        mine = self.versions().where((F.col("database_name") == database) & (F.col("schema_name") == schema))
        flags = mine.select(F.concat(self._at(database, schema, "version_"), F.col("version").cast("string")).alias("s"), F.col("is_current").cast("string").alias("flag"))
        found = self._read("quads", QUADS).where(F.col("graph") == self._at(database, schema, "registry")).join(mine.select("snapshot_id").distinct(), "snapshot_id", "left_semi").join(flags, "s", "left")
        return found.withColumn("o", F.when(F.col("p") == DR + "isCurrent", F.col("flag")).otherwise(F.col("o"))).drop("flag")

    def snapshot_graph(self, database: str, schema: str, version: int) -> DataFrame:
        return self._read("quads", QUADS).where(F.col("graph") == self._at(database, schema, f"v{version}"))

    def changes_graph(self, database: str, schema: str, version: int) -> DataFrame:
        return self._read("quads", QUADS).where(F.col("graph") == self._at(database, schema, f"v{version}/changes"))
