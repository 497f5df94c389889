"""Structural differences of two snapshots, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.xsd import for_diff
from quadrille.operators.frames import SnapshotFrames

CHANGES = "change_type string, table_name string, column_name string, previous_value string, new_value string, description string, seq array<int>"


def _first(df: DataFrame, by: list[Column], order: str) -> DataFrame:
    """The first row of each name, ignoring case."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _changes(df: DataFrame, kind: Column | str, table: Column, column: Column | None, previous: Column | None, new: Column | None, text: Column, seq: list) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(kind.alias("change_type"), table.alias("table_name"), (none if column is None else column).alias("column_name"), (none if previous is None else previous.cast("string")).alias("previous_value"), (none if new is None else new.cast("string")).alias("new_value"), text.alias("description"), F.array(*[x.cast("int") if isinstance(x, Column) else F.lit(x) for x in seq]).alias("seq"))


def diff(previous: SnapshotFrames | None, current: SnapshotFrames) -> DataFrame:
    """All changes, numbered by change_no in the order: tables added, tables dropped, then table by table
    columns added, dropped and altered (type, nullability, length), primary key, foreign keys added, dropped.

    Names are compared ignoring case; without a previous snapshot there is no change. Foreign keys are
    matched by name, those without a name by their columns (so that they aren't new each time).
    """
    if previous is None:
        return current.tables.sparkSession.createDataFrame([], CHANGES).withColumn("change_no", F.lit(0).cast("long")).drop("seq")
    c = F.col
    key = lambda f: _first(f.tables.withColumn("k", F.upper("table_name")), [c("k")], "table_seq").select("k", "table_name", "table_seq")
    old, new = key(previous), key(current)
    added = _changes(new.join(old, "k", "left_anti"), "TABLE_ADDED", c("k"), None, None, None, _text("Table '", c("k"), "' was added"), [0, c("table_seq")])
    dropped = _changes(old.join(new, "k", "left_anti"), "TABLE_DROPPED", c("k"), None, None, None, _text("Table '", c("k"), "' was dropped"), [1, c("table_seq")])
    both = new.join(old.select("k"), "k")

    cols = lambda f: _first(f.columns.withColumn("k", F.upper("table_name")).withColumn("ck", F.upper("column_name")), [c("k"), c("ck")], "col_seq").select("k", "ck", F.struct("column_name", "data_type", "nullable", "max_length", "col_seq").alias("v"))
    sides = cols(current).withColumnRenamed("v", "n").join(cols(previous).withColumnRenamed("v", "o"), ["k", "ck"], "full_outer").join(both.select("k", "table_name", "table_seq"), "k")
    t, at = c("table_name"), c("table_seq")
    col_added = _changes(sides.where("o is null"), "COLUMN_ADDED", t, c("ck"), None, c("n.data_type"), _text("Column '", t, ".", c("ck"), "' was added (", c("n.data_type"), F.when(c("n.nullable"), ", nullable").otherwise(", NOT NULL"), ")"), [2, at, 0, c("n.col_seq"), 0])
    col_dropped = _changes(sides.where("n is null"), "COLUMN_DROPPED", t, c("ck"), c("o.data_type"), None, _text("Column '", t, ".", c("ck"), "' was dropped"), [2, at, 1, c("o.col_seq"), 0])
    kept = sides.where("o is not null and n is not null")
    name = c("n.column_name")
    show = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    altered = [
        _changes(kept.where(for_diff(c("o.data_type")) != for_diff(c("n.data_type"))), "COLUMN_TYPE_CHANGED", t, name, c("o.data_type"), c("n.data_type"), _text("Column '", t, ".", name, "' type changed from '", c("o.data_type"), "' to '", c("n.data_type"), "'"), [2, at, 2, c("n.col_seq"), 0]),
        _changes(kept.where(c("o.nullable") != c("n.nullable")), "COLUMN_NULLABILITY_CHANGED", t, name, c("o.nullable"), c("n.nullable"), _text("Column '", t, ".", name, "' nullability changed from ", c("o.nullable"), " to ", c("n.nullable")), [2, at, 2, c("n.col_seq"), 1]),
        _changes(kept.where(~c("o.max_length").eqNullSafe(c("n.max_length"))), "COLUMN_LENGTH_CHANGED", t, name, show(c("o.max_length")), show(c("n.max_length")), _text("Column '", t, ".", name, "' maxLength changed from ", c("o.max_length"), " to ", c("n.max_length")), [2, at, 2, c("n.col_seq"), 2]),
    ]

    pks = lambda f, name: f.primary_keys.groupBy(F.upper("table_name").alias("k")).agg(F.array_sort(F.collect_list(F.upper("column_name"))).alias(name))
    none = F.array().cast("array<string>")
    keyed = both.join(pks(previous, "o"), "k", "left").join(pks(current, "n"), "k", "left").withColumn("o", F.coalesce("o", none)).withColumn("n", F.coalesce("n", none))
    show_list = lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    pk = _changes(keyed.where("o != n"), "PRIMARY_KEY_CHANGED", t, None, None, None, _text("Primary key changed from ", show_list(c("o")), " to ", show_list(c("n"))), [2, at, 3, 0, 0])

    def fks(f: SnapshotFrames) -> DataFrame:
        target = F.concat(c("pk_table"), F.lit("."), c("pk_column"))
        return f.foreign_keys.select(F.upper("fk_table").alias("k"), "fk_seq", "constraint_name", "fk_column", target.alias("target"), F.coalesce("constraint_name", F.concat(F.lit("\u0000"), "fk_column", F.lit("\u0000"), target)).alias("fk_key"))

    fk_added = _changes(fks(current).join(fks(previous).select("k", "fk_key"), ["k", "fk_key"], "left_anti").join(both, "k"), "FOREIGN_KEY_ADDED", t, c("fk_column"), None, c("target"), _text("FK '", c("constraint_name"), "' added: ", t, ".", c("fk_column"), " → ", c("target")), [2, at, 4, c("fk_seq"), 0])
    fk_dropped = _changes(fks(previous).join(fks(current).select("k", "fk_key"), ["k", "fk_key"], "left_anti").join(both, "k"), "FOREIGN_KEY_DROPPED", t, c("fk_column"), c("target"), None, _text("FK '", c("constraint_name"), "' dropped"), [2, at, 5, c("fk_seq"), 0])

    out = added
    for part in (dropped, col_added, col_dropped, *altered, pk, fk_added, fk_dropped):
        out = out.unionByName(part)
    return out.withColumn("change_no", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long")).drop("seq")
