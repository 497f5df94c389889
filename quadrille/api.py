"""The engine as one object: what the endpoints of a service would call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.naming import BASE
from quadrille.operators import filters, ontology, triples
from quadrille.operators.evolution import diff
from quadrille.operators.frames import SnapshotFrames
from quadrille.operators.shapes import ShapeTable, shape_quads, shape_tables
from quadrille.operators.versions import Registry
from quadrille.plans import sqltext
from quadrille.sources.serialize import Format, serialize


@dataclass
class Extraction:
    """What an extraction reports."""

    tables: int
    columns: int
    foreign_keys: int
    triples: int = 0
    graphs: dict[str, str] = field(default_factory=dict)
    shapes: str | None = None
    shapes_iri: str | None = None
    warnings: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, frames: SnapshotFrames, registry: Registry | None = None, base: str = BASE):
        self.spark, self.frames, self.registry, self.base = spark, frames, registry, base
        self._shapes: list[ShapeTable] | None = None

    def preview(self) -> SnapshotFrames:
        return self.frames

    def ping(self) -> dict[str, object]:
        head = self.frames.snapshots.first()
        return {"status": "OK", "database": head["database_name"], "schema": head["schema_name"], "tables": self.frames.tables.count()}

    def graph(self, kind: str) -> DataFrame:
        """One of the four ontology graphs, or `merged`."""
        if kind == "merged":
            return triples.merged(ontology.ontology_quads(self.frames, self.base).drop("kind"), self.base + "merged")
        if kind not in ontology.GRAPHS:
            raise LookupError(f"no graph {kind}; available: {', '.join([*ontology.GRAPHS, 'merged'])}")
        return ontology.GRAPHS[kind](self.frames, self.base)

    def shapes(self) -> DataFrame:
        return shape_quads(self.frames, base=self.base)

    def extract(self, axioms: bool = True, with_shapes: bool = True, form: Format = Format.TURTLE) -> Extraction:
        counts = self.frames.counts().first()
        out = Extraction(counts["table_count"], counts["column_count"], counts["fk_count"])
        if axioms:
            out.graphs = {kind: serialize(self.graph(kind), form) for kind in [*ontology.GRAPHS, "merged"]}
            out.triples = ontology.ontology_quads(self.frames, self.base).count()
        if with_shapes:
            out.shapes = serialize(self.shapes(), form)
        if self.registry:
            out.shapes_iri = self.registry.register(self.frames)
        out.warnings = [f"Table '{r['table_name']}' has no columns" for r in self.frames.without_columns().collect()]
        return out

    def shape_tables(self) -> list[ShapeTable]:
        if self._shapes is None:
            self._shapes = shape_tables(self.frames)
        return self._shapes

    def generate_sql(self, kinds: list[str] | None = None, dialect: str = "ANSI", include: list[str] | None = None) -> dict[str, list[sqltext.Statement]]:
        return sqltext.statements(self.shape_tables(), kinds, dialect, include)

    def filter_sql(self, raw: dict) -> sqltext.Statement:
        request = filters.Request.parse(raw)
        return sqltext.filter_select(request, filters.resolve(request.table, self.shape_tables()))

    def filter_select(self, raw: dict, df: DataFrame) -> DataFrame:
        """Run a filter request over the table's DataFrame."""
        request = filters.Request.parse(raw)
        return filters.run(request, df, filters.resolve(request.table, self.shape_tables()))

    def diff(self, previous: SnapshotFrames | None) -> DataFrame:
        return diff(previous, self.frames)

    def _held(self) -> Registry:
        if self.registry is None:
            raise LookupError("no registry is attached")
        return self.registry

    def latest(self, database: str | None, schema: str) -> DataFrame:
        found = self._held().latest_shapes(database, schema)
        if found.isEmpty():
            raise LookupError(f"no shapes of {database}/{schema}")
        return found

    def history(self, database: str | None, schema: str) -> DataFrame:
        return self._held().history(database, schema)
