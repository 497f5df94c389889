"""Where operators keep what later steps read again.

On a cluster, executors and driver share only the folder that the session names
in spark.checkpoint.dir. Tables written there survive the loss of an executor;
nothing is kept with localCheckpoint or in a machine's own folder.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
import xxhash


# While a step runs: its shuffle files go when it is over, not when the driver's garbage is collected, and what goes
# to Python at once is small.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where none is named, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
            named = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        sc.setCheckpointDir(named)
        held = sc._jsc.sc().getCheckpointDir()
    return named or held.get()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables of one run of an operator; `drop` removes one, `close` removes all that are left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.held: set[str] = set()
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.held.add(name)
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows once as Parquet and read them from there: lineage ends here."""
        schema, conf = df.schema, self.spark.conf
        before = {k: conf.get(k) for k in _STEP}
        for k, v in _STEP.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
            self.held.discard(name)

    def close(self) -> None:
        if self.held:
            self.held.clear()
            try:
                _delete(self.spark, self.root)
            except Exception:  # the session has ended and its folder is gone or out of reach
                pass


def small(df: DataFrame) -> DataFrame:
    """Checkpoint a narrow result: the cleaner removes the files when the last reference goes."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_row_key(docs: DataFrame, work: Workspace, key: str) -> DataFrame:
    """The rows with a distinct long in column `key`, which stays the same however often and in whatever parts they are read.

    It is the number of the row in its file plus a hash of the file's path; the
    hashes are drawn anew until no two files are near each other. Rows that don't
    come straight from Parquet files are written to such first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "parquet" not in plan.toString():
        docs = work.table(docs, f"rows-{uuid.uuid4().hex}")
    scheme = "^[A-Za-z0-9+.-]+:/+"
    files, seed = [re.sub(scheme, "", path) for path in docs.inputFiles()], 0
    while True:
        at = sorted(xxhash.xxh64(f"{path}#{seed}".encode(), seed=42).intdigest() >> 2 for path in files)
        if all(b - a >> 36 for a, b in zip(at, at[1:], strict=False)):
            break
        seed += 1
    place = F.xxhash64(F.concat(F.regexp_replace("_metadata.file_path", scheme, ""), F.lit(f"#{seed}")))
    return docs.withColumn(key, F.shiftrightunsigned(place, 2) + F.col("_metadata.row_index"))


def integer_ids(docs: DataFrame, id_col: str) -> Column:
    """The ids as longs; ids of another kind are an error of the call, found before any job."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"column {id_col} must hold integers, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name for internal use that the input does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
