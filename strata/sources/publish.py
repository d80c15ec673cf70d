"""Staged publishing of tables.

A run writes its tables into a folder of its own, ``runs/<run id>``, checks
them there, and then names all of them in one manifest.  Readers follow the
newest manifest, so the tables of a run become visible together; a run that
fails, or is repeated after a crash, leaves what is published as it is.

A manifest is one file of a few rows that a single rename brings into place
(``manifests/version=<number>``).  It also holds the state of the input that
the run read: names, sizes and times of its files.  A run whose input has not
changed since need not be repeated.

Two runs that publish at the same moment want the same version; the second one
fails and can be repeated.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.sources.io import read_table, write_table

MANIFEST = "table_name string, location string, row_count bigint, run_id string, input_state string"


class ValidationError(ValueError):
    """A table of a run must not be published."""


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of the files below ``paths``, as one text; the
    files themselves are not read."""
    files = None
    for p in paths:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "length", "modificationTime")
        files = files.unionByName(f) if files else f
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
    return f"{r['n']}-{r['size']}-{r['h']}"


def manifests(spark: SparkSession, out: str) -> DataFrame:
    """(manifest columns, version) of all versions; none yet: no rows."""
    schema = f"{MANIFEST}, version int"
    try:
        return spark.read.schema(schema).json(f"{out}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def published(spark: SparkSession, out: str, version: int | None = None) -> dict:
    """table -> manifest row of the newest version, or of ``version``."""
    rows = manifests(spark, out).collect()  # a row a table and version
    last = max((r["version"] for r in rows), default=None) if version is None else version
    return {r["table_name"]: r for r in rows if r["version"] == last}


def read_published(spark: SparkSession, out: str, table: str, version: int | None = None) -> DataFrame:
    """A published table; readers that have begun keep the version they saw."""
    row = published(spark, out, version).get(table)
    if row is None:
        raise KeyError(f"{table} is not published in {out}")
    return read_table(spark, row["location"])


class Run:
    """One run: tables are written aside, checked, and published together."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.run_id, self.rows, self.named = spark, out.rstrip("/"), uuid.uuid4().hex[:12], {}, []

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None, key: list[str] | None = None,
              buckets: tuple[int, str] | None = None) -> DataFrame:
        """Write a table of the run, check it, and read it back.

        A table needs rows, the columns it was written with, and, where
        ``key`` names its key, no null and no repeated one.  Rows are counted
        while they are written.  ``buckets`` (number, column): the table is
        written in so many buckets; until ``close`` the catalog names them, so
        that tables in equal buckets are joined on the column without a shuffle.
        """
        location, seen = f"{self.out}/runs/{self.run_id}/{name}", Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if buckets:
            self.named.append(f"strata_run_{self.run_id}_{name.replace('/', '_')}")
            counted.write.format("parquet").option("compression", "snappy").bucketBy(*buckets).option("path", location).saveAsTable(self.named[-1])
        else:
            write_table(counted, location, partition_by=partition_by)
        rows = seen.get["rows"]
        if not rows:
            raise ValidationError(f"{name}: no rows")
        back = self.spark.table(self.named[-1]) if buckets else read_table(self.spark, location)
        if sorted(back.columns) != sorted(df.columns):
            raise ValidationError(f"{name}: columns {back.columns}, expected {df.columns}")
        if key:
            empty = back.where(" OR ".join(f"`{c}` IS NULL" for c in key)).limit(1).count()
            if empty or back.groupBy(*key).count().where("count > 1").limit(1).count():
                raise ValidationError(f"{name}: {', '.join(key)} is no key")
        self.rows[name] = (name, location, rows, self.run_id)
        return back

    def close(self) -> None:
        """Take the run's names out of the catalog; the files stay."""
        while self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.named.pop()}`")

    def publish(self, state: str = "") -> int:
        """Make the tables of the run visible; returns the version."""
        past = manifests(self.spark, self.out).agg(F.max("version")).first()[0]
        version = (past or 0) + 1
        rows = self.spark.createDataFrame([(*r, state) for r in self.rows.values()], MANIFEST)
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.out}/manifests/version={version:06d}")
        return version


def expire(spark: SparkSession, out: str, keep: int = 2) -> list[str]:
    """Delete the run folders that none of the last ``keep`` versions names;
    returns the runs of earlier versions that went.  Folders of runs that were
    never published stay: a run may still be writing."""
    rows = manifests(spark, out).collect()
    newest = sorted({r["version"] for r in rows})[-keep:]
    kept = {r["run_id"] for r in rows if r["version"] in newest}
    gone = sorted({r["run_id"] for r in rows} - kept)
    for run in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/runs/{run}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
