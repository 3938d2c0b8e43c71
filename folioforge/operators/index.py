"""State of an index: upserts, replacements, completed groups, status. A version is a Parquet folder and a pointer to it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key it lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def replace_by_path(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """All rows of new's paths are replaced: a path is stable while its content, hashes and number of chunks change."""
    return new.unionByName(old.join(new.select(path).distinct(), path, "left_anti"))


def completed_groups(files: DataFrame, group: str, failed: Column, chunks: Column) -> DataFrame:
    """Groups of which no file failed and that have a chunk at least."""
    return files.groupBy(group).agg(F.bool_or(failed).alias("failed"), F.sum(chunks).alias("n_chunks")).where("not failed and n_chunks > 0").select(group, "n_chunks")


def status(index: DataFrame, dim: int) -> DataFrame:
    """One row: rows, smallest and largest embedding, whether all have the wanted size, ready."""
    n = F.size("embedding")
    return index.agg(F.count("*").alias("n_rows"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim"), F.count_if(n != dim).alias("n_wrong"), F.coalesce(F.min(n) == dim, F.lit(False)).alias("ready"))


def _point(spark: SparkSession, root: str, version: str, schema_id: str) -> None:
    spark.createDataFrame([(version, schema_id)], "version string, schema_id string").coalesce(1).write.mode("append").json(f"{root}/pointer")


def _newest(spark: SparkSession, root: str) -> Row | None:
    """(version, schema_id) pointed to last; none if nothing is there."""
    try:
        rows = spark.read.schema("version string, schema_id string").json(f"{root}/pointer")
    except AnalysisException:
        return None
    return rows.select("version", "schema_id", F.col("_metadata.file_modification_time").alias("at")).orderBy(F.desc("at"), F.desc("version")).first()


def _pointed(spark: SparkSession, root: str, schema_id: str) -> str:
    """The version pointed to last; another schema_id is refused."""
    newest = _newest(spark, root)
    if newest is None or newest.schema_id != schema_id:
        raise ValueError(f"index at {root} has schema {newest and newest.schema_id}, not {schema_id}")
    return newest.version


def publish(df: DataFrame, root: str, version: str, schema_id: str) -> None:
    """Writes a version beside the old ones and then points to it; readers see the old or the new one, never a part."""
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    _point(df.sparkSession, root, version, schema_id)


def current(spark: SparkSession, root: str, schema_id: str) -> DataFrame:
    """The version pointed to last; another schema_id is refused."""
    return spark.read.parquet(f"{root}/versions/{_pointed(spark, root, schema_id)}")


def bucket(path: str | Column, buckets: int) -> Column:
    """The bucket of a path, by its hash."""
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Buckets:
    """An index whose rows lie in hash buckets of their path. A replacement writes the buckets that it touches anew, beside the old ones, and points to a list of which version
    of each bucket counts: other buckets' files stay as they are, and readers see all of it or nothing.

    Below root: rows/version=V/bucket=B/ (Parquet), lists/V (bucket, version), pointer (version, schema_id). What comes to the driver is a number for each bucket.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, path: str, schema_id: str, buckets: int = 64):
        self.spark, self.root, self.path, self.schema_id, self.buckets = spark, root, path, schema_id, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _list(self, version: str) -> dict[int, str]:
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version string").parquet(f"{self.root}/lists/{version}").collect()}

    def _listed(self) -> dict[int, str]:
        """The buckets that count. Nothing is there before the first version, and an index without rows takes any schema."""
        newest = _newest(self.spark, self.root)
        if newest is None:
            return {}
        listed = self._list(newest.version)
        if listed and newest.schema_id != self.schema_id:
            raise ValueError(f"index at {self.root} has schema {newest.schema_id}, not {self.schema_id}")
        return listed

    def _read(self, listed: dict[int, str]) -> DataFrame:
        if not listed:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.root}/rows/version={v}/bucket={b}" for b, v in sorted(listed.items())]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _write(self, rows: DataFrame, version: str, stay: dict[int, str]) -> None:
        """Rows of whole buckets as a version; stay: the buckets that keep theirs."""
        at = f"{self.root}/rows/version={version}"
        dealt = rows.select(*self.schema.names).withColumn("bucket", bucket(self.path, self.buckets))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.path).write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = self.spark.read.schema(f"{self.schema.names[0]} {self.schema[0].dataType.simpleString()}, bucket int").parquet(at).select("bucket").distinct().collect()
        listed = stay | {r.bucket: version for r in written}
        self.spark.createDataFrame(sorted(listed.items()), "bucket int, version string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/{version}")
        _point(self.spark, self.root, version, self.schema_id)

    def rebuild(self, rows: DataFrame, version: str) -> None:
        """All rows anew, whatever schema the index had: an explicit rebuild is the way to another one."""
        self._write(rows, version, {})

    def rows(self) -> DataFrame:
        return self._read(self._listed())

    def replace(self, rows: DataFrame, paths: DataFrame, version: str) -> list[int]:
        """All rows of the paths (one column) give way to those of rows; a path that rows lacks is gone. Rows of other paths are refused. Returns the buckets that were written.

        A path is stable while its content changes. An index of another schema is refused, unless it is empty.
        """
        listed = self._listed()
        named = paths.toDF(self.path).where(F.col(self.path).isNotNull()).distinct()
        if rows.join(named, self.path, "left_anti").limit(1).count():
            raise ValueError("rows of paths that are not replaced")
        touched = sorted(r[0] for r in named.select(bucket(self.path, self.buckets)).distinct().collect())
        old = self._read({b: listed[b] for b in touched if b in listed}).join(named, self.path, "left_anti")
        self._write(old.unionByName(rows.select(*self.schema.names)), version, {b: v for b, v in listed.items() if b not in touched})
        return touched
